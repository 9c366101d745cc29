import pytest
from pyspark.sql import functions as F

from loamstone.engine import Engine
from loamstone.errors import InvalidArgument, NotFound, UnsupportedSource
from loamstone.operators import embedding, evaluation, generation
from loamstone.operators.store import Store


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    return Engine(spark, Store(spark, f"file://{tmp_path_factory.mktemp('engine')}"))


def files(spark, *rows):
    return spark.createDataFrame([(p, c.encode()) for p, c in rows], "path string, content binary")


def test_whole_life(spark, engine):
    chat, empty = engine.store.create_chat("One"), engine.store.create_chat("Two")
    ids = engine.upload(files(spark, ("a.md", "# Turbine\n\nThe turbine spins fast.\n"), ("b.txt", "Bees make honey.")), chat)
    assert {engine.document(i)["status"] for i in ids} == {"pending"}
    assert engine.process()["chunks"] == 3
    assert engine.process() == {}
    assert {engine.document(i)["status"] for i in ids} == {"completed"}
    best = engine.search("who makes honey", 2).orderBy("rank").first()
    assert best["content"].startswith("Bees make honey.")
    assert "honey" in engine.chat_ask(chat, "honey?", 1)
    assert engine.chat_ask(empty, "honey?") == generation.NO_ANSWER
    assert engine.chat_search(empty, "honey").count() == 0
    assert [r["role"] for r in engine.store.messages(chat).collect()] == ["user", "assistant"]
    both = spark.createDataFrame([("1", "turbine"), ("2", "bees")], "query_id string, text string")
    assert engine.ask(both, 1).count() == 2
    with pytest.raises(NotFound):
        engine.chat_search("123e4567-e89b-12d3-a456-426614174000", "x")
    with pytest.raises(InvalidArgument):
        engine.search("  ")
    with pytest.raises(InvalidArgument):
        engine.search("x", 51)
    with pytest.raises(UnsupportedSource):
        engine.upload(files(spark, ("c.gif", "")))
    with pytest.raises(NotFound):
        engine.document("unknown")


def test_failed_files_and_golden_corpus(spark, tmp_path):
    import json

    engine = Engine(spark, Store(spark, f"file://{tmp_path}/store"))
    ids = engine.upload(files(spark, ("a.txt", "Bees make honey."), ("b.docx", "broken")))
    engine.process()
    states = [engine.document(i) for i in ids]
    assert sorted(s["status"] for s in states) == ["completed", "failed"]
    assert "BadZipFile" in next(s["error"] for s in states if s["status"] == "failed")
    golden = {"queries": [{"query": "who makes honey", "relevant_chunk_ids": ["g1"]}, {"query": "fast turbine", "relevant_chunk_ids": ["g2"]}],
              "corpus": [{"chunk_id": "g1", "content": "Honey is what bees make."}, {"chunk_id": "g2", "content": "A turbine spins fast."}]}
    (tmp_path / "golden.json").write_text(json.dumps(golden))
    queries, corpus = evaluation.golden(spark, f"file://{tmp_path}/golden.json")
    assert engine.add_golden(corpus) == 2
    rows = {r["retriever"]: r for r in engine.evaluate(queries, 3).collect()}
    assert rows["sparse"]["recall"] == 1.0
    assert {r["cases"] for r in rows.values()} == {2}
    assert engine.health() == {"status": "ok", "chunks": 3, "indexed": 3}
    assert engine.backfill() == 0
    engine.delete(next(i for i, s in zip(ids, states, strict=True) if s["status"] == "completed"))
    assert engine.health() == {"status": "ok", "chunks": 2, "indexed": 2}


def test_embedding(spark):
    provider = embedding.HashingEmbedder(8)
    rows = spark.createDataFrame([("a", "x y"), ("b", "x y"), ("c", "!")], "chunk_id string, content string")
    vectors = {r["chunk_id"]: r["embedding"] for r in embedding.embed_chunks(rows, provider).collect()}
    assert vectors["a"] == vectors["b"]
    assert all(abs(sum(v * v for v in x) - 1) < 1e-9 for x in vectors.values())
    with pytest.raises(Exception, match="blank text"):
        embedding.embed_chunks(rows.withColumn("content", F.lit(" ")), provider).collect()
    assert embedding.vector_size(embedding.embed_chunks(rows, provider)) == 8
    assert embedding.vector_size(embedding.embed_chunks(rows.limit(0), provider)) is None
