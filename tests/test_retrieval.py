import glob

import duckdb
import pytest
from pyspark.sql import functions as F

from loamstone.errors import InvalidArgument
from loamstone.operators import evaluation, generation, graph, preprocess, relationships, retrieval
from loamstone.plans import search


def lists(spark, *rankings):
    rows = [("q", n, r, c) for n, ranking in enumerate(rankings) for r, c in enumerate(ranking, start=1)]
    return spark.createDataFrame(rows, "query_id string, list_no int, rank int, chunk_id string")


def order(df):
    return [r["chunk_id"] for r in df.orderBy("rank").collect()]


def test_rrf(spark):
    found = retrieval.reciprocal_rank_fusion(lists(spark, "ABC", "BAD"), 4)
    assert order(found) == ["A", "B", "C", "D"]
    scores = {r["chunk_id"]: r["score"] for r in found.collect()}
    assert scores["A"] == scores["B"] == round(1 / 61 + 1 / 62, 9)
    assert order(retrieval.reciprocal_rank_fusion(lists(spark, "AB", "AC"))) == ["A", "B", "C"]
    assert order(retrieval.reciprocal_rank_fusion(lists(spark, ""))) == []


CHUNKS = [("c1", "d1", 0, "alpha beta gamma", [1.0, 0.0]), ("c2", "d1", 1, "beta beta", [0.9, 0.1]), ("c3", "d2", 0, "delta", [0.2, 0.8]), ("c4", "d2", 1, "", [0.0, 1.0])]
SCHEMA = "chunk_id string, document_id string, chunk_index int, content string, embedding array<double>"


@pytest.fixture
def chunks(spark):
    return spark.createDataFrame(CHUNKS, SCHEMA)


@pytest.fixture
def queries(spark):
    return spark.createDataFrame([("q", "Beta?", [1.0, 0.0])], "query_id string, text string, embedding array<double>")


def test_dense_and_sparse(chunks, queries):
    assert order(retrieval.dense(queries, chunks, 3)) == ["c1", "c2", "c3"]
    assert order(retrieval.sparse(queries, chunks, 3)) == ["c2", "c1"]
    assert order(retrieval.hybrid(queries, chunks, 2)) == ["c1", "c2"]


def test_scope(spark, chunks, queries):
    scope = spark.createDataFrame([("d2",)], "document_id string")
    assert order(retrieval.dense(queries, chunks, 5, scope)) == ["c3", "c4"]
    assert order(retrieval.sparse(queries, chunks, 5, scope)) == []
    assert order(retrieval.dense(queries, chunks, 5, scope.limit(0))) == []


def test_empty_queries(chunks, queries):
    assert retrieval.dense(queries.limit(0), chunks, 3).count() == 0
    assert retrieval.sparse(queries.limit(0), chunks, 3).count() == 0


def test_arguments(chunks, queries):
    with pytest.raises(InvalidArgument):
        retrieval.dense(queries, chunks, 0)
    with pytest.raises(InvalidArgument):
        retrieval.hybrid(queries, chunks, 5, 3)


def test_zero_vector(spark, chunks, queries):
    bad = chunks.withColumn("embedding", F.array(F.lit(0.0), F.lit(0.0)))
    with pytest.raises(Exception, match="zero vector"):
        retrieval.dense(queries, bad, 3).collect()


def test_variants(spark, queries):
    made = spark.createDataFrame([("q", 1, " beta? "), ("q", 2, ""), ("q", 3, "gamma")], "query_id string, pos int, text string")
    assert [r["text"] for r in retrieval.variants(queries, made).orderBy("pos").collect()] == ["Beta?", "gamma"]


def test_metrics(spark):
    ranking = spark.createDataFrame([("q", 1, "3"), ("q", 2, "2"), ("q", 3, "1")], "query_id string, rank int, chunk_id string")
    judge = lambda *ids: spark.createDataFrame([("q", i) for i in ids], "query_id string, chunk_id string")
    row = evaluation.case_metrics(ranking, judge("2"), 2).first()
    assert (row["recall"], row["precision"], row["mrr"]) == (1.0, 0.5, 0.5)
    row = evaluation.case_metrics(ranking, judge("1"), 2).first()
    assert (row["recall"], round(row["mrr"], 6)) == (0.0, round(1 / 3, 6))
    row = evaluation.case_metrics(ranking.limit(0), judge("1"), 2).first()
    assert (row["recall"], row["precision"], row["mrr"]) == (0.0, 0.0, 0.0)
    row = evaluation.mean_metrics(evaluation.case_metrics(ranking, judge("1").limit(0), 2)).first()
    assert (row["recall"], row["cases"]) == (0.0, 0)


def test_citations(spark):
    results = spark.createDataFrame([("a", 1, "c1", "d"), ("a", 2, "c2", "d")], "query_id string, rank int, chunk_id string, document_id string")
    cites = "answer_id string, citations array<struct<citation_id:int,chunk_id:string,document_id:string>>"
    check = lambda c, r=results: generation.validate_citations(spark.createDataFrame([("a", c)], cites), r).first()
    row = check([(1, "c1", "d"), (3, "c3", "d")])
    assert (row["valid"], row["invalid"], row["coverage"]) == (False, [3], 0.5)
    assert check([])["valid"] is False
    assert check([], results.limit(0))["valid"] is True
    assert check([(1, "c1", "d"), (1, "c1", "d")])["invalid"] == [1]
    assert check([(2, "c1", "d")])["valid"] is False
    assert check([(2, "c2", "x")])["valid"] is False
    assert check([(1, "c1", "d"), (2, "c2", "d")])["valid"] is True


def test_grounded(spark, chunks, queries):
    row = generation.grounded_answers(queries, retrieval.sparse(queries, chunks, 2)).first()
    assert row["answer"] == "[1] beta beta\n\n[2] alpha beta gamma"
    assert [c["chunk_id"] for c in row["citations"]] == ["c2", "c1"]
    row = generation.grounded_answers(queries, retrieval.sparse(queries, chunks, 2).limit(0)).first()
    assert row["answer"] == generation.NO_ANSWER
    assert row["citations"] == []


E = "document_id string, element_id string, ordinal int, element_type string, content_kind string, text string, asset_path string, metadata string"
R = "document_id string, rel_ordinal int, source_element_id string, relationship_type string, target_element_id string"


def test_preprocess_is_idempotent(spark):
    e = spark.createDataFrame([("d", "a", 0, "p", "text", "Hello world", None, "{}"), ("d", "b", 1, "p", "text", " Hello world ", None, "{}"), ("d", "c", 2, "p", "text", "Different", None, "{}"),
                               ("d", "r", 3, "document", "text", "", None, "{}"), ("d", "t", 4, "table", "table", "Hello world", None, "{}"), ("d", "i", 5, "image", "image", None, " ", "{}"), ("e", "a", 0, "p", "text", "Hello world", None, "{}")], E)
    r = spark.createDataFrame([("d", 0, "a", "contains", "c"), ("d", 1, "r", "contains", "a"), ("d", 2, "a", "contains", "missing")], R)
    clean, edges = preprocess.preprocess(e, r)
    assert {(x["document_id"], x["element_id"]) for x in clean.collect()} == {("d", "a"), ("d", "c"), ("d", "t"), ("e", "a")}
    assert [x["target_element_id"] for x in edges.collect()] == ["c"]
    again, edges2 = preprocess.preprocess(clean, edges)
    assert sorted(map(str, again.collect())) == sorted(map(str, clean.collect()))
    assert edges2.count() == 1


def test_expansion(spark):
    e = spark.createDataFrame([("d", x, n, "p", "text", t, None, "{}") for n, (x, t) in enumerate([("sem", "s"), ("img", None), ("par", "the paragraph"), ("far", "far")])], E)
    r = spark.createDataFrame([("d", 0, "sem", "derived_from", "img"), ("d", 1, "par", "refers_to", "img"), ("d", 2, "par", "follows", "far"), ("d", 3, "par", "contains", "gone")], R)
    seeds = spark.createDataFrame([("1", "d", "sem")], "result_id string, document_id string, element_id string")
    one = graph.expand(seeds, r, e, 1).collect()
    assert [x["element_id"] for x in one] == ["img"]
    two = graph.expand(seeds, r, e, 2)
    assert sorted((x["element_id"], x["hop"]) for x in two.collect()) == [("img", 1), ("par", 2)]
    results = spark.createDataFrame([("1", "d", "base"), ("2", "d", "alone")], "result_id string, document_id string, content string")
    merged = {x["result_id"]: x for x in graph.merged_context(results, two, e).collect()}
    assert merged["1"]["content"] == "base\n\n[Related context]\nthe paragraph"
    assert merged["2"]["relationship_context"] == []


def test_time_and_space(spark):
    s = spark.createDataFrame([("d", "s", 10.0, 15.0)], "document_id string, element_id string, start_seconds double, end_seconds double")
    f = spark.createDataFrame([("d", "f", 16.0), ("d", "g", 30.0), ("e", "h", 12.0)], "document_id string, element_id string, timestamp_seconds double")
    found = {(x["source_element_id"], x["target_element_id"]) for x in relationships.temporal_edges(s, f).collect()}
    assert found == {("s", "f"), ("f", "s")}
    box = "document_id string, element_id string, ordinal int, page_number int, slide_number int, bbox struct<x0:double,y0:double,x1:double,y1:double>"
    b = spark.createDataFrame([("d", "a", 0, 1, None, (0.0, 100.0, 50.0, 140.0)), ("d", "b", 1, 1, None, (0.0, 160.0, 50.0, 400.0)), ("d", "c", 2, 2, None, (0.0, 160.0, 50.0, 400.0)), ("d", "e", 3, None, None, (0.0, 900.0, 50.0, 990.0))], box)
    assert relationships.spatial_edges(b).count() == 2


def test_link_texts(spark):
    box = "document_id string, element_id string, ordinal int, page_number int, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>"
    words = spark.createDataFrame([("d", "w2", 2, 1, "here", (30.0, 0.0, 50.0, 10.0)), ("d", "w1", 1, 1, "click", (0.0, 0.0, 25.0, 10.0)), ("d", "w3", 3, 1, "not", (60.0, 0.0, 70.0, 10.0)), ("d", "w4", 4, 2, "page", (0.0, 0.0, 9.0, 9.0))], box)
    links = spark.createDataFrame([("d", "l", 0, 1, "", (0.0, 2.0, 60.0, 8.0))], box)
    assert relationships.link_texts(links, words).first()["text"] == "click here"


def test_model_answers(spark, chunks, queries):
    found = retrieval.sparse(queries, chunks, 2)
    says = lambda text: generation.model_answers(queries, found, lambda q, c: F.lit(text)).first()
    assert [c["chunk_id"] for c in says('{"answer": "a", "citation_ids": [2, 1, 2]}')["citations"]] == ["c1", "c2"]
    assert [c["citation_id"] for c in says('{"answer": "a", "citation_ids": []}')["citations"]] == [1]
    with pytest.raises(Exception, match="out of range"):
        says('{"answer": "a", "citation_ids": [3]}')
    with pytest.raises(Exception, match="cannot be read"):
        says("nothing")
    assert generation.model_answers(queries, found.limit(0), lambda q, c: F.lit("")).first()["answer"] == generation.NO_ANSWER


def test_compare(spark, chunks, queries):
    qrels = spark.createDataFrame([("q", "c2")], "query_id string, chunk_id string")
    rows = evaluation.compare({"dense": lambda q: retrieval.dense(q, chunks, 1), "sparse": lambda q: retrieval.sparse(q, chunks, 1)}, queries, qrels, 1).collect()
    assert [(r["retriever"], r["recall"]) for r in rows] == [("sparse", 1.0), ("dense", 0.0)]
    golden = spark.createDataFrame([("g1", "delta"), ("g2", "none")], "golden_id string, content string")
    assert {r["golden_id"]: r["chunk_id"] for r in evaluation.matched_by_content(golden, chunks).collect()} == {"g1": "c3", "g2": None}


def test_checked(spark, chunks, queries):
    found = retrieval.sparse(queries, chunks, 2)
    assert retrieval.checked(found).count() == 2
    with pytest.raises(Exception, match="lacks part"):
        retrieval.checked(found.withColumn("content", F.lit(None).cast("string"))).collect()


def test_dense_skips_queries_without_a_vector(spark, chunks, queries):
    more = queries.union(spark.createDataFrame([("r", "Delta", None)], queries.schema))
    found = retrieval.hybrid(more, chunks, 2)
    assert order(found.filter("query_id = 'q'")) == ["c1", "c2"]
    assert order(found.filter("query_id = 'r'")) == ["c3"]


def test_hybrid_query_searches_documents_without_a_vector(spark):
    """At sf0.01 half of the documents have a vector; BM25 ranks, and its figures, are those of all documents."""
    data = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        duck.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    sql = f"""with {search.TERMS}, {search.ASKED}, {search.SCORES.format(where='')}, {search.TOP.format(name='sparse', src='scores', k=10)},
     sims as (select cast(b.item_id as varchar) as query_id, cast(d.doc_id as varchar) as chunk_id, round(list_cosine_similarity(x.embedding::double[], y.embedding::double[]), 9) as score
       from benchmark b join embeddings x on x.vec_id = b.item_id cross join documents d join embeddings y on y.vec_id = d.doc_id),
     {search.TOP.format(name='dense', src='sims', k=10)},
     fused as (select query_id, chunk_id, round(sum(1.0 / (60 + rank)), 9) as score from (select query_id, chunk_id, rank from sparse union all select query_id, chunk_id, rank from dense) group by 1, 2),
     {search.TOP.format(name='best', src='fused', k=5)} select query_id, rank, chunk_id, score from best"""
    expected = {(q, r): (c, round(s, 6)) for q, r, c, s in duck.sql(sql).fetchall()}
    got = {(r["query_id"], r["rank"]): (r["chunk_id"], r["score"]) for r in search.hybrid_topk(spark, data).collect()}
    assert got == expected
    plain = {str(r[0]) for r in duck.sql("select doc_id from documents where doc_id not in (select vec_id from embeddings)").fetchall()}
    assert plain & {c for c, _ in got.values()}


def test_best_chunks_are_those_of_sparse_search(spark, monkeypatch):
    texts = ["the red fox the", "The blue fox", "the the the", "", " .,", "red", "ähre Ähre the", "the blue fox"] * 9
    rows = [(f"c{n}", f"d{n % 3}", 0, t) for n, t in enumerate([*texts, None, "the " * 3000 + "owl"])]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id string, chunk_index int, content string")
    asked = [(f"q{n}", t) for n, t in enumerate(["The fox, the fox", "red owl", "nowhere", "", None, "ÄHRE", "blue", "the"])] + [("q0", "owl")]
    queries = spark.createDataFrame(asked, "query_id string, text string")
    rows = lambda df: sorted(map(tuple, df.select("query_id", "rank", "chunk_id", "score").collect()))
    whole = chunks.filter("content is not null")
    for k in (1, 4, 500):
        want = rows(retrieval.ranked(retrieval.bm25_scores(queries, retrieval.Index(whole)), k))
        assert {r[0] for r in want} == {"q0", "q1", "q5", "q6", "q7"}
        for cells, at_once in ((1 << 21, 1024), (8, 2)):  # all at once, and in many parts
            monkeypatch.setattr(retrieval, "CELLS", cells)
            monkeypatch.setattr(retrieval, "CELL_QUERIES", at_once)
            assert rows(retrieval.bm25_best(queries, chunks.repartition(3), k)) == want
    assert rows(retrieval.bm25_best(queries, chunks.limit(0))) == rows(retrieval.bm25_best(queries.limit(0), chunks)) == []
    with pytest.raises(InvalidArgument):
        retrieval.bm25_best(queries, chunks, 0)


def test_multi_query_neither_stores_nor_shuffles_pairs(spark, tmp_path):
    """Texts of frequent words only: a row for each pair of query and document would be 3,000 x 90 for each list."""
    documents = [(n, f"the fox and the owl {n % 7}", f"src{n % 3}") for n in range(3000)]
    spark.createDataFrame(documents, "doc_id long, text string, source string").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(n, f"the owl and the fox {n}") for n in range(30)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(glob.glob(f"{shared}/loamstone/*/*"))
    found = search.multi_query_rrf(spark, f"file://{tmp_path}")
    made = {p.rsplit("/", 1)[1].split("-")[0] for p in set(glob.glob(f"{shared}/loamstone/*/*")) - before}
    assert len(found.collect()) == 150
    assert made == {"counts"}
    assert 0 < shuffled(found._jdf.queryExecution().executedPlan()) < 30_000  # 90 lists of five from each task, and as much after it


def shuffled(plan) -> int:
    """Rows that the exchanges of a finished plan have written."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return shuffled(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return shuffled(plan.plan())
    own = plan.metrics().apply("shuffleRecordsWritten").value() if name == "ShuffleExchangeExec" else 0
    children = plan.children()
    return own + sum(shuffled(children.apply(n)) for n in range(children.size()))
