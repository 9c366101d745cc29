import time

import pytest
from pyspark.sql import functions as F

from loamstone.errors import DanglingEdge, DuplicateDocument, InvalidArgument, NotFound, NotRetryable
from loamstone.operators.store import Store, latest
from loamstone.streaming import ingest


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


E = "document_id string, element_id string, ordinal int, element_type string, content_kind string, text string, asset_path string, metadata string"
R = "document_id string, rel_ordinal int, source_element_id string, relationship_type string, target_element_id string, metadata string"


def document(spark, text="x", key="a"):
    d = spark.range(1).select(F.lit("d").alias("document_id"), F.lit("txt").alias("source_type"), F.create_map(F.lit(key), F.lit("1")).alias("metadata"))
    e = spark.createDataFrame([("d", "1", 0, "text", "text", text, None, "{}"), ("d", "2", 1, "text", "text", "y", None, "{}")], E)
    r = spark.createDataFrame([("d", 0, "1", "contains", "2", "{}"), ("d", 1, "1", "contains", "2", "{}")], R)
    return d, e, r


def test_persist_and_replace(spark, store):
    store.persist(*document(spark))
    assert store.read("relationships").count() == 1
    with pytest.raises(DuplicateDocument, match="stored already"):
        store.persist(*document(spark))
    store.persist(*document(spark, "new", "b"), allow_existing=True)
    assert {r["text"] for r in store.read("elements").collect()} == {"new", "y"}
    assert store.read("documents").first()["metadata"] == {"a": "1", "b": "1"}
    store.delete_document("elements", "d")
    assert store.read("elements").count() == 0
    with pytest.raises(InvalidArgument):
        store.delete_document("elements", " ")
    store.delete_document("never", "d")


def test_checks(spark, store):
    d, e, r = document(spark)
    with pytest.raises(DanglingEdge):
        store.persist(d, e, r.withColumn("target_element_id", F.lit("9")))
    with pytest.raises(InvalidArgument):
        store.persist(d, e.union(e), r)


def test_runs_and_states(store):
    run = store.start_run()
    store.finish_run(run, "d", "{}")
    failed = store.start_run("e")
    store.fail_run(failed, "broke")
    states = {r["run_id"]: r for r in latest(store.read("runs"), "run_id").collect()}
    assert (states[run]["status"], states[failed]["status"], states[failed]["error_message"]) == ("completed", "failed", "broke")
    store.set_status("d", "failed", "why")
    store.retry("d")
    assert latest(store.read("document_states"), "document_id").first()["status"] == "pending"
    store.set_status("d", "completed")
    with pytest.raises(NotRetryable):
        store.retry("d")
    with pytest.raises(NotFound):
        store.retry("unknown")


def test_vectors(spark, store):
    chunk = lambda i, v: spark.createDataFrame([(i, "d", v)], "chunk_id string, document_id string, embedding array<double>")
    store.upsert_chunks(chunk("c", [1.0, 2.0]))
    store.upsert_chunks(chunk("c", [3.0, 4.0]))
    assert [r["embedding"] for r in store.read("chunks").collect()] == [[3.0, 4.0]]
    with pytest.raises(InvalidArgument):
        store.upsert_chunks(chunk("e", [1.0]))
    with pytest.raises(InvalidArgument):
        store.upsert_chunks(chunk("e", []))


def test_chats(spark, store):
    chat = store.create_chat("  Title ")
    other = store.create_chat("Other")
    assert store.chat(chat)["title"] == "Title"
    store.add_message(chat, " USER ", " hi ")
    time.sleep(0.01)
    store.add_message(chat, "assistant", "yes")
    assert [r["content"] for r in store.messages(chat).collect()] == ["hi", "yes"]
    assert [r["chat_id"] for r in store.chats().collect()] == [chat, other]
    with pytest.raises(InvalidArgument):
        store.add_message(chat, "system", "no")
    with pytest.raises(NotFound):
        store.chat("not-a-uuid")
    store.persist(*document(spark))
    store.attach(chat, "d")
    store.attach(chat, "d")
    assert store.chat_documents(chat).count() == 1
    store.detach(chat, "d")
    assert store.chat_documents(chat).count() == 0


def test_stream_equals_batch(spark, store, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.txt").write_text("some text")
    (inbox / "b.md").write_text("# Head\n\nbody")
    (inbox / "c.gif").write_text("no")
    for _ in range(2):  # the second run finds nothing new
        ingest.stream_folder(spark, f"file://{inbox}", store, f"file://{tmp_path}/cp").awaitTermination()
    assert sorted(r["content"] for r in store.read("chunks").collect()) == ["Head", "body", "some text"]
    assert latest(store.read("runs"), "run_id").first()["status"] == "completed"
    (inbox / "d.txt").write_text("more")
    ingest.stream_folder(spark, f"file://{inbox}", store, f"file://{tmp_path}/cp").awaitTermination()
    assert store.read("documents").count() == 3


def test_only_touched_buckets_are_written(spark, store):
    rows = spark.range(200).select(F.col("id").cast("string").alias("document_id"), F.lit("a").alias("text"))
    store.replace_documents("documents", rows)
    before = store._state()["documents"]["folders"]
    store.replace_documents("documents", rows.filter("document_id = '7'").withColumn("text", F.lit("b")))
    after = store._state()["documents"]["folders"]
    assert sum(before[k] != after[k] for k in before) == 1
    assert {r["document_id"] for r in store.read("documents").filter("text = 'b'").collect()} == {"7"}
    assert store.read("documents").count() == 200
    assert store.read("documents", ["7"]).count() < 200


def test_a_failed_write_shows_nothing(spark, store):
    store.persist(*document(spark))
    bad = spark.range(1).select(F.lit("d").alias("document_id"), F.assert_true(F.col("id") > 5, F.lit("no")).isNull().alias("x"))
    with pytest.raises(Exception, match="no"):
        store.replace_tables({"elements": document(spark, "new")[1], "chunks": bad}, document(spark)[0])
    assert {r["text"] for r in store.read("elements").collect()} == {"x", "y"}
    assert not store.exists("chunks")


def test_unreadable_files_are_failed_documents(spark, store):
    files = spark.createDataFrame([("a", "a.txt", b"fine"), ("b", "b.docx", b"broken"), ("c", "c.pdf", b"%PDF")], "document_id string, path string, content binary")
    counts = ingest.ingest(store, files)
    assert (counts["failed"], counts["chunks"]) == (2, 1)
    states = {r["document_id"]: r["metadata"]["processing_status"] for r in store.read("documents").collect()}
    assert states == {"a": "completed", "b": "failed", "c": "failed"}
