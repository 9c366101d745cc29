"""The pipeline's stages take effect, keep columns, and agree with brute force."""

import re
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
from loamstone.llm import decontamination, near_dedup, queries

from .conftest import make
from .test_dedup import components_of
from .test_filters import contaminated, quality


def test_stages(spark, docs, data):
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.materialise(stage(spark, before, data), name)
        rows = [(r["doc_id"], r["text"]) for r in before.select("doc_id", "text").collect()]
        ids = {r["doc_id"] for r in after.select("doc_id").collect()}
        if name != "bpe":
            assert after.columns == before.columns
        if name == "quality_rules":
            assert ids <= {i for i, t in rows if not quality(t)[-1]}
            good = {r["doc_id"] for r in spark.read.parquet(f"{data}/labels.parquet").filter("quality = 1").collect()}
            assert {i for i, t in rows if i in good and not quality(t)[-1]} <= ids
        elif name == "near_dedup":
            assert ids == {i for i, _, _, kept in components_of(rows, corpus_pipeline.PERCENT, corpus_pipeline.SHINGLE) if kept}
        elif name == "decontamination":
            assert ids == {r[0] for r in contaminated(rows, bench) if not r[5]}
        elif name == "secret_scan":
            assert ids == {i for i, _ in rows}
            assert not [1 for r in after.collect() if re.search(r'token = "[0-9a-f]{40}"', r["text"])]
        else:
            assert ids == {i for i, _ in rows}
            assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in after.collect())
        before = after


def test_stages_on_odd_rows(spark, odd, empty, data):
    """Null, repeated and missing ids, clashing columns, no rows: each row has the fate that its own text deserves."""
    long = " ".join(f"word{n}" for n in range(80))
    bench = spark.read.parquet(f"{data}/benchmark.parquet").first()["text"]
    more = [
        (None, long), (None, long), (None, long + " and an end"), (50, long.replace("word7 ", "wordy ")), (51, "clean " + " ".join(f"own{n}" for n in range(90))),
        (51, f"{bench} {bench}"), (None, f"{bench} {bench} x"), (None, "another " + " ".join(f"text{n}" for n in range(70))), (52, bench), (51, "other " + " ".join(f"more{n}" for n in range(60))),
    ]
    table = odd.union(make(spark, more)).withColumnsRenamed({"node": "ls_clean", "score": "ls_hit"})
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    kept = corpus_pipeline.near_duplicates(spark, table, data)
    assert kept.columns == table.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    groups = components_of(rows, corpus_pipeline.PERCENT, corpus_pipeline.SHINGLE)
    assert len(got) == len(set(got))
    assert {i for i, _ in got if i is not None} == {i for i, _, _, ok in groups if ok and i is not None}
    assert (None, "a row without id") in got
    assert (None, long) not in got  # a near copy of it has an id
    assert (None, long + " and an end") not in got
    assert sum(i == 51 for i, _ in got) == 3  # three texts under one id that are nothing alike
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    left = corpus_pipeline.decontaminate(spark, table, data)
    assert left.columns == table.columns
    fate = [(i, t, contaminated([(i, t)], items)[0][5]) for i, t in rows]
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == sorted(((i, t) for i, t, bad in fate if not bad), key=str)
    assert sum(bad for *_, bad in fate) == 3
    masked = corpus_pipeline.mask_secrets(spark, table, data)
    assert masked.columns == table.columns
    assert masked.select("doc_id", "ls_clean", "ls_hit", "words", "kept").exceptAll(table.select("doc_id", "ls_clean", "ls_hit", "words", "kept")).isEmpty()
    assert masked.filter("text is null").count() == table.filter("text is null").count()
    good = corpus_pipeline.quality(spark, table, data)
    assert good.columns == table.columns
    assert {(r["doc_id"], r["text"]) for r in good.collect()} <= {(i, t) for i, t in rows if not quality(t)[-1]}
    coded = corpus_pipeline.encode(spark, table, data)
    assert sorted((r["doc_id"] for r in coded.collect()), key=str) == sorted((i for i, _ in rows), key=str)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, data).count() == 0


def test_repeated_rows(spark, docs, data):
    twice = docs.union(docs)
    once = corpus_pipeline.near_duplicates(spark, docs, data).count()
    assert corpus_pipeline.near_duplicates(spark, twice, data).count() == once


def test_registered():
    assert {q.split("_")[0] for q in queries.queries()} == {f"op{n}" for n in range(1, 11)}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "secret_scan", "bpe"]
    assert decontamination.WINDOW == 13
    assert near_dedup.PERCENT == 85


def test_library_stands_without(tmp_path):
    """Nothing else imports the subpackage; the entry works when it and the pipeline are gone."""
    root = Path(corpus_pipeline.__file__).parent
    others = [p for p in (root / "loamstone").rglob("*.py") if "llm" not in p.parts]
    assert not [p for p in others if re.search(r"\bllm\b", p.read_text())]
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'pipeline' not in e.queries(); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
