"""Suffix-array dedup (3), near dedup (6) and components against brute force."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loamstone.llm import graph, near_dedup, suffix_dedup

from .conftest import make


def removed(rows, length):
    """Brute force of the contract, rows in any order."""
    known = sorted(((i if i is not None else suffix_dedup.LAST), (t or "").encode()) for i, t in rows)
    first = {}
    for i, raw in known:
        for k in range(len(raw) - length + 1):
            first.setdefault(raw[k : k + length], i)
    out = []
    for i, t in rows:
        raw, own = (t or "").encode(), i if i is not None else suffix_dedup.LAST
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - length + 1):
            if first[raw[k : k + length]] < own:
                gone[k : k + length] = True
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


KEY = lambda r: (r[0] is None, r[0] or 0, r[1:])


def suffix_rows(df):
    return sorted(map(tuple, df.drop("kept").collect()), key=KEY)


def test_remove_repeats(spark, odd, docs, empty):
    for table in (odd, docs):
        rows = [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]
        assert suffix_rows(suffix_dedup.remove_repeats(table)) == sorted(removed(rows, 50), key=KEY)
    assert suffix_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("shard", [1 << 21, 300])
def test_repeats_of_few_letters(spark, shard, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    monkeypatch.setattr(suffix_dedup.judge_bucket, "__defaults__", (shard,))
    rng = random.Random(5)
    base = ["".join(rng.choice("ab\x00") for _ in range(400)) for _ in range(4)]
    rows = []
    for n in range(40):
        a, b = rng.choice(base), rng.choice(base)
        i, j = rng.randrange(300), rng.randrange(300)
        rows.append((n // 2 * 2, a[i : i + rng.randrange(20, 200)] + rng.choice("xyz") + b[j : j + 120]))
    got = suffix_rows(suffix_dedup.remove_repeats(make(spark, rows)))
    assert got == sorted(removed(rows, 50), key=KEY)


def test_one_passage_everywhere(spark):
    passage = "A passage that a third of all documents share, word for word, and longer than fifty bytes."
    rows = [(n, f"{n} own words {n * 7} {passage if n % 3 == 0 else ''} tail {n}") for n in range(300)]
    assert suffix_rows(suffix_dedup.remove_repeats(make(spark, rows))) == sorted(removed(rows, 50), key=KEY)


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=300).map(lambda b: bytes(x % 3 for x in b)))
def test_suffix_array(raw):
    data = np.frombuffer(raw, np.uint8)
    order, rank = suffix_dedup.suffix_ranks(data, 50)
    head = [raw[i : i + 50].ljust(50, b"\0") for i in order]
    assert head == sorted(head)
    assert all((rank[a] == rank[b]) == (x == y) for a, b, x, y in zip(order, order[1:], head, head[1:], strict=False) if len(raw) - max(a, b) >= 50)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(6, 30), st.integers(0, 2**60)), min_size=1, max_size=12), st.integers(2, 3))
def test_kasai(contexts, letters):
    """Prefixes that neighbouring windows share, by Kasai's rule and by comparing."""
    cap, parts, starts, at = 5, [], [], 0
    for size, seed in contexts:
        parts.append(bytes(random.Random(seed % 9).choices(range(letters), k=size)))
        starts += range(at, at + size - cap + 1)
        at += size
    raw = b"".join(parts)
    starts = np.array(starts)
    order = sorted(range(len(starts)), key=lambda k: (raw[starts[k] : starts[k] + cap], k % 3))
    before = np.full(len(starts), -1)
    before[order[1:]] = starts[order[:-1]]
    got = suffix_dedup.kasai(np.frombuffer(raw, np.uint8), starts, before, cap)
    for k, (i, j) in enumerate(zip(starts, before, strict=True)):
        a, b = raw[i : i + cap], raw[j : j + cap]
        assert got[k] == (0 if j < 0 else next((n for n in range(cap) if a[n] != b[n]), cap))


def test_blocks_condensed_before_buckets(spark, docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(suffix_dedup, "FAN_IN", 2)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert suffix_rows(suffix_dedup.remove_repeats(docs)) == sorted(removed(rows, 50), key=KEY)


def test_common_passage_makes_no_full_bucket():
    """What a bucket holds does not grow with the documents that share a passage."""
    import pyarrow as pa

    passage = "A passage that a third of all documents share, word for word, and longer than fifty bytes."
    held = []
    for n in (600, 6000):
        texts = [passage if k % 3 == 0 else f"{k} too short" for k in range(n)]
        batch = pa.record_batch([pa.array(range(n), pa.int64()), pa.array(range(n), pa.int64()), pa.array(texts)], names=["id", "mark", "text"])
        rows = [r for b in suffix_dedup._deal(50, 64, 1, 0, 1)(iter([batch])) for r in b.to_pylist()]
        held.append(sorted(len(suffix_dedup.unpack(r["body"], suffix_dedup.KINDS)[0]) for r in rows if r["bucket"] < 64))
        done = [suffix_dedup.unpack(r["body"], suffix_dedup.DONE) for r in rows if r["bucket"] >= 64]
        assert sum(len(d[0]) for d in done) == n // 3 - 1  # one merged range for each copy
    assert held[0] == held[1]


LOW = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def components_of(rows, percent=85, size=3):
    sets = []
    for _, t in rows:
        w = (t or "").encode().translate(LOW).split()
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * (both := len(sets[a] & sets[b])) >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    out = []
    for n, (i, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if root(m) == root(n) and rows[m][0] is not None]
        least = min(ids) if ids and sets[n] else i
        out.append((i, len(sets[n]), least, i == least))
    return sorted(out, key=KEY)


def near_rows(df):
    return sorted(map(tuple, df.collect()), key=KEY)


def test_near_duplicates(spark, odd, docs, empty):
    for table in (odd, docs):
        rows = [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]
        assert near_rows(near_dedup.near_duplicates(table)) == components_of(rows)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_chains_of_copies(spark):
    """Copies of copies whose ends are far apart, next to copies that are just not near enough."""
    rng = random.Random(3)
    rows, n = [], 0
    for base in range(4):
        words = [f"w{base}x{k}" for k in range(120)]
        rows.append((n, " ".join(words)))
        n += 1
        for step in range(25):
            source = rng.choice(rows[-min(step + 1, 5) :])[1].split()
            for _ in range(rng.choice([1, 2, 3, 6, 9])):
                source[rng.randrange(len(source))] = f"v{rng.randrange(40)}"
            rows.append((n, " ".join(source)))
            n += 1
    rng.shuffle(rows)
    assert near_rows(near_dedup.near_duplicates(make(spark, rows))) == components_of(rows)


def test_words_of_two_letters(spark):
    """Patterns of letters that cancel out in polynomials over 2**64."""
    a = "a"
    for _ in range(12):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"x y {a}"), (2, f"x y {b}"), (3, f"{a} {b} {a} {b} {b} {a}"), (4, f"{b} {a} {b} {a} {a} {b}")]
    assert near_rows(near_dedup.near_duplicates(make(spark, rows))) == components_of(rows)
    words = np.unique(near_dedup.shingle_sets([" ".join(format(n, "b").replace("0", "a").replace("1", "b") for n in range(1, 1 << 14)).encode()], 1)[0])
    assert len(words) == (1 << 14) - 1


def test_hubs_in_parts(spark, monkeypatch):
    """A hub with many partners is compared by several tasks, with the same result."""
    monkeypatch.setattr(near_dedup, "PART", 8)
    rng = random.Random(4)
    words = [f"w{k}" for k in range(150)]
    rows = [(0, " ".join(words))]
    for n in range(1, 60):
        own = list(words)
        for _ in range(rng.choice([1, 4, 8])):
            own[rng.randrange(150)] = f"v{rng.randrange(30)}"
        rows.append((n, " ".join(own)))
    assert near_rows(near_dedup.near_duplicates(make(spark, rows))) == components_of(rows)


def test_super_minhash_by_definition():
    """Level by level gives what one shingle at a time gives."""
    sets = [np.unique(np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64)) for n in (1, 2, 5, 40, 300)]
    got = near_dedup.super_minhash(sets, 16)
    for s, row in zip(sets, got, strict=True):
        want = [2**64 - 1] * 16
        for item in s:
            places = list(range(16))
            for level in range(16):
                with np.errstate(over="ignore"):
                    draw = int(near_dedup.mix(np.array([item + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)], np.uint64))[0])
                pick = level + ((draw >> 32) * (16 - level) >> 32)
                places[level], places[pick] = places[pick], places[level]
                want[places[level]] = min(want[places[level]], level << 32 | draw & 0xFFFFFFFF)
        assert row.tolist() == want


def test_estimate_is_close():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    a, b = np.unique(base[:900]), np.unique(base[100:])
    x, y = near_dedup.super_minhash([a, b], 512)
    assert abs((x == y).mean() - 0.8) < 0.06


@pytest.mark.parametrize("part", [graph.PART, 5])
def test_components(spark, part, monkeypatch):
    monkeypatch.setattr(graph, "PART", part)
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 101), (200, 300)] + [(500, 501 + k) for k in range(50)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0}
    assert (got[103], got[300], got[550]) == (100, 200, 500)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
