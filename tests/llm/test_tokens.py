"""Token files (1) and trie BPE (8) against the tokenizers library."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loamstone.llm import bpe_trie, token_files

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=600))
def test_elias_fano_round_trip(steps):
    values = np.cumsum(np.array(steps, np.int64))
    ef = token_files.EliasFano.from_bytes(token_files.EliasFano.encode(values).to_bytes())
    assert ef.select_range(0, ef.n).tolist() == values.tolist()
    assert ef.select_range(len(values) // 3, len(values) // 2).tolist() == values[len(values) // 3 : len(values) // 2].tolist()
    assert [ef.select(i) for i in range(0, len(values), 7)] == values[::7].tolist()


def test_select_over_long_gaps():
    values = np.cumsum(np.r_[np.ones(3000, np.int64), 4_000_000, np.zeros(700, np.int64), 9_000_000, np.arange(900)])
    ef = token_files.EliasFano.encode(values)
    assert [ef.select(i) for i in range(0, len(values), 11)] == values[::11].tolist()
    assert ef.select_range(2990, 3800).tolist() == values[2990:3800].tolist()
    assert len(ef.places) == -(-len(values) // token_files.SELECT_STEP)


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(1).integers(1, 2000, 10_000))
    assert 8 * len(token_files.EliasFano.encode(values).to_bytes()) < 14 * len(values)


@pytest.mark.parametrize("limit", [token_files.SEGMENT_IDS, 1000])
def test_token_files(spark, odd, docs, limit, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_IDS", limit)
    library = Tokenizer.from_file(BYTE)
    for table in (odd, docs):
        path = token_files.write_segments(table, BYTE, 2)
        got = sorted(map(tuple, token_files.read_segments(spark, path).collect()), key=lambda r: r[1])
        rows = sorted(((r["doc_id"], r["text"] or "") for r in table.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        at = 0
        assert len(got) == len(rows)
        for (doc_id, start, n, crc), (want, text) in zip(got, rows, strict=True):
            ids = [*library.encode(text, add_special_tokens=False).ids, 2]
            assert (doc_id, start, n, crc) == (want, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            at += len(ids)
        image = spark.read.parquet(path).orderBy("part", "segment").first()["image"]
        assert token_files.fetch_document(image, 0)[-1] == 2


def test_token_files_empty(spark, empty):
    assert token_files.read_segments(spark, token_files.write_segments(empty, BYTE, 2)).count() == 0


def test_trie_documents(spark, odd, docs, empty):
    library = Tokenizer.from_file(WORD)
    library.no_truncation()
    library.no_padding()
    for table in (odd, docs):
        texts = [(r["doc_id"], r["text"] or "") for r in table.select("doc_id", "text").collect()]
        want = []
        for doc_id, text in texts:
            ids = library.encode(text, add_special_tokens=False).ids
            sha = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            want.append((doc_id, len(ids), sha, hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        key = lambda r: (r[0] is None, r[0] or 0, r[2])
        assert sorted(map(tuple, bpe_trie.digest_documents(table, WORD).collect()), key=key) == sorted(want, key=key)
    assert bpe_trie.encode_documents(empty, WORD).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="abcdeéßñ", min_size=1, max_size=12), min_size=1, max_size=30))
def test_trie_words(words):
    library = Tokenizer.from_file(WORD)
    codec = bpe_trie.codec(WORD)
    for word, (n, ids, _) in zip(words, codec.encode(words), strict=True):
        want = library.encode(word, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert n == len(want)


def test_cache_starts_anew():
    codec = bpe_trie.WordCodec(WORD, cache=3)
    first = codec.encode(["alpha beta gamma"])
    codec.encode(["delta epsilon zeta eta"])
    assert codec.encode(["alpha beta gamma"]) == first


def test_cache_of_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_files, "CACHE_PIECES", 4)
    own = token_files.PieceEncoder(BYTE)
    first = own.encode(pa.array(["a b, c d!", "e f g."]))
    own.encode(pa.array(["h i j k l m"]))
    assert own.encode(pa.array(["a b, c d!", "e f g."])) == first
