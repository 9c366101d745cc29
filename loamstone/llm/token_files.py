"""Token-id files: concatenated ids with Elias-Fano document boundaries.

A file image ("segment") holds the ids of a run of documents in ascending doc_id
order and the ends of the documents as an Elias-Fano sequence: the low bits of
each end are packed side by side, the high bits are unary in a bit vector, and the file
holds the place of every ``SELECT_STEP``-th one-bit, from which select looks for the i-th
one by counting bits.  That takes about ``2.2 + log2(ids / documents)`` bits a document
instead of a 64-bit table entry, and nothing is built when a file is opened.

Segments travel as rows of a Parquet table in the shared folder, so any store
that Spark reaches will do.  Documents are put in order by range partitioning on
doc_id; each task writes segments of about ``SEGMENT_IDS`` ids, so memory is
bounded by one segment however large a partition is, and a lost executor costs
its partitions only.  What a document's start needs beyond its segment is the sum
of the ids in earlier partitions: one number for each partition.

Defined cases: a null or empty text holds the end id alone; rows without a doc_id
come first; rows that repeat a doc_id lie side by side, by text; an empty table
gives no rows; other columns of ``docs``, whatever their names, are ignored.  A document
is never split over segments, so one very long text makes one large segment and is encoded
whole.  What a worker remembers of pieces is bounded in number and in bytes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, input_bytes, map_arrow, save, scratch, texts

MAGIC = b"LSEF"
SEGMENT_IDS = 1 << 20
#: Text bytes in a range partition, about.
PARTITION_BYTES = 24 << 20
#: Pieces that a worker remembers, and the longest one it does; beyond that it starts anew.
CACHE_PIECES = 1_000_000
PIECE_LENGTH = 256
#: Every so many one-bits, the select structure stores a place.
SELECT_STEP = 256

SEGMENT_SCHEMA = "part int, segment int, start_in_part long, n_docs long, n_ids long, doc_ids array<long>, image binary"


class EliasFano:
    """A non-decreasing sequence of integers in near-minimal space, with select."""

    def __init__(self, n: int, universe: int, low_bits: int, low: np.ndarray, high: np.ndarray, places: np.ndarray, skips: np.ndarray) -> None:
        self.n, self.universe, self.low_bits, self.low, self.high, self.places, self.skips = n, universe, low_bits, low, high, places, skips

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        """Encodes non-decreasing, non-negative values."""
        n = len(values)
        universe = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        v = values.astype(np.uint64)
        bits = ((v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        low = np.packbits(bits.ravel(), bitorder="little")
        marks = np.zeros(n + (universe >> low_bits) + 1, np.uint8)
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        marks[ones] = 1
        # every SELECT_STEP-th one-bit: its byte, and how many one-bits that byte has before it
        sampled = ones[::SELECT_STEP]
        skips = np.array([marks[x // 8 * 8 : x].sum() for x in sampled], "u1")
        return cls(n, universe, low_bits, low, np.packbits(marks, bitorder="little"), (sampled // 8).astype("<u4"), skips)

    def select(self, i: int) -> int:
        """The i-th value: from the sampled place before it, 64 bytes at a time."""
        sample = i // SELECT_STEP
        byte, left = int(self.places[sample]), i - sample * SELECT_STEP + int(self.skips[sample])
        while True:
            ones = np.cumsum(np.bitwise_count(self.high[byte : byte + 64]), dtype=np.int64)
            if ones[-1] > left:
                break
            byte, left = byte + 64, left - int(ones[-1])
        inside = int(np.searchsorted(ones, left, side="right"))
        left -= int(ones[inside - 1]) if inside else 0
        word = int(self.high[byte + inside])
        for _ in range(left):
            word &= word - 1
        place = (byte + inside) * 8 + (word & -word).bit_length() - 1
        return (place - i) << self.low_bits | self._low(i)

    def _low(self, i: int) -> int:
        at, out = i * self.low_bits, 0
        for k in range(self.low_bits):
            out |= (int(self.low[(at + k) >> 3]) >> ((at + k) & 7) & 1) << k
        return out

    def select_range(self, first: int, end: int) -> np.ndarray:
        """The values from the first-th on, up to the one before the end-th, block by block of sampled places."""
        out = np.empty(max(0, end - first), np.int64)
        for sample in range(first // SELECT_STEP, -(-end // SELECT_STEP) if end > first else 0):
            base = sample * SELECT_STEP
            byte = int(self.places[sample])
            stop = int(self.places[sample + 1]) + 1 if sample + 1 < len(self.places) else len(self.high)
            ones = np.flatnonzero(np.unpackbits(self.high[byte:stop], bitorder="little"))[int(self.skips[sample]) :] + 8 * byte
            a, b = max(first, base), min(end, base + SELECT_STEP)
            i = np.arange(a, b)
            high = (ones[a - base : b - base] - i) << self.low_bits
            bits = np.unpackbits(self.low[a * self.low_bits // 8 : b * self.low_bits // 8 + 1], bitorder="little")
            bits = bits[a * self.low_bits % 8 :][: len(i) * self.low_bits].reshape(len(i), self.low_bits).astype(np.int64)
            out[a - first : b - first] = high | (bits << np.arange(self.low_bits)).sum(axis=1)
        return out

    def to_bytes(self) -> bytes:
        head = struct.pack("<QQBQQQ", self.n, self.universe, self.low_bits, len(self.low), len(self.high), len(self.places))
        return head + self.low.tobytes() + self.high.tobytes() + self.skips.tobytes() + self.places.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, universe, low_bits, a, b, c = struct.unpack_from("<QQBQQQ", data)
        at = struct.calcsize("<QQBQQQ")
        low, high = np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, np.uint8, b, at + a)
        return cls(n, universe, low_bits, low, high, np.frombuffer(data, "<u4", c, at + a + b + c), np.frombuffer(data, "u1", c, at + a + b))


def pack_segment(ids: bytes, width: int, lengths: list[int]) -> bytes:
    """A file image: header, Elias-Fano document ends, ids of ``width`` bytes each."""
    ends = EliasFano.encode(np.cumsum(np.asarray(lengths, np.int64))).to_bytes()
    return struct.pack("<4sBBQQ", MAGIC, 1, width, len(lengths), len(ends)) + ends + ids


def unpack_segment(image: bytes) -> tuple[EliasFano, np.ndarray]:
    """Document ends and ids of a file image."""
    magic, version, width, _, size = struct.unpack_from("<4sBBQQ", image)
    if magic != MAGIC or version != 1:
        raise ValueError("not a token segment")
    at = struct.calcsize("<4sBBQQ")
    return EliasFano.from_bytes(image[at : at + size]), np.frombuffer(image, f"<u{width}", -1, at + size)


# White space, by any engine's reckoning, before a blank: there a cut at the blank would
# fall into a run of white space, which the tokenizer's rule keeps together.
CROSSING = (
    r"[\t\n\x0b\x0c\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
)


# Marks at the end of a word are a run of their own by the rule, whatever follows; the letters
# and digits in front are those on whose classes every engine agrees.
MARKED = r"([0-9A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}])([!\"#$%&()*+,\-./:;<=>?@\[\]^_`{|}~]+)( |$)"
#: What stands before such marks once they are cut off, where other pieces have a blank.
BARE = "\0"


class PieceEncoder:
    """The tokenizer library over distinct pieces of text, with a bounded cache.

    Its rule never joins what stands before a blank with the blank, unless that is white
    space too.  So a text is cut before its blanks, and before the marks that end a word,
    and each distinct piece is encoded once: many new pieces side by side in one call, told
    apart by their first tokens.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.width = 2 if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.known: dict[str, bytes] = {}
        self.long: list[str] = []  # pieces that are forgotten after their batch
        # texts that hold a token that is matched before the rule, or BARE itself, are encoded whole
        self.apart = [BARE, *(t.content for t in self.library.get_added_tokens_decoder().values())]
        self.blank = np.zeros(self.library.get_vocab_size(with_added_tokens=True), bool)
        self.blank[[i for t, i in self.library.get_vocab().items() if t.startswith("\u0120")]] = True

    def whole(self, batch: list[str]) -> list[bytes]:
        """Packed ids of each text, straight from the library."""
        found = self.library.encode_batch_fast(batch, add_special_tokens=False) if batch else []
        return [np.array(x.ids, self.kind).tobytes() for x in found]

    def learn(self, pieces: set[str]) -> None:
        """Puts packed ids of unknown pieces into the cache: each behind a blank, or without one if it starts with ``BARE``."""
        for x in self.long:
            self.known.pop(x, None)
        new = pieces.difference(self.known)
        if len(self.known) + len(new) > CACHE_PIECES:
            self.known = {x: self.known[x] for x in pieces.difference(new)}
        bare = [x for x in new if x[:1] == BARE]
        self.known.update(zip(bare, self.whole([x[1:] for x in bare]), strict=True))
        alone = [x for x in new if not x or x[-1].isspace()]
        self.known.update(zip(alone, self.whole([" " + x for x in alone]), strict=True))
        order = list(new.difference(alone, bare))
        slabs = [" " + " ".join(order[at : at + 64]) for at in range(0, len(order), 64)]
        if slabs:
            found = self.library.encode_batch_fast(slabs, add_special_tokens=False)
            # no piece has a blank but its first character, so each starts at a token that begins with one
            ids = np.concatenate([np.array(x.ids, self.kind) for x in found])
            cuts = [*(np.flatnonzero(self.blank[ids]) * self.width).tolist(), ids.nbytes]
            packed = ids.tobytes()
            self.known.update(zip(order, [packed[a:b] for a, b in pairwise(cuts)], strict=True))
        self.long = [x for x in new if len(x) > PIECE_LENGTH]

    def encode(self, batch: pa.Array) -> list[bytes]:
        """Packed ids of each text of a string array without nulls."""
        odd = pc.match_substring_regex(batch, CROSSING)
        for x in self.apart:
            odd = pc.or_(odd, pc.match_substring(batch, x))
        marks = odd.to_pylist()
        strange = iter(self.whole(batch.filter(odd).to_pylist()))
        cut = pc.split_pattern(pc.replace_substring_regex(batch.filter(pc.invert(odd)), MARKED, r"\1 " + BARE + r"\2\3"), " ")
        if not len(cut):
            return list(strange)
        offsets = cut.offsets.to_numpy()
        offsets = offsets - offsets[0]
        coded = cut.flatten().dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        pieces = coded.dictionary.to_pylist()
        self.learn(set(pieces))
        # the first piece of a text has no blank before it
        first = [pieces[c] for c in codes[offsets[:-1]]]
        own = list(set(first))
        heads = dict(zip(own, self.whole(own), strict=True))
        codes[offsets[:-1]] = len(pieces) + np.arange(len(first))
        packed = [self.known[x] for x in pieces] + [heads[x] for x in first]
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // self.width
        starts = np.cumsum(sizes) - sizes
        ids = np.frombuffer(b"".join(packed), self.kind)
        each = sizes[codes]
        ends = np.cumsum(each)
        ids = ids[np.repeat(starts[codes] - (ends - each), each) + np.arange(ends[-1])].tobytes()
        cuts = [0, *(ends[offsets[1:] - 1] * self.width).tolist()]
        plain = iter([ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])
        return [next(strange if o else plain) for o in marks]


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One encoder in each worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return PieceEncoder(path)


def write_segments(docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None) -> str:
    """Writes the token files of ``docs`` and returns their path."""
    spark = docs.sparkSession
    base = texts(docs)
    parts = max(12, -(-input_bytes(base) // PARTITION_BYTES))
    ordered = base.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, context = encoder(tokenizer_path), TaskContext.get()
        end = end_id.to_bytes(own.width, "little")
        part = context.partitionId() if context else 0
        segment = start = 0
        held: list[bytes] = []
        lengths: list[int] = []
        doc_ids: list[int | None] = []

        def flush() -> pa.RecordBatch:
            ids = b"".join(held)
            row = {
                "part": pa.array([part], pa.int32()), "segment": pa.array([segment], pa.int32()),
                "start_in_part": pa.array([start], pa.int64()), "n_docs": pa.array([len(lengths)], pa.int64()),
                "n_ids": pa.array([sum(lengths)], pa.int64()), "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())),
                "image": pa.array([pack_segment(ids, own.width, lengths)], pa.binary()),
            }
            return pa.RecordBatch.from_pydict(row)

        for batch in chunks(batches, limit=8 << 20):
            coded = own.encode(batch.column("text"))
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), coded, strict=True):
                held += [ids, end]
                lengths.append(len(ids) // own.width + 1)
                doc_ids.append(doc_id)
            if sum(lengths) >= SEGMENT_IDS:
                yield flush()
                segment, start = segment + 1, start + sum(lengths)
                held, lengths, doc_ids = [], [], []
        if lengths:
            yield flush()

    path = path or scratch(spark, "tokens")
    save(map_arrow(ordered, work, SEGMENT_SCHEMA), path)
    return path


def read_segments(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    files = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    by_part = files.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = F.sum("ids").over(Window.orderBy("part")) - F.col("ids")  # one row for each partition
    starts = by_part.select("part", before.alias("base"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ends, ids = unpack_segment(row["image"])
                places = [0, *ends.select_range(0, ends.n).tolist()]
                wide = memoryview(ids.astype("<u4").tobytes())
                sums = [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(places, places[1:], strict=False)]
                first = np.asarray(places[:-1], np.int64) + row["base"] + row["start_in_part"]
                yield pa.record_batch(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(first), pa.array(np.diff(places)), pa.array(sums, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    joined = files.join(F.broadcast(starts), "part").select("base", "start_in_part", "doc_ids", "image")
    return map_arrow(joined, work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch_document(image: bytes, i: int) -> np.ndarray:
    """Ids of the i-th document of a file image, found by two selects."""
    ends, ids = unpack_segment(image)
    return ids[(ends.select(i - 1) if i else 0) : ends.select(i)]
