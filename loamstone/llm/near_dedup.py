"""MinHash near-deduplication with SuperMinHash signatures.

A document is the set of its distinct three-word shingles.  SuperMinHash walks a
random permutation of the signature's slots for each shingle, so that the ranks it
gives different slots are correlated and the estimate varies less than with
independent hashes.  The walk goes level by level for all shingles of a batch and
stops for a document as soon as no slot can get lower.

Signatures are cut into bands; documents that agree in a band are candidates.
With 32 bands of 4 rows, a pair at similarity 0.85 is missed by every band with a
probability below 1e-10.  Candidates are confirmed on full sets.

Equal sets are one node from the start, so thousands of copies cost one row.
Inside a band's bucket no pairs are listed: each node is compared with the bucket's
hub, its lowest doc_id, which in a group of copies is mostly their model.  Components
are formed, and only nodes that are then still outside their hub's component are
compared with the hub's other nodes, if exact bounds allow a link: two sets can share no
more of the hub's shingles than each has, and no shingle that no other candidate has.
That spares almost all of these comparisons, and no link that could join two components
goes untested.

A hub with very many partners is compared by several tasks: its partners are dealt
over parts of ``PART`` pairs, and its set, or its row, goes to each part.

Defined cases: null and empty texts have no shingles and are linked with nothing;
texts of one or two words have one shingle; rows that repeat a doc_id are judged
by their own texts; a row without doc_id is linked as others are, but never the
smallest id of a component that has one; of equal smallest ids all rows are kept; a pair
exactly at the threshold is linked; an empty table gives no rows; a text of any length is
hashed whole, in one task; other columns of ``docs``, whatever their names, are ignored.

Shingles are 64-bit hashes of 64-bit word hashes, so "full sets" are sets of hashes; two
different shingles of a pair are taken for one with a probability of about 2**-64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, dealt, hot_keys, in_each_part, map_arrow, mark, materialise, small, texts
from .graph import components

SHINGLE = 3
BANDS = 32
ROWS = 4
#: A pair is linked from this percentage of common shingles on.
PERCENT = 85
LAST = (1 << 63) - 1
#: Pairs of one hub that one task compares.
PART = 2000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the published splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Places in a word whose byte hashes are looked up; those further on are computed.
_HEAD = 32


def _byte_hash(place: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """A random-looking number for each byte value at each place of a word."""
    with np.errstate(over="ignore"):
        return mix(mix(place.astype(np.uint64) * np.uint64(_BASE) + np.uint64(0x9E6C63D0876A9A47)) + byte.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


_TABLE = _byte_hash(np.repeat(np.arange(_HEAD), 256), np.tile(np.arange(256), _HEAD))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash of each word: the sum of its bytes' numbers, each drawn for its own place.

    Two different words differ in one place at least, and the sum is as good as random
    there; unlike a polynomial in one base, no pattern of letters cancels out.
    """
    kind = np.int32 if len(data) < 1 << 30 else np.int64
    sizes = (ends - starts).astype(kind)
    total = np.zeros(len(data) + 1, np.uint64)
    if len(starts):
        inside = np.arange(sizes.sum(), dtype=kind) - np.repeat(np.cumsum(sizes, dtype=kind) - sizes, sizes)
        at = np.repeat(starts.astype(kind), sizes) + inside
        byte = data[at]
        numbers = _TABLE[(np.minimum(inside, _HEAD - 1) << 8) | byte]
        far = np.flatnonzero(inside >= _HEAD)
        numbers[far] = _byte_hash(inside[far], byte[far])
        total[at + 1] = numbers
    total = np.cumsum(total, dtype=np.uint64)
    return mix(total[ends] - total[starts] + sizes.astype(np.uint64))


def shingle_sets(batch: list[bytes], shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text, given as UTF-8."""
    joined = b"\n".join(batch).translate(_LOWER) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    blank = _BLANK[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    words = word_hashes(data, starts, ends)
    sizes = np.array([len(b) + 1 for b in batch], np.int64)
    limits = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
    factors = [np.uint64(pow(0xD6E8FEB86659FD93, i + 1, 1 << 64)) for i in range(shingle)]
    if len(words) >= shingle:
        n = len(words) - shingle + 1
        every = mix(sum((words[i : i + n] * factors[i] for i in range(1, shingle)), words[:n] * factors[0]))
    else:
        every = np.empty(0, np.uint64)
    out = []
    for a, b in zip(limits[:-1], limits[1:], strict=True):
        if b - a >= shingle:
            s = np.sort(every[a : b - shingle + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            few = int(b - a)
            whole = (words[a:b] * np.array(factors[:few])).sum(dtype=np.uint64, keepdims=True)
            out.append(mix(whole + np.uint64(few * 0x632BE59BD9B4E019 & (1 << 64) - 1)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def super_minhash(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """One signature row for each set; empty sets give the largest value everywhere.

    A slot's value is ``level << 32 | rank``; level j can only lower slots above j, so a
    set takes part in level j only while one of its slots is above it.
    """
    with np.errstate(over="ignore"):
        out = np.full((len(sets), slots), np.iinfo(np.uint64).max, np.uint64)
        sizes = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), sizes)
        items = np.concatenate(sets) if len(sets) else np.empty(0, np.uint64)
        picks: list[np.ndarray] = []
        for level in range(slots):
            if not len(items):
                break
            draw = mix(items + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            rank = draw & np.uint64(0xFFFFFFFF)
            pick = (level + (((draw >> np.uint64(32)) * np.uint64(slots - level)) >> np.uint64(32)).astype(np.int64)).astype(np.int32)
            slot = pick.copy()
            for i in range(level - 1, -1, -1):  # where the swaps so far have put this slot
                slot[slot == picks[i]] = i
            np.minimum.at(out.ravel(), owner * slots + slot, (np.uint64(level) << np.uint64(32)) | rank)
            picks.append(pick)
            open_sets = out.max(axis=1) >= np.uint64((level + 1) << 32)
            stay = open_sets[owner]
            if not stay.all():
                items, owner, picks = items[stay], owner[stay], [p[stay] for p in picks]
        return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each document and band."""
    with np.errstate(over="ignore"):
        cut = signatures.reshape(len(signatures), bands, rows)
        key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), cut.shape[:2]).copy()
        for i in range(rows):
            key = mix(key * np.uint64(0x100000001B3) + cut[:, :, i])
        return key.astype(np.int64)


def _encoded(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _digest(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _sign(shingle: int, bands: int, rows: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=2 << 20):
            sets = shingle_sets(_encoded(batch), shingle)
            keys = band_keys(super_minhash(sets, bands * rows), bands, rows)
            offsets = np.concatenate([[0], np.cumsum([bands if len(s) else 0 for s in sets])]).astype(np.int32)
            flat = keys[[len(s) > 0 for s in sets]].ravel()
            yield pa.record_batch(
                [
                    batch.column("doc_id"), batch.column("mark"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_digest(s) for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64())),
                ],
                names=["doc_id", "mark", "n_shingles", "digest", "bands"],
            )

    return work


def _full_sets(shingle: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=2 << 20):
            sets = shingle_sets(_encoded(batch), shingle)
            same = [_digest(s) == d for s, d in zip(sets, batch.column("digest").to_pylist(), strict=True)]
            yield pa.record_batch(
                [
                    pa.array([n for n, ok in zip(batch.column("node").to_pylist(), same, strict=True) if ok], pa.int64()),
                    pa.array([s.astype(np.int64) for s, ok in zip(sets, same, strict=True) if ok], pa.list_(pa.int64())),
                ],
                names=["node", "items"],
            )

    return work


class NearDuplicates:
    """The stages of one run; :meth:`groups` is the result."""

    def __init__(self, docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> None:
        self.percent, self.shingle = percent, shingle
        self.docs = texts(docs)
        self.signed = materialise(map_arrow(
            self.docs.withColumn("mark", mark(F.col("text"))), _sign(shingle, bands, rows),
            "doc_id long, mark long, n_shingles long, digest binary, bands array<bigint>",
        ), "signatures")

    def nodes(self) -> DataFrame:
        """(node, digest, n, id, bands): one row for each distinct set."""
        each = self.signed.filter("n_shingles > 0")
        one = each.groupBy("digest").agg(
            F.min("n_shingles").alias("n"), F.min("doc_id").alias("id"), F.first("bands").alias("bands")
        )
        return materialise(one.withColumn("node", F.monotonically_increasing_id()), "nodes")

    def sets(self, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
        """(node, items): full shingle sets of the nodes in ``wanted``."""
        ids = materialise(nodes.select("node", "digest", "id").join(wanted, "node"), "wanted")
        own = self.docs.join(small(ids), self.docs["doc_id"].eqNullSafe(ids["id"])).select("node", "digest", "text")
        return materialise(map_arrow(own, _full_sets(self.shingle), "node long, items array<bigint>"), "sets")

    def measured(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """``pairs(a, b)`` with the size of their intersection and whether they are linked, by full sets."""
        left = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
        right = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
        hot = hot_keys(pairs, "a", PART)
        if not hot.isEmpty():
            pairs, left = dealt(pairs, hot, "a", "b"), in_each_part(left, hot, "a")
        both = pairs.join(left, [c for c in ("a", "part") if c in pairs.columns]).join(right, "b")
        counted = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("common"), (F.size("x") + F.size("y")).alias("total"))
        linked = 100 * F.col("common") >= self.percent * (F.col("total") - F.col("common"))
        return materialise(counted.select("a", "b", "common", linked.alias("linked")).distinct(), "measured")

    def groups(self) -> DataFrame:
        """(doc_id, n_shingles, component_id, kept, mark, group) of every document."""
        nodes = self.nodes()
        members = nodes.select("node", "n", F.struct(F.coalesce("id", F.lit(LAST)).alias("id"), "node").alias("by"), F.explode("bands").alias("key"))
        # a group's lowest id is what the others were mostly copied from, and so in its middle
        hubs = materialise(
            members.groupBy("key").agg(F.min("by").alias("low"), F.max("by").alias("high")).filter("low.node != high.node")
            .select("key", F.col("low.node").alias("first")),
            "buckets",
        )
        shared = materialise(members.drop("by").join(hubs, "key"), "members")
        sets = self.sets(nodes, shared.select("node").distinct())
        # items that one node alone has can be in no intersection: they bound what a pair can reach
        items = sets.select("node", F.explode("items").alias("item"))
        alone = items.groupBy("item").agg(F.min("node").alias("node"), F.max("node").alias("other")).filter("node = other")
        lonely = alone.groupBy("node").agg(F.count("*").alias("alone"))
        sizes = sets.select("node", F.size("items").alias("n")).distinct().join(lonely, "node", "left")
        sizes = materialise(sizes.select("node", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("m")), "sizes")

        pairs = shared.filter("node != first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
        around = self.measured(materialise(pairs, "pairs"), sets)
        links = around.filter("linked").select("a", "b")
        labels = components(links)
        # nodes outside the component of their hub meet the hub's other nodes of other components
        own = labels.select(F.col("node").alias("b"), F.col("label").alias("b_known"))
        hub = labels.select(F.col("node").alias("a"), F.col("label").alias("a_known"))
        named = around.join(own, "b", "left").join(hub, "a", "left").join(sizes.withColumnRenamed("node", "b"), "b")
        named = named.select(
            F.col("a").alias("hub"), F.col("b").alias("node"), "n", "m", "common", F.coalesce("b_known", "b").alias("label"),
            (F.coalesce("b_known", "b") != F.coalesce("a_known", "a")).alias("outside"),
        )
        named = materialise(named.filter(100 * F.col("m") >= self.percent * F.col("n")), "named")
        side = lambda x: [F.col(c).alias(f"{x}_{c}") for c in ("node", "n", "m", "common", "label", "outside")]
        left = named.filter("outside").select("hub", *side("a"))
        right = named.join(left.select("hub").distinct(), "hub", "left_semi").select("hub", *side("b"))
        on = ["hub"]
        hot = hot_keys(left, "hub", max(1, PART // 8))
        if not hot.isEmpty():
            left, right, on = dealt(left, hot, "hub", "a_node"), in_each_part(right, hot, "hub"), ["hub", "part"]
        # what both can share: of the hub's items, and of items that the hub lacks but others have
        most = F.least(
            F.col("a_m"), F.col("b_m"),
            F.least("a_common", "b_common") + F.least(F.col("a_m") - F.col("a_common"), F.col("b_m") - F.col("b_common")),
        )
        met = left.join(right, on).filter(
            (F.col("a_label") != F.col("b_label")) & (~F.col("b_outside") | (F.col("a_node") < F.col("b_node")))
            & (100 * most >= self.percent * (F.col("a_n") + F.col("b_n") - most))
        )
        rest = materialise(met.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct(), "rest")
        if not rest.isEmpty():
            links = links.unionByName(self.measured(rest, sets).filter("linked").select("a", "b"))
            labels = components(links)
        placed = nodes.join(labels, "node", "left").select("digest", F.coalesce("label", "node").alias("label"), "id")
        lowest = materialise(placed.groupBy("label").agg(F.min("id").alias("component")), "components")
        named = materialise(placed.join(lowest, "label").select("digest", "component", "label"), "classes")
        found = self.signed.select("doc_id", "mark", "n_shingles", "digest").join(named, "digest", "left")
        component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component"))
        return found.select("doc_id", "n_shingles", component.alias("component_id"), "mark", F.col("label").alias("group")).withColumn(
            "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
        )


def near_duplicates(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document; see the module for the rules."""
    return near_groups(docs, percent, shingle, bands, rows).select("doc_id", "n_shingles", "component_id", "kept")


def near_groups(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """:func:`near_duplicates` with ``mark``, which tells rows of one doc_id apart by text, and ``group``, the
    component's own number; a text without words has none."""
    return NearDuplicates(docs, percent, shingle, bands, rows).groups()


def survivors(found: DataFrame) -> DataFrame:
    """(kept_id, kept_mark): of ``near_groups`` one row of each group, and every row that has none."""
    own = found.filter("kept").select(F.struct(F.col("doc_id").alias("kept_id"), F.col("mark").alias("kept_mark")).alias("row"), "group")
    grouped = own.filter("group is not null").groupBy("group").agg(F.min("row").alias("row")).select("row.*")
    return grouped.unionByName(own.filter("group is null").select("row.*").distinct())
