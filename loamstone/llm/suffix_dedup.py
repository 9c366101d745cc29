"""Exact substring dedup with per-shard suffix arrays.

A byte goes when it is covered by a ``length``-byte string that also starts in a
document with a smaller doc_id.  Suffix arrays over whole texts would have to be
compared shard by shard, which grows with the square of the data, so texts are
dealt out by content first:

1. Every ``length``-byte window has an anchor: the leftmost of its ``ANCHOR``-byte
   strings with the smallest hash.  Equal windows have equal anchors.  Neighbouring
   windows with one anchor form a context, at most ``2 * length - ANCHOR`` bytes long.
2. Contexts go to the bucket of their anchor's hash, compressed; of equal contexts in
   one block of texts only that of the smallest doc_id travels, because the others are
   covered by it whatever else exists.  So a passage in a third of all documents is a
   row for each block, not for each document; the ranges that are covered already are
   merged and dealt round about, to no bucket of theirs.  Above ``FAN_IN`` blocks, tasks
   that each take the rows of so many blocks condense them alike before buckets are formed.
3. In a bucket, anchors that one document alone has are dropped.  The distinct contexts
   left are cut into shards; each shard gets a suffix array by Larsson-Sadakane
   refinement (groups of equal prefixes are split by the ranks of the suffixes behind
   them, doubling the compared length, settled groups are left alone) and common
   prefixes of neighbours by Kasai's rule; suffixes that share ``length`` bytes are one
   string with its smallest doc_id.  Shards are merged by binary search in their sorted
   strings; as equal windows share a bucket, no string has to be looked for elsewhere.
4. The covered ranges go back to their documents, which are cut and digested.

The work is done in ``passes`` over the input, each for its share of the anchors, so
that only that share of the contexts is in shuffle files at a time.

Common prefixes: :func:`kasai` goes through all contexts in text order side by side: the
prefix that a window shares with its neighbour in the suffix array is at most one byte
longer than what the next window shares with its own, so comparing goes on where it stopped.

Defined cases: null and empty texts have 0 bytes, and texts shorter than ``length``
lose nothing; documents with equal doc_id never cover each other; a null doc_id counts
as the largest one; a byte string is judged on the input, not on what is left; rows that
repeat a doc_id and a text are judged alike; an empty table gives no rows; a text is cut
whole by one task, whatever its length; other columns of ``docs``, whatever their names,
are ignored.  Rows of one doc_id are told apart by a 64-bit hash of the text, and contexts
are grouped by 128-bit fingerprints: equal hashes are taken for equal.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, input_bytes, map_arrow, mark, materialise, texts
from .near_dedup import mix

LENGTH = 50
ANCHOR = 16
#: Text bytes of one block, in which equal contexts are merged before they travel.
BLOCK_BYTES = 6 << 20
#: Bytes of contexts in a bucket, about.
BUCKET_BYTES = 4 << 20
#: Bytes of distinct contexts under one suffix array.
SHARD_BYTES = 2 << 20
PASSES = 2
#: Blocks whose rows of a bucket one task holds together.
FAN_IN = 4096
LAST = (1 << 63) - 1

_CODEC = "zstd"


def words_at(data: np.ndarray, n: int) -> np.ndarray:
    """The 8 bytes from each of the first n places on, as one unsigned integer; data must go on 8 bytes beyond."""
    return np.ndarray((n,), "<u8", data.tobytes() if not data.flags.c_contiguous else data, strides=(1,)).copy()


# ---- suffix arrays -------------------------------------------------------------------------


def suffix_ranks(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order and ranks by the first ``depth`` (8 at least) bytes; equal prefixes share a rank.

    Larsson-Sadakane refinement: the first sort is by eight bytes; each round compares by
    the ranks of the suffixes behind, doubling the depth, and touches unsettled groups only.
    """
    n = len(data)
    first = min(8, depth)
    key = words_at(np.concatenate([data, np.zeros(16, np.uint8)]), n).byteswap() >> np.uint64(8 * (8 - first))
    order = np.argsort(key, kind="stable").astype(np.int32)
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    del key
    heads = np.flatnonzero(new)
    rank = np.empty(n + 1, np.int32)
    rank[order] = np.repeat(heads.astype(np.int32), np.diff(np.append(heads, n)))
    rank[n] = -1
    have = first
    while have < depth:
        step = min(have, depth - have)
        sizes = np.diff(np.append(heads, n))
        open_groups = sizes > 1
        if not open_groups.any():
            break
        at = np.flatnonzero(np.repeat(open_groups, sizes)).astype(np.int32)  # places that are not settled
        suffix = order[at]
        both = rank[suffix].astype(np.int64) * (n + 1) + (rank[np.minimum(suffix + step, n)] + 1)
        by = np.argsort(both, kind="stable")
        suffix, both = suffix[by], both[by]
        del by
        order[at] = suffix
        split = np.concatenate([[True], both[1:] != both[:-1]])
        del both
        own_heads = np.flatnonzero(split)
        rank[suffix] = np.repeat(at[own_heads], np.diff(np.append(own_heads, len(at))))
        new[at] = split
        heads = np.flatnonzero(new)
        have += step
    return order, rank[:n]


def kasai(data: np.ndarray, starts: np.ndarray, before: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix, up to ``cap``, of the window at each of ``starts`` with the one at ``before``, its
    neighbour in sorted order (-1 for none).

    Kasai's rule, for all runs of neighbouring windows at once: if the windows at i and
    j = before(i) share h bytes, the one at i + 1 shares h - 1 at least with its own neighbour,
    if that is the one at j + 1, or if h < cap, so that j + 1 is sorted before i + 1 too.
    """
    out = np.zeros(len(starts), np.int64)
    if not len(starts):
        return out
    word = words_at(np.concatenate([data, np.zeros(cap + 8, np.uint8)]), len(data) + cap)
    is_window = np.zeros(len(data) + 2, bool)
    is_window[starts] = True
    heads = np.flatnonzero(np.concatenate([[True], np.diff(starts) != 1]))
    sizes = np.diff(np.append(heads, len(starts)))
    by_size = np.argsort(-sizes, kind="stable")
    heads, sizes = heads[by_size], sizes[by_size]
    known = np.zeros(len(heads), np.int64)
    for step in range(int(sizes[0])):
        live = int(np.searchsorted(-sizes, -step, side="left"))  # runs that are longer than step
        row = heads[:live] + step
        i, j, h = starts[row], before[row], known[:live]
        open_rows = np.flatnonzero((j >= 0) & (h < cap))
        while len(open_rows):
            at = h[open_rows]
            apart = word[i[open_rows] + at] ^ word[j[open_rows] + at]
            differ = apart != 0
            lowest = np.bitwise_count((apart & (~apart + np.uint64(1))) - np.uint64(1)) >> 3  # equal bytes in front
            at = np.minimum(at + np.where(differ, lowest, 8), cap)
            h[open_rows] = at
            open_rows = open_rows[~differ & (at < cap)]
        out[row] = h
        behind = before[np.minimum(row + 1, len(before) - 1)]
        carries = (j >= 0) & ((behind == j + 1) | ((h < cap) & is_window[j + 1]))
        known[:live] = np.where(carries, np.maximum(h - 1, 0), 0)
    return out


class Strings:
    """Sorted distinct strings with the smallest doc_id of each; grows by binary search."""

    def __init__(self, length: int) -> None:
        self.text, self.low = np.empty(0, f"S{length}"), np.empty(0, np.int64)

    def merge(self, text: np.ndarray, low: np.ndarray) -> None:
        at = np.searchsorted(self.text, text)
        inside = np.minimum(at, max(len(self.text) - 1, 0))
        known = (self.text[inside] == text) if len(self.text) else np.zeros(len(text), bool)
        np.minimum.at(self.low, at[known], low[known])
        self.text = np.insert(self.text, at[~known], text[~known])
        self.low = np.insert(self.low, at[~known], low[~known])

    def find(self, text: np.ndarray) -> np.ndarray:
        return self.low[np.searchsorted(self.text, text)]


def window_lows(contexts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], length: int) -> list[np.ndarray]:
    """For shards of (bytes, windows' starts, windows' doc_ids): the smallest doc_id with each window's string."""
    found = []
    merged = Strings(length)
    for data, starts, docs in contexts:
        order, _ = suffix_ranks(data, length)
        wanted = np.full(len(data), -1, np.int64)
        wanted[starts] = np.arange(len(starts))
        picked = order[wanted[order] >= 0].astype(np.int64)
        own = wanted[picked]
        before = np.empty(len(starts), np.int64)
        before[own] = np.concatenate([[-1], picked])[: len(picked)]
        heads = np.flatnonzero(kasai(data, starts, before, length)[own] < length)
        low = np.minimum.reduceat(docs[own], heads) if len(heads) else np.empty(0, np.int64)
        text = None
        if len(contexts) > 1:
            grid = data[picked[heads][:, None] + np.arange(length)]
            text = np.ascontiguousarray(grid).view(f"S{length}").ravel()
            merged.merge(text, low)
        found.append((own, heads, low, text))
    out = []
    for (own, heads, low, text), (_, starts, _) in zip(found, contexts, strict=True):
        low = merged.find(text) if text is not None else low
        each = np.empty(len(starts), np.int64)
        each[own] = np.repeat(low, np.diff(np.concatenate([heads, [len(own)]])))
        out.append(each)
    return out


# ---- contexts ------------------------------------------------------------------------------


def _anchor_hash(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return mix(low * np.uint64(0xA0761D6478BD642F) + mix(high * np.uint64(0xE7037ED1A0B428DB)))


def find_contexts(data: np.ndarray, limits: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, anchor place, anchor hash) of every context; texts lie between ``limits``."""
    n = len(data)
    empty = np.empty(0, np.int64)
    if n < length:
        return empty, empty, empty, empty.astype(np.uint64)
    padded = np.concatenate([data, np.zeros(24, np.uint8)])
    word = words_at(padded, n + 8)
    hashes = _anchor_hash(word[:n], word[8 : n + 8])
    del word
    low = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    span, have = length - ANCHOR + 1, 1
    while have < span:
        step = min(have, span - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    # low[s] is now the anchor of the window that starts at s
    change = np.zeros(n + 1, np.int8)
    long = limits[1:] - limits[:-1] >= length
    np.add.at(change, limits[:-1][long], 1)
    np.add.at(change, limits[1:][long] - length + 1, -1)
    valid = np.flatnonzero(np.cumsum(change[:-1], dtype=np.int8))
    if not len(valid):
        return empty, empty, empty, empty.astype(np.uint64)
    anchor = (low[valid] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    head = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (np.diff(valid) != 1)]))
    count = np.diff(np.concatenate([head, [len(valid)]]))
    place = anchor[head]
    return valid[head], count, place, hashes[place]


def grid_of(data: np.ndarray, first: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """Contexts as rows of ``width`` bytes (a multiple of 8), zeros behind their ends."""
    padded = np.concatenate([data, np.zeros(width, np.uint8)])
    grid = padded[first[:, None] + np.arange(width)]
    grid[np.arange(width) >= size[:, None]] = 0
    return grid


def fingerprints(grid: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each context, as one sortable array of pairs."""
    words = grid.view("<u8")
    out = np.empty(len(grid), [("a", np.uint64), ("b", np.uint64)])
    for name, seed in (("a", 0x2545F4914F6CDD1D), ("b", 0x9FB21C651E98DF25)):
        h = size.astype(np.uint64) + np.uint64(seed)
        for i in range(words.shape[1]):
            h = mix((h ^ words[:, i]) * np.uint64(seed | 1))
        out[name] = h
    return out


def lowest_of(prints: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group number of each context, row of each group's smallest doc_id)."""
    order = np.lexsort((docs, prints["b"], prints["a"]))
    p = prints[order]
    head = np.concatenate([[True], (p["a"][1:] != p["a"][:-1]) | (p["b"][1:] != p["b"][:-1])]) if len(p) else np.empty(0, bool)
    group = np.empty(len(p), np.int64)
    group[order] = np.cumsum(head) - 1
    return group, order[head]


def width_of(length: int) -> int:
    return -(-(2 * length - ANCHOR) // 8) * 8


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays behind each other, compressed, with the sizes needed to read them again."""
    raw = b"".join(a.tobytes() for a in arrays)
    head = struct.pack(f"<{len(arrays) + 1}q", len(raw), *[len(a) for a in arrays])
    return head + pa.compress(raw, codec=_CODEC, asbytes=True)


def unpack(data: bytes, kinds: list[str]) -> list[np.ndarray]:
    size, *counts = struct.unpack_from(f"<{len(kinds) + 1}q", data)
    raw = pa.decompress(data[8 * (len(kinds) + 1) :], decompressed_size=size, codec=_CODEC, asbytes=True)
    out, at = [], 0
    for kind, n in zip(kinds, counts, strict=True):
        a = np.frombuffer(raw, kind, n, at)
        out.append(a)
        at += a.nbytes
    return out


#: What a bucket's rows carry: doc_ids, text hashes, first windows, window counts, anchor offsets, bytes.
KINDS = ["<i8", "<i8", "<i4", "u1", "u1", "u1"]
#: Ranges that are covered whatever else there is: doc_ids, text hashes, from, to.
DONE = ["<i8", "<i8", "<i4", "<i4"]
DEALT = "bucket int, salt int, body binary"


def condense(doc: np.ndarray, size: np.ndarray, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows that travel on, rows that are covered): of equal contexts those of the smallest doc_id travel."""
    group, rep = lowest_of(fingerprints(grid, size), doc)
    is_rep = np.zeros(len(doc), bool)
    is_rep[rep] = True
    covered = ~is_rep & (doc > doc[rep][group])
    return np.flatnonzero(~covered), np.flatnonzero(covered)  # a document's own repeats are judged like its first


def merged_ranges(doc: np.ndarray, mark: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges, with those of one text that follow and touch each other made one."""
    if not len(doc):
        return doc, mark, a, b
    new = (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1]) | (a[1:] > b[:-1]) | (a[1:] < a[:-1]) | (b[1:] < b[:-1])
    head = np.flatnonzero(np.concatenate([[True], new]))
    tail = np.append(head[1:], len(doc)) - 1
    return doc[head], mark[head], a[head], b[tail]


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    buckets, salts, bodies = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.record_batch([pa.array(buckets, pa.int32()), pa.array(salts, pa.int32()), pa.array(bodies, pa.binary())], names=["bucket", "salt", "body"])


def _deal(length: int, buckets: int, passes: int, turn: int, salts: int):
    """Blocks of texts to (bucket, salt, contexts) rows; from ``buckets`` on, numbers stand for covered ranges."""
    width = width_of(length)

    def flush(parts: list[tuple], number: int) -> pa.RecordBatch:
        doc, mark, start, count, offset, hashes, grid = (np.concatenate(x) for x in zip(*parts, strict=True))
        size = count + length - 1
        travels, covered = condense(doc, size, grid)
        bucket = ((hashes[travels] >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows: list[tuple[int, int, bytes]] = []
        for b in np.flatnonzero(np.diff(cuts)):
            go = travels[order[cuts[b] : cuts[b + 1]]]
            body = grid[go][np.arange(width) < size[go][:, None]]
            rows.append((int(b), number % salts, pack(
                doc[go], mark[go], start[go].astype(np.int32), count[go].astype(np.uint8), offset[go].astype(np.uint8), body
            )))
        if len(covered):
            ranges = merged_ranges(doc[covered], mark[covered], start[covered].astype(np.int32), (start + size)[covered].astype(np.int32))
            rows.append((buckets + number % buckets, number % salts, pack(*ranges)))
        return _batch(rows)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) * 7919  # a number for each block, the same when a task runs again
        parts: list[tuple] = []
        held = 0
        for batch in chunks(batches, limit=256 << 10):
            raw = batch.column("text").cast(pa.binary()).to_pylist()
            data = np.frombuffer(b"".join(raw), np.uint8)
            limits = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
            with np.errstate(over="ignore"):
                first, count, place, hashes = find_contexts(data, limits, length)
                mine = (hashes >> np.uint64(8)) % np.uint64(passes) == np.uint64(turn)
                first, count, place, hashes = first[mine], count[mine], place[mine], hashes[mine]
                owner = np.searchsorted(limits, first, side="right") - 1
                doc = batch.column("id").to_numpy(zero_copy_only=False)[owner]
                mark = batch.column("mark").to_numpy(zero_copy_only=False)[owner]
                grid = grid_of(data, first, count + length - 1, width)
                parts.append((doc, mark, first - limits[owner], count, place - first, hashes, grid))
                held += len(data)
                if held >= BLOCK_BYTES:
                    yield flush(parts, number)
                    parts, held, number = [], 0, number + 1
        if held:
            with np.errstate(over="ignore"):
                yield flush(parts, number)

    return work


def contexts_of(bodies: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(doc, mark, start, count, offset, grid) of all contexts in rows of a bucket."""
    doc, mark, start, count, offset, body = (np.concatenate(x) for x in zip(*[unpack(b, KINDS) for b in bodies], strict=True))
    width = width_of(length)
    grid = np.zeros((len(doc), width), np.uint8)
    grid[np.arange(width) < (count.astype(np.int64) + length - 1)[:, None]] = body
    return doc, mark, start, count, offset, grid


def runs_of_rows(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, list[bytes]]]:
    """(key, bodies) of each run of rows with equal keys."""
    current, bodies = None, []
    for batch in batches:
        names = zip(*[batch.column(k).to_pylist() for k in keys], strict=True)
        for key, body in zip(names, batch.column("body"), strict=True):
            if key != current and bodies:
                yield current, bodies
                bodies = []
            current = key
            bodies.append(body.as_py())
    if bodies:
        yield current, bodies


def _condense(length: int, buckets: int):
    """Rows sorted by (bucket, salt) to one row of contexts for each, and one of ranges that are covered now."""
    width = width_of(length)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket, salt), bodies in runs_of_rows(batches, "bucket", "salt"):
            if bucket >= buckets:
                yield _batch([(bucket, salt, b) for b in bodies])
                continue
            doc, mark, start, count, offset, grid = contexts_of(bodies, length)
            size = count.astype(np.int64) + length - 1
            with np.errstate(over="ignore"):
                go, covered = condense(doc, size, grid)
            body = grid[go][np.arange(width) < size[go][:, None]]
            rows = [(bucket, salt, pack(doc[go], mark[go], start[go], count[go], offset[go], body))]
            if len(covered):
                a, b = start[covered], (start + size)[covered].astype(np.int32)
                rows.append((buckets + (bucket + salt) % buckets, salt, pack(*merged_ranges(doc[covered], mark[covered], a, b))))
            yield _batch(rows)

    return work


def judge_bucket(doc, start, count, offset, grid, length: int, shard_bytes: int = SHARD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, from, to) of the covered ranges of a bucket's contexts."""
    none = np.empty(0, np.int64)
    n = len(doc)
    # anchors that one document alone has can cover nothing
    at = grid[np.arange(n)[:, None], offset.astype(np.int64)[:, None] + np.arange(ANCHOR)].reshape(-1, ANCHOR)
    words = np.ascontiguousarray(at).view("<u8")
    hashes = _anchor_hash(words[:, 0], words[:, 1])
    order = np.argsort(hashes, kind="stable")
    head = np.flatnonzero(np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]]))
    spread = np.maximum.reduceat(doc[order], head) != np.minimum.reduceat(doc[order], head)
    live = np.sort(order[np.repeat(spread, np.diff(np.concatenate([head, [n]])))])
    if not len(live):
        return none, none, none
    size = count.astype(np.int64)[live] + length - 1
    group, rep = lowest_of(fingerprints(grid[live], size), doc[live])
    rep_size, rep_doc = size[rep], doc[live][rep]
    # distinct contexts in shards, each with its windows
    ends = np.cumsum(rep_size)
    shard = (ends - 1) // shard_bytes
    shards, windows = [], rep_size - length + 1
    for s in np.unique(shard):
        own = np.flatnonzero(shard == s)
        g = grid[live][rep[own]]
        data = g[np.arange(g.shape[1]) < rep_size[own][:, None]]
        base = np.concatenate([[0], np.cumsum(rep_size[own])[:-1]])
        w = windows[own]
        starts = np.repeat(base, w) + np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
        shards.append((data, starts, np.repeat(rep_doc[own], w)))
    lows = np.concatenate(window_lows(shards, length))  # contexts lie in shards in their order
    begin = np.concatenate([[0], np.cumsum(windows)])
    # every context of a group asks its own doc_id against the group's windows
    w = windows[group]
    row = np.repeat(np.arange(len(live)), w)
    inside = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
    hit = lows[np.repeat(begin[group], w) + inside] < doc[live][row]
    row, inside = row[hit], inside[hit]
    if not len(row):
        return none, none, none
    head = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (inside[1:] != inside[:-1] + 1)]))
    tail = np.concatenate([head[1:], [len(row)]]) - 1
    where = live[row[head]]
    return where, start[where] + inside[head], start[where] + inside[tail] + length


def _settle(length: int, buckets: int):
    """Bucket rows, sorted by bucket, to covered ranges."""

    def ranges(bucket: int, bodies: list[bytes]) -> tuple[np.ndarray, ...]:
        if bucket >= buckets:
            return tuple(np.concatenate(x) for x in zip(*[unpack(b, DONE) for b in bodies], strict=True))
        doc, mark, start, count, offset, grid = contexts_of(bodies, length)
        with np.errstate(over="ignore"):
            row, a, b = judge_bucket(doc, start, count, offset, grid, length)
        return doc[row], mark[row], a, b

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket,), bodies in runs_of_rows(batches, "bucket"):
            columns = ranges(bucket, bodies)
            yield pa.record_batch(
                [pa.array(c.astype(np.int64 if i < 2 else np.int32)) for i, c in enumerate(columns)], names=["id", "mark", "a", "b"]
            )

    return work


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        rows = []
        spans = batch.column("spans").to_pylist()
        for doc_id, raw, cover in zip(
            batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), spans, strict=True
        ):
            kept, at, gone, runs, end = [], 0, 0, 0, -1
            for x in sorted((s["a"], s["b"]) for s in cover or ()):
                a, b = x
                if a > end:
                    runs += 1
                    kept.append(raw[at:a])
                    gone += b - a
                    at = end = b
                elif b > end:
                    gone += b - end
                    at = end = b
            kept.append(raw[at:])
            rest = b"".join(kept)
            rows.append((doc_id, len(raw), gone, runs, hashlib.sha256(rest).hexdigest(), rest))
        columns = list(zip(*rows, strict=True))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        yield pa.record_batch(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def covered_ranges(docs: DataFrame, length: int = LENGTH, passes: int = PASSES) -> DataFrame:
    """(id, mark, a, b): byte ranges of each text that a smaller doc_id covers; (id, mark) names a row's text."""
    total = input_bytes(docs)
    buckets = max(512, -(-4 * total // (BUCKET_BYTES * passes)))
    keyed = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("id"), mark(F.col("text")).alias("mark"), "text")
    out: DataFrame | None = None
    salts = -(-total // (BLOCK_BYTES * FAN_IN))
    for turn in range(passes):
        rows = map_arrow(keyed, _deal(length, buckets, passes, turn, max(1, salts)), DEALT)
        if salts > 1:
            rows = rows.repartition(max(64, buckets // 4), "bucket", "salt").sortWithinPartitions("bucket", "salt")
            rows = map_arrow(rows, _condense(length, buckets), DEALT)
        rows = rows.drop("salt").repartition(max(64, buckets // 4), "bucket").sortWithinPartitions("bucket")
        found = materialise(map_arrow(rows, _settle(length, buckets), "id long, mark long, a int, b int"), "ranges")
        out = found if out is None else out.unionByName(found)
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, passes: int = PASSES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept binary) of every document."""
    base = texts(docs)
    ranges = covered_ranges(base, length, passes)
    spans = ranges.groupBy("id", "mark").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    marked = base.withColumns({"key": F.coalesce("doc_id", F.lit(LAST)), "own": mark(F.col("text"))})
    joined = marked.join(spans, (marked["key"] == spans["id"]) & (marked["own"] == spans["mark"]), "left")
    return map_arrow(
        joined.select("doc_id", "text", "spans"), _cut,
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary",
    )
