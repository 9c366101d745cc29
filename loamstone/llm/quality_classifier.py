"""Quality classifier: Bradley-Terry ranking learnt from preference pairs.

A pair (good, bad) of labelled documents says that the first is preferred.  Document
strengths are linear in text features, the chance that i beats j is the logistic of
the difference of their strengths, and the weights minimise the logistic loss on
feature differences.  The cut between good and bad is the exact quantile of the
strengths of all labelled rows that are not held out, at the share of bad labels among
them; a document's score is the logistic of its distance to the cut, moved so that the
cut itself scores ``CUT_SCORE``.

Features are taken from whole texts, once, for all documents: frequencies of
character-class pairs, word and line statistics.  Labels, lang, source and doc_id are
never features.  Fitting the weights uses a bounded sample of labelled rows (``FIT_ROWS``
for each class, those with the lowest hash of doc_id) and ``FIT_PAIRS`` pairs; everything
else, cut and spread included, covers all rows without a shuffle of texts.

Defined cases: null and empty texts have zero features and are scored like any other;
rows that repeat a doc_id are scored each on its own; a null doc_id has no label and
is not held out; a doc_id with both labels counts as each; without labels of both kinds
every score is 0.5; equal strengths score alike, and one at the cut scores ``CUT_SCORE``
and is predicted good; an empty table gives no rows; very long texts are read whole, by one
task each; other columns of ``docs``, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, map_arrow, materialise, small, texts

FIT_ROWS = 3000
FIT_PAIRS = 40_000
CUT_SCORE = 0.7
FOLDS, HELD_OUT = 4, 2
#: Cells of one histogram on the way to a quantile; fewer distinct values than that are sorted.
CELLS = 4096

#: Character classes: lower, upper, digit, blank, line end, stop, inner mark, symbol, control, beyond ASCII.
CLASSES = 10


def _classes() -> np.ndarray:
    kinds = np.full(256, 8, np.uint8)
    kinds[128:] = 9
    for kind, members in enumerate([b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,", b"!?;:'\"()-_/@=[]", b"#*$%&|<>^~`{}\\+"]):
        kinds[list(members)] = kind
    return kinds


KINDS = _classes()
N_FEATURES = CLASSES * CLASSES + 8


def features(batch: list[bytes]) -> np.ndarray:
    """One row of features for each text, given as UTF-8."""
    out = np.zeros((len(batch), N_FEATURES), np.float32)
    sizes = np.array([len(b) for b in batch], np.int64)
    data = KINDS[np.frombuffer(b"".join(batch), np.uint8)].astype(np.int64)
    if len(data) > 1:
        owner = np.repeat(np.arange(len(batch)), sizes)
        inside = owner[1:] == owner[:-1]
        code = (owner[:-1] * CLASSES + data[:-1]) * CLASSES + data[1:]
        counts = np.bincount(code[inside], minlength=len(batch) * CLASSES * CLASSES)
        pairs = counts.reshape(len(batch), -1)
        out[:, : CLASSES * CLASSES] = np.sqrt(pairs / np.maximum(pairs.sum(axis=1, keepdims=True), 1))
    for i, raw in enumerate(batch):
        words, lines = raw.split(), raw.split(b"\n")
        n = len(words)
        if not n:
            continue
        full = [x for x in lines if x.strip()]
        distinct = len(set(words))
        out[i, CLASSES * CLASSES :] = (
            np.log1p(n) / 10, len(raw) / n / 20, distinct / n, 1 - len(set(zip(words, words[1:], words[2:]))) / max(n - 2, 1) if n > 2 else 0,
            len(set(full)) / max(len(full), 1), np.log1p(len(full)) / 10, max(map(len, words)) / 100, n < 50,
        )
    return out


@dataclass(frozen=True)
class Model:
    """Standardisation, weights and cut of a fitted ranking."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    steep: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.weights.any():
            return np.full(len(x), 0.5)
        shift = np.log(CUT_SCORE / (1 - CUT_SCORE))
        return 1 / (1 + np.exp(-np.clip((self.strength(x) - self.cut) * self.steep + shift, -30, 30)))


def fit(x: np.ndarray, good: np.ndarray, pairs: int = FIT_PAIRS, seed: int = 7, rounds: int = 400, decay: float = 1e-3) -> Model:
    """Bradley-Terry weights by accelerated gradient descent on the pairwise logistic loss."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    zero = np.zeros(x.shape[1])
    if not good.any() or good.all():
        return Model(mean, scale, zero, 0.0, 1.0)
    z = (x - mean) / scale
    rng = np.random.default_rng(seed)
    ups, downs = np.flatnonzero(good), np.flatnonzero(~good)
    diff = np.clip(z[rng.choice(ups, pairs)] - z[rng.choice(downs, pairs)], -8, 8)
    step = 4.0 / (np.linalg.norm(diff, 2) ** 2 / len(diff) + 4 * decay)
    w, ahead, t = zero, zero, 1.0
    for _ in range(rounds):
        lose = 1 / (1 + np.exp(np.clip(diff @ ahead, -30, 30)))
        grad = -(lose @ diff) / len(diff) + decay * ahead
        new = ahead - step * grad
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    strength = z @ w
    cut = float(np.quantile(strength, float((~good).mean()), method="midpoint"))
    spread = float(np.median(strength[good]) - np.median(strength[~good]))
    return Model(mean, scale, w, cut, 8.0 / max(spread, 1e-6))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, limit=1 << 20):
        x = features(batch.column("text").cast(pa.binary()).to_pylist())
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * N_FEATURES, pa.int32()), pa.array(x.ravel()))
        yield pa.record_batch([batch.column("doc_id"), flat], names=["doc_id", "x"])


def _score(model: Model):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, N_FEATURES)
                score = np.round(model.score(x.astype(np.float64)), 6)
                yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(score)], names=["doc_id", "held_out", "score"])

    return work


def _strengths(model: Model):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, N_FEATURES)
                yield pa.record_batch([batch.column("good"), pa.array(model.strength(x.astype(np.float64)))], names=["good", "strength"])

    return work


def at_ranks(values: DataFrame, ranks: list[int], cells: int = CELLS) -> dict[int, float]:
    """The values at these places, from 0 on, of the sorted ``values(strength, n)``, each of which stands n times.

    Histograms narrow the range down; only their cells, or as few values, reach the driver.
    """
    low, high, size = values.agg(F.min("strength"), F.max("strength"), F.count("*")).first()
    if size <= cells:
        found = sorted(tuple(r) for r in values.groupBy("strength").agg(F.sum("n")).collect())
        ends = np.cumsum([n for _, n in found])
        return {r: found[int(np.searchsorted(ends, r, side="right"))][0] for r in ranks}
    if low == high:
        return dict.fromkeys(ranks, low)
    cell = F.least(F.floor((F.col("strength") - low) / (high - low) * cells), F.lit(cells - 1))
    counted = values.groupBy(cell.alias("cell")).agg(F.min("strength").alias("a"), F.max("strength").alias("b"), F.sum("n").alias("n")).orderBy("cell").collect()
    out, before = {}, 0
    for r in counted:
        inside = [x - before for x in ranks if before <= x < before + r["n"]]
        if inside:
            part = values.filter(F.col("strength").between(r["a"], r["b"]))
            out |= {x + before: v for x, v in at_ranks(part, inside, cells).items()}
        before += r["n"]
    return out


def quantile(values: DataFrame, total: int, share: float) -> float:
    """The midpoint quantile of ``total`` sorted values."""
    place = (total - 1) * share
    ends = [int(np.floor(place)), int(np.ceil(place))]
    found = at_ranks(values, sorted(set(ends)))
    return (found[ends[0]] + found[ends[1]]) / 2


def calibrate(model: Model, labelled: DataFrame) -> Model:
    """``model`` with the cut and the spread of all rows of ``labelled(good, x)``."""
    strengths = map_arrow(labelled.select("good", "x"), _strengths(model), "good int, strength double")
    values = materialise(strengths.groupBy("good", "strength").agg(F.count("*").alias("n")), "strengths")
    counts = {r["good"]: r["n"] for r in values.groupBy("good").agg(F.sum("n").alias("n")).collect()}
    total = sum(counts.values())
    cut = quantile(values, total, counts[0] / total)
    good, bad = (quantile(values.filter(F.col("good") == k), counts[k], 0.5) for k in (1, 0))
    return replace(model, cut=cut, steep=8.0 / max(good - bad, 1e-6))


def sample(labelled: DataFrame) -> list:
    """The ``FIT_ROWS`` rows of ``labelled(doc_id, good, x)`` with the lowest hash; every task leaves out most others first."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    n = labelled.count()
    near = labelled.filter(place < F.lit(int(min(1.0, 1.5 * FIT_ROWS / max(n, 1)) * (1 << 30))))
    for rows in (near, labelled):
        found = rows.orderBy(place, "doc_id", F.xxhash64("x")).select("good", "x").limit(FIT_ROWS).collect()
        if len(found) >= min(n, FIT_ROWS):
            break
    return found


def train(known: DataFrame, labels: DataFrame) -> Model:
    """A model from the features of labelled rows that are not held out: weights from a sample, the cut from all."""
    own = labels.select(labels["doc_id"].cast("long").alias("l_id"), F.col("quality").cast("int").alias("good")).filter("good in (0, 1)")
    joined = known.filter(~F.col("held_out")).join(small(own.distinct()), F.col("doc_id") == F.col("l_id"))
    rows = [r for k in (1, 0) for r in sample(joined.filter(F.col("good") == k))]
    if not rows:
        return fit(np.zeros((1, N_FEATURES)), np.zeros(1, bool))
    model = fit(np.array([r["x"] for r in rows], np.float64), np.array([r["good"] == 1 for r in rows]))
    return calibrate(model, joined) if model.weights.any() else model


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT
    known = materialise(
        map_arrow(texts(docs), _featurise, "doc_id long, x array<float>").withColumn("held_out", held), "features"
    )
    scored = map_arrow(known, _score(train(known, labels)), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= CUT_SCORE).cast("int"))
