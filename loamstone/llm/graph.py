"""Connected components of an edge table: local union-find, then label jumping.

Each task first runs union-find over blocks of its edges and passes on only a
spanning forest.  What is left is joined: every node takes the smallest label
around it, then the label of its label, until nothing changes, which needs about
the logarithm of a component's diameter in rounds.  All rounds are equi-joins and
map-side combined minima; where a hub has more than ``PART`` edges, or a label so many
nodes, they are dealt over several tasks.  Nothing is collected, and each round is written
to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt, hot_keys, in_each_part, map_arrow, materialise

#: Edges that one union-find holds.
BLOCK = 200_000
#: Rows of one key that one task joins.
PART = 200_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def flush() -> pa.RecordBatch:
        rows = [(x, find(x)) for x in list(parent)]
        rows = [r for r in rows if r[0] != r[1]]
        parent.clear()
        return pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) >= BLOCK:
            yield flush()
    if parent:
        yield flush()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node that ``edges(a, b)`` names; the label is the smallest node of its component."""
    forest = materialise(map_arrow(edges.select("a", "b"), _forest, "a long, b long").distinct(), "forest")
    both = materialise(forest.union(forest.select("b", "a")), "edges")
    labels = materialise(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
        .select("node", F.least("node", "near").alias("label")),
        "labels",
    )
    many = labels.count() > PART
    hubs = hot_keys(both, "b", PART) if many else None
    spread = dealt(both, hubs, "b", "a") if many else both.withColumn("part", F.lit(0))
    while True:
        known = labels.withColumnRenamed("node", "b")
        known = in_each_part(known, hubs, "b") if many else known.withColumn("part", F.lit(0))
        seen = spread.join(known, ["b", "part"]).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(seen, labels["node"] == seen["a"]).select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        lower = materialise(lower, "lower")
        above = lower.select(F.col("node").alias("label"), F.col("label").alias("up_label"))
        roots = hot_keys(lower, "label", PART) if many else None
        left = dealt(lower, roots, "label", "node") if many else lower.withColumn("part", F.lit(0))
        above = in_each_part(above, roots, "label") if many else above.withColumn("part", F.lit(0))
        new = materialise(left.join(above, ["label", "part"]).select("node", "old", F.least("label", "up_label").alias("label")), "labels")
        labels = new.select("node", "label")
        if new.filter(F.col("label") != F.col("old")).isEmpty():
            return labels
