"""Graph operators: groups of related elements, expansion by hops, merged context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import STRONG_EDGES
from ..scratch import materialise

# Fixed value: what stands before each text that relations add.
RELATED = "\n\n[Related context]\n"

#: Edges from which on hot nodes are dealt over several tasks, and over how many.
MANY, PARTS = 5_000_000, 16


def strong(relationships: DataFrame) -> DataFrame:
    return relationships.filter(F.col("relationship_type").isin(*STRONG_EDGES))


def same_document(relationships: DataFrame, elements: DataFrame) -> DataFrame:
    """Edges whose both ends are elements of the edge's own document."""
    own = elements.select("document_id", "element_id")
    source = own.select("document_id", F.col("element_id").alias("source_element_id"))
    target = own.select("document_id", F.col("element_id").alias("target_element_id"))
    return relationships.join(source, ["document_id", "source_element_id"]).join(target, ["document_id", "target_element_id"])


def touching(relationships: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with an end among ``ids(element_id)``: two semi joins, no OR in a join condition."""
    at_source = relationships.join(ids.select(F.col("element_id").alias("source_element_id")), "source_element_id", "left_semi")
    at_target = relationships.join(ids.select(F.col("element_id").alias("target_element_id")), "target_element_id", "left_semi")
    return at_source.select(*relationships.columns).union(at_target.select(*relationships.columns)).distinct()


def groups(elements: DataFrame, relationships: DataFrame) -> DataFrame:
    """(document_id, element_id, group): components over strong edges between text and table elements.

    Labels fall to the smallest ordinal around until nothing changes; each round jumps to
    the label of the label, so rounds grow with the logarithm of a component's diameter.
    Every round is written to the shared folder.  Rows of one label, or of one hub, are dealt
    over ``PARTS`` tasks once a graph has more than ``MANY`` edges.
    """
    own = elements.filter(F.col("content_kind").isin("text", "table")).select("document_id", "element_id", F.col("ordinal").alias("label"))
    ids = own.select("document_id", "element_id", F.col("label").alias("n"))
    edge = strong(relationships).select("document_id", F.col("source_element_id").alias("a"), F.col("target_element_id").alias("b"))
    a = ids.select("document_id", F.col("element_id").alias("a"), F.col("n").alias("na"))
    b = ids.select("document_id", F.col("element_id").alias("b"), F.col("n").alias("nb"))
    numbered = edge.join(a, ["document_id", "a"]).join(b, ["document_id", "b"])
    both = materialise(numbered.select("document_id", "na", "nb").union(numbered.select("document_id", "nb", "na")).distinct(), "edges")
    parts = PARTS if both.limit(MANY + 1).count() > MANY else 1
    dealt = lambda df, by: df.withColumn("part", F.pmod(F.xxhash64(by), F.lit(parts)).cast("int"))
    copied = lambda df: df.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    # only nodes with an edge take part in the rounds
    labels = materialise(both.select("document_id", F.col("na").alias("n")).distinct().withColumn("label", F.col("n")), "labels")
    ways = dealt(both, "na")
    while True:
        around = ways.join(copied(labels.select("document_id", F.col("n").alias("nb"), F.col("label").alias("near"))), ["document_id", "nb", "part"])
        low = around.groupBy("document_id", F.col("na").alias("n")).agg(F.min("near").alias("near"))
        lower = labels.join(low, ["document_id", "n"]).select("document_id", "n", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        lower = materialise(lower, "lower")
        up = copied(lower.select("document_id", F.col("n").alias("label"), F.col("label").alias("above")))
        new = dealt(lower, "n").join(up, ["document_id", "label", "part"]).select("document_id", "n", "old", F.col("above").alias("label"))
        new = materialise(new, "labels")
        labels = new.select("document_id", "n", "label")
        if new.filter("label <> old").isEmpty():
            break
    joined = ids.join(labels, ["document_id", "n"], "left")
    return joined.select("document_id", "element_id", F.col("n").alias("ordinal"), F.coalesce("label", "n").alias("group"))


def expand(seeds: DataFrame, relationships: DataFrame, elements: DataFrame, max_hops: int = 1) -> DataFrame:
    """(result_id, document_id, element_id, hop, relationship_type): what strong edges reach from each result's elements.

    ``seeds(result_id, document_id, element_id)``.  One join for each hop over all results;
    what was seen before is left out by an anti join; the type is that of the first strong
    edge, in stored order, by which an element was reached.
    """
    links = strong(relationships)
    forth = links.select("document_id", F.col("source_element_id").alias("from_id"), F.col("target_element_id").alias("element_id"), "relationship_type", "rel_ordinal")
    back = links.select("document_id", F.col("target_element_id").alias("from_id"), F.col("source_element_id").alias("element_id"), "relationship_type", "rel_ordinal")
    ways = forth.unionByName(back)
    known = elements.select("document_id", "element_id")
    visited = seeds.select("result_id", "document_id", "element_id").distinct()
    frontier, out = visited, None
    for hop in range(1, max_hops + 1):
        met = frontier.withColumnRenamed("element_id", "from_id").join(ways, ["document_id", "from_id"])
        met = met.join(visited, ["result_id", "document_id", "element_id"], "left_anti").join(known, ["document_id", "element_id"], "left_semi")
        found = met.groupBy("result_id", "document_id", "element_id").agg(F.min_by("relationship_type", "rel_ordinal").alias("relationship_type"))
        found = found.withColumn("hop", F.lit(hop))
        out = found if out is None else out.unionByName(found)
        frontier = found.select("result_id", "document_id", "element_id")
        visited = visited.unionByName(frontier)
    return out


def merged_context(results: DataFrame, reached: DataFrame, elements: DataFrame) -> DataFrame:
    """``results(result_id, document_id, content)`` with relationship_context and the reached texts appended, by hop and element."""
    full = reached.join(elements.select("document_id", "element_id", "element_type", "text", "asset_path"), ["document_id", "element_id"])
    item = F.struct("hop", "element_id", "element_type", "relationship_type", "text", "asset_path")
    gathered = full.groupBy("result_id").agg(F.sort_array(F.collect_list(item)).alias("relationship_context"))
    joined = results.join(gathered, "result_id", "left")
    context = F.coalesce("relationship_context", F.array().cast(gathered.schema["relationship_context"].dataType))
    texts = F.transform(F.filter(context, lambda c: F.trim(F.coalesce(c["text"], F.lit(""))) != ""), lambda c: F.concat(F.lit(RELATED), c["text"]))
    return joined.withColumn("relationship_context", context).withColumn("content", F.concat("content", F.array_join(texts, "")))
