"""Queries of edges, groups, expansion, time and space."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import graph, preprocess, relationships
from . import views

EDGES = """edges as (select source as document_id, cast(doc_id as varchar) as s, cast(case when doc_id % 17 = 0 then doc_id + 1000000000 else floor(doc_id / 2) end as bigint) as tn,
  case when doc_id % 5 = 0 then 'follows' when doc_id % 3 = 0 then 'contains' else 'refers_to' end as relationship_type from documents),
 e as (select document_id, s, cast(tn as varchar) as t, relationship_type from edges)"""
CHAIN = """chain as (select source as document_id, row_number() over w as n, doc_id, lag(doc_id, 4) over w as before from documents window w as (partition by source order by doc_id)),
 links as (select document_id, n, cast(doc_id as varchar) as s, cast(before as varchar) as t, case when n % 4 = 0 then 'follows' when n % 3 = 0 then 'contains' else 'refers_to' end as relationship_type
   from chain where before is not null)"""


def reconcile_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges whose both ends are documents of the same source that are not blank."""
    kept = preprocess.valid_elements(views.elements(spark, sf_dir))
    return preprocess.reconcile(views.edges(spark, sf_dir), kept).select("document_id", "source_element_id", "relationship_type", "target_element_id")


def edges_same_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.same_document(views.edges(spark, sf_dir), views.elements(spark, sf_dir))
    return found.select("document_id", "source_element_id", "relationship_type", "target_element_id")


def touching_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = views.elements(spark, sf_dir).filter("ordinal % 20 = 0").select("element_id")
    return graph.touching(views.edges(spark, sf_dir), asked).select("document_id", "source_element_id", "relationship_type", "target_element_id")


def orphan_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.attach_orphans(views.elements(spark, sf_dir), views.edges(spark, sf_dir))


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.groups(views.elements(spark, sf_dir), views.chain_edges(spark, sf_dir))
    return found.select("document_id", "element_id", F.col("group").alias("component"))


COMPONENTS = f"""with recursive {CHAIN},
 nodes as (select source as document_id, doc_id from documents where not (doc_id % 13 = 0 and doc_id % 11 <> 0)),
 st as (select l.document_id, cast(s as bigint) as a, cast(t as bigint) as b from links l where relationship_type in ('contains', 'refers_to')
   and cast(s as bigint) in (select doc_id from nodes) and cast(t as bigint) in (select doc_id from nodes)),
 both_ways as (select document_id, a, b from st union select document_id, b, a from st),
 reach as (select document_id, doc_id as x, doc_id as y from nodes union select r.document_id, r.x, w.b from reach r join both_ways w on w.document_id = r.document_id and w.a = r.y)
 select document_id, cast(x as varchar) as element_id, min(y) as component from reach group by 1, 2"""


def khop_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = views.elements(spark, sf_dir)
    seeds = own.filter("ordinal % 20 = 0").select(F.col("element_id").alias("result_id"), "document_id", "element_id")
    return graph.expand(seeds, views.chain_edges(spark, sf_dir), own, 2)


KHOP = f"""with {CHAIN}, st as (select * from links where relationship_type in ('contains', 'refers_to')),
 ways as (select document_id, s as f, t as g, relationship_type, n from st union all select document_id, t, s, relationship_type, n from st),
 seeds as (select cast(doc_id as varchar) as result_id, source as document_id from documents where doc_id % 20 = 0),
 one as (select result_id, d.document_id, g as element_id, arg_min(relationship_type, n) as relationship_type, 1 as hop from seeds d join ways w on w.document_id = d.document_id and w.f = d.result_id and g <> d.result_id group by 1, 2, 3),
 two as (select o.result_id, o.document_id, g as element_id, arg_min(w.relationship_type, n) as relationship_type, 2 as hop from one o join ways w on w.document_id = o.document_id and w.f = o.element_id
   where g <> o.result_id and not exists (select 1 from one x where x.result_id = o.result_id and x.element_id = g) group by 1, 2, 3),
 reached as (select * from one union all select * from two)"""


def merged_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = views.elements(spark, sf_dir)
    seeds = own.filter("ordinal % 20 = 0")
    results = seeds.select(F.col("element_id").alias("result_id"), "document_id", F.col("text").alias("content"))
    reached = graph.expand(seeds.select(F.col("element_id").alias("result_id"), "document_id", "element_id"), views.chain_edges(spark, sf_dir), own, 2)
    found = graph.merged_context(results, reached, own)
    return found.select("result_id", F.size("relationship_context").alias("n_context"), F.sha2(F.col("content").cast("binary"), 256).alias("content_sha256"))


MERGED = KHOP + """, full_text as (select r.result_id, r.hop, r.element_id, coalesce(d.text, '') as text from reached r join documents d on cast(d.doc_id as varchar) = r.element_id),
 added as (select result_id, count(*) as n, string_agg(case when trim(text) <> '' then chr(10) || chr(10) || '[Related context]' || chr(10) || text else '' end, '' order by hop, element_id) as more from full_text group by 1)
 select cast(doc_id as varchar) as result_id, cast(coalesce(n, 0) as int) as n_context, sha256(coalesce(text, '') || coalesce(more, '')) as content_sha256
 from documents left join added on result_id = cast(doc_id as varchar) where doc_id % 20 = 0"""


def temporal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relationships.temporal_edges(views.segments(spark, sf_dir), views.frames(spark, sf_dir), block=600.0)


TEMPORAL = """with ev as (select event_id, cast(user_id as varchar) as u, epoch_us(ts) / 1000000.0 as t from events),
 seg as (select *, t + 2 + event_id % 8 * 600 as z from ev where event_id % 4 = 0), fr as (select * from ev where event_id % 4 <> 0),
 p as (select s.u, cast(s.event_id as varchar) as a, cast(f.event_id as varchar) as b from seg s join fr f on f.u = s.u and f.t >= s.t - 1 and f.t <= s.z + 1)
 select u as document_id, a as source_element_id, b as target_element_id, 'temporally_adjacent' as relationship_type from p union all select u, b, a, 'temporally_adjacent' from p"""


def spatial_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relationships.spatial_edges(views.boxes(spark, sf_dir))


SPATIAL = f"""with b as ({views.boxes_sql()}),
 p as (select cast(x.k as varchar) as s, cast(y.k as varchar) as t, round(sqrt(pow((x.x0 + x.x1) / 2 - (y.x0 + y.x1) / 2, 2) + pow((x.y0 + x.y1) / 2 - (y.y0 + y.y1) / 2, 2)), 6) as distance
   from b x join b y on x.page = y.page and x.k < y.k and greatest(0, y.y0 - x.y1, x.y0 - y.y1) <= 80 and greatest(0, y.x0 - x.x1, x.x0 - y.x1) <= 80)
 select 'parts' as document_id, s as source_element_id, t as target_element_id, 'spatially_adjacent' as relationship_type, distance from p union all select 'parts', t, s, 'spatially_adjacent', distance from p"""


def caption_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = relationships.captions(*views.layout(spark, sf_dir))
    return found.select("page_number", "kind", "source_element_id", "target_element_id", "number")


CAPTIONS = rf"""with {views.layout_sql()},
 num as (select o.k as ok, o.page, o.kind, t.k as tk, abs(t.y0 - o.y1) as apart,
   nullif(case when o.kind = 'image' then regexp_extract(t.text, '(?i)\b(?:figure|fig\.)\s+(\d+(?:\.\d+)*)', 1) else regexp_extract(t.text, '(?i)\btable\s+(\d+(?:\.\d+)*)', 1) end, '') as number
   from objects o join texts t on o.page = t.page and greatest(0, t.y0 - o.y1, o.y0 - t.y1) <= 60 and greatest(0, t.x0 - o.x1, o.x0 - t.x1) <= 80),
 capt as (select * from num where number is not null qualify row_number() over (partition by ok order by apart, tk) = 1)"""


def figure_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects, texts = views.layout(spark, sf_dir)
    found = relationships.references(texts, relationships.captions(objects, texts))
    return found.select("source_element_id", "relationship_type", "target_element_id")


def table_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that stay because no table of their page covers half of them."""
    objects, texts = views.layout(spark, sf_dir)
    wide = objects.filter("kind = 'table'").withColumn("bbox", G.bbox(F.col("bbox.x0"), F.col("bbox.y0"), F.col("bbox.x1") + 200, F.col("bbox.y1") + 200))
    return relationships.drop_inside_tables(texts, wide).select("element_id")


OVERLAPS = f"""with {views.layout_sql()}, w as (select page, x0, y0, x1 + 200 as x1, y1 + 200 as y1 from objects where kind = 'table')
 select cast(t.k as varchar) as element_id from texts t where not exists (select 1 from w where w.page = t.page
   and greatest(least(t.x1, w.x1) - greatest(t.x0, w.x0), 0) * greatest(least(t.y1, w.y1) - greatest(t.y0, w.y0), 0) >= 0.5 * ((t.x1 - t.x0) * (t.y1 - t.y0)))"""


def box_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas, overlaps, gaps and distances of each box and the next."""
    b = views.boxes(spark, sf_dir).select("ordinal", "bbox")
    nxt = b.select((F.col("ordinal") - 1).alias("ordinal"), F.col("bbox").alias("o"))
    x, y = F.col("bbox"), F.col("o")
    return b.join(nxt, "ordinal").select(
        F.col("ordinal").cast("long").alias("k"), G.area(x).alias("area"), G.intersection(x, y).alias("common"), F.round(G.overlap_ratio(x, y), 6).alias("ratio"),
        G.gap(x, y, "y").alias("v_gap"), G.gap(x, y, "x").alias("h_gap"), F.round(G.distance(x, y), 6).alias("distance"),
    )


BOXES = f"""with b as ({views.boxes_sql()}) select x.k, (x.x1 - x.x0) * (x.y1 - x.y0) as area,
 greatest(least(x.x1, y.x1) - greatest(x.x0, y.x0), 0) * greatest(least(x.y1, y.y1) - greatest(x.y0, y.y0), 0) as common,
 round(greatest(least(x.x1, y.x1) - greatest(x.x0, y.x0), 0) * greatest(least(x.y1, y.y1) - greatest(x.y0, y.y0), 0) / ((x.x1 - x.x0) * (x.y1 - x.y0)), 6) as ratio,
 greatest(0.0, y.y0 - x.y1, x.y0 - y.y1) as v_gap, greatest(0.0, y.x0 - x.x1, x.x0 - y.x1) as h_gap,
 round(sqrt(pow((x.x0 + x.x1) / 2 - (y.x0 + y.x1) / 2, 2) + pow((x.y0 + x.y1) / 2 - (y.y0 + y.y1) / 2, 2)), 6) as distance from b x join b y on y.k = x.k + 1"""

QUERIES = {
    "reconcile_edges": (reconcile_edges, f"""with {EDGES}, ok as (select source as document_id, cast(doc_id as varchar) as id from documents
        where case when doc_id % 11 = 0 or doc_id % 13 <> 0 then trim(coalesce(text, '')) <> '' else doc_id % 26 <> 0 end)
        select e.document_id, s as source_element_id, relationship_type, t as target_element_id from e
        where exists (select 1 from ok where ok.document_id = e.document_id and id = s) and exists (select 1 from ok where ok.document_id = e.document_id and id = t)"""),
    "edges_same_document": (edges_same_document, f"with {EDGES} select e.document_id, s as source_element_id, relationship_type, t as target_element_id from e join documents d on cast(d.doc_id as varchar) = t and d.source = e.document_id"),
    "touching_edges": (touching_edges, f"with {EDGES} select document_id, s as source_element_id, relationship_type, t as target_element_id from e where cast(s as bigint) % 20 = 0 or (cast(t as bigint) % 20 = 0 and cast(t as bigint) in (select doc_id from documents))"),
    "orphan_edges": (orphan_edges, f"with {EDGES} select source as document_id, 'document' as source_element_id, 'contains' as relationship_type, cast(doc_id as varchar) as target_element_id from documents d where not exists (select 1 from e where e.document_id = d.source and e.t = cast(d.doc_id as varchar))"),
    "components": (components, COMPONENTS),
    "khop_context": (khop_context, KHOP + " select result_id, document_id, element_id, relationship_type, hop from reached"),
    "merged_context": (merged_context, MERGED),
    "temporal_pairs": (temporal_pairs, TEMPORAL),
    "spatial_pairs": (spatial_pairs, SPATIAL),
    "caption_match": (caption_match, CAPTIONS + " select page as page_number, kind, cast(tk as varchar) as source_element_id, cast(ok as varchar) as target_element_id, number from capt"),
    "figure_refs": (figure_refs, CAPTIONS + r""", named as (select * from capt qualify row_number() over (partition by page, kind, number order by ok) = 1),
        said as (select k, page, 'image' as kind, nullif(regexp_extract(text, '(?i)\b(?:figure|fig\.)\s+(\d+(?:\.\d+)*)', 1), '') as number from texts
          union all select k, page, 'table', nullif(regexp_extract(text, '(?i)\btable\s+(\d+(?:\.\d+)*)', 1), '') from texts)
        select cast(said.k as varchar) as source_element_id, 'refers_to' as relationship_type, cast(named.ok as varchar) as target_element_id from said join named using (page, kind, number)"""),
    "table_overlap": (table_overlap, OVERLAPS),
    "box_functions": (box_functions, BOXES),
}
