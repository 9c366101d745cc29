"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

CAPITALS, SMALLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _split(separators: str) -> str:
    """The words of a text, A-Z lowered."""
    return rf"list_filter(string_split_regex(translate(coalesce(text, ''), '{CAPITALS}', '{SMALLS}'), '{separators}'), lambda x: x <> '')"


WORDS = _split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANKED = _split(r"[\x20\x09-\x0D]+")

DECONTAMINATION = f"""
with items as (select item_id, {WORDS} as w from benchmark),
runs as (select distinct item_id, least(len(w), 13) as n, array_to_string(w[s : s + least(len(w), 13) - 1], ' ') as run
  from (select item_id, w, unnest(range(1, greatest(len(w) - 11, 2))) as s from items where len(w) > 0)),
docs as (select row_number() over () as rid, doc_id, {WORDS} as w from documents),
sizes as (select distinct n from runs),
places as (select rid, s, n, array_to_string(w[s : s + n - 1], ' ') as run
  from (select rid, w, n, unnest(range(1, len(w) - n + 2)) as s from docs, sizes where len(w) >= n)),
found as (select rid, s, places.n, item_id from places join runs on runs.run = places.run and runs.n = places.n),
hits as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(s, s + n)) as p from (select distinct rid, s, n from found)) group by 1),
named as (select rid, count(*) as n_items, string_agg(i, ',' order by i) as items from (select distinct rid, cast(item_id as varchar) as i from found where item_id is not null) group by 1)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from docs left join hits using (rid) left join named using (rid)
"""

NEAR_DUPLICATES = f"""
with recursive docs as (select doc_id, {BLANKED} as w from documents),
sets as (select distinct doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as s from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from docs where len(w) >= 3)
  union all select doc_id, array_to_string(w, ' ') from docs where len(w) between 1 and 2),
sizes as (select doc_id, count(*) as n from sets group by 1),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as c from sets a join sets b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (select x, y from pairs join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * c >= 85 * (p.n + q.n - c)),
both_ways as (select x, y from links union all select y, x from links),
reach as (select distinct x as a, x as b from both_ways union select r.a, w.y from reach r join both_ways w on w.x = r.b),
least_of as (select a, min(b) as low from reach group by 1)
select d.doc_id, coalesce(n, 0) as n_shingles, coalesce(low, d.doc_id) as component_id, d.doc_id = coalesce(low, d.doc_id) as kept
from documents d left join sizes on sizes.doc_id = d.doc_id left join least_of on a = d.doc_id
"""


def sharding(limit: int) -> str:
    """Shards by prefixes of 60 bits: sizes of every prefix, the shortest that fits, and pieces of cells that never do."""
    return f"""
with docs as (select row_number() over () as rid, doc_id, octet_length(encode(coalesce(text, ''))) as b,
  cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), 't' || md5(coalesce(text, '')))), 1, 15) as bigint) as h from documents),
prefixes as (select rid, b, depth, h >> (60 - depth) as prefix from (select rid, b, h, unnest(range(0, 61)) as depth from docs)),
sizes as (select depth, prefix, sum(b) as s, count(*) as n from prefixes group by 1, 2),
placed as (select rid, min(p.depth) as depth from prefixes p join sizes using (depth, prefix) where s <= {limit} group by 1),
ending as (select coalesce(min(depth), 60) as last from (select depth, max(n) as n from sizes where depth % 10 = 0 and depth > 0 and s > {limit} group by 1) where n = 1),
rest as (select rid, doc_id, b, h >> (60 - last) as cell, last, cast(b > {limit // 2} as int) as big, case when b > {limit // 2} then 0 else b end as little
  from docs, ending where rid not in (select rid from placed)),
runs as (select *, coalesce(sum(big) over w, 0) as bigs, coalesce(sum(little) over w, 0) as littles, max(little) over (partition by cell) as most, sum(big) over (partition by cell) as all_bigs
  from rest window w as (partition by cell order by b, rid rows between unbounded preceding and 1 preceding))
select doc_id, cast(b as bigint) as n_bytes, case when depth = 0 then 'root' else lpad(bin(h >> (60 - depth)), cast(depth as int), '0') end as shard, cast(depth as int) as depth, false as oversize
from docs join placed using (rid)
union all select doc_id, cast(b as bigint), lpad(bin(cell), cast(last as int), '0') || '+' || cast(case when big = 1 then bigs else all_bigs + littles // ({limit} - most + 1) end as bigint), cast(last as int), b > {limit} from runs
"""
