"""Queries of sources, cleaning, functions, chunking, chats and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metadata as M
from ..functions import paths as P
from ..functions import text as T
from ..operators import chunking, preprocess, store
from ..schema import ROLES
from ..sources import captions, html, loaded, plain, registry
from . import views

STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.deduplicate(views.elements(spark, sf_dir)).select("document_id", "element_id", "content_kind")


def validate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.elements(spark, sf_dir).select("element_id", F.coalesce(preprocess.invalid_reason(), F.lit("ok")).alias("reason"))


KIND = "case when doc_id % 11 = 0 then 'table' when doc_id % 13 = 0 then 'image' else 'text' end"


def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").select(
        "doc_id", T.content_hash(T.strip(F.coalesce("text", F.lit("")))).alias("hash"),
        T.chunk_id(F.col("source"), F.col("doc_id")).alias("chunk_id"), T.canonical_id(F.col("source"), F.col("doc_id").cast("string")).alias("element"),
    )


def normalized_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents made untidy, then normalised."""
    untidy = F.concat(F.lit(" \r\n"), F.regexp_replace(F.coalesce("text", F.lit("")), r"\. ", " \r\n\r\n\r\n\r\nx "), F.lit("\x07é  "))
    return views.table(spark, sf_dir, "documents").select("doc_id", T.content_hash(T.normalize_text(untidy)).alias("hash"))


NORMAL = r"""with u as (select doc_id, chr(32) || chr(13) || chr(10) || regexp_replace(coalesce(text, ''), '\. ', chr(32) || chr(10) || chr(10) || chr(10) || chr(10) || 'x ', 'g') || 'e' || chr(769) || '  ' as t from documents),
 l as (select doc_id, regexp_replace(regexp_replace(nfc_normalize(replace(t, chr(13) || chr(10), chr(10))), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g') as t from u)
 select doc_id, sha256(regexp_replace(t, '^\s+|\s+$', '', 'g')) as hash from l"""


def chunked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements = preprocess.valid_elements(views.elements(spark, sf_dir))
    edges = preprocess.reconcile(views.chain_edges(spark, sf_dir), elements)
    found = chunking.chunk_documents(elements, edges)
    return found.select("chunk_id", "document_id", "chunk_index", F.length("content").alias("size"))


def chunk_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document's chunks: which elements they hold, whether indices run on, whether sizes and groups are kept."""
    elements = preprocess.valid_elements(views.elements(spark, sf_dir))
    edges = preprocess.reconcile(views.chain_edges(spark, sf_dir), elements)
    found = chunking.chunk_documents(elements, edges)
    ids = F.from_json(M.get_text(F.col("metadata"), "element_ids"), "array<string>")
    own = found.select("document_id", "chunk_index", F.length("content").alias("size"), ids.alias("ids"))
    whole = own.groupBy("document_id").agg(F.max("size").alias("most"), F.max("chunk_index").alias("last"), F.count("*").alias("chunks"))
    held = own.select("document_id", F.explode("ids").alias("full")).distinct()
    held = held.select("document_id", F.expr("cast(substring(full, length(document_id) + 2) as long)").alias("n"))
    listed = held.groupBy("document_id").agg(F.count("*").alias("elements"), F.sha2(F.array_join(F.array_sort(F.collect_list("n")).cast("array<string>"), ",").cast("binary"), 256).alias("elements_sha256"))
    return whole.join(listed, "document_id").select("document_id", "elements", "elements_sha256", (F.col("most") <= 1000).alias("fits"), (F.col("last") + 1 == F.col("chunks")).alias("counted"))


CHUNKED = f"""with el as (select source, doc_id, {STRIP.format("coalesce(text, '')")} as t from documents where doc_id % 11 = 0 or doc_id % 13 <> 0)
 select source as document_id, count(*) as elements, sha256(string_agg(cast(doc_id as varchar), ',' order by doc_id)) as elements_sha256, true as fits, true as counted from el where t <> '' group by 1"""


def split_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces without overlap: together they hold every character of the text but white space, none is too long."""
    docs = views.table(spark, sf_dir, "documents").select("doc_id", chunking.split_column(F.col("text"), 200, 0).alias("pieces"))
    bare = F.regexp_replace(F.array_join("pieces", ""), r"(?U)[\s\x1c-\x1f]+", "")
    return docs.select("doc_id", F.sha2(bare.cast("binary"), 256).alias("text_sha256"), F.forall("pieces", lambda x: F.length(x) <= 200).alias("fits"))


def split_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(chunking.split_column(F.col("text"))).alias("piece", "content")).select("doc_id", "piece", F.length("content").alias("size"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("document_id"), "url", "html")


def html_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements, _ = registry.read_pages(_pages(spark, sf_dir))
    return elements.select("document_id", "ordinal", "element_id", "element_type", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


# a browser reads these names without their semicolon too
PLAIN = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace({}, '&#x27;', chr(39)), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', chr(34), 'g'), '&amp;?', '&', 'g')"
STRINGS = "array_to_string(list_filter(list_transform(string_split_regex({}, '<[^>]*>'), lambda x: trim(" + PLAIN.format("x") + ", chr(32) || chr(9) || chr(10) || chr(13))), lambda x: x <> ''), ' ')"
HTML_ELEMENTS = rf"""with c as (select page_id, regexp_replace(regexp_replace(html, '(?is)<(script|style|noscript|template)\b.*?</(script|style|noscript|template)>', '', 'g'), '(?s)<!--.*?-->', '<!>', 'g') as h from pages),
 p as (select page_id, regexp_extract_all(h, '<li><a href="[^"]+">([^<]*)</a></li>', 1) as li, string_split(regexp_extract(h, '(?s)<article>(.*)</article>', 1), '<p>') as parts from c),
 nav as (select page_id, unnest(li) as x, unnest(range(1, len(li) + 1)) as i from p),
 para as (select page_id, len(li) as n, parts, unnest(range(2, len(parts) + 1)) as k from p),
 said as (select page_id, n, k, case when starts_with(parts[k], '<b>') then {STRINGS.format("array_to_string(parts[k:], '<p>')")} else {STRINGS.format("string_split(parts[k], '</p>')[1]")} end as x from para),
 rows as (select page_id, 0 as ordinal, 'document' as kind, '' as x from pages
  union all select page_id, 2 * i - 1, 'paragraph', {STRINGS.format('x')} from nav union all select page_id, 2 * i, 'link', {STRINGS.format('x')} from nav
  union all select page_id, 2 * len(li) + 1, 'heading', {STRINGS.format("regexp_extract(parts[1], '(?s)<h1>(.*?)</h1>', 1)")} from p
  union all select page_id, 2 * n + k, 'paragraph', x from said)
 select cast(page_id as varchar) as document_id, cast(ordinal as int) as ordinal, case kind when 'document' then 'document' when 'paragraph' then 'text-' || ordinal else kind || '-' || ordinal end as element_id,
  kind as element_type, sha256(x) as text_sha256 from rows"""


def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and first headings of each page, through the whole tree walk."""
    elements, edges = registry.read_pages(_pages(spark, sf_dir))
    per = elements.groupBy("document_id").agg(
        F.count_if(F.col("element_type") == "link").alias("links"), F.count_if(F.col("element_type") == "heading").alias("headings")
    )
    rooted = edges.filter("source_element_id = 'document'").groupBy("document_id").agg(F.count("*").alias("rooted"))
    return per.join(rooted, "document_id", "left").select("document_id", "links", "headings", (F.coalesce("rooted", F.lit(0)) > 0).alias("rooted"))


HTML = r"""with c as (select page_id, regexp_replace(regexp_replace(html, '(?is)<(script|style|noscript|template)\b.*?</(script|style|noscript|template)>', '', 'g'), '(?s)<!--.*?-->', '', 'g') as h from pages)
 select cast(page_id as varchar) as document_id, len(regexp_extract_all(h, '(?i)<a\s+href="[^"]+"')) as links,
 len(list_filter(regexp_extract_all(h, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1), lambda x: trim(x) <> '')) as headings,
 len(regexp_extract_all(h, '(?i)<(a|h[1-6]|p)\b')) > 0 as rooted from c"""


def markdown_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.concat(F.lit("# Title\n\n"), "text").alias("text"), F.lit("a/b.md").alias("path"))
    elements, _ = loaded.tables(loaded.parse(docs, plain.read_markdown, "text", "path"))
    return elements.groupBy("document_id").agg(
        F.count_if(F.col("element_type") == "heading").alias("headings"), F.count_if(F.col("element_type") == "paragraph").alias("paragraphs")
    )


MARKDOWN = r"""with l as (select doc_id, unnest(string_split_regex('# Title' || chr(10) || chr(10) || text, '\r?\n')) as line from documents)
 select cast(doc_id as varchar) as document_id, count(*) filter (regexp_matches(trim(line), '^#{1,6}\s+\S')) as headings,
 count(*) filter (trim(line) <> '' and not regexp_matches(trim(line), '^#{1,6}\s+\S')) as paragraphs from l group by 1"""


def csv_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of each nation as a CSV file, read back: rows with the header, and the widest row."""
    rows = views.table(spark, sf_dir, "customer")
    line = F.concat_ws(",", F.col("c_custkey").cast("string"), "c_name", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")))
    text = F.concat(F.lit("key, name\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", line.alias("l")))), lambda x: x["l"]), "\n"))
    files = rows.groupBy("c_nationkey").agg(text.alias("text")).select(F.col("c_nationkey").cast("string").alias("document_id"), "text")
    elements, _ = loaded.tables(loaded.parse(files, plain.read_csv, "text"))
    table = elements.filter("element_type = 'table'")
    return table.select(
        "document_id", M.get(F.col("metadata"), "row_count").cast("int").alias("row_count"), M.get(F.col("metadata"), "column_count").cast("int").alias("column_count"),
        F.size(F.split("text", "\n")).alias("lines"),
    )


def caption_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as WebVTT files, read back as transcript elements."""
    turns = views.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_replace(F.trim(F.coalesce("text", F.lit(""))), r"\s+", " ").alias("text"))
    stamp = lambda s: F.format_string("%02d:%02d.500", F.floor(s / 60), s % 60)
    cue = F.concat(F.lit("\n"), stamp(F.col("turn") * 5), F.lit(" --> "), stamp(F.col("turn") * 5 + 4), F.lit(" align:start\n"), "text", F.lit("\n"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", cue.alias("c")))), lambda x: x["c"]), "")
    files = turns.groupBy("conv_id").agg(F.concat(F.lit("WEBVTT\n"), body).alias("text")).select(F.col("conv_id").cast("string").alias("document_id"), "text")
    elements, _ = loaded.tables(loaded.parse(files, captions.read_captions, "text"))
    said = elements.filter("element_type = 'transcript'")
    return said.select("document_id", M.get(F.col("metadata"), "start_seconds").cast("double").alias("start_seconds"),
                       M.get(F.col("metadata"), "end_seconds").cast("double").alias("end_seconds"), T.content_hash(F.col("text")).alias("hash"))


CUES = r"""select cast(conv_id as varchar) as document_id, turn * 5 + 0.5 as start_seconds, turn * 5 + 4.5 as end_seconds,
 sha256(regexp_replace(trim(text), '\s+', ' ', 'g')) as hash from conversations where trim(coalesce(text, '')) <> ''"""


def caption_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    stamp = F.when(n % 3 == 0, F.format_string("%02d:%02d.250", n % 60, n % 59)).when(n % 3 == 1, F.format_string("%02d:%02d:%02d,500", n % 5, n % 60, n % 59)).otherwise("soon")
    return views.table(spark, sf_dir, "events").select("event_id", T.caption_seconds(stamp).alias("seconds"))


def key_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user as sampled frames; the value is the difference to the one before."""
    samples = views.table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("document_id"), (F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).alias("timestamp_seconds"), F.col("value").alias("difference")
    )
    return captions.key_frames(samples, 10.0, 2.0).select("document_id", "element_id", F.round("timestamp_seconds", 6).alias("timestamp_seconds"))


FRAMES = """with recursive s as (select cast(user_id as varchar) as d, floor(epoch(ts)) / 3600 as t, value as v from events),
 k as (select d, min(t) as t, 1 as n from s group by 1
  union all select k.d, min(s.t), any_value(k.n) + 1 from k join s on s.d = k.d and s.v >= 10 and s.t - k.t >= 2 group by k.d)
 select d as document_id, 'frame-' || n as element_id, round(t, 6) as timestamp_seconds from k"""


def extension_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.element_at(F.array(*map(F.lit, ("a.PDF", "b.md", "c.HTM", "d.xlsx", "e.gif", "f", "g.tar.csv", "h.JPEG"))), (F.col("page_id") % 8 + 1).cast("int"))
    return views.table(spark, sf_dir, "pages").select("page_id", F.coalesce(registry.source_type(names), F.lit("unsupported")).alias("source_type"))


ROUTES = """with n as (select page_id, ['a.PDF', 'b.md', 'c.HTM', 'd.xlsx', 'e.gif', 'f', 'g.tar.csv', 'h.JPEG'][cast(page_id % 8 + 1 as int)] as name from pages),
 s as (select page_id, lower(regexp_extract(name, '(\\.[^.]+)$', 1)) as x from n)
 select page_id, case when x = '.pdf' then 'pdf' when x in ('.md', '.markdown') then 'markdown' when x in ('.html', '.htm') then 'html' when x in ('.xlsx', '.xlsm') then 'excel'
  when x = '.csv' then 'csv' when x in ('.jpg', '.jpeg', '.png', '.webp', '.bmp', '.tiff', '.tif') then 'image' else 'unsupported' end as source_type from s"""


def url_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("https://www.youtube.com/watch?v=id"), F.col("page_id").cast("string"), F.lit("&t=1"))).when(
        F.col("page_id") % 4 == 1, F.concat(F.lit("https://youtu.be/id"), F.col("page_id").cast("string"))
    ).when(F.col("page_id") % 4 == 2, F.concat(F.lit("https://m.youtube.com/watch?v=id"), F.col("page_id").cast("string"))).otherwise(F.col("url"))
    return views.table(spark, sf_dir, "pages").select("page_id", P.is_http(url).alias("http"), P.youtube_id(url).alias("video"))


def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "pages").select("page_id", P.safe_name(F.concat(F.lit("../.."), F.col("url"), F.lit("..")) ).alias("name"))


def sidecar_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda suffix: F.concat(F.lit("v/"), F.col("p_partkey").cast("string"), F.lit(suffix))
    parts = views.table(spark, sf_dir, "part")
    videos = parts.select(name(".mp4").alias("path"))
    files = parts.filter("p_partkey % 2 = 0").select(name(".vtt").alias("path")).union(parts.filter("p_partkey % 3 = 0").select(name(".srt").alias("path")))
    return captions.sidecars(videos, files)


def caption_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.when(F.col("p_partkey") % 3 == 0, "Fig. ").when(F.col("p_partkey") % 3 == 1, "as in FIGURE ").otherwise("table "), F.col("p_size").cast("string"), F.lit(".2 and Table 7"))
    return views.table(spark, sf_dir, "part").select("p_partkey", T.figure_number(text).alias("figure"), T.table_number(text).alias("table_no"))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as rows of the message log, one second apart."""
    rows = views.table(spark, sf_dir, "conversations")
    return rows.select(
        F.col("conv_id").cast("string").alias("chat_id"), F.lower("role").alias("role"), F.timestamp_seconds(F.col("turn")).alias("at"),
        F.concat_ws("/", F.lpad(F.col("turn").cast("string"), 9, "0"), "role").alias("message_id"), "turn",
    )


def chat_messages_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of each conversation in order, with user and assistant roles only, numbered."""
    found = store.ordered(_messages(spark, sf_dir).filter(F.col("role").isin(*ROLES)), "chat_id", "at", "message_id")
    return found.select(F.col("chat_id").cast("long").alias("conv_id"), "turn", "role", "place")


def chat_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chat's last message: state is the latest event."""
    rows = _messages(spark, sf_dir).withColumn("event_no", F.col("message_id"))
    last = store.latest(rows, "chat_id").select("chat_id", F.col("turn").alias("last_turn"), F.col("role").alias("last_role"))
    return last.join(rows.groupBy("chat_id").agg(F.count("*").alias("messages")), "chat_id").select(F.col("chat_id").cast("long").alias("conv_id"), "last_turn", "last_role", "messages")


def chat_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents attached to each conversation (conv_id divides doc_id), in the order they were attached."""
    chats = views.table(spark, sf_dir, "conversations").select("conv_id").distinct()
    docs = views.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "doc_id", "source")
    links = docs.join(chats, docs["doc_id"] % 100 == chats["conv_id"]).select(
        F.col("conv_id").cast("string").alias("chat_id"), "document_id", F.timestamp_seconds(F.col("doc_id")).alias("at")
    )
    found = store.attached(docs, links)
    return found.select(F.col("chat_id").cast("long").alias("conv_id"), "doc_id", "source", "place")


def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user as the current state of an append-only log."""
    events = views.table(spark, sf_dir, "events").select(F.col("user_id"), F.col("ts").alias("at"), F.col("event_id").alias("event_no"), F.col("event_type").alias("status"))
    return store.latest(events, "user_id").select("user_id", "event_no", "status")


def metadata_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored metadata under new metadata: new keys win, old ones stay."""
    docs = views.table(spark, sf_dir, "documents")
    old = docs.filter("doc_id % 3 <> 0").select(F.col("doc_id").cast("string").alias("document_id"), F.create_map(F.lit("lang"), "lang", F.lit("old"), F.lit("1")).alias("metadata"))
    new = docs.filter("doc_id % 2 = 0").select(F.col("doc_id").cast("string").alias("document_id"), F.create_map(F.lit("lang"), F.lit("new"), F.lit("source"), "source").alias("metadata"))
    m = F.col("metadata")
    return store.merged_metadata(old, new).select("document_id", m["lang"].alias("lang"), m["old"].alias("old"), m["source"].alias("source"))


MERGE = """select cast(doc_id as varchar) as document_id, case when doc_id % 2 = 0 then 'new' else lang end as lang, case when doc_id % 3 <> 0 then '1' end as old,
 case when doc_id % 2 = 0 then source end as source from documents where doc_id % 2 = 0 or doc_id % 3 <> 0"""


def metadata_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each user and hour the keys on whose value all events agree."""
    rows = views.table(spark, sf_dir, "events").select(
        "user_id", F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("string").alias("hour"),
        F.explode(F.create_map(F.lit("type"), "event_type", F.lit("k"), M.get(F.col("props"), "k"))).alias("key", "value"),
    )
    return chunking.agreed(rows, "user_id", "hour")


PROMOTION = """with r as (select user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as hour, 'type' as key, event_type as value from events
 union all select user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S'), 'k', json_extract_string(props, '$.k') from events)
 select user_id, hour, key, min(value) as value from r where value is not null group by 1, 2, 3 having min(value) = max(value)"""


def normalized_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id").cast("string")
    values = F.create_map(
        F.lit("page_number"), F.concat(F.lit(" "), n), F.lit("slide_number"), F.lit("x1"), F.lit("start_seconds"), n,
        F.lit("content_type"), F.concat(F.lit("  "), "event_type", F.lit(" ")), F.lit("other"), F.lit(" kept "),
    )
    m = F.col("m")
    return views.table(spark, sf_dir, "events").select("event_id", M.normalized(values).alias("m")).select(
        "event_id", m["page_number"].alias("page_number"), m["slide_number"].alias("slide_number"), m["start_seconds"].alias("start_seconds"),
        m["content_type"].alias("content_type"), m["other"].alias("other"),
    )


def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File name, else title, else id; empty text falls through."""
    k = F.col("p_partkey")
    return views.table(spark, sf_dir, "part").select(
        "p_partkey", M.first_filled(F.when(k % 3 == 0, F.col("p_name")).when(k % 3 == 1, ""), F.when(k % 2 == 0, F.col("p_brand")), k.cast("string")).alias("name")
    )


def constraint_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal (source, text) pairs as UNIQUE violations, lines without an order as foreign-key violations."""
    docs = views.table(spark, sf_dir, "documents").withColumn("hash", T.content_hash(F.coalesce("text", F.lit(""))))
    twice = store.duplicates(docs, "source", "hash").agg(F.count("*").alias("n")).select(F.lit("unique").alias("rule"), "n")
    lines = views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    orders = views.table(spark, sf_dir, "orders").filter("o_orderkey % 10 <> 0").select("o_orderkey")
    lost = lines.join(orders, "o_orderkey", "left_anti").agg(F.count("*").alias("n")).select(F.lit("foreign_key").alias("rule"), "n")
    return twice.union(lost)


def preprocess_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements and edges that the whole chain leaves, by document."""
    elements, edges = preprocess.preprocess(views.elements(spark, sf_dir), views.edges(spark, sf_dir))
    left = elements.groupBy("document_id").agg(F.count("*").alias("elements"))
    right = edges.groupBy("document_id").agg(F.count("*").alias("edges"))
    return left.join(right, "document_id", "left").select("document_id", "elements", F.coalesce("edges", F.lit(0)).alias("edges"))


ONE = STRIP.format("coalesce(text, '')")
PREPROCESSED = f"""with el as (select doc_id, source, {KIND} as kind, sha256({ONE}) as h, {ONE} as t from documents),
 ok as (select * from el where case when kind = 'image' then doc_id % 26 <> 0 else t <> '' end),
 keep as (select * from ok qualify kind <> 'text' or row_number() over (partition by source, kind, h order by doc_id) = 1),
 ed as (select source, doc_id as s, cast(case when doc_id % 17 = 0 then doc_id + 1000000000 else floor(doc_id / 2) end as bigint) as t from documents)
 select k.source as document_id, count(*) as elements, (select count(*) from ed where ed.source = k.source and s in (select doc_id from keep where source = ed.source) and t in (select doc_id from keep where source = ed.source)) as edges
 from keep k group by 1"""

QUERIES = {
    "exact_dedup": (exact_dedup, f"select source as document_id, cast(doc_id as varchar) as element_id, {KIND} as content_kind from documents qualify {KIND} <> 'text' or row_number() over (partition by source, {KIND}, sha256({ONE}) order by doc_id) = 1"),
    "validate_reasons": (validate_reasons, f"""select cast(doc_id as varchar) as element_id, case when {KIND} = 'image' then case when doc_id % 26 = 0 then 'missing_image_path' else 'ok' end
        when {ONE} = '' then case when {KIND} = 'table' then 'empty_table' else 'empty_text' end else 'ok' end as reason from documents"""),
    "content_hashes": (content_hashes, f"select doc_id, sha256({ONE}) as hash, sha256(source || ':' || doc_id) as chunk_id, source || ':' || doc_id as element from documents"),
    "normalized_texts": (normalized_texts, NORMAL),
    "preprocess_chain": (preprocess_chain, PREPROCESSED),
    "chunked_documents": (chunked_documents, None),
    "chunk_properties": (chunk_properties, CHUNKED),
    "split_coverage": (split_coverage, r"select doc_id, sha256(regexp_replace(coalesce(text, ''), '\s+', '', 'g')) as text_sha256, true as fits from documents"),
    "split_pieces": (split_pieces, None),
    "html_elements": (html_elements, HTML_ELEMENTS),
    "html_links": (html_links, HTML),
    "markdown_elements": (markdown_elements, MARKDOWN),
    "csv_tables": (csv_tables, "select cast(c_nationkey as varchar) as document_id, cast(count(*) + 1 as int) as row_count, cast(max(case when c_custkey % 2 = 0 then 3 else 2 end) as int) as column_count, cast(count(*) + 1 as int) as lines from customer group by 1"),
    "caption_cues": (caption_cues, CUES),
    "caption_seconds": (caption_seconds, "select event_id, case event_id % 3 when 0 then (event_id % 60) * 60 + event_id % 59 + 0.25 when 1 then (event_id % 5) * 3600 + (event_id % 60) * 60 + event_id % 59 + 0.5 end as seconds from events"),
    "key_frames": (key_frames, FRAMES),
    "extension_routing": (extension_routing, ROUTES),
    "url_checks": (url_checks, "select page_id, page_id % 4 <> 3 or regexp_matches(url, '^https?://') as http, case when page_id % 4 < 2 then 'id' || page_id end as video from pages"),
    "safe_names": (safe_names, r"select page_id, regexp_replace(regexp_replace(regexp_replace('../..' || url || '..', '^.*[/\\]', ''), '[^A-Za-z0-9._-]', '_', 'g'), '^\.+|\.+$', '', 'g') as name from pages"),
    "sidecar_lookup": (sidecar_lookup, "select 'v/' || p_partkey || '.mp4' as path, case when p_partkey % 3 = 0 then 'v/' || p_partkey || '.srt' when p_partkey % 2 = 0 then 'v/' || p_partkey || '.vtt' end as caption_path from part"),
    "caption_numbers": (caption_numbers, "select p_partkey, case when p_partkey % 3 < 2 then p_size || '.2' end as figure, case when p_partkey % 3 = 2 then p_size || '.2' else '7' end as table_no from part"),
    "chat_messages_ordered": (chat_messages_ordered, "select conv_id, turn, lower(role) as role, row_number() over (partition by conv_id order by turn, role) as place from conversations where lower(role) in ('user', 'assistant')"),
    "chat_latest": (chat_latest, "select conv_id, max(turn) as last_turn, lower(arg_max(role, turn)) as last_role, count(*) as messages from conversations group by 1"),
    "chat_documents": (chat_documents, "select conv_id, doc_id, source, row_number() over (partition by conv_id order by doc_id) as place from (select distinct conv_id from conversations) join documents on doc_id % 100 = conv_id"),
    "run_states": (run_states, "select user_id, event_id as event_no, event_type as status from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1"),
    "metadata_merge": (metadata_merge, MERGE),
    "metadata_promotion": (metadata_promotion, PROMOTION),
    "normalized_metadata": (normalized_metadata, "select event_id, cast(event_id as varchar) as page_number, 'x1' as slide_number, event_id || '.0' as start_seconds, event_type as content_type, ' kept ' as other from events"),
    "display_names": (display_names, "select p_partkey, case when p_partkey % 3 = 0 then p_name when p_partkey % 2 = 0 then p_brand else cast(p_partkey as varchar) end as name from part"),
    "constraint_checks": (constraint_checks, "select 'unique' as rule, count(*) as n from (select 1 from documents group by source, coalesce(text, '') having count(*) > 1) union all select 'foreign_key', count(*) from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderkey % 10 <> 0)"),
}
