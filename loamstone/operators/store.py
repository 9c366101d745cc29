"""Persistent tables: documents, elements, edges, chunks, runs, chats; replaced by document.

Two kinds of tables.  Tables of documents lie in hash buckets of document_id; a change
writes the buckets it touches as new folders and leaves the others alone.  Logs (runs, states,
chats, messages) are appended to, one file for each call, and a state is its latest event.

What readers see of document tables is named by the newest commit: one small file that maps
every table to the folders of its buckets.  A change of several tables is one commit, so all
of it is seen or none; a write that fails leaves folders that nothing names.  Constraints
that a database would hold are explicit checks.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import DanglingEdge, DuplicateDocument, InvalidArgument, NotFound, NotRetryable
from ..functions.paths import is_uuid
from ..scratch import materialise, save


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that more than one row has."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def dangling(relationships: DataFrame, elements: DataFrame) -> DataFrame:
    """Edges with an end that is no element of their document."""
    ids = elements.select("document_id", "element_id")
    out = None
    for side in ("source_element_id", "target_element_id"):
        lost = relationships.join(ids.withColumnRenamed("element_id", side), ["document_id", side], "left_anti").select(*relationships.columns)
        out = lost if out is None else out.unionByName(lost)
    return out.distinct()


def latest(events: DataFrame, key: str, order: str = "at") -> DataFrame:
    """The last event of each key: states are appended, never updated."""
    last = Window.partitionBy(key).orderBy(F.desc(order), F.desc("event_no"))
    return events.withColumn("place", F.row_number().over(last)).filter("place = 1").drop("place")


def merged_metadata(old: DataFrame, new: DataFrame) -> DataFrame:
    """(document_id, metadata MAP): a shallow merge in which new keys win."""
    joined = old.select("document_id", F.col("metadata").alias("o")).join(new.select("document_id", F.col("metadata").alias("n")), "document_id", "full")
    empty = F.create_map().cast("map<string,string>")
    kept = F.map_filter(F.coalesce("o", empty), lambda k, v: ~F.map_contains_key(F.coalesce(F.col("n"), empty), k))
    return joined.select("document_id", F.map_concat(kept, F.coalesce("n", empty)).alias("metadata"))


def ordered(rows: DataFrame, key: str, *by: str) -> DataFrame:
    """Rows with their place, from 1 on, in the order of each key."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*by)))


def attached(documents: DataFrame, links: DataFrame) -> DataFrame:
    """``documents`` joined with ``links(chat_id, document_id, at)``, numbered in the order they were attached to each chat."""
    first = links.groupBy("chat_id", "document_id").agg(F.min("at").alias("attached_at"))
    return ordered(documents.join(first, "document_id"), "chat_id", "attached_at", "document_id")


@dataclass
class Store:
    """Tables under one root."""

    spark: SparkSession
    root: str
    buckets: int = 16

    # ---- files ----

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _commits(self) -> list[str]:
        files, path = self._path("_commits")
        return sorted(f.getPath().getName() for f in files.listStatus(path)) if files.exists(path) else []

    def _state(self) -> dict:
        """What the newest commit names: schema and bucket folders of each table."""
        names = self._commits()
        if not names:
            return {}
        return json.loads("\n".join(r["value"] for r in self.spark.read.option("wholetext", "true").text(f"{self.root}/_commits/{names[-1]}").collect()))

    def _commit(self, changes: dict) -> None:
        """All changed tables at once: a file of the next number, which cannot be there already."""
        names = self._commits()
        state = self._state() | changes
        files, path = self._path(f"_commits/{int(names[-1]) + 1 if names else 0:012d}")
        out = files.create(path, False)  # two writers at once: the second one fails here
        out.write(bytearray(json.dumps(state).encode()))
        out.close()

    def _log(self, name: str) -> str:
        return f"{self.root}/_logs/{name}"

    # ---- tables ----

    def exists(self, name: str) -> bool:
        files, path = self._path(f"_logs/{name}")
        return name in self._state() or files.exists(path)

    def read(self, name: str, ids: list[str] | None = None) -> DataFrame:
        """A table, or only the buckets of some documents."""
        state = self._state()
        if name not in state:
            files, path = self._path(f"_logs/{name}")
            if files.exists(path):
                return self.spark.read.option("mergeSchema", "true").parquet(self._log(name))
            raise NotFound(name)
        schema, folders = StructType.fromJson(state[name]["schema"]), state[name]["folders"]
        if ids is not None:
            frame = self.spark.createDataFrame([(i,) for i in ids], "document_id string")
            wanted = {str(r["bucket"]) for r in frame.select(self._bucket().alias("bucket")).distinct().collect()}
            folders = {k: v for k, v in folders.items() if k in wanted}
        paths = [f"{self.root}/{v}" for v in folders.values()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("document_id"), F.lit(self.buckets)).cast("int")

    def _written(self, name: str, df: DataFrame, buckets: list[int]) -> dict:
        """Writes rows of these buckets and returns what the table's entry becomes."""
        version = uuid.uuid4().hex
        base = f"{name}/{version}"
        rows = df.withColumn("ls_bucket", self._bucket())
        save(rows.repartition("ls_bucket", F.pmod(F.xxhash64(*[c for c in df.columns if c.endswith("_id")]), F.lit(8))), f"{self.root}/{base}", "zstd", "ls_bucket")
        files, _ = self._path(base)
        old = self._state().get(name, {"folders": {}})["folders"]
        folders = {k: v for k, v in old.items() if int(k) not in buckets}
        for b in buckets:
            folder = f"{base}/ls_bucket={b}"
            if files.exists(self._path(folder)[1]):  # a bucket that has no rows left has no folder
                folders[str(b)] = folder
        return {name: {"schema": df.schema.jsonValue(), "folders": folders}}

    def _replaced(self, name: str, df: DataFrame, ids: DataFrame) -> dict:
        """The buckets of ``ids``, with the rows of these documents replaced by ``df``."""
        touched = [r["bucket"] for r in ids.select(self._bucket().alias("bucket")).distinct().collect()]
        state = self._state()
        if name in state:
            folders = state[name]["folders"]
            paths = [f"{self.root}/{folders[str(b)]}" for b in touched if str(b) in folders]
            if paths:
                old = self.spark.read.schema(StructType.fromJson(state[name]["schema"])).parquet(*paths)
                df = old.join(ids.select("document_id").distinct(), "document_id", "left_anti").unionByName(df, allowMissingColumns=True)
        return self._written(name, df, touched)

    def write(self, name: str, df: DataFrame) -> None:
        """The whole table anew."""
        change = self._written(name, df, list(range(self.buckets)))
        self._commit(change)

    def append(self, name: str, df: DataFrame) -> None:
        """Adds rows to a log; what is there is neither read nor written."""
        df.write.mode("append").parquet(self._log(name))

    def replace_documents(self, name: str, df: DataFrame, ids: DataFrame | None = None) -> None:
        """Rows of the given documents (by default those in ``df``) are replaced by those of ``df``."""
        self.replace_tables({name: df}, df if ids is None else ids)

    def replace_tables(self, tables: dict[str, DataFrame], ids: DataFrame) -> None:
        """Rows of the given documents are replaced in several tables, by one commit."""
        gone = materialise(ids.select("document_id").distinct(), "replaced")
        changes: dict = {}
        for name, df in tables.items():
            changes |= self._replaced(name, df, gone)
        self._commit(changes)

    def delete_document(self, name: str, document_id: str) -> None:
        self.delete_documents([document_id], name)

    def delete_documents(self, ids: list[str], *names: str) -> None:
        """Documents leave several tables, by one commit."""
        if not all(i.strip() for i in ids):
            raise InvalidArgument("document_id is blank")
        gone = self.spark.createDataFrame([(i,) for i in ids], "document_id string")
        state = self._state()
        changes: dict = {}
        for name in names:
            if name in state:
                changes |= self._replaced(name, self.spark.createDataFrame([], StructType.fromJson(state[name]["schema"])), gone)
        if changes:
            self._commit(changes)

    def persist(self, documents: DataFrame, elements: DataFrame, relationships: DataFrame, allow_existing: bool = False, **more: DataFrame) -> None:
        """Checks, then documents, elements, edges and further tables by one commit; equal edges collapse."""
        if not duplicates(elements, "document_id", "element_id").isEmpty():
            raise InvalidArgument("an element id occurs twice in a document")
        if not dangling(relationships, elements).isEmpty():
            raise DanglingEdge("an edge names an element that does not exist")
        if self.exists("documents"):
            old = self.read("documents").join(documents.select("document_id"), "document_id", "left_semi")
            if not allow_existing and not old.isEmpty():
                raise DuplicateDocument("these documents are stored already")
            documents = documents.drop("metadata").join(merged_metadata(old, documents), "document_id").select(*documents.columns)
        once = relationships.dropDuplicates(["document_id", "source_element_id", "relationship_type", "target_element_id"])
        self.replace_tables({"elements": elements, "relationships": once, **more, "documents": documents}, documents)

    def record(self, name: str, key: str, key_value: str, **fields: str | None) -> None:
        """Appends an event to a log."""
        row = self.spark.range(1).select(F.lit(key_value).alias(key), *[F.lit(v).cast("string").alias(k) for k, v in fields.items()])
        self.record_all(name, row)

    def record_all(self, name: str, rows: DataFrame) -> None:
        """Appends events: one write, however many.  Events of one call share their time; a later call's number is higher."""
        self.append(name, rows.withColumns({"event_no": F.lit(time.time_ns()), "at": F.current_timestamp()}))

    def start_run(self, document_id: str | None = None) -> str:
        run = str(uuid.uuid4())
        self.record("runs", "run_id", run, document_id=document_id, status="running", error_message=None, stats=None)
        return run

    def finish_run(self, run_id: str, document_id: str | None, stats: str) -> None:
        self.record("runs", "run_id", run_id, document_id=document_id, status="completed", error_message=None, stats=stats)

    def fail_run(self, run_id: str, message: str) -> None:
        self.record("runs", "run_id", run_id, document_id=None, status="failed", error_message=message, stats=None)

    def set_status(self, document_id: str, status: str, error: str | None = None) -> None:
        self.record("document_states", "document_id", document_id, status=status, error=error if status == "failed" else None)

    def set_statuses(self, states: DataFrame) -> None:
        """The same for many: ``states(document_id, status, error)``."""
        kept = F.when(F.col("status") == "failed", F.col("error")).cast("string")
        self.record_all("document_states", states.select("document_id", "status", kept.alias("error")))

    def retry(self, document_id: str) -> None:
        """Back to pending, from failed or pending only."""
        state = latest(self.read("document_states"), "document_id").filter(F.col("document_id") == document_id).first() if self.exists("document_states") else None
        if state is None:
            raise NotFound(document_id)
        if state["status"] not in ("failed", "pending"):
            raise NotRetryable(state["status"])
        self.set_status(document_id, "pending")

    def upsert_chunks(self, chunks: DataFrame) -> None:
        """Latest wins by chunk_id; vectors must be present, filled and of one size."""
        if "embedding" in chunks.columns:
            sizes = chunks.agg(F.min(F.coalesce(F.size("embedding"), F.lit(0))).alias("low"), F.max(F.size("embedding")).alias("high")).first()
            if sizes["low"] is not None and (sizes["low"] <= 0 or sizes["low"] != sizes["high"]):
                raise InvalidArgument("vectors are empty or of several sizes")
            if self.exists("chunks"):
                known = self.read("chunks").select(F.size("embedding").alias("s")).first()
                if known and sizes["high"] is not None and known["s"] != sizes["high"]:
                    raise InvalidArgument("vectors differ in size from those stored")
        ids = chunks.select("document_id").distinct()
        if self.exists("chunks"):
            old = self.read("chunks").join(ids, "document_id", "left_semi").join(chunks.select("chunk_id"), "chunk_id", "left_anti")
            chunks = old.unionByName(chunks, allowMissingColumns=True)
        self.replace_documents("chunks", chunks, ids)

    def create_chat(self, title: str) -> str:
        chat = str(uuid.uuid4())
        self.record("chats", "chat_id", chat, title=title.strip())
        return chat

    def chat(self, chat_id: str):
        """One chat; a malformed or unknown id is not found."""
        asked = self.spark.range(1).select(is_uuid(F.lit(chat_id)).alias("ok")).first()["ok"]
        row = latest(self.read("chats"), "chat_id").filter(F.col("chat_id") == chat_id).first() if asked and self.exists("chats") else None
        if row is None:
            raise NotFound(chat_id)
        return row

    def attach(self, chat_id: str, document_id: str) -> None:
        self.attach_all(chat_id, self.spark.range(1).select(F.lit(document_id).alias("document_id")))

    def attach_all(self, chat_id: str, documents: DataFrame) -> None:
        """Attaches documents to a chat: those that are not attached already."""
        self.chat(chat_id)
        links = documents.select(F.lit(chat_id).alias("chat_id"), "document_id").distinct()
        if self.exists("chat_documents"):
            links = links.join(self.links(), ["chat_id", "document_id"], "left_anti")
        self.record_all("chat_documents", links.withColumn("attached", F.lit(True)))

    def detach(self, chat_id: str, document_id: str) -> None:
        if self.exists("chat_documents"):
            row = self.spark.range(1).select(F.lit(chat_id).alias("chat_id"), F.lit(document_id).alias("document_id"), F.lit(False).alias("attached"))
            self.record_all("chat_documents", row)

    def links(self) -> DataFrame:
        """(chat_id, document_id, at) of documents that are attached now."""
        if not self.exists("chat_documents"):
            return self.spark.createDataFrame([], "chat_id string, document_id string, at timestamp")
        pair = Window.partitionBy("chat_id", "document_id").orderBy(F.desc("event_no"))
        last = self.read("chat_documents").withColumn("place", F.row_number().over(pair)).filter("place = 1 and attached")
        return last.select("chat_id", "document_id", "at")

    def add_message(self, chat_id: str, role: str, content: str, citations: str | None = None) -> str:
        role, content = role.strip().lower(), content.strip()
        if role not in ("user", "assistant"):
            raise InvalidArgument(f"unknown role {role}")
        if not content:
            raise InvalidArgument("a message needs content")
        chat = self.chat(chat_id)
        message = str(uuid.uuid4())
        self.record("chat_messages", "message_id", message, chat_id=chat_id, role=role, content=content, citations=citations)
        self.record("chats", "chat_id", chat_id, title=chat["title"])  # the last event is the time of the last update
        return message

    def chats(self) -> DataFrame:
        """Most recently updated first."""
        return latest(self.read("chats"), "chat_id").orderBy(F.desc("at"), "chat_id")

    def messages(self, chat_id: str) -> DataFrame:
        return ordered(self.read("chat_messages").filter(F.col("chat_id") == chat_id), "chat_id", "event_no", "message_id").drop("place").orderBy("event_no", "message_id")

    def chat_documents(self, chat_id: str) -> DataFrame:
        """The chat's documents in the order they were attached."""
        return attached(self.read("documents"), self.links().filter(F.col("chat_id") == chat_id)).orderBy("place").drop("place", "chat_id")
