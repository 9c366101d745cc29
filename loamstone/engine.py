"""The engine behind one object: upload, process, search, ask, chat.

Tables live in a :class:`~loamstone.operators.store.Store`; every question set is one plan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import InvalidArgument, NotFound
from .functions.paths import safe_name
from .operators import embedding, evaluation, generation, graph, retrieval
from .operators.postings import PostingIndex
from .operators.store import Store, latest
from .scratch import materialise
from .schema import ELEMENTS, RELATIONSHIPS
from .session import Settings
from .sources.media import Plugins
from .sources.registry import require_supported, source_type
from .streaming.ingest import ingest

QUERIES = "query_id string, text string"
MAX_TOP_K = 50


@dataclass
class Engine:
    spark: SparkSession
    store: Store
    settings: Settings = field(default_factory=Settings)
    provider: embedding.EmbeddingProvider = field(default_factory=embedding.HashingEmbedder)
    rewrite: Callable | None = None
    rerank: Callable | None = None
    plugins: Plugins = field(default_factory=Plugins)

    # ---- documents ----

    def upload(self, files: DataFrame, chat_id: str | None = None) -> list[str]:
        """Registers ``files(path, content)`` as pending, all or none; links them to a chat."""
        if chat_id:
            self.store.chat(chat_id)
        require_supported(files)
        if not files.filter(F.octet_length("content") > self.settings.upload_limit).isEmpty():
            raise InvalidArgument("a file is over the upload limit")
        kept = files.select(F.sha2("path", 256).alias("document_id"), safe_name(F.col("path")).alias("name"), "path", "content")
        self.store.replace_documents("files", kept)
        ids = kept.select("document_id")
        self.store.set_statuses(ids.withColumns({"status": F.lit("pending"), "error": F.lit(None).cast("string")}))
        if chat_id:
            self.store.attach_all(chat_id, ids)
        return [r["document_id"] for r in ids.orderBy("document_id").collect()]  # what the caller gave, as ids

    def process(self) -> dict[str, int]:
        """All pending documents through ingestion and indexing, as one batch; unreadable ones fail by themselves."""
        states = latest(self.store.read("document_states"), "document_id")
        pending = materialise(states.filter("status = 'pending'").select("document_id"), "pending")
        if pending.isEmpty():
            return {}
        files = self.store.read("files").join(pending, "document_id", "left_semi")
        none = F.lit(None).cast("string")
        self.store.set_statuses(pending.withColumns({"status": F.lit("processing"), "error": none}))
        try:
            counts = ingest(self.store, files, self.settings.chunk_size, self.settings.chunk_overlap, self.plugins)
            self.index(pending)
        except Exception as e:
            self.store.set_statuses(pending.withColumns({"status": F.lit("failed"), "error": F.lit(str(e)[:500])}))
            raise
        metadata = F.col("metadata")
        done = self.store.read("documents").join(pending, "document_id", "left_semi")
        self.store.set_statuses(done.select("document_id", metadata["processing_status"].alias("status"), metadata["error"].alias("error")))
        return counts

    @property
    def postings(self) -> PostingIndex:
        """The stored inverted index beside the vectors."""
        return PostingIndex(self.spark, f"{self.store.root}/_postings")

    def index(self, ids: DataFrame | None = None) -> int:
        """Vectors and postings for the chunks of some documents, or of all; returns how many chunks."""
        chunks = self.store.read("chunks")
        own = chunks if ids is None else chunks.join(ids.distinct(), "document_id", "left_semi")
        gone = own.select("document_id") if ids is None else ids
        vectors = materialise(embedding.embed_chunks(own, self.provider).select("chunk_id", "document_id", "embedding"), "vectors")
        size, known = embedding.vector_size(vectors), self.vector_size()
        if size is not None and known is not None and size != known:
            raise InvalidArgument("vectors differ in size from those stored")
        self.store.replace_documents("vectors", vectors, gone)
        self.postings.replace_documents(own, gone)
        return own.count()

    def vector_size(self) -> int | None:
        """The size of stored vectors, from one of them; None without any."""
        row = self.store.read("vectors").select(F.size("embedding").alias("size")).first() if self.store.exists("vectors") else None
        return row["size"] if row else None

    def backfill(self) -> int:
        """Postings for chunks that have none, checked to be complete; returns how many were added."""
        return self.postings.backfill(self.store.read("chunks"))

    def add_golden(self, corpus: DataFrame) -> int:
        """A golden corpus as stored and indexed chunks; returns how many."""
        chunks = materialise(evaluation.golden_chunks(corpus), "golden")
        self.store.replace_documents("chunks", chunks)
        for name, schema in (("elements", ELEMENTS), ("relationships", RELATIONSHIPS)):
            if not self.store.exists(name):
                self.store.write(name, self.spark.createDataFrame([], schema))
        return self.index(chunks.select("document_id"))

    def evaluate(self, golden_queries: DataFrame, k: int = 5) -> DataFrame:
        """Mean metrics of dense, sparse and hybrid retrieval over golden queries."""
        chunks = self.store.read("chunks").join(self.store.read("vectors").select("chunk_id", "embedding"), "chunk_id")
        asked = materialise(embedding.embed_queries(golden_queries.select("query_id", "text"), self.provider), "asked")
        wide = max(k, self.settings.candidate_k)
        return evaluation.compare(
            {
                "dense": lambda q: retrieval.dense(q, chunks, k), "sparse": lambda q: retrieval.sparse(q, chunks, k, index=self.postings),
                "hybrid": lambda q: retrieval.hybrid(q, chunks, k, wide, self.settings.rrf_k, index=self.postings),
            },
            asked, evaluation.golden_qrels(golden_queries), k,
        )

    def health(self) -> dict:
        """Whether Spark and the store answer, and how much is indexed."""
        chunks = self.store.read("chunks").count() if self.store.exists("chunks") else 0
        return {"status": "ok" if self.spark.range(1).count() == 1 else "failed", "chunks": chunks, "indexed": self.postings.figures()[0] if self.postings.exists() else 0}

    def document(self, document_id: str) -> dict:
        """One document with its state and display name."""
        found = self.store.read("files", [document_id]).filter(F.col("document_id") == document_id).select("document_id", "name", source_type(F.col("path")).alias("source_type")).first()
        if found is None:
            raise NotFound(document_id)
        state = latest(self.store.read("document_states"), "document_id").filter(F.col("document_id") == document_id).first()
        return {**found.asDict(), "status": state["status"] if state else "unknown", "error": state["error"] if state else None}

    def retry(self, document_id: str) -> None:
        self.store.retry(document_id)

    def delete(self, document_id: str) -> None:
        self.store.delete_documents([document_id], "vectors", "chunks", "relationships", "elements", "documents")
        self.postings.delete_documents(self.spark.createDataFrame([(document_id,)], "document_id string"))

    # ---- questions ----

    def _asked(self, queries: DataFrame | str, top_k: int) -> DataFrame:
        if isinstance(queries, str):
            queries = self.spark.createDataFrame([("q", queries)], QUERIES)
        if not 1 <= top_k <= MAX_TOP_K:
            raise InvalidArgument(f"top_k must be between 1 and {MAX_TOP_K}")
        if not queries.filter(F.coalesce(F.trim("text"), F.lit("")) == "").isEmpty():
            raise InvalidArgument("a query is blank")
        asked = retrieval.rewritten(queries, self.rewrite) if self.rewrite else queries
        return embedding.embed_queries(asked, self.provider)

    def search(self, queries: DataFrame | str, top_k: int = 5, scope: DataFrame | None = None) -> DataFrame:
        """Hybrid results with graph context: result columns, relationship_context, enriched content."""
        asked = self._asked(queries, top_k)
        chunks = self.store.read("chunks").join(self.store.read("vectors").select("chunk_id", "embedding"), "chunk_id")
        wanted = max(top_k, self.settings.candidate_k) if self.rerank else top_k
        found = retrieval.hybrid(asked, chunks, wanted, max(wanted, self.settings.candidate_k), self.settings.rrf_k, scope, self.postings)
        if self.rerank:
            found = retrieval.rerank(asked, found, top_k, self.rerank)
        result = found.withColumn("result_id", F.concat_ws("/", "query_id", "chunk_id"))
        # element ids in chunk metadata are qualified by their document
        ids = F.from_json(F.get_json_object("metadata", "$.element_ids"), "array<string>")
        seeds = result.join(chunks.select("chunk_id", "metadata"), "chunk_id").select("result_id", "document_id", F.explode(ids).alias("full"))
        seeds = seeds.select("result_id", "document_id", F.expr("substring(full, length(document_id) + 2)").alias("element_id"))
        elements = self.store.read("elements")
        reached = graph.expand(seeds, self.store.read("relationships"), elements, self.settings.max_hops)
        return graph.merged_context(result, reached, elements).drop("result_id")

    def ask(self, queries: DataFrame | str, top_k: int = 5, scope: DataFrame | None = None) -> DataFrame:
        """(query_id, answer, citations) of every query."""
        if isinstance(queries, str):
            queries = self.spark.createDataFrame([("q", queries)], QUERIES)
        return generation.grounded_answers(queries, self.search(queries, top_k, scope))

    def _scope(self, chat_id: str) -> DataFrame:
        self.store.chat(chat_id)
        if not self.store.exists("chat_documents"):
            return self.spark.createDataFrame([], "document_id string")
        return retrieval.chat_scope(self.store.links(), chat_id)

    def chat_search(self, chat_id: str, query: str, top_k: int = 5) -> DataFrame:
        """Search in the chat's documents; a chat without documents finds nothing."""
        return self.search(query, top_k, self._scope(chat_id))

    def chat_ask(self, chat_id: str, query: str, top_k: int = 5) -> str:
        """An answer from the chat's documents; question and answer become messages."""
        scope = self._scope(chat_id)
        self.store.add_message(chat_id, "user", query)
        row = self.ask(query, top_k, scope).select("answer", F.to_json("citations").alias("citations")).first()
        self.store.add_message(chat_id, "assistant", row["answer"], row["citations"])
        return row["answer"]
