"""Grounded answers and the validation of their citations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Fixed value: what is answered without any result.
NO_ANSWER = "I could not find relevant information in the available documents."


def grounded_answers(queries: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, answer, citations): numbered contents, one citation for each result; a fixed sentence without any."""
    item = F.struct("rank", "content", "chunk_id", "document_id")
    gathered = results.groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("items"))  # top_k items at most
    joined = queries.select(F.col("query_id").cast("string").alias("query_id")).join(gathered, "query_id", "left")
    cited = F.transform("items", lambda x, i: F.struct((i + 1).alias("citation_id"), x["chunk_id"].alias("chunk_id"), x["document_id"].alias("document_id")))
    return joined.select(
        "query_id", F.coalesce(T.formatted_context(F.col("items.content")), F.lit(NO_ANSWER)).alias("answer"),
        F.coalesce(cited, F.array().cast("array<struct<citation_id:int,chunk_id:string,document_id:string>>")).alias("citations"),
    )


def validate_citations(answers: DataFrame, results: DataFrame) -> DataFrame:
    """(answer_id, valid, validated, invalid, coverage) from ``answers(answer_id, citations)`` and ranked results.

    A citation is invalid if its id came before, is no rank, or names another chunk or
    document than that rank; an answer over results without citations is invalid.
    """
    placed = answers.select("answer_id", F.posexplode("citations").alias("pos", "c")).select("answer_id", "pos", "c.*")
    seen = Window.partitionBy("answer_id", "citation_id").orderBy("pos")
    numbered = placed.withColumn("again", F.row_number().over(seen) > 1)
    known = results.select(F.col("query_id").alias("answer_id"), F.col("rank").alias("citation_id"), F.col("chunk_id").alias("r_chunk"), F.col("document_id").alias("r_document"))
    judged = numbered.join(known, ["answer_id", "citation_id"], "left").withColumn(
        "good", ~F.col("again") & F.coalesce((F.col("chunk_id") == F.col("r_chunk")) & (F.col("document_id") == F.col("r_document")), F.lit(False))
    )
    at = F.struct("pos", "citation_id")
    per = judged.groupBy("answer_id").agg(
        F.transform(F.sort_array(F.collect_list(F.when(F.col("good"), at))), lambda x: x["citation_id"]).alias("validated"),
        F.transform(F.sort_array(F.collect_list(F.when(~F.col("good"), at))), lambda x: x["citation_id"]).alias("invalid"),
    )
    count = results.groupBy(F.col("query_id").alias("answer_id")).agg(F.count("*").alias("n"))
    none = F.array().cast("array<int>")
    joined = answers.select("answer_id").join(per, "answer_id", "left").join(count, "answer_id", "left")
    good, bad, n = F.coalesce("validated", none), F.coalesce("invalid", none), F.coalesce("n", F.lit(0))
    total = F.size(good) + F.size(bad)
    return joined.select(
        "answer_id", F.when(n == 0, total == 0).otherwise((total > 0) & (F.size(bad) == 0)).alias("valid"),
        good.alias("validated"), bad.alias("invalid"), F.when(total > 0, F.size(good) / total).otherwise(F.lit(0.0)).alias("coverage"),
    )


#: What a model is asked to answer with.
MODEL_ANSWER = "answer string, citation_ids array<int>"


def model_answers(queries: DataFrame, results: DataFrame, model: Callable[[Column, Column], Column]) -> DataFrame:
    """(query_id, answer, citations) from a model over (query, numbered context) that returns MODEL_ANSWER as JSON.

    Ids are taken once each, in their order; none means the first result; an id that is no
    rank is an error, and so is an answer that cannot be read.
    """
    item = F.struct("rank", "content", "chunk_id", "document_id")
    gathered = results.groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("items"))  # top_k items at most
    joined = queries.select(F.col("query_id").cast("string").alias("query_id"), "text").join(gathered, "query_id", "left")
    context = T.formatted_context(F.col("items.content"))
    said = F.when(F.col("items").isNotNull(), F.from_json(model(F.col("text"), context), MODEL_ANSWER))
    ids = F.array_distinct(F.col("said.citation_ids"))
    read = joined.withColumn("said", said).withColumn(
        "ids", F.when(F.coalesce(F.size(ids), F.lit(0)) > 0, ids).otherwise(F.array(F.lit(1)))
    )
    clear = F.assert_true(F.col("items").isNull() | F.col("said.answer").isNotNull(), F.lit("the model's answer cannot be read"))
    inside = F.assert_true(
        F.col("items").isNull() | F.forall("ids", lambda i: (i >= 1) & (i <= F.size("items"))), F.lit("a citation is out of range")
    )
    cited = F.transform("ids", lambda i: F.struct(i.alias("citation_id"), F.get("items", i - 1)["chunk_id"].alias("chunk_id"), F.get("items", i - 1)["document_id"].alias("document_id")))
    none = F.array().cast("array<struct<citation_id:int,chunk_id:string,document_id:string>>")
    return read.filter(clear.isNull() & inside.isNull()).select(
        "query_id", F.when(F.col("items").isNull(), NO_ANSWER).otherwise(F.col("said.answer")).alias("answer"),
        F.when(F.col("items").isNull(), none).otherwise(cited).alias("citations"),
    )
