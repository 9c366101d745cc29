"""Shared plumbing: clean inputs, the shared scratch folder, Arrow batch loops."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import clean_scratch, materialise, save, scratch

__all__ = [
    "chunks", "clean_scratch", "dealt", "fits", "hot_keys", "in_each_part", "input_bytes", "lookup", "map_arrow", "mark", "materialise", "save", "scratch",
    "small", "table", "tame_malloc", "texts",
]

#: Text bytes that a Python worker looks at together.
CHUNK_BYTES = 4 << 20
#: Arrays from this size on do not stay in a worker's heap; mapping smaller ones costs more than it saves.
MAPPED_BYTES = 4 << 20

#: Rows that may be broadcast: about 32 MB of terms or ids.
BROADCAST_ROWS = 500_000
#: Tasks that share the rows of one key where the other side is too large to be broadcast.
PARTS = 32

#: Word characters of the token contract are ASCII digits, ASCII letters and
#: every code point above 0x7F; this table lower-cases A-Z and blanks the rest.
WORD_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256)
)

#: Separators of the token contract as a Java regular expression class body.
NON_WORD = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Reads one table of a data folder through Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only (doc_id long, text string); a null text counts as empty.

    Whatever else the input holds, under whatever names, is left out here, so
    that no operator can stumble over a clashing column.
    """
    return docs.select(
        docs[key].cast("long").alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text")
    )


def mark(text: Column) -> Column:
    """What tells rows of one doc_id apart: a 64-bit hash of the text, a null text counting as empty."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def fits(df: DataFrame) -> bool:
    """Whether ``df`` is counted to be small enough for broadcast."""
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if it is small enough, else as it is."""
    return F.broadcast(df) if fits(df) else df


def lookup(rows: DataFrame, table: DataFrame, on: list[str], by: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``: by broadcast if that is small enough; else rows of one key are dealt over
    ``PARTS`` tasks by the hash of ``by``, and ``table`` goes to each of them."""
    if fits(table):
        return rows.join(F.broadcast(table), on, how)
    dealt = rows.withColumn("part", F.pmod(F.xxhash64(*by), F.lit(PARTS)).cast("int"))
    copies = table.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return dealt.join(copies, [*on, "part"], how).drop("part")


def hot_keys(rows: DataFrame, key: str, per: int) -> DataFrame:
    """(key, parts) of keys with more than ``per`` rows: in how many parts to deal them."""
    counted = rows.groupBy(key).agg(F.count("*").alias("rows")).filter(F.col("rows") > per)
    return materialise(counted.select(key, F.ceil(F.col("rows") / per).cast("int").alias("parts")), "hot")


def dealt(rows: DataFrame, hot: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` with ``part``: rows of a hot key are dealt over its parts by the hash of ``by``, others have part 0."""
    found = rows.join(small(hot), key, "left")
    return found.withColumn("part", F.coalesce(F.pmod(F.xxhash64(by), F.col("parts")).cast("int"), F.lit(0))).drop("parts")


def in_each_part(rows: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``part``: rows of a hot key once for each of its parts."""
    found = rows.join(small(hot), key, "left")
    return found.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0))))).drop("parts")


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into pieces of about ``limit`` bytes of ``column``, rows kept whole."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i in range(n):
            if held and held + sizes[i] > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(sizes[i])
        yield batch.slice(start, n - start)


def tame_malloc() -> None:
    """Has large arrays go back to the system when they are freed, where the C library can do that.

    Workers live on from stage to stage; without it they keep the largest heap they ever had.
    """
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, MAPPED_BYTES)  # M_MMAP_THRESHOLD: larger blocks are mapped, and unmapped when freed
        libc.mallopt(-1, 2 * MAPPED_BYTES)  # M_TRIM_THRESHOLD: so much free heap may stay


def map_arrow(
    df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``mapInArrow`` in workers that give memory back."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tame_malloc()
        yield from fn(batches)

    return df.mapInArrow(work, schema)


def input_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes in all texts: one aggregate, used to size partitions."""
    row = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()
    return int(row["b"] or 0)
