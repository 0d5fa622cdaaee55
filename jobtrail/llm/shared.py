"""Folders all executors see, and small column helpers."""

from __future__ import annotations

import ctypes
import inspect
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Java form of the word separators: space and the control characters 9 to 13.
GAPS = "[ \\t-\\r]+"
# Places among which the rows of one key are dealt when they meet its facts; one bit each of a 64-bit integer.
PLACES = 64


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; only a local session without one makes its own."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("Set spark.checkpoint.dir to a folder shared by the cluster.")
        folder = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back, so later steps see the same rows."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Give freed memory back to the system: Python workers live on, and what they keep adds to later stages' memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def releasing(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
              ) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``function`` for ``mapInArrow``; what it has freed at its task's end goes back to the system."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            release()

    return run


def releasing_group(function: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """``function`` for ``applyInArrow`` of one or two groups; for groups of megabytes, as each call takes milliseconds."""
    if len(inspect.signature(function).parameters) == 1:
        def run(table: pa.Table) -> pa.Table:
            try:
                return function(table)
            finally:
                release()
    else:
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            try:
                return function(left, right)
            finally:
                release()
    return run


def place_of(spread: str) -> Column:
    """The place of a row within its key."""
    return F.pmod(F.xxhash64(spread), F.lit(PLACES)).cast("int")


def places_of(spread: str, where: Column | None = None) -> Column:
    """Aggregate: the places in which a key has rows, as bits."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place_of(spread))
    return F.bit_or(bit if where is None else F.when(where, bit))


def join_places(rows: DataFrame, facts: DataFrame, key: str, spread: str) -> DataFrame:
    """Join rows with their key's facts, of which ``_places`` came from ``places_of``.

    Facts are repeated only for the places their key has rows in, so there are
    never more of them than rows, and a key of any size lies in ``PLACES`` parts.
    """
    taken = F.filter(F.sequence(F.lit(0), F.lit(PLACES - 1)),
                     lambda i: F.call_function("shiftright", F.col("_places"), i).bitwiseAND(F.lit(1)) == 1)
    dealt = facts.withColumn("_place", F.explode(taken)).drop("_places")
    return rows.withColumn("_place", place_of(spread)).join(dealt, [key, "_place"]).drop("_place")


def join_facts(rows: DataFrame, facts: DataFrame, key: str, spread: str) -> DataFrame:
    """``join_places`` with a table of one row per key."""
    places = rows.groupBy(key).agg(places_of(spread).alias("_places"))
    return join_places(rows, places.join(facts, key), key, spread)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str = "text") -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Words between white space, A-Z lower-cased; empty for a text without words."""
    return F.filter(F.split(ascii_lower(text), GAPS), lambda w: w != "")


def hex_unit(text: Column) -> Column:
    """A number in [0, 1) with 52 bits from the MD5 of a text; the same in any SQL engine."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
