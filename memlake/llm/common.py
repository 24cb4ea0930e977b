"""What the operators of this subpackage share: table access and cutting of lineage."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset a temporary folder stands in, in local mode only; on a cluster an unset
    folder is an error, since machines do not see each other's disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    global _LOCAL
    if _LOCAL is None:
        _LOCAL = tempfile.mkdtemp(prefix="memlake-")
    return _LOCAL


_LOCAL: str | None = None


#: Rows that a task of a table of known size takes at least.
ROWS_OF_TASK = 2000
#: Folders written since each ``scratch()`` that is open began, the innermost last; threads and
#: contexts have their own, so queries that run side by side don't meet.
_OPEN: ContextVar[tuple[list[tuple[SparkSession, str]], ...]] = ContextVar("open", default=())
#: Folders that results still read; see ``release``.
_KEPT: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, partition_by: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage: a lost executor never makes the work before it run again, and readers
    get the same rows in the same files each time. Inside ``scratch()`` the table goes when the
    block ends, else at the next ``release``. ``rows``, a bound of the table's size where one is
    known, spares a small table more tasks and files than it fills.
    """
    spark, path = df.sparkSession, os.path.join(shared_dir(df.sparkSession), f"memlake-{uuid.uuid4().hex}")
    (_OPEN.get() or (_KEPT,))[-1].append((spark, path))
    if rows is not None:
        df = df.coalesce(max(1, math.ceil(rows / ROWS_OF_TASK)))
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.memlake_path = path
    return out


def kept_table(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``materialize`` for the result of a ``scratch()`` block: the table stays."""
    token = _OPEN.set(_OPEN.get()[:-1])
    try:
        return materialize(df, rows=rows)
    finally:
        _OPEN.reset(token)


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes the tables that ``materialize`` writes in the block; what is needed of them
    afterwards has to be written by ``kept_table``."""
    mine: list[tuple[SparkSession, str]] = []
    token = _OPEN.set((*_OPEN.get(), mine))
    try:
        yield
    finally:
        _OPEN.reset(token)
        for spark, path in mine:
            _delete(spark, path)


def drop_table(df: DataFrame) -> None:
    """Delete what ``materialize`` or ``kept_table`` wrote for ``df``, if it did; nothing may read it any more."""
    if path := getattr(df, "memlake_path", None):
        _delete(df.sparkSession, path)


def release() -> None:
    """Delete every table that results of this process still read: for when they have been written
    or collected."""
    while _KEPT:
        _delete(*_KEPT.pop())


#: At most HOT keys, of more than HOT_ROWS rows each, count as hot; a hot key's rows are dealt
#: into SALTS parts.
HOT = 1024
HOT_ROWS = 1000
SALTS = 32


def hot_keys(rows: DataFrame, key: list[str]) -> DataFrame | None:
    """The most frequent keys of ``rows``, HOT at most, that have more than HOT_ROWS rows; or None."""
    return hot_from_counts(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key)


def hot_from_counts(counts: DataFrame, key: list[str]) -> DataFrame | None:
    """``hot_keys`` from the keys' counts ``n``."""
    some = counts.filter(F.col("n") > HOT_ROWS).orderBy(F.col("n").desc(), *key).limit(HOT).select(key)
    found = some.collect()
    return counts.sparkSession.createDataFrame(found, some.schema) if found else None


def join_hot(rows: DataFrame, side: DataFrame, key: list[str], by: str, hot: DataFrame | None) -> DataFrame:
    """Inner join of ``rows`` with ``side``, which has one row per key, on ``key``.

    The rows of a hot key are dealt into SALTS parts by ``by`` and its row of ``side`` is
    repeated for each: at most HOT * SALTS rows more, and no key's rows meet in one task.
    """
    if hot is None:
        return rows.join(side, key)
    marked = F.broadcast(hot.withColumn("hot_key", F.lit(True)))  # HOT rows at most
    zero = F.lit(0).cast("long")
    part = F.when(F.col("hot_key"), F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(zero)
    parts = F.when(F.col("hot_key"), F.sequence(zero, F.lit(SALTS - 1).cast("long"))).otherwise(F.array(zero))
    left = rows.join(marked, key, "left").withColumn("salt", part).drop("hot_key")
    right = side.join(marked, key, "left").withColumn("salt", F.explode(parts)).drop("hot_key")
    return left.join(right, [*key, "salt"]).drop("salt")


#: Bits of the sieve that spares most rows a join with few: 2^18 rows of 64 bits at most.
SIEVE_BITS = 1 << 24


def sifted(rows: DataFrame, key: Column, some: DataFrame, some_key: Column) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two: all whose ``key`` is among ``some``'s keys with few others, and the rest.

    Only the first have to be joined with ``some``, so the rest, long texts and all, stay where
    they are. The sieve has a fixed bound; the fuller it gets, the more rows go to the join.
    """

    def place(of: Column) -> tuple[Column, Column]:
        slot = F.pmod(F.xxhash64(of), F.lit(SIEVE_BITS))
        return F.shiftright(slot, 6), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))

    word, bit = place(some_key)
    sieve = some.groupBy(word.alias("sieve_word")).agg(F.bit_or(bit).alias("sieve_bits"))
    word, bit = place(key)
    met = rows.withColumn("sieve_word", word).join(F.broadcast(sieve), "sieve_word", "left")
    passes = F.coalesce(F.col("sieve_bits").bitwiseAND(bit) != 0, F.lit(False))
    return met.filter(passes).select(rows.columns), met.filter(~passes).select(rows.columns)


def rows_of(batches: Iterator[pa.RecordBatch], at_once: int = 500) -> Iterator[tuple]:
    """The batches' rows as tuples, a few at a time, so that long texts are not all held twice."""
    for batch in batches:
        for at in range(0, batch.num_rows, at_once):
            yield from zip(*(column.to_pylist() for column in batch.slice(at, at_once).columns))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bucket_of(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; a null id gives null."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % modulus
