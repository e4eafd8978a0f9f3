"""Scratch space that every executor can reach, and lineage cuts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import qualified


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset on a local master (tests), a folder of the
    warehouse.  On a cluster it must be set: a folder of one machine would lose what others read.  The name is full: without
    a scheme it is of the default file system."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if not told and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return qualified(spark, told or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")


#: Rows of a text column that go to a Python worker at a time.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of this session hold ``BATCH_ROWS`` rows at most; a smaller setting stays.  Texts are
    long, and a batch stands in the executor's and the worker's memory several times over."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once, its lineage cut by a checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a new Parquet table of the shared folder, read back.  The caller's cluster clears that folder."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as make it no column of ``df``, whatever the case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Bits of the table of ``sifted``.
BITS = 1 << 23


def sifted(df: DataFrame, column: str, wanted: DataFrame, inside: bool = True) -> DataFrame:
    """The rows of ``df`` whose ``column`` may be among the values of the one column of ``wanted``: all that are, and
    those that share a bit with one; or, not ``inside``, the others.  The table of bits is broadcast, BITS / 64 rows at
    most whatever the input; a full table only lets more through."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))
    bits = wanted.select(place(wanted.columns[0]).alias("p")).groupBy(F.floor(F.col("p") / 64).alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    placed = df.withColumn("_p", place(column)).join(F.broadcast(bits), F.floor(F.col("_p") / 64) == F.col("_word"), "inner" if inside else "left")
    hit = F.coalesce(F.getbit("_bits", (F.col("_p") % 64).cast("int")) == 1, F.lit(False))
    return placed.where(hit if inside else ~hit).select(df.columns)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
