"""Shared scratch storage: cutting lineage with tables every executor can read.

The folder is the one the cluster names in ``spark.checkpoint.dir``; only where
that setting is absent and all of Spark is one process (tests, a laptop) a local
temporary folder is made. Elsewhere its absence is an error: executors would
each write to a disk of their own.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables of this session."""
    if shared := spark.conf.get("spark.checkpoint.dir", None):
        return shared.rstrip("/")
    context = spark.sparkContext
    app = context.applicationId
    if app not in _LOCAL:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="corvane-")
    return _LOCAL[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/corvane-{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it where ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def trim() -> None:
    """Give a worker's free memory back, which it keeps otherwise while it waits for the next task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no glibc
        pass


def spread_join(rows: DataFrame, values: DataFrame, counts: DataFrame, keys: list[str], by: Column, share: int = 1000, salts: int = 64) -> DataFrame:
    """``rows`` left-joined with ``values`` (one row a key), frequent keys dealt over ``salts`` tasks.

    ``counts`` has the keys and how many rows each has, ``_n``. A key is frequent from one row in ``share`` on, so there
    are at most ``share`` of them, and they are broadcast. ``by`` deals a key's rows.
    """
    total = counts.agg(F.sum("_n").alias("n")).first().n or 0
    hot = F.broadcast(counts.where(F.col("_n") * share > total).select(*keys, F.lit(True).alias("_hot")))  # at most ``share`` rows
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(salts))).otherwise(0).cast("int")
    left = rows.join(hot, keys, "left").withColumn("_salt", salt).drop("_hot")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = values.join(hot, keys, "left").withColumn("_salt", F.explode(every)).drop("_hot")
    return left.join(right, [*keys, "_salt"], "left").drop("_salt")
