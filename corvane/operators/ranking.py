"""Places in an order, however many rows share a key: no task numbers all rows of one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.session import cut


def numbered(df: DataFrame, keys: list[str], order: list[Column | str], out: str = "place") -> DataFrame:
    """Adds ``out``: the place, from 1, of each row among those of equal ``keys`` in ``order``. Null keys are one key; rows equal in all of ``order`` come in any order.

    Rows are sorted by ranges over tasks, so a frequent key is spread over as many as it fills. Within a task a key's rows follow
    one another, and a place is a row's distance from the key's first row there, and the key's rows in the tasks before.
    """
    rows = cut(df.orderBy(*keys, *order).withColumn("_id", F.monotonically_increasing_id()))
    task = F.shiftrightunsigned("_id", 33)
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    spans = rows.groupBy(task.alias("_task"), *named).agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*(f"_k{i}" for i in range(len(keys))) or [F.lit(0)]).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task that has the key
    spans = spans.withColumn("_base", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    same = task == F.col("_task")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    place = (F.col("_base") + F.col("_id") - F.col("_first") + 1).cast("long")
    return rows.join(spans, same).withColumn(out, place).drop("_id", "_task", "_first", "_base", *(f"_k{i}" for i in range(len(keys))))


def within(df: DataFrame, keys: list[str], most: int, what: str) -> DataFrame:
    """``df``, if no key has more than ``most`` rows; else an error, for results that put a key's rows into one value."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n")) if keys else df.agg(F.count("*").alias("n"))
    if (largest := counts.agg(F.max("n")).first()[0] or 0) > most:
        raise ValueError(f"{what}: {largest} rows of one key are more than {most}")
    return df
