"""Audit of how filters interact, over every order in which they may be applied.

What a filter removes depends only on which filters came before it, not on their
order. So documents contribute to lattice edges (set of filters already applied,
next filter), ``m * 2 ** (m - 1)`` of them for m filters (80 for five), and the
``m! * m`` steps of all orders (600) are paths over these edges: one join.

Documents are summed into cells first (part, which filters fail, good, toxic), by
partial aggregation, so no task holds a part, and a text with many copies is one
row for each kind of copy before its group meets.

Nulls: a null text is empty; a null part is the empty string; a row without an id
is no copy of a smaller id and gives no text a smaller id; it has no label. Repeated
rows of one id are documents each, and no copies of each other. Of several labels of
one id, one that says 1 is enough; a null label says nothing. An empty text fails
the filter of few words only. Very long texts are split into words whole, in their task.
Columns other than those named are ignored, whatever their names. An empty table
gives no rows.
"""

from __future__ import annotations

from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: White space between words, as a Java pattern: U+0020 and U+0009 to U+000D.
SPACE = r"[ \t-\r]+"
#: The filter that a copy of a smaller id's text fails.
COPY = "E"


def text_failures(docs: DataFrame, text: Column) -> tuple[DataFrame, dict[str, Column]]:
    """``docs`` with columns that the failure conditions A to D read, and the conditions."""
    content = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(content, SPACE), "")
    upper = F.octet_length(F.regexp_replace(content, "[^A-Z]+", ""))
    read = docs.select("*", words.alias("_words"), upper.alias("_upper"), F.length(content).alias("_chars"), content.rlike("[#$%&*|]").alias("_signs"))
    n, distinct = F.size("_words"), F.size(F.array_distinct("_words"))
    return read, {
        "A": n < 200,
        "B": 100 * distinct.cast("long") < 50 * n.cast("long"),
        "C": 100 * F.col("_upper").cast("long") > 3 * F.col("_chars").cast("long"),
        "D": F.col("_signs"),
    }


def lattice_steps(names: str) -> list[tuple[str, int, int, int]]:
    """``order, step, applied, next`` of each step of each order; filters are bits, by their place in ``names``."""
    bit = {c: 1 << i for i, c in enumerate(names)}
    return [("".join(p), i + 1, sum(bit[c] for c in p[:i]), bit[p[i]]) for p in permutations(names) for i in range(len(p))]


def _cells(docs: DataFrame, labels: DataFrame, key: str, text: str, part: str) -> DataFrame:
    """``part, mask, good, toxic, n``: documents by the filters they fail and their labels."""
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).alias("text"))
    read, fails = text_failures(rows, F.col("text"))
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(fails.values())), F.lit(0))
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    rows = read.select("id", "part", digest.alias("digest"), mask.alias("mask")).groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    says = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    known = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    no = F.lit(False)
    rows = rows.join(known, "id", "left").select("id", "part", "digest", "mask", "n", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    # Copies of a text: for each kind, its least id, how many rows have it, and how many have no id.
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    kinds = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("all"), least.alias("least"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"))
    first = F.min("least.id").over(Window.partitionBy("digest"))
    own = F.col("unnamed") + F.when(F.col("least.id") == first, F.col("least.n")).otherwise(0)
    copy = F.lit(1 << len(fails))
    split = kinds.select("part", "mask", "good", "toxic", "all", own.alias("own")).select(
        "part", "good", "toxic", F.explode(F.array(F.struct("mask", F.col("own").alias("n")), F.struct((F.col("mask") + copy).alias("mask"), (F.col("all") - F.col("own")).alias("n")))).alias("x")
    )
    return split.groupBy("part", "good", "toxic", F.col("x.mask").alias("mask")).agg(F.sum("x.n").alias("n"))


def _edges(cells: DataFrame, m: int) -> DataFrame:
    """What happens on each edge of the lattice in each part: ``part, applied, next`` and counts."""
    every = [(s, 1 << i) for i in range(m) for s in range(1 << m) if not s >> i & 1]
    edges = F.explode(F.array(*(F.struct(F.lit(s).alias("applied"), F.lit(f).alias("next")) for s, f in every)))
    at = cells.select("part", "good", "toxic", "mask", "n", edges.alias("e")).select("*", "e.applied", "e.next")
    fails, gone = F.col("mask").bitwiseAND(F.col("next")) != 0, F.col("mask").bitwiseAND(F.col("applied")) != 0
    count = lambda where: F.sum(F.when(where, F.col("n")).otherwise(0)).cast("long")
    return at.groupBy("part", "applied", "next").agg(
        count(~fails & ~gone).alias("kept"), count(fails & ~gone).alias("removed"), count(fails & gone).alias("redundant"), count(F.col("mask") == F.col("next")).alias("unique_fails"),
        count(fails & ~gone & F.col("good")).alias("good_lost"), count(fails & ~gone & F.col("toxic")).alias("toxic_lost"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row for each part, order of the filters A to E, and step."""
    spark, names = docs.sparkSession, "ABCD" + COPY
    edges = _edges(_cells(docs, labels, key, text, part), len(names))
    steps = spark.createDataFrame(pa.table(list(map(list, zip(*lattice_steps(names), strict=True))), ["filter_order", "step", "applied", "next"]))
    paths = edges.join(F.broadcast(steps), ["applied", "next"])  # 600 rows, whatever the data
    shapley = F.sum("removed").over(Window.partitionBy("part", "next"))
    counts = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    return paths.select("part", "filter_order", F.col("step").cast("int").alias("step"), *counts, shapley.alias("shapley"))
