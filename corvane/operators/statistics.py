"""Resampling statistics of experiment cells, as joins and aggregations.

A resample is drawn by a hash of draw and slot, so that it is the same on any machine and in any engine. A row matters only by
its pair of labels, so rows are packed into blocks of numbers of pairs, in order. A task draws some resamples from a stretch of
blocks and counts the pairs; one aggregation of these counts gives the scores of each draw. Draws are never written as rows, a slot
is hashed once for all cells of a stretch, and no task holds more than a stretch, nor a matrix of draws and rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import kernels
from corvane.session import cut

SCORES = ("precision", "recall", "f1")
#: Stretches that rows are numbered by, so no task numbers all rows of a key.
STRETCHES = 4096
#: Rows of a block, and blocks of a stretch: one or two bytes a row, which one task holds.
BLOCK, PER_STRETCH = 1 << 20, 128
#: Draws of a task, and slots that it hashes at once.
BATCH, SLOTS = 4, 1 << 16


def ordinals(df: DataFrame, keys: list[str], by: str, out: str = "ordinal") -> DataFrame:
    """Adds ``out``: the place (from 0) of each row among those of equal ``keys``, by the whole number ``by``; nulls come first, ties in any order.

    Rows are numbered within stretches of ``by``, and stretches by their counts.
    """
    span = df.agg(F.min(by).alias("lo"), F.max(by).alias("hi")).first()
    lo, width = span.lo or 0, ((span.hi or 0) - (span.lo or 0)) // STRETCHES + 1
    df = cut(df.withColumn("_s", F.coalesce(F.floor((F.col(by) - F.lit(lo)) / F.lit(width)).cast("long"), F.lit(-1).cast("long"))))
    counts = df.groupBy(*keys, "_s").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))
    same = [F.col(f"_k{i}").eqNullSafe(F.col(k)) for i, k in enumerate(keys)]
    base = counts.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_s").alias("_t"), F.coalesce(before, F.lit(0)).alias("_base"))
    on = F.col("_s") == F.col("_t")
    for one in same:
        on = on & one
    place = F.row_number().over(Window.partitionBy(*keys, "_s").orderBy(by)) - 1
    return df.withColumn("_p", place).join(base, on).withColumn(out, (F.col("_base") + F.col("_p")).cast("long")).drop("_s", "_p", "_t", "_base", *(f"_k{i}" for i in range(len(keys))))


def slot_hash(seed: Column, part: Column, draw: Column, slot: Column) -> Column:
    """A whole number below 2 ** 48 for each slot of a draw, from the digits of an md5."""
    text = F.concat_ws("/", *(c.cast("string") for c in (seed, part, draw, slot)))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def resamples(sizes: DataFrame, draws: int, seed: int) -> DataFrame:
    """``each, parts, draw, ordinal, times`` for ``sizes (each, parts)``: ``each`` rows drawn with replacement from every of ``parts`` equal stretches.

    Draw -1 has every row once.
    """
    rows = sizes.select("each", "parts").distinct().withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("draw", F.explode(F.sequence(F.lit(-1), F.lit(draws - 1))))
    slots = rows.repartition("each", "parts", "part", "draw").withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("each") - 1)))
    hashed = slot_hash(F.lit(seed), F.col("part"), F.col("draw"), F.col("slot")) % F.col("each")
    at = F.col("part") * F.col("each") + F.when(F.col("draw") < 0, F.col("slot")).otherwise(hashed)
    return slots.select("each", "parts", "draw", at.cast("long").alias("ordinal")).groupBy("each", "parts", "draw", "ordinal").agg(F.count("*").alias("times"))


def drawn_hashes(seed: int, part: int, draw: int, slots: list[bytes]) -> np.ndarray:
    """``slot_hash`` of many slots of a draw."""
    head, md5 = f"{seed}/{part}/{draw}/".encode(), hashlib.md5
    text = b"".join([md5(head + s).digest() for s in slots])
    return (np.frombuffer(text, ">u8")[::2] >> np.uint64(16)).astype(np.int64)


def drawn_pairs(rows: DataFrame, shape: DataFrame, keys: list[str], draws: int, seed: int) -> DataFrame:
    """``keys, n, draw, truth, predicted, times``: how often each draw of a cell has a pair of labels; draw -1 is the cell itself.

    ``rows`` has ``keys``, ``ordinal``, ``truth``, ``predicted``; ``shape`` has ``keys``, ``n``, and ``each`` and ``parts`` as in ``resamples``.
    """
    own = rows.groupBy(*keys, "truth", "predicted").agg(F.count("*").alias("times"))
    number = lambda *by: (F.row_number().over(Window.orderBy(*by)) - 1).cast("int")
    pairs = cut(own.select("truth", "predicted").distinct().withColumn("_code", number("truth", "predicted")))  # a row for each pair of labels
    cells = cut(shape.withColumn("_cell", number(*keys)))  # a row for each cell
    kind = np.min_scalar_type(max(0, pairs.count() - 1)).str
    t, p = (F.col(f"_{c}").eqNullSafe(F.col(c)) for c in ("truth", "predicted"))
    coded = rows.join(cells, keys).join(F.broadcast(pairs.withColumnRenamed("truth", "_truth").withColumnRenamed("predicted", "_predicted")), t & p)

    def pack(pdf):
        codes = pdf.sort_values("ordinal")["_code"].to_numpy().astype(kind)
        return pd.DataFrame({"_cell": pdf["_cell"].iloc[:1], "_block": pdf["_block"].iloc[:1], "codes": [codes.tobytes()]})

    coded = coded.select("_cell", F.floor(F.col("ordinal") / BLOCK).cast("int").alias("_block"), "ordinal", "_code")
    blocks = cut(coded.groupBy("_cell", "_block").applyInPandas(pack, "_cell int, _block int, codes binary"))
    stretch = F.floor((F.row_number().over(Window.orderBy("_cell", "_block")) - 1) / PER_STRETCH).cast("int")
    place = blocks.select(F.col("_cell").alias("_c"), F.col("_block").alias("_b"), stretch.alias("_stretch"))  # a row for each million rows
    batches = -(-draws // BATCH)
    dealt = blocks.join(F.broadcast(place), (F.col("_cell") == F.col("_c")) & (F.col("_block") == F.col("_b"))).join(F.broadcast(cells.select("_cell", "each", "parts")), "_cell")
    dealt = dealt.select("_stretch", "_cell", "_block", "each", "parts", "codes").withColumn("_batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1)))) if draws else None

    def count(key, pdf):
        mine = []
        for cell, own in pdf.sort_values(["_cell", "_block"]).groupby("_cell"):
            codes = np.frombuffer(b"".join(own["codes"]), kind)
            mine.append((int(cell), int(own["each"].iloc[0]), int(own["parts"].iloc[0]), int(own["_block"].iloc[0]) * BLOCK, codes))
        out = {}
        most = max(each for _, each, _, _, _ in mine)
        for lo in range(0, most, SLOTS):
            slots = [b"%d" % i for i in range(lo, min(lo + SLOTS, most))]
            for draw in range(int(key[1]) * BATCH, min((int(key[1]) + 1) * BATCH, draws)):
                for part in range(max(parts for _, _, parts, _, _ in mine)):
                    hashed = drawn_hashes(seed, part, draw, slots)
                    for cell, each, parts, first, codes in mine:
                        if part >= parts or lo >= each:
                            continue
                        at = hashed[: each - lo] % each + (part * each - first)
                        at = at[(at >= 0) & (at < len(codes))]
                        seen = np.bincount(codes[at])
                        old = out.get((cell, draw))
                        out[cell, draw] = seen if old is None else np.pad(old, (0, max(0, len(seen) - len(old)))) + np.pad(seen, (0, max(0, len(old) - len(seen))))
        found = [(cell, draw, int(code), int(seen[code])) for (cell, draw), seen in out.items() for code in np.flatnonzero(seen)]
        return pd.DataFrame(found, columns=["_cell", "draw", "_code", "times"])

    names = [*keys, "n", "draw", "truth", "predicted", "times"]
    itself = own.join(shape.select(*keys, "n"), keys).withColumn("draw", F.lit(-1)).select(*names)
    if not draws:
        return itself
    tasks = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes and long loops
    counted = dealt.repartition(tasks, "_stretch", "_batch").groupBy("_stretch", "_batch").applyInPandas(count, "_cell int, draw int, _code int, times long")
    counted = counted.groupBy("_cell", "draw", "_code").agg(F.sum("times").alias("times"))
    return counted.join(F.broadcast(cells), "_cell").join(F.broadcast(pairs), "_code").select(*names).union(itself)


def resampled_scores(rows: DataFrame, keys: list[str], label_keys: list[str], draws: int, seed: int, parts: str | None = None) -> DataFrame:
    """``keys, draw, n, precision, recall, f1, accuracy`` of every resample of each cell; draw -1 is the cell itself.

    ``rows`` has ``keys``, ``ordinal``, ``truth``, ``predicted``. Macro scores are over the labels of ``label_keys``' whole sample, 0 for
    one that is not drawn. With ``parts`` (a column), each of its values is resampled by itself; they need equal numbers of rows.
    """
    rows = cut(rows)
    shape = rows.groupBy(*keys).agg(F.count("*").alias("n"), (F.countDistinct(parts) if parts else F.lit(1)).cast("int").alias("parts"))
    shape = cut(shape.withColumn("each", F.floor(F.col("n") / F.col("parts")).cast("long")))
    if parts and not (uneven := rows.groupBy(*keys, parts).agg(F.count("*").alias("own")).groupBy(*keys).agg(F.min("own").alias("a"), F.max("own").alias("b")).where("a <> b")).isEmpty():
        raise ValueError(f"seeds have different numbers of rows: {uneven.first()}")
    both = drawn_pairs(rows, shape, keys, draws, seed)
    hit = (F.col("truth") == F.col("predicted")).cast("long") * F.col("times")
    none = F.lit(0).cast("long")
    sides = F.explode(F.array(F.struct(F.col("truth").alias("label"), hit.alias("tp"), F.col("times").alias("nt"), none.alias("np")), F.struct(F.col("predicted").alias("label"), none.alias("tp"), none.alias("nt"), F.col("times").alias("np"))))
    counts = both.select(*keys, "n", "draw", sides.alias("s")).groupBy(*keys, "n", "draw", "s.label").agg(*(F.sum(f"s.{c}").alias(c) for c in ("tp", "nt", "np")))
    labels = rows.select(*label_keys, F.explode(F.array("truth", "predicted")).alias("label")).groupBy(*label_keys).agg(F.countDistinct("label").alias("labels"))
    share = lambda a, b: F.sum(F.when(b > 0, a / b).otherwise(0.0)) / F.first("labels")
    tp, nt, np_ = F.col("tp"), F.col("nt"), F.col("np")
    # A label counts once for a draw, whichever side has it.
    return counts.join(labels, label_keys).groupBy(*keys, "n", "draw").agg(share(tp, np_).alias("precision"), share(tp, nt).alias("recall"), share(2 * tp, nt + np_).alias("f1"), (F.sum("tp") / F.first("n")).alias("accuracy"))


def _spans(scores: DataFrame, keys: list[str], names) -> DataFrame:
    own = F.col("draw") < 0
    cols = []
    for c in names:
        drawn = F.when(~own, F.col(c))
        cols += [F.max(F.when(own, F.col(c))).alias(c), F.percentile(drawn, F.lit(0.025)).alias(f"{c}_lo"), F.percentile(drawn, F.lit(0.975)).alias(f"{c}_hi"), F.stddev_samp(drawn).alias(f"{c}_std"), F.max(F.when(F.col("draw") == 0, F.col(c))).alias(f"{c}_first")]
    return scores.groupBy(*keys).agg(F.first("n").alias("n"), *cols)


def bootstrap_ci(df: DataFrame, keys: list[str], truth: str = "truth", predicted: str = "predicted", draws: int = 1000, seed: int = 0) -> DataFrame:
    """Per cell: macro scores and accuracy, their 2.5 and 97.5 percentiles over resamples, and a quarter of the span as their error.

    Rows without a label or prediction are left out; rows are drawn in query order.
    """
    rows = df.select(*keys, "query_node", F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).dropna(subset=["truth", "predicted"])
    found = _spans(resampled_scores(ordinals(rows, keys, "query_node"), keys, keys, draws, seed), keys, [*SCORES, "accuracy"])
    cols = [c for s in [*SCORES, "accuracy"] for c in (F.col(s), F.col(f"{s}_lo").alias(f"{s}_ci_lo"), F.col(f"{s}_hi").alias(f"{s}_ci_hi"), ((F.col(f"{s}_hi") - F.col(f"{s}_lo")) / 4).alias(f"{s}_boot_se"))]
    return df.select(*keys).distinct().join(found.select(*(F.col(k).alias(f"_{k}") for k in keys), "n", *cols), _null_safe(keys), "left").drop(*(f"_{k}" for k in keys)).withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def _null_safe(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return out


def wilson_interval(p: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    z2, p = z * z, F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))
    centre, half = (p + z2 / (2 * n)) / (1 + z2 / n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)


def paired_ci(df: DataFrame, group: list[str], cell: str = "cell", by_seed: str | None = None, draws: int = 1000, seed: int = 0) -> DataFrame:
    """Intervals of the macro scores of a group's cells, all from the same resampled queries.

    With ``by_seed``, each seed's rows are resampled among themselves (seeds need equal numbers of rows). An interval of
    no width is replaced by Wilson's.
    """
    keys = [*group, cell]
    rows = df.select(*keys, "query_node", "truth", "predicted", *([by_seed] if by_seed else []))
    if by_seed:  # stretches of seeds, one after the other
        place = F.dense_rank().over(Window.partitionBy(*keys).orderBy(by_seed)) - 1
        sizes = rows.groupBy(*keys, by_seed).agg(F.count("*").alias("_own")).withColumn("_before", place)
        rows = ordinals(rows, [*keys, by_seed], "query_node").join(sizes, [*keys, by_seed]).withColumn("ordinal", F.col("_before") * F.col("_own") + F.col("ordinal")).drop("_own", "_before")
    else:
        rows = ordinals(rows, keys, "query_node")
    found = _spans(resampled_scores(rows, keys, keys, draws, seed, by_seed), keys, SCORES)
    cols = []
    for s in SCORES:
        flat = F.col(f"{s}_lo") == F.col(f"{s}_hi")
        lo, hi = wilson_interval(F.col(f"{s}_first"), F.col("n"))
        cols += [F.when(flat, lo).otherwise(F.col(f"{s}_lo")).alias(f"{s}_lo"), F.when(flat, hi).otherwise(F.col(f"{s}_hi")).alias(f"{s}_hi")]
    return found.select(*keys, "n", *cols)


def bootstrap_ties(df: DataFrame, group: list[str], draws: int = 1000, seed: int = 42) -> DataFrame:
    """Which cells of a group are best, and tied with the best, by size floor and overall, for each macro score.

    ``df`` has ``cell, cell_k, query_node, truth, predicted``. Queries that all cells have are resampled together; a cell
    ties with the best where the 95 % interval of their difference holds 0.
    """
    keys = [*group, "cell", "cell_k"]
    rows = df.where(F.col("predicted").isNotNull()).select(*keys, "query_node", "truth", "predicted")
    cells = rows.select(*keys).distinct().groupBy(*group).agg(F.count("*").alias("_cells"))
    common = rows.groupBy(*group, "query_node").agg(F.countDistinct("cell").alias("_have")).join(cells, group).where("_have = _cells").select(*group, "query_node")
    rows = ordinals(rows.join(common, [*group, "query_node"]), keys, "query_node")
    scores = resampled_scores(rows, keys, group, draws, seed)
    long = F.explode(F.array(*(F.struct(F.lit(s).alias("metric"), F.col(s).alias("v")) for s in SCORES)))
    scores = cut(scores.select(*keys, "n", "draw", long.alias("m")).select(*keys, F.col("n").alias("n_queries"), "draw", "m.metric", "m.v"))
    value = scores.where("draw < 0").select(*keys, "n_queries", "metric", F.col("v").alias("value"))
    best = F.min_by("cell", F.struct((-F.col("value")).alias("v"), "cell"))
    of_floor = value.groupBy(*group, "cell_k", "metric").agg(best.alias("section"))
    of_all = value.groupBy(*group, "metric").agg(best.alias("overall"))
    told = cut(value.join(of_floor, [*group, "cell_k", "metric"]).join(of_all, [*group, "metric"]))
    drawn = scores.where("draw >= 0").select(*keys, "metric", "draw", "v")
    other = lambda c: drawn.select(*group, F.col("cell").alias(c), "metric", "draw", F.col("v").alias(f"{c}_v"))
    paired = drawn.join(told.select(*keys, "metric", "section", "overall"), [*keys, "metric"]).join(other("section"), [*group, "section", "metric", "draw"]).join(other("overall"), [*group, "overall", "metric", "draw"])
    spans = [F.percentile(F.col(f"{c}_v") - F.col("v"), F.lit(q)).alias(f"{c}_{s}") for c in ("section", "overall") for s, q in (("lo", 0.025), ("hi", 0.975))]
    out = told.join(paired.groupBy(*keys, "metric").agg(F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("std"), *spans), [*keys, "metric"])
    holds = lambda c: (F.col(f"{c}_lo") <= 0) & (F.col(f"{c}_hi") >= 0)
    return out.select(
        *group, "cell", "cell_k", "n_queries", "metric", "value", "std", (F.col("section") == F.col("cell")).alias("section_best"), (F.col("overall") == F.col("cell")).alias("overall_best"),
        holds("section").alias("section_tied"), holds("overall").alias("overall_tied"), "section_lo", "section_hi", "overall_lo", "overall_hi",
    )


def table_sort(ties: DataFrame) -> DataFrame:
    """Rows of a table of cells in its printed order: size floor, method, connectivity and depth, absent ones first."""
    return ties.orderBy(*(F.asc_nulls_first(c) for c in ("cell_k", "method", "kappa", "bfs_depth") if c in ties.columns), "cell", *(["metric"] if "metric" in ties.columns else []))


def signed_ranks(deltas: DataFrame, keys: list[str], delta: str = "delta") -> DataFrame:
    """``keys, n_paired, n, w_plus, tie_term, untied`` of each group: rows, those that are not zero, the rank sum of those above zero, and sum of t^3 - t over ties.

    Equal sizes are counted first, in one pass over the rows; a size's mid-rank is the number of smaller ones and half of its own. Sizes
    are ranked within octaves, and octaves by their counts, so no task sorts all sizes of a group.
    """
    d = F.col(delta).cast("double")
    rows = deltas.select(*keys, F.when(~F.isnan(d), d).alias("d"))
    counts = cut(rows.groupBy(*keys, F.abs("d").alias("size")).agg(F.count("*").alias("t"), F.count_if(F.col("d") > 0).alias("plus")))
    total = counts.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("size").isNotNull(), F.col("t"))), F.lit(0)).alias("n_paired"))
    sizes = counts.where(F.col("size") != 0).withColumn("octave", F.floor(F.log2("size") * 16))
    per = sizes.groupBy(*keys, "octave").agg(F.sum("t").alias("k"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy(*keys).orderBy("octave").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    less = F.coalesce(F.sum("t").over(Window.partitionBy(*keys, "octave").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = sizes.withColumn("less", less).join(per.select(*keys, "octave", before.alias("base")), [*keys, "octave"])
    rank = F.col("base") + F.col("less") + (F.col("t") + 1) / 2
    t = F.col("t").cast("double")
    sums = ranked.groupBy(*keys).agg(F.sum("t").alias("n"), F.sum(F.col("plus") * rank).alias("w_plus"), F.sum(t * t * t - t).alias("tie_term"), (F.max("t") == 1).alias("untied"))
    return total.join(sums, keys, "left").na.fill(0, ["n"]).na.fill(0.0, ["w_plus", "tie_term"]).withColumn("untied", F.coalesce("untied", F.lit(True)))


def wilcoxon(deltas: DataFrame, keys: list[str], delta: str = "delta") -> DataFrame:
    """Two-sided signed-rank test of each group's deltas: null below two values, 1 where all are zero."""

    @F.pandas_udf("double")
    def p_value(paired: pd.Series, n: pd.Series, plus: pd.Series, ties: pd.Series, untied: pd.Series) -> pd.Series:
        return pd.Series([kernels.signed_rank_p(*row) for row in zip(paired, n, plus, ties, untied, strict=True)], dtype="float64")

    ranks = signed_ranks(deltas, keys, delta)
    p = p_value("n_paired", "n", "w_plus", "tie_term", "untied")
    return ranks.select(*keys, "n_paired", F.when(F.col("n_paired") >= 2, p).alias("p"))


def section_best(scores: DataFrame, group: list[str], metric: str = "f1") -> DataFrame:
    """The best cell of each size floor and of all (``cell_k`` null) in a group; ties go to the name."""
    best = F.min_by("cell", F.struct((-F.col(metric)).alias("v"), "cell")).alias("best_cell")
    every = scores.groupBy(*group).agg(best, F.max(metric).alias(metric)).withColumn("cell_k", F.lit(None).cast("int"))
    return scores.groupBy(*group, "cell_k").agg(best, F.max(metric).alias(metric)).unionByName(every)
