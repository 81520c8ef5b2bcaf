"""Experiment records: reading, deriving, deduplicating, and summarising them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_records(spark: SparkSession, path: str, schema: str, name: str = "records.ndjson") -> tuple[DataFrame, DataFrame]:
    """Records of a tree of files of a ``name`` (a pattern), and the lines that are none. Blank lines and ``.bak`` folders are left out."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(path)
    lines = lines.where(~F.col("_metadata.file_path").rlike(r"\.bak/")).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return parsed.where("r._corrupt IS NULL").select("r.*").drop("_corrupt"), parsed.where("r._corrupt IS NOT NULL").select("value")


def append_records(records: DataFrame, path: str) -> None:
    records.drop("neighborhood").write.mode("append").partitionBy("method", "params_hash").json(path)


def finite(c: Column) -> Column:
    """Not-a-number and infinite values are null."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def safe_col(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "[^0-9A-Za-z_]+", "_"), "^_+|_+$", "")


def size_bucket(c: Column) -> Column:
    return F.when(c <= 5, "small").when(c <= 20, "medium").otherwise("large")


def relative_gap(bound: Column, incumbent: Column) -> Column:
    return F.when(bound.isNotNull() & incumbent.isNotNull(), F.greatest(bound - incumbent, F.lit(0.0)) / F.greatest(F.abs(incumbent), F.lit(1e-10)))


def set_hash(c: Column) -> Column:
    """Digest of a set of ids: sorted, one a line."""
    return F.concat(F.lit("sha256:"), F.sha2(F.array_join(F.transform(F.array_sort(c), lambda x: x.cast("string")), "\n"), 256))


def dedup(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def resume_join(todo: DataFrame, done: DataFrame, keys: list[str], order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Cells of ``todo`` with the first usable row of ``done`` (null keys match), and the cells still to do."""
    first = dedup(done, keys, order)
    first = first.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *(c for c in first.columns if c not in keys))
    same = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        same = one if same is None else same & one
    extra = [c for c in first.columns if not c.startswith("_k_")]
    return todo.join(first, same).select(*todo.columns, *extra), todo.join(first.drop(*extra), same, "left_anti")


def summarise_cells(df: DataFrame, keys: list[str], metrics: list[str], digits: int = 4) -> DataFrame:
    """Mean, deviation (0 for one value), quartiles, extremes and count of the finite values, by cell."""
    aggs = [F.count("*").alias("n_rows"), F.countDistinct("query_node").alias("n_queries")]
    for m in metrics:
        v = finite(F.col(m))
        q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        aggs += [
            F.round(F.avg(v), digits).alias(f"{m}_mean"), F.round(F.when(F.count(v) == 1, F.lit(0.0)).otherwise(F.stddev_samp(v)), digits).alias(f"{m}_std"), F.round(q[1], digits).alias(f"{m}_median"),
            F.round(q[0], digits).alias(f"{m}_q1"), F.round(q[2], digits).alias(f"{m}_q3"), F.min(v).alias(f"{m}_min"), F.max(v).alias(f"{m}_max"), F.count(v).alias(f"{m}_n"),
        ]
    return df.groupBy(*keys).agg(*aggs)


def flag_rates(df: DataFrame, keys: list[str], flags: list[str]) -> DataFrame:
    aggs = []
    for f in flags:
        n, c = F.count(f), F.coalesce(F.sum(F.col(f).cast("int")), F.lit(0))
        aggs += [c.cast("long").alias(f"{f}_count"), F.when(n > 0, c.cast("double") / n).alias(f"{f}_rate")]
    return df.groupBy(*keys).agg(*aggs)


def collapse_seeds(df: DataFrame, keys: list[str], metric: str, flag: str, extra: str, digits: int = 4) -> DataFrame:
    """Median over seeds, any of the flags, and the first seed's extra value."""
    return df.groupBy(*keys).agg(
        F.round(F.percentile(metric, 0.5), digits).alias(metric), F.bool_or(flag).alias(flag), F.min_by(extra, F.struct(F.coalesce("seed", F.lit(-1)), extra)).alias(extra), F.count("*").alias("n_rows"),
    )


def macro_prf(df: DataFrame, keys: list[str], truth: str = "label", predicted: str = "predicted", digits: int = 9) -> DataFrame:
    """Macro precision, recall and F1 over the labels seen on either side, and accuracy. Null predictions are label -1."""
    p = F.coalesce(F.col(predicted), F.lit(-1))
    rows = df.where(F.col(truth).isNotNull()).select(*keys, F.col(truth).alias("t"), p.alias("p"))
    both = rows.select(*keys, F.explode(F.array(F.struct(F.col("t").alias("l"), F.lit(1).alias("nt"), F.lit(0).alias("np")), F.struct(F.col("p").alias("l"), F.lit(0).alias("nt"), F.lit(1).alias("np")))).alias("s"), (F.col("t") == F.col("p")).cast("int").alias("hit"))
    per = both.groupBy(*keys, "s.l").agg(F.sum("s.nt").alias("nt"), F.sum("s.np").alias("np"), F.sum(F.col("hit") * F.col("s.nt")).alias("tp"))
    part = lambda a, b: F.when(b > 0, a.cast("double") / b).otherwise(0.0)
    tp, nt, np_ = F.col("tp"), F.col("nt"), F.col("np")
    return per.groupBy(*keys).agg(
        F.round(F.avg(part(tp, np_)), digits).alias("precision"), F.round(F.avg(part(tp, nt)), digits).alias("recall"), F.round(F.avg(part(2 * tp, nt + np_)), digits).alias("f1"),
        (F.sum("tp").cast("double") / F.sum("nt")).alias("accuracy"), F.sum("nt").cast("long").alias("n"),
    )


def best_by_val(scores: DataFrame, keys: list[str], cell: str) -> DataFrame:
    """The best validation cell of each key: by F1, precision, recall, then name."""
    return dedup(scores, keys, [F.desc("f1"), F.desc("precision"), F.desc("recall"), F.asc(cell)])


def common_queries(df: DataFrame, cell: list[str]) -> DataFrame:
    """Queries that every cell has."""
    cells = df.select(*cell).distinct().agg(F.count("*").alias("n"))
    return df.groupBy("query_node").agg(F.count_distinct(F.struct(*cell)).alias("k")).join(F.broadcast(cells), F.col("k") == F.col("n")).select("query_node")  # one row


def wilson_interval(successes: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    p, z2 = successes / n, z * z
    centre, span = (p + z2 / (2 * n)) / (1 + z2 / n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return F.greatest(centre - span, F.lit(0.0)), F.least(centre + span, F.lit(1.0))


def recorded_grid(df: DataFrame, key: str, *names: str) -> DataFrame:
    """All combinations of the values (null is one) that each ``key`` has on record for a few parameters: joins of their distinct values."""
    grid = None
    for name in names:
        one = df.select(key, name).distinct()
        grid = one if grid is None else grid.join(one, key)
    return grid


def param_grid(spark: SparkSession, **values: list) -> DataFrame:
    """All combinations of a few parameter values."""
    df = None
    for name, vs in values.items():
        one = spark.createDataFrame([(v,) for v in vs], [name])
        df = one if df is None else df.crossJoin(one)  # a grid is what is asked for; its inputs are literals
    return df


def bf_status(method: Column, status: Column, returncode: Column, size: Column, k: Column, kappa: Column, actual: Column) -> Column:
    """Outcome of a check against enumeration, by the first rule that holds. Unknown sizes and connectivities are too small."""
    small = (method == "bp") & k.isNotNull() & F.coalesce(size < k, F.lit(True))
    loose = (kappa >= 1) & F.coalesce(actual < kappa, F.lit(True))
    return F.when(status.startswith("skipped"), status).when(returncode != 0, "solver_error").when(small, "infeasible_size").when(loose, "infeasible_kappa").otherwise("feasible")


def abstract_text(df: DataFrame, key: str, index: str) -> DataFrame:
    """Text from a map of words to their positions; gaps are empty."""
    places = df.select(key, F.explode(index).alias("word", "at")).select(key, "word", F.explode("at").alias("at"))
    whole = places.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("at", "word"))).alias("m"), F.max("at").alias("top"))
    return whole.select(key, F.array_join(F.transform(F.sequence(F.lit(0), F.col("top")), lambda i: F.coalesce(F.element_at("m", i), F.lit(""))), " ").alias("text"))
