"""Summaries of experiment rows: one grouped aggregation each, with null keys as groups of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .flatten import COST_FIELDS, DERIVED_RATE_COLUMNS, HEADLINE_METRICS, TRACE_METRICS, derived_columns
from .records import bf_status, finite


def spread(metric: str, digits: int | None = None, extremes: bool = False) -> list[Column]:
    """Mean, deviation (0 for one value), median, quartiles and count of the finite values of a metric."""
    v = finite(F.col(metric).cast("double"))
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    cut = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    out = {
        "mean": cut(F.avg(v)), "std": cut(F.when(F.count(v) == 1, F.lit(0.0)).otherwise(F.stddev_samp(v))), "median": cut(q[1]), "q1": cut(q[0]), "q3": cut(q[2]), "n_finite": F.count(v),
    }
    out |= {"min": F.min(v), "max": F.max(v)} if extremes else {}
    return [c.alias(f"{metric}_{name}") for name, c in out.items()]


def _rate(flag: str, digits: int | None) -> list[Column]:
    """Count, share and percentage of a flag among rows where it is known."""
    n, c = F.count(flag), F.coalesce(F.sum(F.col(flag).cast("int")), F.lit(0))
    share = F.when(n > 0, c.cast("double") / n)
    cut = (lambda x: F.round(x, digits)) if digits is not None else (lambda x: x)
    return [c.cast("long").alias(f"n_{flag}"), cut(share).alias(f"{flag}_rate"), cut(100 * share).alias(f"{flag}_pct")]


def _cap_columns() -> list[Column]:
    hit = F.coalesce(F.col("hard_cap_hit"), F.lit(False)).cast("int")
    return [F.sum(hit).cast("long").alias("n_hard_cap_hit"), (F.sum(hit).cast("double") / F.count("*")).alias("hard_cap_hit_rate")]


def _groups(combine_splits: bool, extra: tuple[str, ...] = ()) -> list[str]:
    return ["dataset", "method", "params_hash", *([] if combine_splits else ["query_split"]), *extra]


def collapse_quality_seeds(rows: DataFrame, order: str = "ord") -> DataFrame:
    """Quality rows with a query's seeds replaced by their medians; other columns are the first row's, flags are any of them.

    Most queries have one seed or two, whose median needs their extremes only; only where there are more are values gathered.
    """
    keys = ["dataset", "method", "params_hash", "params", "query_split", "query_node"]
    first = lambda c: F.min_by(c, order).alias(c)
    # Counted by one number, which sorts faster than the keys; keys that share it have their values gathered too.
    counted = rows.withColumn("_key", F.xxhash64(*keys)).withColumn("_rows", F.count("*").over(Window.partitionBy("_key")))

    def collapsed(df: DataFrame, median) -> DataFrame:
        metrics = [median(m).alias(m) for m in (*HEADLINE_METRICS, *TRACE_METRICS)]
        others = [first("split_hash"), first("requested_k"), F.bool_or("fallback_used").alias("fallback_used"), median("size_solver").alias("size_solver"), F.bool_or("hard_cap_hit").alias("hard_cap_hit"), first("size_bucket"), F.min(order).alias(order)]
        return df.groupBy("_key", *keys).agg(*metrics, *others).drop("_key")

    few = collapsed(counted.where("_rows <= 2"), lambda m: F.min(m) * 0.5 + F.max(m) * 0.5)
    many = collapsed(counted.where("_rows > 2"), lambda m: F.percentile(m, 0.5))
    return derived_columns(few.union(many))


def summarise_quality(rows: DataFrame, combine_splits: bool = False, extra: tuple[str, ...] = (), digits: int | None = None) -> DataFrame:
    """Per cell: spread of every headline metric, how often the cap was hit, and rates of the derived flags."""
    aggs = [F.min("params").alias("params"), F.min("requested_k").alias("requested_k"), F.count("*").alias("n_queries"), *_cap_columns()]
    aggs += [c for f in DERIVED_RATE_COLUMNS for c in _rate(f, digits)] + [c for m in HEADLINE_METRICS for c in spread(m, digits)]
    return rows.groupBy(*_groups(combine_splits, extra)).agg(*aggs)


def summarise_cost(rows: DataFrame, combine_splits: bool = False, digits: int | None = None) -> DataFrame:
    """Per cell: spread of every cost field, and how often the cap was hit."""
    aggs = [F.min("params").alias("params"), F.count("*").alias("n_queries"), *_cap_columns(), *(c for m in COST_FIELDS for c in spread(m, digits))]
    return rows.groupBy(*_groups(combine_splits)).agg(*aggs)


def distinct_list(c: str) -> Column:
    """Sorted distinct values, as text."""
    return F.array_sort(F.collect_set(F.col(c).cast("string")))


def first_known(c: str, order: str) -> Column:
    """The first value that is not null."""
    return F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order)))


def counts_json(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Per group a JSON map of a column's values (as text, sorted) to their counts; an empty one where there are none."""
    one = df.groupBy(*keys, F.col(column).cast("string").alias("_v")).agg(F.count("*").alias("_c"))
    pair = F.when(F.col("_v").isNotNull(), F.struct("_v", "_c"))
    return one.groupBy(*keys).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(pair)))).alias(f"{column}_counts_json"))


def summarise_records(df: DataFrame, keys: list[str], metrics: list[str], flags: list[str], configs: list[str], order: str = "ord", digits: int | None = None) -> DataFrame:
    """Per cell of flattened records: counts, split hashes and builds seen, first configuration, flags, and spreads with extremes."""
    aggs = [F.count("*").alias("n_records"), F.countDistinct("query_node").alias("n_queries"), F.to_json(distinct_list("split_hash")).alias("split_hashes_json")]
    aggs += [F.countDistinct("solver_build_id").alias("n_solver_build_ids"), F.to_json(distinct_list("solver_build_id")).alias("solver_build_ids_json")]
    aggs += [first_known(c, order).alias(c) for c in configs]
    for f in flags:
        n, c = F.count(f), F.coalesce(F.sum(F.col(f).cast("int")), F.lit(0)).cast("long")
        aggs += [c.alias(f"{f}_count"), F.when(n > 0, c.cast("double") / n).alias(f"{f}_rate")]
    return df.groupBy(*keys).agg(*aggs, *(c for m in metrics for c in spread(m, digits, True)))


def paired_deltas(rows: DataFrame, baseline: str, metrics: tuple[str, ...], order: str = "ord") -> DataFrame:
    """``dataset, method, params_hash, query_split, query_node, metric, delta`` against the baseline's first row of the same query.

    Both sides take the first row of a query in ``order``: the baseline's of its dataset and split, the others' of their cell too.
    """
    def first(df: DataFrame, *keys: str) -> DataFrame:
        w = Window.partitionBy(*keys, "query_node").orderBy(order)
        return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")

    side = ["dataset", "query_split"]
    rows = rows.repartition(*side, "query_node")  # by which both sides are grouped and joined
    base = first(rows.where(F.col("method") == baseline), *side).select(*side, "query_node", *(F.col(m).alias(f"_{m}") for m in metrics))
    other = first(rows.where(F.col("method") != baseline), "method", "params_hash", *side)
    both = other.join(base, [*side, "query_node"])
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), (finite(F.col(m).cast("double")) - finite(F.col(f"_{m}").cast("double"))).alias("delta")) for m in metrics)))
    return both.select("dataset", "method", "params_hash", "query_split", "query_node", each.alias("d")).select("*", "d.*").drop("d").where("delta IS NOT NULL")


def paired_summary(deltas: DataFrame, digits: int | None = None) -> DataFrame:
    """Median, quartiles and number of the deltas of each cell and metric."""
    cut = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    q = F.percentile("delta", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return deltas.groupBy("dataset", "method", "params_hash", "query_split", "metric").agg(F.count("*").alias("n_paired"), cut(q[1]).alias("delta_median"), cut(q[0]).alias("delta_q1"), cut(q[2]).alias("delta_q3"))


def bf_summary(runs: DataFrame, keys: tuple[str, ...] = ("method", "k", "kappa", "p")) -> DataFrame:
    """Checks against enumeration, by cell: outcomes, match rates and medians among the feasible runs, and how often the cap was hit."""
    status = bf_status(*(F.col(c) for c in ("method", "status", "returncode", "solver_size", "k", "kappa", "solver_actual_kappa")))
    df = runs.withColumn("_status", status).withColumn("_ok", F.col("_status") == "feasible")
    of = lambda s: F.count_if(F.col("_status") == s).alias(f"n_{s}")
    matched = lambda c: F.count_if(F.col("_ok") & F.coalesce(F.col(c), F.lit(False)))
    rate = lambda c: F.when(F.count_if("_ok") > 0, matched(c) / F.count_if("_ok")).otherwise(F.lit(0.0))
    first, second = "opt_match_within_tol", "opt_match_within_tol_secondary"
    return df.groupBy(*keys).agg(
        F.count("*").alias("n_runs"), F.count_if("_ok").alias("n_feasible"), matched(first).alias("n_match_primary"), rate(first).alias("match_rate_primary"),
        matched(second).alias("n_match_secondary"), rate(second).alias("match_rate_secondary"), of("solver_error"), of("infeasible_size"), of("infeasible_kappa"), of("skipped_bf_infeasible"),
        F.percentile(F.when(F.col("_ok"), F.col("wall_time_s")), 0.5).alias("median_wall_time_s"), F.percentile(F.when(F.col("_ok"), F.col("total_bb_nodes")), 0.5).alias("median_total_bb_nodes"), *_cap_columns(),
    )


def optima_lookup(runs: DataFrame, optima: DataFrame) -> DataFrame:
    """Runs with the enumerated optimum of their graph and cell (null keys match); cells without a feasible set (below 0) are marked to be skipped."""
    keys = ["n", "p", "seed", "k", "kappa"]
    right = optima.select(*(F.col(c).alias(f"_{c}") for c in keys), *(c for c in ("opt_value", "opt_size", "opt_nodes", "opt_kappa") if c in optima.columns))
    same = None
    for c in keys:
        one = F.col(c).eqNullSafe(F.col(f"_{c}"))
        same = one if same is None else same & one
    df = runs.join(right, same, "left").drop(*(f"_{c}" for c in keys))
    return df.withColumn("status", F.when(F.col("opt_value") < 0, "skipped_bf_infeasible").otherwise("ran"))


def best_params_scores(grid: DataFrame, scores: tuple[str, ...] = ("precision", "recall", "f1", "accuracy")) -> DataFrame:
    """The parameters of best validation F1 for each dataset, method and seed, with their scores on every subset.

    ``grid`` has ``dataset, subset, method, params_hash, seed`` and scores. Ties go to precision, recall, then the hash.
    """
    keys = ["dataset", "method", "seed"]
    w = Window.partitionBy(*keys).orderBy(F.desc("f1"), F.desc("precision"), F.desc("recall"), "params_hash")
    best = grid.where("subset = 'val'").withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*(F.col(c).alias(f"_{c}") for c in keys), F.col("params_hash").alias("best_params_hash"))
    same = F.col("params_hash") == F.col("best_params_hash")
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    of = lambda s, m: F.max(F.when(F.col("subset") == s, F.col(m))).alias(f"{'hard' if s == 'bfs_depth1_wrong' else s}_{m}")
    return grid.join(best, same).groupBy(*keys, "best_params_hash").agg(*(of(s, m) for s in ("val", "test", "bfs_depth1_wrong") for m in scores))


def primary_seed(df: DataFrame, preferred: tuple[int, ...] = (42, 43, 44, 45, 46), deterministic: tuple[str, ...] = ("avgdeg", "bfs")) -> DataFrame:
    """``method, params_hash, seed, place``: the seeds of each cell in order, of deterministic methods only the first (null before others)."""
    seeds = df.select("method", "params_hash", "seed").distinct()
    listed = F.array_position(F.array(*(F.lit(s) for s in preferred)), F.col("seed").cast("int"))
    single = F.col("method").isin(*deterministic)
    w = Window.partitionBy("method", "params_hash").orderBy(F.when(single, 0).when(listed > 0, 0).otherwise(1), F.when(single, 0).when(listed > 0, listed).otherwise(0), F.asc_nulls_first("seed"))
    ranked = seeds.where(single | F.col("seed").isNotNull()).withColumn("place", F.row_number().over(w))
    return ranked.where(~F.col("method").isin(*deterministic) | (F.col("place") == 1))


def best_by_val_strict(scores: DataFrame, first: str = "first_seen") -> DataFrame:
    """Per method the parameter hash of best validation F1; the first seen of equals stays."""
    w = Window.partitionBy("method").orderBy(F.desc("f1"), first, "params_hash")
    return scores.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("method", "params_hash", "f1")


def expected_sizes(df: DataFrame, expected: DataFrame) -> DataFrame:
    """Cells whose number of distinct queries is not their split's: ``expected`` has ``dataset, query_split, want``. A missing split counts 0."""
    keys = ["dataset", "method", "params_hash", "seed"]
    cells = df.where(F.col("query_split").isin("val", "test")).select(*keys).distinct().join(F.broadcast(expected), "dataset")  # two rows a dataset
    have = df.groupBy(*(F.col(c).alias(f"_{c}") for c in (*keys, "query_split"))).agg(F.countDistinct("query_node").alias("have"))
    same = None
    for c in (*keys, "query_split"):
        one = F.col(c).eqNullSafe(F.col(f"_{c}"))
        same = one if same is None else same & one
    both = cells.join(have, same, "left").select(*keys, "query_split", F.coalesce("have", F.lit(0)).alias("have"), "want")
    return both.where("have <> want")


def collapse_report(df: DataFrame, keys: list[str], digits: int = 9) -> DataFrame:
    """Per cell how often the cap was hit and the vote fell back, and the mean size and oracle queries of known rows."""
    known = lambda c: F.round(F.avg(finite(F.col(c).cast("double"))), digits)
    fell = F.count_if(F.coalesce(F.col("fallback_used"), F.lit(False)))
    return df.groupBy(*keys).agg(
        F.count("*").alias("query_count"), *_cap_columns(), fell.alias("fallback_count"), (100.0 * fell / F.count("*")).alias("fallback_rate"),
        known("size").alias("avg_pred_size"), known("oracle_queries").alias("avg_oracle_queries"),
    )


def filter_hard_subset(df: DataFrame, hard: DataFrame) -> DataFrame:
    """Records outside the test split, and test records of hard queries; all records, where no query is hard."""
    some = hard.select(F.count("*").alias("_n"))  # one row
    marked = df.join(hard.select("query_node", F.lit(True).alias("_hard")).distinct(), "query_node", "left").crossJoin(F.broadcast(some))
    kept = marked.where((F.col("_n") == 0) | ~F.col("query_split").eqNullSafe("test") | F.col("_hard").isNotNull())
    return kept.select(*df.columns)


def seed_scores(per_seed: DataFrame, keys: list[str], scores: tuple[str, ...] = ("precision", "recall", "f1"), digits: int = 9) -> DataFrame:
    """Means over seeds of per-seed scores, how many seeds there are, and which kind of interval goes with them."""
    n = F.count("*")
    kind = F.when(F.col("method").isin("avgdeg", "bfs") | (F.col("n_seeds") <= 1), "single_seed_paired").otherwise("stratified_seed_pooled")
    means = per_seed.groupBy(*keys).agg(n.alias("n_seeds"), F.max("n").alias("n_queries"), *(F.round(F.avg(s), digits).alias(f"{s}_mean") for s in scores))
    return means.withColumn("ci_kind", kind)


def select_cell(summary: DataFrame, wanted: DataFrame, order: str = "params_hash") -> DataFrame:
    """For each row of ``wanted (dataset, method, k, kappa, expected_n)`` the first matching summary row; its values are null if it has too few queries.

    ``kappa`` counts for method bp only. A wanted cell without a summary row stays, with nulls.
    """
    left = wanted.select("dataset", "method", "k", "kappa", "expected_n")
    right = summary.select(*(F.col(c).alias(f"_{c}") for c in ("dataset", "method")), *(c for c in summary.columns if c not in ("dataset", "method")))
    same = (F.col("dataset") == F.col("_dataset")) & (F.col("method") == F.col("_method")) & (F.col("param_k") == F.col("k"))
    same = same & ((F.col("method") != "bp") | (F.col("param_kappa") == F.col("kappa")))
    first = Window.partitionBy("dataset", "method", "k", "kappa").orderBy(F.asc_nulls_last(order))
    both = left.join(right, same, "left").withColumn("_r", F.row_number().over(first)).where("_r = 1")
    values = [c for c in right.columns if not c.startswith("_") and c not in ("param_k", "param_kappa")]
    enough = F.col("n_queries") >= F.col("expected_n")
    return both.select("dataset", "method", "k", "kappa", *(F.when(enough, F.col(c)).alias(c) for c in values))


def bf_compare(runs: DataFrame, tol: float = 1e-6) -> DataFrame:
    """Solver sets against enumerated optima: the same set, the value within ``tol``, the same size; first and second optimum.

    ``runs`` has ``solver_value, solver_nodes, opt_value, opt_nodes, opt_size`` and the same three with ``_secondary``. A missing value matches nothing.
    """
    within = lambda a, b: F.coalesce(F.abs(F.col(a) - F.col(b)) <= tol, F.lit(False))
    alike = lambda a, b: F.coalesce(F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b)), F.lit(False))
    return runs.withColumns({
        "opt_match": alike("solver_nodes", "opt_nodes"), "opt_match_within_tol": within("solver_value", "opt_value"), "opt_match_size_only": F.coalesce(F.size("solver_nodes") == F.col("opt_size"), F.lit(False)),
        "opt_match_secondary": alike("solver_nodes", "opt_nodes_secondary"), "opt_match_within_tol_secondary": within("solver_value", "opt_value_secondary"),
    })


def provenance(df: DataFrame, keys: list[str]) -> DataFrame:
    """Which builds, split hashes and reused sources the records of a cell come from."""
    reused = F.count_if(F.coalesce(F.col("reused_solver_record"), F.lit(False))) if "reused_solver_record" in df.columns else F.lit(0)
    return df.groupBy(*keys).agg(F.count("*").alias("n_records"), distinct_list("solver_build_id").alias("builds"), distinct_list("split_hash").alias("split_hashes"), reused.cast("long").alias("n_reused"))
