"""Registered queries on experiment records, statistics, splits and displays, and their SQL.

Lines of orders stand for records: what a record says is a rule of the line's columns, the same in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.params import QUALITY_SCHEMA
from corvane.operators import display, evaluate, flatten, records, splits, statistics, summaries
from corvane.sources import graphs, outputs, papers

from .register import query

#: One flat row a line; ``ord`` is unique.
FLAT = """SELECT l_returnflag AS dataset, CASE CAST(l_linenumber % 3 AS INT) WHEN 0 THEN 'bfs' WHEN 1 THEN 'bp' ELSE 'avgdeg' END AS method,
  CAST(3 + l_suppkey % 2 AS INT) AS k, CASE WHEN l_linenumber % 3 = 1 THEN CAST(l_suppkey % 2 AS INT) END AS kappa, CASE WHEN l_linenumber % 3 = 0 THEN CAST(1 + l_suppkey % 2 AS INT) END AS depth,
  CASE WHEN l_linenumber % 3 = 1 THEN CAST(42 + l_linenumber % 2 AS INT) END AS seed, concat('h', CAST(l_suppkey % 2 AS VARCHAR)) AS params_hash, concat('s', CAST(l_orderkey % 3 AS VARCHAR)) AS split_hash,
  CASE WHEN l_orderkey % 2 = 0 THEN 'val' ELSE 'test' END AS query_split, CAST(l_orderkey AS BIGINT) AS query_node, CASE WHEN l_partkey % 23 > 0 THEN CAST(l_orderkey % 7 AS INT) END AS query_label,
  CASE WHEN l_suppkey % 11 > 0 THEN CAST((l_orderkey + l_suppkey % 3) % 7 AS INT) END AS predicted_label, CASE WHEN l_partkey % 50 = 0 THEN 1 ELSE 0 END AS returncode, CAST(l_quantity AS BIGINT) AS size,
  CASE WHEN l_partkey % 13 > 0 THEN CAST(l_suppkey % 4 AS BIGINT) END AS edge_connectivity, CAST(l_extendedprice AS DOUBLE) AS wall_time_s, CAST(l_partkey AS BIGINT) AS oracle_queries, l_discount > 0.05 AS hard_cap_hit,
  l_tax > 0.04 AS fallback_used, CAST(l_discount AS DOUBLE) AS density, CASE WHEN l_suppkey % 5 > 0 THEN CAST(l_tax AS DOUBLE) END AS mixing, concat('b', CAST(l_suppkey % 3 AS VARCHAR)) AS build, CAST(l_partkey % 97 AS BIGINT) AS bb_nodes,
  CASE WHEN l_partkey % 3 = 0 THEN 'exhausted' ELSE 'time_limit' END AS gap_status, ((CAST(l_orderkey AS BIGINT) * 8 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS ord FROM lineitem"""
_F = f"WITH f AS ({FLAT})"


def _flat(spark, d) -> DataFrame:
    graphs.tables(spark, d, "lineitem")
    return spark.sql(FLAT.replace("VARCHAR", "STRING"))


def _records(spark, d) -> DataFrame:
    """The rows as nested records."""
    f = _flat(spark, d)
    config = F.struct(F.lit("distance").alias("weighting"), F.struct(F.lit(0).alias("max_in_edges")).alias("solver_config"))
    params = F.struct("k", "kappa", F.col("depth").alias("bfs_depth"), config.alias("_eval"))
    known = F.struct("size", "edge_connectivity", F.col("density").alias("dir_internal_edge_density"), F.col("mixing").alias("mixing_param"))
    stats = F.struct(F.col("bb_nodes").alias("total_bb_nodes"), F.col("wall_time_s").alias("t_total"), F.col("oracle_queries").alias("total_lp_solves"))
    return f.select(
        "dataset", "method", "params_hash", "seed", "split_hash", "query_split", "query_node", "query_label", "predicted_label", "returncode", "size", "oracle_queries", "wall_time_s", "hard_cap_hit", "fallback_used",
        "gap_status", F.col("build").alias("solver_build_id"), params.alias("params"), known.alias("qualities"), stats.alias("stats"), "ord",
    )


_SPREAD = "round(avg({c}), 6) AS {m}_mean, round(CASE WHEN count({c}) = 1 THEN 0.0 ELSE stddev_samp({c}) END, 6) AS {m}_std, round(quantile_cont({c}, 0.5), 6) AS {m}_median, round(quantile_cont({c}, 0.25), 6) AS {m}_q1, round(quantile_cont({c}, 0.75), 6) AS {m}_q3, count({c}) AS {m}_n_finite"


def _spread(m: str, c: str) -> str:
    return _SPREAD.format(m=m, c=f"CAST({c} AS DOUBLE)")


@query(f"""{_F} SELECT ord, dataset, method, params_hash, params_hash AS params_hash_short, seed, query_node, CAST(k AS DOUBLE) AS requested_k, CAST(edge_connectivity AS DOUBLE) AS quality_kappa_s, size < k AS size_lt_k,
  edge_connectivity < 1 AS kappa_s_lt_1, edge_connectivity < 2 AS kappa_s_lt_2, query_label = predicted_label AS prediction_correct, k AS param_k, kappa AS param_kappa, depth AS param_bfs_depth, 'distance' AS eval_weighting,
  0 AS eval_solver_config_max_in_edges, density AS quality_dir_internal_edge_density, bb_nodes AS stat_total_bb_nodes FROM f""")
def flatten_record(spark, d):
    df = _records(spark, d)
    names = ("dataset", "method", "params_hash", "params_hash_short", "seed", "query_node", "requested_k", "quality_kappa_s", "size_lt_k", "kappa_s_lt_1", "kappa_s_lt_2", "prediction_correct", "param_k", "param_kappa", "param_bfs_depth", "eval_weighting", "eval_solver_config_max_in_edges", "quality_dir_internal_edge_density", "stat_total_bb_nodes")
    return flatten.flatten_record(df.withColumn("query_split", F.col("ord").cast("string"))).select(F.col("query_split").cast("long").alias("ord"), *names)


@query(f"{_F} SELECT 'param_k' AS name, count(k) AS n, CAST(sum(k) AS DOUBLE) AS total FROM f UNION ALL SELECT 'param_kappa', count(kappa), CAST(sum(kappa) AS DOUBLE) FROM f UNION ALL SELECT 'param_bfs_depth', count(depth), CAST(sum(depth) AS DOUBLE) FROM f UNION ALL SELECT 'eval_solver_config_max_in_edges', count(*), 0.0 FROM f")
def flatten_params(spark, d):
    df = _records(spark, d)
    leaves = {n: c for n, c in flatten.flatten_params(df).items() if n != "eval_weighting"}
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), c.cast("double").alias("v")) for n, c in leaves.items())))
    return df.select(each.alias("x")).groupBy("x.name").agg(F.count("x.v").alias("n"), F.sum("x.v").alias("total"))


_METRICS = {
    "size": "size", "oracle_queries": "oracle_queries", "wall_time_s": "wall_time_s", "returncode": "returncode", "quality_size": "size", "quality_edge_connectivity": "edge_connectivity", "quality_kappa_s": "edge_connectivity",
    "quality_dir_internal_edge_density": "density", "quality_mixing_param": "mixing", "stat_total_bb_nodes": "bb_nodes", "stat_t_total": "wall_time_s", "stat_total_lp_solves": "oracle_queries",
    "param_k": "k", "param_kappa": "kappa", "param_bfs_depth": "depth", "eval_weighting": "dataset", "eval_solver_config_max_in_edges": "dataset",
}


@query(f"{_F}, own AS (SELECT * FROM f WHERE method = 'bfs') " + " UNION ALL ".join(f"SELECT '{name}' AS name, count({c}) AS n FROM own{'' if name.startswith(('param_', 'eval_')) else f' HAVING count({c}) > 0'}" for name, c in _METRICS.items()))
def numeric_metric_columns(spark, d):
    """Metric and configuration columns of one method's flattened records, and how many records have a value; a metric that none has is no column."""
    wide = flatten.flatten_record(_records(spark, d).where("method = 'bfs'"))
    names = flatten.metric_columns(wide) + flatten.config_columns(wide)
    counts = wide.agg(*(F.count(c).alias(c) for c in names))
    return counts.unpivot([], names, "name", "n")


@query(f"""{_F} SELECT ord, dataset, method, params_hash, seed, query_node, query_split, CAST(k AS DOUBLE) AS requested_k, CAST(size AS DOUBLE) AS size, density AS dir_internal_edge_density, mixing AS mixing_param, CAST(edge_connectivity AS DOUBLE) AS kappa_s,
  hard_cap_hit, size < k AS size_lt_k, edge_connectivity < 1 AS kappa_s_lt_1, edge_connectivity < 2 AS kappa_s_lt_2, CASE WHEN size <= 5 THEN 'small' WHEN size <= 20 THEN 'medium' ELSE 'large' END AS size_bucket FROM f""")
def row_for_quality(spark, d):
    return flatten.quality_rows(_records(spark, d)).select("ord", "dataset", "method", "params_hash", "seed", "query_node", "query_split", "requested_k", "size", "dir_internal_edge_density", "mixing_param", "kappa_s", "hard_cap_hit", "size_lt_k", "kappa_s_lt_1", "kappa_s_lt_2", "size_bucket")


@query(f"{_F} SELECT ord, dataset, method, params_hash, seed, query_node, query_split, wall_time_s, CAST(oracle_queries AS DOUBLE) AS oracle_queries, CAST(size AS DOUBLE) AS size_solver, CAST(bb_nodes AS DOUBLE) AS total_bb_nodes, CAST(oracle_queries AS DOUBLE) AS total_lp_solves, wall_time_s AS t_total, gap_status, build AS solver_build_id, hard_cap_hit FROM f")
def row_for_cost(spark, d):
    return flatten.cost_rows(_records(spark, d)).select("ord", "dataset", "method", "params_hash", "seed", "query_node", "query_split", "wall_time_s", "oracle_queries", "size_solver", "total_bb_nodes", "total_lp_solves", "t_total", "gap_status", "solver_build_id", "hard_cap_hit")


@query(f"{_F} SELECT ord FROM f WHERE dataset = 'N' AND method = 'bp' AND query_split = 'val'")
def record_filters(spark, d):
    return flatten.record_filters(_records(spark, d), dataset="N", method="bp", split="val").select("ord")


_CELL = """CASE method WHEN 'bp' THEN concat('bp/', CAST(k AS VARCHAR), '/', CAST(kappa AS VARCHAR)) WHEN 'bfs' THEN concat('bfs/', CAST(depth AS VARCHAR), '/', CAST(k AS VARCHAR)) ELSE concat('avgdeg/', CAST(k AS VARCHAR)) END"""
_CELLS = f"""cells AS (SELECT cell, k AS cell_k, label AS cell_label, query_node, truth, predicted FROM (
  SELECT {_CELL} AS cell, k, CASE method WHEN 'bp' THEN concat('BP κ=', CAST(kappa AS VARCHAR)) WHEN 'bfs' THEN concat('BFS d=', CAST(depth AS VARCHAR)) ELSE 'AvgDeg' END AS label, query_node, query_label AS truth, coalesce(predicted_label, -1) AS predicted,
    row_number() OVER (PARTITION BY {_CELL}, query_node ORDER BY ord DESC) AS r FROM f WHERE query_split = 'test' AND (seed IS NULL OR seed = 42) AND query_label IS NOT NULL) x WHERE r = 1)"""


@query(f"{_F}, {_CELLS} SELECT * FROM cells")
def collect_cells(spark, d):
    return flatten.collect_cells(_records(spark, d), "test").drop("method")


@query(f"{_F} SELECT cell, cell_k, count(*) AS n FROM (SELECT {_CELL} AS cell, k AS cell_k FROM f) x GROUP BY cell, cell_k")
def cell_keys(spark, d):
    cols = flatten.cell_columns(F.col("method"), F.col("params.k"), F.col("params.kappa"), F.col("params.bfs_depth"))
    return _records(spark, d).select(cols["cell"].alias("cell"), cols["cell_k"].alias("cell_k")).groupBy("cell", "cell_k").agg(F.count("*").alias("n"))


_COLLAPSED = """c AS (SELECT dataset, method, params_hash, query_split, query_node, quantile_cont(CAST(size AS DOUBLE), 0.5) AS size, quantile_cont(density, 0.5) AS density, quantile_cont(mixing, 0.5) AS mixing, quantile_cont(CAST(edge_connectivity AS DOUBLE), 0.5) AS kappa_s,
  arg_min(k, ord) AS requested_k, bool_or(hard_cap_hit) AS hard_cap_hit, bool_or(fallback_used) AS fallback_used, min(ord) AS ord FROM f GROUP BY dataset, method, params_hash, query_split, query_node, k, kappa, depth)"""


@query(f"{_F}, {_COLLAPSED} SELECT dataset, method, params_hash, query_split, query_node, size, density AS dir_internal_edge_density, kappa_s, CAST(requested_k AS DOUBLE) AS requested_k, hard_cap_hit, fallback_used, size < requested_k AS size_lt_k FROM c")
def reattach_extras(spark, d):
    c = summaries.collapse_quality_seeds(flatten.quality_rows(_records(spark, d)))
    return c.select("dataset", "method", "params_hash", "query_split", "query_node", "size", "dir_internal_edge_density", "kappa_s", "requested_k", "hard_cap_hit", "fallback_used", "size_lt_k")


@query(f"""{_F}, {_COLLAPSED} SELECT dataset, method, params_hash, query_split, count(*) AS n_queries, CAST(count(*) FILTER (hard_cap_hit) AS BIGINT) AS n_hard_cap_hit, CAST(count(*) FILTER (hard_cap_hit) AS DOUBLE) / count(*) AS hard_cap_hit_rate,
  count(*) FILTER (size < requested_k) AS n_size_lt_k, round(CAST(count(*) FILTER (size < requested_k) AS DOUBLE) / count(*), 6) AS size_lt_k_rate, count(*) FILTER (kappa_s < 2) AS n_kappa_s_lt_2, round(100 * CAST(count(*) FILTER (kappa_s < 2) AS DOUBLE) / count(kappa_s), 6) AS kappa_s_lt_2_pct,
  {_spread('size', 'size')}, {_spread('kappa_s', 'kappa_s')}, {_spread('mixing_param', 'mixing')} FROM c GROUP BY dataset, method, params_hash, query_split""")
def summarise_quality(spark, d):
    c = summaries.collapse_quality_seeds(flatten.quality_rows(_records(spark, d)))
    s = summaries.summarise_quality(c, digits=6)
    keep = [f"{m}_{x}" for m in ("size", "kappa_s", "mixing_param") for x in ("mean", "std", "median", "q1", "q3", "n_finite")]
    return s.select("dataset", "method", "params_hash", "query_split", "n_queries", "n_hard_cap_hit", "hard_cap_hit_rate", "n_size_lt_k", "size_lt_k_rate", "n_kappa_s_lt_2", "kappa_s_lt_2_pct", *keep)


@query(f"{_F} SELECT dataset, method, params_hash, count(*) AS n_queries, CAST(count(*) FILTER (hard_cap_hit) AS DOUBLE) / count(*) AS hard_cap_hit_rate, {_spread('wall_time_s', 'wall_time_s')}, {_spread('total_bb_nodes', 'bb_nodes')}, 0 AS t_pricing_n_finite FROM f GROUP BY dataset, method, params_hash")
def summarise_cost(spark, d):
    s = summaries.summarise_cost(flatten.cost_rows(_records(spark, d)), combine_splits=True, digits=6)
    keep = [f"{m}_{x}" for m in ("wall_time_s", "total_bb_nodes") for x in ("mean", "std", "median", "q1", "q3", "n_finite")]
    return s.select("dataset", "method", "params_hash", "n_queries", "hard_cap_hit_rate", *keep, "t_pricing_n_finite")


@query(f"{_F} SELECT dataset, method, seed, count(*) AS n_records, count(DISTINCT query_node) AS n_queries, array_to_string(list_sort(list(DISTINCT split_hash)), ',') AS split_hashes, count(DISTINCT build) AS n_solver_build_ids, arg_min(kappa, ord) FILTER (kappa IS NOT NULL) AS param_kappa, min(wall_time_s) AS wall_time_s_min, max(wall_time_s) AS wall_time_s_max, count(*) FILTER (query_label = predicted_label) AS prediction_correct_count FROM f GROUP BY dataset, method, seed")
def distinct_lists(spark, d):
    """Distinct lists, first known configuration, flags and extremes of each cell."""
    df = _records(spark, d)
    wide = flatten.flatten_record(df.withColumn("solver_dump_path", F.col("ord"))).withColumnRenamed("solver_dump_path", "ord")
    s = summaries.summarise_records(wide, ["dataset", "method", "seed"], ["wall_time_s"], ["prediction_correct"], ["param_kappa"])
    listed = F.array_join(F.from_json("split_hashes_json", "array<string>"), ",")
    return s.select("dataset", "method", "seed", "n_records", "n_queries", listed.alias("split_hashes"), "n_solver_build_ids", "param_kappa", "wall_time_s_min", "wall_time_s_max", "prediction_correct_count")


@query(f"{_F}, c AS (SELECT dataset, method, gap_status AS v, count(*) AS c FROM f GROUP BY 1, 2, 3) SELECT dataset, method, '{{' || string_agg('\"' || v || '\":' || c, ',' ORDER BY v) || '}}' AS gap_status_counts_json FROM c GROUP BY dataset, method")
def category_counts(spark, d):
    return summaries.counts_json(_records(spark, d), ["dataset", "method"], "gap_status")


_PAIRED = """b AS (SELECT dataset, query_split, query_node, size, mixing FROM (SELECT *, row_number() OVER (PARTITION BY dataset, query_split, query_node ORDER BY ord) AS r FROM f WHERE method = 'avgdeg') x WHERE r = 1),
o AS (SELECT dataset, method, params_hash, query_split, query_node, size, mixing FROM (SELECT *, row_number() OVER (PARTITION BY method, params_hash, dataset, query_split, query_node ORDER BY ord) AS r FROM f WHERE method <> 'avgdeg') x WHERE r = 1),
p AS (SELECT o.*, b.size AS bs, b.mixing AS bm FROM o JOIN b ON o.dataset = b.dataset AND o.query_split = b.query_split AND o.query_node = b.query_node),
deltas AS (SELECT dataset, method, params_hash, query_split, query_node, 'size' AS metric, CAST(size - bs AS DOUBLE) AS delta FROM p UNION ALL SELECT dataset, method, params_hash, query_split, query_node, 'mixing_param', mixing - bm FROM p WHERE mixing - bm IS NOT NULL)"""


@query(f"{_F}, {_PAIRED} SELECT dataset, method, params_hash, query_split, metric, count(*) AS n_paired, round(quantile_cont(delta, 0.5), 6) AS delta_median, round(quantile_cont(delta, 0.25), 6) AS delta_q1, round(quantile_cont(delta, 0.75), 6) AS delta_q3 FROM deltas GROUP BY ALL")
def paired_join(spark, d):
    deltas = summaries.paired_deltas(flatten.quality_rows(_records(spark, d)), "avgdeg", ("size", "mixing_param"))
    return summaries.paired_summary(deltas, 6)


_RANKS = """sizes AS (SELECT dataset, method, params_hash, query_split, metric, abs(delta) AS size, count(*) AS t, count(*) FILTER (delta > 0) AS plus FROM deltas WHERE delta <> 0 GROUP BY ALL),
ranked AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY dataset, method, params_hash, query_split, metric ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2.0 AS mid FROM sizes)"""


@query(f"""{_F}, {_PAIRED}, {_RANKS}, sums AS (SELECT dataset, method, params_hash, query_split, metric, sum(t) AS n, sum(plus * mid) AS w_plus, sum(CAST(t AS DOUBLE) * t * t - t) AS tie_term FROM ranked GROUP BY ALL)
SELECT a.dataset, a.method, a.params_hash, a.query_split, a.metric, a.n_paired, CAST(coalesce(n, 0) AS BIGINT) AS n, CAST(coalesce(w_plus, 0) AS DOUBLE) AS w_plus, CAST(coalesce(tie_term, 0) AS DOUBLE) AS tie_term
FROM (SELECT dataset, method, params_hash, query_split, metric, count(*) AS n_paired FROM deltas GROUP BY ALL) a LEFT JOIN sums s ON s.dataset = a.dataset AND s.method = a.method AND s.params_hash = a.params_hash AND s.query_split = a.query_split AND s.metric = a.metric""")
def wilcoxon_ranks(spark, d):
    """What a signed-rank test is made of: values that are not zero, their rank sum, and ties."""
    deltas = summaries.paired_deltas(flatten.quality_rows(_records(spark, d)), "avgdeg", ("size", "mixing_param"))
    return statistics.signed_ranks(deltas, ["dataset", "method", "params_hash", "query_split", "metric"]).drop("untied")


@query()
def wilcoxon_signed_rank(spark, d):
    deltas = summaries.paired_deltas(flatten.quality_rows(_records(spark, d)), "avgdeg", ("size", "mixing_param"))
    return statistics.wilcoxon(deltas, ["dataset", "method", "params_hash", "query_split", "metric"])


#: Resamples of the queries of each cell, drawn by the digits of an md5, and the scores of each.
DRAWS = 200


def _drawn(seed: int, where: str = "", labels: str = "cell") -> str:
    return f"""c AS (SELECT cell, cell_k, 'test' AS subset, query_node, truth, predicted, row_number() OVER (PARTITION BY cell ORDER BY query_node) - 1 AS ordinal, count(*) OVER (PARTITION BY cell) AS n FROM (
  SELECT * FROM (SELECT {_CELL} AS cell, k AS cell_k, query_node, query_label AS truth, coalesce(predicted_label, -1) AS predicted, row_number() OVER (PARTITION BY {_CELL}, query_node ORDER BY ord DESC) AS r FROM f WHERE query_split = 'test' AND query_label IS NOT NULL) x WHERE r = 1) y {where}),
draws AS (SELECT unnest(range(-1, {DRAWS})) AS draw), slots AS (SELECT unnest(range(1000000)) AS slot),
times AS (SELECT n, draw, CASE WHEN draw < 0 THEN slot ELSE ('0x' || substr(md5(concat('{seed}/0/', draw, '/', slot)), 1, 12))::BIGINT % n END AS ordinal, count(*) AS times FROM (SELECT DISTINCT n FROM c) z CROSS JOIN draws JOIN slots ON slot < n GROUP BY ALL),
b AS (SELECT cell, cell_k, c.n, draw, truth, predicted, sum(times) AS times FROM c JOIN times t ON t.n = c.n AND t.ordinal = c.ordinal GROUP BY ALL),
k AS (SELECT cell, cell_k, n, draw, label, sum(tp) AS tp, sum(nt) AS nt, sum(np) AS np FROM (SELECT cell, cell_k, n, draw, truth AS label, CASE WHEN truth = predicted THEN times ELSE 0 END AS tp, times AS nt, 0 AS np FROM b UNION ALL SELECT cell, cell_k, n, draw, predicted, 0, 0, times FROM b) w GROUP BY ALL),
labels AS (SELECT {'cell' if labels == 'cell' else "'all' AS cell"}, count(DISTINCT label) AS labels FROM (SELECT cell, truth AS label FROM c UNION ALL SELECT cell, predicted FROM c) v GROUP BY ALL),
s AS (SELECT k.cell, cell_k, n, draw, sum(CASE WHEN np > 0 THEN CAST(tp AS DOUBLE) / np ELSE 0 END) / max(labels) AS precision, sum(CASE WHEN nt > 0 THEN CAST(tp AS DOUBLE) / nt ELSE 0 END) / max(labels) AS recall,
  sum(CASE WHEN nt + np > 0 THEN 2.0 * CAST(tp AS DOUBLE) / (nt + np) ELSE 0 END) / max(labels) AS f1, CAST(sum(tp) AS DOUBLE) / n AS accuracy FROM k JOIN labels ON {'labels.cell = k.cell' if labels == 'cell' else 'true'} GROUP BY k.cell, cell_k, n, draw)"""


def _own_cells(spark, d) -> DataFrame:
    return flatten.collect_cells(_records(spark, d).withColumn("seed", F.lit(None).cast("int")), "test").withColumn("subset", F.lit("test"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


_PERCENT = "round(quantile_cont({c}, 0.025) FILTER (draw >= 0), 9) AS {c}{x}_lo, round(quantile_cont({c}, 0.975) FILTER (draw >= 0), 9) AS {c}{x}_hi"
_OWN = "round(max({c}) FILTER (draw < 0), 9) AS {c}, " + _PERCENT.replace("{x}", "_ci") + ", round((quantile_cont({c}, 0.975) FILTER (draw >= 0) - quantile_cont({c}, 0.025) FILTER (draw >= 0)) / 4, 9) AS {c}_boot_se"


@query(f"{_F}, {_drawn(0)} SELECT cell, max(n) AS n, {', '.join(_OWN.format(c=c) for c in ('precision', 'recall', 'f1', 'accuracy'))} FROM s GROUP BY cell")
def bootstrap_ci(spark, d):
    return _rounded(statistics.bootstrap_ci(_own_cells(spark, d), ["cell"], draws=DRAWS))


@query(f"{_F}, {_drawn(0)} SELECT 'test' AS subset, cell, max(n) AS n, {', '.join(_PERCENT.format(c=c, x='') for c in ('precision', 'recall', 'f1'))} FROM s GROUP BY cell")
def paired_ci(spark, d):
    return _rounded(statistics.paired_ci(_own_cells(spark, d), ["subset"], draws=DRAWS))


_COMMON = "WHERE query_node IN (SELECT query_node FROM (SELECT DISTINCT {c} AS cell, query_node FROM f WHERE query_split = 'test' AND query_label IS NOT NULL) u GROUP BY query_node HAVING count(*) = (SELECT count(DISTINCT {c}) FROM f WHERE query_split = 'test' AND query_label IS NOT NULL))".format(c=_CELL)


@query(f"""{_F.replace("CAST(l_orderkey AS BIGINT) AS query_node", "CAST(l_orderkey % 50 AS BIGINT) AS query_node").replace("CASE WHEN l_partkey % 23 > 0 THEN CAST(l_orderkey % 7 AS INT) END", "CAST(l_orderkey % 50 % 7 AS INT)").replace("l_orderkey % 2 = 0", "l_orderkey % 50 % 2 = 0")}, {_drawn(42, _COMMON, "all")},
m AS (SELECT cell, cell_k, n, draw, unnest(['precision', 'recall', 'f1']) AS metric, unnest([precision, recall, f1]) AS v FROM s), own AS (SELECT * FROM m WHERE draw < 0),
told AS (SELECT *, first_value(cell) OVER (PARTITION BY cell_k, metric ORDER BY v DESC, cell) AS section, first_value(cell) OVER (PARTITION BY metric ORDER BY v DESC, cell) AS overall FROM own)
SELECT 'test' AS subset, t.cell, t.cell_k, t.n AS n_queries, t.metric, round(t.v, 9) AS value, round(stddev_samp(m.v), 9) AS std, t.section = t.cell AS section_best, t.overall = t.cell AS overall_best,
  round(quantile_cont(a.v - m.v, 0.025), 9) AS section_lo, round(quantile_cont(a.v - m.v, 0.975), 9) AS section_hi, round(quantile_cont(b.v - m.v, 0.025), 9) AS overall_lo, round(quantile_cont(b.v - m.v, 0.975), 9) AS overall_hi
FROM told t JOIN m ON m.cell = t.cell AND m.metric = t.metric AND m.draw >= 0 JOIN m a ON a.cell = t.section AND a.metric = t.metric AND a.draw = m.draw JOIN m b ON b.cell = t.overall AND b.metric = t.metric AND b.draw = m.draw
GROUP BY t.cell, t.cell_k, t.n, t.metric, t.v, t.section, t.overall""")
def bootstrap_ties(spark, d):
    """Cells over 50 queries that all have, best and tied with the best."""
    f = _records(spark, d)
    few = (F.col("query_node") % 50).cast("long")
    f = f.withColumn("query_split", F.when(few % 2 == 0, "val").otherwise("test")).withColumn("query_label", (few % 7).cast("int")).withColumn("query_node", few).withColumn("seed", F.lit(None).cast("int"))
    cells = flatten.collect_cells(f, "test").withColumn("subset", F.lit("test"))
    return _rounded(statistics.bootstrap_ties(cells, ["subset"], DRAWS).drop("section_tied", "overall_tied"))


_BF = """r AS (SELECT method, k, kappa, CAST(query_node % 2 AS DOUBLE) / 2 AS p, CASE WHEN bb_nodes % 10 = 0 THEN 'skipped_bf_infeasible' ELSE 'ran' END AS status, returncode, size AS solver_size, edge_connectivity AS solver_actual_kappa,
  density < 0.05 AS opt_match_within_tol, density < 0.07 AS opt_match_within_tol_secondary, wall_time_s, bb_nodes AS total_bb_nodes, hard_cap_hit FROM f)"""
_STATUS = "CASE WHEN status LIKE 'skipped%' THEN status WHEN returncode <> 0 THEN 'solver_error' WHEN method = 'bp' AND coalesce(solver_size < k, true) THEN 'infeasible_size' WHEN kappa >= 1 AND coalesce(solver_actual_kappa < kappa, true) THEN 'infeasible_kappa' ELSE 'feasible' END"


def _runs(spark, d) -> DataFrame:
    f = _flat(spark, d)
    status = F.when(F.col("bb_nodes") % 10 == 0, "skipped_bf_infeasible").otherwise("ran")
    return f.select(
        "method", "k", "kappa", ((F.col("query_node") % 2).cast("double") / 2).alias("p"), status.alias("status"), "returncode", F.col("size").alias("solver_size"), F.col("edge_connectivity").alias("solver_actual_kappa"),
        (F.col("density") < 0.05).alias("opt_match_within_tol"), (F.col("density") < 0.07).alias("opt_match_within_tol_secondary"), "wall_time_s", F.col("bb_nodes").alias("total_bb_nodes"), "hard_cap_hit",
    )


@query(f"{_F}, {_BF} SELECT {_STATUS} AS row_status, count(*) AS n FROM r GROUP BY 1")
def bf_row_status(spark, d):
    status = records.bf_status(*(F.col(c) for c in ("method", "status", "returncode", "solver_size", "k", "kappa", "solver_actual_kappa")))
    return _runs(spark, d).groupBy(status.alias("row_status")).agg(F.count("*").alias("n"))


@query(f"""{_F}, {_BF}, x AS (SELECT *, {_STATUS} AS st FROM r) SELECT method, k, kappa, p, count(*) AS n_runs, count(*) FILTER (st = 'feasible') AS n_feasible, count(*) FILTER (st = 'feasible' AND opt_match_within_tol) AS n_match_primary,
  coalesce(CAST(count(*) FILTER (st = 'feasible' AND opt_match_within_tol) AS DOUBLE) / nullif(count(*) FILTER (st = 'feasible'), 0), 0.0) AS match_rate_primary, count(*) FILTER (st = 'feasible' AND opt_match_within_tol_secondary) AS n_match_secondary,
  count(*) FILTER (st = 'solver_error') AS n_solver_error, count(*) FILTER (st = 'infeasible_size') AS n_infeasible_size, count(*) FILTER (st = 'infeasible_kappa') AS n_infeasible_kappa, count(*) FILTER (st = 'skipped_bf_infeasible') AS n_skipped_bf_infeasible,
  quantile_cont(wall_time_s, 0.5) FILTER (st = 'feasible') AS median_wall_time_s, quantile_cont(total_bb_nodes, 0.5) FILTER (st = 'feasible') AS median_total_bb_nodes, CAST(count(*) FILTER (hard_cap_hit) AS DOUBLE) / count(*) AS hard_cap_hit_rate FROM x GROUP BY method, k, kappa, p""")
def bf_summary(spark, d):
    return summaries.bf_summary(_runs(spark, d)).drop("match_rate_secondary", "n_hard_cap_hit")


@query(f"""{_F}, o AS (SELECT DISTINCT k, kappa, CASE WHEN kappa = 1 AND k = 4 THEN -1.0 ELSE CAST(k AS DOUBLE) / 10 END AS opt_value FROM f WHERE method = 'bp')
SELECT f.k, f.kappa, CASE WHEN o.opt_value < 0 THEN 'skipped_bf_infeasible' ELSE 'ran' END AS status, max(o.opt_value) AS opt_value, count(*) AS n FROM f LEFT JOIN o ON f.k = o.k AND f.kappa IS NOT DISTINCT FROM o.kappa GROUP BY 1, 2, 3""")
def optima_lookup(spark, d):
    one = [F.lit(1).alias(c) for c in ("n", "p", "seed")]
    f = _flat(spark, d).select("k", "kappa", "method", *one)
    value = F.when((F.col("kappa") == 1) & (F.col("k") == 4), -1.0).otherwise(F.col("k").cast("double") / 10)
    optima = f.where("method = 'bp'").select("n", "p", "seed", "k", "kappa", value.alias("opt_value"), F.lit(None).cast("long").alias("opt_size")).distinct()
    return summaries.optima_lookup(f, optima).groupBy("k", "kappa", "status").agg(F.max("opt_value").alias("opt_value"), F.count("*").alias("n"))


@query(f"{_F}, x AS (SELECT method, abs(density - 0.05) <= 0.011 AS within, size = k AS same_size, size = k AND query_node % 2 = 0 AS alike FROM f) SELECT method, count(*) FILTER (alike) AS opt_match, count(*) FILTER (within) AS opt_match_within_tol, count(*) FILTER (same_size) AS opt_match_size_only FROM x GROUP BY method")
def bf_compare(spark, d):
    f = _flat(spark, d)
    longs = lambda n, by: F.transform(F.sequence(F.lit(1).cast("long"), n.cast("long")), lambda x: x * by)
    runs = f.select("method", F.col("density").alias("solver_value"), F.reverse(longs(F.col("size"), 1)).alias("solver_nodes"), F.lit(0.05).alias("opt_value"), longs(F.col("k"), F.when(F.col("query_node") % 2 == 0, 1).otherwise(3)).alias("opt_nodes"), F.col("k").alias("opt_size"))
    runs = runs.withColumns({"opt_value_secondary": F.lit(None).cast("double"), "opt_nodes_secondary": F.lit(None).cast("array<bigint>")})
    of = lambda c: F.count_if(c).alias(c)
    return summaries.bf_compare(runs, 0.011).groupBy("method").agg(of("opt_match"), of("opt_match_within_tol"), of("opt_match_size_only"))


_PRF = """per AS (SELECT {k}, l, sum(nt) AS nt, sum(np) AS np, sum(tp) AS tp FROM (SELECT {k}, truth AS l, 1 AS nt, 0 AS np, CASE WHEN truth = predicted THEN 1 ELSE 0 END AS tp FROM {t} UNION ALL SELECT {k}, predicted, 0, 1, 0 FROM {t}) y GROUP BY {k}, l),
prf AS (SELECT {k}, round(avg(CASE WHEN np > 0 THEN CAST(tp AS DOUBLE) / np ELSE 0.0 END), 9) AS precision, round(avg(CASE WHEN nt > 0 THEN CAST(tp AS DOUBLE) / nt ELSE 0.0 END), 9) AS recall, round(avg(CASE WHEN nt + np > 0 THEN CAST(2 * tp AS DOUBLE) / (nt + np) ELSE 0.0 END), 9) AS f1,
  CAST(sum(tp) AS DOUBLE) / sum(nt) AS accuracy, CAST(sum(nt) AS BIGINT) AS n FROM per GROUP BY {k})"""
_GRID = f"""{_F}, hard AS (SELECT DISTINCT query_node FROM f WHERE query_node % 5 = 0), rows AS (SELECT dataset, query_split AS subset, method, params_hash, seed, query_label AS truth, predicted_label AS predicted FROM f WHERE query_label IS NOT NULL AND predicted_label IS NOT NULL
  UNION ALL SELECT dataset, 'bfs_depth1_wrong', method, params_hash, seed, query_label, predicted_label FROM f JOIN hard USING (query_node) WHERE query_split = 'test' AND query_label IS NOT NULL AND predicted_label IS NOT NULL), {_PRF.format(k='dataset, subset, method, params_hash, seed', t='rows')}"""


def _grid(spark, d) -> DataFrame:
    f = _records(spark, d)
    hard = f.where("query_node % 5 = 0").select("dataset", "query_node").distinct()
    rows = flatten.classification_subsets(f, hard).where("predicted_label IS NOT NULL AND query_label IS NOT NULL")
    return records.macro_prf(rows, ["dataset", "subset", "method", "params_hash", "seed"], "query_label", "predicted_label")


@query(f"{_GRID} SELECT * FROM prf")
def classification_grid(spark, d):
    return _grid(spark, d)


@query(f"""{_GRID}, best AS (SELECT dataset, method, seed, params_hash FROM (SELECT *, row_number() OVER (PARTITION BY dataset, method, seed ORDER BY f1 DESC, precision DESC, recall DESC, params_hash) AS r FROM prf WHERE subset = 'val') x WHERE r = 1)
SELECT b.dataset, b.method, b.seed, b.params_hash AS best_params_hash, max(f1) FILTER (subset = 'val') AS val_f1, max(f1) FILTER (subset = 'test') AS test_f1, max(f1) FILTER (subset = 'bfs_depth1_wrong') AS hard_f1, max(accuracy) FILTER (subset = 'test') AS test_accuracy
FROM best b JOIN prf p ON p.dataset = b.dataset AND p.method = b.method AND p.seed IS NOT DISTINCT FROM b.seed AND p.params_hash = b.params_hash GROUP BY b.dataset, b.method, b.seed, b.params_hash""")
def best_params_join(spark, d):
    return summaries.best_params_scores(_grid(spark, d)).select("dataset", "method", "seed", "best_params_hash", "val_f1", "test_f1", "hard_f1", "test_accuracy")


_VAL = f"""{_F}, rows AS (SELECT method, params_hash, query_label AS truth, coalesce(predicted_label, -1) AS predicted FROM f WHERE query_split = 'val' AND query_label IS NOT NULL), {_PRF.format(k='method, params_hash', t='rows')}"""


@query(f"""{_F}, rows AS (SELECT method, concat(params_hash, t) AS params_hash, query_label AS truth, coalesce(predicted_label, -1) AS predicted, ord * 2 + CASE WHEN t = 'z' THEN 0 ELSE 1 END AS o
  FROM f, (VALUES ('z'), ('a')) v(t) WHERE query_split = 'val' AND query_label IS NOT NULL AND (seed IS NULL OR seed = 42)), {_PRF.format(k='method, params_hash', t='rows')},
seen AS (SELECT method, params_hash, min(o) AS o FROM rows GROUP BY method, params_hash)
SELECT method, params_hash, f1 FROM (SELECT p.*, row_number() OVER (PARTITION BY p.method ORDER BY f1 DESC, o) AS r FROM prf p JOIN seen s ON s.method = p.method AND s.params_hash = p.params_hash) x WHERE r = 1""")
def best_by_val_f1_strict(spark, d):
    """Every cell is on record twice, with equal scores, first under the hash that sorts last; of seeds only the first counts."""
    f = _records(spark, d).where("query_split = 'val' AND query_label IS NOT NULL AND (seed IS NULL OR seed = 42)")
    twice = f.withColumn("t", F.explode(F.array(F.lit("z"), F.lit("a")))).withColumns({"params_hash": F.concat("params_hash", "t"), "o": F.col("ord") * 2 + F.when(F.col("t") == "z", 0).otherwise(1)})
    scores = records.macro_prf(twice, ["method", "params_hash"], "query_label", "predicted_label")
    return summaries.best_by_val_strict(scores.join(twice.groupBy("method", "params_hash").agg(F.min("o").alias("first_seen")), ["method", "params_hash"]))


@query(f"{_F}, s AS (SELECT DISTINCT method, params_hash, seed FROM f) SELECT method, params_hash, seed, row_number() OVER (PARTITION BY method, params_hash ORDER BY seed NULLS FIRST) AS place FROM s")
def primary_seed(spark, d):
    return summaries.primary_seed(_records(spark, d)).withColumn("place", F.col("place").cast("long"))


@query(f"{_F}, rows AS (SELECT method, seed, query_label AS truth, coalesce(predicted_label, -1) AS predicted FROM f WHERE query_split = 'test' AND query_label IS NOT NULL), {_PRF.format(k='method, seed', t='rows')} SELECT method, count(*) AS n_seeds, max(n) AS n_queries, round(avg(precision), 6) AS precision_mean, round(avg(recall), 6) AS recall_mean, round(avg(f1), 6) AS f1_mean, CASE WHEN method IN ('avgdeg', 'bfs') OR count(*) <= 1 THEN 'single_seed_paired' ELSE 'stratified_seed_pooled' END AS ci_kind FROM prf GROUP BY method")
def per_seed_and_pooled_scores(spark, d):
    per = records.macro_prf(_records(spark, d).where("query_split = 'test'"), ["method", "seed"], "query_label", "predicted_label")
    return summaries.seed_scores(per, ["method"], digits=6)


@query(f"{_F}, {_CELLS}, {_PRF.format(k='cell, cell_k', t='cells')} SELECT cell_k, arg_min(cell, {{'v': -f1, 'c': cell}}) AS best_cell, max(f1) AS f1 FROM prf GROUP BY cell_k UNION ALL SELECT NULL, arg_min(cell, {{'v': -f1, 'c': cell}}), max(f1) FROM prf")
def section_best(spark, d):
    cells = collect_cells(spark, d)
    scores = records.macro_prf(cells, ["cell", "cell_k"], "truth", "predicted")
    return statistics.section_best(scores, []).select("cell_k", "best_cell", "f1")


@query(f"{_F} SELECT DISTINCT query_node FROM f WHERE method = 'bfs' AND query_split = 'test' AND depth = 1 AND query_label IS NOT NULL AND query_label IS DISTINCT FROM predicted_label")
def hard_subset_from_records(spark, d):
    return flatten.wrong_depth1_queries(_records(spark, d))


@query(f"{_F}, h AS (SELECT DISTINCT query_node FROM f WHERE method = 'bfs' AND query_split = 'test' AND depth = 1 AND query_label IS NOT NULL AND query_label IS DISTINCT FROM predicted_label) SELECT ord FROM f WHERE query_split <> 'test' OR query_node IN (SELECT query_node FROM h)")
def filter_hard_subset(spark, d):
    f = _records(spark, d)
    return summaries.filter_hard_subset(f, flatten.wrong_depth1_queries(f)).select("ord")


@query(f"{_F} SELECT method, params_hash, seed, place // 100 * 100 + 1 AS first, count(*) AS n_records, string_agg(CAST(ord AS VARCHAR), ',' ORDER BY place) AS ords FROM (SELECT *, row_number() OVER (PARTITION BY method, params_hash, seed ORDER BY query_node, ord) - 1 AS place FROM f WHERE query_split = 'test') x GROUP BY method, params_hash, seed, place // 100")
def group_records(spark, d):
    g = flatten.group_records(_records(spark, d), "test", "ord", stretch=100)
    return g.select("method", "params_hash", "seed", "first", "n_records", F.array_join(F.transform("records", lambda r: r.ord.cast("string")), ",").alias("ords"))


@query(f"{_F} SELECT dataset, method, count(*) AS query_count, count(*) FILTER (hard_cap_hit) AS n_hard_cap_hit, CAST(count(*) FILTER (hard_cap_hit) AS DOUBLE) / count(*) AS hard_cap_hit_rate, count(*) FILTER (fallback_used) AS fallback_count, 100.0 * count(*) FILTER (fallback_used) / count(*) AS fallback_rate, round(avg(CAST(size AS DOUBLE)), 6) AS avg_pred_size, round(avg(CAST(oracle_queries AS DOUBLE)), 6) AS avg_oracle_queries FROM f GROUP BY dataset, method")
def collapse_report(spark, d):
    return summaries.collapse_report(_records(spark, d), ["dataset", "method"], 6)


@query(f"{_F} SELECT dataset, method, count(*) AS n_records, array_to_string(list_sort(list(DISTINCT build)), ',') AS builds, array_to_string(list_sort(list(DISTINCT split_hash)), ',') AS split_hashes FROM f GROUP BY dataset, method")
def provenance(spark, d):
    p = summaries.provenance(_records(spark, d), ["dataset", "method"])
    return p.select("dataset", "method", "n_records", F.array_join("builds", ",").alias("builds"), F.array_join("split_hashes", ",").alias("split_hashes"))


@query(f"""{_F}, cells AS (SELECT DISTINCT dataset, method, params_hash, seed FROM f), want AS (SELECT d.dataset, s.query_split, 100 AS want FROM (SELECT DISTINCT dataset FROM f) d, (VALUES ('val'), ('test')) s(query_split)), have AS (SELECT dataset, method, params_hash, seed, query_split, count(DISTINCT query_node) AS have FROM f GROUP BY ALL)
SELECT c.dataset, c.method, c.params_hash, c.seed, w.query_split, coalesce(h.have, 0) AS have, w.want FROM cells c JOIN want w ON w.dataset = c.dataset LEFT JOIN have h ON h.dataset = c.dataset AND h.method = c.method AND h.params_hash = c.params_hash AND h.seed IS NOT DISTINCT FROM c.seed AND h.query_split = w.query_split WHERE coalesce(h.have, 0) <> w.want""")
def expected_size_join(spark, d):
    f = _records(spark, d)
    want = f.select("dataset").distinct().withColumn("query_split", F.explode(F.array(F.lit("val"), F.lit("test")))).withColumn("want", F.lit(100))
    return summaries.expected_sizes(f, want)


@query(f"""{_F}, s AS (SELECT dataset, method, params_hash, k AS param_k, max(kappa) AS param_kappa, count(*) AS n_queries, max(wall_time_s) AS worst FROM f GROUP BY dataset, method, params_hash, k), w AS (SELECT * FROM (VALUES ('N', 'bp', 3, 0, 1), ('N', 'avgdeg', 4, NULL, 1), ('R', 'bfs', 3, NULL, 1000000000), ('X', 'bp', 3, 0, 1)) v(dataset, method, k, kappa, expected_n)),
j AS (SELECT w.*, s.params_hash, s.n_queries, s.worst, row_number() OVER (PARTITION BY w.dataset, w.method, w.k, w.kappa ORDER BY s.params_hash NULLS LAST) AS r FROM w LEFT JOIN s ON s.dataset = w.dataset AND s.method = w.method AND s.param_k = w.k AND (w.method <> 'bp' OR s.param_kappa = w.kappa))
SELECT dataset, method, k, kappa, CASE WHEN n_queries >= expected_n THEN params_hash END AS params_hash, CASE WHEN n_queries >= expected_n THEN worst END AS worst FROM j WHERE r = 1""")
def select_cell(spark, d):
    s = _flat(spark, d).groupBy("dataset", "method", "params_hash", F.col("k").alias("param_k")).agg(F.max("kappa").alias("param_kappa"), F.count("*").alias("n_queries"), F.max("wall_time_s").alias("worst"))
    wanted = spark.createDataFrame([("N", "bp", 3, 0, 1), ("N", "avgdeg", 4, None, 1), ("R", "bfs", 3, None, 1000000000), ("X", "bp", 3, 0, 1)], "dataset string, method string, k int, kappa int, expected_n long")
    return summaries.select_cell(s, wanted).select("dataset", "method", "k", "kappa", "params_hash", "worst")


_PICTURE = f"""WITH edges AS ({graphs.PART_EDGES}), nodes AS ({graphs.PART_NODES}), labels AS (SELECT node_id, label, CASE WHEN train THEN 'train' WHEN val THEN 'val' WHEN test THEN 'test' ELSE 'unlabeled' END AS split FROM nodes),
members AS (SELECT source AS query, source AS node FROM edges WHERE source % 100 = 0 UNION SELECT source, target FROM edges WHERE source % 100 = 0), placed AS (SELECT query, node, row_number() OVER (PARTITION BY query ORDER BY node) AS position FROM members)"""


def _picture(spark, d):
    edges, nodes = graphs.graph_view(spark, d, "part")
    from pyspark.sql import Window

    from corvane.operators import expand

    queries = edges.select(F.col("source").alias("query")).where("query % 100 = 0").distinct()
    members = expand.bfs_ball(expand.revealed(edges), queries, 1).withColumn("position", F.row_number().over(Window.partitionBy("query").orderBy("node")))
    split = F.when(F.col("train"), "train").when(F.col("val"), "val").when(F.col("test"), "test").otherwise("unlabeled")
    return display.display_graph(edges, nodes.withColumn("split", split), members)


@query(f"""{_PICTURE}, deg AS (SELECT node, count(*) AS degree FROM (SELECT source AS node FROM edges UNION ALL SELECT target FROM edges) x GROUP BY node)
SELECT query, CAST(p.node AS VARCHAR) AS id, p.node AS raw_id, CAST(position AS INT) AS display_num, label, split, coalesce(degree, 0) AS degree FROM placed p JOIN labels ON node_id = p.node LEFT JOIN deg ON deg.node = p.node""")
def display_num(spark, d):
    return display.core_only(_picture(spark, d)[0]).drop("type")


_GHOSTS = """both_ AS (SELECT source AS node, target AS other, true AS out FROM edges UNION ALL SELECT target, source, false FROM edges),
outside AS (SELECT m.query, m.node, b.other, count(*) AS c, bool_or(b.out) AS out FROM members m JOIN both_ b ON b.node = m.node WHERE b.other <> b.node AND NOT EXISTS (SELECT 1 FROM members k WHERE k.query = m.query AND k.node = b.other) GROUP BY m.query, m.node, b.other),
ranked AS (SELECT *, sum(c) OVER (PARTITION BY query, node) AS n, row_number() OVER (PARTITION BY query, node ORDER BY sha256(CAST(node AS VARCHAR) || '|' || CAST(other AS VARCHAR)), other) AS r FROM outside),
ghosts AS (SELECT * FROM ranked WHERE r <= least(3, greatest(1, floor(n * CAST(0.1 AS DOUBLE)))))"""


@query(f"""{_PICTURE}, {_GHOSTS}, core AS (SELECT DISTINCT m.query, e.source, e.target FROM members m JOIN edges e ON e.source = m.node JOIN members k ON k.query = m.query AND k.node = e.target)
SELECT query, CAST(source AS VARCHAR) AS source, CAST(target AS VARCHAR) AS target, 'core' AS type FROM core
UNION ALL SELECT query, CASE WHEN out THEN CAST(node AS VARCHAR) ELSE 'ghost_' || other END, CASE WHEN out THEN 'ghost_' || other ELSE CAST(node AS VARCHAR) END, 'ghost' FROM ghosts""")
def display_graph(spark, d):
    return _picture(spark, d)[1]


@query(f"{_PICTURE}, v AS (SELECT query, count(*) AS v FROM members GROUP BY query), e AS (SELECT m.query, count(*) AS e FROM members m JOIN edges e ON e.source = m.node JOIN members k ON k.query = m.query AND k.node = e.target GROUP BY m.query), {_GHOSTS}, g AS (SELECT query, count(DISTINCT other) AS ghosts FROM ghosts GROUP BY query) SELECT query, v, coalesce(e, 0) AS e, CASE WHEN v > 1 THEN CAST(coalesce(e, 0) AS DOUBLE) / (v * (v - 1)) ELSE 0.0 END AS density, coalesce(ghosts, 0) AS ghosts FROM v LEFT JOIN e USING (query) LEFT JOIN g USING (query)")
def display_stats(spark, d):
    return display.display_stats(*_picture(spark, d))


@query(f"{_PICTURE} SELECT query, p.node AS raw_id, row_number() OVER (PARTITION BY query ORDER BY label, p.node) - 1 AS rank, (row_number() OVER (PARTITION BY query ORDER BY label, p.node) - 1) % 3 AS row FROM placed p JOIN labels ON node_id = p.node")
def layout_rank(spark, d):
    return display.layout_rank(_picture(spark, d)[0]).select("query", "raw_id", F.col("rank").cast("long").alias("rank"), F.col("row").cast("long").alias("row"))


@query(f"{_PICTURE} SELECT query, p.node AS raw_id, row_number() OVER (ORDER BY label DESC, position, query) AS place FROM placed p JOIN labels ON node_id = p.node")
def ledger_sort(spark, d):
    return display.ledger_places(_picture(spark, d)[0], "label", True).select("query", "raw_id", "place")


_ITEMS = "SELECT ((CAST(l_orderkey AS BIGINT) * 8 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS ord, CAST(l_partkey % 5 AS VARCHAR) AS a, CAST(l_suppkey % 5 AS VARCHAR) AS b, l_returnflag AS c FROM lineitem"


@query(f"WITH i AS ({_ITEMS}), x AS (SELECT ord, a AS w, 1 AS spot FROM i UNION ALL SELECT ord, c, 2 FROM i UNION ALL SELECT ord, b, 3 FROM i UNION ALL SELECT ord, a, 4 FROM i) SELECT ord, value, row_number() OVER (PARTITION BY ord ORDER BY spot) AS position FROM (SELECT ord, TRY_CAST(w AS BIGINT) AS value, min(spot) AS spot FROM x WHERE TRY_CAST(w AS BIGINT) IS NOT NULL GROUP BY 1, 2) y")
def ordered_unique(spark, d):
    graphs.tables(spark, d, "lineitem")
    items = spark.sql(_ITEMS.replace("VARCHAR", "STRING")).select("ord", F.array("a", "c", "b", "a").alias("items"))
    return display.ordered_unique(items, ["ord"], "items").withColumn("position", F.col("position").cast("long"))


_WORKS = """SELECT CAST(p_partkey AS VARCHAR) AS node_id, p_size AS n, CASE WHEN p_size % 9 = 0 THEN NULL WHEN p_size % 9 = 1 THEN '{broken' ELSE '{"title": "T' || CAST(p_partkey AS VARCHAR) || '", "cited_by_count": ' || CAST(p_size AS VARCHAR) || ', "publication_year": ' || CAST(1990 + p_size % 30 AS VARCHAR) ||
  ', "authorships": [{"author": {"display_name": "A"}}' || CASE WHEN p_size % 2 = 0 THEN ', {"author": {"display_name": "B"}}' ELSE '' END || '], "referenced_works": ["https://x.org/W' || CAST(p_size AS VARCHAR) || '", "https://x.org/W2"], "abstract_inverted_index": {"deep": [0, 3], "graphs": [1]}}' END AS body FROM part"""


@query(f"""WITH w AS ({_WORKS}) SELECT node_id AS id, CASE WHEN n % 9 < 2 THEN 'Fetch Failed' ELSE 'T' || node_id END AS title, CASE WHEN n % 9 < 2 THEN 0 ELSE CAST(n AS BIGINT) END AS citations, CASE WHEN n % 9 < 2 THEN 'N/A' ELSE CAST(1990 + n % 30 AS VARCHAR) END AS year,
  CASE WHEN n % 9 < 2 THEN 'Unknown' WHEN n % 2 = 0 THEN 'A et al.' ELSE 'A' END AS author, 'N/A' AS journal, CASE WHEN n % 9 < 2 THEN '' ELSE 'W' || n || ',W2' END AS refs, CASE WHEN n % 9 < 2 THEN 'No abstract.' ELSE 'deep graphs  deep' END AS abstract FROM w""")
def paper_metadata(spark, d):
    graphs.tables(spark, d, "part")
    flat = papers.paper_metadata(spark.sql(_WORKS.replace("VARCHAR", "STRING")))
    return flat.select("id", "title", "citations", "year", "author", "journal", F.array_join("references", ",").alias("refs"), "abstract")


_OUT = """SELECT CAST(o_orderkey AS BIGINT) AS run, CASE WHEN o_orderkey % 4 = 0 THEN 'no result here' ELSE 'API Queries Made : ' || CAST(o_orderkey % 91 AS VARCHAR) || '
JSON_RESULT:{"query_node": "' || CAST(o_orderkey AS VARCHAR) || '", "method": "bp", "size": 2, "nodes": ["' || CAST(o_orderkey AS VARCHAR) || '", "7"], "wall_time_s": 0.5}
tail' END AS stdout FROM orders"""


@query(f"WITH r AS ({_OUT}) SELECT run, CASE WHEN run % 4 > 0 THEN CAST(run AS VARCHAR) END AS query_node, CASE WHEN run % 4 > 0 THEN run || ',7' END AS nodes, CASE WHEN run % 4 > 0 THEN run % 91 END AS oracle_queries FROM r")
def parse_solver_json(spark, d):
    graphs.tables(spark, d, "orders")
    r = spark.sql(_OUT.replace("VARCHAR", "STRING"))
    p = outputs.parse_solver_json(F.col("stdout"))
    return r.select("run", p.query_node.alias("query_node"), F.array_join(p.nodes, ",").alias("nodes"), outputs.parse_oracle_queries(F.col("stdout")).alias("oracle_queries"))


_NODES = f"WITH n AS ({graphs.PART_NODES}), s AS (SELECT node_id, label, train AND NOT val AND NOT test AS train, val, test FROM n)"


@query(f"{_NODES} SELECT split, count(*) FILTER (flag) AS size, 'sha256:' || sha256(coalesce(string_agg(CASE WHEN flag THEN CAST(node_id AS VARCHAR) END, chr(10) ORDER BY node_id), '')) AS hash FROM (SELECT node_id, 'train' AS split, train AS flag FROM s UNION ALL SELECT node_id, 'val', val FROM s UNION ALL SELECT node_id, 'test', test FROM s) x GROUP BY split")
def split_hashes(spark, d):
    nodes = graphs.graph_view(spark, d, "part")[1]
    return splits.split_hashes(splits.complement_train(nodes))


@query(f"WITH e AS ({graphs.PART_EDGES}) SELECT 'sha256:' || sha256(string_agg(source || ',' || target, chr(10) ORDER BY source, target)) AS edges_hash, count(*) AS num_edges FROM e")
def edges_hash(spark, d):
    return splits.edges_hash(graphs.graph_view(spark, d, "part")[0])


@query(f"WITH n AS ({graphs.PART_NODES}), c AS (SELECT label, count(*) AS n FROM n GROUP BY label), o AS (SELECT label, n, n // 2 AS half, n % 2 AS odd, coalesce(sum(n % 2) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c) SELECT label, half + CASE WHEN odd = 1 AND before % 2 = 1 THEN 1 ELSE 0 END AS val, n - half - CASE WHEN odd = 1 AND before % 2 = 1 THEN 1 ELSE 0 END AS test FROM o")
def stratified_half_split(spark, d):
    s = splits.stratified_half_split(graphs.graph_view(spark, d, "part")[1])
    return s.groupBy("label").agg(F.count_if(F.col("split") == "val").alias("val"), F.count_if(F.col("split") == "test").alias("test"))


@query(f"""{_F} SELECT dataset, query_split, split_hash, 's0' AS want, count(*) AS n_records FROM f WHERE split_hash <> 's0' GROUP BY dataset, query_split, split_hash""")
def validate_split_hash(spark, d):
    f = _records(spark, d)
    metas = {r.dataset: {"splits": {s: {"hash": "s0"} for s in ("val", "test")}} for r in f.select("dataset").distinct().collect()}  # a few datasets
    return splits.hash_mismatches(f, metas)


_TODO = f"{_F}, done AS (SELECT DISTINCT dataset, method, seed, query_node FROM f WHERE returncode = 0 AND query_split = 'val'), todo AS (SELECT DISTINCT dataset, method, seed, query_node FROM f)"


@query(f"{_TODO} SELECT t.dataset, t.method, count(d.query_node) AS hits, count(*) - count(d.query_node) AS misses FROM todo t LEFT JOIN done d ON d.dataset = t.dataset AND d.method = t.method AND d.seed IS NOT DISTINCT FROM t.seed AND d.query_node = t.query_node GROUP BY t.dataset, t.method")
def cache_lookup(spark, d):
    f = _records(spark, d).select("dataset", "method", "seed", "query_node", "query_split", "returncode", "ord", F.lit("p").alias("params_hash"), F.lit("s").alias("split_hash"))
    todo = f.select(*evaluate.KEY).distinct()
    hit, miss = evaluate.cache_lookup(todo, f.where("query_split = 'val'"))
    both = hit.select("dataset", "method", F.lit(1).alias("h")).unionByName(miss.select("dataset", "method", F.lit(0).alias("h")))
    return both.groupBy("dataset", "method").agg(F.sum("h").alias("hits"), F.sum(1 - F.col("h")).alias("misses"))


@query(f"""{_F}, v AS (SELECT DISTINCT dataset, method, k, kappa, depth FROM f), s AS (SELECT string_agg(CAST(seed AS VARCHAR), ',' ORDER BY seed) AS seeds FROM (SELECT DISTINCT seed FROM f WHERE seed IS NOT NULL) y)
SELECT DISTINCT a.dataset, a.method, b.k, c.kappa, e.depth, 'sha256:' || sha256('{{"_eval": {{"forbidden_hash": "sha256:' || sha256('') || '", "max_fallback_hops": 10, "quality_schema_version": "{QUALITY_SCHEMA}", "solver_config": {{"max_in_edges": 0}}, "weighting": "distance"}}, ' ||
  CASE a.method WHEN 'bp' THEN '"k": ' || b.k || ', "kappa": ' || c.kappa WHEN 'bfs' THEN '"bfs_depth": ' || e.depth || ', "bfs_use_k": true, "k": ' || b.k ELSE '"k": ' || b.k END || '}}') AS params_hash, CASE WHEN a.method = 'bp' THEN seeds ELSE 'None' END AS seeds FROM v a JOIN v b ON b.dataset = a.dataset AND b.method = a.method JOIN v c ON c.dataset = a.dataset AND c.method = a.method JOIN v e ON e.dataset = a.dataset AND e.method = a.method, s""")
def sweep(spark, d):
    """The manifests of sweeps over the parameters and seeds that each dataset's methods have on record: a few values each."""
    f = _flat(spark, d)
    seeds = sorted(r.seed for r in f.select("seed").where("seed IS NOT NULL").distinct().collect())
    grids: dict = {}
    for r in f.select("dataset", "method", "k", "kappa", F.col("depth").alias("bfs_depth")).distinct().collect():
        own = grids.setdefault(r.dataset, {}).setdefault(r.method, {})
        for name in ("k", "kappa", "bfs_depth"):
            if r[name] is not None:
                own.setdefault(name, set()).add(r[name])
    out = None
    for dataset, methods in sorted(grids.items()):
        one = evaluate.sweep(spark, dataset, {m: {n: sorted(v) for n, v in values.items()} for m, values in methods.items()}, seeds, "/records")
        out = one if out is None else out.unionByName(one)
    p = F.from_json("params_json", "k int, kappa int, bfs_depth int")
    return out.select("dataset", "method", p.k.alias("k"), p.kappa.alias("kappa"), p.bfs_depth.alias("depth"), "params_hash", "seeds")


@query()
def evaluate_nodes(spark, d):
    """Every node divisible by 100 evaluated by its one-hop ball: qualities, vote and record."""
    edges, nodes = graphs.graph_view(spark, d, "part")
    queries = nodes.where("node_id % 100 = 0").select(F.col("node_id").alias("query_node"))
    found = evaluate.evaluate_nodes(queries, edges, nodes, "bfs", {"bfs_depth": 1, "k": 3}, "part", "val", "s0", hops=2)
    return found.select("query_node", "query_label", "predicted_label", "fallback_used", "size", "oracle_queries", "qualities.dir_internal_edge_density", "qualities.undir_external_conductance", "qualities.edge_connectivity", "qualities.train_label_entropy")


def _evaluated(spark, d, method: str, params: dict) -> DataFrame:
    """Every nation evaluated on its graph, where a whole reveal is small."""
    edges, nodes = graphs.graph_view(spark, d, "nation")
    queries = nodes.select(F.col("node_id").alias("query_node"))
    found = evaluate.evaluate_nodes(queries, edges, nodes, method, params, "nation", "val", "s0", seed=42, hops=3, weighting="uniform")
    return found.select("query_node", "query_label", "predicted_label", "fallback_used", "size", "oracle_queries", "gap_status", F.round("qualities.dir_internal_edge_density", 9).alias("density"))


@query()
def evaluate_avgdeg(spark, d):
    return _evaluated(spark, d, "avgdeg", {"k": 6})


@query()
def evaluate_bp(spark, d):
    return _evaluated(spark, d, "bp", {"k": 3, "kappa": 1, "node_limit": 2000})


#: Prices, and tiny and huge numbers without a digit that is a tie.
_NUM = "SELECT ((CAST(l_orderkey AS BIGINT) * 8 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS ord, CASE l_linenumber % 3 WHEN 0 THEN -sqrt(CAST(l_extendedprice AS DOUBLE)) * CAST(1e-9 AS DOUBLE) WHEN 1 THEN sqrt(CAST(l_extendedprice AS DOUBLE)) * CAST(1e7 AS DOUBLE) ELSE CAST(l_extendedprice AS DOUBLE) END AS x FROM lineitem"


@query(f"WITH n AS ({_NUM}) SELECT ord, CASE WHEN abs(x) >= 0.001 AND abs(x) < 1e6 THEN printf('%.4f', x) ELSE regexp_replace(format('{{:.3e}}', x), 'e([+-])0*([0-9])', 'e\\1\\2') END AS shown FROM n")
def format_numbers(spark, d):
    graphs.tables(spark, d, "lineitem")
    return spark.sql(_NUM).select("ord", display.show_float(F.col("x"), 4).alias("shown"))
