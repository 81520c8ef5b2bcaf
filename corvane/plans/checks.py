"""Registered queries that hold solvers against enumeration, and their SQL, which enumerates subsets and cuts as bit masks."""

from __future__ import annotations

from pyspark.sql import DataFrame

from corvane.operators import summaries, verify
from corvane.sources import graphs

from .register import query

_BITS = range(graphs.BLOCK)
_INSIDE = " + ".join(f"CASE WHEN (s >> {i}) & 1 = 1 THEN bit_count(s & o{i}) ELSE 0 END" for i in _BITS)
_ACROSS = " + ".join(f"CASE WHEN (t >> {i}) & 1 = 1 THEN bit_count((s - t) & u{i}) ELSE 0 END" for i in _BITS)
_MASKS = ", ".join(f"coalesce(bit_or(CASE WHEN node = {i} AND way = 1 THEN 1 << other END), 0) AS o{i}, coalesce(bit_or(CASE WHEN node = {i} THEN 1 << other END), 0) AS u{i}" for i in _BITS)
#: Every set with the query node, its arcs, and its connectivity: the least number of links across any part of it that holds the query.
_SETS = f"""WITH arcs AS ({graphs.BLOCK_ARCS}), meta AS ({graphs.BLOCK_META}), ends AS (SELECT seed, source AS node, target AS other, 1 AS way FROM arcs UNION ALL SELECT seed, target, source, 2 FROM arcs),
g AS (SELECT m.n, CAST(m.p AS DOUBLE) AS p, e.seed, CAST(1 << m.query_node AS BIGINT) AS q, {_MASKS} FROM ends e JOIN meta m ON m.seed = e.seed GROUP BY m.n, m.p, e.seed, m.query_node),
r AS (SELECT unnest(range(256)) AS s), sets AS (SELECT * FROM g JOIN r ON s & q = q AND bit_count(s) > 1),
conn AS (SELECT seed, s, min({_ACROSS}) AS conn FROM sets JOIN (SELECT s AS t FROM r) x ON t & s = t AND t & q = q AND t < s GROUP BY seed, s),
valued AS (SELECT n, p, sets.seed, bit_count(sets.s) AS size, {_INSIDE.replace("(s ", "(sets.s ").replace("(s &", "(sets.s &")} AS arcs, conn FROM sets JOIN conn ON conn.seed = sets.seed AND conn.s = sets.s),
cells AS (SELECT * FROM (SELECT unnest([3, 4, 5]) AS k) a, (SELECT unnest([0, 1, 2]) AS kappa) b),
best AS (SELECT n, p, seed, 'avgdeg' AS optimum_kind, CAST(NULL AS INT) AS k, CAST(NULL AS INT) AS kappa, max(CAST(arcs AS DOUBLE) / size) AS opt_value FROM valued GROUP BY n, p, seed
  UNION ALL SELECT n, p, seed, 'avgdeg_connected', NULL, NULL, coalesce(max(CAST(arcs AS DOUBLE) / size) FILTER (conn >= 1), -1.0) FROM valued GROUP BY n, p, seed
  UNION ALL SELECT n, p, seed, 'edge_density_kappa', k, kappa, coalesce(max(CAST(arcs AS DOUBLE) / (size * (size - 1))) FILTER (size >= k AND conn >= kappa), -1.0) FROM valued, cells GROUP BY n, p, seed, k, kappa)"""


@query(f"{_SETS} SELECT seed, optimum_kind, k, kappa, round(opt_value, 9) AS opt_value FROM best")
def verify_optima(spark, d) -> DataFrame:
    """Enumerated optima of every small graph."""
    from pyspark.sql import functions as F

    return verify.optima(*graphs.block_graphs(spark, d)).select("seed", "optimum_kind", "k", "kappa", F.round("opt_value", 9).alias("opt_value"))


@query(f"""{_SETS}, second AS (SELECT seed, opt_value AS v FROM best WHERE optimum_kind = 'avgdeg_connected'),
x AS (SELECT CASE WHEN optimum_kind = 'avgdeg' THEN 'avgdeg' ELSE 'bp' END AS method, k, kappa, p, opt_value >= 0 AS ok, optimum_kind = 'avgdeg' AND abs(opt_value - v) <= 1e-9 AS twice FROM best JOIN second USING (seed) WHERE optimum_kind <> 'avgdeg_connected')
SELECT method, k, kappa, p, count(*) AS n_runs, count(*) FILTER (ok) AS n_feasible, count(*) FILTER (ok) AS n_match_primary, CASE WHEN count(*) FILTER (ok) > 0 THEN 1.0 ELSE 0.0 END AS match_rate_primary,
  count(*) FILTER (twice) AS n_match_secondary, 0 AS n_solver_error, 0 AS n_infeasible_size, 0 AS n_infeasible_kappa, count(*) FILTER (NOT ok) AS n_skipped_bf_infeasible, 0 AS n_hard_cap_hit FROM x GROUP BY method, k, kappa, p""")
def verify_matches(spark, d) -> DataFrame:
    """Solvers on every small graph and cell against the optima: in SQL, what an exact solver must reach."""
    s = summaries.bf_summary(verify.verify(*graphs.block_graphs(spark, d)))
    return s.select(
        "method", "k", "kappa", "p", "n_runs", "n_feasible", "n_match_primary", "match_rate_primary", "n_match_secondary", "n_solver_error", "n_infeasible_size", "n_infeasible_kappa", "n_skipped_bf_infeasible", "n_hard_cap_hit",
    )
