"""The dataflow that holds solvers against enumeration, over files and over odd graphs."""

import pytest
from pyspark.sql import functions as F

from corvane.functions.branching import Limits
from corvane.operators import summaries, verify
from corvane.sources import graphs

META = "n int, p double, seed int, query_node long"
EDGES = "n int, p double, seed int, source long, target long"


def test_tree_of_graphs_matches_enumeration(spark, tmp_path):
    root, out = str(tmp_path / "tree"), str(tmp_path / "out")
    for p in (0.25, 0.5, 0.75):
        for seed in range(5):
            graphs.write_gnp(spark, root, 9, p, seed)
    few, _ = verify.verify_tree(spark, root, out, seeds=[0, 1])
    assert few.count() == 2 * 3 * 10
    first = spark.read.parquet(f"{out}/optima").count()
    checks, summary = verify.verify_tree(spark, root, out)
    rows = summary.collect()
    assert checks.count() == 15 * 10 and sum(r.n_runs for r in rows) == 150
    assert all(r.match_rate_primary == 1.0 and r.n_match_primary == r.n_feasible for r in rows if r.n_feasible)
    assert all(r.n_solver_error == r.n_infeasible_size == r.n_infeasible_kappa == 0 for r in rows)
    assert first == 6 * 11 and spark.read.parquet(f"{out}/optima").count() == 15 * 11  # the first six graphs were kept
    n_runs = spark.read.parquet(f"{out}/solver_runs").count()
    assert n_runs == checks.where("status = 'ran'").count()
    verify.verify_tree(spark, root, out)
    assert spark.read.parquet(f"{out}/solver_runs").count() == n_runs


def test_cells_without_a_set_are_skipped_and_second_optima_are_connected(spark):
    """0 - 1 and, apart from it, a dense triangle: the connected optimum of arcs a node is worse than the first."""
    both = lambda pairs: [e for u, v in pairs for e in ((u, v), (v, u))]
    arcs = both([(0, 1), (2, 3), (3, 4), (2, 4)])
    meta = spark.createDataFrame([(5, 0.5, 1, 0), (4, None, 2, 3)], META)  # the second has no arcs at all, and no p
    edges = spark.createDataFrame([(5, 0.5, 1, u, v) for u, v in arcs + [(0, 0), arcs[0]]], EDGES)
    rows = {(r.seed, r.method, r.k, r.kappa): r for r in verify.verify(meta, edges, (3,), (0, 1, 2)).collect()}
    one = rows[1, "avgdeg", None, None]
    assert one.opt_value == 8 / 5 and one.opt_value_secondary == 1.0 and one.opt_kappa == 0 and one.opt_kappa_secondary == 1
    assert one.opt_match_within_tol and not one.opt_match_within_tol_secondary and one.solver_actual_kappa == 0
    assert rows[1, "bp", 3, 1].status == "skipped_bf_infeasible" and rows[1, "bp", 3, 1].solver_nodes is None and not rows[1, "bp", 3, 1].opt_match
    assert rows[1, "bp", 3, 0].opt_match_within_tol
    assert rows[2, "bp", 3, 0].opt_value == 0.0 and rows[2, "bp", 3, 2].status == "skipped_bf_infeasible"
    assert len(rows) == 8


def test_limits_and_wrong_sets_show(spark):
    meta, edges = (t.where("n = 8") for t in (spark.createDataFrame([(8, 0.9, s, 0) for s in range(4)], META), spark.range(4).select(F.lit(8).alias("n"), F.lit(0.9).alias("p"), F.col("id").cast("int").alias("seed"), F.explode(F.sequence(F.lit(0), F.lit(62))).alias("e")).select("n", "p", "seed", F.floor(F.col("e") / 8).alias("source"), ((F.col("e") * 5 + F.col("seed")) % 8).alias("target"))))
    best = verify.optima(meta, edges)
    cells = verify.solver_cells(meta, best)
    runs = verify.solver_runs(cells.where("status = 'ran'"), edges, Limits(nodes=0))
    checked = verify.compare(cells, runs, best)
    wrong = verify.compare(cells, runs.withColumn("solver_value", F.col("solver_value") - 0.1).withColumn("solver_actual_kappa", F.lit(0)), best)
    assert checked.count() == 40
    s = summaries.bf_summary(wrong, ("method",)).where("method = 'bp'").first()
    assert s.n_match_primary == 0 and s.n_infeasible_kappa > 0


def test_empty_and_too_large(spark):
    none = spark.createDataFrame([], META)
    assert verify.verify(none, spark.createDataFrame([], EDGES)).count() == 0
    with pytest.raises(ValueError, match="25 nodes"):
        verify.optima(spark.createDataFrame([(25, 0.5, 0, 0)], META), spark.createDataFrame([], EDGES))
