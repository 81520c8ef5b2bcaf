"""Solvers held against enumeration, over any number of small graphs in one dataflow.

A graph is a key ``n, p, seed``: ``meta (n, p, seed, query_node)`` has a row for each, ``edges (n, p, seed, source, target)`` its arcs between
the nodes 0 to n - 1. Optima are enumerated, cells without a feasible set are left out, the rest is solved, and both are compared. Each
graph is one group, whose size ``MOST`` bounds; graphs are dealt over tasks by their keys.
"""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import branching, kernels
from corvane.session import cut, shared_dir
from corvane.sources.graphs import scan_synthetic_tree

from .summaries import bf_compare, bf_summary, optima_lookup

KEYS = ["n", "p", "seed"]
#: Nodes of a graph that subsets are enumerated of; graphs of at most ``FEW`` are enumerated many at once.
MOST, FEW = 24, 10
OPTIMA = "n int, p double, seed int, query_node long, optimum_kind string, k int, kappa int, opt_value double, opt_size long, opt_nodes array<long>, opt_kappa int"
RUN = (
    "n int, p double, seed int, method string, k int, kappa int, solver_value double, solver_nodes array<long>, solver_size long, solver_actual_kappa int, kappa_verified boolean, "
    "gap_status string, hard_cap_hit boolean, total_bb_nodes long, wall_time_s double, returncode int"
)


def _typed(meta: DataFrame) -> DataFrame:
    return meta.select(F.col("n").cast("int").alias("n"), F.col("p").cast("double").alias("p"), F.col("seed").cast("int").alias("seed"), F.col("query_node").cast("long").alias("query_node"))


def _arcs(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("n").cast("int").alias("n"), F.col("p").cast("double").alias("p"), F.col("seed").cast("int").alias("seed"), "source", "target").where("source <> target").distinct()


def _joined(a: DataFrame, b: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """``a`` joined with ``b``; nulls of ``by`` are equal."""
    b, on = b.withColumnsRenamed({c: f"_r{c}" for c in by}), F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_r{c}"))
    return a.join(b, on, how).drop(*(f"_r{c}" for c in by))


def _first_alike(arcs: DataFrame, asks: DataFrame) -> DataFrame:
    """``n, p, seed`` of each graph with the ``_p, _seed`` of the first that has the same nodes, query node and arcs: what is found of one holds for all."""
    told = arcs.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("source", "target"))).alias("told"))  # a small graph's arcs
    graphs = _joined(asks.select(*KEYS, "query_node").distinct(), told, KEYS, "left")
    graphs = cut(graphs.withColumn("told", F.coalesce(F.to_json("told"), F.lit(""))))
    by = ["n", "query_node", "told"]
    first = graphs.groupBy(*by).agg(F.min(F.struct("p", "seed")).alias("first"))
    return _joined(graphs, first, by).select(*KEYS, F.col("first.p").alias("_p"), F.col("first.seed").alias("_seed"))


def _once(arcs: DataFrame, cells: DataFrame, solve, schema: str) -> DataFrame:
    """As ``_by_graph``; equal graphs are solved once, for all cells that any of them is asked for."""
    names = [f.split()[0] for f in schema.split(", ")]
    alike = cut(_first_alike(arcs, cells))
    cell = [c for c in ("method", "k", "kappa") if c in cells.columns]
    firsts = cut(_joined(cells, alike, KEYS).select("n", F.col("_p").alias("p"), F.col("_seed").alias("seed"), "query_node", *cell).distinct())
    few = _joined(arcs, firsts.select(*KEYS).distinct(), KEYS, "left_semi")
    found = _by_graph(few, firsts, solve, schema).withColumnsRenamed({"p": "_p", "seed": "_seed"})
    whole = _joined(found, alike, ["n", "_p", "_seed"]).select(*names)
    return _joined(whole, cells.select(*KEYS, *cell).distinct(), [*KEYS, *cell], "left_semi") if cell else whole


def _by_graph(arcs: DataFrame, cells: DataFrame, solve, schema: str) -> DataFrame:
    """``solve(rows)`` of batches of graphs, each a row with the ends of its arcs as lists and, where ``cells`` have any, its cells in ``asked``.

    Few bytes make long searches, so the number of tasks is set and not left to the size of the data.
    """
    tasks = 4 * int(arcs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = arcs.groupBy(*KEYS).agg(F.collect_list(F.struct("source", "target")).alias("told"))  # a small graph's arcs
    ends = [F.coalesce(f"told.{c}", F.array().cast("array<long>")).alias(c) for c in ("source", "target")]
    if cell := [c for c in ("method", "k", "kappa") if c in cells.columns]:
        cells = cells.groupBy(*KEYS, "query_node").agg(F.collect_list(F.struct(*cell)).alias("asked"))  # a graph's cells
    rows = _joined(cells, told, KEYS, "left").select(*cells.columns, *ends).repartition(tasks, *KEYS)
    return rows.mapInPandas(lambda batches: (solve(b.iloc[i : i + 500]) for b in batches for i in range(0, len(b), 500)), schema)


def _whole(x) -> int | None:
    return None if pd.isna(x) else int(x)


def optima(meta: DataFrame, edges: DataFrame, ks=(3, 4, 5), kappas=(0, 1, 2)) -> DataFrame:
    """Enumerated optima of each graph: pair density by floor and connectivity, arcs a node, and the same of connected sets.

    ``opt_kappa`` is the edge connectivity that the optimal set has; -1 without a set where none is feasible.
    """
    meta = _typed(meta)
    if (widest := meta.agg(F.max("n")).first()[0] or 0) > MOST:
        raise ValueError(f"graphs of {widest} nodes: at most {MOST} are enumerated")

    names = [f.split()[0] for f in OPTIMA.split(", ")]

    def alone(r):
        """The rows of one graph, set by set."""
        adj, q = kernels.adjacency(zip(r.source.tolist(), r.target.tolist(), strict=True)), int(r.query_node)
        for u in range(int(r.n)):
            adj.setdefault(u, set())
        und = kernels.support(adj)
        for kind, k, kappa, value, s in kernels.enumerate_optima(adj, q, ks, kappas):
            linked = kernels.edge_connectivity(und, s, q) if len(s) > 1 else None
            yield int(r.n), r.p, int(r.seed), q, kind, k, kappa, float(value), len(s) or None, sorted(s), linked

    def alike(rows, n, q):
        """The rows of graphs of the same nodes and query node, together."""
        arcs = np.zeros((len(rows), n, n), bool)
        arcs[np.repeat(np.arange(len(rows)), rows.source.map(len)), np.concatenate(list(rows.source)).astype("i8"), np.concatenate(list(rows.target)).astype("i8")] = True
        of = list(zip(rows.p, rows.seed.tolist(), strict=True))
        sets = {}
        for kind, k, kappa, *found in kernels.enumerate_many(arcs, q, ks, kappas):
            for (p, seed), value, mask, linked in zip(of, *(x.tolist() for x in found), strict=True):
                if mask not in sets:
                    sets[mask] = [u for u in range(n) if mask >> u & 1]
                yield n, p, seed, q, kind, k, kappa, value, len(sets[mask]) or None, sets[mask], linked if mask else None

    def solve(rows):
        few = (rows.n <= FEW) & (rows.n > 1) & (rows.query_node < rows.n) & (rows.query_node >= 0)
        few &= [all(len(x) == 0 or (x.min() >= 0 and x.max() < n) for x in ends) for *ends, n in zip(rows.source, rows.target, rows.n, strict=True)]
        out = [x for r in rows[~few].itertuples() for x in alone(r)]
        for (n, q), some in rows[few].groupby(["n", "query_node"]):
            out += alike(some, int(n), int(q))
        return pd.DataFrame(out, columns=names)

    return _once(_arcs(edges), meta, solve, OPTIMA)


def solver_cells(meta: DataFrame, best: DataFrame, ks=(3, 4, 5), kappas=(0, 1, 2)) -> DataFrame:
    """A row for each graph and cell, ``avgdeg`` and ``bp`` for every floor and connectivity, with its optimum and whether it is to be run."""
    each = [("avgdeg", None, None)] + [("bp", k, kappa) for k in ks for kappa in kappas]
    cell = F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.lit(k).cast("int").alias("k"), F.lit(kappa).cast("int").alias("kappa")) for m, k, kappa in each)))
    cells = _typed(meta).withColumn("cell", cell).select(*KEYS, "query_node", "cell.*")
    return optima_lookup(cells, best.where("optimum_kind <> 'avgdeg_connected'"))


def solver_runs(cells: DataFrame, edges: DataFrame, limits: branching.Limits = branching.Limits()) -> DataFrame:  # noqa: B008
    """The solvers' sets for cells ``(n, p, seed, query_node, method, k, kappa)``, with the connectivity that each set really has.

    Equal graphs are solved once and have that run's time.
    """

    names = [f.split()[0] for f in RUN.split(", ")]

    def one(r):
        """The runs of one graph: what its searches have in common is found once."""
        adj, q = kernels.adjacency(zip(r.source.tolist(), r.target.tolist(), strict=True)), int(r.query_node)
        for u in range(int(r.n)):
            adj.setdefault(u, set())
        und, shared, linked = kernels.support(adj), {}, {}
        for method, k, kappa in ((c["method"], _whole(c["k"]), _whole(c["kappa"])) for c in r.asked):
            began, nodes, status = time.perf_counter(), None, "not_run"
            if method == "avgdeg":
                value, found = kernels.avgdeg_anchored(adj, q)
            else:
                told = branching.densest(adj, q, k, kappa or 0, limits, None, shared)
                value, found, nodes, status = told["density"], set(told["nodes"]), told["bb_nodes"], told["gap_status"]
            key, actual, spent = frozenset(found), None, time.perf_counter() - began
            if q in found:
                if key not in linked:
                    linked[key] = kernels.edge_connectivity(und, found, q)
                actual = linked[key]
            # As ``kappa_verify``: q alone holds no connectivity of one or more.
            yield (
                int(r.n), r.p, int(r.seed), method, k, kappa, float(value), sorted(found), len(found), actual, q in found and actual >= (kappa or 0), status,
                status not in ("not_run", "exhausted"), nodes, spent, 0,
            )

    def solve(rows):
        return pd.DataFrame([x for r in rows.itertuples() for x in one(r)], columns=names)

    return _once(_arcs(edges), cells, solve, RUN)


def compare(cells: DataFrame, runs: DataFrame, best: DataFrame, tol: float = 1e-9) -> DataFrame:
    """Cells with their runs, matched against the first optimum and, for ``avgdeg``, that of connected sets as the second."""
    names = [f.split()[0] for f in RUN.split(", ")]
    by = [*KEYS, "method", "k", "kappa"]
    ran = runs.select(*(F.col(c).alias(f"_{c}") if c in by else F.col(c) for c in names))
    second = best.where("optimum_kind = 'avgdeg_connected'").select(*(F.col(c).alias(f"_{c}") for c in KEYS), *(F.col(c).alias(f"{c}_secondary") for c in ("opt_value", "opt_size", "opt_nodes", "opt_kappa")))

    def same(keys):
        on = F.lit(True)
        for c in keys:
            on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
        return on

    both = cells.join(ran, same(by), "left").drop(*(f"_{c}" for c in by))
    both = both.join(second, same(KEYS) & (F.col("method") == "avgdeg"), "left").drop(*(f"_{c}" for c in KEYS))
    return bf_compare(both, tol)


def verify(meta: DataFrame, edges: DataFrame, ks=(3, 4, 5), kappas=(0, 1, 2), limits: branching.Limits = branching.Limits(), tol: float = 1e-9) -> DataFrame:  # noqa: B008
    """Every cell of every graph, solved and compared with its enumerated optimum; cells without a feasible set are skipped, not solved."""
    best = cut(optima(meta, edges, ks, kappas))
    cells = cut(solver_cells(meta, best, ks, kappas))
    return compare(cells, cut(solver_runs(cells.where("status = 'ran'"), edges, limits)), best, tol)


def _kept(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``, or an empty one."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def _append(fresh: DataFrame, path: str, schema: str) -> DataFrame:
    fresh.write.mode("append").parquet(path)
    return _kept(fresh.sparkSession, path, schema)


def verify_tree(spark: SparkSession, root: str, out: str | None = None, ks=(3, 4, 5), kappas=(0, 1, 2), seeds: list[int] | None = None, limits: branching.Limits = branching.Limits(), tol: float = 1e-9) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """Checks of all graphs in the folder tree ``root`` and their summary, with ``optima`` and ``solver_runs`` kept as tables under ``out``.

    What these tables have already, from a run that was cut off or had fewer seeds or cells, is not computed again.
    """
    out = out or f"{shared_dir(spark)}/verify"
    meta, edges = scan_synthetic_tree(spark, root, seeds)
    meta, edges = cut(_typed(meta)), cut(edges)
    wanted = meta.withColumn("k", F.explode(F.array(*(F.lit(k) for k in ks)))).withColumn("kappa", F.explode(F.array(*(F.lit(x) for x in sorted({0, *kappas})))))
    have = _kept(spark, f"{out}/optima", OPTIMA)
    missing = wanted.join(have.select(*KEYS, "k", "kappa"), [*KEYS, "k", "kappa"], "left_anti").select(*meta.columns).distinct()
    best = _append(cut(optima(missing, edges, ks, kappas)), f"{out}/optima", OPTIMA).dropDuplicates([*KEYS, "optimum_kind", "k", "kappa"])
    best = cut(best.join(meta.select(*KEYS), KEYS, "left_semi"))
    cells = cut(solver_cells(meta, best, ks, kappas))
    by = [*KEYS, "method", "k", "kappa"]
    done = _kept(spark, f"{out}/solver_runs", RUN).select(*(F.col(c).alias(f"_{c}") for c in by))
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    todo = cut(cells.where("status = 'ran'").join(done, on, "left_anti"))
    runs = _append(cut(solver_runs(todo, edges, limits)), f"{out}/solver_runs", RUN).dropDuplicates(by)
    checks = cut(compare(cells, runs, best, tol))
    return checks, bf_summary(checks)
