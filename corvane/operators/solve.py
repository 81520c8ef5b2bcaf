"""Kernels over many queries: one group of revealed arcs per query, solved where it lies."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import branching, kernels

from . import expand
from .expand import bfs_ball, induced_edges, revealed


def reveal(edges: DataFrame, queries: DataFrame, depth: int = -1, max_in_edges: int = 0) -> DataFrame:
    """``query, source, target``: arcs among the nodes that each query reaches (all of them, if ``depth`` is negative)."""
    inside = induced_edges(edges, bfs_ball(revealed(edges, max_in_edges), queries, depth))
    return queries.select("query").join(inside, "query", "left")


def _solve(shown: DataFrame, solve, schema: str) -> DataFrame:
    def one(key, pdf):
        q = int(key[0])
        pdf = pdf.dropna()
        adj = kernels.adjacency(zip(pdf.source.astype(int), pdf.target.astype(int), strict=True))
        adj.setdefault(q, set())
        return pd.DataFrame(solve(adj, q))

    tasks = 4 * int(shown.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes and long searches, which would else be put together
    return shown.repartition(tasks, "query").groupBy("query").applyInPandas(one, schema)


def dense_communities(shown: DataFrame, ks=(3, 4, 5), kappas=(0, 1, 2), limits: branching.Limits = branching.Limits()) -> DataFrame:  # noqa: B008
    """Densest community for each query, size floor and connectivity; infeasible: density 0 and no nodes."""

    def solve(adj, q):
        for k in ks:
            for kappa in kappas:
                r = branching.densest(adj, q, k, kappa, limits)
                n = len(r["nodes"])
                yield {"query": q, "k": k, "kappa": kappa, "density": float(r["density"]), "size": n, "nodes": r["nodes"], "bb_nodes": r["bb_nodes"], "gap_status": r["gap_status"], "bb_best_bound": r["bound"], "optimality_gap": r["gap"], "open_bb_nodes": r["open"], "trajectory": r["trajectory"], "iterations": [{c: row[c] for c in ("iteration", "lambda", "value", "size", "bb_nodes", "cuts")} for row in r["iterations"]]}

    trace = "trajectory array<struct<bb_node:long,density:double,size:long,nodes:array<long>>>"
    return _solve(shown, lambda a, q: list(solve(a, q)), f"query long, k int, kappa int, density double, size long, nodes array<long>, bb_nodes long, gap_status string, bb_best_bound double, optimality_gap double, open_bb_nodes long, {trace}, iterations array<struct<iteration:long,lambda:double,value:double,size:long,bb_nodes:long,cuts:long>>")


def average_degree_communities(shown: DataFrame) -> DataFrame:
    def solve(adj, q):
        value, s = kernels.avgdeg_anchored(adj, q)
        return [{"query": q, "avg_degree": float(value), "size": len(s), "nodes": sorted(s)}]

    return _solve(shown, solve, "query long, avg_degree double, size long, nodes array<long>")


def grown_communities(arcs: DataFrame, queries: DataFrame, k: int = 5, depth: int = 1) -> DataFrame:
    """``query, size, nodes, asked``: each query's ball of ``depth`` hops grown to ``k`` nodes, by the rule of ``kernels.grow_to_k``.

    One join a step for all queries at once: the known neighbour with most known links into a community joins it, is asked,
    and what it mentions becomes known. A step reads the arcs of the nodes that joined in it, so work goes with queries x k.
    """
    arcs = expand.cut(arcs.select("node", "neighbour", "side", "ord"))
    known = expand.cut(expand.discovery_ordinals(arcs, queries, depth + 1))
    members = known.where(F.col("distance") <= depth).select("query", "node")
    known = known.select("query", "node", "ordinal")

    def told(asked: DataFrame) -> DataFrame:
        return asked.join(arcs, "node").where("node <> neighbour")

    def links(said: DataFrame) -> DataFrame:
        both = F.explode(F.array(F.struct(F.col("node").alias("u"), F.col("neighbour").alias("v")), F.struct(F.col("neighbour").alias("u"), F.col("node").alias("v"))))
        return said.select("query", both.alias("l")).select("query", "l.u", "l.v").distinct()

    every = expand.cut(links(told(members)))
    for _ in range(k):
        small = members.groupBy("query").agg(F.count("*").alias("n")).where(F.col("n") < k).select("query")
        inside = members.join(small, "query")
        near = every.join(inside.select("query", F.col("node").alias("u")), ["query", "u"]).join(members.select("query", F.col("node").alias("v")), ["query", "v"], "left_anti")
        gain = near.groupBy("query", F.col("v").alias("node")).agg(F.countDistinct("u").alias("gain")).join(known, ["query", "node"])
        fresh = expand.cut(gain.groupBy("query").agg(F.min_by("node", F.struct((-F.col("gain")).alias("g"), "ordinal")).alias("node")))
        if fresh.isEmpty():
            break
        said = told(fresh)
        first = said.groupBy("query", F.col("neighbour").alias("node")).agg(F.min(F.struct("side", "ord")).alias("at")).join(known.select("query", "node"), ["query", "node"], "left_anti")
        so_far = known.groupBy("query").agg(F.max("ordinal").alias("top"))
        place = F.col("top") + F.row_number().over(Window.partitionBy("query").orderBy("at", "node"))
        known = known.union(expand.cut(first.join(so_far, "query").select("query", "node", place.cast("long").alias("ordinal"))))
        every = every.union(expand.cut(links(said)))
        members = members.union(fresh.select("query", "node"))
    return members.groupBy("query").agg(F.count("*").alias("size"), F.array_sort(F.collect_list("node")).alias("nodes"), F.count("*").alias("asked"))


def grown_sets(shown: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """``query, node``: communities ``(query, node)`` grown to ``k`` nodes over all arcs shown (``query, source, target``).

    The neighbour with most links into a community joins it, one join a step for all queries that lack nodes; of equals
    the one that a search from the query mentions first.
    """
    members = expand.cut(members.select("query", "node").distinct())
    small = members.groupBy("query").agg(F.count("*").alias("n")).where(F.col("n") < k).select("query")
    if small.isEmpty():
        return members
    arcs = expand.cut(shown.join(small, "query", "left_semi").where("source <> target").select("query", "source", "target").distinct())
    links = expand.cut(arcs.select("query", F.col("source").alias("u"), F.col("target").alias("v")).union(arcs.select("query", "target", "source")).distinct())
    told = arcs.select(F.col("source").alias("node"), F.col("target").alias("neighbour"), F.lit(1).alias("side"), F.col("target").alias("ord")).distinct()
    known = expand.cut(expand.discovery_ordinals(told, small, 1 << 20).select("query", "node", "ordinal"))
    for _ in range(k):
        lack = members.join(small, "query").groupBy("query").agg(F.count("*").alias("n")).where(F.col("n") < k).select("query")
        inside = members.join(lack, "query")
        near = links.join(inside.select("query", F.col("node").alias("u")), ["query", "u"]).join(members.select("query", F.col("node").alias("v")), ["query", "v"], "left_anti")
        gain = near.groupBy("query", F.col("v").alias("node")).agg(F.count("*").alias("gain")).join(known, ["query", "node"], "left")
        first = F.struct((-F.col("gain")).alias("g"), F.col("ordinal").isNull().alias("late"), F.col("ordinal").alias("o"), F.col("node").alias("n"))
        fresh = expand.cut(gain.groupBy("query").agg(F.min_by("node", first).alias("node")))
        if fresh.isEmpty():
            break
        members = members.union(fresh)
    return members


def grown_balls(edges: DataFrame, queries: DataFrame, depth: int, k: int = 1, max_in_edges: int = 0) -> DataFrame:
    """``query, nodes, gap_status`` of balls grown to ``k``."""
    grown = grown_communities(expand.revealed(edges, max_in_edges), queries, k, depth)
    return grown.select("query", "size", "nodes", F.lit("not_run").alias("gap_status"))


def inside(edges: DataFrame, members: DataFrame) -> DataFrame:
    """``query, source, target``: arcs inside each community; a node without any has a row with itself, so it is known."""
    own = members.select("query", F.col("node").alias("source"), F.col("node").alias("target"))
    return expand.listed_edges(edges, members).unionByName(own)


def optima(shown: DataFrame, ks=(3, 4), kappas=(0, 1, 2)) -> DataFrame:
    """Enumerated optima of small graphs, one row a kind and cell: pair density for each floor and connectivity, and average degree. Infeasible: -1."""

    def solve(adj, q):
        for kind, k, kappa, value, s in kernels.enumerate_optima(adj, q, ks, kappas):
            yield {"query": q, "optimum_kind": kind, "k": k, "kappa": kappa, "opt_value": float(value), "opt_size": len(s) or None, "opt_nodes": sorted(s)}

    return _solve(shown, lambda a, q: list(solve(a, q)), "query long, optimum_kind string, k int, kappa int, opt_value double, opt_size long, opt_nodes array<long>")


def cut_qualities(shown: DataFrame) -> DataFrame:
    """Edge connectivity, normalised cut, second eigenvalue and bridge-free size of each query's revealed graph."""

    def solve(adj, q):
        und, s = kernels.support(adj), set(adj)
        return [{
            "query": q, "edge_connectivity": kernels.global_min_cut(und, s)[0], "ncut": round(kernels.internal_ncut(und, s), 9), "lambda2": round(kernels.algebraic_connectivity(und, s), 9),
            "bridge_free_size": len(kernels.bridge_free_component(und, q)), "two_connected": kernels.kappa_verify(und, s, q, 2),
        }]

    return _solve(shown, solve, "query long, edge_connectivity long, ncut double, lambda2 double, bridge_free_size long, two_connected boolean")


def internal_ncuts(edges: DataFrame, members: DataFrame) -> DataFrame:
    """``query, int_ncut``: the normalised minimum cut of each community's own links; 0 where it falls apart."""

    def solve(adj, q):
        return [{"query": q, "int_ncut": kernels.internal_ncut(kernels.support(adj), set(adj))}]

    return _solve(inside(edges, members), solve, "query long, int_ncut double")


def without_trees(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """Arcs without the trees that hang from the rest: nodes with one neighbour are taken off, round by round.

    No cycle and no path between nodes that stay is lost, after however many rounds; they end where one takes off hardly anything.
    """
    links = expand.cut(expand.undirected(edges))
    before = links.count()
    for _ in range(rounds):
        ends = links.groupBy("node").agg(F.count("*").alias("n")).where("n < 2").select("node")
        after = expand.cut(links.join(ends, "node", "left_anti").join(ends.withColumnRenamed("node", "neighbour"), "neighbour", "left_anti").select("node", "neighbour"))
        links, left = after, after.count()
        if before - left <= before // 100:
            break
        before = left
    keep = links.select("node").distinct()
    plain = edges.where("source <> target").select("source", "target").distinct()
    return plain.join(keep.withColumnRenamed("node", "source"), "source", "left_semi").join(keep.withColumnRenamed("node", "target"), "target", "left_semi").select("source", "target")


def query_pool(edges: DataFrame, least: int = 5) -> DataFrame:
    """Pure sources whose bridge-free component in what they reach has at least ``least`` nodes.

    Only what lies on cycles or between them is revealed, and only to sources with two links into it, one of them to a node that
    has arcs itself: others reveal a star at most. Of those, what a source reveals is searched only if it is no tree.
    """
    if least < 2:
        raise ValueError("a pool needs components of two nodes or more")
    core = expand.cut(without_trees(edges))
    able = core.groupBy(F.col("source").alias("query")).agg(F.count("*").alias("n")).where("n > 1").select("query")
    onward = core.join(core.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select(F.col("source").alias("query")).distinct()
    able = able.join(onward, "query", "left_semi")
    asked = expand.cut(expand.pure_sources(edges).join(able, "query", "left_semi"))

    def solve(adj, q):
        return [{"query": q, "bridge_free_size": len(kernels.bridge_free_component(kernels.support(adj), q))}]

    ball = expand.cut(bfs_ball(revealed(core), asked, -1))
    shown = expand.cut(induced_edges(core, ball))
    links = shown.select("query", F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v")).distinct().groupBy("query").agg(F.count("*").alias("links"))
    cyclic = ball.groupBy("query").agg(F.count("*").alias("nodes")).join(links, "query").where("links >= nodes")
    return _solve(shown.join(cyclic.select("query"), "query", "left_semi"), solve, "query long, bridge_free_size long").where(F.col("bridge_free_size") >= least)
