"""Neighbourhood expansion, many queries at once, as joins.

Communities and frontiers are long tables ``(query, node)``. Loops write each layer as a table of its own (``cut``) and
put the layers together at the end, so nothing is written twice and lost executors cost one layer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.session import cut, tasks_for


def revealed(edges: DataFrame, max_in_edges: int = 0) -> DataFrame:
    """Arcs that queries of nodes show, as ``(node, neighbour, side, ord)``: successors (side 1), and the first predecessors up to a cap (side 0; 0: none).

    ``ord`` is the order of edges in their source, where known, else that of the neighbours.
    """
    order = F.col("edge_ord") if "edge_ord" in edges.columns else None
    out = edges.select(F.col("source").alias("node"), F.col("target").alias("neighbour"), F.lit(1).alias("side"), (F.col("target") if order is None else order).alias("ord"))
    if max_in_edges:
        w = Window.partitionBy("target").orderBy("source" if order is None else "edge_ord")
        ins = edges.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max_in_edges)
        out = out.union(ins.select(F.col("target").alias("node"), F.col("source").alias("neighbour"), F.lit(0).alias("side"), (F.col("source") if order is None else order).alias("ord")))
    return out


def oracle_counts(arcs: DataFrame, asked: DataFrame) -> DataFrame:
    """``query, queries_made, misses``: how often each query asked for a node (``query, node``), and how many nodes no one had asked for earlier.

    Answers are remembered over all queries, in their order: a node is a miss for the first query that asks for it.
    """
    first = asked.groupBy("node").agg(F.min("query").alias("query")).groupBy("query").agg(F.count("*").alias("misses"))
    return asked.groupBy("query").agg(F.countDistinct("node").alias("queries_made")).join(first, "query", "left").na.fill(0, ["misses"])


def frontier_expand(arcs: DataFrame, frontier: DataFrame, visited: DataFrame, tasks: int = 0) -> DataFrame:
    """One layer: neighbours of ``frontier (query, node)`` that are not in ``visited``; ``tasks`` that they are dealt over, where given."""
    step = frontier.join(arcs, "node").select("query", F.col("neighbour").alias("node"))
    step = (step.repartition(tasks, "query", "node") if tasks else step).distinct()
    return step.join(visited, ["query", "node"], "left_anti")


def _together(layers: list[DataFrame]) -> DataFrame:
    whole = layers[0]
    for layer in layers[1:]:
        whole = whole.union(layer)
    return whole


def bfs_distances(arcs: DataFrame, queries: DataFrame, depth: int = -1, forbidden: DataFrame | None = None) -> DataFrame:
    """``query, node, distance``: hops from each query, up to ``depth`` (negative: all), never entering forbidden nodes.

    A query itself is always expanded.
    """
    arcs = arcs.select("node", "neighbour")
    if forbidden is not None:
        arcs = arcs.join(forbidden.select(F.col("node").alias("neighbour")), "neighbour", "left_anti").select("node", "neighbour")
    arcs = cut(arcs.distinct()) if depth < 0 or depth > 1 else arcs
    layers, degree = [queries.select("query", F.col("query").alias("node"), F.lit(0).alias("distance"))], 0.0
    while depth < 0 or len(layers) <= depth:
        if len(layers) == 2:
            degree = arcs.count() / max(1, arcs.select("node").distinct().count())
        tasks = tasks_for(arcs.sparkSession, layers[-1].count() * degree) if degree else 0  # by a mean, which sizes tasks only
        step = frontier_expand(arcs, layers[-1].select("query", "node"), _together(layers).select("query", "node"), tasks)
        layer = step.withColumn("distance", F.lit(len(layers)))
        if len(layers) == depth:  # no layer follows: nothing to write
            layers.append(layer)
            break
        layer = cut(layer)
        if layer.isEmpty():
            break
        layers.append(layer)
    return _together(layers)


def bfs_ball(arcs: DataFrame, queries: DataFrame, depth: int = 1) -> DataFrame:
    """Closed ball of ``depth`` hops: ``query, node``."""
    if depth == 1:  # one pass, without a visited set
        near = queries.join(arcs, F.col("query") == F.col("node")).select("query", F.col("neighbour").alias("node"))
        return near.union(queries.select("query", F.col("query").alias("node"))).distinct()
    return bfs_distances(arcs, queries, depth).select("query", "node")


def reach_counts(arcs: DataFrame, queries: DataFrame) -> DataFrame:
    """``query, reached``: how many nodes each query reaches, itself included.

    Every weak component has a landmark. Who reaches it reaches all that it reaches, so these nodes are found once and counted
    for all such queries. Queries among them have their answer; the others that reach it look for what lies outside of them, and
    only those that do not reach it look for all.
    """
    arcs = cut(arcs.select("node", "neighbour").where("node <> neighbour").distinct())
    queries = cut(queries.select("query").distinct())
    edges = arcs.select(F.col("node").alias("source"), F.col("neighbour").alias("target"))
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    degree = cut(ends.groupBy("e.node").agg(F.least(F.sum("e.o"), F.sum("e.i")).alias("d")))
    parts = cut(weak_components(edges, degree.select(F.lit(0).alias("query"), "node")).select("node", "component"))
    wanted = parts.join(queries.withColumnRenamed("query", "node"), "node", "left_semi").select("component").distinct()
    marks = cut(parts.join(wanted, "component", "left_semi").join(degree, "node").groupBy("component").agg(F.max_by("node", F.struct("d", "node")).alias("query")).select("query"))
    ahead = cut(bfs_ball(arcs, marks, -1).select(F.col("query").alias("mark"), "node"))
    behind = cut(bfs_ball(arcs.select(F.col("neighbour").alias("node"), F.col("node").alias("neighbour")), marks, -1).select(F.col("query").alias("mark"), "node"))
    size = ahead.groupBy("mark").agg(F.count("*").alias("n"))
    known = ahead.select(F.col("node").alias("query"), F.lit(True).alias("inside"))
    able = cut(queries.join(behind.withColumnRenamed("node", "query"), "query").join(size, "mark").join(known, "query", "left").select("query", "n", "inside"))
    outer = able.where("inside IS NULL")
    beyond = bfs_distances(arcs, outer, -1, ahead.select("node")).groupBy("query").agg(F.count("*").alias("more"))
    rest = bfs_ball(arcs, cut(queries.join(able, "query", "left_anti")), -1).groupBy("query").agg(F.count("*").alias("reached"))
    found = able.where("inside").select("query", F.col("n").alias("reached"))
    return found.union(outer.join(beyond, "query").select("query", F.col("n") + F.col("more"))).union(rest)


def discovery_ordinals(arcs: DataFrame, queries: DataFrame, depth: int = 1) -> DataFrame:
    """``query, node, distance, ordinal``: dense numbers of first mention, up to ``depth`` hops.

    Nodes are asked in the order they were mentioned; each mentions its predecessors, then its successors, in file order.
    """
    arcs = cut(arcs.select("node", "neighbour", "side", "ord"))
    layers = [queries.select("query", F.col("query").alias("node"), F.lit(0).alias("distance"), F.lit(0).cast("long").alias("ordinal"))]
    while len(layers) <= depth:
        before = _together(layers)
        said = layers[-1].join(arcs, "node").groupBy("query", F.col("neighbour").alias("node")).agg(F.min(F.struct("ordinal", "side", "ord")).alias("at"))
        fresh = said.join(before.select("query", "node"), ["query", "node"], "left_anti")
        known = before.groupBy("query").agg(F.count("*").alias("_n"))
        place = F.col("_n") + F.row_number().over(Window.partitionBy("query").orderBy("at", "node")) - 1
        layer = cut(fresh.join(known, "query").select("query", "node", F.lit(len(layers)).alias("distance"), place.cast("long").alias("ordinal")))
        if layer.isEmpty():
            break
        layers.append(layer)
    return _together(layers)


def induced_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """``query, source, target`` with both ends in the query's community."""
    inside = edges.join(members.select("query", F.col("node").alias("source")), "source")
    return inside.join(members.select("query", F.col("node").alias("target")), ["query", "target"], "left_semi").select("query", "source", "target")


def boundary_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """``query, source, target`` that leave the query's community."""
    inside = edges.join(members.select("query", F.col("node").alias("source")), "source")
    return inside.join(members.select("query", F.col("node").alias("target")), ["query", "target"], "left_anti").select("query", "source", "target")


#: Members of a community that one list holds, and arcs of a node.
LISTED = 512


def member_arcs(edges: DataFrame, members: DataFrame, listed: Column | None = None) -> DataFrame:
    """``query, source, targets, inner, degree``: the arcs from each member as lists, all targets and those in the member's own community.

    An arc travels as one number in its source's list, to the list of the community, and not as a row. Communities of more than
    ``LISTED`` members are marked arc by arc, each target a list of its own; a node's arcs come in lists of about ``LISTED``.
    ``listed`` (of ``source`` and ``target``): arcs that are listed; the others are counted in ``degree`` only.
    """
    told = F.col("target") if listed is None else F.when(listed, F.col("target"))
    members = cut(members.select("query", "node"))
    size = members.groupBy("query").agg(F.count("*").alias("_n"))
    large = size.where(F.col("_n") > LISTED).select("query")
    degree = F.count("*").over(Window.partitionBy("source"))
    lists = edges.select("source", "target").withColumn("_at", F.pmod(F.xxhash64("target"), F.floor(degree / LISTED) + 1)).groupBy("source", "_at").agg(F.collect_list(told).alias("targets"), F.count("*").alias("degree")).drop("_at")
    of = members.withColumnRenamed("node", "source")
    balls = members.join(large, "query", "left_anti").groupBy("query").agg(F.collect_list("node").alias("_nodes"))  # at most LISTED
    few = lists.join(of, "source").join(balls, "query")
    few = few.select("query", "source", "targets", F.filter("targets", lambda t: F.array_contains("_nodes", t)).alias("inner"), "degree")
    inside = members.select("query", F.col("node").alias("target"), F.lit(True).alias("_in"))
    many = edges.select("source", "target").join(of.join(large, "query", "left_semi"), "source").join(inside.join(large, "query", "left_semi"), ["query", "target"], "left")
    one = F.array_compact(F.array(told))
    return few.union(many.select("query", "source", one.alias("targets"), F.when(F.col("_in"), one).otherwise(F.slice(one, 1, 0)).alias("inner"), F.lit(1).cast("long").alias("degree")))


def listed_edges(edges: DataFrame, members: DataFrame, inside: bool = True) -> DataFrame:
    """``induced_edges``, or ``boundary_edges`` if not ``inside``, of many small communities."""
    told = member_arcs(edges, members)
    ends = F.col("inner") if inside else F.filter("targets", lambda t: ~F.array_contains("inner", t))
    return told.select("query", "source", F.explode(ends).alias("target"))


def support_links(edges: DataFrame) -> DataFrame:
    """Unordered pairs with an arc in either direction, without self-loops."""
    return edges.where("source <> target").select(F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v")).distinct()


def undirected(edges: DataFrame, distinct: bool = True) -> DataFrame:
    """Both directions of each edge as ``(node, neighbour)``; with duplicates if not ``distinct``."""
    both = edges.select(F.col("source").alias("node"), F.col("target").alias("neighbour")).union(edges.select("target", "source"))
    return both.where("node <> neighbour").distinct() if distinct else both


def pure_sources(edges: DataFrame) -> DataFrame:
    """Sources that are never a target."""
    return edges.select(F.col("source").alias("query")).subtract(edges.select("target"))


def reciprocal_edges(edges: DataFrame) -> DataFrame:
    """Edges whose reverse is present."""
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target")).distinct()
    return edges.join(back, ["source", "target"], "left_semi")


def in_triangle(edges: DataFrame) -> DataFrame:
    """Nodes that lie in an undirected triangle. Links point from the end with fewer links, so a hub's links are not paired with each other."""
    links = cut(support_links(edges))
    degree = links.select(F.explode(F.array("u", "v")).alias("n")).groupBy("n").agg(F.count("*").alias("d"))
    both = links.join(degree.toDF("u", "du"), "u").join(degree.toDF("v", "dv"), "v")
    up = F.struct("du", "u") < F.struct("dv", "v")
    lead = cut(both.select(F.when(up, F.col("u")).otherwise(F.col("v")).alias("a"), F.when(up, F.col("v")).otherwise(F.col("u")).alias("b")))
    wedges = lead.join(lead.select("a", F.col("b").alias("c")), "a").where("b < c")
    closed = links.select(F.col("u").alias("b"), F.col("v").alias("c"))
    return wedges.join(closed, ["b", "c"], "left_semi").select(F.explode(F.array("a", "b", "c")).alias("node")).distinct()


def weak_components(edges: DataFrame, members: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``query, node, component``: smallest node reachable inside the community, ignoring direction.

    By large and small stars in turn: links are rewired to the least node known, so paths halve and few rounds are needed.
    """
    inside = induced_edges(edges, members).where("source <> target")
    links = cut(inside.select("query", F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v")).distinct())
    for _ in range(max_rounds):
        both = links.union(links.select("query", F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("query", "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, ["query", "u"]).where("v > u").select("query", F.col("m").alias("u"), "v").where("u < v").distinct()
        low = large.groupBy("query", "v").agg(F.min("u").alias("m"))
        small = large.join(low, ["query", "v"]).select("query", F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v")).where("u < v").distinct()
        after = cut(small)
        mark = [F.count("*").alias("n"), F.sum(F.xxhash64("query", "u", "v").cast("decimal(38,0)")).alias("s")]
        same, links = after.agg(*mark).first() == links.agg(*mark).first(), after
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = links.select("query", F.col("v").alias("node"), F.col("u").alias("component"))
    return members.select("query", "node").join(roots, ["query", "node"], "left").select("query", "node", F.coalesce("component", "node").alias("component"))
