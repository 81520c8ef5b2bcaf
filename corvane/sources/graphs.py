"""Graphs as DataFrames: ``edges(source, target[, edge_ord])`` and ``nodes(node_id, label, train, val, test)``.

Readers keep the file's order in ``edge_ord`` (first come, first kept under an in-edge cap) and duplicates.
The views make graphs of the star-schema tables; their SQL runs on other engines too.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.session import cut, tasks_for

#: Parts that follow one another in an order.
PART_EDGES = """SELECT DISTINCT source, target FROM (
  SELECT l_partkey AS source, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS target FROM lineitem
) x WHERE target IS NOT NULL AND source <> target"""
PART_NODES = "SELECT p_partkey AS node_id, p_size % 7 AS label, p_partkey % 5 <> 0 AS train, p_partkey % 10 = 0 AS val, p_partkey % 10 = 5 AS test FROM part"
#: Each nation's five best customers abroad.
NATION_EDGES = """SELECT source, target FROM (
  SELECT CAST(s_nationkey AS BIGINT) AS source, CAST(c_nationkey AS BIGINT) AS target,
    row_number() OVER (PARTITION BY s_nationkey ORDER BY count(*) DESC, c_nationkey) AS r
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE s_nationkey <> c_nationkey GROUP BY s_nationkey, c_nationkey) x WHERE r <= 5"""
NATION_NODES = "SELECT CAST(n_nationkey AS BIGINT) AS node_id, n_regionkey AS label, n_nationkey % 5 <> 0 AS train, n_nationkey % 10 = 0 AS val, n_nationkey % 10 = 5 AS test FROM nation"
#: Users whose events of one type follow one another in a session of events, and the types each user has most of.
FOLLOW_EDGES = """SELECT DISTINCT source, target FROM (
  SELECT CAST(user_id AS BIGINT) AS source, CAST(lead(user_id) OVER (PARTITION BY event_type ORDER BY event_id) AS BIGINT) AS target FROM events
) x WHERE target IS NOT NULL AND source <> target"""
FOLLOW_NODES = """SELECT user_id AS node_id, CAST(label AS INT) AS label, user_id % 5 <> 0 AS train, user_id % 10 = 0 AS val, user_id % 10 = 5 AS test FROM (
  SELECT CAST(user_id AS BIGINT) AS user_id, CAST(max(event_id) % 7 AS INT) AS label FROM events GROUP BY user_id) x"""
#: Small graphs: the lines of each sixteen orders link eight nodes. A graph's query is the node of most arcs, of equals the largest.
BLOCK = 8
BLOCK_ARCS = """SELECT DISTINCT CAST(floor(l_orderkey / 16.0) AS INT) AS seed, CAST(l_partkey % 8 AS BIGINT) AS source, CAST(l_suppkey % 8 AS BIGINT) AS target
  FROM lineitem WHERE l_partkey % 8 <> l_suppkey % 8"""
BLOCK_META = f"""SELECT 8 AS n, floor(4 * m / 56.0) / 4 AS p, seed, query_node FROM (
  SELECT seed, node AS query_node, sum(d) OVER (PARTITION BY seed) / 2 AS m, row_number() OVER (PARTITION BY seed ORDER BY d DESC, node DESC) AS r FROM (
    SELECT seed, node, count(*) AS d FROM (SELECT seed, source AS node FROM ({BLOCK_ARCS}) a UNION ALL SELECT seed, target FROM ({BLOCK_ARCS}) b) c GROUP BY seed, node) d_) e WHERE r = 1"""
VIEWS = {"part": (PART_EDGES, PART_NODES), "nation": (NATION_EDGES, NATION_NODES), "follow": (FOLLOW_EDGES, FOLLOW_NODES)}


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names or ("lineitem", "orders", "customer", "supplier", "part", "nation", "region", "events"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def graph_view(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Edges and nodes of a view, written once: operators read edges several times."""
    tables(spark, sf_dir)
    edges, nodes = VIEWS[name]
    return cut(spark.sql(edges)), spark.sql(nodes)


def block_graphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``meta (n, p, seed, query_node)`` and ``edges (n, p, seed, source, target)`` of many small graphs; p is the share of arcs in quarters."""
    tables(spark, sf_dir, "lineitem")
    meta = cut(spark.sql(BLOCK_META).selectExpr("n", "CAST(p AS DOUBLE) AS p", "seed", "query_node"))
    return meta, cut(spark.sql(BLOCK_ARCS).join(meta.select("n", "p", "seed"), "seed").select("n", "p", "seed", "source", "target"))


class Oracle(Protocol):
    """A source of a graph that is asked node by node: many at once, as a join."""

    def query(self, asked: DataFrame) -> DataFrame:
        """For ``asked (query, node)``: ``query, node, neighbour, side, ord``; predecessors have side 0, successors 1."""
        ...


@dataclass
class TableOracle:
    """An oracle over a table of edges; ``max_in_edges`` caps the predecessors it tells, first come first."""

    edges: DataFrame
    max_in_edges: int = 0

    def query(self, asked: DataFrame) -> DataFrame:
        from corvane.operators.expand import revealed

        return asked.join(revealed(self.edges, self.max_in_edges), "node").select("query", "node", "neighbour", "side", "ord")


@dataclass(frozen=True)
class GraphContext:
    """What an evaluation needs of a graph: directed and undirected arcs, and those that fallback votes walk on."""

    directed: DataFrame
    undirected: DataFrame
    fallback: DataFrame


def build_graph_context(edges: DataFrame, max_in_edges: int = 0) -> GraphContext:
    """Arcs without self-loops. Without in-edges the fallback walks successors only, else both directions."""
    from corvane.operators.expand import undirected

    plain = edges.where("source <> target")
    directed = cut(plain.select(F.col("source").alias("node"), F.col("target").alias("neighbour")).distinct())
    both = cut(undirected(edges))
    return GraphContext(directed, both, both if max_in_edges else directed)


def sim_dataset(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Undirected neighbour lists with duplicates, successor lists, and one row of class count and total volume.

    Links are dealt over tasks by their number, so a task's lists do not grow with the table.
    """
    order = "edge_ord" if "edge_ord" in edges.columns else "neighbour"
    both = edges.select(F.col("source").alias("node"), F.col("target").alias("neighbour"), *(["edge_ord"] if order == "edge_ord" else []), F.lit(1).alias("out"))
    both = both.unionByName(both.select(F.col("neighbour").alias("node"), F.col("node").alias("neighbour"), *(["edge_ord"] if order == "edge_ord" else []), F.lit(0).alias("out")))
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "neighbour"))), lambda x: x.neighbour)
    both = both.repartition(tasks_for(edges.sparkSession, 2 * edges.count()), "node")
    total = nodes.agg((F.max("label") + 1).alias("num_classes")).crossJoin(edges.agg((2 * F.count("*")).alias("total_volume")))  # one row each
    return both.groupBy("node").agg(listed.alias("neighbours")), both.where("out = 1").groupBy("node").agg(listed.alias("successors")), total


def read_edges_csv(spark: SparkSession, path: str) -> DataFrame:
    """``source, target`` strings and ``edge_ord``: each file's header dropped, cut at the first comma, lines without one skipped.

    Lines are numbered within the stretches that tasks read, and the stretches by file and place: only one row a stretch
    meets in one place.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    lines = cut(lines)
    stretches = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    order = Window.orderBy("file", "block")  # one row a stretch
    stretches = stretches.withColumn("base", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    numbered = lines.join(F.broadcast(stretches), ["file", "block"])  # about one row for each 128 MB of input
    numbered = numbered.select("value", (F.col("base") + F.col("id") - F.col("first")).alias("edge_ord"), ((F.col("block") == 0) & (F.col("id") == F.col("first"))).alias("header"))
    body = numbered.where("NOT header").select(F.regexp_replace("value", "\r$", "").alias("value"), "edge_ord")
    at = F.locate(",", "value")
    return body.where(at > 0).select(F.expr("substring(value, 1, locate(',', value) - 1)").alias("source"), F.expr("substring(value, locate(',', value) + 1)").alias("target"), "edge_ord")


def first_two_columns(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges from the first two columns, whatever their names, without self-loops; and the sorted nodes."""
    edges = df.select(F.col(df.columns[0]).alias("source"), F.col(df.columns[1]).alias("target")).where("source <> target")
    nodes = edges.select(F.col("source").alias("node_id")).union(edges.select("target")).distinct().orderBy("node_id")
    return edges, nodes


def read_nodes_csv(spark: SparkSession, path: str) -> DataFrame:
    """Labels and split of each node; flags may be text; train comes before val before test."""
    df = spark.read.option("header", True).csv(path)
    flag = lambda c: F.lower(F.trim(c)) == "true" if c in df.columns else F.lit(False)
    split = F.when(flag("train"), "train").when(flag("val"), "val").when(flag("test"), "test").otherwise("unlabeled")
    return df.select(F.col("node_id").cast("long").alias("node_id"), F.col("label").cast("int").alias("label"), split.alias("split"))


def existing_export(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every id from 0 to the largest seen, with label 0 where none is given."""
    top = edges.select(F.greatest("source", "target").alias("m")).union(nodes.select("node_id")).agg(F.max("m").alias("m")).first().m
    ids = edges.sparkSession.range(0 if top is None else top + 1).select(F.col("id").alias("node_id"))
    return ids.join(nodes.select("node_id", "label"), "node_id", "left").na.fill(0, ["label"])


def generate_gnp(spark: SparkSession, n: int, p: float, seed: int) -> tuple[DataFrame, int]:
    """G(n, p) with both arcs of each pair, and the node of largest degree (ties: the largest id)."""
    import numpy as np

    rng = np.random.default_rng(seed)
    pairs = [(u, v) for u in range(n) for v in range(u + 1, n) if rng.random() < p]
    degree = [sum(x in e for e in pairs) for x in range(n)]
    query = max(range(n), key=lambda x: (degree[x], x))
    arcs = pairs + [(v, u) for u, v in pairs]
    return spark.createDataFrame(arcs, "source long, target long"), query


def write_gnp(spark: SparkSession, root: str, n: int, p: float, seed: int) -> str:
    """A G(n, p) graph as ``edge.csv`` and ``meta.json`` under ``n{n}/p{p}/s{seed}``; its folder."""
    arcs, query = generate_gnp(spark, n, p, seed)
    folder = f"{root}/n{n}/p{round(1000 * p):03d}/s{seed}"
    arcs.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/edge.csv")
    m = arcs.count()
    meta = {"n": n, "p": p, "seed": seed, "query_node": query, "edge_count_directed": m, "edge_count_undirected": m // 2}
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/meta.json")
    return folder


def scan_synthetic_tree(spark: SparkSession, root: str, seeds: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Metadata of all graphs under ``root`` (of some seeds), and their edges with the graph's ``n, p, seed``."""
    lines = spark.read.option("recursiveFileLookup", True).text(root).select("value", F.col("_metadata.file_path").alias("file"))
    meta = lines.where(F.col("file").contains("/meta.json")).select(F.from_json("value", "n int, p double, seed int, query_node long, edge_count_directed long").alias("m"), F.regexp_extract("file", "^(.*)/meta.json", 1).alias("folder")).select("m.*", "folder")
    meta = meta.where(F.col("seed").isin(*seeds)) if seeds is not None else meta.where("seed IS NOT NULL")
    edges = lines.where(F.col("file").contains("/edge.csv") & F.col("value").rlike("^[0-9]+,[0-9]+$")).select(F.regexp_extract("file", "^(.*)/edge.csv", 1).alias("folder"), F.split("value", ",").alias("e"))
    edges = edges.join(F.broadcast(meta.select("folder", "n", "p", "seed")), "folder")  # one row a graph
    return meta.drop("folder"), edges.select("n", "p", "seed", F.col("e")[0].cast("long").alias("source"), F.col("e")[1].cast("long").alias("target"))


def list_datasets(spark: SparkSession, root: str) -> DataFrame:
    """``dataset, nodes, classes`` of every folder under ``root`` that has both tables, ``nodes.csv`` and ``edge.csv``."""
    lines = spark.read.option("recursiveFileLookup", True).text(root).select("value", F.col("_metadata.file_path").alias("file"))
    of = lambda name: F.regexp_extract("file", f"([^/]+)/{name}(/|$)", 1)
    edge = lines.select(of("edge.csv").alias("dataset")).where("dataset <> ''").distinct()
    rows = lines.select(of("nodes.csv").alias("dataset"), F.split("value", ",").alias("c")).where((F.col("dataset") != "") & F.col("c")[0].try_cast("long").isNotNull())
    counts = rows.groupBy("dataset").agg(F.count("*").alias("nodes"), (F.max(F.col("c")[1].try_cast("int")) + 1).alias("classes"))
    return counts.join(edge, "dataset", "left_semi")
