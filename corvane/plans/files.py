"""Registered queries that write tables with the sinks and read them back with the readers, and what SQL says must come back.

Files go to a folder of their own in the shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import display, evaluate, records, splits
from corvane.session import shared_dir
from corvane.sources import graphs, outputs
from corvane.streaming import packets

from .experiments import _F, _NODES, _flat
from .register import SQL, query
from .registry import _LINES, _lines


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


def _sql(spark: SparkSession, text: str) -> DataFrame:
    return spark.sql(text.replace("VARCHAR", "STRING"))


@query(f"WITH e AS ({graphs.PART_EDGES}) SELECT source, target, true AS ordered FROM e")
def scan_edges_csv(spark, d):
    """Edges as files with a header each; places in their order are numbers without gaps."""
    path = f"{_folder(spark)}/edge.csv"
    outputs.sink_csv(graphs.graph_view(spark, d, "part")[0].select("source", "target"), path, single=False)
    back = graphs.read_edges_csv(spark, path)
    span = back.agg((F.max("edge_ord") - F.min("edge_ord") < F.count("*") + F.lit(1000)).alias("a"), (F.countDistinct("edge_ord") == F.count("*")).alias("b"))  # headers leave gaps
    return back.crossJoin(F.broadcast(span)).select(F.col("source").cast("long").alias("source"), F.col("target").cast("long").alias("target"), (F.col("a") & F.col("b")).alias("ordered"))  # one row


@query(f"WITH n AS ({graphs.PART_NODES}) SELECT node_id, label, CASE WHEN train THEN 'train' WHEN val THEN 'val' WHEN test THEN 'test' ELSE 'unlabeled' END AS split FROM n")
def scan_nodes_csv(spark, d):
    path = f"{_folder(spark)}/nodes.csv"
    nodes = graphs.graph_view(spark, d, "part")[1]
    outputs.sink_csv(nodes.withColumn("val", F.initcap(F.col("val").cast("string"))), path, single=False)
    return graphs.read_nodes_csv(spark, path)


@query(f"""WITH p AS (SELECT count(*) AS n, max(label) + 1 AS c FROM ({graphs.PART_NODES}) a), q AS (SELECT count(*) AS n, max(label) + 1 AS c FROM ({graphs.NATION_NODES}) b)
SELECT 'part' AS dataset, n AS nodes, c AS classes FROM p UNION ALL SELECT 'nation', n, c FROM q""")
def list_datasets(spark, d):
    """Two graphs in folders of their own, beside a folder without edges."""
    root = _folder(spark)
    for name in ("part", "nation"):
        edges, nodes = graphs.graph_view(spark, d, name)
        outputs.sink_csv(edges.select("source", "target"), f"{root}/{name}/edge.csv", single=False)
        outputs.sink_csv(nodes, f"{root}/{name}/nodes.csv", single=False)
    outputs.sink_csv(nodes, f"{root}/alone/nodes.csv")
    return graphs.list_datasets(spark, root)


@query(f"""WITH e AS ({graphs.PART_EDGES}), asked AS (SELECT DISTINCT source AS query FROM e WHERE source % 100 = 0) SELECT DISTINCT target AS node_id FROM e JOIN asked ON query = source UNION SELECT query FROM asked""")
def read_predicted_nodes(spark, d):
    """The nodes of all balls around ids divisible by 100, written as one community."""
    path = _folder(spark)
    edges = graphs.graph_view(spark, d, "part")[0].where("source % 100 = 0")
    outputs.sink_nodes_csv(edges.select(F.explode(F.array("source", "target")).alias("node")).distinct(), path)
    return outputs.read_predicted_nodes(spark, path)


_NDJSON = """SELECT CAST(o_orderkey AS BIGINT) AS k, CASE CAST(o_orderkey % 10 AS INT) WHEN 0 THEN '{"query_node": ' || CAST(o_orderkey AS VARCHAR) WHEN 1 THEN '   '
  ELSE '{"query_node": ' || CAST(o_orderkey AS VARCHAR) || ', "method": "bp", "size": ' || CAST(o_custkey AS VARCHAR) || CASE WHEN o_orderkey % 3 = 0 THEN ', "new": [1]' ELSE '' END || '}' END AS value FROM orders"""


@query("SELECT CAST(o_orderkey AS BIGINT) AS query_node, 'bp' AS method, CAST(o_custkey AS BIGINT) AS size, CAST(NULL AS VARCHAR) AS broken FROM orders WHERE o_orderkey % 10 > 1 UNION ALL SELECT NULL, NULL, NULL, '{\"query_node\": ' || CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % 10 = 0")
def scan_records_tree(spark, d):
    """Lines of records in a tree of folders: good ones, broken ones and blank ones; a folder of old ones is left out."""
    graphs.tables(spark, d, "orders")
    root, lines = _folder(spark), _sql(spark, _NDJSON)
    lines.withColumn("part", F.col("k") % 3).select("value", "part").write.partitionBy("part").text(f"{root}/a")
    lines.select("value").limit(5).write.text(f"{root}/old.bak")
    good, bad = records.read_records(spark, root, "query_node long, method string, size long", "part-*")
    none = lambda *kinds: [F.lit(None).cast(k) for k in kinds]
    return good.select("query_node", "method", "size", *(c.alias("broken") for c in none("string"))).unionAll(bad.select(*none("long", "string", "long"), "value"))


_KEPT = "dataset, method, params_hash, seed, split_hash, query_node, query_split, query_label, predicted_label, size, oracle_queries, returncode, hard_cap_hit, fallback_used, gap_status, ord"


@query(f"{_F} SELECT {_KEPT} FROM f")
def sink_records_ndjson(spark, d):
    """Records appended in two runs to folders of their methods and parameters, and read as evaluations."""
    path, names = _folder(spark), _KEPT.split(", ")
    f = _flat(spark, d).select(*names)
    for half in (0, 1):
        records.append_records(f.where(F.col("ord") % 2 == half), path)
    return evaluate.read_evaluations(spark, path).select(*names)


_HASHES = SQL["split_hashes"].replace("SELECT split, count(*) FILTER", "SELECT split, CAST(count(*) FILTER", 1).replace("(flag) AS size", "(flag) AS BIGINT) AS size", 1)


@query(f"SELECT * FROM ({_HASHES}) a UNION ALL SELECT 'edges', num_edges, edges_hash FROM ({SQL['edges_hash']}) b")
def split_meta(spark, d):
    """The manifest of a split, written, read, checked against its tables, and told as rows."""
    edges, nodes = graphs.graph_view(spark, d, "part")
    nodes, path = splits.complement_train(nodes), _folder(spark)
    splits.write_split_meta(spark, splits.split_meta("part", 42, nodes, edges), path)
    meta = splits.check_split_meta(splits.read_split_meta(spark, path), nodes, edges)
    rows = [(s, v["size"], v["hash"]) for s, v in meta["splits"].items()] + [("edges", meta["num_edges"], meta["edges_hash"])]
    return spark.createDataFrame(rows, "split string, size long, hash string")


@query(f"{_F} SELECT ord, CASE WHEN k = 3 THEN density END AS density, mixing, '[' || k || ',' || size || ']' AS nodes FROM f")
def sink_json(spark, d):
    """Payloads as lines of JSON: values that are not numbers come back as null, absent ones too."""
    path = _folder(spark)
    x = F.when(F.col("k") == 3, F.col("density")).when(F.col("k") == 4, float("nan")).otherwise(float("inf"))
    outputs.sink_json(_flat(spark, d).select("ord", x.alias("density"), "mixing", F.array(F.col("k").cast("long"), "size").alias("nodes")), path)
    back = spark.read.schema("ord long, density double, mixing double, nodes array<long>").json(path)
    return back.withColumn("nodes", F.concat(F.lit("["), F.array_join("nodes", ","), F.lit("]")))


@query(f"{_F} SELECT dataset, method, count(*) AS n, '[' || min(k) || ',' || max(k) || ']' AS span, '{{\"cap\":' || count(*) FILTER (hard_cap_hit) || '}}' AS hits FROM f GROUP BY dataset, method")
def sink_aggregate_csv(spark, d):
    """A summary as one CSV file, arrays and structs as JSON texts."""
    path = _folder(spark)
    outputs.sink_csv(_flat(spark, d).groupBy("dataset", "method").agg(F.count("*").alias("n"), F.array(F.min("k"), F.max("k")).alias("span"), F.struct(F.count_if("hard_cap_hit").alias("cap")).alias("hits")), path)
    return spark.read.option("header", True).option("escape", "\\").schema("dataset string, method string, n long, span string, hits string").csv(path)


@query(f"""WITH l AS ({_LINES}) SELECT CASE WHEN starts_with(value, 'INCUMBENT_JSON:') AND value NOT LIKE '%broken' THEN '{{"type":"incumbent","content":' || substr(value, 16) || '}}' ELSE '{{"type":"log","content":"' || value || '"}}' END AS value, count(*) AS n FROM l GROUP BY 1""")
def sink_ndjson_packets(spark, d):
    """Every packet as a line of JSON, written and read; equal lines are counted."""
    path = _folder(spark)
    packets.packet_json(packets.packets(_lines(spark, d))).write.text(path)
    return spark.read.text(path).groupBy("value").agg(F.count("*").alias("n"))


_DATES = """SELECT CAST(o_orderkey AS BIGINT) AS k, CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN NULL WHEN 1 THEN 'soon' ELSE substr(CAST(o_orderdate AS VARCHAR), 1, 10) END AS date,
  CASE WHEN o_orderkey % 3 = 0 THEN 'N/A' ELSE CAST(1950 + o_custkey % 70 AS VARCHAR) END AS year FROM orders"""


@query(f"WITH t AS ({_DATES}) SELECT k, epoch_ms(CAST(coalesce(TRY_CAST(date AS DATE), make_date(TRY_CAST(year AS INT), 1, 1), DATE '2000-01-01') AS TIMESTAMP)) AS at FROM t")
def epoch_dates(spark, d):
    """The time of works by date, else by year, else of the year 2000."""
    graphs.tables(spark, d, "orders")
    return _sql(spark, _DATES).select("k", display.epoch(F.col("date"), F.col("year")).alias("at"))


_SCALARS = "SELECT p_partkey AS k, '--' || p_name || ' / ' || p_brand || '__' AS name, CASE CAST(p_size % 5 AS INT) WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN CAST('Infinity' AS DOUBLE) ELSE p_retailprice END AS x, CASE WHEN p_size % 7 > 0 THEN CAST(p_size AS DOUBLE) END AS bound, CAST(p_partkey % 50 AS DOUBLE) AS found FROM part"


@query(f"WITH t AS ({_SCALARS}) SELECT k, regexp_replace(regexp_replace(name, '[^0-9A-Za-z_]+', '_', 'g'), '^_+|_+$', '', 'g') AS name, CASE WHEN isfinite(x) THEN x END AS x, CASE WHEN bound IS NOT NULL THEN greatest(bound - found, 0.0) / greatest(abs(found), 1e-10) END AS gap FROM t")
def record_scalars(spark, d):
    """Safe names, finite numbers, and relative gaps."""
    graphs.tables(spark, d, "part")
    return _sql(spark, _SCALARS).select("k", records.safe_col(F.col("name")).alias("name"), records.finite(F.col("x")).alias("x"), records.relative_gap(F.col("bound"), F.col("found")).alias("gap"))
