"""What solver runs print and write, read as tables; and the sinks of results."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.records import append_records, finite
from corvane.streaming.packets import write_packets

#: What solver logs mark their result and count of queries by.
RESULT = r"(?m)^JSON_RESULT:(.*)$"
QUERIES = r"API Queries Made\s*:\s*(\d+)"
PAYLOAD = (
    "schema_version string, solver_build_id string, method string, query_node string, k int, kappa int, bfs_depth int, nodes array<string>, size long, lambda_final double, "
    "kappa_verified boolean, kappa_verify_failed boolean, hard_cap_hit boolean, stats map<string,double>, optimality_gap double, bb_incumbent_obj double, bb_best_bound double, "
    "gap_status string, qualities map<string,double>, oracle struct<queries_made:long,unique_nodes_mapped:long>, io struct<input_edge_count:long,io_time_s:double>, "
    "incumbent_trajectory array<struct<bb_node:long,lambda:double,param_obj:double,density:double,size:long,nodes:array<string>>>, wall_time_s double"
)

__all__ = ["append_records", "parse_oracle_queries", "parse_solver_json", "project_payload", "read_predicted_nodes", "run_rows", "sink_csv", "sink_json", "sink_nodes_csv", "write_packets"]


def parse_solver_json(stdout: Column) -> Column:
    """The payload after the result mark, as a struct; null without one or where it is no JSON object."""
    body = F.regexp_extract(stdout, RESULT, 1)
    return F.when(F.try_parse_json(body).isNotNull() & (F.ltrim(body).startswith("{")), F.from_json(body, PAYLOAD))


def parse_oracle_queries(output: Column) -> Column:
    """How often the source was asked, by the log; null where it does not say."""
    return F.nullif(F.regexp_extract(output, QUERIES, 1), F.lit("")).cast("long")


def project_payload(p: str = "payload") -> list[Column]:
    """The fields of a payload that records take over."""
    get = lambda name: F.col(f"{p}.{name}")
    names = ("method", "solver_build_id", "kappa_verified", "kappa_verify_failed", "hard_cap_hit", "gap_status", "stats", "incumbent_trajectory")
    numbers = ("optimality_gap", "bb_incumbent_obj", "bb_best_bound", "wall_time_s", "lambda_final")
    nodes = F.filter(F.transform(get("nodes"), lambda x: x.try_cast("long")), lambda x: x.isNotNull())
    return [get("query_node").cast("long").alias("query_node"), nodes.alias("retrieved_nodes"), F.size(nodes).cast("long").alias("size"), *(get(n).alias(n) for n in names), *(finite(get(n)).alias(n) for n in numbers)]


def run_rows(runs: DataFrame) -> DataFrame:
    """Rows ``stdout, returncode`` of solver runs as projected payloads with ``oracle_queries``.

    A run that failed, or that has no payload, raises when it is read: an empty community must not pass for a result.
    """
    df = runs.withColumn("payload", parse_solver_json(F.col("stdout")))
    bad = (F.col("returncode") != 0) | F.col("payload").isNull()
    checked = F.when(bad, F.raise_error(F.concat(F.lit("solver run failed: "), F.right("stdout", F.lit(2000))))).otherwise(F.col("payload"))
    df = df.withColumn("payload", checked)
    return df.select(*project_payload(), F.coalesce(parse_oracle_queries(F.col("stdout")), F.col("payload.oracle.queries_made")).alias("oracle_queries"), "returncode")


def read_predicted_nodes(spark: SparkSession, path: str) -> DataFrame:
    """``node_id`` (long) of a CSV of nodes; no rows where the file or the column is missing."""
    empty = spark.createDataFrame([], "node_id long")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return empty
    df = spark.read.option("header", True).csv(path)
    return df.select(F.col("node_id").try_cast("long").alias("node_id")).where("node_id IS NOT NULL") if "node_id" in df.columns else empty


def sink_csv(df: DataFrame, path: str, single: bool = True) -> None:
    """A table as CSV with a header; arrays, maps and structs as JSON. Small results go to one file."""
    nested = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]
    flat = df.select(*nested)
    (flat.coalesce(1) if single else flat).write.mode("overwrite").option("header", True).csv(path)


def sink_nodes_csv(members: DataFrame, path: str) -> None:
    """A community as a column ``node_id``."""
    sink_csv(members.select(F.col("node").alias("node_id")), path)


def sink_json(payload: DataFrame, path: str) -> None:
    """Each row as one JSON object a line, nulls included, numbers that JSON lacks as null."""
    cols = [finite(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in payload.dtypes]
    payload.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def payload_line(payload: dict) -> str:
    """A payload as the line that a log marks it by."""
    return "JSON_RESULT:" + json.dumps(payload, sort_keys=True)
