"""Splits of a graph's nodes: drawing them, pinning them by hashes, and checking records and tables against the pins."""

from __future__ import annotations

import hashlib
import json
from datetime import UTC, datetime

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.session import cut

from .ranking import within

#: What manifests of splits say, as other tools expect it.
SCHEMA_VERSION = "3.0"
POOL_MIN_SIZE = 5
POOL_CRITERION = "pure_source_with_out_reachable_2edge_component_geq_5"
SPLIT_STRATEGY = "label_stratified_50_50_out_2edge_component_eligible"
HARD_CRITERION = "bfs_depth1_label_vote_wrong_outgoing"


#: Lines of a digest: its text streams through one task, some ten bytes a line, so this bounds time and not memory.
MAX_HASHED = 2_000_000_000


def digests(df: DataFrame, key: Column, order: list[Column], line: Column) -> DataFrame:
    """``_key, hash``: for each ``key`` (text), the SHA-256 of its lines in ``order``, joined by line ends; null lines are left out.

    Lines are sorted by ranges over tasks and put together into blocks there. A digest is a chain from its first byte to the
    last, so a key's blocks then pass through one task, which holds one batch of them at a time.
    """
    names = [f"_o{i}" for i in range(len(order))]
    lines = df.select(key.alias("_key"), *(c.alias(n) for c, n in zip(order, names, strict=True)), line.alias("_line")).where("_line IS NOT NULL")

    def blocks(batches):
        task, at = TaskContext.get().partitionId(), 0
        for pdf in batches:
            for k, own in pdf.groupby("_key", sort=False)["_line"]:
                yield pd.DataFrame({"_key": [k], "task": [task], "at": [at], "text": ["\n".join(own)]})
                at += 1

    def chain(batches):
        now, state = None, None
        for pdf in batches:
            for k, text in zip(pdf["_key"], pdf["text"], strict=True):
                if k != now:
                    if now is not None:
                        yield pd.DataFrame({"_key": [now], "hash": ["sha256:" + state.hexdigest()]})
                    now, state = k, hashlib.sha256(text.encode())
                else:
                    state.update(b"\n" + text.encode())
        if now is not None:
            yield pd.DataFrame({"_key": [now], "hash": ["sha256:" + state.hexdigest()]})

    sorted_ = lines.orderBy("_key", *names).select("_key", "_line")
    text = cut(sorted_.mapInPandas(blocks, "_key string, task int, at long, text string"))
    return text.repartition("_key").sortWithinPartitions("_key", "task", "at").mapInPandas(chain, "_key string, hash string")


#: What the digest of no line is.
EMPTY = "sha256:" + hashlib.sha256(b"").hexdigest()


def stratified_half_split(pool: DataFrame, seed: int = 42) -> DataFrame:
    """``node_id, label, split``: half of each label's nodes are ``val``, half ``test``.

    A label's odd node goes to ``val`` only where ``val`` has fewer nodes so far, labels ascending. Nodes are shuffled by
    a hash of the seed, so the draw is the same however the pool is partitioned; only one count a label meets in one place.
    """
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64(F.lit(seed), "node_id"), "node_id"))
    counts = {r.label: r.n for r in pool.groupBy("label").agg(F.count("*").alias("n")).collect()}  # one row a label
    n_val, val, test = {}, 0, 0
    for label in sorted(counts):
        n_val[label] = counts[label] // 2 + (counts[label] % 2 and val < test)
        val, test = val + n_val[label], test + counts[label] - n_val[label]
    cut = F.lit(0)
    for label, n in n_val.items():
        cut = F.when(F.col("label") == label, n).otherwise(cut)
    return pool.select("node_id", "label", F.when(place <= cut, "val").otherwise("test").alias("split"))


def complement_train(nodes: DataFrame) -> DataFrame:
    """``train`` is every node that is in neither other split."""
    return nodes.withColumn("train", ~(F.coalesce("val", F.lit(False)) | F.coalesce("test", F.lit(False))))


def split_hashes(nodes: DataFrame) -> DataFrame:
    """``split, size, hash`` of the three splits (empty ones too), of at most ``MAX_HASHED`` nodes."""
    nodes = within(nodes, [], MAX_HASHED, "hashes of splits")
    flags = F.explode(F.array(*(F.struct(F.lit(s).alias("split"), F.coalesce(F.col(s), F.lit(False)).alias("on")) for s in ("train", "val", "test"))))
    rows = nodes.select(F.col("node_id").cast("long").alias("node_id"), flags.alias("f")).select("node_id", "f.*")
    found = digests(rows.where("on"), F.col("split"), [F.col("node_id")], F.col("node_id").cast("string"))
    sizes = rows.groupBy("split").agg(F.count_if("on").alias("size"))
    return sizes.join(F.broadcast(found), F.col("split") == F.col("_key"), "left").select("split", "size", F.coalesce("hash", F.lit(EMPTY)).alias("hash"))  # three rows


def edges_hash(edges: DataFrame) -> DataFrame:
    """One row: the digest of the sorted edge list, one ``u,v`` a line. More than ``MAX_HASHED`` edges are an error."""
    edges = within(edges, [], MAX_HASHED, "hash of edges")
    u, v = (F.col(c).cast("long") for c in ("source", "target"))
    found = digests(edges, F.lit("edges"), [u, v], F.concat(u.cast("string"), F.lit(","), v.cast("string")))
    size = edges.agg(F.count("*").alias("num_edges"))
    return size.join(F.broadcast(found), F.lit(True), "left").select(F.coalesce("hash", F.lit(EMPTY)).alias("edges_hash"), "num_edges")  # one row


def set_hashes(nodes: DataFrame, by: str = "label") -> DataFrame:
    """``by, members, hash`` of each label's set of nodes; a set of more than ``MAX_HASHED`` is an error."""
    key, node = F.to_json(F.struct(by)), F.col("node_id").cast("long")
    nodes = within(nodes, [by], MAX_HASHED, "hashes of sets")
    sizes = nodes.groupBy(by).agg(F.count("*").alias("members"))
    return sizes.join(digests(nodes, key, [node], node.cast("string")), key == F.col("_key"), "left").select(by, "members", F.coalesce("hash", F.lit(EMPTY)).alias("hash"))


def set_row(nodes: DataFrame, column: str = "node_id") -> dict:
    node = F.col(column).cast("long")
    nodes = within(nodes, [], MAX_HASHED, "hash of a set")
    found = digests(nodes, F.lit("set"), [node], node.cast("string")).first()
    return {"size": nodes.count(), "hash": found["hash"] if found else EMPTY}


def split_meta(dataset: str, seed: int, nodes: DataFrame, edges: DataFrame, hard: DataFrame | None = None, pool: DataFrame | None = None, versions: dict | None = None) -> dict:
    """The manifest of a split: sizes and hashes of its parts, of the edges, and of what was drawn from."""
    parts = {r.split: {"size": r["size"], "hash": r["hash"]} for r in split_hashes(nodes).collect()}
    edge = edges_hash(edges).first()
    return {
        "schema_version": SCHEMA_VERSION, "dataset_name": dataset, "seed": seed, "num_nodes": nodes.count(), "num_edges": edge.num_edges, "pool_criterion": POOL_CRITERION,
        "pool_min_out_2edge_component_size": POOL_MIN_SIZE, "split_strategy": SPLIT_STRATEGY, "splits": parts,
        "query_pool": None if pool is None else {"criterion": POOL_CRITERION, **set_row(pool)},
        "hard_subset": None if hard is None else {"criterion": HARD_CRITERION, "split": "test", **set_row(hard)},
        "edges_hash": edge.edges_hash, "library_versions": versions or {}, "created_at": datetime.now(UTC).isoformat(),
    }


def write_split_meta(spark: SparkSession, meta: dict, path: str) -> None:
    """One JSON text, keys sorted."""
    text = json.dumps(meta, indent=2, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)


def read_split_meta(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first().value)


def check_split_meta(meta: dict, nodes: DataFrame, edges: DataFrame) -> dict:
    """``meta``, if it fits the tables; raises at the first field that does not."""
    for field, want in (("schema_version", SCHEMA_VERSION), ("pool_criterion", POOL_CRITERION), ("pool_min_out_2edge_component_size", POOL_MIN_SIZE), ("split_strategy", SPLIT_STRATEGY)):
        if meta.get(field) != want:
            raise ValueError(f"{meta.get('dataset_name')}: {field} is {meta.get(field)!r}, not {want!r}")
    for row in split_hashes(nodes).collect():
        if meta["splits"][row.split]["hash"] != row["hash"]:
            raise ValueError(f"{meta.get('dataset_name')}: the {row.split} split has changed")
    if edges_hash(edges).first().edges_hash != meta["edges_hash"]:
        raise ValueError(f"{meta.get('dataset_name')}: the edges have changed")
    return meta


def hash_mismatches(records: DataFrame, metas: dict[str, dict]) -> DataFrame:
    """``dataset, query_split, split_hash, want, n_records`` of records made under another split than the manifests'."""
    rows = [(d, s, m["splits"][s]["hash"]) for d, m in metas.items() for s in ("val", "test")]
    want = records.sparkSession.createDataFrame(rows, "dataset string, query_split string, want string")
    both = records.select("dataset", "query_split", "split_hash").join(F.broadcast(want), ["dataset", "query_split"])  # two rows a dataset
    return both.where(~F.col("split_hash").eqNullSafe(F.col("want"))).groupBy("dataset", "query_split", "split_hash", "want").agg(F.count("*").alias("n_records"))


def validate_split_hash(records: DataFrame, metas: dict[str, dict]) -> None:
    if bad := hash_mismatches(records, metas).orderBy("dataset", "query_split").limit(5).collect():  # shown in the message
        raise RuntimeError("records of another split: " + "; ".join(f"{r.dataset}/{r.query_split}: {r.n_records}" for r in bad))


def validate_complete(records: DataFrame, metas: dict[str, dict], allow_partial: bool = False) -> None:
    """Raises where a cell has not all queries of its split."""
    from .summaries import expected_sizes

    if allow_partial:
        return
    rows = [(d, s, m["splits"][s]["size"]) for d, m in metas.items() for s in ("val", "test")]
    want = records.sparkSession.createDataFrame(rows, "dataset string, query_split string, want long")
    if short := expected_sizes(records, want).orderBy("dataset", "method", "params_hash", "seed", "query_split").limit(12).collect():  # shown in the message
        raise RuntimeError("partial records: " + "; ".join(f"{r.dataset}/{r.method}/{r.params_hash[-12:]}/seed={r.seed}/{r.query_split}: {r.have}/{r.want}" for r in short))
