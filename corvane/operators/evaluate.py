"""Evaluation of queries: reuse what is on record, solve the rest, measure, vote, and append.

One pipeline of joins over all queries: cells already on record are looked up; of the rest, those whose solver result
exists under another split or evaluation are taken over, with labels and qualities computed anew; only what remains is
solved. Every new record is appended, so a run that was cut off goes on where it stopped.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.params import QUALITY_SCHEMA, Evaluation, SolveParams, grid, seeds_of

from corvane.functions.branching import Limits
from corvane.sources.graphs import build_graph_context

from . import expand, metrics, solve, votes
from .records import size_bucket

RECORD = (
    "dataset string, method string, params string, params_hash string, resume_key string, seed int, split_hash string, query_node long, query_split string, query_label int, "
    "predicted_label int, fallback_used boolean, size long, retrieved_nodes array<long>, oracle_queries long, returncode int, hard_cap_hit boolean, gap_status string, "
    "qualities struct<size:long,dir_internal_avg_degree:double,dir_internal_edge_density:double,undir_external_expansion:double,undir_external_conductance:double,mixing_param:double,"
    "within_class_internal_edges_ratio:double,train_label_entropy:double,true_class_vote_share:double,n_train_neighbours:long,size_bucket:string,edge_connectivity:long,undir_internal_ncut:double,algebraic_connectivity_lambda2:double>, "
    "quality_schema_version string, reused_solver_record boolean, reused_from_params_hash string, reused_from_split_hash string, ord long"
)
KEY = ["query_node", "method", "params_hash", "dataset", "split_hash", "seed"]
MANIFEST = "dataset string, method string, params_hash string, params_json string, records_dir string, seeds string"
#: Forbidden nodes that an evaluation can have.
MAX_FORBIDDEN = 10_000_000
RESUME = ["query_node", "method", "dataset", "resume_key", "seed"]


def read_evaluations(spark: SparkSession, path: str, below: bool = False) -> DataFrame:
    """Records appended under ``path``; none where there is nothing yet. With ``below``, those of its folders, but of none whose name ends in ``.bak``."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return spark.createDataFrame([], RECORD)
    paths = [x.getPath().toString() for x in files.listStatus(folder) if x.isDirectory() and not x.getPath().getName().endswith(".bak")] if below else [path]
    return spark.read.schema(RECORD).option("pathGlobFilter", "*.json").json(paths) if paths else spark.createDataFrame([], RECORD)


def _same(left: list[str]) -> Column:
    out = None
    for c in left:
        one = F.col(c).eqNullSafe(F.col(f"_{c}"))
        out = one if out is None else out & one
    return out


def _one_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key, with the key's columns renamed."""
    first = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
    return first.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in first.columns if c not in keys))


def cache_lookup(todo: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records of the cells in ``todo`` (the last of each key counts; failed runs do not), and the cells without one."""
    done = _one_of(records.where(F.coalesce("returncode", F.lit(0)) == 0), KEY, [F.desc("ord")])
    hit = todo.join(done.drop(*(c for c in todo.columns if c not in KEY)), _same(KEY)).drop(*(f"_{k}" for k in KEY))
    return hit, todo.join(done.select(*(f"_{k}" for k in KEY)), _same(KEY), "left_anti")


def reusable(todo: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells of ``todo`` with the nodes that an earlier run found for the same solver question (the first counts), and the cells without."""
    usable = (F.coalesce("returncode", F.lit(0)) == 0) & (F.size("retrieved_nodes") > 0)
    first = _one_of(records.where(usable), RESUME, [F.asc("ord")])
    first = first.select(*(f"_{k}" for k in RESUME), "retrieved_nodes", "oracle_queries", "hard_cap_hit", "gap_status", F.col("params_hash").alias("reused_from_params_hash"), F.col("split_hash").alias("reused_from_split_hash"))
    hit = todo.join(first, _same(RESUME)).drop(*(f"_{k}" for k in RESUME))
    return hit.withColumn("reused_solver_record", F.lit(True)), todo.join(first.select(*(f"_{k}" for k in RESUME)), _same(RESUME), "left_anti")


def _by_ball(edges: DataFrame, queries: DataFrame, params: SolveParams) -> DataFrame:
    return solve.grown_balls(edges, queries, params.bfs_depth, params.k or 1, params.max_in_edges)


def _by_average_degree(edges: DataFrame, queries: DataFrame, params: SolveParams) -> DataFrame:
    """The set of largest average degree, grown to the size floor over what the query revealed."""
    shown = expand.cut(solve.reveal(edges, queries, -1, params.max_in_edges))
    found = expand.cut(solve.average_degree_communities(shown).select("query", F.explode("nodes").alias("node")))
    grown = solve.grown_sets(shown.dropna(), found, params.k or 1)
    return grown.groupBy("query").agg(F.array_sort(F.collect_list("node")).alias("nodes")).withColumn("gap_status", F.lit("not_run"))


def _by_density(edges: DataFrame, queries: DataFrame, params: SolveParams) -> DataFrame:
    limits = Limits(params.time_limit, params.hard_time_limit, params.node_limit, params.dinkelbach_iter, params.gap_tolerance)
    return solve.dense_communities(solve.reveal(edges, queries, -1, params.max_in_edges), (params.k,), (params.kappa,), limits)


#: Methods by name: functions of ``(edges, queries, params)`` that give ``query, nodes, gap_status``. Others may be added.
SOLVERS = {"bfs": _by_ball, "avgdeg": _by_average_degree, "bp": _by_density}


def run_solver(edges: DataFrame, queries: DataFrame, params: SolveParams) -> DataFrame:
    """``query, retrieved_nodes, oracle_queries, hard_cap_hit, gap_status`` of each query by the method of ``params``."""
    found = SOLVERS[params.method](edges, queries, params)
    asked = expand.bfs_ball(expand.revealed(edges, params.max_in_edges), queries, params.bfs_depth if params.method == "bfs" else -1).groupBy("query").agg(F.count("*").alias("oracle_queries"))
    return found.join(asked, "query").select("query", F.col("nodes").alias("retrieved_nodes"), "oracle_queries", (F.col("gap_status") == "hard_time_limit").alias("hard_cap_hit"), "gap_status")


def classify(
    members: DataFrame, edges: DataFrame, nodes: DataFrame, queries: DataFrame, weighting: str = "distance", hops: int = 10, forbidden: DataFrame | None = None, max_in_edges: int = 0,
) -> DataFrame:
    """``query, predicted_label, fallback_used``: the community's vote, or without voters the nearest training layer's, or the majority of all.

    Distances that weigh votes are undirected; the fallback walks successors only, unless predecessors are told too.
    """
    graph = build_graph_context(edges, max_in_edges)
    voters = votes.train_members(members, nodes, forbidden)
    chosen = votes.distance_vote(voters, expand.bfs_distances(graph.undirected, queries, hops, forbidden)) if weighting == "distance" else votes.label_vote(voters)
    allowed = nodes if forbidden is None else nodes.join(forbidden.select(F.col("node").alias("node_id")), "node_id", "left_anti")
    chosen = expand.cut(queries.select("query").distinct().join(chosen, "query", "left"))
    lost = chosen.where(F.col("predicted").isNull()).select("query")
    backup = votes.fallback_vote(expand.bfs_distances(graph.fallback, lost, hops, forbidden), allowed).withColumnRenamed("predicted", "backup")
    df = queries.select("query").join(chosen, "query", "left").join(backup, "query", "left")
    return df.select("query", F.coalesce("predicted", "backup").cast("int").alias("predicted_label"), F.col("predicted").isNull().alias("fallback_used"))


def measure(members: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``query, qualities``: directed, undirected, label and cut qualities of each community, in one struct."""
    flat = metrics.directed_qualities(edges, members).join(metrics.undirected_qualities(edges, members).drop("size"), "query", "left").join(metrics.per_class(edges, members, nodes).drop("size", "size_bucket"), "query", "left")
    flat = flat.join(solve.cut_qualities(solve.inside(edges, members)), "query", "left")
    named = {
        "size": "num_nodes", "dir_internal_avg_degree": "avg_degree", "dir_internal_edge_density": "pair_density", "undir_external_expansion": "expansion", "undir_external_conductance": "conductance",
        "mixing_param": "mixing", "within_class_internal_edges_ratio": "same_label_ratio", "train_label_entropy": "entropy", "true_class_vote_share": "own_share", "n_train_neighbours": "n_train",
    }
    cut = {"edge_connectivity": "edge_connectivity", "undir_internal_ncut": "ncut", "algebraic_connectivity_lambda2": "lambda2"}
    fields = [F.col(c).alias(n) for n, c in named.items()] + [size_bucket(F.col("num_nodes")).alias("size_bucket")] + [F.col(c).alias(n) for n, c in cut.items()]
    return flat.select("query", F.struct(*fields).alias("qualities"))


def evaluate_nodes(
    queries: DataFrame, edges: DataFrame, nodes: DataFrame, method: str, params: dict, dataset: str, split: str, split_hash: str, records: str | None = None,
    seed: int | None = None, weighting: str = "distance", hops: int = 10, forbidden: DataFrame | None = None, qualities: bool = True, solver=run_solver, siblings: str | None = None,
) -> DataFrame:
    """A record of each query (``query_node``), in the order of queries; new ones are appended at ``records``.

    ``solver`` is any function of ``(edges, queries, params)`` with the columns of ``run_solver``, for queries that no record answers.
    Records in the folders of ``siblings`` (other weightings, other splits) give their solver results to equal solver questions.
    A record's ``ord`` is the number of the run that appended it. At most ``MAX_FORBIDDEN`` nodes can be forbidden, since they are hashed as one text.
    """
    spark = queries.sparkSession
    barred = forbidden.select("node").distinct().limit(MAX_FORBIDDEN + 1).collect() if forbidden is not None else []
    if len(barred) > MAX_FORBIDDEN:
        raise ValueError(f"more than {MAX_FORBIDDEN} forbidden nodes")
    asked = SolveParams.of(method, params)
    one = Evaluation(params, weighting, hops, tuple(r.node for r in barred), solver_config={"max_in_edges": asked.max_in_edges})
    fixed = {
        "dataset": dataset, "method": method, "params": json.dumps(one.stored, sort_keys=True), "params_hash": one.key, "resume_key": one.question,
        "seed": seed if method == "bp" else None, "split_hash": split_hash, "query_split": split,
    }
    todo = queries.select(F.col("query_node").cast("long").alias("query_node")).distinct()
    todo = todo.select(*(F.lit(v).cast("int" if k == "seed" else "string").alias(k) for k, v in fixed.items()), "query_node")
    stored = read_evaluations(spark, records) if records else spark.createDataFrame([], RECORD)
    cached, rest = cache_lookup(todo, stored)
    others = stored if siblings is None else read_evaluations(spark, siblings, below=True)
    taken, rest = reusable(rest, others)
    rest = expand.cut(rest)
    solved = rest.join(solver(edges, rest.select(F.col("query_node").alias("query")), asked), F.col("query_node") == F.col("query")).drop("query")
    fresh = taken.unionByName(solved, allowMissingColumns=True)
    fresh = expand.cut(fresh.withColumn("returncode", F.lit(0)).withColumn("size", F.size("retrieved_nodes").cast("long")))
    members = fresh.select(F.col("query_node").alias("query"), F.explode("retrieved_nodes").alias("node"))
    open_ = fresh.select(F.col("query_node").alias("query"))
    label = nodes.select(F.col("node_id").alias("query_node"), F.col("label").cast("int").alias("query_label"))
    done = fresh.join(label, "query_node", "left").join(classify(members, edges, nodes, open_, weighting, hops, forbidden, asked.max_in_edges).withColumnRenamed("query", "query_node"), "query_node")
    if qualities:
        done = done.join(measure(members, edges, nodes).withColumnRenamed("query", "query_node"), "query_node", "left").withColumn("quality_schema_version", F.lit(QUALITY_SCHEMA))
    last = stored.agg(F.max("ord").alias("o")).first().o or 0
    done = done.withColumn("ord", F.lit(last + 1).cast("long")) if records else done
    new = spark.createDataFrame([], RECORD).unionByName(done, allowMissingColumns=True)
    new = expand.cut(new)
    if records:
        new.write.mode("append").json(records)
    return cached.select(*new.columns).unionByName(new).orderBy("query_node")


def averages(records: DataFrame) -> DataFrame:
    """One row: fallbacks, mean size and oracle queries, and means of the headline qualities, of evaluated records."""
    fell = F.count_if(F.coalesce(F.col("fallback_used"), F.lit(False)))
    means = ("dir_internal_avg_degree", "dir_internal_edge_density", "undir_external_expansion", "undir_external_conductance", "undir_internal_ncut")
    return records.agg(
        F.count("*").alias("query_count"), fell.alias("fallback_count"), (100.0 * fell / F.greatest(F.count("*"), F.lit(1))).alias("fallback_rate"),
        F.avg("size").alias("avg_pred_size"), F.avg("oracle_queries").alias("avg_oracle_queries"), *(F.avg(f"qualities.{m}").alias(f"avg_{m}") for m in means),
    )


def sweep(spark: SparkSession, dataset: str, grids: dict[str, dict], seeds: list[int] | None = None, root: str = "", **evaluation) -> DataFrame:
    """The manifest of a sweep: one row per method and parameters, with its hash, folder (none without a root) and seeds. Deterministic methods have no seed."""
    rows = []
    for method, values in grids.items():
        for params in grid(method, **values):
            config = {"max_in_edges": SolveParams.of(method, params).max_in_edges}
            hashed = Evaluation(params, **evaluation, solver_config=config).key
            own = seeds_of(method, seeds) if seeds is not None else seeds_of(method)
            rows.append((dataset, method, hashed, json.dumps(params, sort_keys=True), f"{root}/{method}/{hashed[-12:]}" if root else "", ",".join(str(s) for s in own)))
    return spark.createDataFrame(rows, MANIFEST)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("header", True).option("escape", '"').csv(path)


def run_sweep(manifest: DataFrame, queries: dict[str, DataFrame], hashes: dict[str, str], edges: DataFrame, nodes: DataFrame, manifest_path: str | None = None, **evaluation) -> DataFrame:
    """All records of a sweep, over its splits. The manifest is small; each of its cells is one evaluation over all queries.

    It is written at ``manifest_path`` before the first cell is run, for ``read_manifest`` to take a sweep up again.
    """
    if manifest_path:
        manifest.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(manifest_path)
    out = None
    for row in manifest.collect():
        for seed in row.seeds.split(","):
            for split, asked in queries.items():
                one = evaluate_nodes(
                    asked, edges, nodes, row.method, json.loads(row.params_json), row.dataset, split, hashes[split], row.records_dir or None,
                    None if seed == "None" else int(seed), siblings=row.records_dir.rpartition("/")[0] or None if row.records_dir else None, **evaluation,
                )
                out = one if out is None else out.unionByName(one)
    return out
