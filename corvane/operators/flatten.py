"""Experiment records as wide rows: flattening, derived columns, and the cells they belong to.

Records are DataFrames with struct columns ``params``, ``qualities`` and ``stats`` (read with a schema, or
inferred). What to flatten follows from the schema, so no row is looked at for it. A field that the schema
lacks is null. Not-a-number and infinite values are null.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, NumericType, StructType

from .ranking import numbered
from .records import finite, size_bucket

#: Field names of records, as they are written by other tools.
HEADLINE_METRICS = (
    "size", "dir_internal_avg_degree", "dir_internal_edge_density", "undir_external_expansion", "undir_internal_ncut", "mixing_param",
    "algebraic_connectivity_lambda2", "edge_connectivity", "kappa_s", "within_class_internal_edges_ratio", "train_label_entropy", "true_class_vote_share",
)
TRACE_METRICS = ("undir_external_conductance", "n_train_neighbours")
DERIVED_RATE_COLUMNS = ("size_lt_k", "kappa_s_lt_1", "kappa_s_lt_2")
COST_FIELDS = (
    "wall_time_s", "oracle_queries", "size_solver", "total_bb_nodes", "total_lp_solves", "total_columns_added", "total_cuts_added", "t_lp_solve",
    "t_pricing", "t_separation", "t_sync", "t_total", "optimality_gap", "bb_incumbent_obj", "bb_best_bound", "open_bb_nodes",
)
RECORD_FIELDS = (
    "dataset", "method", "params_hash", "seed", "split_hash", "query_split", "query_node", "query_label", "predicted_label", "returncode", "size",
    "oracle_queries", "wall_time_s", "solver_wall_time_s", "soft_time_limit_s", "hard_time_limit_s", "solver_build_id", "solver_dump_path",
    "quality_schema_version", "kappa_verified", "kappa_verify_failed", "hard_cap_hit", "optimality_gap", "bb_incumbent_obj", "bb_best_bound",
    "gap_status", "fallback_used",
)
METRIC_FIELDS = (
    "size", "oracle_queries", "wall_time_s", "solver_wall_time_s", "soft_time_limit_s", "hard_time_limit_s", "optimality_gap", "bb_incumbent_obj",
    "bb_best_bound", "returncode",
)


def safe_name(name: str) -> str:
    """A column name of letters, digits and underscores."""
    return re.sub(r"[^0-9A-Za-z_]+", "_", name).strip("_")


def field(df: DataFrame, path: str, cast: str | None = None) -> Column:
    """The field at ``path``, or null where the schema has none."""
    kind: DataType = df.schema
    for part in path.split("."):
        if not isinstance(kind, StructType) or part not in kind.fieldNames():
            return F.lit(None).cast(cast or "string")
        kind = kind[part].dataType
    return F.col(path).cast(cast) if cast else F.col(path)


def jsonish(c: Column, kind: DataType) -> Column:
    """Scalars as they are, all else as JSON text."""
    return F.to_json(c) if isinstance(kind, (StructType, ArrayType, MapType)) else c


def flat_fields(prefix: str, c: Column, kind: DataType) -> dict[str, Column]:
    """The leaves of a nested value, named by their path."""
    if not isinstance(kind, StructType):
        return {prefix: jsonish(c, kind)}
    out: dict[str, Column] = {}
    for f in kind.fields:
        out |= flat_fields(f"{prefix}_{safe_name(f.name)}" if prefix else safe_name(f.name), c[f.name], f.dataType)
    return out


def flatten_params(df: DataFrame, column: str = "params") -> dict[str, Column]:
    """Columns of a parameter struct: ``eval_*`` from its ``_eval`` block, ``param_*`` from all else."""
    if column not in df.columns:
        return {}
    out: dict[str, Column] = {}
    for f in df.schema[column].dataType.fields:
        out |= flat_fields("eval" if f.name == "_eval" else f"param_{safe_name(f.name)}", F.col(column)[f.name], f.dataType)
    return out


def _prefixed(df: DataFrame, column: str, prefix: str) -> dict[str, Column]:
    if column not in df.columns:
        return {}
    return {f"{prefix}_{safe_name(f.name)}": jsonish(F.col(column)[f.name], f.dataType) for f in df.schema[column].dataType.fields}


def less(a: Column, b: Column | int) -> Column:
    """A comparison that is null where a side is."""
    return finite(a.cast("double")) < (finite(b.cast("double")) if isinstance(b, Column) else F.lit(b))


def flatten_record(df: DataFrame) -> DataFrame:
    """Each record as one wide row: its fields, derived flags, parameters, qualities and statistics."""
    k, kappa = field(df, "params.k", "double"), field(df, "qualities.edge_connectivity", "double")
    size = F.coalesce(field(df, "qualities.size", "double"), field(df, "size", "double"))
    label, predicted = field(df, "query_label", "long"), field(df, "predicted_label", "long")
    nodes = [c for c in ("retrieved_nodes", "neighborhood") if c in df.columns]
    out = {c: field(df, c) for c in RECORD_FIELDS}
    out |= {
        "params_hash_short": F.right(F.coalesce(field(df, "params_hash", "string"), F.lit("")), F.lit(12)),
        "params_json": F.to_json("params") if "params" in df.columns else F.lit("{}"),
        "retrieved_nodes_json": F.coalesce(*(F.to_json(c) for c in nodes), F.lit("[]")),
        "incumbent_trajectory_json": F.coalesce(F.to_json("incumbent_trajectory"), F.lit("[]")) if "incumbent_trajectory" in df.columns else F.lit("[]"),
        "requested_k": finite(k), "quality_kappa_s": finite(kappa), "size_lt_k": less(size, k), "kappa_s_lt_1": less(kappa, 1), "kappa_s_lt_2": less(kappa, 2),
        "prediction_correct": label == predicted,
    }
    return df.select(*(c.alias(n) for n, c in (out | flatten_params(df) | _prefixed(df, "qualities", "quality") | _prefixed(df, "stats", "stat")).items()))


def metric_columns(df: DataFrame) -> list[str]:
    """Numeric columns of flattened records that hold any value: one pass counts them all."""
    named = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and (f.name in METRIC_FIELDS or f.name.startswith(("quality_", "stat_")))]
    counts = df.agg(*(F.count(finite(F.col(c).cast("double"))).alias(c) for c in named)).first() if named else ()
    return [c for c, n in zip(named, counts, strict=True) if n]


def config_columns(df: DataFrame) -> list[str]:
    return sorted(c for c in df.columns if c.startswith(("param_", "eval_")))


def quality_rows(df: DataFrame) -> DataFrame:
    """Records with their headline qualities; ``kappa_s`` is the edge connectivity."""
    out = {c: field(df, c) for c in ("dataset", "method", "params_hash", "seed", "split_hash", "query_node", "query_split", "fallback_used")}
    out |= {"params": F.to_json("params") if "params" in df.columns else F.lit("{}"), "requested_k": field(df, "params.k", "double"), "size_solver": field(df, "size", "double")}
    out |= {"hard_cap_hit": F.coalesce(field(df, "hard_cap_hit", "boolean"), F.lit(False))}
    for m in (*HEADLINE_METRICS, *TRACE_METRICS):
        out[m] = finite(field(df, f"qualities.{'edge_connectivity' if m == 'kappa_s' else m}", "double"))
    out["size_bucket"] = F.coalesce(field(df, "qualities.size_bucket", "string"), size_bucket(out["size"]))
    keep = [c for c in ("ord",) if c in df.columns]
    return derived_columns(df.select(*(c.alias(n) for n, c in out.items()), *keep))


def derived_columns(df: DataFrame) -> DataFrame:
    """Adds whether a set is smaller than asked for, and whether it is connected once and twice; null where unknown."""
    return df.withColumns({"size_lt_k": less(F.col("size"), F.col("requested_k")), "kappa_s_lt_1": less(F.col("kappa_s"), 1), "kappa_s_lt_2": less(F.col("kappa_s"), 2)})


def cost_rows(df: DataFrame) -> DataFrame:
    """Records with what they cost. Gap fields are the record's where its schema has them (nulls too), else those of its statistics."""
    out = {c: field(df, c) for c in ("dataset", "method", "params_hash", "seed", "query_node", "query_split", "solver_build_id", "hard_cap_hit")}
    out["params"] = F.to_json("params") if "params" in df.columns else F.lit("{}")
    for c in COST_FIELDS:
        own = c if c in ("wall_time_s", "oracle_queries") else "size" if c == "size_solver" else None
        path = own or (c if c in df.columns and c in ("optimality_gap", "bb_incumbent_obj", "bb_best_bound") else f"stats.{c}")
        out[c] = finite(field(df, path, "double"))
    out["gap_status"] = field(df, "gap_status" if "gap_status" in df.columns else "stats.gap_status", "string")
    keep = [c for c in ("ord",) if c in df.columns]
    return df.select(*(c.alias(n) for n, c in out.items()), *keep)


def record_filters(df: DataFrame, dataset: str | None = None, method: str | None = None, params_hash: str | None = None, split: str = "union") -> DataFrame:
    """Records of one dataset, method, parameter hash or split; ``None`` and ``union`` take all."""
    for name, value in (("dataset", dataset), ("method", method), ("params_hash", params_hash), ("query_split", None if split == "union" else split)):
        df = df.where(F.col(name) == value) if value is not None else df
    return df


def cell_columns(method: Column, k: Column, kappa: Column, depth: Column) -> dict[str, Column]:
    """Key, size floor and label of the cell a record belongs to; all null where a part that its method needs is missing."""
    part = lambda *xs: F.concat_ws("/", method, *(x.cast("string") for x in xs))
    known = lambda *xs: [x.isNotNull() for x in xs]

    def chosen(bp: Column, bfs: Column, avgdeg: Column) -> Column:
        all_of = lambda cs: cs[0] if len(cs) == 1 else cs[0] & all_of(cs[1:])
        return F.when((method == "bp") & all_of(known(k, kappa)), bp).when((method == "bfs") & all_of(known(depth, k)), bfs).when((method == "avgdeg") & k.isNotNull(), avgdeg)

    label = chosen(F.concat(F.lit("BP κ="), kappa.cast("string")), F.concat(F.lit("BFS d="), depth.cast("string")), F.lit("AvgDeg"))
    return {"cell": chosen(part(k, kappa), part(depth, k), part(k)), "cell_k": chosen(k, k, k), "cell_label": label}


def collect_cells(df: DataFrame, split: str, hard: DataFrame | None = None, order: str = "ord") -> DataFrame:
    """``cell, cell_k, cell_label, query_node, truth, predicted`` of a split: first seed only, the last row of a query counts.

    Records without a label or a whole key are left out; a missing prediction is label -1. ``hard`` has the queries to keep.
    """
    cells = cell_columns(F.col("method"), field(df, "params.k", "int"), field(df, "params.kappa", "int"), field(df, "params.bfs_depth", "int"))
    rows = df.where((F.col("query_split") == split) & (F.col("seed").isNull() | (F.col("seed") == 42)) & F.col("query_label").isNotNull())
    rows = rows.select(*(c.alias(n) for n, c in cells.items()), "method", "query_node", F.col("query_label").alias("truth"), F.coalesce("predicted_label", F.lit(-1)).alias("predicted"), F.col(order).alias("_o"))
    rows = rows.where(F.col("cell").isNotNull())
    if hard is not None:
        rows = rows.join(hard.select("query_node").distinct(), "query_node", "left_semi")
    last = Window.partitionBy("cell", "query_node").orderBy(F.desc("_o"))
    return rows.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r", "_o")


def group_records(df: DataFrame, split: str, *fields: str, stretch: int = 10_000) -> DataFrame:
    """Records of a split per method, parameter hash and seed, as arrays in query order; ``first`` is the place of an array's first record.

    An array has ``stretch`` records at most, so a cell of any size is as many rows as it needs.
    """
    keys, item = ["method", "params_hash", "seed"], ["query_node", *fields]
    rows = numbered(df.where(F.col("query_split") == split).select(*keys, *item), keys, item)
    arrays = F.array_sort(F.collect_list(F.struct(*item)))
    first = (F.floor((F.col("place") - 1) / stretch) * stretch + 1).cast("long").alias("first")
    return rows.groupBy(*keys, first).agg(arrays.alias("records"), F.count("*").alias("n_records"))


def wrong_depth1_queries(df: DataFrame) -> DataFrame:
    """Test queries that a one-hop ball without growth votes wrongly on: a stand-in for the hard subset where no graph is at hand."""
    wrong = ~F.col("predicted_label").eqNullSafe(F.col("query_label")) & F.col("query_label").isNotNull()
    rows = df.where((F.col("method") == "bfs") & (F.col("query_split") == "test") & (field(df, "params.bfs_depth", "int") == 1) & wrong)
    return rows.select("query_node").distinct()


def classification_subsets(df: DataFrame, hard: DataFrame | None = None) -> DataFrame:
    """Records by ``subset``: validation, test, and the hard queries of the test split once more. ``hard`` has ``dataset, query_node``."""
    both = df.where(F.col("query_split").isin("val", "test")).withColumn("subset", F.col("query_split"))
    if hard is None:
        return both
    again = df.where("query_split = 'test'").join(hard.select("dataset", "query_node").distinct(), ["dataset", "query_node"], "left_semi")
    return both.unionByName(again.withColumn("subset", F.lit("bfs_depth1_wrong")))
