"""Communities as they are shown: core and ghost nodes and edges, order, ranks, and figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import numbered


def stable_sample(df: DataFrame, keys: list[str], item: str, size: Column, *salt: Column | str) -> DataFrame:
    """At most ``size`` items of each key, the same ones however often and wherever it is asked: those of the lowest digests."""
    mark = F.sha2(F.concat_ws("|", *salt, F.col(item).cast("string")), 256)
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(mark, item))).where(F.col("_r") <= size).drop("_r")


def ordered_unique(df: DataFrame, keys: list[str], items: str, kind: str = "long") -> DataFrame:
    """``keys, position, value``: the array's values that convert to ``kind``, each at its first place; positions count from 1 without gaps."""
    rows = df.select(*keys, F.posexplode(items).alias("_at", "_raw")).select(*keys, "_at", F.col("_raw").try_cast(kind).alias("value")).where("value IS NOT NULL")
    first = rows.groupBy(*keys, "value").agg(F.min("_at").alias("_at"))
    return first.select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy("_at")).alias("position"), "value")


def display_graph(edges: DataFrame, nodes: DataFrame, members: DataFrame, fraction: float = 0.1, cap: int = 3) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of each query's picture: ``members (query, node, position)`` as core, sampled outside neighbours as ghosts.

    Of a core node's n outside neighbours (an arc counts once a direction), ``min(cap, max(1, n * fraction))`` are sampled. A
    ghost's edge points the way its arc does; where both do, away from the core.
    """
    both = edges.select(F.col("source").alias("node"), F.col("target").alias("other"), F.lit(True).alias("out")).unionByName(edges.select(F.col("target").alias("node"), F.col("source").alias("other"), F.lit(False).alias("out")))
    degree = both.groupBy("node").agg(F.count("*").alias("degree"))
    core = members.select("query", "node")
    label = nodes.select(F.col("node_id").alias("node"), "label", "split")
    core_nodes = members.join(label, "node").join(degree, "node", "left")
    core_nodes = core_nodes.select("query", F.col("node").cast("string").alias("id"), F.col("node").alias("raw_id"), F.col("position").alias("display_num"), "label", "split", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"), F.lit("core").alias("type"))
    around = core.join(both.where("node <> other"), "node").join(core.select("query", F.col("node").alias("other"), F.lit(True).alias("_in")), ["query", "other"], "left")
    core_edges = around.where("_in AND out").select("query", F.col("node").cast("string").alias("source"), F.col("other").cast("string").alias("target"), F.lit("core").alias("type")).distinct()
    outside = around.where("_in IS NULL").groupBy("query", "node", "other").agg(F.count("*").alias("_k"), F.bool_or("out").alias("out"))
    outside = outside.withColumn("_n", F.sum("_k").over(Window.partitionBy("query", "node")))
    size = F.least(F.lit(cap), F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(fraction))))
    ghosts = stable_sample(outside, ["query", "node"], "other", size, F.col("node").cast("string")) if fraction > 0 and cap > 0 else outside.limit(0)
    ghost = F.concat(F.lit("ghost_"), F.col("other").cast("string"))
    ghost_nodes = ghosts.select("query", "other").distinct().join(label.withColumnRenamed("node", "other"), "other", "left")
    ghost_nodes = ghost_nodes.select("query", ghost.alias("id"), F.col("other").alias("raw_id"), F.lit(None).cast("int").alias("display_num"), F.coalesce("label", F.lit(-1)).alias("label"), F.coalesce("split", F.lit("unlabeled")).alias("split"), F.lit(None).cast("long").alias("degree"), F.lit("ghost").alias("type"))
    own = F.col("node").cast("string")
    ghost_edges = ghosts.select("query", F.when(F.col("out"), own).otherwise(ghost).alias("source"), F.when(F.col("out"), ghost).otherwise(own).alias("target"), F.lit("ghost").alias("type"))
    return core_nodes.unionByName(ghost_nodes), core_edges.unionByName(ghost_edges)


def core_only(shown: DataFrame) -> DataFrame:
    return shown.where("type = 'core'")


def display_stats(shown: DataFrame, edges: DataFrame) -> DataFrame:
    """Per query: core nodes and edges, density of the core, and ghosts."""
    n = shown.groupBy("query").agg(F.count_if(F.col("type") == "core").alias("v"), F.count_if(F.col("type") == "ghost").alias("ghosts"))
    e = edges.groupBy("query").agg(F.count_if(F.col("type") == "core").alias("e"))
    df = n.join(e, "query", "left").na.fill(0, ["e"])
    return df.select("query", "v", "e", F.when(F.col("v") > 1, F.col("e").cast("double") / (F.col("v") * (F.col("v") - 1))).otherwise(0.0).alias("density"), "ghosts")


def epoch(date: Column, year: Column) -> Column:
    """Milliseconds of a date, else of its year's first day, else of the year 2000's."""
    day = F.coalesce(F.try_to_date(date), F.make_date(year.try_cast("int"), F.lit(1), F.lit(1)), F.lit("2000-01-01").cast("date"))
    return F.unix_millis(day.cast("timestamp"))


def layout_rank(shown: DataFrame, *order: Column | str) -> DataFrame:
    """Adds each core node's rank in its picture and its row of three."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy(*(order or ("label", "raw_id")))) - 1
    return core_only(shown).withColumn("rank", rank).withColumn("row", F.col("rank") % 3)


#: Columns that a ledger sorts as whole numbers.
NUMERIC = ("year", "citations", "label", "degree", "raw_id", "display_num")


def ledger_key(column: str) -> Column:
    """What a ledger sorts a column by: numbers with unknown ones as -1, texts in lower case."""
    c = F.col(column)
    return F.coalesce(F.nullif(c.cast("string"), F.lit("N/A")).try_cast("int"), F.lit(-1)) if column in NUMERIC else F.lower(c.cast("string"))


def _ledger_order(column: str, descending: bool) -> list:
    key = ledger_key(column)
    return [key.desc() if descending else key.asc(), "display_num", "query"]


def ledger_sort(shown: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Core nodes in the order of a column; equals keep the result's order."""
    return core_only(shown).orderBy(*_ledger_order(column, descending)[:2])


def ledger_places(shown: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Adds each core node's ``place`` in the ledger of all pictures, equals by their number and query; sorted by ranges over tasks."""
    return numbered(core_only(shown), [], _ledger_order(column, descending))


def log_tail(lines: DataFrame, keys: list[str], seq: str = "seq", most: int = 2000) -> DataFrame:
    """The last ``most`` lines of each log."""
    return lines.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(seq)))).where(F.col("_r") <= most).drop("_r")


def show_float(c: Column, digits: int = 6) -> Column:
    """Fixed digits, or an exponent with three where a value is tiny or huge; null stays."""
    size = F.abs(c)
    exponent = F.floor(F.log10(size)).cast("int")
    mantissa = F.round(c / F.pow(F.lit(10.0), exponent), 3)
    carried = F.abs(mantissa) >= 10
    mantissa, exponent = F.when(carried, mantissa / 10).otherwise(mantissa), F.when(carried, exponent + 1).otherwise(exponent)
    sign = F.when(exponent < 0, F.lit("-")).otherwise(F.lit("+"))
    scientific = F.concat(F.format_string("%.3f", mantissa), F.lit("e"), sign, F.abs(exponent).cast("string"))
    return F.when(c.isNull() | F.isnan(c), None).when((size != 0) & ((size < 1e-3) | (size >= 1e6)), scientific).otherwise(F.format_string(f"%.{digits}f", c))


def show_int(c: Column) -> Column:
    """Thousands apart by commas."""
    return F.format_number(c, 0)


def show_spread(mean: Column, std: Column, digits: int = 3) -> Column:
    """A mean with its deviation, as a formula; pending where there is none."""
    return F.when(mean.isNull(), "(pending)").otherwise(F.concat(F.lit("$"), F.format_string(f"%.{digits}f", mean), F.lit(r" \pm "), F.format_string(f"%.{digits}f", F.coalesce(std, F.lit(0.0))), F.lit("$")))
