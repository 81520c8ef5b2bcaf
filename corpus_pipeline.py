"""A corpus cleaning pipeline: toxicity, near duplicates, decontamination, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written and read again as the next one's ``docs``. All but the last return the
columns of ``documents``.

Rows are told apart by a number of their own or by their texts, so null and repeated
ids are documents like others: a contaminated row goes by its own text, and of linked rows
exactly one stays. A null or empty text is not toxic (as empty texts score), links
with nothing and holds no item, so it stays, and is packed as the end id alone.
Extra columns are carried to the last stage, whatever their names; an empty table
passes through all stages. Very long texts are treated whole in one task each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import decontam, ngram_join, packing, scratch, toxicity
from corvane.llm.queries import END_ID, LENGTH, learn_from, tokenizer_path

#: Rejected from this score on, as in op3.
TOXIC = 0.7


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number for each row, written, and that column's name: keys may be null or repeated."""
    row = scratch.free_name(docs, "_row")
    return scratch.materialise(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    score = scratch.free_name(docs, "_score")
    scored = toxicity.score_texts(docs, learn_from(spark, sf_dir, docs), out=score)
    return scored.where(F.col(score) < TOXIC).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the smallest id stays (of equal ids, one row)."""
    rows, row = numbered(docs)
    groups = ngram_join.jaccard_components(rows, key=row).select(F.col(row).alias("_of"), "component_id")
    named = rows.select(F.col(row).alias("_of"), F.col("doc_id").alias("_id")).join(groups, "_of")
    first = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col("_of").alias("o"))
    kept = named.groupBy("component_id").agg(F.min(first).alias("first")).select(F.col("first.o").alias(row))
    return rows.join(kept, row, "left_semi").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item is found go. What a text holds is the same in all its rows, so its digest tells them, and no row is written again."""
    of = scratch.free_name(docs, "_of")
    rows = docs.withColumn(of, F.sha2("text", 256))
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    gone = decontam.find_items(rows, bench, key=of).select(of).distinct()
    return rows.join(gone, of, "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents and their places in training sequences."""
    pieces = scratch.materialise(packing.cut_pieces(docs, tokenizer_path(), capacity=LENGTH, end_id=END_ID), "pieces")
    return packing.pack_best_fit(pieces, capacity=LENGTH).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard", drop_near_duplicates), ("decontamination", drop_contaminated), ("best_fit_packing", pack)]
#: No SQL: learned scores and packing have none; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each from what the one before wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
