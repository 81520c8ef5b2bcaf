"""Token counts through a cache of digests.

A text's content digest (of its UTF-8 bytes; null counts as empty, and no other
normalisation, since any other could change the tokens) and the tokenizer's
version digest (of its file) are looked up in a stored table. Distinct misses
are found from digests alone; one text of each is encoded, and its count is
appended to the store. A rerun encodes only what is new.

Repeated rows keep their rows and are encoded once (twice at the most, where a
frequent digest is split over tasks; the lookup takes one). Null keys are keys
like others. A very long text is counted by itself. Columns other than those
named are ignored. An empty table gives no rows and appends none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .scratch import materialise, spread_join, trim

CACHE = "digest binary, version string, n_tokens long"


def tokenizer_version(path: str) -> str:
    """Digest of a tokenizer's file, as the driver has it."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _counts(df: DataFrame, tokenizer: str, kind: str) -> DataFrame:
    """``digest, version, n_tokens`` for ``digest, version, text``, each digest once a task."""

    def count(batches):
        if kind == "model":
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=tokenizer)
            sizes = lambda texts: np.asarray([len(model.encode(t, num_threads=1)) for t in texts.to_pylist()], "i8")
        else:
            sizes = encoder(tokenizer).count_batch
        seen: set[bytes] = set()
        for b in batches:
            fresh = [d not in seen and not seen.add(d) for d in b.column(0).to_pylist()]
            b = b if all(fresh) else b.filter(pa.array(fresh, pa.bool_()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes(b.column(2)), pa.int64())], ["digest", "version", "n_tokens"])
        trim()

    return df.mapInArrow(count, CACHE)


def read_cache(spark, path: str, version: str) -> DataFrame:
    """``digest, n_tokens`` as stored; no rows where there is no store yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], CACHE).select("digest", "n_tokens")
    stored = spark.read.schema(CACHE).parquet(path).where(F.col("version") == version)
    return stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _digests(df: DataFrame, key: str, text: str) -> DataFrame:
    content = F.coalesce(F.col(text), F.lit(""))
    return df.select(F.col(key).alias("key"), F.octet_length(content).cast("long").alias("n_bytes"), F.unhex(F.sha2(content, 256)).alias("digest"))


def _add_missing(rows: DataFrame, df: DataFrame, tokenizer: str, cache: str, key: str, text: str) -> int:
    """Encode one text of each digest of ``rows`` that the store lacks, and append the counts; how many there were."""
    version = tokenizer_version(tokenizer)
    stored = read_cache(df.sparkSession, cache, version)
    # One row stands for each digest: found without its text, which only then is fetched.
    miss = materialise(rows.groupBy("digest").agg(F.min("key").alias("key")).join(stored, "digest", "left_anti"), "misses")
    n = miss.count()
    if n:
        texts = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
        same = texts["key"].eqNullSafe(miss["key"]) & (texts["digest"] == miss["digest"])
        # By sorted merge, equal rows meet in one task, and rows that memory does not hold spill.
        picked = texts.join(miss.hint("merge"), same, "left_semi").select("digest", F.lit(version).alias("version"), "text")
        _counts(picked, tokenizer, "model" if tokenizer.endswith(".model") else "json").write.mode("append").parquet(cache)
    return n


def count_tokens(df: DataFrame, tokenizer: str, cache: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_bytes, n_tokens`` of each row; the cache at ``cache`` gains what it lacked."""
    rows = materialise(_digests(df, key, text), "digests")
    _add_missing(rows, df, tokenizer, cache, key, text)
    counts = read_cache(df.sparkSession, cache, tokenizer_version(tokenizer))
    copies = rows.groupBy("digest").agg(F.count("*").alias("_n"))
    found = spread_join(rows, counts, copies, ["digest"], F.struct("key", "n_bytes"))
    return found.select(F.col("key").alias(key), "n_bytes", "n_tokens")
