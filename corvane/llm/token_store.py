"""Token ids as Parquet: list columns, dictionary and delta encodings, page indexes.

Texts are dealt by ranges of their key, so that each file holds one stretch of
the corpus in order, and encoded as they are written. Ids are a list column
(dictionary encoding, 16 bits an id for vocabularies of that size); keys and
lengths are delta encoded. Row groups and pages are small enough that a reader
of one document's ids, or of the metadata alone, reads little else.

Nulls: a null text is empty, so it has the end id alone; a row with a null key
comes first. Repeated keys keep all their rows, ordered by text. An empty table
gives an empty store. Other columns of the input are ignored, whatever their
names. A very long text is encoded by itself and is one list in one row.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .scratch import parallelism, trim


def encode_tokens(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int | None = 2) -> DataFrame:
    """``key``, ``n_tokens`` and ``ids`` of each row, in the order of the input's partitions."""
    last = np.asarray([] if end_id is None else [end_id], "<u4")

    def encode(batches):
        encode_batch = encoder(tokenizer).encode_batch
        for batch in batches:
            at = 0
            for sizes, ids in encode_batch(batch.column(1)):
                inner = np.cumsum(sizes)
                ids = np.insert(ids, np.repeat(inner, len(last)), np.tile(last, len(sizes))) if len(last) else ids
                sizes = sizes + len(last)
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype("i4")
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.view("<i4")))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sizes)), pa.array(sizes), lists], ["key", "n_tokens", "ids"])
                at += len(sizes)
        trim()

    return df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(encode, "key long, n_tokens long, ids array<int>")


def write_token_store(
    df: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int | None = 2,
    row_group_bytes: int = 32 << 20, page_rows: int = 500, partitions: int | None = None,
) -> None:
    """Write the store: ``key, n_tokens, ids`` in ascending key order, file after file."""
    texts = df.select(F.col(key).alias(key), F.col(text).alias(text))
    dealt = texts.repartitionByRange(partitions or parallelism(df.sparkSession), F.col(key)).sortWithinPartitions(key, text)
    (
        encode_tokens(dealt, tokenizer, key, text, end_id)
        .write.option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.block.size", row_group_bytes).option("parquet.page.row.count.limit", page_rows)
        .option("parquet.enable.dictionary#ids.list.element", "true").option("parquet.enable.dictionary#key", "false")
        .option("parquet.enable.dictionary#n_tokens", "false").parquet(path)
    )


def read_token_store(spark, path: str, ids: bool = True) -> tuple[DataFrame, DataFrame]:
    """Two tables. Rows: ``file, at, key, n_tokens`` (and ``ids``). Files: ``file, base``, the tokens of all files before.

    A row's start is its file's base and the tokens before it in the file, so only one row a file meets in one place.
    """
    store = spark.read.schema("key long, n_tokens long, ids array<int>").parquet(path)
    lengths = store.select(F.col("_metadata.file_path").alias("file"), "key", "n_tokens")
    files = lengths.groupBy("file").agg(F.min("key").alias("first"), F.sum("n_tokens").alias("total"))
    before = Window.orderBy(F.asc_nulls_first("first"), "file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    rows = store.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"), "key", "n_tokens", *["ids"] * ids)
    return rows, files


def store_digests(spark, path: str) -> DataFrame:
    """``key, start, n_tokens, ids_crc32`` of each row, from the files."""
    rows, files = read_token_store(spark, path)

    def crc(batches):
        for b in batches:
            ids = b.column(4)
            flat, ends = ids.values.to_numpy(), ids.offsets.to_numpy()
            view = memoryview(np.ascontiguousarray(flat, "<i4")).cast("B")
            sums = [zlib.crc32(view[4 * s : 4 * e]) for s, e in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(sums, pa.int64())], ["file", "at", "key", "n_tokens", "ids_crc32"])

    digests = rows.mapInArrow(crc, "file string, at long, key long, n_tokens long, ids_crc32 long")
    within = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    digests = digests.withColumn("inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return digests.join(files, "file").select("key", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
