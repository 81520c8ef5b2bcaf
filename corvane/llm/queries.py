"""Registered queries of this subpackage, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import backoff_lm, chat_format, decontam, filter_audit, html_extract, ngram_join, order_minhash, packing, scratch, sharding, token_counts, token_store, toxicity, whitening

#: The end-of-document id of op2 and op7, the sequence length, and the limit of op9.
END_ID, LENGTH = 2, 1024


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    log = chat_format.log_of(turns.unionByName(extra))
    return chat_format.read_back(chat_format.format_chats(log, parts=("message", "copy")))


def op2_token_store(spark, sf_dir):
    path = scratch.new_path(spark, "tokens")
    token_store.write_token_store(_table(spark, sf_dir, "documents"), path, tokenizer_path(), end_id=END_ID)
    return token_store.store_digests(spark, path).withColumnRenamed("key", "doc_id")


def learn_from(spark, sf_dir, docs):
    """A lexicon from the labelled rows of ``docs`` that are not held out."""
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    return toxicity.learn_lexicon(toxicity.labelled_sample(docs, _table(spark, sf_dir, "labels"), where=~held_out))


def op3_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    scored = toxicity.score_texts(docs.select("doc_id", "text"), learn_from(spark, sf_dir, docs))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_jump_sharding(spark, sf_dir):
    return sharding.shard_rows(_table(spark, sf_dir, "documents"), shards=8)


def op5_ngram_jaccard(spark, sf_dir):
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op6_decontamination(spark, sf_dir):
    found = decontam.find_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("item", "item_id")


def op7_best_fit_packing(spark, sf_dir):
    pieces = scratch.materialise(packing.cut_pieces(_table(spark, sf_dir, "documents"), tokenizer_path(), capacity=LENGTH, end_id=END_ID), "pieces")
    packed = packing.pack_best_fit(pieces, capacity=LENGTH)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_html_extraction(spark, sf_dir):
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"))


def op9_token_counts(spark, sf_dir):
    cache = scratch.new_path(spark, "counts")
    docs = _table(spark, sf_dir, "documents")
    token_counts.count_tokens(docs, tokenizer_path(), cache)  # encodes what the cache lacks: at first, everything
    counts = token_counts.count_tokens(docs, tokenizer_path(), cache)  # looks all of it up
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LENGTH).alias("over_limit"))


def op10_order_minhash(spark, sf_dir):
    return order_minhash.fingerprint_edits(_table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark, sf_dir):
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark, sf_dir):
    return filter_audit.audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_lm_scoring(spark, sf_dir):
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) == 0
    return backoff_lm.score_texts(_table(spark, sf_dir, "documents"), held_out)


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_chat_formatting, op2_token_store, op3_toxicity, op4_jump_sharding, op5_ngram_jaccard, op6_decontamination, op7_best_fit_packing,
            op8_html_extraction, op9_token_counts, op10_order_minhash, op11_embedding_whitening, op12_filter_audit, op13_lm_scoring,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_formatting": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), safe AS (
  SELECT *, regexp_replace(replace(text, '\', '\\'), '<\||<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<start_of_turn>|<end_of_turn>', '~', 'g') AS gone,
    length(replace(text, '\', '\\')) AS plain,
    len(regexp_extract_all(replace(text, '\', '\\'), '<\||<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<start_of_turn>|<end_of_turn>')) AS marks
  FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(8 + length(role) + 8 + plain + marks + 8) AS BIGINT) AS formatted_chars
FROM safe GROUP BY conv_id""",
        "op12_filter_audit": r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), known AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), rows AS (
  SELECT t.part, coalesce(k.good, 0) AS good, coalesce(k.toxic, 0) AS toxic,
    CASE WHEN len(words) < 200 THEN 1 ELSE 0 END AS a,
    CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 1 ELSE 0 END AS b,
    CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 1 ELSE 0 END AS c,
    CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 1 ELSE 0 END AS d,
    CASE WHEN t.doc_id > min(t.doc_id) OVER (PARTITION BY text) THEN 1 ELSE 0 END AS e
  FROM texts t LEFT JOIN known k ON t.doc_id = k.doc_id
), cells AS (
  SELECT part, good, toxic, a + 2 * b + 4 * c + 8 * d + 16 * e AS mask, count(*) AS n FROM rows GROUP BY ALL
), letters AS (
  SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS t(f, bit)
), orders AS (
  SELECT p.f || q.f || r.f || s.f || t.f AS filter_order, p.bit AS b1, q.bit AS b2, r.bit AS b3, s.bit AS b4, t.bit AS b5
  FROM letters p, letters q, letters r, letters s, letters t WHERE p.bit | q.bit | r.bit | s.bit | t.bit = 31
), steps AS (
  SELECT filter_order, 1 AS step, 0 AS applied, b1 AS bit FROM orders
  UNION ALL SELECT filter_order, 2, b1, b2 FROM orders
  UNION ALL SELECT filter_order, 3, b1 + b2, b3 FROM orders
  UNION ALL SELECT filter_order, 4, b1 + b2 + b3, b4 FROM orders
  UNION ALL SELECT filter_order, 5, b1 + b2 + b3 + b4, b5 FROM orders
), counted AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (applied | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & applied = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & applied <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & applied = 0 AND mask & bit <> 0 AND good = 1 THEN n ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & applied = 0 AND mask & bit <> 0 AND toxic = 1 THEN n ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM counted""",
    }
