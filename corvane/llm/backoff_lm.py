"""Language-model scores by a weighted backoff automaton.

States are the start, each word that training texts hold, and the root. An arc
from word v reads w, where training texts hold "v w", with its interpolated
probability ``(c(v w) - D) / c(v) + bow(v) * p(w)``; a failure arc leads from v to
the root with ``bow(v) = D * T(v) / c(v)``, T(v) counting the different words after v;
the root reads every word with ``p(w) = (c(w) + a) / (N + a * (V + 1))``, where all
unknown words are one. Each state's probabilities sum to one. D comes from the numbers
of pairs seen once and twice. A text is read once, left to right: the
state is carried from token to token, and log10 probabilities are added.

The automaton is never whole in one place. Texts are written in blocks of bounded
size, a row each. Each block asks for the totals of its different pairs, by hash, dealt
over buckets; a bucket sums what all blocks hold of a pair, answers in the order asked,
and names one block its owner. Owners count T(v) together, and a second exchange
gives each block the totals of its words. Then each block builds the states and arcs
that its own texts can reach, and reads them. A block asks once for what occurs in
it often, so no key has more rows than there are blocks, and a bucket's load
is bounded by the number of buckets, which follows the corpus.

Words and pairs are told apart by 64-bit hashes. Nulls: a null text is empty and is the
end token alone; a row with a null ``held_out`` is learned from. Repeated rows
are read and counted each. A text larger than a block is a block of its own, read whole.
Columns other than those named are ignored. An empty table gives no rows; where
there is nothing to learn from, every token is unknown, with probability 1 at
the root.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialise, new_path, parallelism, trim

#: Bytes of text of a block, and keys of a bucket.
BLOCK, BUCKET = 8 << 20, 1 << 20
#: Added to every count at the root.
ADDED = 0.1
#: Hashes of the end token and of the start, which no text holds.
_END, _START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_ASKED = "bucket int, block long, keys binary, first binary, second binary"
_TOLD = "round int, bucket int, block long, first binary, second binary, stat_a long, stat_b long"


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of each text: how many, their numbers one text after the other, and the different words."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = parts.flatten()
    real = pc.not_equal(pc.binary_length(flat), 0)
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy())
    coded = flat.filter(real).dictionary_encode()
    return np.bincount(row[real.to_numpy(zero_copy_only=False)], minlength=len(texts)), coded.indices.to_numpy(), coded.dictionary


def _blocks(df: DataFrame, key: str, text: str, held_out: Column) -> DataFrame:
    """A row for each block: keys, flags, sizes and word numbers of its texts, and its words' hashes."""
    rows = df.select(F.col(key).alias("key"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    fields = f"block long, keys array<{kind}>, held array<boolean>, sizes array<int>, ids binary, words binary"

    def block(rows, at):
        rows = pa.Table.from_batches(rows).combine_chunks()
        sizes, ids, words = tokens(rows.column("text").combine_chunks())
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words.cast(pa.large_binary()).to_pylist()), "u8", len(words))
        keys, held = (rows.column(c).combine_chunks() for c in ("key", "held"))
        whole = [keys, held, pa.array(sizes.astype("i4"))]
        row = [pa.array([at], pa.int64()), *(pa.ListArray.from_arrays([0, len(sizes)], x) for x in whole), *(pa.array([x.tobytes()], pa.binary()) for x in (ids.astype("i4"), hashes))]
        return pa.RecordBatch.from_arrays(row, ["block", "keys", "held", "sizes", "ids", "words"])

    def cut(batches):
        at, held, room = TaskContext.get().partitionId() << 32, [], BLOCK
        for b in batches:
            size = pc.fill_null(pc.binary_length(b.column(2)), 0).to_numpy()
            begin, bytes_ = 0, np.cumsum(size)
            while begin < len(b):
                before = bytes_[begin - 1] if begin else 0
                end = max(int(np.searchsorted(bytes_, before + room, "right")), begin + (not held))
                if end > begin:
                    held.append(b.slice(begin, end - begin))
                    room -= bytes_[end - 1] - before
                if end < len(b):
                    yield block(held, at)
                    at, held, room = at + 1, [], BLOCK
                begin = end
        if held:
            yield block(held, at)
        trim()

    # Bucketed by block, so that later passes read it where the answers are sent, and the texts' tokens are not shuffled.
    name = f"corvane_blocks_{uuid.uuid4().hex}"
    writer = rows.mapInArrow(cut, fields).write.option("compression", "zstd").option("path", new_path(df.sparkSession, "blocks"))
    writer.bucketBy(parallelism(df.sparkSession), "block").sortBy("block").saveAsTable(name)
    return df.sparkSession.table(name)


class _Block:
    """One block's texts as pairs of word numbers; the last two numbers are the end and the start."""

    def __init__(self, row: dict):
        words = np.frombuffer(row["words"], "u8")
        self.id, self.hashes, self.end = row["block"], np.append(words, [_END, _START]), len(words)
        self.sizes = np.asarray(row["sizes"], "i8") + 1
        last = np.cumsum(self.sizes) - 1
        self.word = np.full(self.sizes.sum(), self.end, "i8")
        inner = np.ones(len(self.word), bool)
        inner[last] = False
        self.word[inner] = np.frombuffer(row["ids"], "i4")
        self.before = np.roll(self.word, 1)
        self.before[last - self.sizes + 1] = self.end + 1
        self.train = np.repeat(~np.asarray(row["held"], bool), self.sizes)
        self.pair, pairs = pd.factorize(self.before * len(self.hashes) + self.word)
        self.pair_before, self.pair_word = np.divmod(pairs, len(self.hashes))

    def pair_keys(self) -> np.ndarray:
        """64-bit hashes of the pairs."""
        x = self.hashes[self.pair_before] * np.uint64(0xFF51AFD7ED558CCD)
        x ^= (x >> np.uint64(32)) + self.hashes[self.pair_word]
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(29))


def _deal(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the keys by bucket, the buckets that have any, and where each begins."""
    to = (keys % np.uint64(buckets)).astype("i4")
    order = np.argsort(to, kind="stable")
    there, begin = np.unique(to[order], return_index=True)
    return order, there, begin


def _asked(block: int, keys: np.ndarray, buckets: int, *values: np.ndarray) -> pa.RecordBatch:
    order, there, begin = _deal(keys, buckets)
    cut = lambda x, kind: pa.array([p.tobytes() for p in np.split(x[order].astype(kind), begin[1:])] if len(begin) else [], pa.binary())
    values = [*values, np.zeros(len(keys), "i4")][:2]
    return pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(np.full(len(there), block)), cut(keys, "u8"), *(cut(v, "i4") for v in values)], ["bucket", "block", "keys", "first", "second"])


def _totals(asked: DataFrame, stage: int, name: str) -> DataFrame:
    """Each block's answers, a row a bucket, in the order asked.

    Round 1 sums pairs: ``first`` is the total, negative for the block that owns the pair; the statistics are the
    numbers of pairs seen once and twice. Round 2 sums words: ``first`` and ``second`` are totals; the statistics are
    the number of words in training texts and of all their tokens.
    """

    def answer(table):
        table = table.sort_by("block")
        keys = np.concatenate([np.frombuffer(x, "u8") for x in table["keys"].to_pylist()])
        sizes = pc.divide(pc.binary_length(table["keys"]), 8).to_numpy()
        first, second = (np.concatenate([np.frombuffer(x, "i4") for x in table[c].to_pylist()]).astype("i8") for c in ("first", "second"))
        code, distinct = pd.factorize(keys)
        sums = [np.bincount(code, v, len(distinct)).astype("i8") for v in (first, second)]  # exact below 2 ** 53
        told = [s[code] for s in sums]
        if stage == 1:
            stats = int((sums[0] == 1).sum()), int((sums[0] == 2).sum())
            mine = np.flatnonzero(first)
            mine = mine[~pd.Series(code[mine]).duplicated().to_numpy()]
            told[0][mine] *= -1
        else:
            stats = int((sums[0] > 0).sum()), int(sums[0].sum())
        n, at = table.num_rows, np.cumsum(sizes)[:-1]
        cut = lambda x: pa.array([p.tobytes() for p in np.split(x, at)], pa.binary())
        only = lambda x: pa.array([x] + [0] * (n - 1), pa.int64())
        out = [pa.array(np.full(n, stage, "i4")), table["bucket"], table["block"], cut(told[0]), cut(told[1]) if stage == 2 else pa.array([b""] * n, pa.binary()), only(stats[0]), only(stats[1])]
        return pa.table(out, ["round", "bucket", "block", "first", "second", "stat_a", "stat_b"])

    return materialise(asked.groupBy("bucket").applyInArrow(lambda t: answer(t), _TOLD), name)


def _told(table: pa.Table, stage: int) -> list[np.ndarray]:
    """A block's answers of a round, one after the other by bucket."""
    part = table.filter(pc.equal(table["round"], stage)).sort_by("bucket")
    return [np.concatenate([np.frombuffer(x, "i8") for x in part[c].to_pylist()] or [np.zeros(0, "i8")]) for c in ("first", "second")]


def _in_place(keys: np.ndarray, buckets: int, values: np.ndarray) -> np.ndarray:
    out = np.empty(len(keys), values.dtype)
    out[_deal(keys, buckets)[0]] = values
    return out


def read_texts(block: _Block, arcs: list, fail: list, root: list) -> list[float]:
    """One traversal of each text: the state is the word before, or the root after a word that is no state.

    ``arcs`` has the log probability of each pair's arc, None where its first word has no such arc; a word that is
    no state has neither arcs nor a price for failing, as the root has.
    """
    scores, at, word, pair, before = [], 0, block.word.tolist(), block.pair.tolist(), block.end + 1
    for size in block.sizes.tolist():
        total, state = 0.0, before
        for i in range(at, at + size):
            w, arc = word[i], arcs[pair[i]]
            if arc is None:
                total += fail[state] + root[w]
            else:
                total += arc
            state = w
        scores.append(total)
        at += size
    return scores


def score_texts(df: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each row; rows that are ``held_out`` are not learned from."""
    blocks = _blocks(df, key, text, held_out)
    found = blocks.agg(F.sum(F.octet_length("ids")).alias("ids"), F.sum(F.octet_length("words")).alias("words")).first()
    least = 4 * parallelism(df.sparkSession)
    many, few = (max(least, (n or 0) // size // BUCKET + 1) for n, size in ((found.ids, 4), (found.words, 8)))

    def ask_pairs(batches):
        for batch in batches:
            for row in batch.to_pylist():
                b = _Block(row)
                yield _asked(b.id, b.pair_keys(), many, np.bincount(b.pair[b.train], minlength=len(b.pair_before)))

    pairs = _totals(blocks.mapInArrow(ask_pairs, _ASKED), 1, "pairs")
    once, twice = pairs.agg(F.sum("stat_a"), F.sum("stat_b")).first()
    discount = min(max((once or 0) / max(1, (once or 0) + 2 * (twice or 0)), 0.1), 0.9)

    def ask_words(left, right):
        out = []
        for row in left.to_pylist():
            b = _Block(row)
            owned = _in_place(b.pair_keys(), many, _told(right, 1)[0]) < 0
            n = len(b.hashes)
            out.append(_asked(b.id, b.hashes, few, np.bincount(b.word[b.train], minlength=n), np.bincount(b.pair_before[owned], minlength=n)))
        return pa.Table.from_batches(out, _asked(0, _START[None], 1, np.zeros(1)).schema)

    answers = pairs.select("round", "bucket", "block", "first", "second")
    words = _totals(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda x, y: ask_words(x, y), _ASKED), 2, "words")
    vocabulary, total = (x or 0 for x in words.agg(F.sum("stat_a"), F.sum("stat_b")).first())

    def read(left, right):
        out = []
        for row in left.to_pylist():
            b = _Block(row)
            seen = np.abs(_in_place(b.pair_keys(), many, _told(right, 1)[0]))
            count, after = (_in_place(b.hashes, few, x) for x in _told(right, 2))
            p = (count + ADDED) / (total + ADDED * (vocabulary + 1))
            context = count.copy()
            context[b.end + 1] = count[b.end]  # a start for each end
            mass = discount * after / np.maximum(context, 1)  # 0 for what is no state
            fail = np.log10(np.where(mass > 0, mass, 1.0))
            v, w = b.pair_before, b.pair_word
            arc = np.log10(np.where(seen > 0, (seen - discount) / np.maximum(context[v], 1) + mass[v] * p[w], 1.0))
            arcs = [x if s else None for x, s in zip(arc.tolist(), seen.tolist(), strict=True)]
            root = np.log10(p)
            begin = np.cumsum(b.sizes) - b.sizes
            scores = read_texts(b, arcs, fail.tolist(), root.tolist())
            m = len(scores)
            out.append(pa.table(
                [pa.array(row["keys"], left.schema.field("keys").type.value_type), pa.array(row["held"], pa.bool_()), pa.array(b.sizes), pa.array(np.add.reduceat((count[b.word] > 0).astype("i8"), begin)), pa.array(np.full(m, total, "i8")), pa.array(np.add.reduceat(root[b.word], begin)), pa.array(scores)],
                [key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            ))
        trim()
        return pa.concat_tables(out)

    kind = df.schema[key].dataType.simpleString()
    answers = answers.unionByName(words.select(*answers.columns))
    out = f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda x, y: read(x, y), out)
