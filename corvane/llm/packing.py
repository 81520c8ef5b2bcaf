"""Best-fit packing of token sequences under vector capacities.

An item's needs are a vector that its length fixes: tokens, one document, and
attention cost (length squared). So the packing is worked out for the histogram
of lengths, at most ``capacity`` of them whatever the corpus holds: longest
first, each item goes to the open bin that still fits it under every capacity
and leaves the least weighted norm of residuals (or has the largest weighted dot
product with it). Bins in the same state are placed in bulk, which gives the
same bins as one item at a time. The plan, runs of ranks within a length to
runs of bins, is broadcast while it is small; beyond that it is written as a table
and joined by stretches of ranks.

Only texts longer than the capacity are cut, in pieces of the capacity; the
first piece takes what is left over, and whole pieces fill bins of their own.

Nulls: a null text is empty and has the end id alone; a null key is one like
others. Repeated rows are packed each. A very long text is cut in its task. Other
columns of ``pieces``, whatever their names, are kept, but for ``sequence_id`` and
``offset``, which are replaced. An empty table gives no pieces.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .scratch import free_name, materialise, parallelism, trim

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Up to so many runs, of 48 bytes each, are broadcast; more are joined, by stretches of so many ranks.
MAX_RUNS, STRETCH = 200_000, 1 << 16


def cut_pieces(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """The pieces of each text: place, length and checksum of their ids."""
    end = np.asarray([end_id], "<u4")

    def cut(batches):
        encode_batch = encoder(tokenizer, tight=True).encode_batch
        for batch in batches:
            at = 0
            for sizes, ids in encode_batch(batch.column(1)):
                view = memoryview(np.insert(ids, np.cumsum(sizes), end[0])).cast("B")
                sizes = sizes + 1
                begin = np.cumsum(sizes) - sizes
                n = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                first = ((sizes - 1) % capacity + 1)[row]
                start = np.where(piece > 0, first + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, first)
                place = (begin[row] + start).tolist()
                sums = [zlib.crc32(view[4 * p : 4 * (p + k)]) for p, k in zip(place, length.tolist(), strict=True)]
                keys = batch.column(0).slice(at, len(sizes)).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([keys, pa.array(piece.astype("i4")), pa.array(start), pa.array(length), pa.array(sums, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])
                at += len(sizes)
        trim()

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, PIECES)


def plan_best_fit(
    counts: dict[int, int], capacity: int = 1024, max_docs: int = 1024, max_cost: int | None = None,
    weights: tuple[float, float, float] = (1.0, 0.05, 0.2), rule: str = "norm",
) -> list[tuple[int, int, int, int, int, int]]:
    """Runs ``(length, rank, n_items, bin, per_bin, offset)``: items of a length from ``rank`` on,
    ``per_bin`` of them to each bin from ``bin`` on, at ``offset`` tokens in it."""
    cost = max_cost or capacity * capacity
    if not 0 < max(counts, default=1) <= capacity or any(n * n > cost for n in counts):
        raise ValueError("an item is larger than a bin")
    runs: list[tuple[int, int, int, int, int, int]] = []
    open_bins: dict[tuple[int, int, int], list[tuple[int, int]]] = defaultdict(list)  # residual -> runs of bins
    by_tokens: dict[int, set[tuple[int, int, int]]] = defaultdict(set)
    next_bin = 0

    def put(state, first, n):
        if state[0] > 0 and state[1] > 0:
            open_bins[state].append((first, n))
            by_tokens[state[0]].add(state)

    def score(state, length):
        need = (length / capacity, 1 / max_docs, length * length / cost)
        left = [x / full for x, full in zip(state, (capacity, max_docs, cost), strict=True)]
        if rule == "dot":
            return -sum(w * a * b for w, a, b in zip(weights, need, left, strict=True)), state
        return sum(w * (a - b) ** 2 for w, a, b in zip(weights, left, need, strict=True)), state

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        fitting = [(score(s, length), s) for t in range(length, capacity + 1) for s in by_tokens.get(t, ()) if s[1] >= 1 and s[2] >= length * length]
        heapq.heapify(fitting)
        while left:
            if fitting:
                state = heapq.heappop(fitting)[1]
                source = open_bins.pop(state)
                by_tokens[state[0]].discard(state)
            else:
                state, source = (capacity, max_docs, cost), [(next_bin, left)]
            per = min(state[0] // length, state[1], state[2] // (length * length))
            # By dot product an emptier bin comes first, so each open bin gets one item before any gets another.
            again = rule == "dot" and state[1] < max_docs and per > 1
            per = 1 if again else per
            while source and left:
                first, n = source.pop()
                used = min(n, -(-left // per))
                whole = min(used, left // per)
                for bins, each in ((whole, per), (used - whole, left - whole * per)):
                    if bins:
                        runs.append((length, rank, bins * each, first, each, capacity - state[0]))
                        put((state[0] - each * length, state[1] - each, state[2] - each * length * length), first, bins)
                        rank, left, first = rank + bins * each, left - bins * each, first + bins
                if state[0] == capacity and state[1] == max_docs:
                    next_bin += used
                elif n > used:
                    source.append((first, n - used))
            after = (state[0] - length, state[1] - 1, state[2] - length * length)
            if again and after in open_bins:
                heapq.heappush(fitting, (score(after, length), after))
            if source and state[0] < capacity:
                for first, n in source:
                    put(state, first, n)
    return runs


def pack_best_fit(pieces: DataFrame, capacity: int = 1024, max_docs: int = 1024, max_cost: int | None = None, rule: str = "norm") -> DataFrame:
    """``pieces`` (with ``doc_id, piece, length``) and the ``sequence_id`` and ``offset`` of each.

    Ranks within a length are counted in two steps, by blocks of documents, so no task gets all of a length.
    """
    spark = pieces.sparkSession
    blocks = 16 * parallelism(spark)
    pieces = pieces.drop("sequence_id", "offset")
    kept = pieces.columns
    block, base, at, rank = (free_name(pieces, c) for c in ("block", "base", "at", "rank"))
    pieces = pieces.withColumn(block, F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)))
    sizes = materialise(pieces.groupBy("length", block).agg(F.count("*").alias("_n")), "lengths")
    counts = {r.length: r.n for r in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most ``capacity`` rows
    runs = np.asarray(sorted(plan_best_fit(counts, capacity, max_docs, max_cost, rule=rule)), "i8").reshape(-1, 6)
    before = Window.partitionBy("length").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    # Written, so that the join keeps both keys: dealt by length alone, as this window is, one length's pieces would meet in one task.
    bases = materialise(sizes.select("length", block, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(base)), "bases")
    order = Window.partitionBy("length", block).orderBy("doc_id", "piece", "start")
    ranked = pieces.withColumn(at, F.row_number().over(order) - 1).join(bases, ["length", block])
    ranked = ranked.select(*kept, (F.col(base) + F.col(at)).alias(rank))
    return _placed(ranked, runs, rank) if len(runs) <= MAX_RUNS else _joined(ranked, runs, rank)


def _placed(ranked: DataFrame, runs: np.ndarray, rank: str) -> DataFrame:
    """Sequences and offsets from a broadcast plan."""
    plan = ranked.sparkSession.sparkContext.broadcast(runs)

    def place(batches):
        runs = plan.value
        key = runs[:, 0] * (1 << 44) + runs[:, 1]  # ranks stay below 2 ** 44
        for b in batches:
            length, ranks = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", rank))
            run = runs[np.searchsorted(key, length * (1 << 44) + ranks, "right") - 1] if len(runs) else runs
            inside = ranks - run[:, 1]
            seq = run[:, 3] + inside // run[:, 4]
            offset = run[:, 5] + inside % run[:, 4] * length
            yield b.append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(offset))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema)
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long").drop(rank)


def _joined(ranked: DataFrame, runs: np.ndarray, rank: str) -> DataFrame:
    """Sequences and offsets from a plan of any size: each run goes to the stretches of ranks that it touches."""
    spark = ranked.sparkSession
    names = [free_name(ranked, f"_plan_{c}") for c in ("length", "rank", "n", "bin", "per", "offset", "stretch")]
    length, begin, n, bin_, per, offset, stretch = map(F.col, names)
    rows = None
    for i in range(0, len(runs), 1_000_000):
        part = spark.createDataFrame(pa.table([pa.array(c) for c in runs[i : i + 1_000_000].T], names[:6]))
        rows = part if rows is None else rows.union(part)
    first, last = F.floor(begin / STRETCH), F.floor((begin + n - 1) / STRETCH)
    rows = materialise(rows.withColumn(names[6], F.explode(F.sequence(first, last))), "plan")
    inside = F.col(rank) - begin
    held = (F.col("length") == length) & (F.floor(F.col(rank) / STRETCH) == stretch) & (inside >= 0) & (inside < n)
    seq, offset = bin_ + F.floor(inside / per), offset + inside % per * F.col("length")
    return ranked.join(rows, held).select(*(c for c in ranked.columns if c != rank), seq.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))
