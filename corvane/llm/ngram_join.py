"""Exact Jaccard self-join on word n-grams, with skipping by set relations.

1. Each text becomes a set of 64-bit shingle hashes, computed column-wise.
2. Shingles are counted over the corpus: a task sends the shingles of a batch of
   documents, packed by bucket, and the buckets answer with those that are
   shared, by how many (in powers of two). A shingle of one document cannot be
   part of an intersection, so from here on sets are their shared shingles.
3. Equal sets are one *representative*. Its shingles are ordered rarest first;
   two sets that link must share one of their first |x| - ceil(t |x|) + 1.
   Unshared shingles come first of all, so most texts index nothing.
4. Inverted lists of those prefixes are split by size class and by block of
   positions; class pairs that cannot link by size, and blocks from which on the
   overlap with a class cannot be reached, never meet: pairs of classes are part
   of the join's key, and a block is sent only to those it can reach.
5. Each representative is compared with one *pivot* of its lists, the same for a
   family of similar sets; the family's answers are then derived from the
   pivot's: members of one pivot are connected through it, and only pivots are
   compared across families. Jaccard distance is a metric, so members of two
   pivots need comparing only if d(p, q) <= (1 - t) + r(x) + r(y).
6. Links are joined to components by spreading the smallest id.

Nothing is capped. Pairs within a family are not emitted: it costs one comparison
a member. Where two families of different components may hold members that link by
the bound of step 5, the sets of the smaller are compared with the pivot of the larger,
and which of its members they can link with is derived from both one's differences to
that pivot, so only these pairs are compared.

Texts are lower-cased for A-Z and cut at ASCII white space. A set has the
distinct n-word shingles; with fewer words, the whole sequence as one; without
words (or text) it is empty and links with nothing. Every row is a document of
its own, those with null or repeated keys too; a component is named by its least
key that is not null, and is null where it has none. Repeated rows are equal
sets, so they share a component. Texts are cut into shingles by stretches of
bytes, a very long one by itself. Other columns, whatever their names, are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialise, parallelism, spread_join, trim

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64
#: Shingles in a batch that is counted together, and characters of the texts that are cut into shingles together.
BATCH, SLICE = 400_000, 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words, by multiplications and shifts."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[:1] = 1
    return np.multiply.accumulate(out)


def shingle_sets(texts: list[str | None], n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the texts' sets, and their hashes, sorted within each text."""
    raw = b"\n".join((t or "").encode("utf-8", "surrogatepass") for t in texts) + b"\n"
    data = np.frombuffer(raw, np.uint8)
    upper = (data >= 65) & (data <= 90)
    data = np.where(upper, data + 32, data)
    ends = np.cumsum([len((t or "").encode("utf-8", "surrogatepass")) + 1 for t in texts]) if texts else np.zeros(0, "i8")
    solid = np.concatenate([[False], ~_WHITE[data], [False]])
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    start, stop = edge[0::2], edge[1::2]
    if not len(start):
        return np.zeros(len(texts), "i8"), np.zeros(0, _U)
    # A word's hash: its bytes as a polynomial, from prefix sums; odd bases have inverses modulo 2**64.
    inverse = pow(_BASE, -1, 1 << 64)
    with np.errstate(over="ignore"):
        chunk, hashes = 1 << 19, np.empty(len(start), _U)
        at = 0
        while at < len(start):  # in stretches, for memory
            to = max(at + 1, int(np.searchsorted(stop, start[at] + chunk, "right")))
            lo, hi = int(start[at]), int(stop[to - 1])
            up = _powers(hi - lo, _BASE)
            sums = np.concatenate([np.zeros(1, _U), np.cumsum(_mix(data[lo:hi].astype(_U) + _U(1)) * up, dtype=_U)])
            down = _powers(hi - lo, inverse)
            s, e = start[at:to] - lo, stop[at:to] - lo
            hashes[at:to] = _mix((sums[e] - sums[s]) * down[s] + (e - s).astype(_U))
            at = to
        words_before = np.searchsorted(start, np.concatenate([[0], ends]), "left")
        words = np.diff(words_before)
        counts = np.where(words >= n, words - n + 1, np.minimum(words, 1))
        total = int(counts.sum())
        doc = np.repeat(np.arange(len(texts)), counts)
        first = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(words_before[:-1], counts)
        length = np.minimum(words, n)[doc]
        out = np.zeros(total, _U)
        for j in range(n):
            inside = j < length
            w = hashes[np.minimum(first + j, len(hashes) - 1)]
            out = np.where(inside, _mix(out * _U(0xD6E8FEB86659FD93) + w), out)
    order = np.lexsort((out, doc))
    out, doc = out[order], doc[order]
    fresh = np.ones(total, bool)
    fresh[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    return np.bincount(doc[fresh], minlength=len(texts)), out[fresh]


def _pack(h: np.ndarray) -> bytes:
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes()  # 56 bits; the bucket has the ones above


def _unpack(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(b, np.uint8).reshape(-1, 7)
    return out.view("<u8").ravel()


def _slices(texts: list[str | None], most: int):
    """Stretches of ``texts`` of about ``most`` characters; at least one text each."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "") + 1
        if held >= most:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


_SENT = "bucket int, batch long, docs array<long>, keys array<long>, sizes binary, sums binary, hashes binary"
_BINARY = [pa.binary()] * 3


def _send(docs: DataFrame, n: int, bits: int) -> DataFrame:
    """Batches of sets, cut by bucket. A head row (with ``docs``) has the batch's ids, keys, sizes and set digests."""
    names, types = [f.split()[0] for f in _SENT.split(", ")], [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), *_BINARY]

    def flush(ids, keys, sizes, hashes):
        with np.errstate(over="ignore"):
            edges = np.concatenate([[0], np.cumsum(sizes)]).astype("i8")
            sums = []
            for salt in (1, 2):  # sums of mixed elements: equal for equal sets
                run = np.concatenate([np.zeros(1, _U), np.cumsum(_mix(hashes ^ _U(salt * 0x5851F42D4C957F2D)), dtype=_U)])
                sums.append(run[edges[1:]] - run[edges[:-1]])
        bucket = (hashes >> _U(64 - bits)).astype("i8")
        doc = np.repeat(np.arange(len(ids)), sizes)
        order = np.argsort(bucket, kind="stable")
        there, begin = np.unique(bucket[order], return_index=True)
        rows = [(int(bucket[0]) if len(bucket) else 0, ids[0], ids, keys, np.asarray(sizes, "<i4").tobytes(), np.concatenate(sums).astype("<u8").tobytes(), None)]
        for b, part in zip(there.tolist(), np.split(order, begin[1:]) if len(there) else [], strict=True):
            per = np.bincount(doc[part], minlength=len(ids))
            rows.append((b, ids[0], None, None, per.astype("<i4").tobytes(), None, _pack(hashes[part])))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def send(batches):
        ids, keys, sizes, parts, held = [], [], [], [], 0
        for b in batches:
            row, key, text = (b.column(i).to_pylist() for i in range(3))
            for i, j in _slices(text, SLICE):
                s, h = shingle_sets(text[i:j], n)
                ids, keys, sizes, held = ids + row[i:j], keys + key[i:j], sizes + s.tolist(), held + len(h)
                parts.append(h)
                if held >= BATCH:
                    yield flush(ids, keys, sizes, np.concatenate(parts))
                    ids, keys, sizes, parts, held = [], [], [], [], 0
        if ids:
            yield flush(ids, keys, sizes, np.concatenate(parts))
        trim()

    return docs.mapInArrow(send, _SENT)


_ANSWER = "batch long, bucket int, docs array<long>, keys array<long>, sizes binary, sums binary, hashes binary, levels binary"


def _answer(sent: DataFrame) -> DataFrame:
    """Of each batch's shingles in a bucket, those that several documents have, with log2 of how many."""
    names, types = [f.split()[0] for f in _ANSWER.split(", ")], [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), *_BINARY, pa.binary()]

    def answer(key, table):
        is_head = table["docs"].is_valid()
        heads, rest = table.filter(is_head), table.filter(pa.compute.invert(is_head))
        bucket = key[0].as_py()
        out = [(b, bucket, d, k, s, m, None, None) for b, d, k, s, m in zip(*(heads[c].to_pylist() for c in ("batch", "docs", "keys", "sizes", "sums")), strict=True)]
        packed = rest["hashes"].to_pylist()
        if packed:
            parts = [_unpack(p) for p in packed]
            every = np.sort(np.concatenate(parts))
            fresh = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
            n = np.diff(np.concatenate([fresh, [len(every)]]))
            shared, level = every[fresh[n > 1]], np.log2(n[n > 1]).astype(np.uint8)
            for b, per, p in zip(rest["batch"].to_pylist(), rest["sizes"].to_pylist(), parts, strict=True):
                at = np.searchsorted(shared, p)
                at[at == len(shared)] = 0
                hit = shared[at] == p if len(shared) else np.zeros(len(p), bool)
                if hit.any():
                    per = np.frombuffer(per, "<i4")
                    doc = np.repeat(np.arange(len(per)), per)[hit]
                    out.append((b, bucket, None, None, np.bincount(doc, minlength=len(per)).astype("<i4").tobytes(), None, _pack(p[hit]), level[at[hit]].tobytes()))
        return pa.table([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 8, types, strict=True)], names)

    return sent.groupBy("bucket").applyInArrow(answer, _ANSWER)


_SETS = "id long, key long, n int, a long, b long, tokens array<long>, prefix int"


def _gather(answers: DataFrame, percent: int, bits: int) -> DataFrame:
    """Per document: size, digest, shared shingles rarest first, and how many of them are in its prefix."""

    def gather(_, table):
        is_head = table["docs"].is_valid()
        head, rest = table.filter(is_head), table.filter(pa.compute.invert(is_head))
        ids, keys = (pa.array(head[c][0].as_py(), pa.int64()) for c in ("docs", "keys"))
        n = np.frombuffer(head["sizes"][0].as_py(), "<i4").astype("i8")
        m, sums = len(ids), np.frombuffer(head["sums"][0].as_py(), "<i8")
        doc, tok, lev = [np.zeros(0, "i8")], [np.zeros(0, "i8")], [np.zeros(0, "u1")]
        for bucket, per, h, level in zip(*(rest[c].to_pylist() for c in ("bucket", "sizes", "hashes", "levels")), strict=True):
            doc.append(np.repeat(np.arange(m), np.frombuffer(per, "<i4")))
            tok.append((_unpack(h) | (_U(bucket >> (bits - 8)) << _U(56))).astype("i8"))
            lev.append(np.frombuffer(level, "u1"))
        doc, tok, lev = np.concatenate(doc), np.concatenate(tok), np.concatenate(lev)
        order = np.lexsort((tok, lev, doc))
        doc, tok = doc[order], tok[order]
        shared = np.bincount(doc, minlength=m)
        need = -(-percent * n // 100)
        prefix = np.maximum(0, n - need + 1 - (n - shared)) * (n > 0)
        prefix = np.minimum(prefix, shared)
        wanted = prefix > 0
        keep = np.repeat(wanted, shared)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(wanted, shared, 0))]).astype("i4")), pa.array(tok[keep]))
        columns = [ids, keys, pa.array(n.astype("i4")), pa.array(sums[:m]), pa.array(sums[m:]), lists, pa.array(prefix.astype("i4"))]
        return pa.table(columns, [f.split()[0] for f in _SETS.split(", ")])

    return answers.groupBy("batch").applyInArrow(gather, _SETS)


def _compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``x, y`` with the sizes of both sets, of their intersection and union. Each y's set goes to its pairs once a group."""
    left, right = (sets.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("tokens").alias(f"t_{c}")) for c in ("x", "y"))

    def overlap(batches):
        for b in batches:
            x, y = b.column(2), b.column(3)
            xv, yv, xo, yo = x.values.to_numpy(), y.values.to_numpy(), x.offsets.to_numpy(), y.offsets.to_numpy()
            common = [len(np.intersect1d(xv[p:q], yv[r:s], assume_unique=True)) for p, q, r, s in zip(xo[:-1], xo[1:], yo[:-1], yo[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(4), b.column(5), pa.array(common, pa.int64())], ["x", "y", "n_x", "n_y", "common"])
        trim()

    both = pairs.join(left, "x").join(right, "y").select("x", "y", "t_x", "t_y", "n_x", "n_y")
    return both.mapInArrow(overlap, "x long, y long, n_x int, n_y int, common long").withColumn("either", F.col("n_x") + F.col("n_y") - F.col("common"))


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root`` for the nodes of ``links`` (``x, y``): the smallest id reachable. Alternates large and small stars."""
    edges = materialise(links.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).where("u < v").distinct(), "edges")
    for _ in range(max_rounds):
        # Large star: each node's larger neighbours point to its smallest one.
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u < v").distinct()
        # Small star: each node and its smaller neighbours point to the smallest.
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v")).where("u < v").distinct()
        after = materialise(small, "edges")
        same = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        was = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        edges = after
        if same == was:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))


def _families(lists: DataFrame, reps: DataFrame, linked: Column, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """Links ``x, y`` of representatives with their pivots, and ``rep, pivot, r`` (their distance).

    Of a list the set with fewest shingles of its own leads: near copies of a text have each some that no other text has,
    the text itself has none, so the middle of a family comes before its edges. Sets that are too far from their pivot
    look for one among themselves in the next round.
    """
    near = family = None
    left = lists
    for _ in range(rounds):
        lead = F.struct("own", F.col("rep").alias("pivot"))
        heads = left.groupBy("token", "class").agg(F.min(lead).alias("lead"), F.count("*").alias("size")).where("size > 1")
        pivots = left.join(heads.select("token", "class", "lead"), ["token", "class"]).groupBy("rep").agg(F.min("lead").alias("lead")).where("lead.pivot <> rep")
        found = materialise(_compare(pivots.select(F.col("rep").alias("x"), F.col("lead.pivot").alias("y")), reps).where(linked), "near")
        own = found.select(F.col("x").alias("rep"), F.col("y").alias("pivot"), (1 - F.col("common") / F.col("either")).alias("r"))
        near, family = (found, own) if near is None else (near.union(found), family.union(own))
        left = left.join(family.select("rep").union(family.select("pivot")).distinct(), "rep", "left_anti")
    return near, family


def _rooted(rows: DataFrame, roots: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` without those whose two columns are of one component."""
    for c in columns:
        rows = rows.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"_of_{c}")), c, "left")
    one, other = (F.coalesce(f"_of_{c}", c) for c in columns)
    return rows.where(one != other).drop(*(f"_of_{c}" for c in columns))


def _apart(unlinked: DataFrame, family: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """``x, y, d, rx, ry``: pivots that do not link, of different components, whose families' radii allow members to link."""
    radius = family.groupBy(F.col("pivot").alias("p")).agg(F.max("r").alias("r"))
    apart = unlinked.select("x", "y", (1 - F.col("common") / F.col("either")).alias("d"))
    for c in "xy":
        apart = apart.join(radius.select(F.col("p").alias(c), F.col("r").alias(f"r{c}")), c, "left")
    apart = apart.na.fill(0.0, ["rx", "ry"])
    apart = apart.where((F.col("rx") + F.col("ry") > 0) & (F.col("d") <= 1 - percent / 100 + 1e-9 + F.col("rx") + F.col("ry")))
    return materialise(_rooted(apart, roots, ["x", "y"]), "apart")


def _against(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Sets and a pivot, ``m, p``: sizes ``n, n_p``, how many shingles are ``common``, and those of m ``outside`` the pivot, rarest first."""
    one, pivot = sets.select(F.col("rep").alias("m"), "n", F.col("tokens").alias("t")), sets.select(F.col("rep").alias("p"), F.col("n").alias("n_p"), F.col("tokens").alias("t_p"))

    def differ(batches):
        for b in batches:
            own, of = b.column(4), b.column(5)
            v, w, o, q = own.values.to_numpy(), of.values.to_numpy(), own.offsets.to_numpy(), of.offsets.to_numpy()
            out = [v[i:j][~np.isin(v[i:j], w[k:n])] for i, j, k, n in zip(o[:-1], o[1:], q[:-1], q[1:], strict=True)]
            ends = np.cumsum([0, *map(len, out)]).astype("i4")
            outside = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, "i8"), *out])))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(np.diff(o).astype("i8") - np.diff(ends)), outside], ["m", "p", "n", "n_p", "common", "outside"])
        trim()

    both = pairs.join(one, "m").join(pivot, "p").select("m", "p", "n", "n_p", "t", "t_p")
    return both.mapInArrow(differ, "m long, p long, n int, n_p int, common long, outside array<long>").withColumn("either", F.col("n") + F.col("n_p") - F.col("common"))


def _outsiders(apart: DataFrame, family: DataFrame, reps: DataFrame) -> DataFrame:
    """Of two families apart, each set of the smaller one against the pivot of the larger, ``p``: one comparison a set."""
    sizes = family.groupBy(F.col("pivot").alias("p")).agg(F.count("*").alias("k"))
    for c in "xy":
        apart = apart.join(sizes.select(F.col("p").alias(c), F.col("k").alias(f"k{c}")), c, "left")
    first = F.coalesce("kx", F.lit(0)) >= F.coalesce("ky", F.lit(0))
    sides = apart.select(F.when(first, F.col("x")).otherwise(F.col("y")).alias("p"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("q"))
    members = sides.join(family.select(F.col("pivot").alias("q"), F.col("rep").alias("m")), "q").select("m", "p")
    return materialise(_against(sides.select(F.col("q").alias("m"), "p").union(members).where("m <> p").distinct(), reps), "outsiders")


def _derived(outside: DataFrame, family: DataFrame, reps: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs ``x, y`` of a set outside a family and a member of it that may link, derived from both one's answers with the pivot.

    A set y has ``common`` shingles with the pivot. With a member x it has those, less what x lacks of the pivot, and
    more by shingles that both have and the pivot has not. So x must share with y as many shingles outside the pivot as y's
    overlap with the pivot falls short, of those that y has (all but so many of the rarest are enough to look at), or be so
    small that nothing falls short.
    """
    left = _rooted(outside, roots, ["m", "p"])
    inner = materialise(_against(family.join(left.select(F.col("p").alias("pivot")).distinct(), "pivot", "left_semi").select(F.col("rep").alias("m"), F.col("pivot").alias("p")), reps), "inner")
    bounds = inner.groupBy("p").agg(F.min("n").alias("least"), F.max(1 - F.col("common") / F.col("either")).alias("radius"))
    far = 1 - F.col("common") / F.col("either")
    slack = 1 - percent / 100 + 1e-9
    short = F.ceil(percent * (F.col("least") + F.col("n")) / (100 + percent) - 1e-9) - F.col("common")
    left = left.join(bounds, "p").withColumn("far", far).withColumn("short", short).where(F.col("far") <= slack + F.col("radius"))
    sets = left.where(F.size("outside") >= F.col("short"))
    look = F.slice("outside", F.lit(1), F.greatest(F.size("outside") - F.greatest("short", F.lit(1)) + 1, F.lit(0)).cast("int"))
    ys = sets.select("p", F.col("m").alias("y"), "far", F.explode(look).alias("token"))
    xs = inner.select("p", F.col("m").alias("x"), far.alias("r"), F.explode("outside").alias("token"))
    shared = ys.join(xs, ["p", "token"]).where(F.col("far") <= slack + F.col("r")).select("x", "y")
    small = left.where("short <= 0").select("p", F.col("m").alias("y"), F.col("n").alias("n_y"), F.col("common").alias("has"), "far")
    small = small.join(inner.select("p", F.col("m").alias("x"), F.col("n").alias("n_x"), far.alias("r")), "p")
    small = small.where((percent * (F.col("n_x") + F.col("n_y")) <= (100 + percent) * F.col("has")) & (F.col("far") <= slack + F.col("r")))
    return shared.union(small.select("x", "y")).where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def jaccard_components(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 75) -> DataFrame:
    """``key, n_shingles, component_id`` of each row. Only connectivity is derived: links within a family are neither counted nor given."""
    spark = df.sparkSession
    # Rows are known by a number of their own, so that null or repeated keys are rows like others.
    docs = df.select(F.monotonically_increasing_id().alias("id"), F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    bits = min(30, max(8, math.ceil(math.log2(4 * parallelism(spark)))))  # buckets follow the session's setting
    sets = materialise(_gather(_answer(_send(docs, n, bits)), percent, bits), "sets")

    # Equal sets: one representative.
    by_set = materialise(sets.where("n > 0").groupBy("n", "a", "b").agg(F.min("id").alias("rep"), F.min("key").alias("least"), F.count("*").alias("copies")), "by_set")
    tokens = sets.where("prefix > 0").groupBy("n", "a", "b").agg(F.min("id").alias("rep"), F.min_by(F.struct("tokens", "prefix"), "id").alias("s"))
    reps = materialise(tokens.select("rep", "n", "s.tokens", "s.prefix"), "reps")

    # Lists, split by size class: within a class, sizes allow a link.
    ratio = 100 / percent
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(ratio))) + 1e-9).cast("int")
    lists = reps.select("rep", "n", F.size("tokens").alias("shared"), F.posexplode(F.slice("tokens", F.lit(1), F.col("prefix"))).alias("at", "token")).withColumn("class", size_class)
    lists = materialise(lists.select("token", "class", "rep", "n", (F.col("n") - F.col("shared")).alias("own"), (F.col("shared") - F.col("at")).alias("rest")), "lists")
    linked = F.expr(f"100 * common >= {percent} * either")
    near, family = _families(lists, reps, linked)

    # Pivots stand for their families in the lists; classes a step apart may link too.
    stood = lists.join(family.select("rep", "pivot"), "rep", "left")
    stood = stood.select("token", "class", F.coalesce("pivot", "rep").alias("p"), "n", "rest")
    # A block: one pivot's stretch of a list, with the most that an overlap from its positions on can reach.
    spans = stood.groupBy("token", "p", "class").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("rest").alias("rest"))
    lists_of = spans.groupBy("token").agg(F.countDistinct("p").alias("k")).where("k > 1")
    spans = materialise(spans.join(lists_of.select("token"), "token", "left_semi"), "spans")
    # The blocks of a list meet by a pair of classes, the lesser first. A block goes to those pairs only whose smallest
    # sets its positions can still reach the overlap with, so blocks to be skipped never meet.
    floor_of = lambda c: F.floor(F.pow(F.lit(ratio), c.cast("double")) - 1e-6)
    reaches = lambda least: F.col("rest") * (100 + percent) >= (F.col("lo") + least) * percent
    own, step = F.col("class"), lambda d: F.col("class") + d

    def sent(side: str, pairs: Column) -> DataFrame:
        cols = [F.col(c).alias(f"{c}_{side}") for c in ("lo", "hi", "rest")]
        return spans.select("token", F.col("p").alias(side), *cols, F.explode(pairs).alias("pair"))

    either_class = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    up = F.when(reaches(floor_of(step(1))), F.array(either_class(own, own), either_class(own, step(1)))).otherwise(F.array(either_class(own, own)))
    down = F.when(reaches(floor_of(step(-1))), F.array(either_class(own, own), either_class(step(-1), own))).otherwise(F.array(either_class(own, own)))
    left, right = (sent(side, F.when(reaches(floor_of(own)), pairs).otherwise(F.filter(pairs, lambda q: q.a != q.b))) for side, pairs in (("x", up), ("y", down)))
    fits = (F.col("hi_x") * 100 >= F.col("lo_y") * percent) & (F.col("hi_y") * 100 >= F.col("lo_x") * percent) & (F.col("x") != F.col("y"))
    fits = fits & (F.least("rest_x", "rest_y") * (100 + percent) >= (F.col("lo_x") + F.col("lo_y")) * percent)
    across = left.join(right, ["token", "pair"]).where(fits).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    across = across.join(near.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")), ["x", "y"], "left_anti")
    between = materialise(_compare(across, reps), "between")
    links = near.select("x", "y").union(between.where(linked).select("x", "y"))
    roots = components(links)
    apart = _apart(between.where(~linked), family, roots, percent)
    if not apart.isEmpty():
        outside = _outsiders(apart, family, reps)
        links = links.union(outside.where(linked).select(F.col("m").alias("x"), F.col("p").alias("y")))
        roots = components(links)
        last = _derived(outside.where(~linked), family, reps, roots, percent)
        links = links.union(materialise(_compare(last, reps), "found").where(linked).select("x", "y"))
        roots = components(links)

    # Each set's component, and the least key in it.
    rooted = by_set.join(roots, F.col("rep") == F.col("node"), "left").select("n", "a", "b", "least", F.coalesce("root", "rep").alias("root"))
    rooted = materialise(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("_n"))
    named = spread_join(rooted.select("n", "a", "b", "root"), least.drop("_n"), least.drop("component_id"), ["root"], F.col("a")).drop("root")
    copies = by_set.select("n", "a", "b", F.col("copies").alias("_n"))
    rows = spread_join(sets.select("id", "key", "n", "a", "b"), named, copies, ["n", "a", "b"], F.col("id"))
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key"))
    return rows.select(F.col("key").alias(key), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))
