"""Order MinHash fingerprints, in SQL expressions.

A text's elements are its k-mers of words, each with the number of its earlier
occurrences. Their hashes are dealt to ``bins`` by one permutation; of each bin
the ``tuple_size`` smallest are selected, kept in text order, and hashed
together. A signature lists the tuple of each bin that has elements. The share
of bins that two texts agree in is the likeness; it falls with moved passages as
with replaced ones, and so follows edit distance more closely than plain
MinHash, which ignores order.

Elements are 64-bit integers (hash bits above, place below), sorted as such.
Occurrences are numbered in the sorted array by doubling steps, as many as a
text's repeats need.

Nulls: a null text is empty; a text without words has no bins, and the
fingerprint "". Two empty signatures are alike (1), one empty one is unlike (0).
Fewer than ``k`` words are one k-mer. Equal texts have equal fingerprints. A text
is one array in its task; places are kept modulo 2**24, so of texts beyond 16.7
million words order is told within such stretches. Keys are integers, of any span;
null keys come last in descending order, and equal keys are ordered by a hash of
their texts, then by the texts. Columns other than those named are ignored or
kept as they are. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PLACE = 24  # bits: words of a text
_BIN = 6  # bits
BINS = 1 << _BIN
_TUPLE = 32  # bits of a tuple's hash in a signature
#: Heads of up to so many blocks, 40 bytes each, are broadcast; more are shuffled.
MAX_BROADCAST = 200_000
#: Rows are dealt to blocks between so many quantiles of their keys, at most.
MAX_QUANTILES = 1024


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _and(c: Column, mask: int) -> Column:
    return c.bitwiseAND(F.lit(mask).cast("long"))


def with_signature(df: DataFrame, text: str, out: str, k: int = 3) -> DataFrame:
    """Adds ``out``: array<long>, one entry (bin above, tuple's hash below) per bin with elements, ascending."""
    place = (1 << _PLACE) - 1
    hash_of = lambda x: F.shiftright(x, _PLACE)
    bin_of = lambda x: F.shiftright(x, 63 - _BIN)
    packed = lambda h, at: F.shiftleft(F.shiftrightunsigned(h, _PLACE + 1), _PLACE).bitwiseOR(_and(at, place))
    none = F.array(F.lit(None).cast("long"))
    # Neighbours are zipped in, never looked up by index: the optimiser may put a column's whole expression inside a lambda.
    df = df.withColumn("_w", F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    ahead = [F.slice("_w", 1 + j, F.greatest(F.size("_w") - j, F.lit(0))).alias(f"w{j}") for j in range(k)]
    kmers = F.transform(F.arrays_zip(*ahead), lambda z, i: F.struct(z.alias("z"), i.cast("long").alias("i")))
    kmers = F.filter(kmers, lambda p: p.z[f"w{k - 1}"].isNotNull() | (p.i == 0)) if k > 1 else kmers
    df = df.withColumn("_e", F.sort_array(F.transform(kmers, lambda p: packed(F.xxhash64(*(p.z[f"w{j}"] for j in range(k))), p.i)))).drop("_w")
    # _f: index of the first of each run of equal k-mers, spread over the run by doubling steps.
    before = F.arrays_zip(F.col("_e").alias("x"), F.concat(none, F.col("_e")).alias("y"))
    first = F.transform(F.filter(before, lambda p: p.x.isNotNull()), lambda p, i: F.when(hash_of(p.x).eqNullSafe(hash_of(p.y)), F.lit(-1)).otherwise(i))

    def spread(f: Column, step: Column) -> Column:
        filled = F.transform(f, lambda x, i: F.when((x >= 0) | (i < step), x).otherwise(F.get(f, i - step)))
        return filled

    def steps(f: Column) -> Column:
        """1, 2, 4 and so on, while below the number of repeats: no run is longer."""
        n = F.size(F.filter(f, lambda x: x < 0))
        return F.filter(F.array(*(F.lit(1 << i) for i in range(_PLACE))), lambda p: p <= n)

    df = df.withColumn("_f", _let(first, lambda f: F.aggregate(steps(f), f, spread)))
    mixed = F.transform(F.arrays_zip(F.col("_e").alias("x"), F.col("_f").alias("f")), lambda p, i: packed(F.xxhash64(hash_of(p.x), i - p.f), p.x))
    df = df.withColumn("_m", F.sort_array(mixed)).drop("_e", "_f")
    # _s: the two smallest of each bin.
    far = F.arrays_zip(F.col("_m").alias("x"), F.concat(none, none, F.col("_m")).alias("y"))
    small = F.filter(far, lambda p: p.x.isNotNull() & ~F.coalesce(bin_of(p.x) == bin_of(p.y), F.lit(False)))
    df = df.withColumn("_s", F.transform(small, lambda p: p.x)).drop("_m")
    around = F.arrays_zip(F.col("_s").alias("x"), F.concat(none, F.col("_s")).alias("y"), F.slice("_s", 2, F.greatest(F.size("_s") - 1, F.lit(0))).alias("z"))

    def entry(p: Column) -> Column:
        x, z = p.x, p.z
        pair = F.when(bin_of(z) == bin_of(x), F.when(_and(x, place) < _and(z, place), F.xxhash64(hash_of(x), hash_of(z))).otherwise(F.xxhash64(hash_of(z), hash_of(x))))
        return F.shiftleft(bin_of(x), _TUPLE).bitwiseOR(_and(F.coalesce(pair, F.xxhash64(hash_of(x))), (1 << _TUPLE) - 1))

    leading = F.filter(around, lambda p: p.x.isNotNull() & ~F.coalesce(bin_of(p.x) == bin_of(p.y), F.lit(False)))
    return df.withColumn(out, F.transform(leading, entry)).drop("_s")


def show(signature: str) -> Column:
    """A signature as a string: ten hexadecimal digits a bin."""
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), 10, "0")), "")


def likeness(a: str, b: str) -> Column:
    """Share of the bins of either signature that agree, on the scale of single elements: its square root."""
    common = F.size(F.array_intersect(a, b))
    bins = lambda s: F.transform(s, lambda x: F.shiftright(x, _TUPLE))
    either = F.size(F.array_union(bins(F.col(a)), bins(F.col(b))))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.sqrt(common / either)).cast("double")


def _blocks(df: DataFrame, key: str, block_rows: int) -> tuple[Column, int]:
    """A row's block ``(i, p, s)``, ordered as keys are, and about how many there are. Needs ``_h``, a hash of the text.

    ``i`` is the stretch of keys between quantiles, so outlying keys make no block large; within one, ``s`` cuts by the key's place.
    A key that fills several quantiles has blocks of its own (``p`` 0), cut by ``_h``; so have null keys (``i`` -1).
    """
    stats = df.agg(F.count("*").alias("n"), F.count(key).alias("known"), F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    parts = max(1, min(MAX_QUANTILES, stats.known // block_rows))
    cuts = df.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 50 * MAX_QUANTILES).alias("q")).first().q if parts > 1 else []
    bounds = sorted({stats.lo or 0, *cuts})
    times = [(cuts or []).count(b) for b in bounds]
    subs = -(-stats.known // (parts * block_rows)) or 1
    longs = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs))
    after = [*bounds[1:], (stats.hi or 0) + 1]
    part_of = lambda x, k: F.least(F.floor(x * k), k - 1).cast("long")
    shuffled = F.col("_h").cast("double") / F.lit(2.0**64) + 0.5
    k = F.col(key).cast("long")

    def block(i: Column) -> Column:
        lo, hi, n = F.get(longs(bounds), i).cast("double"), F.get(F.array(*(F.lit(float(a)) for a in after)), i), F.get(longs(times), i)
        own = (n > 1) & (k == F.get(longs(bounds), i))
        s = F.when(own, part_of(shuffled, subs * n)).otherwise(part_of((k.cast("double") - lo) / F.greatest(hi - lo, F.lit(1.0)), F.lit(subs).cast("long")))
        return F.struct(i.alias("i"), F.when(own, 0).otherwise(1).alias("p"), s.alias("s"))

    found = _let(F.size(F.filter(longs(bounds), lambda b: b <= k)) - 1, block)
    nulls = -(-(stats.n - stats.known) // block_rows) or 1
    none = F.struct(F.lit(-1).alias("i"), F.lit(0).alias("p"), part_of(shuffled, F.lit(nulls).cast("long")).alias("s"))
    return F.when(F.col(key).isNull(), none).otherwise(found), parts * subs + sum(times) * subs + nulls


def with_next(df: DataFrame, key: str, text: str, carry: dict[str, str], block_rows: int = 2048) -> DataFrame:
    """Adds the columns named by ``carry``'s values: those of its keys in the row with the next lower ``key``; the first row's, for the last.

    Rows are dealt to blocks of neighbouring keys; each block also gets the first row of the one after, so texts are
    shuffled once and no task holds the whole order.
    """
    hashed = df.withColumn("_h", F.xxhash64(text))
    block, n_blocks = _blocks(df, key, block_rows)
    rows = hashed.withColumn("_block", block)
    # Where the first row of each block goes besides: the block above, or for the topmost block, behind the lowest.
    heads = rows.groupBy("_block").agg(F.max(F.struct(F.col(key).alias("k"), F.col("_h").alias("h"))).alias("top"))
    firsts = heads.groupBy(F.col("_block.i").alias("i")).agg(F.min("_block").alias("first"))
    all_of = Window.orderBy("i")  # at most one row a quantile
    firsts = firsts.select("i", F.lead("first").over(all_of).alias("after"), F.min("first").over(all_of.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("bottom"))
    up = F.lead("_block").over(Window.partitionBy("_block.i").orderBy("_block"))
    heads = heads.withColumn("up", up).withColumn("i", F.col("_block.i")).join(F.broadcast(firsts), "i")
    up = F.coalesce("up", "after")
    heads = heads.select(F.col("_block").alias("hb"), F.col("top.k").alias("hk"), F.col("top.h").alias("hh"), F.coalesce(up, "bottom").alias("to"), up.isNull().alias("wrap"))
    heads = F.broadcast(heads) if n_blocks < MAX_BROADCAST else heads
    ghost = rows.join(heads, F.col(key).eqNullSafe(F.col("hk")) & (F.col("_h") == F.col("hh")) & (F.col("_block") == F.col("hb")), "left")
    plain = F.struct(F.col("_block").alias("block"), F.lit(0).alias("ghost"))
    extra = F.struct(F.col("to").alias("block"), F.when(F.col("wrap"), 2).otherwise(1).alias("ghost"))
    both = ghost.withColumn("_to", F.explode(F.when(F.col("to").isNull(), F.array(plain)).otherwise(F.array(plain, extra)))).drop("hb", "hk", "hh", "to", "wrap")
    # Ghosts are lower than all of a block's rows; equal rows make several, of which the first counts.
    w = Window.partitionBy("_to.block").orderBy("_to.ghost", F.desc_nulls_last(key), F.desc("_h"), F.desc(text))
    led = both.withColumns({new: F.lead(old).over(w) for old, new in carry.items()})
    return led.where("_to.ghost = 0").drop("_to", "_block", "_h")


def fingerprint_edits(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likenesses."""
    rows = df.select(F.col(key).alias(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = with_next(with_signature(rows, "text", "sig"), key, "text", {"text": "next_text", "sig": "next_sig"})
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("_half", F.floor(F.col("n_chars") / 2).cast("int"))
    rows = rows.withColumn("edited", F.concat(F.left("text", (F.col("n_chars") - F.col("_half")).cast("int")), F.left("next_text", F.col("_half"))))
    rows = with_signature(rows.drop("text", "next_text"), "edited", "edited_sig").withColumn("edited_sha256", F.sha2("edited", 256))
    return rows.select(
        key, "n_chars", "edited_sha256", show("sig").alias("fingerprint"), show("edited_sig").alias("edited_fingerprint"),
        likeness("sig", "edited_sig").alias("near_edited"), likeness("sig", "next_sig").alias("near_next"),
    )
