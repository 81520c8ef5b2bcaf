"""Benchmark decontamination by templates, in SQL expressions.

Texts are cut into words (runs of letters or digits). In a window of words,
numbers, units and names become typed placeholders, numbered by first occurrence
in the window, so a window's template says which slots hold equal values. Each
window has two templates: with capitalised words as names, and without (for
passages whose case was changed). A document's windows are hash-joined to the
benchmark's templates; matches that lie alike in both texts are one alignment.
Windows whose slots hold the item's own values count. Of the others, those count
that are consistent: one value of the item's maps to one value of the document's,
the one that most windows of the alignment have for it. An item is found in a document when the matched
windows are at least ``min_cover`` of the item's, or ``min_windows``.

A window of mostly slots would match by chance, so it has no template and is
matched by its words, slot values included; so are items of fewer than
``MIN_WORDS`` words. Verbatim copies are thus found of every item that has words.
``search_of`` says which windows of an item have a template. An item's cover is the
greater of its share of all windows and of those with a template, so windows
without one do not hide a copy with other values.

Windows are hashed only around anchors: two words of a benchmark window that are
no slots, at their distance. At least half of a template's words are literal, so
every template has such a pair, any document window with it has the pair at the
same places, and none is lost. The nearest pair is taken, of these the longest, so
neighbouring windows share theirs. A window matched by its words has two
neighbours for anchor, whatever they are, or its only word, at no distance.

Nulls: null or empty texts have no windows. Items shorter than a window are one
window of their own width, so an item of one word is found wherever the word is.
Repeated items and documents are found alike. A very long text is one array of
words in its task. Columns other than those named are ignored. Empty tables give
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialise

#: Words that are units, or numbers written out.
UNITS = (
    "kg g mg lb lbs oz t km m cm mm mi mile miles yd ft in inch inches l ml s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "kmh mph percent pct usd eur gbp dollar dollars euro euros cent cents degree degrees c f k j kj kw w v a hz khz mhz ghz b kb mb gb tb"
).split()
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split()
WIDTH, MIN_WORDS = 8, 4
#: Up to so many anchors are sets in the filter; more are joined.
MAX_SET = 20_000
#: Benchmark windows of up to so many bytes are broadcast; more are shuffled.
MAX_BROADCAST = 64 << 20


def words_of(text: str) -> Column:
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _is_number(w: Column) -> Column:
    return w.rlike(r"^\p{N}") | F.lower(w).isin(*NUMBERS)


def _kind(w: Column, names: bool) -> Column:
    """A word's slot type, or null for a literal word. A unit is one only beside other than letters: units of one letter are literal."""
    kind = F.when(_is_number(w), F.lit("<number>")).when(F.lower(w).isin(*[u for u in UNITS if len(u) > 1]), F.lit("<unit>"))
    return kind.when(w.rlike(r"^\p{Lu}\p{Ll}"), F.lit("<name>")) if names else kind


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, computed once: a column named inside a lambda may be put there as its whole expression, for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def _windows(df: DataFrame, ids: list[str], width: int) -> DataFrame:
    """``ids, at, hash, slots, exact`` of the windows of ``width`` of ``words`` that begin at ``starts``, by either kind of template, or by their words."""
    cut = _let(F.struct("starts", "words"), lambda s: F.transform(s.starts, lambda at: F.struct(at.alias("at"), F.slice(s.words, at, width).alias("words"))))
    at = df.select(*ids, F.explode(cut).alias("cut")).select(*ids, "cut.at", "cut.words").where(F.size("words") == width)
    kinds = F.array(F.struct(F.lit(0).alias("v"), F.transform("words", lambda w: _kind(w, False)).alias("k")), F.struct(F.lit(1).alias("v"), F.transform("words", lambda w: _kind(w, True)).alias("k")))
    cut = at.select(*ids, "at", F.transform("words", F.lower).alias("w"), F.explode(kinds).alias("t"))
    cut = cut.select(*ids, "at", "w", "t.v", F.arrays_zip(F.col("w").alias("w"), F.col("t.k").alias("k")).alias("z"))
    shape = _let(F.struct("w", "z"), lambda s: F.transform(s.z, lambda p: F.when(p.k.isNull(), p.w).otherwise(F.concat(p.k, F.array_position(s.w, p.w).cast("string")))))
    slots = F.transform(F.filter("z", lambda p: p.k.isNotNull()), lambda p: p.w)
    # A template of mostly slots would match by chance. Slots without names are slots with them too.
    exact = F.lit(True) if width < MIN_WORDS else (width - F.size(slots)) * 2 < width
    cut = cut.select(*ids, "at", "w", "v", "z", exact.alias("exact")).where(~F.col("exact") | (F.col("v") == 0))
    by_words, by_shape = F.xxhash64(F.lit(width), F.lit(2), F.array_join("w", " ")), F.xxhash64(F.lit(width), "v", F.array_join(shape, " "))
    none = F.array().cast("array<string>")
    return cut.select(*ids, "at", F.when(F.col("exact"), by_words).otherwise(by_shape).alias("hash"), F.when(F.col("exact"), none).otherwise(slots).alias("slots"), "exact")


def _starts(width: int) -> Column:
    return F.when(F.size("words") >= width, F.sequence(F.lit(1), F.size("words") - (width - 1)))


def _starts_near(width: int) -> Column:
    """Starts of the windows that hold one of ``spots``."""
    near = F.transform("spots", lambda p: F.sequence(F.greatest(F.lit(1), p - (width - 1)), p))
    both = F.struct(F.array_distinct(F.flatten(near)).alias("near"), (F.size("words") - (width - 1)).alias("last"))
    return _let(both, lambda s: F.filter(s.near, lambda p: p <= s["last"]))


def _anchor(width: int) -> Column:
    """The pair of words that stands for a window's ``words``: negated distance, length, and both in lower case."""

    def nearest(names: bool) -> Column:
        literal = F.transform("words", lambda w, i: F.struct(_kind(w, names).isNull().alias("fixed"), F.lower(w).alias("x"), i.alias("i")))

        def pairs(those: Column) -> Column:
            both = F.zip_with(those, F.slice(those, 2, width), lambda a, b: F.struct((a.i - b.i).alias("near"), (F.length(a.x) + F.length(b.x)).alias("n"), a.x.alias("u"), b.x.alias("v")))
            return F.when(F.size(those) * 2 >= width, F.array_max(F.filter(both, lambda p: p.v.isNotNull())))

        return _let(F.filter(literal, lambda p: p.fixed), pairs)

    # Of a window matched by its words, any neighbours stand.
    beside = 1 if width > 1 else 0
    both = F.zip_with("words", F.slice("words", 1 + beside, width), lambda a, b: F.struct(F.lit(-beside).alias("near"), (F.length(a) + F.length(b)).alias("n"), F.lower(a).alias("u"), F.lower(b).alias("v")))
    exact = F.array_max(F.filter(both, lambda p: p.v.isNotNull()))
    # Literals under names as slots are literals either way; where they are too few, that template is not used.
    return exact if width < MIN_WORDS else F.coalesce(nearest(True), nearest(False), exact)


def _pair_hashes(distance: int) -> str:
    """SQL: hashes of the words ``lw`` with those ``distance`` on, by place."""
    return f"zip_with(lw, slice(lw, {1 + distance}, size(lw)), (a, b) -> xxhash64({distance}, a, b))"


def _lowered(body: str) -> str:
    """SQL: ``body`` with ``lw`` for the lower-case ``words``, computed once."""
    return f"get(transform(array(transform(words, x -> lower(x))), lw -> {body}), 0)"


def _spots(anchors: dict[int, list[int]]) -> Column:
    """Places of the words that begin an anchor; ``anchors`` by distance."""
    hit = "filter(transform({}, (h, i) -> if(h IN ({}), i + 1, null)), i -> i IS NOT NULL)"
    found = ", ".join(hit.format(_pair_hashes(d), ", ".join(f"{h}L" for h in hashes)) for d, hashes in sorted(anchors.items()))
    return F.expr(_lowered(f"array_distinct(flatten(array({found})))"))


def _consistent(windows: str) -> Column:
    """Of ``windows`` (``item_at, exact, pairs``), those of which every item's value has the value that most windows have for it."""
    every = F.flatten(F.transform(windows, lambda d: d.pairs))

    def chosen(s: Column) -> Column:
        counted = F.transform(s.distinct_pairs, lambda p: F.struct(p.item_slots.alias("i"), F.size(F.filter(s.every, lambda q: q == p)).alias("n"), p.alias("p")))
        return _let(counted, lambda every: F.filter(every, lambda c: ~F.exists(every, lambda o: (o.i == c.i) & (o > c))))

    def split(s: Column) -> Column:
        one_to_one = F.size(s.distinct_pairs) == F.size(F.array_distinct(F.transform(s.distinct_pairs, lambda p: p.item_slots)))
        best = _let(s, lambda t: F.transform(chosen(t), lambda c: c.p))
        held = _let(F.struct(s.windows.alias("windows"), best.alias("best")), lambda t: F.filter(t.windows, lambda d: F.size(F.array_except(d.pairs, t.best)) == 0))
        return F.when(one_to_one, s.windows).otherwise(held)

    return _let(F.struct(F.col(windows).alias("windows"), every.alias("every"), F.array_distinct(every).alias("distinct_pairs")), split)


def _widths(items: DataFrame, width: int) -> dict[int, DataFrame]:
    """``items`` by the width of their windows."""
    own = F.least(F.size("words"), F.lit(width))
    return {r.w: items.where(own == r.w) for r in items.select(own.alias("w")).distinct().collect()}  # at most ``width`` values


def search_of(bench: DataFrame, item: str = "item_id", item_text: str = "text", width: int = WIDTH) -> DataFrame:
    """``item, words, windows, templates`` of every item: no templates, and only verbatim copies are found; no windows, and nothing is."""
    items = bench.select(F.col(item).alias("item"), words_of(item_text).alias("words"))
    rows = items.select("item", F.size("words").cast("long").alias("words"), F.lit(None).cast("int").alias("at"), F.lit(True).alias("exact"))
    for w, part in _widths(items.where(F.size("words") > 0), width).items():
        own = _windows(part.withColumn("starts", _starts(w)), ["item"], w)
        rows = rows.union(own.select("item", F.lit(None).cast("long"), "at", "exact").distinct())
    at = lambda exact: F.countDistinct(F.when(exact, F.col("at")))
    return rows.groupBy("item").agg(F.max("words").alias("words"), F.countDistinct("at").alias("windows"), at(~F.col("exact")).alias("templates"))


def find_items(
    docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    width: int = WIDTH, min_cover: float = 0.3, min_windows: int = 6,
) -> DataFrame:
    """``key, item, matched, windows, cover`` of each item found in a document."""
    spark = docs.sparkSession
    items = bench.select(F.col(item).alias("item"), words_of(item_text).alias("words")).where(F.size("words") > 0)
    sized = _widths(items, width)
    empty = spark.createDataFrame([], f"`{key}` {dict(docs.dtypes)[key]}, item {dict(bench.dtypes)[item]}, matched long, windows long, cover double")
    if not sized:
        return empty
    plates = None
    anchors = None
    for w, part in sized.items():
        own = _windows(part.withColumn("starts", _starts(w)), ["item"], w)
        plates = own if plates is None else plates.union(own)
        spots = part.select("words", F.explode(_starts(w)).alias("at")).select(F.slice("words", F.col("at"), w).alias("words"))
        pairs = spots.select(_anchor(w).alias("a")).where("a IS NOT NULL").select((-F.col("a.near")).alias("d"), F.col("a.u").alias("u"), F.col("a.v").alias("v"))
        pairs = pairs.select("d", F.xxhash64("d", "u", "v").alias("h"))
        anchors = pairs if anchors is None else anchors.union(pairs)
    anchors = materialise(anchors.distinct(), "anchors")
    picked = anchors.limit(MAX_SET + 1).collect()
    rows = docs.select(F.col(key).alias(key), words_of(text).alias("words"))
    if not picked:
        return empty
    if len(picked) <= MAX_SET:
        by_distance = {d: sorted(r.h for r in picked if r.d == d) for d in {r.d for r in picked}}
        rows = rows.withColumn("spots", _spots(by_distance)).where(F.size("spots") > 0)
    else:
        hashes = F.expr(_lowered(f"array({', '.join(_pair_hashes(d) for d in range(width))})"))
        held = rows.select(F.col(key).alias("_key"), F.posexplode(hashes).alias("d", "h")).select("_key", "d", F.posexplode("h").alias("i", "h"))
        held = held.join(anchors, ["d", "h"], "left_semi").groupBy("_key").agg(F.collect_set(F.col("i") + 1).alias("spots"))
        rows = rows.join(held, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    rows = materialise(rows, "anchored")  # few documents, read once a width
    totals = plates.select("item", "at", "exact").distinct().groupBy("item").agg(F.count("*").alias("windows"), F.count_if(~F.col("exact")).alias("templates"))
    plates = plates.select("item", F.col("at").alias("item_at"), "hash", F.col("slots").alias("item_slots")).distinct()
    plates = materialise(plates, "plates")
    held = plates.agg(F.sum(F.octet_length(F.array_join("item_slots", " ")) + 32 * F.size("item_slots") + 128).alias("n")).first().n
    if (held or 0) <= MAX_BROADCAST:
        plates = F.broadcast(plates)
    found = None
    for w in sized:
        own = _windows(rows.withColumn("starts", _starts_near(w)), [key], w).join(plates, "hash")
        found = own if found is None else found.union(own)
    pairs = F.array_distinct(F.arrays_zip("item_slots", "slots"))
    same = F.col("item_slots") == F.col("slots")
    found = found.select(key, "item", "item_at", (F.col("at") - F.col("item_at")).alias("shift"), "exact", F.when(~same, pairs).alias("pairs")).distinct()
    spot = F.struct("item_at", "exact")
    differs = F.collect_set(F.when(F.col("pairs").isNotNull(), F.struct("item_at", "exact", "pairs")))
    alike = found.groupBy(key, "item", "shift").agg(F.collect_set(F.when(F.col("pairs").isNull(), spot)).alias("same"), differs.alias("differs"))
    kept = F.transform(_consistent("differs"), lambda d: F.struct(d.item_at.alias("item_at"), d.exact.alias("exact")))
    spots = alike.select(key, "item", F.explode(F.concat("same", kept)).alias("at")).select(key, "item", "at.*").distinct()
    matched = spots.groupBy(key, "item").agg(F.count("*").alias("matched"), F.count_if(~F.col("exact")).alias("by_template")).join(totals, "item")
    cover = F.greatest(F.col("matched") / F.col("windows"), F.try_divide("by_template", "templates"))
    return matched.select(key, "item", "matched", "windows", cover.alias("cover")).where((F.col("cover") >= min_cover) | (F.col("matched") >= min_windows))
