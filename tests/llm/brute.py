"""Plain versions of the operators, one text or pair at a time."""

from __future__ import annotations

import collections
import functools
import re
import struct

import xxhash

from corvane.llm import decontam, packing


def jump(key: int, n: int) -> int:
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def spark_hash(*values, seed: int = 42) -> int:
    """What Spark's xxhash64 gives: a chain over the values, nulls left out."""
    h = seed
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else struct.pack("<q", v) if isinstance(v, int) else struct.pack("<i", v[0])
            h = xxhash.xxh64(data, seed=h % 2**64).intdigest()
    return h


def shingles(text: str | None) -> set:
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode("utf-8", "surrogatepass"))
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in w]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def components(sets: list[set]) -> list[int]:
    """The least index that each set is linked to."""
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return [root(a) for a in range(len(sets))]


def words_of(text: str | None) -> list[str]:
    import regex

    return [w for w in regex.split(r"[^\p{L}\p{N}]+", text or "") if w]


@functools.lru_cache(1 << 16)
def kind(w: str, names: bool) -> str | None:
    import regex

    if regex.match(r"\p{N}", w) or w.lower() in decontam.NUMBERS:
        return "<number>"
    if w.lower() in [u for u in decontam.UNITS if len(u) > 1]:
        return "<unit>"
    return "<name>" if names and regex.match(r"\p{Lu}\p{Ll}", w) else None


def windows(words: list[str], width: int):
    """``place, template, slots, exact`` of each window, by either kind of template or by its words."""
    for at in range(len(words) - width + 1):
        w = [x.lower() for x in words[at : at + width]]
        for names in (False, True):
            kinds = [kind(x, names) for x in words[at : at + width]]
            slots = [x for x, k in zip(w, kinds, strict=True) if k]
            exact = width < decontam.MIN_WORDS or (width - len(slots)) * 2 < width
            if exact and not names:
                yield at, (width, "exact", *w), [], True
            elif not exact:
                yield at, (width, names, *(x if k is None else f"{k}{w.index(x) + 1}" for x, k in zip(w, kinds, strict=True))), slots, False


def find_items(docs: list[tuple], items: list[tuple], width: int = 8, min_cover: float = 0.3, min_windows: int = 6) -> set[tuple]:
    """``(document, item)`` pairs found."""
    found = set()
    said_at: dict[int, dict] = {}  # width -> template -> where documents have it
    for item, text in items:
        own = words_of(text)
        if not own:
            continue
        w = min(width, len(own))
        if w not in said_at:
            said_at[w] = collections.defaultdict(list)
            for i, (_, said) in enumerate(docs):
                for at, plate, slots, _ in windows(words_of(said), w):
                    said_at[w][plate].append((i, at, slots))
        aligned = collections.defaultdict(set)
        whole, templates = set(), set()
        for item_at, plate, item_slots, exact in windows(own, w):
            whole.add(item_at)
            templates |= set() if exact else {item_at}
            for i, at, slots in said_at[w].get(plate, ()):
                aligned[i, at - item_at].add((item_at, exact, tuple(sorted(set(zip(item_slots, slots, strict=True)))) if item_slots != slots else ()))
        spots = collections.defaultdict(set)
        for (i, _), hits in aligned.items():
            spots[i] |= {h[:2] for h in hits if not h[2]}
            differ = [h for h in hits if h[2]]
            counts = collections.Counter(p for h in differ for p in h[2])
            best: dict = {}
            for p, n in counts.items():
                if p[0] not in best or (n, p) > (counts[best[p[0]]], best[p[0]]):
                    best[p[0]] = p
            spots[i] |= {h[:2] for h in differ if all(best[p[0]] == p for p in h[2])}
        for i, at in spots.items():
            by_template, matched = len({a for a, exact in at if not exact}), len(at)
            if matched and (matched / len(whole) >= min_cover or (templates and by_template / len(templates) >= min_cover) or matched >= min_windows):
                found.add((docs[i][0], item))
    return found


def signature(text: str | None, k: int = 3) -> str:
    """Order MinHash, element by element."""
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", text or "") if w]
    kmers = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)] or ([tuple(words)] if words else [])
    cut = lambda h: h % 2**64 >> 25
    seen: collections.Counter = collections.Counter()
    elements = []
    for place, kmer in enumerate(kmers):
        h = cut(spark_hash(*kmer))
        elements.append((cut(spark_hash(h, (seen[h],))), place))
        seen[h] += 1
    bins = collections.defaultdict(list)
    for h, place in elements:
        bins[h >> 33].append((h, place))
    out = []
    for b in sorted(bins):
        chosen = sorted(sorted(bins[b])[:2], key=lambda e: e[1])
        out.append(b << 32 | spark_hash(*(h for h, _ in chosen)) % 2**32)
    return "".join(f"{x:010x}" for x in out)


def likeness(a: str, b: str) -> float:
    x, y = ({s[i : i + 10] for i in range(0, len(s), 10)} for s in (a, b))
    either = {s[:2] for s in x | y}
    return 1.0 if not either else (len(x & y) / len(either)) ** 0.5


def best_fit(lengths: list[int], capacity: int, max_docs: int, max_cost: int, rule: str) -> list[tuple]:
    """Contents of the bins when items are placed one by one, longest first."""
    bins: list[list] = []
    weights = (1.0, 0.05, 0.2)
    for n in sorted(lengths, reverse=True):
        need = (n / capacity, 1 / max_docs, n * n / max_cost)

        def score(state, need=need):
            left = [x / f for x, f in zip(state, (capacity, max_docs, max_cost), strict=True)]
            if rule == "dot":
                return -sum(w * a * b for w, a, b in zip(weights, need, left, strict=True)), state
            return sum(w * (a - b) ** 2 for w, a, b in zip(weights, left, need, strict=True)), state

        fits = [b for b in bins if b[0][0] >= n and b[0][1] >= 1 and b[0][2] >= n * n and b[0][0] > 0]
        if not fits:
            bins.append([(capacity, max_docs, max_cost), []])
            fits = bins[-1:]
        best = min(fits, key=lambda b: score(b[0]))
        t, d, c = best[0]
        best[0] = (t - n, d - 1, c - n * n)
        best[1].append(n)
    return sorted(tuple(sorted(b[1])) for b in bins)


def planned(lengths: list[int], capacity: int, max_docs: int, max_cost: int, rule: str) -> list[tuple]:
    """The same from the plan."""
    bins = collections.defaultdict(list)
    for length, _, n, first, per, _ in packing.plan_best_fit(dict(collections.Counter(lengths)), capacity, max_docs, max_cost, rule=rule):
        for i in range(n):
            bins[first + i // per].append(length)
    return sorted(tuple(sorted(b)) for b in bins.values())
