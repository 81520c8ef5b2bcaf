"""Toxicity scores from a weighted lexicon.

Texts are folded (lower case, homoglyphs to Latin letters, digits and signs
inside words to the letters they stand for, accents kept) and their words
matched against the lexicon by one Aho-Corasick automaton, whose entries are
whole words, word beginnings, and exception phrases; a match inside an exception
phrase does not count. The weights found, normalised by the text's length, and
their sum give a score between 0 and 1 by a logistic curve.

The lexicon is learned from labelled texts: words and word beginnings that are
found in toxic texts far more often than in others, with their log odds. It is
fitted on a sample of at most ``sample`` labelled rows, taken by hash of their
ids: documented bound, 40,000; half chooses entries, the other half fits the
curve. Counting is distributed; at most ``max_entries`` entries are kept.

Nulls: a null text is empty and scores as a text without matches does; a null
label or key is left out of the sample. Repeated rows and ties score alike. A very
long text is folded and matched whole. Other columns are kept; one named like the
score is replaced. Without labels of both kinds the built-in lexicon is used. An
empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import trim

#: Letters of other scripts that look like Latin ones, and digits and signs used for letters.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһкмтвнзαενοικρτυχаＡ", "aeopcyxijsdhkmtbh3aevoikptuxaa", strict=True))
DIGITS = str.maketrans("013457@$!", "oieastasi")
#: Built-in entries and their weights, for when there are no labels.
BUILT_IN = {"idiot": 4.0, "moron": 4.0, "stupid": 3.0, "loser": 3.0, "scum": 4.0, "trash": 2.0, "worthless": 3.0, "pathetic": 3.0, "disgusting": 3.0}
#: Phrases in which an entry is no insult.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "class clown", "circus clown", "idiot proof", "idiot light", "sore loser")
BEGINNINGS = (4, 5, 6)
#: A task hands on its counts of entries when it holds so many, to bound its memory.
MAX_COUNTED = 300_000
#: The score from which a text counts as toxic: the curve is laid so that this cut separates best.
CUT = 0.7
_FOLD = str.maketrans({**HOMOGLYPHS, **{chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}, **{c: None for c in "\u00ad\u200b\u200c\u200d\u2060\ufeff"}})
_FOLDED = re.compile("[" + re.escape("".join(map(chr, _FOLD))) + "]")
_MIXED, _REST = re.compile(r"[\d@$!](?:(?<=[^\W\d_].)|(?=[^\W\d_]))"), re.compile(r"[\w@$!]*")
_WORD = re.compile(r"[^\W_]+")
#: ASCII but letters and digits to spaces: words of plain texts without an expression.
_GAPS = {i: " " for i in range(128) if not chr(i).isalnum()}


def _unmix(text: str) -> str:
    """``text`` with letters for the digits and signs of mixed words. A word is looked at from where letters and digits meet, so long words take no longer than many."""
    parts, done, m = [], 0, _MIXED.search(text)
    while m:
        at, end = m.start(), _REST.match(text, m.end()).end()
        while at > done and text[at - 1].isalnum():
            at -= 1
        parts += text[done:at], text[at:end].rstrip("!").translate(DIGITS), " "
        done, m = end, _MIXED.search(text, end)
    return "".join(parts) + text[done:]


def fold(text: str | None) -> str:
    """Words of a text in matching form, each between spaces."""
    if not text:
        return " "
    text = text.lower()
    if not text.isascii():
        text = _FOLDED.sub(lambda m: _FOLD[ord(m[0])] or "", text)
    text = _unmix(text)
    return f" {' '.join(text.translate(_GAPS).split() if text.isascii() else _WORD.findall(text))} "


@dataclass
class Lexicon:
    """Entries and their weights; a leading space stands for a word's start, a trailing one for its end."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = (-4.0, 1.5, 20.0)  # bias, by sum of weights, by weight a word
    _automaton: object = field(default=None, repr=False, compare=False)

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for entry, w in self.weights.items():
                a.add_word(entry, (len(entry), w))
            for phrase in self.exceptions:
                a.add_word(f" {phrase} ", (len(phrase) + 2, None))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def features(self, text: str | None) -> tuple[float, float]:
        """Sum of weights found, at most one entry a word, and that sum per word."""
        folded = fold(text)
        found: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        for end, (n, w) in self.automaton().iter(folded):
            start = end - n + 1
            if w is None:
                excused.append((start, end))
            elif w > found.get(start, 0.0):
                found[start] = w
        total = sum(w for at, w in found.items() if not any(s <= at < e for s, e in excused))
        return total, total / max(folded.count(" ") - 1, 1)

    def score(self, text: str | None) -> float:
        b, by_sum, by_word = self.curve
        total, per_word = self.features(text)
        z = b + by_sum * min(total, 40.0) + by_word * per_word
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "curve": self.curve, "_automaton": None}


def _entries(text: str | None) -> set[str]:
    words = set(fold(text).split())
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in BEGINNINGS if len(w) > n}


def learn_lexicon(
    labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_entries: int = 5_000, min_odds: float = 4.0,
) -> Lexicon:
    """Fit a lexicon on ``labelled``, one row a text. Its rows should be few columns: it is read twice."""
    half = F.pmod(F.xxhash64(F.lit("half"), F.col(key)), F.lit(2))
    rows = labelled.where(F.col(label).isNotNull()).select(F.coalesce(F.col(text), F.lit("")).alias("text"), (F.col(label) == 1).cast("int").alias("y"), half.alias("half"))
    totals = {(r.half, r.y): r.n for r in rows.groupBy("half", "y").agg(F.count("*").alias("n")).collect()}
    pos, neg = totals.get((0, 1), 0), totals.get((0, 0), 0)
    if not pos or not neg:
        return Lexicon({f" {w} ": s for w, s in BUILT_IN.items()})

    def count(batches):
        seen: tuple[Counter, Counter] = Counter(), Counter()
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen[y].update(_entries(t))
                if len(seen[0]) + len(seen[1]) > MAX_COUNTED:
                    yield from flush(seen)
        yield from flush(seen)
        trim()

    def flush(seen):
        for toxic in (1, 0):
            part = seen[toxic]
            keys = list(part)
            for i in range(0, len(keys), 50_000):
                k = keys[i : i + 50_000]
                n = [part[e] for e in k]
                zero = [0] * len(k)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n if toxic else zero, pa.int64()), pa.array(zero if toxic else n, pa.int64())], ["entry", "toxic", "clean"])
            part.clear()

    counts = rows.where("half = 0").select("text", "y").mapInArrow(count, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (pos + 1)) - F.log((F.col("clean") + 0.5) / (neg + 1))
    need = max(3, math.ceil(pos / 500))
    best = counts.where(F.col("toxic") >= need).withColumn("odds", odds).where(F.col("odds") >= min_odds).orderBy(F.desc("toxic"), "entry").limit(max_entries).collect()
    weights = {r.entry: float(r.odds) for r in best}
    # An entry that a shorter beginning covers as well adds nothing.
    kept = {e: w for e, w in weights.items() if not any(len(e.strip()) > n and weights.get(e[: n + 1], 0) >= w - 0.5 for n in BEGINNINGS)}
    kept = kept or {f" {w} ": s for w, s in BUILT_IN.items()}
    lexicon = Lexicon(kept)

    def features(batches):
        for b in batches:
            f = [lexicon.features(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in f]), pa.array([x[1] for x in f]), b.column(1)], ["total", "per_word", "y"])

    # At most half the sample's rows, of three numbers each.
    table = rows.where("half = 1").select("text", "y").mapInArrow(features, "total double, per_word double, y int").toPandas()
    if table.y.nunique() == 2:
        lexicon.curve = _fit_curve(table.total.to_numpy(), table.per_word.to_numpy(), table.y.to_numpy())
    return lexicon


def _fit_curve(total: np.ndarray, per_word: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression with a small ridge; slopes are not negative."""
    x = np.column_stack([np.ones_like(total), np.minimum(total, 40.0), per_word])
    scale = np.maximum(x.max(axis=0), 1e-9)
    z, beta, ridge = x / scale, np.zeros(3), np.diag([1e-3, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ beta)
        beta = beta + np.clip(step, -5, 5)
        beta[1:] = np.maximum(beta[1:], 0)
        if np.abs(step).max() < 1e-6:
            break
    b = beta / scale
    return float(b[0]), float(b[1]), float(b[2])


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = 40_000, where=None) -> DataFrame:
    """At most ``sample`` labelled rows, those with the lowest hashes of their keys (all, where there are fewer)."""
    chosen = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    chosen = chosen.where(where) if where is not None else chosen
    chosen = chosen.groupBy(key).agg(F.max(label).alias(label)).orderBy(F.xxhash64(F.lit("sample"), F.col(key)), key).limit(sample)
    return docs.select(F.col(key).alias(key), F.col(text).alias(text)).join(F.broadcast(chosen), key)  # bounded by ``sample``


def score_texts(df: DataFrame, lexicon: Lexicon, text: str = "text", out: str = "score") -> DataFrame:
    """``df`` with the score of each whole text in ``out``, which replaces a column of that name (unless it is the text)."""
    if out == text:
        raise ValueError("the score needs a column of its own")
    df = df.drop(out)
    shared = df.sparkSession.sparkContext.broadcast(lexicon)

    def score(batches):
        one = shared.value.score
        for b in batches:
            yield b.append_column(out, pa.array([one(t) for t in b.column(b.schema.get_field_index(text)).to_pylist()], pa.float64()))
        trim()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(score, f"{fields}, `{out}` double")
