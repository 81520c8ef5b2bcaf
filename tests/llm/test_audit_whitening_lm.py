"""Filter audit, whitening and language-model scores against plain versions, and on odd input."""

import collections
import itertools
import math
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("corvane.llm")

from corvane.llm import backoff_lm, filter_audit, queries, whitening
from corvane.session import ship

DOCS = "doc_id long, text string, lang string, extra string"
WORDS = "[^\x20\x09-\x0d]+"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


# Filter audit


def plain_audit(docs, labels):
    """Every order applied to every document, one filter after the other."""
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    fails = []
    for i, t, _ in docs:
        t = t or ""
        w = re.findall(WORDS, t)
        fails.append({
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t],
        })
    out, removed = {}, collections.Counter()
    for part in {p or "" for *_, p in docs}:
        rows = [k for k, d in enumerate(docs) if (d[2] or "") == part]
        for order in itertools.permutations("ABCDE"):
            kept = set(rows)
            for step, f in enumerate(order):
                gone = {k for k in kept if fails[k][f]}
                redundant = sum(fails[k][f] for k in rows if k not in kept)
                kept -= gone
                unique = sum(fails[k][f] and sum(fails[k].values()) == 1 for k in rows)
                lost = [sum(docs[k][0] in s for k in gone) for s in (good, toxic)]
                out[part, "".join(order), step + 1] = (len(kept), len(gone), redundant, unique, *lost)
                removed[part, f] += len(gone)
    return {(p, o, s, *v, removed[p, o[s - 1]]) for (p, o, s), v in out.items()}


AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_of_odd_rows(spark):
    many = " ".join(f"w{i}" for i in range(250))
    docs = [
        (5, "same text", "en"), (3, "same text", "en"), (3, "same text", "en"), (None, "same text", "de"), (9, "same text", None), (1, None, "en"), (2, "", None), (4, "  \t\r\n", "en"), (None, None, "en"),
        (6, many, "en"), (7, many + " #", "en"), (8, many + " word" * 300, "de"), (10, many.upper(), "de"), (11, many, "de"), (12, "x\x0by\x0cz\x1cq r " * 90, ""), (13, "É" * 30 + "A", "fr"), (14, " ".join(f"v{i}" for i in range(60_000)), "fr"),
    ]
    labels = [(5, 1, 0), (3, None, 1), (3, 1, None), (None, 1, 1), (6, 1, 1), (11, 1, None), (8, 0, 1), (99, 1, 1)]
    d = spark.createDataFrame([(*x, "e") for x in docs], DOCS).withColumnRenamed("extra", "mask")
    found = filter_audit.audit_filters(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).select(AUDIT).collect()
    assert {tuple(r) for r in found} == plain_audit(docs, labels) and len(found) == 600 * 4
    assert filter_audit.audit_filters(d.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_audit_query_is_its_sql_and_the_plain_version(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rows = {tuple(r[c] for c in AUDIT) for r in queries.queries()["op12_filter_audit"](spark, sf_dir).collect()}
    assert rows == set(con.sql(queries.oracle_sql()["op12_filter_audit"]).df()[AUDIT].itertuples(index=False, name=None))
    assert rows == plain_audit(con.sql("SELECT doc_id, text, lang FROM documents").fetchall(), con.sql("SELECT doc_id, quality, toxic FROM labels").fetchall())


# Whitening


def plain_whitening(vectors):
    """Exact covariance of the distinct integer vectors, their number and sums."""
    x = [tuple(math.floor(64 * float(c)) + 1_000_000 for c in v) for v in vectors]
    fit = sorted(set(x))
    n, d = len(fit), len(fit[0])
    s = [sum(v[i] for v in fit) for i in range(d)]
    centred = [[n * v[i] - s[i] for i in range(d)] for v in fit]
    cov = [[float(Fraction(sum(c[i] * c[j] for c in centred), n**3)) for j in range(d)] for i in range(d)]
    return x, n, s, np.array(cov)


def held(rows, keys, vectors, components=16):
    x, n, s, cov = plain_whitening(vectors)
    e, axes = np.linalg.eigh(cov)
    e, axes = e[::-1], axes[:, ::-1]
    got = collections.defaultdict(dict)
    for r in rows:
        got[r.vec_id][r.component] = r
    d = len(s)
    k = min(components, int((e > 1e-13 * e[0]).sum()))
    for key, v in zip(keys, x, strict=True):
        assert sorted(got[key]) == list(range(1, k + 1))
        c = np.array([float(Fraction(n * a - b, n)) for a, b in zip(v, s, strict=True)])
        for i, r in got[key].items():
            assert r.n == n and r.deviation == sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True)) and r.identity_error < 1e-9
            assert abs(r.explained - e[i - 1] / np.trace(cov)) < 1e-9 * r.explained
    y = np.array([[got[key][i].whitened for i in range(1, k + 1)] for key in keys])
    want = (np.array(x, float) - np.array(s) / n) @ axes[:, :k] / np.sqrt(e[:k])
    sign = np.sign((y * want).sum(0))
    assert np.abs(y * sign - want).max() < 1e-5
    return d


def test_whitening_query(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    rows = queries.queries()["op11_embedding_whitening"](spark, sf_dir).collect()
    table = [r for r in table if r.embedding is not None and all(c is not None and math.isfinite(c) for c in r.embedding)]
    assert len(rows) == 16 * len(table)
    held(rows, [r.vec_id for r in table], [r.embedding for r in table])


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = [[float(c) for c in v] for v in rng.normal(size=(40, 3)) * [9, 3, 1]]
    rows = [(i, v, "c") for i, v in enumerate(good)] + [(100 + i, good[0], "c") for i in range(30)]
    odd = [None, [], [1.0, None, 2.0], [1.0, float("nan"), 2.0], [float("inf"), 0.0, 1.0], [1.0, 2.0], [1e30, 0.0, 1.0]]
    df = spark.createDataFrame(rows + [(200 + i, v, "c") for i, v in enumerate(odd)], "vec_id long, embedding array<float>, component string")
    as_float = [[float(np.float32(c)) for c in v] for _, v, _ in rows]
    found = whitening.whiten(df).collect()
    assert len(found) == 3 * len(rows)
    held(found, [r[0] for r in rows], as_float)
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.where("vec_id >= 100 and vec_id < 130")).count() == 0
    flat = [(i, [float(i % 7), 2.0 * (i % 7), 5.0]) for i in range(20)] + [(None, [3.0, 6.0, 5.0])]
    found = whitening.whiten(spark.createDataFrame(flat, "vec_id long, embedding array<double>")).collect()  # one component has variance
    assert {r.component for r in found} == {1} and len(found) == 21 and found[0].explained == pytest.approx(1)


def test_compensated_sum_keeps_what_doubles_lose():
    """Outer products whose sum cancels but for the last bits, at entries of 2 ** 40."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.integers(-(2**40), 2**40, (500, 4)), np.ones((1, 4), "i8")])
    exact, high, low = whitening.centred(x, len(x), [int(c) for c in x.sum(0)])
    total = whitening.outer_sum(high, low)
    n = len(x)
    for i in range(4):
        for j in range(i, 4):
            want = Fraction(sum(int(a) * int(b) for a, b in zip(exact[:, i], exact[:, j], strict=True)), n * n)
            assert abs(Fraction(total[0][i, j]) + Fraction(total[1][i, j]) - want) <= abs(want) * Fraction(1, 2**90) + 1


# Language-model scores


def plain_scores(docs, held):
    """Counts in dictionaries, one token after the other."""
    def toks(t):
        data = (t or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
        return [*re.findall(WORDS.encode(), data), None]

    uni, pair, after = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for d, t in docs:
        if not held(d):
            w = toks(t)
            uni.update(w)
            pair.update(zip(["start", *w], w, strict=False))
            for a, b in zip(["start", *w], w, strict=False):
                after[a].add(b)
    n, v = sum(uni.values()), len(uni)
    sizes = collections.Counter(pair.values())
    disc = min(max(sizes[1] / max(1, sizes[1] + 2 * sizes[2]), 0.1), 0.9)
    context = collections.Counter()
    for (a, _), c in pair.items():
        context[a] += c
    p1 = lambda b: (uni[b] + 0.1) / (n + 0.1 * (v + 1))

    def p2(a, b):
        if not context[a]:
            return p1(b)
        return max(pair[a, b] - disc, 0) / context[a] + disc * len(after[a]) / context[a] * p1(b)

    for a in list(context)[:5]:  # probabilities sum to one, all unknown words being one
        assert sum(p2(a, b) for b in uni) + p2(a, b"\x00no") == pytest.approx(1)
    out = []
    for d, t in docs:
        w = toks(t)
        out.append((d, held(d), len(w), sum(uni[x] > 0 for x in w), n, sum(math.log10(p1(x)) for x in w), sum(math.log10(p2(a, b)) for a, b in zip(["start", *w], w, strict=False))))
    return out


def same_scores(rows, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    rows, want = sorted(map(tuple, rows), key=key), sorted(want, key=key)
    assert [r[:5] for r in rows] == [w[:5] for w in want]
    assert np.allclose([r[5:] for r in rows], [w[5:] for w in want], rtol=1e-9)


def held_out(d):
    return d is not None and zlib.crc32(str(d).encode()) % 10 == 0


HELD = "pmod(crc32(cast(cast(doc_id AS string) AS binary)), 10) = 0"


def test_lm_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows = queries.queries()["op13_lm_scoring"](spark, sf_dir).collect()
    same_scores(rows, plain_scores(docs, held_out))
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_lm_of_odd_rows_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(backoff_lm, "BLOCK", 200)
    monkeypatch.setattr(backoff_lm, "BUCKET", 50)
    texts = ["The cat SAT on the mat", "the cat", None, "", " \t\x0b\x0c\r\n", "the  cat\x1cran", "É é", "the cat sat on the mat", "the " * 3000 + "end"] + [f"a{i % 9} b{i % 4} c" for i in range(60)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, "the cat ran"), (1, "the cat"), (1, "the cat")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id long, text string, block string, held string").repartition(3)
    same_scores(backoff_lm.score_texts(df, F.expr(HELD)).collect(), plain_scores(docs, held_out))
    assert backoff_lm.score_texts(df.limit(0), F.expr(HELD)).count() == 0
    nothing = backoff_lm.score_texts(df, F.lit(True)).collect()
    assert {(r.n_known, r.train_tokens, r.score) for r in nothing} == {(0, 0, 0.0)} and len(nothing) == len(docs)
