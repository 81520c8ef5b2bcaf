"""The full-reveal search, evaluation rules and resampling statistics against plain versions."""

import itertools
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import branching as B
from corvane.functions import kernels as K
from corvane.functions.params import SolveParams
from corvane.operators import dense, evaluate, expand, statistics


def grid_graph(n, p, seed, sym=True):
    rng = np.random.default_rng(seed)
    arcs = [(a, b) for u in range(n) for v in range(u + 1, n) if rng.random() < p for a, b in ((u, v), (v, u))] if sym else [(u, v) for u in range(n) for v in range(n) if u != v and rng.random() < p]
    g = K.adjacency(arcs)
    for x in range(n):
        g.setdefault(x, set())
    return g


def frame(spark, g):
    return spark.createDataFrame([(u, v) for u in g for v in g[u]], "source long, target long")


def test_grid_of_cells_is_optimal_with_fewer_nodes():
    """15 graphs of 9 cells; the search before this one took 195 tree nodes for the cells of connectivity 2."""
    taken = 0
    for p, seed in itertools.product((0.25, 0.5, 0.75), range(5)):
        g = grid_graph(12, p, seed)
        q = max(g, key=lambda x: (len(g[x]), x))
        want = {(k, kappa): v for kind, k, kappa, v, _ in K.enumerate_optima(g, q, (3, 4, 5), (0, 1, 2)) if kind == "edge_density_kappa"}
        for (k, kappa), value in want.items():
            r = B.densest(g, q, k, kappa)
            assert r["density"] == max(value, 0) and (r["gap_status"], r["gap"], r["open"]) == ("exhausted", 0, 0)
            taken += r["bb_nodes"] if kappa == 2 else 0
    assert taken < OLD_NODES


OLD_NODES = 195


@pytest.mark.parametrize("limits, status", [
    (B.Limits(nodes=2), "node_limit"), (B.Limits(hard=0.0), "hard_time_limit"), (B.Limits(soft=0.0), "soft_time_limit"), (B.Limits(iterations=1), "iteration_limit"), (B.Limits(gap=0.9), "gap_tolerance"),
])
def test_each_limit_ends_a_search_and_is_reported(limits, status):
    g = grid_graph(40, 0.15, 7, sym=False)
    r, whole = B.densest(g, 0, 5, 0, limits), B.densest(g, 0, 5, 0)
    assert r["gap_status"] == status and whole["gap_status"] == "exhausted" and r["density"] <= whole["density"] <= Fraction(r["bound"]).limit_denominator(10**6) + Fraction(1, 10**5)
    steps = whole["iterations"]
    assert [s["iteration"] for s in steps] == list(range(len(steps))) and all(a["value"] == b["lambda"] for a, b in itertools.pairwise(steps)) and steps[-1]["value"] == float(whole["density"])


@pytest.mark.parametrize("kappa", [0, 1, 2, 3])
def test_pruning_never_loses_and_keeps_the_connectivity(kappa):
    rng = np.random.default_rng(kappa)
    for seed in range(12):
        g = grid_graph(14, 0.4, seed, sym=seed % 2 == 0)
        und = K.support(g)
        s = {0, *(int(x) for x in rng.choice(14, 9, replace=False))}
        if kappa and not K.kappa_verify(und, s, 0, kappa):
            continue
        out = B.prune_incumbent(g, und, s, 0, 4, kappa)
        assert out <= s and 0 in out and len(out) >= min(4, len(s)) and B.density(g, out) >= B.density(g, s) and K.kappa_verify(und, out, 0, kappa)
        assert all(B.holds(und, s, 0, x) == K.kappa_verify(und, s, 0, x) for x in (0, 1, 2, 3))


def test_levels_are_cores(spark):
    g = grid_graph(40, 0.08, 3, sym=False)
    und = K.support(g)
    want, left, c = {}, {u for u in g if und[u]}, 0
    weight = lambda u, s: sum((v in g[u]) + (u in g[v]) for v in und[u] & s)
    while left:
        low = [u for u in left if weight(u, left) <= c]
        if low:
            left -= {low[0]}
            want[low[0]] = c
        else:
            c += 1
    assert {r.node: r.level for r in dense.core_levels(frame(spark, g)).collect()} == want


def test_reveal_asks_until_there_are_enough(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 4), (10, 11), (10, 12), (10, 13), (12, 13)], "source long, target long")
    asked, told = dense.adaptive_reveal(expand.revealed(edges), spark.createDataFrame([(0,), (10,), (4,)], "query long"), 4)
    rows = {(r.query, r.node): r["round"] for r in asked.collect()}
    assert rows == {(0, 0): 0, (0, 1): 1, (0, 2): 2, (0, 3): 3, (10, 10): 0, (10, 11): 1, (10, 12): 1, (10, 13): 1, (4, 4): 0}
    assert {(r.query, r.source, r.target) for r in told.collect()} == {(0, i, i + 1) for i in range(4)} | {(10, 10, 11), (10, 10, 12), (10, 10, 13), (10, 12, 13)}
    first = {(r.query, r.k): r for r in dense.first_communities(expand.revealed(edges), spark.createDataFrame([(0,)], "query long"), (4,), (1,)).collect()}
    assert set(first[0, 4].nodes) == {0, 1, 2, 3}


def test_full_reveal_finds_the_optimum(spark):
    """Two components; the whole reveal beats the one-hop ball; an enumeration and an unpeeled search agree."""
    a, b = grid_graph(12, 0.3, 1, sym=False), grid_graph(60, 0.06, 2, sym=False)
    arcs = [(u, v) for u in a for v in a[u]] + [(100 + u, 100 + v) for u in b for v in b[u]]
    edges = spark.createDataFrame([*arcs, (500, 501)], "source long, target long")
    queries = spark.createDataFrame([(0,), (5,), (100,), (130,), (500,), (999,)], "query long")
    found = {(r.query, r.k, r.kappa): r for r in dense.full_communities(edges, queries, (3, 4), (0, 1)).collect()}
    reach = dense._reach_of(0)
    for q in (0, 5, 100, 130):
        g = a if q < 100 else {100 + u: {100 + v for v in vs} for u, vs in b.items()}
        keep = reach(g, q)
        own = {u: g[u] & keep for u in keep}
        for k in (3, 4):
            for kappa in (0, 1):
                r = found[q, k, kappa]
                want = (K.brute_force(own, q, k, kappa) or (0,))[0] if q < 100 else B.densest(own, q, k, kappa)["density"]
                assert r.density == float(want) and r.revealed == len(keep) and r.gap_status == "exhausted" and r.optimality_gap == 0
    assert found[500, 3, 0].nodes == [] and found[500, 3, 0].revealed == 2 and found[999, 3, 0].revealed == 1


def test_subsets_by_bit_masks_agree_with_the_kernel(spark):
    g = grid_graph(9, 0.4, 5, sym=False)
    members = spark.createDataFrame([(q, u) for q in (0, 4) for u in g], "query long, node long")
    for r in dense.subset_optima(frame(spark, g), members, (3, 4)).collect():
        assert r.opt_density == float(K.brute_force(g, r.query, r.k)[0]) and bin(r.opt_mask).count("1") == r.opt_size
    with pytest.raises(ValueError, match="members"):
        dense.subset_optima(frame(spark, g), members, (3,), most=8)


def test_average_degree_is_grown_to_the_floor(spark):
    edges = spark.createDataFrame([(u, v) for u in (1, 2, 3) for v in (1, 2, 3) if u != v] + [(3, 4), (4, 5)], "source long, target long")
    found = {k: evaluate.run_solver(edges, spark.createDataFrame([(1,)], "query long"), SolveParams("avgdeg", k)).first() for k in (3, 4, 9)}
    assert [found[k].retrieved_nodes for k in (3, 4, 9)] == [[1, 2, 3], [1, 2, 3, 4], [1, 2, 3, 4, 5]]


def test_fallback_walks_successors(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 4)], "source long, target long")
    nodes = spark.createDataFrame([(1, 7, True), (2, 7, True), (3, 0, False), (4, 0, False)] + [(i, 5, True) for i in (10, 11, 12)], "node_id long, label int, train boolean")
    one = lambda cap: evaluate.classify(spark.createDataFrame([(3, 3)], "query long, node long"), edges, nodes, spark.createDataFrame([(3,)], "query long"), "uniform", max_in_edges=cap).first()
    assert (one(0).predicted_label, one(0).fallback_used) == (5, True) and one(5).predicted_label == 7


def test_a_sweep_under_another_weighting_solves_nothing(spark, tmp_path):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 4)], "source long, target long")
    nodes = spark.createDataFrame([(i, 1, i < 3) for i in range(1, 5)], "node_id long, label int, train boolean")
    asked = []

    def solver(e, q, p):
        asked.append(q.count())
        return evaluate.run_solver(e, q, p)

    queries = {"val": spark.createDataFrame([(1,), (3,)], "query_node long")}
    for weighting, split in (("distance", "a"), ("uniform", "a"), ("uniform", "b")):
        m = evaluate.sweep(spark, "d", {"bfs": {"bfs_depth": [1], "k": [2]}}, None, str(tmp_path), weighting=weighting)
        found = evaluate.run_sweep(m, queries, {"val": split}, edges, nodes, weighting=weighting, solver=solver).collect()
        assert len(found) == 2 and all(r.reused_solver_record for r in found) == (weighting == "uniform")
    assert asked == [2, 0, 0]
    (tmp_path / "old").mkdir()
    (tmp_path / "bfs").rename(tmp_path / "old" / "x.bak")
    assert evaluate.read_evaluations(spark, str(tmp_path / "old"), below=True).count() == 0


def test_parameters_that_no_method_takes_are_refused():
    assert SolveParams.of("bp", {"k": 3, "node_limit": 5, "dinkelbach_iter": 2, "gap_tolerance": 0.1}).node_limit == 5
    for bad in ({"k": 3, "depth": 1}, {"k": 3, "node_limit": 0}):
        with pytest.raises(ValueError):
            SolveParams.of("bp", bad)


# Statistics


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(4)
    rows = [(c, k, s, 1000 + 37 * q, int(t), int(t if rng.random() < right else rng.integers(0, 4)), "g") for c, k, right in (("a", 3, 0.9), ("b", 3, 0.5), ("c", 4, 0.88)) for s in (1, 2) for q, t in enumerate(np.arange(30) % 3)]
    return spark.createDataFrame(rows, "cell string, cell_k int, seed int, query_node long, truth int, predicted int, g string"), rows


def indices(spark, n, parts, draws, seed):
    """The drawn rows as a matrix, from the table of multiplicities."""
    got = {}
    for r in statistics.resamples(spark.createDataFrame([(n // parts, parts)], "each long, parts int"), draws, seed).collect():
        got.setdefault(r.draw, []).extend([r.ordinal] * r.times)
    assert sorted(got.pop(-1)) == list(range(n))
    return np.array([sorted(got[d]) for d in range(draws)])


def test_intervals_equal_the_kernel(spark, cells):
    df, rows = cells
    one = df.where("seed = 1")
    drawn = indices(spark, 30, 1, 40, 0)
    ci = {r.cell: r for r in statistics.bootstrap_ci(one, ["cell"], draws=40).collect()}
    for c in "abc":
        t, p = (np.array([r[i] for r in rows if r[0] == c and r[2] == 1]) for i in (4, 5))
        scores = K.fixed_label_scores(t, p, drawn)
        for i, name in enumerate(("precision", "recall", "f1", "accuracy")):
            lo, hi = np.percentile(scores[i], [2.5, 97.5])
            assert (ci[c][f"{name}_ci_lo"], ci[c][f"{name}_ci_hi"], ci[c][f"{name}_boot_se"]) == pytest.approx((lo, hi, (hi - lo) / 4), abs=1e-9)
    pooled = indices(spark, 60, 2, 40, 0)
    assert all((np.bincount(r // 30) == 30).all() for r in pooled)
    for r in statistics.paired_ci(df, ["g"], by_seed="seed", draws=40).collect():
        t, p = (np.array([x[i] for x in sorted(rows, key=lambda x: (x[2], x[3])) if x[0] == r.cell]) for i in (4, 5))
        for name, (lo, hi) in zip(("precision", "recall", "f1"), K.score_intervals(t, p, pooled), strict=True):
            assert (r[f"{name}_lo"], r[f"{name}_hi"]) == pytest.approx((lo, hi), abs=1e-9)
    with pytest.raises(ValueError, match="numbers of rows"):
        statistics.paired_ci(df.where("NOT (seed = 2 AND query_node = 1000)"), ["g"], by_seed="seed", draws=3).collect()


def test_ties_equal_the_kernel(spark, cells):
    df, rows = cells
    one = [r for r in rows if r[2] == 1]
    found = {(r.cell, r.metric): r for r in statistics.bootstrap_ties(df.where("seed = 1"), ["g"], 40).collect()}
    drawn, (t, *p) = indices(spark, 30, 1, 40, 42), [np.array([r[i] for r in one if r[0] == c]) for c, i in (("a", 4), ("a", 5), ("b", 5), ("c", 5))]
    labels = np.unique(np.concatenate([t, *p]))
    scores = {c: K.fixed_label_scores(t, x, drawn, labels) for c, x in zip("abc", p, strict=True)}
    value = {c: K.fixed_label_scores(t, x, np.arange(30)[None, :], labels)[:, 0] for c, x in zip("abc", p, strict=True)}
    for i, metric in enumerate(statistics.SCORES):
        best = min("abc", key=lambda c: (-value[c][i], c))
        for c in "abc":
            r = found[c, metric]
            lo, hi = np.percentile(scores[best][i] - scores[c][i], [2.5, 97.5])
            assert (r.value, r.std, r.overall_lo, r.overall_hi) == pytest.approx((value[c][i], scores[c][i].std(ddof=1), lo, hi), abs=1e-9)
            assert (r.overall_best, r.overall_tied, r.n_queries) == (c == best, bool(lo <= 0 <= hi), 30)
    sorted_ = [r.cell_k for r in statistics.table_sort(spark.createDataFrame([(4, "b", "f1"), (None, "a", "f1"), (3, "c", "f1")], "cell_k int, cell string, metric string")).collect()]
    assert sorted_ == [None, 3, 4]


def test_signed_ranks_equal_the_kernel(spark):
    rng = np.random.default_rng(8)
    groups = {"small": rng.normal(size=20), "large": rng.normal(0.1, 1, 400), "ties": rng.integers(-3, 4, 200).astype(float), "zeros": np.zeros(5), "one": np.array([2.0]), "wide": 10.0 ** rng.integers(-300, 300, 80) * rng.choice([-1, 1], 80)}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("small", None), ("small", float("nan"))]
    found = {r.m: r for r in statistics.wilcoxon(spark.createDataFrame(rows, "m string, delta double"), ["m"]).collect()}
    for g, xs in groups.items():
        want = K.wilcoxon_p(list(xs))
        assert found[g].n_paired == len(xs) and (found[g].p is None if want is None else found[g].p == pytest.approx(want, abs=1e-12))


def test_ordinals_number_rows_by_stretches(spark):
    rows = [("a", x) for x in (5, -3, 10**12, 7, 7)] + [("b", 1), (None, 2), (None, None)]
    found = sorted(((r.k, r.x, r.ordinal) for r in statistics.ordinals(spark.createDataFrame(rows, "k string, x long"), ["k"], "x").collect()), key=str)
    assert found == sorted([("a", -3, 0), ("a", 5, 1), ("a", 7, 2), ("a", 7, 3), ("a", 10**12, 4), ("b", 1, 0), (None, None, 0), (None, 2, 1)], key=str)


def test_signed_ranks_read_the_deltas_once(spark, tmp_path):
    path = str(tmp_path / "deltas")
    rows = [("a", 2.0), ("a", -1.0), ("a", 0.0), ("a", None), ("a", float("nan")), ("b", None), ("c", 0.0)]
    spark.createDataFrame(rows, "m string, delta double").write.parquet(path)
    ranks = statistics.signed_ranks(spark.read.parquet(path), ["m"])
    assert not any(path in f for f in ranks.inputFiles())
    assert {r.m: (r.n_paired, r.n, r.w_plus, r.tie_term, r.untied) for r in ranks.collect()} == {"a": (3, 2, 2.0, 0.0, True), "b": (0, 0, 0.0, 0.0, True), "c": (1, 0, 0.0, 0.0, True)}
