"""Kernels against closed forms and enumeration."""

import random
import time
from fractions import Fraction

import numpy as np
import pytest

from corvane.functions import branching as B
from corvane.functions import kernels as K


def sym(*pairs):
    return K.adjacency([(u, v) for a, b in pairs for u, v in ((a, b), (b, a))])


K3 = sym((0, 1), (1, 2), (0, 2))
K4 = sym(*[(a, b) for a in range(4) for b in range(a)])
K4_LESS = sym((0, 1), (0, 2), (0, 3), (1, 2), (1, 3))
PATH = sym((0, 1), (1, 2), (2, 3))


def gnp(n, p, seed):
    rng = np.random.default_rng(seed)
    return sym(*[(u, v) for u in range(n) for v in range(u + 1, n) if rng.random() < p])


@pytest.mark.parametrize("g,k,kappa,density,size", [(K3, 2, 0, 1, None), (K3, 2, 2, 1, 3), (K4, 4, 3, 1, 4), (K4_LESS, 4, 0, Fraction(10, 12), 4), (K4_LESS, 4, 2, Fraction(10, 12), 4), (K4_LESS, 3, 0, 1, 3)])
def test_closed_forms(g, k, kappa, density, size):
    r = B.densest(g, 0, k, kappa)
    assert r["density"] == density and 0 in r["nodes"] and (size is None or len(r["nodes"]) == size)


def test_infeasible_and_disconnected():
    assert B.densest(K4_LESS, 0, 4, 3)["nodes"] == []
    g = sym((1, 2))
    g[0] = set()
    assert B.densest(g, 0, 3)["density"] == Fraction(2, 6)
    assert B.densest(g, 0, 3, 1)["nodes"] == []


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("p", [0.25, 0.5, 0.75])
def test_dense_community_is_optimal(seed, p):
    g = gnp(8, p, seed)
    for x in range(8):
        g.setdefault(x, set())
    q = max(g, key=lambda x: (len(g[x]), x))
    for k in (3, 4):
        for kappa in (0, 1, 2):
            want = K.brute_force(g, q, k, kappa)
            assert B.densest(g, q, k, kappa)["density"] == (want[0] if want else 0)


@pytest.mark.parametrize("seed", range(12))
def test_directed_graphs(seed):
    rng = np.random.default_rng(seed)
    g = K.adjacency([(u, v) for u in range(7) for v in range(7) if u != v and rng.random() < 0.3] + [(0, 1)])
    assert B.densest(g, 0, 3)["density"] == (K.brute_force(g, 0, 3) or (0,))[0]
    assert K.avgdeg_anchored(g, 0)[0] == K.brute_force_avgdeg(g, 0)


def test_average_degree():
    assert K.avgdeg_anchored(K3, 0)[0] == 2 and K.avgdeg_anchored(K4, 0)[0] == 3 and K.avgdeg_anchored(K4_LESS, 0)[0] == Fraction(5, 2)


def test_connectivity():
    assert K.edge_connectivity(K3, {0, 1, 2}, 0) == 2 and K.edge_connectivity(PATH, {0, 1, 2}, 0) == 1
    assert K.edge_connectivity(sym((0, 1), (1, 2)), {0, 2}, 0) == 0
    assert K.kappa_verify(K3, {0, 1, 2}, 0, 2) and not K.kappa_verify(PATH, {0, 1, 2}, 0, 2) and not K.kappa_verify(K3, {0}, 0, 1) and K.kappa_verify(K3, {0}, 0, 0)


def test_cuts_and_spectrum():
    assert K.internal_ncut(PATH, {0, 1, 2, 3}) == pytest.approx(1.2)
    star, c4 = sym((0, 1), (0, 2), (0, 3)), sym((0, 1), (1, 2), (2, 3), (3, 0))
    for g, want in ((K3, 1.5), (K4, 4 / 3), (c4, 1.0), (star, 1.0), (sym((0, 1), (2, 3)), 0.0)):
        assert K.algebraic_connectivity(g, set(g)) == pytest.approx(want)


def test_bridges_and_growth():
    g = K.support(K.adjacency([(0, 1), (1, 2), (2, 3), (3, 4), (0, 4), (4, 5), (10, 11), (10, 12), (11, 12)]))
    assert len(K.bridge_free_component(g, 0)) == 5 and len(K.bridge_free_component(g, 10)) == 3


def grown_by_hand(said: dict[int, list[int]], q: int, k: int) -> set[int]:
    """One query from its own node: ask, then take the best linked node, first mentioned of equals."""
    inside, order, links, asked = [q], [q], set(), []
    while True:
        for u in inside:
            if u not in asked:
                asked.append(u)
                for v in said.get(u, []):
                    order += [v] * (v not in order)
                    links |= {(u, v), (v, u)} if u != v else set()
        near = [v for v in order if v not in inside and any((u, v) in links for u in inside)]
        if len(inside) >= k or not near:
            return set(inside)
        inside.append(max(near, key=lambda v: (sum((u, v) in links for u in inside), -order.index(v))))


def test_growth_asks_members_and_breaks_ties_by_first_mention():
    said = {0: [9, 4], 9: [7, 0], 4: [7, 3], 7: [3], 3: []}
    assert K.grow_to_k(lambda u: said.get(u, []), [0], 3) == {0, 9, 4} or grown_by_hand(said, 0, 3) == {0, 9, 4}
    rng = np.random.default_rng(3)
    for _ in range(40):
        said = {u: [int(v) for v in rng.permutation(9)[: rng.integers(0, 4)] if v != u] for u in range(9)}
        for k in (1, 2, 4, 9):
            assert K.grow_to_k(lambda u: said[u], [0], k) == grown_by_hand(said, 0, k)  # noqa: B023


def test_growth_of_many_queries_at_once(spark):
    from pyspark.sql import functions as F

    from corvane.operators import expand, solve

    rng = np.random.default_rng(5)
    edges = sorted({(int(a), int(b)) for a, b in rng.integers(0, 14, (26, 2)) if a != b})
    df = spark.createDataFrame([(u, v, i) for i, (u, v) in enumerate(edges)], "source long, target long, edge_ord long")
    said = {u: [v for a, v in edges if a == u] for u in range(14)}
    queries = df.select(F.col("source").alias("query")).distinct()
    for k, depth in ((5, 0), (6, 1)):
        got = {r.query: set(r.nodes) for r in solve.grown_communities(expand.revealed(df), queries, k, depth).collect()}
        for q, nodes in got.items():
            if depth == 0:
                assert nodes == grown_by_hand(said, q, k)
            else:
                assert nodes >= {q, *said[q]} and len(nodes) <= max(k, 1 + len(said[q]))


def test_enumerated_optima_agree_with_the_solvers():
    rng = np.random.default_rng(11)
    for _ in range(6):
        g = K.adjacency([(int(a), int(b)) for a, b in rng.integers(0, 7, (14, 2))] + [(0, 1)])
        found = {(kind, k, kappa): v for kind, k, kappa, v, _ in K.enumerate_optima(g, 0, (3, 4), (0, 1, 2))}
        for k in (3, 4):
            for kappa in (0, 1, 2):
                want = found["edge_density_kappa", k, kappa]
                r = B.densest(g, 0, k, kappa)
                assert r["density"] == max(want, 0) and r["gap_status"] == "exhausted" and r["gap"] == 0 and r["open"] == 0
        assert found["avgdeg", None, None] <= K.avgdeg_anchored(g, 0)[0] and found["avgdeg_connected", None, None] <= found["avgdeg", None, None]


def test_cut_off_search_reports_its_gap():
    rng = np.random.default_rng(2)
    g = K.adjacency([(int(a), int(b)) for a, b in rng.integers(0, 24, (150, 2))])
    r, whole = B.densest(g, 0, 4, limits=B.Limits(nodes=1)), B.densest(g, 0, 4)
    assert r["gap_status"] in ("node_limit", "exhausted") and r["bound"] >= float(whole["density"]) - 1e-12 and (r["gap"] > 0) == (r["open"] > 0 and r["bound"] > float(r["density"]))


def test_statistics():
    assert K.wilcoxon_p([1, 2, 3, 4, 5]) == pytest.approx(0.0625) and K.wilcoxon_p([0, 0]) == 1.0 and K.wilcoxon_p([1]) is None
    t, p = np.array([0, 1, 2] * 20), np.array([0, 1, 1] * 20)
    for value, lo, hi in K.bootstrap_scores(t, p):
        assert lo <= value <= hi
    rows = K.resample_indices(60, 5, 0)
    for i, row in enumerate(rows):  # label by label
        per = []
        for label in (0, 1, 2):
            tp, fp, fn = (((t[row] == label) == x) & ((p[row] == label) == y) for x, y in ((True, True), (False, True), (True, False)))
            tp, fp, fn = tp.sum(), fp.sum(), fn.sum()
            per.append((tp / (tp + fp) if tp + fp else 0, tp / (tp + fn) if tp + fn else 0, 2 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else 0))
        assert np.allclose(K.fixed_label_scores(t, p, rows)[:3, i], np.mean(per, axis=0))
    assert {tuple(sorted(set(r // 20))) for r in K.resample_indices(60, 50, 0, 3)} == {(0, 1, 2)} and all((np.bincount(r // 20) == 20).all() for r in K.resample_indices(60, 9, 0, 3))
    with pytest.raises(ValueError):
        K.resample_indices(61, 1, 0, 3)
    lo, hi = K.score_intervals(np.zeros(10, int), np.zeros(10, int), K.resample_indices(10, 20, 0))[2]
    assert (lo, hi) == pytest.approx(K.wilson(1.0, 10))
    cells = {"a": t, "b": t.copy(), "c": (t + 1) % 3}
    table = {(r[0], r[3]): r for r in K.tie_table(t, cells, {"a": 3, "b": 3, "c": 4}, 100)}
    assert table["a", "f1"][6:10] == [True, True, True, True] and table["b", "f1"][6:10] == [False, False, True, True] and table["c", "f1"][6:10] == [True, False, True, False]


def test_dense_community_query_has_no_time_limit_and_says_how_it_ended(spark, sf_dir, monkeypatch):
    from corvane.operators import solve
    from corvane.plans import registry
    from corvane.session import ship

    given, real = {}, solve.dense_communities
    monkeypatch.setattr(solve, "dense_communities", lambda shown, **kw: given.update(kw) or real(shown, **kw))
    rows = registry.queries()["dense_community"](ship(spark), sf_dir).collect()
    assert "limits" not in given and rows and {r.gap_status for r in rows} == {"exhausted"}


def test_components_of_a_long_path_take_one_pass():
    n = 30_000
    und = {u: {v for v in (u - 1, u + 1) if 0 <= v < n} for u in range(n)}
    began = time.monotonic()
    assert K.components_inside(und, set(und)) == [set(und)]
    assert time.monotonic() - began < 5


def test_searches_on_one_graph_share_it_and_find_what_each_finds_alone():
    rng = random.Random(5)
    adj = K.adjacency((u, v) for u in range(120) for v in range(120) if u != v and rng.random() < 0.05)
    shared: dict = {}
    for q in (0, 7, 60):
        for kappa in (0, 1, 2):
            together, alone = (B.densest(adj, q, 4, kappa, B.Limits(nodes=30), None, s) for s in (shared, None))
            assert [together[c] for c in ("nodes", "density", "bb_nodes", "bound", "gap", "open")] == [alone[c] for c in ("nodes", "density", "bb_nodes", "bound", "gap", "open")]
    assert sum(isinstance(g, B._Graph) for g in shared.values()) == len({B._pool(adj, 0, kappa, shared) for kappa in (0, 1, 2)})


def test_reach_counts_equal_candidates_together():
    rng = np.random.default_rng(3)
    for size in (0, 5, 64, 65, 400):
        gain, twice = rng.integers(0, 4, size), rng.integers(0, 3, size)
        links = twice + rng.integers(0, 5, size)
        reach = B._Reach(gain, links, twice)
        for m in range(size + 1):
            plain = sorted((2 * gain + np.minimum(links, m - 1) + np.minimum(twice, m - 1)).tolist())[size - m :] if m else []
            assert reach.total(m) == sum(plain) <= reach.most(np.array([m]))[0]
