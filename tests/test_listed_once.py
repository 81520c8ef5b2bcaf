"""Links that are listed at one end, and arcs inside communities that travel in lists."""

import random

import pytest

from corvane.functions import kernels
from corvane.operators import expand, metrics, solve


@pytest.mark.parametrize("most", [512, 3])
def test_links_listed_once_count_as_before(spark, monkeypatch, most):
    monkeypatch.setattr(expand, "LISTED", most)  # 3: communities larger than lists
    rng = random.Random(most)
    arcs = sorted({(u, v) for u in range(25) for v in range(25) if u != v and rng.random() < 0.15})
    members = {q: sorted({q, *rng.sample(range(26), rng.randint(1, 9))}) for q in (*range(7), 25)}  # 25 has no links
    edges = spark.createDataFrame(arcs, "source long, target long")
    of = spark.createDataFrame([(q, u) for q, us in members.items() for u in us], "query long, node long")
    links = {frozenset(e) for e in arcs}
    for r in metrics.undirected_qualities(edges, of).collect():
        s = set(members[r.query])
        inner, volume = sum(e <= s for e in links), sum(len(e & s) for e in links)
        assert (r.size, r.internal_links, r.boundary_links) == (len(s), inner, volume - 2 * inner)
        small = min(volume, 2 * len(links) - volume)
        assert r.conductance == (pytest.approx((volume - 2 * inner) / small) if small else None)
    seen = {}
    for r in solve.inside(edges, of).collect():
        seen.setdefault(r.query, []).append((r.source, r.target))
    for q, us in members.items():
        assert sorted(seen[q]) == sorted([(u, v) for u, v in arcs if u in us and v in us] + [(u, u) for u in us])
    cuts = {r.query: r.int_ncut for r in solve.internal_ncuts(edges, of).collect()}
    for q, us in members.items():
        adj = kernels.adjacency([*((u, v) for u, v in arcs if u in us and v in us), *((u, u) for u in us)])
        assert cuts[q] == kernels.internal_ncut(kernels.support(adj), set(us))


def test_a_link_is_in_one_list(spark):
    edges = spark.createDataFrame([(u, v) for u in range(12) for v in range(u)], "source long, target long")
    members = spark.createDataFrame([(0, u) for u in range(12)], "query long, node long")
    seen, real = [], metrics.member_arcs
    metrics.member_arcs = lambda *a: seen.append(real(*a)) or seen[0]
    try:
        metrics.undirected_qualities(edges, members)
    finally:
        metrics.member_arcs = real
    rows = seen[0].collect()
    assert sum(len(r.targets) for r in rows) == 66 and sum(r.degree for r in rows) == 132
    plan = solve.inside(edges, members)._jdf.queryExecution().toString()
    assert "array_contains" in plan  # arcs go to communities as lists
