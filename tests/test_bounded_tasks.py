"""Loops and groups over larger tables: what goes to the driver, what a task holds, and how often a table is read."""

import random

import pytest

from corvane import session
from corvane.operators import dense, expand, votes
from corvane.session import ship


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def edges(spark):
    pick = random.Random(5)
    pairs = {(pick.randrange(40), pick.randrange(40)) for _ in range(300)}
    return session.cut(ship(spark).createDataFrame(sorted(p for p in pairs if p[0] != p[1]), "source long, target long"))


def test_levels_are_not_sent_to_the_driver(spark, edges, monkeypatch):
    plans = []
    for name in ("cut", "cut_by"):
        inner = getattr(session, name)
        monkeypatch.setattr(dense, name, lambda df, *rest, inner=inner: plans.append(plan(df)) or inner(df, *rest))
    found = {r.node: r.level for r in dense.core_levels(edges).collect()}
    assert len(plans) > 2 and not any("Broadcast" in p for p in plans)
    weight, near = {}, {}
    for r in edges.collect():
        for a, b in ((r.source, r.target), (r.target, r.source)):
            weight[a, b] = weight.get((a, b), 0) + 1
            near.setdefault(a, set()).add(b)
    left, want, level = set(near), {}, 0
    while left:  # the least linked goes first
        least = min(left, key=lambda u: sum(weight[u, v] for v in near[u] & left))
        level = max(level, sum(weight[least, v] for v in near[least] & left))
        want[least] = level
        left.remove(least)
    assert found == want


def test_last_layer_is_dealt_by_its_rows(spark, edges, monkeypatch):
    arcs = expand.revealed(edges)
    queries = edges.selectExpr("source AS query").distinct()
    want = {tuple(r) for r in expand.bfs_distances(arcs, queries, 3).collect()}
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    dealt = expand.bfs_distances(arcs, queries, 3)
    assert "REPARTITION_BY_NUM" in plan(dealt) and {tuple(r) for r in dealt.collect()} == want


def test_votes_read_distances_once(spark):
    pick = random.Random(9)
    rows = [(q, n, pick.choice([1, 2, 3])) for q in range(20) for n in range(100, 130) if pick.random() < 0.4] + [(q, q, 0) for q in range(20)] + [(77, 77, 0)]
    dist = session.cut(ship(spark).createDataFrame(rows, "query long, node long, distance int"))
    told = [(n, n % 3, n % 5 > 0, False, False) for n in [*range(20), *range(100, 130), 77]]
    nodes = spark.createDataFrame(told, "node_id long, label int, train boolean, val boolean, test boolean")
    train = {n: lab for n, lab, t, *_ in told if t}
    common = min(set(train.values()), key=lambda x: (-list(train.values()).count(x), x))

    def best(scores):
        return min(scores, key=lambda x: (-scores[x], x))

    nearest, weighed = {}, {}
    for q in {r[0] for r in rows}:
        own = [(d, train[n]) for p, n, d in rows if p == q and d > 0 and n in train]
        first = [lab for d, lab in own if d == min(own)[0]]
        nearest[q] = best({x: first.count(x) for x in first}) if own else common
        if own:
            weighed[q] = best({x: sum(sum(lab == x and d == e for d, lab in own) / e for e in (1, 2, 3)) for _, x in own})
    fallback, distance = votes.fallback_vote(dist, nodes), votes.distance_vote(votes.train_members(dist, nodes))
    assert plan(fallback).count("FileScan") == 1 and plan(distance).count("FileScan") == 1
    assert {r.query: r.predicted for r in fallback.collect()} == nearest
    assert {r.query: r.predicted for r in distance.collect()} == weighed
    both = votes.distance_vote(votes.train_members(dist.select("query", "node"), nodes), dist)
    assert {r.query: r.predicted for r in both.collect()} == weighed


def test_links_of_a_node_are_dealt_by_their_number(spark, sf_dir, monkeypatch):
    from corvane.plans import registry

    monkeypatch.setattr(session, "TASK_ROWS", 100)
    assert "REPARTITION_BY_NUM" in plan(registry.queries()["scan_sim_adjacency"](ship(spark), sf_dir))
