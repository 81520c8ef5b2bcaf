"""Distributed places, bounded digests, pools of sources, cuts inside communities, and manifests."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from corvane.functions import kernels
from corvane.operators import display, evaluate, flatten, ranking, solve, splits


def test_places_of_hot_null_and_absent_keys(spark):
    """One key holds most rows and is spread over tasks; a null key is a key of its own; extra columns stay."""
    rows = [(None if i % 97 == 0 else ("hot" if i % 5 else f"k{i % 7}"), (i * 7919) % 3001, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v int, _x int").repartition(7)
    got = {r._x: r.place for r in ranking.numbered(df, ["k"], [F.desc("v"), "_x"]).collect()}
    for key in {r[0] for r in rows}:
        order = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2]))
        assert [got[r[2]] for r in order] == list(range(1, len(order) + 1))
    every = [r._x for r in ranking.numbered(df, [], ["v", "_x"]).orderBy("place").collect()]
    assert every == [r[2] for r in sorted(rows, key=lambda r: (r[1], r[2]))]
    same = ranking.numbered(spark.createDataFrame([(1,)] * 5, "v int"), [], ["v"])
    assert sorted(r.place for r in same.collect()) == [1, 2, 3, 4, 5]
    assert ranking.numbered(df.limit(0), ["k"], ["v"]).count() == 0


def test_ledger_places_follow_the_ledger(spark):
    shown = spark.createDataFrame([(1, "a", 2, "B", "core"), (1, "b", 1, "b", "core"), (2, "c", 1, "a", "core"), (2, "g", None, "a", "ghost")], "query long, id string, display_num int, label string, type string")
    shown = shown.withColumn("journal", F.col("label"))
    rows = display.ledger_places(shown, "journal", True).orderBy("place").collect()
    assert [(r.id, r.place) for r in rows] == [("b", 1), ("a", 2), ("c", 3)]


def test_records_of_a_cell_come_in_stretches(spark):
    df = spark.createDataFrame([("bfs", "h", None, "test", (i * 37) % 101, i) for i in range(101)] + [("bp", "h", 1, "val", 1, 1)], "method string, params_hash string, seed int, query_split string, query_node long, ord long")
    rows = flatten.group_records(df, "test", "ord", stretch=40).orderBy("first").collect()
    assert [(r.first, r.n_records, len(r.records)) for r in rows] == [(1, 40, 40), (41, 40, 40), (81, 21, 21)]
    assert [x.query_node for r in rows for x in r.records] == list(range(101))


def test_digests_say_when_they_are_too_large(spark, monkeypatch):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "source long, target long")
    nodes = spark.createDataFrame([(1, 0, True, False, False), (2, 0, False, True, False), (3, 0, False, False, True)], "node_id long, label int, train boolean, val boolean, test boolean")
    assert splits.edges_hash(edges).first().num_edges == 3 and splits.set_hashes(nodes).first().members == 3
    monkeypatch.setattr(splits, "MAX_HASHED", 2)
    for ask in (lambda: splits.edges_hash(edges), lambda: splits.split_hashes(nodes), lambda: splits.set_hashes(nodes), lambda: splits.set_row(nodes)):
        with pytest.raises(ValueError, match="more than 2"):
            ask()


def _reach(adj, q):
    seen, left = {q}, [q]
    while left:
        fresh = adj[left.pop()] - seen
        seen |= fresh
        left += fresh
    return seen


@pytest.mark.parametrize("seed", range(3))
def test_pool_equals_whole_reveals(spark, seed):
    rng = random.Random(seed)
    arcs = {(u, v) for u in range(24) for v in range(6, 24) if u != v and rng.random() < 0.07} | {(30, 31), (31, 32), (40, 41)}
    edges = spark.createDataFrame(sorted(arcs) + [(5, 5)], "source long, target long").where("source <> target")
    adj = kernels.adjacency(arcs)
    want = {}
    for q in {u for u, _ in arcs} - {v for _, v in arcs}:
        near = _reach(adj, q)
        size = len(kernels.bridge_free_component(kernels.support({u: adj[u] & near for u in near}), q))
        if size >= 3:
            want[q] = size
    assert {r.query: r.bridge_free_size for r in solve.query_pool(edges, 3).collect()} == want
    if seed == 0:
        assert want  # some source lies on a cycle


def test_cuts_inside_communities_equal_enumeration(spark):
    rng = random.Random(5)
    arcs = sorted({(u, v) for u in range(30) for v in range(30) if u // 6 == v // 6 and u != v and rng.random() < 0.4} | {(0, 7)})
    edges = spark.createDataFrame(arcs, "source long, target long")
    members = spark.createDataFrame([(6 * g, 6 * g + i) for g in range(5) for i in range(6)] + [(100, 100)], "query long, node long")
    got = {r.query: r.int_ncut for r in solve.internal_ncuts(edges, members).collect()}
    assert got[100] == 0.0
    for g in range(5):
        s = set(range(6 * g, 6 * g + 6))
        und = kernels.support(kernels.adjacency([e for e in arcs if set(e) <= s]))
        for u in s:
            und.setdefault(u, set())
        cuts = []
        for r in range(1, 6):
            for side in map(set, itertools.combinations(sorted(s), r)):
                over = sum(len(und[u] & (s - side)) for u in side)
                a, b = (sum(len(und[u] & s) for u in part) for part in (side, s - side))
                cuts.append((over, over * (a + b) / (a * b) if a and b else 0.0))
        least = min(c for c, _ in cuts)
        assert any(abs(got[6 * g] - v) < 1e-12 for c, v in cuts if c == least)


def test_manifest_round_trip(spark, tmp_path):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "source long, target long")
    nodes = spark.createDataFrame([(i, i % 2, True, False, False) for i in (1, 2, 3)], "node_id long, label int, train boolean, val boolean, test boolean")
    m = evaluate.sweep(spark, "d", {"bfs": {"bfs_depth": [1], "k": [2, 3]}}, None, "")
    path = str(tmp_path / "manifest")
    queries = {"val": spark.createDataFrame([(1,)], "query_node long")}
    assert evaluate.run_sweep(m, queries, {"val": "s"}, edges, nodes, path, qualities=False).count() == 2
    assert sorted(evaluate.read_manifest(spark, path).na.fill("").collect()) == sorted(m.collect())


def test_sweep_without_a_root_writes_no_records(spark):
    rows = evaluate.sweep(spark, "d", {"bfs": {"bfs_depth": [1], "k": [2]}}, None, "").collect()
    assert [r.records_dir for r in rows] == [""]  # a folder of the file system's root before
    rows = evaluate.sweep(spark, "d", {"bfs": {"bfs_depth": [1], "k": [2]}}, None, "/records").collect()
    assert rows[0].records_dir.startswith("/records/bfs/")
