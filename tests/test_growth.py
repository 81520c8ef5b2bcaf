"""Steps whose work must grow with the input: each against a plain version, and for what it must not do."""

import hashlib
import random

from pyspark.sql import functions as F

from corvane.operators import expand, metrics, solve, splits, statistics, verify


def test_a_digest_streams_through_one_task(spark):
    """Lines of several keys in many ranges and batches; the bound leaves room for 360 times sf0.1 (161 million arcs)."""
    assert splits.MAX_HASHED > 200_000_000
    rows = [(f"k{i % 3}", (i * 7919) % 100_003, None if i % 1000 == 0 else f"line {(i * 7919) % 100_003}") for i in range(60_000)]
    df = spark.createDataFrame(rows, "k string, v int, line string").repartition(9)
    found = {r["_key"]: r["hash"] for r in splits.digests(df, F.col("k"), [F.col("v")], F.col("line")).collect()}
    for k in ("k0", "k1", "k2"):
        text = "\n".join(r[2] for r in sorted((r for r in rows if r[0] == k and r[2]), key=lambda r: r[1]))
        assert found[k] == "sha256:" + hashlib.sha256(text.encode()).hexdigest()
    assert splits.edges_hash(spark.createDataFrame([], "source long, target long")).first() == (splits.EMPTY, 0)


def test_overlap_with_a_class_lists_no_class(spark):
    """As with the class listed for each query; a query without a label, and one without a ball."""
    nodes = spark.createDataFrame([(i, None if i % 11 == 0 else i % 4) for i in range(60)], "node_id long, label int")
    queries = spark.createDataFrame([(0,), (5,), (7,), (11,), (20,)], "query long")
    members = spark.createDataFrame([(0, 0), (0, 4), (5, 5), (5, 9), (5, 10), (7, 7), (11, 3)], "query long, node long")
    own = nodes.toDF("query", "label").join(queries, "query").join(nodes.toDF("node", "label"), "label").select("query", "node")
    want = sorted(metrics.overlap(members, own).collect())
    found = metrics.class_overlap(members, queries, nodes)
    assert sorted(found.collect()) == want and len(want) == 5


def _plain_reach(arcs, q):
    seen, left = {q}, [q]
    while left:
        u = left.pop()
        for a, b in arcs:
            if a == u and b not in seen:
                seen.add(b)
                left.append(b)
    return len(seen)


def test_reach_is_counted_past_landmarks(spark, monkeypatch):
    """Queries in, before, beside and behind a strong core, in several components, one without arcs; of the core's queries none is searched."""
    rng = random.Random(4)
    arcs = {(u, v) for u in range(20) for v in range(20) if u != v and rng.random() < 0.2}
    arcs |= {(30, 31), (31, 0), (31, 32), (32, 33), (3, 40), (40, 41), (50, 41), (50, 51), (60, 61), (61, 62), (62, 60), (63, 62), (63, 64)}
    edges = spark.createDataFrame(sorted(arcs) + [(70, 70)], "source long, target long")
    asked = [0, 5, 19, 30, 31, 32, 40, 50, 60, 63, 64, 70, 99]
    searched, plain = [], expand.bfs_distances
    monkeypatch.setattr(expand, "bfs_distances", lambda a, q, *rest: searched.extend(r.query for r in q.collect()) or plain(a, q, *rest))
    found = {r.query: r.reached for r in expand.reach_counts(expand.revealed(edges), spark.createDataFrame([(q,) for q in asked], "query long")).collect()}
    assert found == {q: _plain_reach(arcs, q) for q in asked}
    assert len(searched) < 2 * 3 + len(asked) - 4


def test_only_sources_on_cycles_are_searched(spark, monkeypatch):
    """Of 40 orders with the same parts none is revealed; of two suppliers only that of a cycle is searched."""
    arcs = [(100 + i, j) for i in range(40) for j in range(3)] + [(200, 100), (200, 101), (201, 300), (201, 301), (300, 302), (301, 303), (302, 300), (303, 301), (302, 303)]
    arcs += [(202, 400), (202, 402), (400, 401), (402, 403), (500, 401), (500, 403), (400, 404), (501, 404), (501, 401)]
    shown, plain = [], solve._solve
    monkeypatch.setattr(solve, "_solve", lambda s, *rest: shown.extend(r.query for r in s.select("query").distinct().collect()) or plain(s, *rest))
    found = {r.query: r.bridge_free_size for r in solve.query_pool(spark.createDataFrame(arcs, "source long, target long"), 3).collect()}
    assert sorted(shown) == [200, 201] and set(found) == {200, 201}


def test_draws_are_counted_without_rows(spark, monkeypatch):
    """Counts of pairs equal those of the table of draws: cells of different sizes, seeds, and stretches that cut through a cell."""
    monkeypatch.setattr(statistics, "BLOCK", 16)
    monkeypatch.setattr(statistics, "PER_STRETCH", 2)
    monkeypatch.setattr(statistics, "SLOTS", 7)
    for parts in (1, 2):
        rows = [(c, i, i * 7 % 5, i * 11 % 4 - 1) for c, n in (("a", 60), ("b", 22), ("c", 2)) for i in range(n)]
        df = spark.createDataFrame(rows, "cell string, ordinal long, truth int, predicted int")
        shape = spark.createDataFrame([(c, n, n // parts, parts) for c, n in (("a", 60), ("b", 22), ("c", 2))], "cell string, n long, each long, parts int")
        times = df.join(shape, "cell").join(statistics.resamples(shape, 9, 3), ["each", "parts", "ordinal"])
        want = times.groupBy("cell", "n", "draw", "truth", "predicted").agg(F.sum("times").alias("times"))
        found = statistics.drawn_pairs(df, shape, ["cell"], 9, 3)
        assert sorted(found.collect()) == sorted(want.collect())
        plans = found._jdf.queryExecution().toString()
        assert "md5" not in plans  # no row for each slot of a draw


def test_equal_graphs_are_solved_once(spark, monkeypatch):
    """Twenty graphs of three kinds: one with another query node is another; a graph without arcs is whole; every graph has all its rows."""
    arcs = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 1), (1, 0)]
    meta = spark.createDataFrame([(4, 0.5 if s % 2 else 0.25, s, 0 if s % 5 else 3) for s in range(20)] + [(4, 0.0, 20, 0)], "n int, p double, seed int, query_node long")
    edges = spark.createDataFrame([(4, 0.5 if s % 2 else 0.25, s, u, v) for s in range(20) for u, v in arcs], "n int, p double, seed int, source long, target long")
    given, plain = [], verify._by_graph
    monkeypatch.setattr(verify, "_by_graph", lambda a, cells, *rest: given.append(cells.select(*verify.KEYS).distinct().count()) or plain(a, cells, *rest))
    checks = verify.verify(meta, edges, (3,), (0, 1))
    want = {s: 3 for s in range(21)}
    assert {r.seed: r.n for r in checks.groupBy("seed").agg(F.count("*").alias("n")).collect()} == want
    assert max(given) <= 3 and len(given) == 2
    assert checks.where("status = 'ran' AND NOT solver_value = opt_value").count() == 0
    assert {r.p for r in checks.select("p").distinct().collect()} == {0.0, 0.25, 0.5}


def test_arcs_of_members_come_as_lists(spark, monkeypatch):
    """As arc by arc: communities above and below the limit of a list, a hub, and doubled arcs."""
    monkeypatch.setattr(expand, "LISTED", 5)
    rng = random.Random(2)
    arcs = [(u, v) for u in range(25) for v in range(25) if u != v and rng.random() < 0.25] + [(0, v) for v in range(1, 25)]
    edges = spark.createDataFrame(arcs, "source long, target long")
    members = spark.createDataFrame([(q, u) for q in range(8) for u in rng.sample(range(25), 2 + 2 * q)] + [(50, 99)], "query long, node long")
    assert sorted(expand.listed_edges(edges, members).collect()) == sorted(expand.induced_edges(edges, members).collect())
    assert sorted(expand.listed_edges(edges, members, inside=False).collect()) == sorted(expand.boundary_edges(edges, members).collect())
    assert expand.member_arcs(edges, members).where("query < 2").agg(F.max(F.size("targets"))).first()[0] > 1
