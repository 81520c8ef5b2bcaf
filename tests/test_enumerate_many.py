"""Enumeration of many small graphs at once against that of one, set by set."""

import random

import numpy as np
import pytest

from corvane.functions import kernels
from corvane.operators import verify


@pytest.mark.parametrize("n", [2, 3, 6, 8])
def test_many_equal_one(n):
    rng = random.Random(n)
    q = rng.randrange(n)
    graphs = [{(u, v) for u in range(n) for v in range(n) if u != v and rng.random() < p} for p in (0.0, 0.15, 0.3, 0.6, 1.0) for _ in range(2)]
    arcs = np.zeros((len(graphs), n, n), bool)
    for i, g in enumerate(graphs):
        for u, v in g:
            arcs[i, u, v] = True
    many = {(kind, k, kappa): found for kind, k, kappa, *found in kernels.enumerate_many(arcs, q, (3, 4), (0, 1, 2))}
    for i, g in enumerate(graphs):
        adj = kernels.adjacency(g)
        for u in range(n):
            adj.setdefault(u, set())
        for kind, k, kappa, value, s in kernels.enumerate_optima(adj, q, (3, 4), (0, 1, 2)):
            values, masks, conn = many.pop((kind, k, kappa)) if i == len(graphs) - 1 else many[kind, k, kappa]
            assert values[i] == float(value) and masks[i] == sum(1 << u for u in s)
            assert not s or conn[i] == kernels.edge_connectivity(kernels.support(adj), s, q)
    assert not many


def test_small_graphs_are_not_enumerated_one_by_one(spark, monkeypatch):
    """Nor is there a group for each of them; a larger graph and one with a stranger's arc are enumerated alone, with the same columns."""
    meta = spark.createDataFrame([(4, 0.5, 1, 3), (4, None, 2, 3), (11, 0.5, 3, 0), (4, 0.5, 4, 0)], "n int, p double, seed int, query_node long")
    arcs = [(0, 1), (1, 3), (3, 0), (3, 2)]
    edges = spark.createDataFrame([(4, 0.5, 1, *e) for e in arcs] + [(11, 0.5, 3, *e) for e in arcs] + [(4, 0.5, 4, 0, 9)], "n int, p double, seed int, source long, target long")
    best = verify.optima(meta, edges, (3,), (0, 2))
    assert "FlatMapCoGroups" not in best._jdf.queryExecution().toString()
    rows = {(r.seed, r.optimum_kind, r.k, r.kappa): r for r in best.collect()}
    assert len(rows) == 16
    for seed in (1, 3):
        assert rows[seed, "edge_density_kappa", 3, 2].opt_nodes == [0, 1, 3] and rows[seed, "edge_density_kappa", 3, 2].opt_value == 0.5 and rows[seed, "avgdeg", None, None].opt_kappa is not None
    assert rows[2, "edge_density_kappa", 3, 2].opt_value == -1 and rows[2, "edge_density_kappa", 3, 2].opt_size is None and rows[2, "avgdeg", None, None].p is None
    assert rows[4, "avgdeg", None, None].opt_nodes == [0, 9]
