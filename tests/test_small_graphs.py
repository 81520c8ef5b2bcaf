"""Small graphs searched as bit masks, and solved in batches."""

import random

from corvane.functions import branching as B
from corvane.functions import kernels as K
from corvane.operators import verify


def test_masks_find_what_enumeration_finds(monkeypatch):
    monkeypatch.setattr(B, "_Search", None)  # small graphs need no tables of their own
    rng = random.Random(3)
    for n in (1, 2, 4, 7, 8):
        for p in (0.15, 0.3, 0.6):
            adj, shared = {u: {v for v in range(n) if v != u and rng.random() < p} for u in range(n)}, {}
            q, und = rng.randrange(n), K.support(adj)
            if n > 1:
                assert K.avgdeg_anchored(adj, q)[0] == K.brute_force_avgdeg(adj, q)
            for k in (3, 5):
                for kappa in (0, 1, 2):
                    got, want = B.densest(adj, q, k, kappa, shared=shared), K.brute_force(adj, q, k, kappa)
                    assert got["density"] == (want[0] if want else 0) and (got["gap_status"], got["gap"], got["open"]) == ("exhausted", 0, 0)
                    if got["nodes"]:
                        s = set(got["nodes"])
                        assert q in s and len(s) >= k and B.density(adj, s) == got["density"] and K.kappa_verify(und, s, q, kappa)
    cut = B.densest({u: {v for v in range(8) if v != u and (u * v) % 3} for u in range(8)}, 0, 3, 0, B.Limits(nodes=0))
    assert cut["gap_status"] == "node_limit" and cut["bound"] >= float(cut["density"]) and cut["open"] == 1


def test_graphs_are_solved_in_batches(spark):
    rng = random.Random(4)
    rows = [(6, 0.5, g, u, v) for g in range(4) for u in range(6) for v in range(6) if u != v and rng.random() < 0.5]
    edges = spark.createDataFrame(rows, "n int, p double, seed int, source long, target long")
    meta = spark.createDataFrame([(6, 0.5, g, g) for g in range(5)], "n int, p double, seed int, query_node long")  # the last has no arcs
    cells = verify.solver_cells(meta, verify.optima(meta, edges))
    runs = verify.solver_runs(cells, edges)
    assert "CoGroups" not in runs._jdf.queryExecution().toString()
    found = {(r.seed, r.method, r.k, r.kappa): r for r in runs.collect()}
    assert len(found) == 50
    for r in cells.collect():
        run = found[r.seed, r.method, r.k, r.kappa]
        if r.opt_value is not None and r.opt_value >= 0:
            assert abs(run.solver_value - r.opt_value) < 1e-12 and run.kappa_verified and run.solver_size == len(run.solver_nodes)
        else:
            assert run.solver_nodes == [] and run.solver_actual_kappa is None
