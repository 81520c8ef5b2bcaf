"""Numeric kernels on one small graph each; whole numbers and fractions wherever an answer is exact.

A graph is a set of nodes and a dict of ordered arcs ``adj[u] = {v, ...}`` without self-loops.
"""

from __future__ import annotations

import itertools
import math
from collections import deque
from fractions import Fraction
from functools import lru_cache

import numpy as np

Adj = dict[int, set[int]]


def adjacency(arcs) -> Adj:
    adj: Adj = {}
    for u, v in arcs:
        adj.setdefault(u, set())
        adj.setdefault(v, set())
        if u != v:
            adj[u].add(v)
    return adj


def support(adj: Adj) -> Adj:
    und: Adj = {u: set(vs) for u, vs in adj.items()}
    for u, vs in adj.items():
        for v in vs:
            und[v].add(u)
    return und


def arcs_inside(adj: Adj, s: set[int]) -> int:
    return sum(len(adj.get(u, set()) & s) for u in s)


def max_flow(und: Adj, s: set[int], a: int, b: int, limit: int = 1 << 30) -> tuple[int, set[int]]:
    """Edge-disjoint paths from a to b within s (up to ``limit``), and the nodes still reached from a."""
    flow: dict[tuple[int, int], int] = {}
    total = 0
    while True:
        seen, queue = {a: a}, deque([a])
        while queue and b not in seen:
            u = queue.popleft()
            for v in und[u] & s:
                if v not in seen and flow.get((u, v), 0) < 1:
                    seen[v] = u
                    queue.append(v)
        if b not in seen or total >= limit:
            return total, set(seen)
        v = b
        while v != a:
            u = seen[v]
            flow[u, v] = flow.get((u, v), 0) + 1
            flow[v, u] = flow.get((v, u), 0) - 1
            v = u
        total += 1


def edge_connectivity(und: Adj, s: set[int], root: int) -> int:
    """Smallest number of edge-disjoint paths from ``root`` to another member."""
    return min((max_flow(und, s, root, t)[0] for t in s if t != root), default=0)


def kappa_verify(und: Adj, s: set[int], root: int, kappa: int) -> bool:
    if kappa <= 0:
        return True
    return len(s) >= 2 and root in s and all(max_flow(und, s, root, t, kappa)[0] >= kappa for t in s if t != root)


def components_inside(und: Adj, s: set[int]) -> list[set[int]]:
    left, out = set(s), []
    while left:
        part, queue = set(), [next(iter(left))]
        while queue:
            u = queue.pop()
            if u not in part:
                part.add(u)
                queue.extend((und[u] & s) - part)
        out.append(part)
        left -= part
    return out


def global_min_cut(und: Adj, s: set[int]) -> tuple[int, set[int]]:
    """Weight and one side of a minimum cut, by maximum-adjacency orders."""
    if len(s) < 2:
        return 0, set()
    groups = {u: {u} for u in s}
    w = {u: {v: 1 for v in und[u] & s} for u in s}
    best, side = math.inf, set()
    while len(w) > 1:
        order, weight, rest = [], dict.fromkeys(w, 0), set(w)
        while rest:
            u = max(rest, key=lambda x: (weight[x], -min(groups[x])))
            rest.discard(u)
            order.append((u, weight[u]))
            for v, c in w[u].items():
                if v in rest:
                    weight[v] += c
        (t, cut), prev = order[-1], order[-2][0]
        if cut < best:
            best, side = cut, set(groups[t])
        for v, c in w.pop(t).items():
            w[v].pop(t, None)
            if v != prev:
                w[prev][v] = w[prev].get(v, 0) + c
                w[v][prev] = w[v].get(prev, 0) + c
        groups[prev] |= groups.pop(t)
    return int(best), side


def internal_ncut(und: Adj, s: set[int]) -> float:
    """Normalised minimum cut of the community: cut (va + vb) / (va vb); 0 below two nodes or without edges."""
    cut, side = global_min_cut(und, s)
    va, vb = (sum(len(und[u] & s) for u in part) for part in (side, s - side))
    return cut * (va + vb) / (va * vb) if va and vb else 0.0


def algebraic_connectivity(und: Adj, s: set[int]) -> float:
    """Second eigenvalue of the normalised Laplacian; 0 below two nodes or with an isolated one."""
    ids = sorted(s)
    a = np.array([[float(v in und[u]) for v in ids] for u in ids])
    d = a.sum(axis=1) if len(ids) else np.zeros(0)
    if len(ids) < 2 or (d == 0).any():
        return 0.0
    scale = 1 / np.sqrt(d)
    return float(max(0.0, np.linalg.eigvalsh(np.eye(len(ids)) - a * scale[:, None] * scale)[1]))


def bridge_free_component(und: Adj, root: int) -> set[int]:
    """Nodes joined to ``root`` without crossing a bridge; depth first, without recursion."""
    order, low, parent, bridges = {root: 0}, {root: 0}, {root: None}, set()
    stack = [(root, iter(sorted(und[root])))]
    while stack:
        u, it = stack[-1]
        for v in it:
            if v not in order:
                order[v] = low[v] = len(order)
                parent[v] = u
                stack.append((v, iter(sorted(und[v]))))
                break
            if v != parent[u]:
                low[u] = min(low[u], order[v])
        else:
            stack.pop()
            if stack:
                p = stack[-1][0]
                low[p] = min(low[p], low[u])
                if low[u] > order[p]:
                    bridges |= {(p, u), (u, p)}
    part, queue = set(), [root]
    while queue:
        u = queue.pop()
        if u not in part:
            part.add(u)
            queue.extend(v for v in und[u] if (u, v) not in bridges)
    return part


def grow_to_k(ask, s: list[int], k: int, seen: dict[int, set[int]] | None = None, asked: set[int] | None = None, ordinal: dict[int, int] | None = None) -> set[int]:
    """Add the known neighbour with most known links into ``s`` until it has k nodes; ties go to the node mentioned first.

    ``ask(u)`` gives u's predecessors and successors in file order. A node that joins is asked, and what it mentions
    becomes a candidate. Without candidates a member not asked yet is; without such, growth ends.
    """
    members, links = list(s), {u: set(vs) for u, vs in (seen or {}).items()}
    asked = set(asked or ())
    ordinal = dict(ordinal) if ordinal is not None else {u: i for i, u in enumerate(dict.fromkeys([*s, *(v for u in links for v in (u, *sorted(links[u])))]))}

    def learn(u: int) -> None:
        asked.add(u)
        links.setdefault(u, set())
        for v in ask(u):
            ordinal.setdefault(v, len(ordinal))
            if v != u:
                links[u].add(v)
                links.setdefault(v, set()).add(u)

    inside = set(members)
    while len(inside) < k:
        near = {v for u in inside for v in links.get(u, ())} - inside
        if near:
            v = max(near, key=lambda x: (len(links[x] & inside), -ordinal[x]))
            inside.add(v)
            members.append(v)
        else:
            v = next((u for u in members if u not in asked), None)
            if v is None:
                break
        if v not in asked:
            learn(v)
    return inside


def brute_force(adj: Adj, q: int, k: int, kappa: int = 0) -> tuple[Fraction, set[int]] | None:
    """Best pair density of any set with q and at least k nodes, by enumeration; None if no set qualifies."""
    others, und, best = sorted(set(adj) - {q}), support(adj), None
    for r in range(max(k, 2) - 1, len(others) + 1):
        for c in itertools.combinations(others, r):
            s = {q, *c}
            value = Fraction(arcs_inside(adj, s), len(s) * (len(s) - 1))
            if (best is None or value > best[0]) and kappa_verify(und, s, q, kappa):
                best = value, s
    return best


def brute_force_avgdeg(adj: Adj, q: int) -> Fraction:
    others = sorted(set(adj) - {q})
    return max(Fraction(arcs_inside(adj, s := {q, *c}), len(s)) for r in range(len(others) + 1) for c in itertools.combinations(others, r))


def enumerate_optima(adj: Adj, q: int, ks, kappas):
    """``kind, floor, connectivity, value, set`` of each optimum over all sets with q and two nodes or more; -1 and no set where none is feasible."""
    und, others = support(adj), sorted(set(adj) - {q})
    cells = {("edge_density_kappa", k, kappa): (Fraction(-1), set()) for k in sorted(ks) for kappa in sorted({0, *kappas})}
    cells |= {("avgdeg", None, None): (Fraction(-1), set()), ("avgdeg_connected", None, None): (Fraction(-1), set())}
    for r in range(1, len(others) + 1):
        for c in itertools.combinations(others, r):
            s = {q, *c}
            arcs, paths = arcs_inside(adj, s), None
            for (kind, k, kappa), (best, _) in cells.items():
                value = Fraction(arcs, len(s)) if k is None else Fraction(arcs, len(s) * (len(s) - 1))
                if value <= best or (k or 0) > len(s):
                    continue
                if kind == "avgdeg_connected" or kappa:
                    paths = edge_connectivity(und, s, q) if paths is None else paths
                    if paths < (kappa or 1):
                        continue
                cells[kind, k, kappa] = value, s
    for (kind, k, kappa), (value, s) in cells.items():
        yield kind, k, kappa, value, s


@lru_cache(maxsize=None)
def _set_tables(m: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Sets of ``m`` nodes as bit masks in the order of ``enumerate_optima``, their sizes with the query node, and each set's proper subsets."""
    masks = [sum(1 << i for i in c) for r in range(1, m + 1) for c in itertools.combinations(range(m), r)]
    every = np.arange(1 << m)
    return np.array(masks, "i8"), np.array([x.bit_count() + 1 for x in masks], "i8"), [(x, every[(every & x == every) & (every < x)]) for x in masks]


def _inside(w: np.ndarray) -> np.ndarray:
    """For graphs of symmetric weights ``w[graph, u, v]``: the weight inside every set of nodes, by its bit mask."""
    total = np.zeros((len(w), 1), "i2")
    for h in range(w.shape[1]):
        to = np.zeros((len(w), 1), "i2")
        for j in range(h):
            to = np.concatenate([to, to + w[:, h, j, None]], 1)
        total = np.concatenate([total, total + to], 1)
    return total


def enumerate_many(arcs: np.ndarray, q: int, ks, kappas):
    """As ``enumerate_optima`` of many graphs at once, ``arcs[graph, u, v]`` (boolean, without self-loops) on the same few nodes.

    ``kind, floor, connectivity, values, masks, connectivities``: masks have a bit for each node, 0 where no set is feasible. All sets and
    all their parts are tried: a set's connectivity is the least number of links between a part with q and the rest.
    """
    n = arcs.shape[1]
    at = [u for u in range(n) if u != q] + [q]  # q has the top bit
    d = arcs[:, at][:, :, at].astype("i2")
    masks, size, parts = _set_tables(n - 1)
    top = 1 << (n - 1)
    inner, links = _inside(d + d.transpose(0, 2, 1)), _inside(d | d.transpose(0, 2, 1))
    conn = np.stack([(links[:, x + top, None] - links[:, t + top] - links[:, x - t]).min(1) for x, t in parts], 1)
    inner = inner[:, masks + top].astype("f8")
    # The sets' bits by the nodes' own numbers.
    named = (masks & ((1 << q) - 1)) | (masks >> q << (q + 1)) | (1 << q)
    # Equal fractions are equal doubles, and the first of equal sets counts.
    by_pair, by_node, row = inner / (size * (size - 1)), inner / size, np.arange(len(arcs))
    cells = [("edge_density_kappa", k, kappa, by_pair, (size >= k) & (conn >= kappa)) for k in sorted(ks) for kappa in sorted({0, *kappas})]
    cells += [("avgdeg", None, None, by_node, conn >= 0), ("avgdeg_connected", None, None, by_node, conn >= 1)]
    for kind, k, kappa, value, able in cells:
        value = np.where(able, value, -1.0)
        best = value.argmax(1)
        found = value[row, best] >= 0
        yield kind, k, kappa, value[row, best], np.where(found, named[best], 0), conn[row, best]


def _peel(und: Adj, pool: set[int], q: int, kappa: int) -> set[int]:
    """Without nodes of fewer than kappa links; for kappa above 1, only q's bridge-free component."""
    pool = set(pool)
    if kappa >= 1 and q in pool:
        pool = next(c for c in components_inside(und, pool) if q in c)
    if kappa >= 2 and q in pool:
        pool = bridge_free_component({u: und[u] & pool for u in pool}, q)
    while low := {u for u in pool if len(und[u] & pool) < kappa}:
        pool -= low
    return pool


def avgdeg_anchored(adj: Adj, q: int) -> tuple[Fraction, set[int]]:
    """Largest arcs per node of any set with q, by Newton steps on exact fractions, each a minimum cut."""
    s = set(adj)
    value = Fraction(arcs_inside(adj, s), len(s))
    while True:
        better = _best_closure(adj, q, value)
        found = Fraction(arcs_inside(adj, better), len(better))
        if found <= value:
            return value, s
        value, s = found, better


def _best_closure(adj: Adj, q: int, lam: Fraction) -> set[int]:
    """Smallest set with q of largest arcs - lam * nodes, by a minimum cut.

    Twice a set's arcs are its nodes' degrees less the arcs that leave it, so nodes are all that the network needs.
    """
    p, d = lam.numerator, lam.denominator
    cap: dict = {u: {} for u in adj} | {"s": {}, "t": {}}
    for u, vs in adj.items():
        for v in vs:
            cap[u][v] = cap[u].get(v, 0) + d
            cap[v][u] = cap[v].get(u, 0) + d
    for u in adj:
        worth = sum(cap[u].values()) - 2 * p
        a, b = ("s", u) if worth > 0 or u == q else (u, "t")
        cap[a][b], cap[b][a] = (1 << 60) if u == q else abs(worth), 0
    while True:  # shortest augmenting paths
        seen, queue = {"s": None}, deque(["s"])
        while queue and "t" not in seen:
            a = queue.popleft()
            for b, c in cap[a].items():
                if c > 0 and b not in seen:
                    seen[b] = a
                    queue.append(b)
        if "t" not in seen:
            return {x for x in seen if x != "s"} | {q}
        path, b = [], "t"
        while seen[b] is not None:
            path.append((seen[b], b))
            b = seen[b]
        step = min(cap[a][b] for a, b in path)
        for a, b in path:
            cap[a][b] -= step
            cap[b][a] += step


def macro_scores(truth: np.ndarray, predicted: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
    """Macro precision, recall and F1 over the labels seen, for each row of indices (or once)."""
    rows = np.arange(len(truth))[None, :] if rows is None else rows
    t, p = truth[rows], predicted[rows]
    labels = np.union1d(truth, predicted)
    scores, present = np.zeros((3, len(rows), len(labels))), np.zeros((len(rows), len(labels)), bool)
    for i, label in enumerate(labels):
        tp, nt, np_ = ((t == label) & (p == label)).sum(1), (t == label).sum(1), (p == label).sum(1)
        present[:, i] = nt + np_ > 0
        for j, (a, b) in enumerate(((tp, np_), (tp, nt), (2 * tp, nt + np_))):
            scores[j, :, i] = np.divide(a, b, out=np.zeros(len(rows)), where=b > 0)
    return (scores * present).sum(2) / np.maximum(present.sum(1), 1)


def fixed_label_scores(truth: np.ndarray, predicted: np.ndarray, rows: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """Macro precision, recall, F1 and accuracy for each row of indices, over ``labels`` (those of the whole sample), 0 for a label not drawn."""
    labels = np.union1d(truth, predicted) if labels is None else labels
    t, p = np.searchsorted(labels, truth), np.searchsorted(labels, predicted)
    n, k = rows.shape[0], len(labels)
    place = np.arange(n)[:, None] * k
    count = lambda x, where=None: np.bincount((place + x[rows]).ravel(), None if where is None else where[rows].ravel(), n * k).reshape(n, k)
    hit = (t == p).astype(float)
    tp, nt, np_ = count(t, hit), count(t), count(p)
    share = lambda a, b: np.divide(a, b, out=np.zeros((n, k)), where=b > 0).mean(1)
    return np.stack([share(tp, np_), share(tp, nt), share(2 * tp, nt + np_), hit[rows].mean(1)])


def bootstrap_scores(truth: np.ndarray, predicted: np.ndarray, draws: int = 1000, seed: int = 0) -> list[tuple[float, float, float]]:
    """Precision, recall, F1 and accuracy: value, 2.5 and 97.5 percentile over resamples."""
    value = fixed_label_scores(truth, predicted, np.arange(len(truth))[None, :])[:, 0]
    drawn = fixed_label_scores(truth, predicted, resample_indices(len(truth), draws, seed))
    lo, hi = np.percentile(drawn, [2.5, 97.5], axis=1)
    return [(float(v), float(a), float(b)) for v, a, b in zip(value, lo, hi, strict=True)]


def resample_indices(n: int, draws: int, seed: int, parts: int = 1) -> np.ndarray:
    """Rows drawn with replacement, ``draws`` times; within each of ``parts`` equal stretches of rows."""
    rng, each = np.random.default_rng(seed), n // parts
    if each * parts != n:
        raise ValueError("seeds have different numbers of rows")
    return np.concatenate([rng.integers(s * each, (s + 1) * each, (draws, each)) for s in range(parts)], axis=1)


def wilson(p: float, n: int, z: float = 1.959963984540054) -> tuple[float, float]:
    z2, p = z * z, min(1.0, max(0.0, p))
    centre, half = (p + z2 / (2 * n)) / (1 + z2 / n), z * math.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return max(0.0, centre - half), min(1.0, centre + half)


def score_intervals(truth: np.ndarray, predicted: np.ndarray, rows: np.ndarray) -> list[tuple[float, float]]:
    """Intervals of precision, recall and F1 over given resamples; Wilson's where a score never varies."""
    out = []
    for drawn in fixed_label_scores(truth, predicted, rows)[:3]:
        lo, hi = np.percentile(drawn, [2.5, 97.5])
        out.append(wilson(float(drawn[0]), len(truth)) if lo == hi else (float(lo), float(hi)))
    return out


def tie_table(truth: np.ndarray, cells: dict[str, np.ndarray], floor: dict[str, int], draws: int = 1000, seed: int = 42) -> list[list]:
    """Rows ``cell, floor, queries, metric, value, std, best of its floor, best of all, tied with them, intervals of the differences``."""
    labels = np.unique(np.concatenate([truth, *cells.values()]))
    rows, once = resample_indices(len(truth), draws, seed), np.arange(len(truth))[None, :]
    value = {c: fixed_label_scores(truth, p, once, labels)[:, 0] for c, p in cells.items()}
    drawn = {c: fixed_label_scores(truth, p, rows, labels) for c, p in cells.items()}
    out = []
    for i, metric in enumerate(("precision", "recall", "f1")):
        best_of = lambda cs: min(cs, key=lambda c: (-value[c][i], c))  # noqa: B023, E731
        of_floor = {k: best_of([c for c in cells if floor[c] == k]) for k in set(floor[c] for c in cells)}
        of_all = best_of(cells)
        for c in sorted(cells):
            spans = []
            for best in (of_floor[floor[c]], of_all):
                lo, hi = (0.0, 0.0) if best == c else np.percentile(drawn[best][i] - drawn[c][i], [2.5, 97.5])
                spans.append((float(lo), float(hi)))
            tied = [lo <= 0 <= hi for lo, hi in spans]
            std = float(drawn[c][i].std(ddof=1)) if draws > 1 else 0.0
            out.append([c, int(floor[c]), len(truth), metric, float(value[c][i]), std, of_floor[floor[c]] == c, of_all == c, *tied, *spans[0], *spans[1]])
    return out


def signed_rank_p(paired: int, n: int, plus: float, ties: float, untied: bool) -> float | None:
    """Two-sided p of a signed-rank test: of ``paired`` values ``n`` are not zero, those above it have the rank sum ``plus``, and ``ties`` is the sum of t^3 - t.

    Exact below 51 untied values, else normal.
    """
    if paired < 2:
        return None
    if not n:
        return 1.0
    if n <= 50 and untied:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[:-r].copy()
        low = int(min(plus, n * (n + 1) / 2 - plus))
        return float(min(1.0, 2 * ways[: low + 1].sum() / ways.sum()))
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return float(math.erfc(abs(plus - mean) / math.sqrt(var) / math.sqrt(2)))


def wilcoxon_p(deltas) -> float | None:
    """The same from the values themselves; zeros are dropped."""
    d = np.asarray([x for x in deltas if x is not None and not math.isnan(x)], float)
    paired, d = len(d), d[d != 0]
    size = np.abs(d)
    order = np.sort(size)
    rank = (np.searchsorted(order, size, "left") + np.searchsorted(order, size, "right") + 1) / 2
    ties = np.unique(size, return_counts=True)[1]
    return signed_rank_p(paired, len(d), rank[d > 0].sum(), float((ties**3 - ties).sum()), bool((ties == 1).all()))
