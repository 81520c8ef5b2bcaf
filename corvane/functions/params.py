"""Parameters of experiments: canonical text, hashes, validation, and the grids of a sweep."""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterable
from dataclasses import dataclass

#: Names and versions that other tools write and expect.
METHODS = ("bp", "avgdeg", "bfs")
QUALITY_SCHEMA = "2"
#: The seeds of the one method that is not deterministic.
SEEDS = (42, 43, 44, 45, 46)


#: Fixed value: the entry of stored parameters that says how sets were judged.
JUDGED = "_eval"


def canonical_json(value) -> str:
    """Sorted keys, no spaces; nothing is an empty object."""
    return json.dumps(value or {}, sort_keys=True, separators=(",", ":"))


def digest(text: str) -> str:
    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()


def node_set_hash(nodes: Iterable[int]) -> str:
    return digest("\n".join(map(str, sorted(int(n) for n in nodes))))


def edge_list_hash(edges: Iterable[tuple[int, int]]) -> str:
    return digest("\n".join(f"{u},{v}" for u, v in sorted((int(u), int(v)) for u, v in edges)))


@dataclass(frozen=True)
class Evaluation:
    """What decides an evaluation's result: the solver's parameters, and how its sets are judged.

    Its stored form (``stored``), that form's hash (``key``) and the solver's question alone (``question``) come from its fields.
    """

    params: dict
    weighting: str = "distance"
    hops: int = 10
    forbidden: tuple[int, ...] = ()
    code_hash: str | None = None
    solver_config: dict | None = None

    @property
    def stored(self) -> dict:
        judged = {"weighting": self.weighting, "max_fallback_hops": self.hops, "forbidden_hash": node_set_hash(self.forbidden), "quality_schema_version": QUALITY_SCHEMA}
        given = {"code_hash": self.code_hash, "solver_config": self.solver_config}
        return {**self.params, JUDGED: judged | {k: v for k, v in given.items() if v is not None}}

    @property
    def key(self) -> str:
        return digest(json.dumps(self.stored, sort_keys=True))

    @property
    def question(self) -> str:
        """What two evaluations must share to use one solver result."""
        return canonical_json(self.params) + canonical_json(self.solver_config)


def grid(method: str, **values: Iterable) -> list[dict]:
    """All combinations of a method's parameter values, the first name varying slowest."""
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    extra = {"bfs_use_k": True} if method == "bfs" else {}
    return [dict(zip(values, xs, strict=True)) | extra for xs in itertools.product(*values.values())]


def seeds_of(method: str, seeds: Iterable[int] = SEEDS) -> list[int | None]:
    return list(seeds) if method == "bp" else [None]


@dataclass(frozen=True)
class SolveParams:
    """Arguments of one method; ``validate`` raises on what it cannot run."""

    method: str = "bp"
    k: int | None = None
    kappa: int = 0
    bfs_depth: int | None = None
    max_in_edges: int = 0
    time_limit: float | None = None
    hard_time_limit: float | None = None
    gap_tolerance: float = 0.0
    node_limit: int | None = None
    dinkelbach_iter: int | None = None

    def validate(self) -> SolveParams:
        rules = [
            (self.method in METHODS, f"unknown method: {self.method}"),
            (self.method != "bp" or (self.k is not None and self.k >= 2), "bp needs a size floor of 2 or more"),
            (self.k is None or self.k >= 1, "a size floor is at least 1"),
            (self.kappa >= 0, "a connectivity is not negative"),
            (self.kappa == 0 or self.method == "bp", "only bp takes a connectivity"),
            (self.method != "bfs" or self.bfs_depth is not None, "bfs needs a depth"),
            (self.bfs_depth is None or self.method == "bfs", "only bfs takes a depth"),
            (self.max_in_edges >= 0, "a cap on in-edges is not negative"),
            (self.time_limit is None or self.time_limit > 0, "a time limit is positive"),
            (self.hard_time_limit is None or self.hard_time_limit > 0, "a hard time limit is positive"),
            (0 <= self.gap_tolerance < 1, "a gap tolerance lies in [0, 1)"),
            (self.node_limit is None or self.node_limit > 0, "a node limit is positive"),
            (self.dinkelbach_iter is None or self.dinkelbach_iter > 0, "a limit of iterations is positive"),
        ]
        for holds, message in rules:
            if not holds:
                raise ValueError(message)
        return self

    @classmethod
    def of(cls, method: str, params: dict) -> SolveParams:
        """From a grid's entry; raises on a name that no method takes."""
        known = {k: v for k, v in params.items() if k not in ("method", "bfs_use_k", JUDGED)}
        if unknown := sorted(set(known) - set(cls.__dataclass_fields__)):
            raise ValueError(f"unknown parameters: {', '.join(unknown)}")
        if method == "bfs" and not params.get("bfs_use_k", True):
            known.pop("k", None)
        return cls(method, **known).validate()
