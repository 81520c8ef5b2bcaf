"""The n-gram join on families of near copies at every distance, where answers are derived from pivots."""

import random

import pytest

pytest.importorskip("corvane.llm")

from corvane.llm import ngram_join
from corvane.session import ship
from tests.llm import brute


def family(rng, words, copies, most):
    """Texts from one base: some words replaced from a small pool, stretches left out, tails added."""
    out, pool = [" ".join(words)], [f"e{i}" for i in range(3)]
    for _ in range(copies):
        w = list(words)
        for _ in range(rng.randint(0, most)):
            kind, at = rng.random(), rng.randrange(len(w))
            if kind < 0.4:
                w[at] = rng.choice(pool)
            elif kind < 0.8 and len(w) > 20:
                del w[at : at + rng.randint(1, 12)]
            else:
                w += [f"t{j}" for j in range(rng.randint(1, 10))]
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_components_of_families(spark, seed):
    ship(spark)
    rng = random.Random(seed)
    texts = []
    for base in range(4):
        words = [f"b{base}x{i}" for i in range(60)]
        texts += family(rng, words, 30, 8)
        texts += family(rng, words[:45] + [f"c{base}y{i}" for i in range(15)], 15, 4)
    rng.shuffle(texts)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [brute.shingles(t) for t in texts]
    assert found == {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, brute.components(sets), strict=True))}


def test_families_apart_are_joined_by_members(spark):
    """Pivots too far apart to link, with one member between them that links both, and members that do not."""
    ship(spark)
    words = [f"w{i}" for i in range(84)]
    near = [words[k:] for k in range(0, 9)]  # what is left out grows by a shingle each
    far = [words[k:] for k in range(18, 34)]
    other = [words[:40] + [f"o{i}" for i in range(44)]]
    texts = [" ".join(w) for w in near * 1 + far + other]
    sets = [brute.shingles(t) for t in texts]
    found = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert found == dict(enumerate(brute.components(sets)))
