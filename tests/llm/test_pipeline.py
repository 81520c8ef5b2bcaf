"""The pipeline's stages against plain versions, each on its own input, and rows that are hard to tell apart."""

import pytest

pytest.importorskip("corvane.llm")
pipeline = pytest.importorskip("corpus_pipeline")

from corvane.llm import decontam
from corvane.llm.queries import learn_from
from corvane.session import ship
from tests.llm import brute


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return ship(spark).read.parquet(f"{sf_dir}/documents.parquet")


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda p: (p[0] is None, p[0] or 0, p[1] or ""))


def test_stages(spark, sf_dir, docs):
    lexicon = learn_from(spark, sf_dir, docs)
    kept = pipeline.drop_toxic(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    rows = [p for p in pairs(docs) if lexicon.score(p[1]) < pipeline.TOXIC]
    assert pairs(kept) == rows and len(rows) < docs.count()
    kept = pipeline.drop_near_duplicates(spark, docs, sf_dir)
    every = pairs(docs)
    roots = brute.components([brute.shingles(t) for _, t in every])
    rows = [p for i, p in enumerate(every) if roots[i] == i]
    assert pairs(kept) == rows and kept.columns == docs.columns and len(rows) < len(every)
    kept = pipeline.drop_contaminated(spark, docs, sf_dir)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    gone = {d for d, _ in brute.find_items(every, items)}
    assert pairs(kept) == [p for p in every if p[0] not in gone] and gone


def test_run_applies_all_stages(spark, sf_dir, docs):
    left = docs
    for _, stage in pipeline.STAGES[:-1]:
        left = stage(spark, left, sf_dir)
    packed = pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in left.select("doc_id").collect()}
    size = {}
    for r in packed:
        size[r.sequence_id] = size.get(r.sequence_id, 0) + r.length
    assert max(size.values()) <= 1024


def test_rows_without_names(spark, sf_dir, docs):
    long = " ".join(f"word{i}" for i in range(40))
    item = next(t for _, t in ((r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()) if t and len(decontam.WIDTH * "x") < len(t.split()))
    rows = [(1, long), (1, long), (2, long), (None, long), (None, "quite another text of enough words to count"), (3, "one text under a shared id goes on here"), (3, "and the other text under that id is this one"), (None, f"so {item} there"), (4, item), (5, None), (6, ""), (None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _score int, _row string"
    odd = spark.createDataFrame([(d, t, "x", "y", 0, 9, "r") for d, t in rows], schema)
    kept = pipeline.drop_near_duplicates(spark, odd, sf_dir)
    assert kept.columns == odd.columns and [p for p in pairs(kept) if p[1] == long] == [(1, long)] and kept.count() == len(rows) - 4  # a benchmark passage and the same between two words are near copies too
    kept = pipeline.drop_contaminated(spark, odd, sf_dir)
    assert kept.columns == odd.columns and pairs(kept) == [p for p in pairs(odd) if item not in (p[1] or "")]
    kept = pipeline.drop_toxic(spark, odd, sf_dir)
    assert kept.columns == odd.columns and kept.count() == len(rows) and {r._score for r in kept.collect()} == {9}
    packed = pipeline.pack(spark, odd, sf_dir).collect()
    assert len(packed) == len(rows)
    for stage in (s for _, s in pipeline.STAGES):
        assert stage(spark, odd.limit(0), sf_dir).count() == 0


def test_decontamination_writes_no_copy_of_its_documents(spark, sf_dir, docs, monkeypatch):
    monkeypatch.setattr(pipeline, "numbered", None)  # rows are told by their texts
    left = pipeline.drop_contaminated(spark, docs.union(docs), sf_dir)
    once = pipeline.drop_contaminated(spark, docs, sf_dir)
    assert left.columns == docs.columns and left.count() == 2 * once.count() < 2 * docs.count()
