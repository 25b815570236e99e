"""The pipeline's filters on tables without languages and with null or repeated ids."""

import random

import pytest

import corpus_pipeline
from quarry.llm import decontam

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng, n, prefix):
    return " ".join(f"{prefix}{rng.choice('abcdefghij')}{rng.choice('klmnopq')}{rng.randrange(300)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    item = words(rng, 30, "bench")
    base, copied = words(rng, 60, "a"), words(rng, 60, "b")
    texts = [(1, base), (1, words(rng, 60, "c")), (7, base), (7, words(rng, 60, "d")), (None, copied), (None, copied), (None, words(rng, 60, "e")),
             (None, item), (9, item), (9, words(rng, 60, "f")), (None, None), (3, "12 34")]
    return item, base, copied, [(i, t, None, "s", len(t or "")) for i, t in texts]


def test_no_language_at_all(spark, rows):
    docs = spark.createDataFrame(rows[3], DOCS)
    got = corpus_pipeline.language(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, [r for r in docs.collect() if r.text and r.text != "12 34"]))


def test_filters_go_by_row(spark, rows, tmp_path):
    item, base, copied, given = rows
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(given, DOCS)
    kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    want = [r[:2] for r in given if r[:2] not in ((7, base), (None, copied), (9, item), (None, item))] + [(None, copied), (9, item)]
    assert kept.columns == docs.columns and sorted(map(repr, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(repr, want))
    clean = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert sorted(map(repr, ((r.doc_id, r.text) for r in clean.collect()))) == sorted(repr(r[:2]) for r in given if r[1] != item)
    judged = decontam.decontaminate(spark, docs, spark.read.parquet(f"{tmp_path}/benchmark.parquet")).collect()
    assert sorted((r.doc_id or 0) for r in judged if r.contaminated) == [0, 9] and len(judged) == len(given)
