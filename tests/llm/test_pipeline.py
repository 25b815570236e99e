"""The pipeline's stages on a small corpus with known cases."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm.common import Scratch

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id int, keys int, words string, score int"


def words(rng, n, prefix):
    return [f"{prefix}{rng.choice('abcdefghij')}{rng.choice('klmnopq')}{rng.randrange(300)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(6)
    folder = tmp_path_factory.mktemp("corpus")
    items = [" ".join(words(rng, 30, "bench")) for _ in range(4)]
    rows = [(i, " ".join(words(rng, rng.randrange(40, 120), "le" if i % 3 else "the")), "fr" if i % 3 else "en", "big" if i % 4 else f"s{i % 8}") for i in range(120)]
    base = rows[5][1].split()
    near = base[:-1] + ["changed"]
    rows += [(200, rows[5][1], "fr", "big"), (201, " ".join(near), "fr", "big"), (202, items[0], "en", "big"), (203, " ".join(words(rng, 10, "q")) + " " + items[1], "en", "s1"),
             (204, "12 34 !!", "en", "big"), (205, None, None, None), (206, "", "en", "big")]
    spark.createDataFrame([(*r, len(r[1] or ""), 1, 2, "x", 3) for r in rows], DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows


def test_stages(spark, corpus):
    folder, rows = corpus
    scratch, docs, ids = Scratch(spark, "t"), spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.keep(stage(spark, docs, folder), name)
        if name != "token_output":
            assert docs.columns == columns
            ids[name] = [r.doc_id for r in docs.select("doc_id").collect()]
    every = {r[0] for r in rows}
    assert sorted(ids["language"]) == sorted(every - {204, 205, 206})
    assert sorted(ids["near_duplicates"]) == sorted(set(ids["language"]) - {200, 201})
    assert sorted(ids["decontamination"]) == sorted(set(ids["near_duplicates"]) - {202, 203})
    assert set(ids["mixing"]) <= set(ids["decontamination"])
    assert docs.agg(F.sum(F.size("spans"))).first()[0] if "spans" in docs.columns else docs.count() > 0
    assert sorted(r.slot for r in docs.collect()) == list(range(docs.count()))


def test_run_and_empty(spark, corpus, tmp_path):
    folder, _ = corpus
    assert corpus_pipeline.run(spark, folder).count() > 0
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "mixing", "token_output"]
    assert corpus_pipeline.ORACLE_SQL is None
