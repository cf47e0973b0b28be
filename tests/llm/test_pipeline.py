"""Stages of the corpus pipeline on odd rows and on the smallest tables."""

from __future__ import annotations

import corpus_pipeline
from overstats.llm.catalog import ORACLE, QUERIES
from overstats.llm.store import save
from tests.llm import cases

FOLDER = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert [int(x[2:].split("_")[0]) for x in QUERIES] == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)


def test_every_document_has_a_row(spark):
    n = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    for name in ("op1_minhash_near_dedup", "op3_bpe", "op4_language_id", "op7_secret_scan", "op9_benchmark_decontamination"):
        assert QUERIES[name](spark, FOLDER).count() == n


def test_stages_take_odd_rows(spark):
    docs = cases.documents(spark)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = save(stage(spark, docs, FOLDER), name)
        if k < 4:
            assert after.columns == docs.columns
        assert 0 < after.count() <= docs.count()
        docs = after
    assert docs.where("decoded != text").count() == 0
    assert docs.where("doc_id = 305").count() == 1


def test_stages_take_an_empty_table(spark):
    docs = cases.empty(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs = save(stage(spark, docs, FOLDER), name)
        assert docs.count() == 0


def test_run_applies_all_stages(spark):
    got = corpus_pipeline.run(spark, FOLDER)
    assert {"doc_id", "text", "lang", "source", "n_chars", "ids", "n_tokens"} <= set(got.columns)
    rows = got.collect()
    assert rows and all(r.decoded == r.text and r.n_tokens == len(r.ids) for r in rows)
