"""The pipeline's stages, each on what the one before it kept."""

from __future__ import annotations

import re
from collections import Counter

import pytest

import corpus_pipeline
from tidemark.llm.common import materialise


@pytest.fixture(scope="module")
def stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialise(stage(spark, out[-1], sf), name))
    return out


def test_columns_and_whole_results(stages):
    assert all(sorted(s.columns) == sorted(stages[0].columns) for s in stages[1:-1])
    assert stages[5].count() == stages[4].count() and stages[5].where("not decoded_equal").count() == 0


def test_toxic_documents_go_and_clean_ones_stay(spark, stages):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    left = stages[1].select("doc_id").join(labels, "doc_id")
    toxic, clean = labels.where("toxic = 1").count(), labels.where("toxic = 0").count()
    assert left.where("toxic = 1").count() < 0.25 * toxic and left.where("toxic = 0").count() > 0.95 * clean


def test_one_of_each_text_stays(stages):
    norm = lambda s: Counter(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in s.select("text").collect())
    before, after = norm(stages[1]), norm(stages[2])
    assert set(before) == set(after) and set(after.values()) == {1}


def test_one_of_each_near_group_stays(stages):
    from tests.llm.test_operators import _components

    texts = {r.doc_id: r.text or "" for r in stages[2].collect()}
    assert {r.doc_id for r in stages[3].collect()} == {i for i, (_, c) in _components(texts, 5, 80).items() if c == i}


def test_mixing_repeats_only_what_is_there(stages):
    kept = {r.doc_id for r in stages[3].select("doc_id").collect()}
    assert {r.doc_id for r in stages[4].select("doc_id").collect()} <= kept
