"""The pipeline against its stages done by hand."""

import os
from collections import defaultdict

import numpy as np
import public_tokenizers

import pytest

import __spark_entry__ as entry
import check
import corpus_pipeline
from tests.llm.test_documents import brute_components, check_packing, library
from vicinity.llm import language, quality, simhash
from vicinity.llm.queries import ORACLES

TINY = "/root/testdata/sf0.001"


def test_pipeline_matches_brute_force(spark):
    docs = spark.read.parquet(os.path.join(TINY, "documents.parquet"))
    labels = spark.read.parquet(os.path.join(TINY, "labels.parquet"))
    model = quality.fit(docs, labels)
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    texts = [r[1].encode() for r in rows]
    x = np.fromiter(quality.size_differences(texts, model.good, model.bad), float)
    score = model.score(x, np.array([len(t) for t in texts], dtype=float))
    rows = [r for r, s in zip(rows, score) if s >= quality.THRESHOLD]

    kept = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    known = language.fit(kept)
    probs = language.document_probabilities(known, [r[1].encode() for r in rows])
    rows = [
        r[:2]
        for r, p in zip(rows, probs.max(axis=1))
        if p >= corpus_pipeline.LEAST_LANGUAGE and any(c.isalpha() for c in r[1])
    ]

    groups = defaultdict(list)
    for name, text in rows:
        groups[text].append(name)
    rows = [(max(names), text) for text, names in groups.items()]
    rows = [r for r, c in zip(rows, brute_components(rows)) if c[2] == r[0]]

    got = corpus_pipeline.run(spark, TINY).collect()
    assert 0 < len(rows) < len(texts)
    check_packing(rows, got, library(public_tokenizers.path("byte_bpe_50k.json")), 1024)


def test_stages_keep_the_columns(spark):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "language_id", "exact_dedup", "simhash_near_dedup", "best_fit_packing"]
    docs = spark.read.parquet(os.path.join(TINY, "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, TINY).columns == docs.columns


def test_near_dedup_stage_broadcasts_no_balls(spark, monkeypatch):
    class Seen(Exception):
        pass

    def watched(edges, folder):
        raise Seen(edges._jdf.queryExecution().executedPlan().toString())

    monkeypatch.setattr(simhash, "components", watched)
    docs = spark.read.parquet(os.path.join(TINY, "documents.parquet"))
    with pytest.raises(Seen) as seen:
        dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, TINY)
    lines = str(seen.value).splitlines()
    assert any("SortMergeJoin" in x for x in lines)
    assert not [x for x in lines if "BroadcastHashJoin" in x and "LeftAnti" not in x]


def test_every_operator_is_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_against_its_sql(spark, name):
    problems, count = check.compare(spark, check.connect(TINY), TINY, name)
    assert not problems and count
