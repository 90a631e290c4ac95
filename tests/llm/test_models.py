"""The trained operators: gradients, held-out accuracy and edge cases."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinity.llm import exact, language, quality, recurrent
from vicinity.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"


def test_backpropagation_matches_differences(monkeypatch):
    monkeypatch.setattr(recurrent.np, "float32", np.float64)
    rng = np.random.default_rng(0)
    w = recurrent.new_weights(3, 5)
    x, y, mask = rng.integers(0, 256, (4, 7)), rng.integers(0, 3, 4), rng.random((4, 7)) < 0.8
    _, grad = recurrent.gradients(w, x, y, mask)
    for name, g in grad.items():
        flat, g = w[name].reshape(-1), g.reshape(-1)
        for i in np.argsort(-np.abs(g))[:4]:
            keep, ends = flat[i], []
            for step in (1e-5, -1e-5):
                flat[i] = keep + step
                ends.append(recurrent.gradients(w, x, y, mask)[0])
            flat[i] = keep
            assert (ends[0] - ends[1]) / 2e-5 == pytest.approx(g[i], rel=1e-3, abs=1e-6)


def test_windows_cover_whole_texts():
    texts = [b"", b"a" * 64, b"b" * 65, b"c"]
    rows, owner, used = language.windows_of(texts)
    assert rows.shape == (4, 64) and owner.tolist() == [1, 2, 2, 3] and used.tolist() == [64, 64, 1, 1]


def test_document_probabilities_pool_every_position():
    w = recurrent.new_weights(3, 4)
    model = language.LanguageModel(["a", "b", "c"], w)
    texts = [b"some bytes " * 30, b"", b"x"]
    got = language.document_probabilities(model, texts)
    for text, row in zip(texts, got):
        total = np.zeros(3)
        for at in range(0, len(text), 64):
            part = np.frombuffer(text[at : at + 64], np.uint8)
            padded = np.zeros((1, 64), np.uint8)
            padded[0, : len(part)] = part
            probs = recurrent.probabilities(w, recurrent.states(w, padded))
            total += probs[: len(part), 0].sum(axis=0)
        assert row == pytest.approx(total / max(len(text), 1), abs=1e-5)


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = QUERIES["op1_language_id"](spark, SMALL).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 1000 and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r.lang == r.lang_pred for r in got if r.held_out]
    assert np.mean(held) > 0.96


EDGES = [(1, None, "en"), (2, "", "en"), (3, "123 !?", "en"), (None, "word", None), (4, "word", "en"), (4, "word", "en")]


def test_language_edges(table):
    docs = table("doc_id bigint, text string, lang string, letters string, score string",
                 *[(*r, "x", "y") for r in EDGES])
    model = language.fit(docs)
    got = language.identify(docs, model).collect()
    assert [r.lang_pred for r in got] == ["und", "und", "und", "en", "en", "en"]
    assert [r.score for r in got[:3]] == [0, 0, 0] and got[4] == got[5]
    assert not got[3].held_out
    kept = language.keep_known(docs, model, 0.4)
    assert kept.columns == docs.columns and kept.count() == 3
    nothing = docs.limit(0)
    assert language.identify(nothing, language.fit(nothing)).count() == 0
    assert {r.lang_pred for r in language.identify(docs, language.fit(nothing)).collect()} == {"und"}


def test_sample_is_bounded_and_covers_each_class(spark):
    rows = spark.range(20_000).select(
        F.col("id").alias("doc_id"),
        F.lit("some text of a row").alias("text"),
        F.when(F.col("id") % 100 == 0, "rare").otherwise("common").alias("kind"),
    )
    got = language.labelled_sample(rows, 150, 9, "kind").groupBy("kind").agg(
        F.count("*").alias("n"), F.sum("weight").alias("all"), F.max(F.length("text")).alias("most")
    )
    for r in got.collect():
        assert 90 < r.n < 210 and r.most == 9
        assert r["all"] == pytest.approx({"rare": 200, "common": 19_800}[r.kind], rel=0.4)


def test_language_sample_of_null_and_repeated_identifiers(spark):
    text = F.concat(F.lit("a text with number "), F.col("id"))
    def rows(n, name, said, lang):
        return spark.range(n).select(name.cast("bigint").alias("doc_id"), said.alias("text"), F.lit(lang).alias("lang"))
    docs = (
        rows(5000, F.lit(None), text, "none")
        .unionByName(rows(5000, F.lit(7), text, "one"))
        .unionByName(rows(5000, F.lit(8), F.lit("the same text"), "same"))
        .unionByName(rows(5000, F.col("id"), text, "own"))
        .unionByName(rows(20, F.col("id"), text, "few"))
    )
    got = language.language_sample(docs, 64, 12).collect()
    count = {k: sum(r.lang == k for r in got) for k in ("none", "one", "same", "own", "few")}
    assert count.pop("few") == 20 and count.pop("same") == 64
    assert all(40 <= n <= 64 for n in count.values()), count
    assert max(len(r.text) for r in got) == 12
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, language.language_sample(docs.repartition(7), 64, 12).collect()), key=str)
    assert language.fit(docs.filter("lang = 'none'")).languages == ["none"]


def test_stages_keep_columns_of_any_name(table):
    names = ["score", "of", "digest", "keep_id", "keep_digest", "_score", "_of", "_digest", "_keep_id", "a.b", "Text2"]
    ddl = "doc_id bigint, text string, lang string, " + ", ".join(f"`{n}` string" for n in names)
    docs = table(ddl, *[(k, f"some words {k % 3}", "en", *(f"{n} {k}" for n in names)) for k in range(6)])
    labels = table("doc_id bigint, quality int", *[(k, 1) for k in range(6)])
    stages = {
        "good": quality.keep_good(docs, quality.fit(docs, labels), 0.1),
        "known": language.keep_known(docs, language.fit(docs), 0.1),
        "latest": exact.keep_latest(docs),
    }
    for stage, got in stages.items():
        assert got.columns == docs.columns
        rows = got.collect()
        assert len(rows) == (3 if stage == "latest" else 6)
        assert all(r[n] == f"{n} {r.doc_id}" for r in rows for n in names)


def test_quality_of_several_labels_and_of_none(table):
    rows = [(k, ("fine words " if k % 2 else "?!? ### ") * 30 + str(k)) for k in range(60)]
    docs = table("doc_id bigint, text string", *rows)
    marks = [(k, k % 2) for k, _ in rows] + [(k, 1) for k in range(0, 60, 3)]
    models = [quality.fit(docs, table("doc_id bigint, quality int", *m)) for m in (marks, marks[::-1], marks[30:] + marks[:30])]
    lowest = quality.fit(docs, table("doc_id bigint, quality int", *[(k, k % 2) for k, _ in rows]))
    assert all(m == lowest for m in models) and lowest.good
    blank = quality.fit(docs, table("doc_id bigint, quality int"))
    with pytest.warns(UserWarning, match="no labels"):
        assert quality.keep_good(docs, blank).count() == 60
    only_bad = quality.fit(docs, table("doc_id bigint, quality int", *[(k, 0) for k, _ in rows]))
    assert quality.keep_good(docs, only_bad).count() == 0


def test_quality_of_held_out_documents(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    got = QUERIES["op9_quality_classifier"](spark, SMALL)
    assert got.count() == 1000
    rows = got.filter("held_out").join(labels, "doc_id").collect()
    assert all((r.predicted == 1) == (r.score >= quality.THRESHOLD) for r in rows)
    good = [r.score for r in rows if r.quality == 1]
    bad = [r.score for r in rows if r.quality == 0]
    better = np.mean([[g > b for b in bad] for g in good])
    assert better > 0.95
    assert np.mean([s >= quality.THRESHOLD for s in good]) > 0.95


def test_differences_are_those_of_the_segments():
    good, bad = b"clean words of a text " * 50, b"### $$$ %%% " * 90
    text = b"clean words of a text " * 200
    pair = [quality._compressor(bad), quality._compressor(good)]
    sizes = [sum(len(c.compress(text[k : k + quality.SEGMENT])) for k in range(0, len(text), quality.SEGMENT)) for c in pair]
    assert list(quality.size_differences([text, b""], good, bad)) == [(sizes[0] - sizes[1]) / len(text), 0]
    assert sizes[0] > sizes[1]


def test_curve_finds_the_share_for_short_texts():
    rng = np.random.default_rng(1)
    y = (rng.random(4000) < 0.8).astype(int)
    x = np.where(y == 1, 0.1, -0.1) + rng.normal(size=4000) * 0.08
    n = rng.integers(1, 3000, 4000).astype(float)
    model = quality.QualityModel(b"", b"", *quality.logistic(x, n, y, np.ones(4000)))
    assert model.score(np.zeros(1), np.zeros(1))[0] == pytest.approx(0.8, abs=0.03)
    assert np.mean((model.score(x, n) > 0.5) == (y == 1)) > 0.87


def test_quality_edges(table):
    rows = [(k, ("fine words " if k % 2 else "?!? ### ") * 30) for k in range(60)] + [(None, "x"), (90, None), (91, "")]
    docs = table("doc_id bigint, text string, quality string, weight string, x string", *[(*r, "a", "b", "c") for r in rows])
    labels = table("doc_id bigint, quality int, toxic int",
                   *[(k, k % 2, 0) for k in range(60)], (3, 1, 0), (None, 1, 0), (5, None, 0))
    model = quality.fit(docs, labels)
    got = {r.doc_id: r for r in quality.classify(docs, model).collect()}
    assert len(got) == 63 and not got[None].held_out
    assert got[90].score == got[91].score == pytest.approx(model.score(np.zeros(1), np.zeros(1))[0])
    assert quality.keep_good(docs, model, 0.0).columns == docs.columns
    nothing = quality.fit(docs, labels.limit(0))
    assert {round(r.score, 9) for r in quality.classify(docs, nothing).collect()} == {0.5}
    assert quality.classify(docs.limit(0), model).count() == 0


def test_quality_takes_a_repeated_identifier_once(table):
    rows = [(k, ("fine words " if k % 2 else "?!? ### ") * 30 + str(k)) for k in range(60)]
    labels = table("doc_id bigint, quality int", *[(k, k % 2) for k, _ in rows])
    once = quality.fit(table("doc_id bigint, text string", *rows), labels)
    often = quality.fit(table("doc_id bigint, text string", *rows, *[r for r in rows for _ in range(50)]), labels)
    assert (often.good, often.bad) == (once.good, once.bad) and once.good
    assert (often.slope, often.base, often.prior) == pytest.approx((once.slope, once.base, once.prior))
