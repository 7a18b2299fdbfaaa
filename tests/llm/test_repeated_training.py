"""Classifiers learn the same from rows that share a doc_id, however the rows lie."""

import hashlib

import numpy as np
import pytest

from grantlens.llm import quality, token_counts, toxicity
from grantlens.llm.batches import one_text_per_id
from tests.llm.helpers import frame

FINE = "The committee met on Tuesday and agreed that the bridge over the river {} should be repaired before winter."
POOR = "BUY NOW!!! $$$ {} click click click >>> !!! 1234 5678 @@@"
RUDE = "You are a worthless idiot number {} and everyone knows that you are stupid."


@pytest.fixture(scope="module")
def rows():
    """Ten texts to an id, of either kind."""
    return [(k % 60, ((FINE, POOR)[(k * 7 // 3) % 2] + " ").format(k) * (1 + k % 4)) for k in range(600)]


def layouts(docs):
    return [docs.repartition(n, "text") for n in (3, 5, 9)]


def test_lowest_md5_is_learnt(spark, rows):
    docs = frame(spark, [*rows, *rows[:50]]).select("doc_id", "text")
    expected = {}
    for i, text in rows:
        expected.setdefault(i, []).append((hashlib.md5(text.encode()).hexdigest(), text))
    for df in layouts(docs):
        found = one_text_per_id(df).collect()
        assert len(found) == 60
        assert {r.doc_id: r.text for r in found} == {i: min(texts)[1] for i, texts in expected.items()}


def test_quality_model_is_the_same_in_every_layout(spark, rows):
    models = [quality.fit(df) for df in layouts(frame(spark, rows))]
    assert models[0].weights is not None
    for model in models[1:]:
        assert np.isclose(model.intercept, models[0].intercept, atol=1e-6)
        assert np.allclose(model.weights, models[0].weights, atol=1e-6)


def test_toxicity_scores_are_the_same_in_every_layout(spark, rows):
    mixed = [(i, RUDE.format(k)) if i % 3 == 0 else (i, text) for k, (i, text) in enumerate(rows)]
    docs = frame(spark, mixed)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    results = []
    for df in layouts(docs):
        model = toxicity.fit(df, labels)
        assert model.trees is not None
        results.append(sorted((r.doc_id, r.score) for r in model.score(docs).collect()))
    assert results[0] == results[1] == results[2]
    assert min(s for i, s in results[0] if i % 3 == 0) > max(s for i, s in results[0] if i % 3)


def test_calibration_rows_do_not_teach_the_lexicon(spark, rows, monkeypatch):
    seen = {}
    learn = toxicity.learn_terms

    def spy(docs, n_toxic, n_clean):
        seen["ids"] = {r.doc_id for r in docs.collect()}
        seen["n"] = (n_toxic, n_clean)
        return learn(docs, n_toxic, n_clean)

    monkeypatch.setattr(toxicity, "learn_terms", spy)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    toxicity.fit(frame(spark, rows), labels)
    aside = spark.range(60).filter("pmod(xxhash64(id, 'calibration'), 4) = 0").collect()
    assert seen["ids"] == set(range(60)) - {r.id for r in aside} and aside
    assert sum(seen["n"]) == len(seen["ids"])


def test_calls_are_counted_in_bytes(monkeypatch):
    monkeypatch.setattr(token_counts, "CALL_BYTES", 10)
    assert list(token_counts._calls(["日本", "日", "abcd", "e"])) == [["日本", "日"], ["abcd", "e"]]
