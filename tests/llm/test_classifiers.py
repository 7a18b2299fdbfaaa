import numpy as np
import pyarrow as pa
import pytest

from grantlens.llm import quality, toxicity
from tests.llm.helpers import PROSE, frame, odd_rows

FOLDER = "/root/testdata/sf0.1"


def auc(labels, scores):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    values, inverse, counts = np.unique(np.asarray(scores), return_inverse=True, return_counts=True)
    ranks = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    labels = np.asarray(labels)
    ones = labels.sum()
    assert len(order) == len(labels)
    return (ranks[labels == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(labels) - ones))


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{FOLDER}/labels.parquet")


def test_toxicity_on_held_out_labels(spark, documents, labels):
    fold = "crc32(cast(cast(doc_id AS string) AS binary)) % 4"
    model = toxicity.fit(documents, labels.filter(f"{fold} <> 2"))
    scored = model.score(documents)
    assert scored.count() == documents.count()
    held = scored.join(labels, "doc_id").filter(f"{fold} = 2").toPandas()
    assert auc(held.toxic, held.score) > 0.95
    flagged = held.score >= toxicity.THRESHOLD
    assert flagged[held.toxic == 1].mean() > 0.85 and flagged[held.toxic == 0].mean() < 0.01
    assert held.score.between(0, 1).all()
    odd = frame(spark, odd_rows())
    rows = model.score(odd).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r.score <= 1 for r in rows)
    kept = model.keep_clean(odd)
    assert kept.columns == odd.columns
    insult = frame(spark, [(1, "You are a stupid, pathetic loser and a worthless idiot."), (2, PROSE)])
    assert [r.doc_id for r in model.keep_clean(insult).collect()] == [2]


def test_toxicity_without_labels(spark):
    docs = frame(spark, odd_rows())
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, none)
    assert {r.score for r in model.score(docs).collect()} == {0.5}
    assert model.keep_clean(docs).count() == len(odd_rows())
    unknown = spark.createDataFrame([(1, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    assert toxicity.fit(docs, unknown).trees is None
    assert toxicity.fit(docs.limit(0), none).score(docs.limit(0)).count() == 0


def test_features_of_disguised_and_addressed_words():
    words = toxicity.lexicon([])
    texts = ["you id1ot", "YOU IDIOT!!", "idiot. " + "far " * 30 + "you", "nothing here", "", None]
    found = dict(zip(toxicity.FEATURES, toxicity.feature_batch(pa.array(texts), words), strict=True))
    assert found["given_hits"].tolist() == [0, 1, 1, 0, 0, 0]
    assert found["hidden_hits"].tolist() == [1, 0, 0, 0, 0, 0]
    assert found["addressed"].tolist() == [1, 1, 0, 0, 0, 0]
    assert found["nearness"][1] == 0.5 and 0 < found["nearness"][2] < 0.05


def test_quality_against_labels(spark, documents, labels):
    model = quality.fit(documents)
    scored = model.score(documents)
    assert scored.count() == documents.count()
    known = scored.join(labels, "doc_id").toPandas()
    assert auc(known.quality, known.score) > 0.98
    assert known.keep[known.quality == 1].mean() > 0.99 and known.keep[known.quality == 0].mean() < 0.05
    odd = frame(spark, odd_rows())
    assert len(model.score(odd).collect()) == len(odd_rows())
    assert model.filter(odd).columns == odd.columns


def test_quality_of_few_or_no_documents(spark):
    assert quality.classify(frame(spark, [])).count() == 0
    rows = quality.classify(frame(spark, odd_rows())).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r.score <= 1 for r in rows)
    same = quality.classify(frame(spark, [(i, PROSE) for i in range(5)])).collect()
    assert len({r.score for r in same}) == 1 and same[0].keep


def test_em_recovers_accuracies():
    draw = np.random.default_rng(3)
    fine = draw.random(20_000) < 0.7
    right = [0.95, 0.9, 0.8, 0.7]
    votes = np.stack([np.where(draw.random(len(fine)) < p, fine, ~fine) for p in right], axis=1)
    patterns = ["".join("-+"[int(v)] for v in row) for row in votes]
    counts = {p: patterns.count(p) for p in set(patterns)}
    model = quality.estimate(counts, labellers=4)
    assert abs(model.prior - 0.7) < 0.03
    assert np.allclose(model.chances[:, 1, 2], right, atol=0.03)
    assert np.allclose(model.chances[:, 0, 0], right, atol=0.04)
