from collections import Counter

import pytest

import corpus_pipeline
from grantlens.llm import decontamination, near_dedup, quality, queries, toxicity
from tests.compare import connect, duck_rows, spark_rows
from tests.llm.helpers import frame, odd_rows
from tests.llm.test_near_threshold import lowest_linked

FOLDER = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and len(set(names)) == 5
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept[-1], FOLDER)
        assert out.columns == columns
        kept.append(spark.createDataFrame(out.collect(), docs.schema))
    texts = [{r.doc_id: r.text for r in df.collect()} for df in kept]
    scores = {r.doc_id: r.keep for r in quality.classify(docs).collect()}
    assert set(texts[1]) == {i for i, keep in scores.items() if keep}
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    toxic = {r.doc_id: r.score for r in toxicity.fit(kept[1], labels).score(kept[1]).collect()}
    assert set(texts[2]) == {i for i, score in toxic.items() if score < toxicity.THRESHOLD}
    assert set(texts[3]) == {i for i, first in lowest_linked(texts[2].items(), 80).items() if i == first}
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    leaks = {r.doc_id for r in decontamination.leaks(kept[3], benchmark).collect()}
    assert set(texts[4]) == set(texts[3]) - leaks
    last = corpus_pipeline.STAGES[-1][1](spark, kept[4], FOLDER)
    assert Counter(r.doc_id for r in last.collect()) == Counter(list(texts[4]))


def test_odd_rows_pass_every_stage(spark):
    docs = frame(spark, odd_rows())
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() > 0
        assert stage(spark, docs.limit(0), FOLDER).count() == 0


def test_near_stage_equals_operator(spark):
    docs = frame(spark, odd_rows())
    kept = near_dedup.near_duplicates(docs).members.filter("kept").count()
    assert near_dedup.deduplicate(docs).filter("doc_id IS NOT NULL").count() == kept


QUERIES = queries.queries()
SQL = queries.oracle_sql()
COLUMNS = {
    "op1_toxicity": "doc_id held_out score predicted",
    "op2_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op4_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op6_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op8_lm_scoring": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op9_byte_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op10_near_dedup": "doc_id n_shingles component_id kept",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_registered_queries(spark, name):
    df = QUERIES[name](spark, FOLDER)
    if name in COLUMNS:
        assert set(COLUMNS[name].split()) <= set(df.columns)
        assert df.count() == 200
    else:
        assert df.count() >= 0
    if name in SQL:
        assert spark_rows(df) == duck_rows(connect(FOLDER), SQL[name])
