"""Toxicity: gradient-boosted trees over dense text features, calibrated by isotonic regression.

Features: densities of a given and a learned lexicon, hits close to second-person words, capitals,
punctuation, and hits that appear only after undoing obfuscation. They are counted in numpy over
whole texts. Trees and calibration are Spark ML models, fitted on a bounded sample of labelled rows.

Rows: every document once per input row. Null or empty text scores like any text without hits.
Several labels of one document count as toxic if one does; null labels and null ids are no labels.
Of several texts of one doc_id the model learns the one with the lowest MD5; of near copies the learned
lexicon counts the one with the lowest doc_id.
Without labels of both kinds every score is the smoothed share of toxic labels. Columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from grantlens.llm import text_stats
from grantlens.llm.batches import id_and_text, map_slices, mix, one_text_per_id, shingle_sets
from grantlens.llm.text_stats import Texts, lowered, rate
from grantlens.workspace import Workspace

# Labelled rows that the models are fitted on, at most: those with the smallest hash of their id.
TRAIN_ROWS = 20_000

# A document counts as toxic from this score on.
THRESHOLD = 0.3

# Learned terms: words and word beginnings in at least this share of the toxic training texts,
# this many times likelier there than elsewhere; the strongest ones, at most MAX_TERMS.
TERM_SHARE = 0.015
TERM_RATIO = 12.0
MAX_TERMS = 400
BEGINNINGS = (4, 5, 6)

INSULTS = (
    "bastard", "bitch", "clown", "creep", "crap", "cretin", "cunt", "damn", "degenerate", "dimwit",
    "disgusting", "dumb", "dumbass", "fool", "freak", "fuck", "fucking", "garbage", "hate", "idiot",
    "idiotic", "imbecile", "jerk", "kill", "liar", "loser", "losers", "moron", "moronic", "nasty",
    "pathetic", "pig", "rat", "scum", "shit", "shut", "slut", "stupid", "sucks", "trash", "ugly",
    "useless", "vermin", "whore", "worthless", "idioten", "dumm", "arschloch", "abschaum",
    "connard", "salaud", "ordure", "imbécile", "estúpido", "basura", "inútil",
)

SECOND_PERSON = (
    "you", "your", "yours", "yourself", "u", "ur", "youre", "du", "dich", "dir", "dein", "ihr", "euch",
    "tu", "te", "toi", "ton", "vous", "votre", "usted", "tus", "ti", "vosotros",
)

# Characters that stand in for letters in disguised words.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}

# Words within this distance of a second-person word count as addressed.
NEAR_WORDS = 6

FEATURES = (
    "log_words", "given_hits", "given_density", "learned_hits", "learned_density", "learned_kinds",
    "hidden_hits", "hidden_density", "addressed", "nearness", "capitals", "capital_words",
    "shouting", "punctuation", "digits", "mixed_words",
)

_LETTERS = text_stats._LETTER
_UNDO = np.arange(256, dtype=np.uint8)
for _sign, _letter in STAND_INS.items():
    _UNDO[ord(_sign)] = ord(_letter)
_FILLER = np.isin(np.arange(256), [ord(c) for c in "*.-_+~'`,;:?\"()#"])


@dataclass(frozen=True)
class Lexicon:
    """Hashes of terms: whole words, and beginnings by their number of bytes."""

    given: np.ndarray
    person: np.ndarray
    learned: np.ndarray


def lexicon(learned: list[int], given=INSULTS, person=SECOND_PERSON) -> Lexicon:
    def table(words):
        return np.sort(np.array([text_stats.word_hash(word) for word in words], dtype=np.uint64))

    return Lexicon(table(given), table(person), np.sort(np.array(learned, dtype=np.int64).view(np.uint64)))


def _term_hashes(texts: Texts, plain: np.ndarray) -> list[np.ndarray]:
    """Per word: the hash of the word (letters only) and of each of its beginnings, salted by length."""
    letters = _LETTERS[plain]
    terms = [texts.hashes(plain, letters)]
    place = np.concatenate([[0], np.cumsum(letters, dtype=np.int64)])
    # How many letters of its word each byte ends.
    begins = np.zeros(len(plain), dtype=np.int64)
    begins[texts.begin] = 1
    nth = place[1:] - np.concatenate([[0], place[texts.begin]])[np.cumsum(begins)]
    size = place[texts.end] - place[texts.begin]
    for length in BEGINNINGS:
        hashes = texts.hashes(plain, letters & (nth <= length))
        terms.append(np.where(size >= length, mix(hashes + np.uint64(length)), np.uint64(0)))
    return terms


def _isin(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values


def feature_batch(column: pa.Array, words: Lexicon) -> list[np.ndarray]:
    """The features of each text, in the order of ``FEATURES``."""
    texts = Texts(column)
    plain = lowered(texts.data)
    terms = _term_hashes(texts, plain)
    given = _isin(terms[0], words.given)
    learned = np.zeros(len(given), dtype=bool)
    hits_row, hits_term = [], []
    for hashes in terms:
        hit = _isin(hashes, words.learned)
        learned |= hit
        hits_row.append(texts.row[hit])
        hits_term.append(hashes[hit])
    kinds = np.unique(np.stack([np.concatenate(hits_row).astype(np.uint64), np.concatenate(hits_term)]), axis=1)
    undone = _UNDO[plain]
    changed = texts.words_with(~text_stats._LETTER) > 0
    filler = _FILLER[plain]
    if len(texts.end):
        filler[texts.end - 1] |= plain[texts.end - 1] == ord("!")
    hidden = changed & ~given & _isin(texts.hashes(undone, ~filler), words.given)
    hit = given | learned | hidden
    person = np.flatnonzero(_isin(terms[0], words.person))
    distance = np.full(len(hit), np.inf)
    if len(person):
        at = np.flatnonzero(hit)
        for side in (np.searchsorted(person, at) - 1, np.searchsorted(person, at)):
            near = person[np.clip(side, 0, len(person) - 1)]
            same = texts.row[near] == texts.row[at]
            distance[at] = np.minimum(distance[at], np.where(same, np.abs(near - at), np.inf))
    nearness = np.zeros(texts.n_rows)
    np.maximum.at(nearness, texts.row, 1.0 / (1.0 + distance))
    n_words, n_bytes = texts.n_words, texts.n_bytes
    letters = texts.bytes_of(_LETTERS)
    word_letters, word_caps = texts.words_with(_LETTERS), texts.words_with(text_stats._UPPER)
    word_marks = texts.words_with(text_stats._DIGIT | text_stats._SYMBOL)
    columns = [
        np.log1p(n_words),
        texts.per_row(given),
        rate(texts.per_row(given), n_words),
        texts.per_row(learned),
        rate(texts.per_row(learned), n_words),
        np.bincount(kinds[0].astype(np.int64), minlength=texts.n_rows).astype(float),
        texts.per_row(hidden),
        rate(texts.per_row(hidden), n_words),
        texts.per_row(distance <= NEAR_WORDS),
        nearness,
        rate(texts.bytes_of(text_stats._UPPER), letters),
        rate(texts.per_row((word_caps > 1) & (word_caps == word_letters)), n_words),
        rate(texts.bytes_of(text_stats._SHOUT), n_bytes),
        rate(texts.bytes_of(text_stats._STOP), n_bytes),
        rate(texts.bytes_of(text_stats._DIGIT), n_bytes),
        rate(texts.per_row((word_letters > 0) & (word_marks > 0)), n_words),
    ]
    return [np.asarray(c, dtype=np.float64) for c in columns]


def features(docs: DataFrame, words: Lexicon) -> DataFrame:
    """doc_id and the dense features of every document."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = [pa.array(c) for c in feature_batch(batch.column("text"), words)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *FEATURES])

    schema = "doc_id long, " + ", ".join(f"{name} double" for name in FEATURES)
    return map_slices(id_and_text(docs), run, schema)


# --- fitting -----------------------------------------------------------------------


def _hash_rank(column: str) -> Column:
    return F.xxhash64(F.col(column), F.lit("toxicity sample"))


def training_labels(labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """One label per document, of the ``rows`` documents whose ids hash lowest."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    one = known.dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return one.orderBy(_hash_rank("doc_id"), "doc_id").limit(rows)


def _terms_of(docs: DataFrame) -> DataFrame:
    """doc_id, two family marks and the distinct term hashes of each training document."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column("text")
        texts = Texts(column)
        terms = _term_hashes(texts, lowered(texts.data))
        row = np.concatenate([texts.row] * len(terms))
        value = np.concatenate(terms)
        pairs = np.unique(np.stack([row.astype(np.uint64), value]), axis=1)
        pairs = pairs[:, pairs[1] != 0]
        ends = np.searchsorted(pairs[0], np.arange(batch.num_rows + 1, dtype=np.uint64)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pairs[1].view(np.int64)))
        shingles, bounds = shingle_sets(column, 5)
        marks = []
        for seed in (0x2545F4914F6CDD1D, 0x8EBC6AF09C88C6E3):
            mixed = mix(np.append(shingles, np.uint64(2**64 - 1)) ^ np.uint64(seed))
            low = np.minimum.reduceat(mixed, bounds[:-1])
            low = np.where(np.diff(bounds) > 0, low, np.uint64(0))
            marks.append(pa.array(low.view(np.int64)))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *marks, lists], ["doc_id", "m1", "m2", "terms"])

    return map_slices(id_and_text(docs), run, "doc_id long, m1 long, m2 long, terms array<long>")


def learn_terms(docs: DataFrame, n_toxic: int, n_clean: int) -> list[int]:
    """Terms that mark the toxic ones of the training documents, which have n_toxic and n_clean labels.

    Of near copies (equal MinHash marks) one counts.
    """
    if not n_toxic or not n_clean:
        return []
    single = _terms_of(docs).join(docs.select("doc_id", "toxic"), "doc_id")
    for mark in ("m1", "m2"):
        first = F.min_by(F.struct("doc_id", "m1", "m2", "terms"), "doc_id").alias("first")
        single = single.groupBy(F.col(mark).alias("mark"), "toxic").agg(first).select("first.*", "toxic")
    counted = single.select("toxic", F.explode("terms").alias("term"))
    counts = counted.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))
    odds = ((F.col("toxic") + 0.1) / n_toxic) / ((F.col("clean") + 0.5) / n_clean)
    least = max(3.0, TERM_SHARE * n_toxic)
    marked = counts.filter((F.col("toxic") >= least) & (odds >= TERM_RATIO))
    top = marked.orderBy(F.desc("toxic"), "term").limit(MAX_TERMS)
    return [row["term"] for row in top.select("term").collect()]  # MAX_TERMS rows at most


@dataclass(frozen=True)
class ToxicityModel:
    words: Lexicon
    trees: object | None
    calibration: object | None
    prior: float

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id and score, from 0 to 1, of every document."""
        if self.trees is None:
            return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(self.prior).alias("score"))
        raw = self.trees.transform(_assembled(features(docs, self.words)))
        raw = raw.select("doc_id", vector_to_array("probability")[1].alias("margin"))
        scored = self.calibration.transform(raw)
        return scored.select("doc_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")).alias("score"))


    def keep_clean(self, docs: DataFrame) -> DataFrame:
        """The documents that score below the threshold, with all their columns; all of them without trees."""
        if self.trees is None:
            return docs
        words = self.words
        # The text goes to the workers once, beside the other columns.
        others = [F.col(f"`{name}`") for name in docs.columns if name != "text"]
        rows = docs.select(F.struct(*others).alias("row"), "text")

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns = [pa.array(c) for c in feature_batch(batch.column("text"), words)]
            return pa.RecordBatch.from_arrays([*batch.columns, *columns], ["row", "text", *FEATURES])

        schema = StructType([*rows.schema, *(StructField(name, DoubleType()) for name in FEATURES)])
        raw = self.trees.transform(_assembled(map_slices(rows, run, schema)))
        raw = raw.select("row", "text", vector_to_array("probability")[1].alias("margin"))
        kept = self.calibration.transform(raw).filter(F.col("score") < THRESHOLD)
        own = F.col("row").getField
        return kept.select(*[F.col("text") if name == "text" else own(name).alias(name) for name in docs.columns])


def _assembled(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(df)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Fit on the documents that ``labels`` (doc_id, toxic) names, ``rows`` of them at most.

    A quarter of the sample, by hash, is kept from the lexicon and the trees and calibrates them.
    """
    workspace = Workspace(docs.sparkSession)
    chosen = workspace.stage(training_labels(labels, rows), "toxicity_labels").df
    # The sample is bounded by `rows`, so its ids fit a broadcast.
    texts = one_text_per_id(id_and_text(docs).join(F.broadcast(chosen), "doc_id"), "toxic")
    sample = workspace.stage(texts, "toxicity_sample").df
    aside = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("calibration")), F.lit(4)) == 0
    counts = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    prior = (counts["toxic"] + 1) / (counts["n"] + 2)
    taught = sample.filter(~aside)
    n = {row["toxic"]: row["n"] for row in taught.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    words = lexicon(learn_terms(taught, n.get(1, 0), n.get(0, 0)))
    measured = features(sample, words).join(sample.select("doc_id", "toxic"), "doc_id")
    # The same rows in the same order, however the input lies.
    measured = workspace.stage(measured, "toxicity_features").df
    measured = measured.repartition(4, "doc_id").sortWithinPartitions("doc_id").coalesce(4)
    table = _assembled(measured).withColumn("label", F.col("toxic").cast("double")).select("doc_id", "features", "label")
    parts = [table.filter(~aside), table.filter(aside)]
    if any(part.select("label").distinct().count() < 2 for part in parts):
        return ToxicityModel(words, None, None, float(prior))
    booster = GBTClassifier(maxIter=25, maxDepth=4, stepSize=0.2, seed=17, minInstancesPerNode=5)
    trees = booster.fit(parts[0])
    held = trees.transform(parts[1]).select("label", vector_to_array("probability")[1].alias("margin"))
    # Margins on a grid: the number of points that calibration gathers is bounded.
    held = held.groupBy(F.round("margin", 3).alias("margin")).agg(
        F.avg("label").alias("label"), F.count(F.lit(1)).cast("double").alias("weight")
    )
    calibration = IsotonicRegression(
        featuresCol="margin", labelCol="label", weightCol="weight", predictionCol="score"
    ).fit(held)
    return ToxicityModel(words, trees, calibration, float(prior))
