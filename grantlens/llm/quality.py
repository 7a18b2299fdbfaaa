"""Quality: heuristic labellers, weighed by expectation-maximisation, teach a hashed linear scorer.

Each labeller votes fine (1), poor (-1) or nothing (0) on a whole text. Votes are counted per
pattern in Spark; EM over the few patterns estimates every labeller's accuracy without any true
label, and with it the probability that a document is fine. These posteriors are the soft labels of a
logistic regression over hashed word shapes, which scores every document.

Rows: every document once per input row. Null or empty text has no words: labellers abstain or call it
poor, and the scorer sees no features. Every row votes; of several texts of one doc_id the scorer learns the
one with the lowest MD5, from that text's own votes, and rows without an id teach it nothing. An empty table, or votes of one pattern only, gives the
posterior itself as the score. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantlens.llm import text_stats
from grantlens.llm.batches import id_and_text, map_slices, mix, one_text_per_id
from grantlens.llm.text_stats import Texts, rate
from grantlens.workspace import Workspace

# Documents that the linear scorer is fitted on, at most: those with the smallest hash of their id.
TRAIN_ROWS = 20_000

# Buckets of the hashed features.
BUCKETS = 1 << 12

KEEP = 0.5

# Labellers: a measure, poor from one bound on, fine up to another (None: never votes fine). Between
# them, and for texts with fewer words than `words`, the labeller abstains. They look at whole texts from
# different sides - words, bytes, runs, lines, sentences - so that they overlap on most kinds of junk.
LABELLERS = (
    # name, poor from, fine up to, words
    ("odd_words", 0.08, 0.03, 1),
    ("odd_bytes", 0.04, 0.015, 1),
    ("odd_run", 8.0, 3.0, 1),
    ("odd_lines", 0.1, 0.02, 5),
    ("unplain_words", 0.1, 0.04, 1),
    ("unended", 0.99, 0.98, 20),
    ("repeated_next", 0.05, None, 5),
    ("repeated_lines", 0.4, None, 1),
    ("lacking_types", 0.8, None, 40),
)
NAMES = tuple(name for name, *_ in LABELLERS)

_TABLE = np.arange(256, dtype=np.uint8)
_TABLE[text_stats._LOWER | text_stats._WIDE] = ord("a")
_TABLE[text_stats._UPPER] = ord("A")
_TABLE[text_stats._DIGIT] = ord("0")
_BAR = np.arange(256) == ord("|")
_BANG = np.arange(256) == ord("!")
_SIGNS = text_stats._SYMBOL & ~_BAR


def _lines(texts: Texts) -> np.ndarray:
    """Place of the first word of every line that has words."""
    breaks = np.concatenate([[0], np.cumsum(texts.data == 10)])
    line = breaks[texts.begin]
    first = np.ones(len(line), dtype=bool)
    first[1:] = (line[1:] != line[:-1]) | (texts.row[1:] != texts.row[:-1])
    return np.flatnonzero(first)


def _line_repeats(texts: Texts, hashes: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Share of each row's words that stand in lines seen before in the row."""
    if not len(start):
        return np.zeros(texts.n_rows)
    size = np.diff(np.append(start, len(hashes)))
    place = np.arange(len(hashes)) - np.repeat(start, size)
    content = np.add.reduceat(mix(hashes + place.astype(np.uint64)), start)
    row = texts.row[start]
    order = np.lexsort((np.arange(len(start)), content, row))
    again = np.zeros(len(start), dtype=bool)
    again[order[1:]] = (content[order[1:]] == content[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
    return rate(np.bincount(row, weights=np.where(again, size, 0), minlength=texts.n_rows), texts.n_words)


def _longest_run(texts: Texts, flag: np.ndarray) -> np.ndarray:
    """Length of the longest run of flagged words in each row."""
    longest = np.zeros(texts.n_rows)
    if len(flag):
        at = np.arange(len(flag))
        new_row = np.zeros(len(flag), dtype=bool)
        new_row[1:] = texts.row[1:] != texts.row[:-1]
        broken = np.maximum.accumulate(np.where(~flag, at + 1, np.where(new_row, at, 0)))
        np.maximum.at(longest, texts.row, np.where(flag, at - broken + 1, 0))
    return longest


def _measures(texts: Texts) -> dict[str, np.ndarray]:
    hashes = texts.hashes()
    n_words = texts.n_words
    size = texts.end - texts.begin
    letters = texts.words_with(text_stats._LETTER)
    wide = texts.words_with(text_stats._WIDE)
    capitals = texts.words_with(text_stats._UPPER)
    bangs = texts.words_with(_BANG)
    signs = texts.words_with(_SIGNS)
    bars = (texts.words_with(_BAR) > 0) & (size <= 2)
    stops = texts.words_with(text_stats._STOP)
    same_row = texts.row[1:] == texts.row[:-1]
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & same_row
    celled = bars.copy()  # a bar and the words beside it
    celled[1:] |= bars[:-1] & same_row
    celled[:-1] |= bars[1:] & same_row
    shouted = (capitals > 1) & (capitals == letters - wide)
    odd = same | celled | shouted | (signs >= 2) | (bangs >= 2)
    plain = (letters + np.minimum(stops, 1) == size) & (letters > 0) & ~shouted
    start = _lines(texts)
    odd_lines = np.zeros(texts.n_rows)
    if len(start):
        line_words = np.diff(np.append(start, len(odd)))
        line_odd = np.add.reduceat(odd.astype(np.int64), start)
        junk = np.where((line_words >= 3) & (2 * line_odd > line_words), line_words, 0)
        odd_lines = np.bincount(texts.row[start], weights=junk, minlength=texts.n_rows)
    types = texts.distinct(hashes)
    ended = np.zeros(len(odd), dtype=bool)
    if len(odd):
        ended = (texts.data[texts.end - 1] == ord(".")) & plain
    extra = texts.per_row(np.maximum(capitals - 1, 0) + signs + bangs + bars)
    return {
        "odd_words": rate(texts.per_row(odd), n_words),
        "odd_bytes": rate(extra, texts.n_bytes),
        "odd_run": _longest_run(texts, odd),
        "odd_lines": rate(odd_lines, n_words),
        "unplain_words": 1.0 - rate(texts.per_row(plain), n_words),
        "unended": 1.0 - rate(texts.per_row(ended), n_words),
        "repeated_next": rate(texts.per_row(same), n_words),
        "repeated_lines": _line_repeats(texts, hashes, start),
        "lacking_types": 1.0 - rate(types, n_words),
    }


def vote_batch(column: pa.Array) -> np.ndarray:
    """Votes of every labeller, one row per text: -1 poor, 0 none, 1 fine."""
    texts = Texts(column)
    measures = _measures(texts)
    votes = np.zeros((texts.n_rows, len(LABELLERS)), dtype=np.int8)
    for k, (name, poor, fine, words) in enumerate(LABELLERS):
        value = measures[name]
        enough = texts.n_words >= words
        praised = enough & (value <= fine) if fine is not None else np.zeros(texts.n_rows, dtype=bool)
        votes[:, k] = np.where(enough & (value >= poor), -1, praised.astype(np.int8))
    return votes


def votes(docs: DataFrame) -> DataFrame:
    """doc_id and the votes, written as one character per labeller: + fine, - poor, 0 none."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        patterns = ["".join("-0+"[v + 1] for v in row) for row in vote_batch(batch.column("text"))]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(patterns, pa.string())], ["doc_id", "pattern"]
        )

    return map_slices(id_and_text(docs), run, "doc_id long, pattern string")


# --- weak labels -------------------------------------------------------------------


@dataclass(frozen=True)
class LabelModel:
    """P(fine), and per labeller P(vote | poor) and P(vote | fine) over the votes -, 0, +."""

    prior: float
    chances: np.ndarray  # labellers x {poor, fine} x {-, 0, +}

    def posterior(self, patterns: list[str]) -> np.ndarray:
        """Probability that a text with each pattern is fine."""
        given = np.array([["-0+".index(c) for c in p] for p in patterns], dtype=int).reshape(-1, len(self.chances))
        logs = np.log([[1 - self.prior], [self.prior]]) + sum(
            np.log(self.chances[k][:, given[:, k]]) for k in range(len(self.chances))
        )
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def estimate(counts: dict[str, int], rounds: int = 200, labellers: int = len(LABELLERS)) -> LabelModel:
    """EM for a two-class model with independent labellers, from counts of vote patterns.

    It starts from labellers that are right more often than not, which settles which class is
    fine. Pseudo-counts keep every probability above 0.
    """
    patterns = list(counts)
    weight = np.array([counts[p] for p in patterns], dtype=float)
    given = np.array([["-0+".index(c) for c in p] for p in patterns], dtype=int).reshape(-1, labellers)
    start = np.array([[[0.6, 0.3, 0.1], [0.02, 0.28, 0.7]]] * labellers)
    model = LabelModel(0.8, start)
    for _ in range(rounds):
        fine = model.posterior(patterns)
        shares = np.stack([weight * (1 - fine), weight * fine])
        chances = np.empty((labellers, 2, 3))
        for k in range(labellers):
            for vote in range(3):
                chances[k, :, vote] = shares[:, given[:, k] == vote].sum(axis=1)
        # Pseudo-counts in the shape of the start, so that unseen classes keep its meaning.
        chances += 2.0 * start
        chances /= chances.sum(axis=2, keepdims=True)
        total = shares.sum()
        prior = float(np.clip((shares[1].sum() + 1.6) / (total + 2), 0.01, 0.99))
        moved = abs(prior - model.prior) + np.abs(chances - model.chances).max()
        model = LabelModel(prior, chances)
        if moved < 1e-9:
            break
    return model


# --- hashed linear scorer -------------------------------------------------------------


def hashed_batch(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and value of the hashed features: shares of word shapes, scaled to unit length.

    A shape is a word with letters, capitals and digits each written as one sign and runs of equal signs
    as one or two. Words that repeat the word before count under shapes of their own.
    """
    texts = Texts(column)
    shape = _TABLE[texts.data]
    fresh = np.ones(len(shape), dtype=bool)
    fresh[1:] = shape[1:] != shape[:-1]
    if len(texts.begin):
        fresh[texts.begin] = True
    second = np.zeros(len(shape), dtype=bool)
    second[1:] = fresh[:-1]
    hashes = texts.hashes(shape, fresh | second)
    words = texts.hashes()
    same = np.zeros(len(words), dtype=bool)
    same[1:] = (words[1:] == words[:-1]) & (texts.row[1:] == texts.row[:-1])
    hashes = np.where(same, mix(hashes + np.uint64(1)), hashes)
    bucket = (hashes >> np.uint64(52)).astype(np.int64)
    cells, n = np.unique(texts.row * BUCKETS + bucket, return_counts=True)
    row = cells // BUCKETS
    value = np.sqrt(n / texts.n_words[row])  # squares add up to one
    return row, cells % BUCKETS, value


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, buckets and values of every document."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, bucket, value = hashed_batch(batch.column("text"))
        ends = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.ListArray.from_arrays(ends, pa.array(bucket, pa.int32())),
                pa.ListArray.from_arrays(ends, pa.array(value)),
            ],
            ["doc_id", "buckets", "values"],
        )

    return map_slices(id_and_text(docs), run, "doc_id long, buckets array<int>, values array<double>")


@dataclass(frozen=True)
class QualityModel:
    labels: LabelModel
    weights: np.ndarray | None
    intercept: float

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id, score (0 to 1, higher: finer) and keep of every document."""

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            score = self.scores(batch.column("text"))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

        scored = map_slices(id_and_text(docs), run, "doc_id long, score double")
        return scored.withColumn("keep", F.col("score") >= KEEP)

    def filter(self, docs: DataFrame) -> DataFrame:
        """The documents whose score reaches ``KEEP``, with all their columns."""
        return map_slices(docs, lambda batch: batch.filter(pa.array(self.scores(batch.column("text")) >= KEEP)), docs.schema)

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.weights is None:
            return self.labels.posterior(["".join("-0+"[v + 1] for v in row) for row in vote_batch(column)])
        row, bucket, value = hashed_batch(column)
        margin = np.bincount(row, weights=self.weights[bucket] * value, minlength=len(column))
        return 1 / (1 + np.exp(-np.clip(margin + self.intercept, -500, 500)))


def fit(docs: DataFrame, rows: int = TRAIN_ROWS) -> QualityModel:
    """Labeller accuracies from the votes on all documents; the scorer from ``rows`` of them at most."""
    workspace = Workspace(docs.sparkSession)
    voted = workspace.stage(votes(docs), "quality_votes").df
    # At most 3 ** labellers patterns come to the driver.
    counts = {row["pattern"]: row["n"] for row in voted.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return QualityModel(estimate({}), None, 0.0)
    labels = estimate(counts)
    patterns = list(counts)
    soft = dict(zip(patterns, labels.posterior(patterns).tolist(), strict=True))
    if min(soft.values()) > 0.5 or max(soft.values()) < 0.5:
        return QualityModel(labels, None, 0.0)
    drawn = voted.filter("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id", F.lit("quality sample")), "doc_id")
    chosen = drawn.limit(rows).select("doc_id").distinct()  # bounded by `rows`, so it fits a broadcast
    fine = F.create_map(*[F.lit(x) for item in soft.items() for x in item])[F.col("pattern")]
    texts = one_text_per_id(id_and_text(docs).join(F.broadcast(chosen), "doc_id"))
    texts = workspace.stage(texts, "quality_texts").df
    table = hashed(texts).join(votes(texts).select("doc_id", fine.alias("fine")), "doc_id")
    # The same rows in the same order, however the input lies.
    table = workspace.stage(table, "quality_sample").df.repartition(4, "doc_id").sortWithinPartitions("doc_id").coalesce(4)
    vector = F.udf(lambda b, v: Vectors.sparse(BUCKETS, b, v), VectorUDT())  # on the bounded sample only
    table = table.select(vector("buckets", "values").alias("features"), "fine")
    sides = F.explode(
        F.array(
            F.struct(F.lit(1.0).alias("label"), F.col("fine").alias("weight")),
            F.struct(F.lit(0.0).alias("label"), (1 - F.col("fine")).alias("weight")),
        )
    )
    table = table.select("features", sides.alias("side")).select("features", "side.*")
    linear = LogisticRegression(
        featuresCol="features", labelCol="label", weightCol="weight", regParam=1e-5, maxIter=60, standardization=False
    ).fit(table)
    return QualityModel(labels, linear.coefficients.toArray(), float(linear.intercept))


def classify(docs: DataFrame) -> DataFrame:
    """doc_id, score and keep of every document, by a model of the same documents."""
    return fit(docs).score(docs)


def keep_fine(docs: DataFrame) -> DataFrame:
    """The documents that the classifier keeps, with all their columns."""
    return fit(docs).filter(docs)
