"""Spelling variants: words one edit away from a much more frequent word.

Asymmetric q-chunks: the longer word of a pair contributes disjoint chunks, the other one its positional
grams. An edit falls into one half of the longer word and leaves the other half, which the other word then
holds as a gram at the same place or shifted by one. That would be a key for a join, but a short half is
shared by thousands of words. So the half with the edit is itself cut in two chunks, of which the edit
again leaves one. What is left of a word without one of its four quarters is hashed to the join key. Only
grams that lie within a shift of one of their chunk can join, so the shorter word sends just those. Pairs
that meet are verified by edit distance.

Nulls and odd rows: a document without text has no words; one without id is hashed as if its id were
empty; repeated rows count as often as they occur. Of equally frequent near words the smallest in
code-point order is taken. An empty table gives no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantlens.workspace import Stage, Workspace

# Letters of a word.
LETTERS = r"A-Za-zÀ-ÿ"

MIN_LENGTH = 7
MIN_COUNT = 2

# A form is at least so many times as frequent as its variant.
FORM_RATIO = 10

QUARTERS = 4

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def runs(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(doc_id, run): maximal runs of letters, A-Z lower-cased, with at least ``min_length`` code points."""
    # Greedy from its first letter on, a match is a whole run; shorter runs match nowhere.
    long_runs = F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))
    found = docs.select("doc_id", F.explode(long_runs).alias("run"))
    return found.select("doc_id", F.translate("run", _UPPER, _UPPER.lower()).alias("run"))


def damaged(run: Column, key: Column, modulus: int) -> Column:
    """The run without one of its letters where ``modulus`` divides the CRC-32 of ``key``."""
    h = F.crc32(key.cast("binary"))
    place = (h % F.char_length(run)).cast("int")
    without = F.concat(F.substring(run, F.lit(1), place), F.substr(run, place + 2))
    return F.when(h % modulus == 0, without).otherwise(run)


def vocabulary(
    workspace: Workspace, words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT
) -> Stage:
    """(word, n): words long and frequent enough, with their number, from one row per occurrence."""
    counts = words.filter(F.char_length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return workspace.stage(counts.filter(F.col("n") >= min_count), "vocabulary")


def _cuts(length: Column) -> list[Column]:
    """Ends of the four quarters: the halves first, then the halves of each."""
    half = F.floor(length / 2)
    cuts = [F.lit(0), F.floor(half / 2), half, half + F.floor((length - half) / 2), length]
    return [cut.cast("int") for cut in cuts]


def _without(word: Column, length: Column, quarter: int) -> tuple[Column, Column]:
    """What a word has before and after a quarter of a word of ``length``, counted from either end."""
    cuts = _cuts(length)
    return F.left(word, cuts[quarter]), F.right(word, length - cuts[quarter + 1])


def _rests(words: DataFrame, length: str, columns: list[str]) -> DataFrame:
    """``columns`` with four hashes: the word without each quarter of a word of ``length``."""
    rests = [
        F.xxhash64(F.lit(quarter), length, *_without(F.col("word"), F.col(length), quarter))
        for quarter in range(QUARTERS)
    ]
    return words.select(*columns, F.array(*rests).alias("rests"))


def near_pairs(workspace: Workspace, words: Stage) -> Stage:
    """(a, n_a, b, n_b): every pair of words exactly one edit apart, once; ``a`` is the longer, or the smaller.

    Two words may agree without several of their quarters; the pair counts where the first of these meets.
    A key stands for all words that differ in one quarter only, so its rows are few; Spark splits a partition
    that is large all the same.
    """
    sized = words.df.withColumn("size", F.char_length("word"))
    targets = sized.withColumn("target", F.explode(F.array("size", F.col("size") + 1)))
    chunks = _rests(sized, "size", ["word", "n", "size"]).toDF("a", "n_a", "size_a", "rests_a")
    grams = _rests(targets, "target", ["word", "n", "size"]).toDF("b", "n_b", "size_b", "rests_b")
    met = chunks.select("*", F.posexplode("rests_a").alias("quarter", "rest")).join(
        grams.select("*", F.posexplode("rests_b").alias("quarter", "rest")), ["quarter", "rest"]
    )
    ordered = (F.col("size_b") < F.col("size_a")) | (F.col("a") < F.col("b"))
    for earlier in range(QUARTERS - 1):
        agreed = F.col("rests_a")[earlier] == F.col("rests_b")[earlier]
        ordered = ordered & ((F.col("quarter") <= earlier) | ~agreed)
    verified = met.filter(ordered & (F.levenshtein("a", "b", 1) == 1))
    return workspace.stage(verified.select("a", "n_a", "b", "n_b"), "near-words")


def roots(workspace: Workspace, forms: Stage) -> DataFrame:
    """(word, root): the last word on the way from form to form; each round doubles the steps taken.

    A form is many times as frequent as its word, so ways are short and have no cycles.
    """
    known = forms.df.select("word", F.col("form").alias("root"))
    rows = forms.rows
    while rows > 0:
        onward = known.select(F.col("word").alias("root"), F.col("root").alias("further"))
        stepped = workspace.stage(
            known.join(onward, "root", "left").select(
                "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
            ),
            "word-roots",
        )
        rows = stepped.df.filter("moved").limit(1).count()
        known = stepped.df.select("word", "root")
    return known


def variants(words: Stage, workspace: Workspace, ratio: int = FORM_RATIO) -> DataFrame:
    """Each word with its form, the root of its forms, and how many words are near it.

    ``words`` is (word, n) with each word once. A word's form is the most frequent word one edit away, if it
    is at least ``ratio`` times as frequent. Columns: word, form, root, n, n_near, form_n.
    """
    pairs = near_pairs(workspace, words).df
    both = pairs.toDF("word", "n", "other", "n_other").unionByName(pairs.toDF("other", "n_other", "word", "n"))
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"))
    # Only the few pairs of very different frequency go through the sort that a smallest struct needs.
    better = both.filter(F.col("n_other") >= ratio * F.col("n"))
    best = better.groupBy("word").agg(F.min(F.struct((-F.col("n_other")).alias("less"), F.col("other"))).alias("best"))
    forms = workspace.stage(
        best.select("word", F.col("best.other").alias("form"), (-F.col("best.less")).alias("form_n")), "forms"
    )
    resolved = forms.df.join(roots(workspace, forms), "word")
    return (
        words.df.join(near, "word", "left")
        .join(resolved, "word", "left")
        .select(
            "word",
            "form",
            F.coalesce("root", "word").alias("root"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            "form_n",
        )
    )


def spelling_variants(docs: DataFrame, damage: int | None = None) -> DataFrame:
    """``variants`` over all words of the documents' whole texts.

    With ``damage``, one letter is deleted from the share 1 / ``damage`` of the runs, chosen by the
    CRC-32 of document and run, so that there are known misspellings to find.
    """
    workspace = Workspace(docs.sparkSession)
    found = runs(docs)
    word = F.col("run")
    if damage is not None:
        key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), word)
        word = damaged(word, key, damage)
    return variants(vocabulary(workspace, found.select(word.alias("word"))), workspace)
