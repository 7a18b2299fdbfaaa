import hashlib
import re

from pyspark.sql import functions as F

from grantlens.llm import fingerprints as fp
from tests.llm.helpers import frame, odd_rows

def pieces(text):
    found = set()
    for line in re.split("[\r\n]+", text):
        words = [m.span() for m in re.finditer("[^ \t]+", line)]
        at = 0
        while at < len(words):
            left = len(words) - at
            ends = [n for n in range(fp.LEAST_WORDS, fp.PIECE_WORDS + 1) if n <= left and line[words[at + n - 1][1] - 1] in fp.ENDS]
            n = ends[0] if ends else min(fp.PIECE_WORDS, left)
            found.add(line[words[at][0] : words[at + n - 1][1]])
            at += n
    return found


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    result = []
    for k, (i, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        result.append(
            (i, len(text), hashlib.sha256(edited.encode()).hexdigest(),
             round(alike(pieces(text), pieces(edited)), 9), round(alike(pieces(text), pieces(following)), 9))
        )
    return result


def check(spark, rows):
    found = fp.fingerprints(frame(spark, rows)).collect()
    got = [(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in found]
    key = lambda r: (r[0] is None, r)
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    return found


def test_whole_texts_equal_brute_force(spark):
    found = check(spark, odd_rows())
    by_id = {r.doc_id: r for r in found}
    assert by_id[1].fingerprint == by_id[6].fingerprint  # equal texts
    assert by_id[2].fingerprint == by_id[3].fingerprint  # no text, empty text
    assert len({len(r.fingerprint) for r in found}) == 1
    check(spark, [(7, "alone among all")])
    assert fp.fingerprints(frame(spark, [])).count() == 0


def test_next_documents_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_ROWS", 4)
    ids = [*range(0, 40), *range(1_000, 1_200, 7), 10**12, -5, -(10**9)]
    rows = [(i, f"document {i} " + "word " * (i % 30)) for i in ids]
    check(spark, rows)
    monkeypatch.setattr(fp, "BROADCAST_ROWS", 0)
    check(spark, rows)


def test_tables_subtract_and_peel(spark):
    left, right = list(range(100, 112)), list(range(106, 110)) + [7, 8]
    df = spark.createDataFrame([(left, right)], "l array<long>, r array<long>")
    third, seed = F.lit(20), F.lit(3)
    one, two = fp.table(F.col("l"), third, seed), fp.table(F.col("r"), third, seed)
    row = df.select(
        fp.peel(fp.subtract(one, two), third, seed).alias("p"),
        (fp.subtract(one, two) == fp.difference_table(F.col("l"), F.col("r"), third, seed)).alias("same"),
    ).first()
    assert row.same and row.p.ok and (row.p.left, row.p.right) == (8, 2)


def test_failing_tables_are_made_larger(spark):
    df = spark.createDataFrame([(list(range(400)), list(range(390, 500)))], "l array<long>, r array<long>")
    small = fp.peel(fp.difference_table(F.col("l"), F.col("r"), F.lit(8), F.lit(1)), F.lit(8), F.lit(1))
    row = df.select(small.alias("small"), fp._retried(F.col("l"), F.col("r")).alias("large")).first()
    assert not row.small.ok
    assert row.large.ok and (row.large.left, row.large.right) == (390, 100)


def test_no_python_on_the_path(spark):
    plan = fp.fingerprints(frame(spark, odd_rows()))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_words_put_in_change_few_pieces(spark):
    prose = " ".join(f"{a} {b}" for a in "the dogs look across many rivers while nobody sings".split() for b in "red things grow under blue cloudy skies".split())
    rows = [(k, f"x{k} {prose}") for k in range(20)]  # each one next to the other, but for the first word
    found = check(spark, rows)
    assert min(r.near_next for r in found) > 0.8


def test_counts_are_exact_where_no_table_peels(spark, monkeypatch):
    rows = [(k, "\n".join(f"line {n} of {k % 3}" for n in range(5 * k))) for k in range(12)]
    monkeypatch.setattr(fp, "TRIES", 1)
    monkeypatch.setattr(fp, "DEALT_CELLS", 3)  # a cell in each group: nothing but one digest peels
    check(spark, rows)


def test_cells_are_found_without_division(spark):
    """Filling a table compares the places of a group alone, and divides for none of them."""
    cells = fp.table(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.xxhash64(i)), F.lit(8), F.lit(0))
    row = spark.range(1).select(cells.alias("cells"))
    assert "floor" not in row._jdf.queryExecution().analyzed().toString().lower()
    assert [sum(c.n for c in row.first().cells[8 * g : 8 * g + 8]) for g in range(3)] == [40, 40, 40]


def test_next_cells_are_those_of_the_next_row(spark):
    """A row's cells are made once and go along with its digests to the row before it."""
    rows = fp.with_next(frame(spark, odd_rows()))
    wrong = ~F.col("next_cells").eqNullSafe(fp.table(F.col("next_keys"), F.lit(fp.CELLS // 3), F.lit(0)))
    assert rows.count() > 0 and rows.filter(wrong).count() == 0


def test_peeling_counts_each_digest_once_on_its_side(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [3, 5])], "l array<bigint>, r array<bigint>")
    third, seed = F.lit(8), F.lit(0)
    found = df.select(fp.peel(fp.difference_table(F.col("l"), F.col("r"), third, seed), third, seed).alias("p")).first().p
    assert (found.ok, found.left, found.right) == (True, 3, 1)
