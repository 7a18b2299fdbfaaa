"""Rows that share a doc_id but have different texts."""

from collections import Counter

from pyspark.sql import functions as F

from grantlens.llm import near_dedup
from tests.llm.helpers import frame


def text(name, changed=()):
    return " ".join("other" if k in changed else f"{name}{k}" for k in range(80))


ROWS = [
    (1, text("a")),
    (5, text("a", [40])),  # a near copy of 1
    (5, text("b")),  # resembles nothing but 7
    (5, text("b")),
    (7, text("b", [3])),
    (8, text("c")),
    (8, text("d")),
    (8, None),
    (8, " "),
    (9, text("d", [79])),
    (9, text("a", [0])),
    (10, text("e")),
    (10, text("e", [79])),
    (None, text("a")),
]


def test_only_near_copies_go(spark):
    docs = frame(spark, ROWS)
    kept = near_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    rows = Counter((r.doc_id, r.text) for r in kept.collect())
    one_of_ten = [row for row in rows if row[0] == 10]
    assert len(one_of_ten) == 1 and one_of_ten[0] in ROWS
    expected = [ROWS[k] for k in (0, 2, 5, 6, 7, 8, 13)] + one_of_ten
    assert rows == Counter(expected)


def test_members_and_links_have_one_row_per_id(spark):
    found = near_dedup.near_duplicates(frame(spark, ROWS))
    members = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found.members.collect()}
    assert members == {
        1: (76, 1, True),
        5: (152, 5, True),
        7: (76, 5, False),
        8: (152, 8, True),
        9: (152, 1, False),
        10: (152, 10, True),
    }
    assert {tuple(sorted(r)) for r in found.links.collect()} >= {(1, 5), (5, 7), (8, 9), (10, 10)}


def test_same_rows_whatever_their_order(spark):
    rows = [(i % 4, text("x", [i % 60])) for i in range(40)] + [(i % 4, text(f"n{i}")) for i in range(40)]
    docs = frame(spark, rows).withColumn("source", F.concat(F.lit("src"), F.spark_partition_id().cast("string")))
    results = [
        sorted(map(tuple, near_dedup.deduplicate(df).collect()))
        for df in (docs.repartition(5), docs.repartition(3, "text"))
    ]
    assert results[0] == results[1] and len(results[0]) == 41
