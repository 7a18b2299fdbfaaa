import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from grantlens.llm import conversation_trie, queries, tree_contraction
from grantlens.workspace import Workspace
from tests.compare import connect, duck_rows, spark_rows

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth bigint, id string, parent string, words string"


def frame(spark, rows):
    return spark.createDataFrame([(*row, 0, "x", "x", "x") for row in rows], SCHEMA)


def brute(rows, block=1, shared=0):
    original = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            original[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(found, key=lambda x: x[:3])] for c, found in original.items()}
    rebuilt = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % shared if shared else 0
        rebuilt[c] = turns.get(c - c % block, [])[:h] + turns[c][h:]
    members = defaultdict(list)
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    own = {p: (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0 for p, m in members.items()}
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += own[p]
    result = {}
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(p))
        result[min(m), len(p)] = (
            min(members[p[:-1]]) if p else None,
            len(m),
            children[p],
            leaves[p],
            saved[p],
            hashlib.sha256(ends.encode()).hexdigest(),
        )
    return result


def found(spark, rows, block=1, shared=0):
    result = conversation_trie.prefix_trie(frame(spark, rows), block, shared).collect()
    trie = {(r.conv_id, r.depth): tuple(r)[2:] for r in result}
    assert len(trie) == len(result)
    return trie


def talks(n, seed, most=6):
    draw = random.Random(seed)
    return [
        (c, turn, draw.choice(["user", "assistant"]), " ".join(draw.choice(["a", "b"]) for _ in range(draw.randint(0, 1))))
        for c in range(n)
        for turn in range(draw.randint(1, most))
    ]


def test_equals_brute_force(spark):
    rows = talks(120, 1)
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, 20, 4) == brute(rows, 20, 4)


def test_missing_bases_and_turnless_conversations(spark):
    rows = [r for r in talks(90, 2, most=2) if r[0] % 20 or r[0] == 40]
    expected = brute(rows, 20, 4)
    nobody = hashlib.sha256().hexdigest()
    assert expected[min(r[0] for r in rows), 0][-1] != nobody  # some conversations have no turns left
    assert found(spark, rows, 20, 4) == expected


def test_one_long_conversation_in_many_runs(spark):
    """A conversation cut into runs equals one that a task sorts as a whole."""
    long_talk = [(7, turn, "user", f"word {turn % 3}") for turn in range(700)]
    rows = [*long_talk, *[(9, t, r, x) for _, t, r, x in long_talk[:650]], (9, 900, "user", "else"), (8, 0, "user", "word 0")]
    spread = frame(spark, rows).repartition(5)
    result = conversation_trie.prefix_trie(spread).collect()
    assert {(r.conv_id, r.depth): tuple(r)[2:] for r in result} == brute(rows)


def test_copies_end_at_one_node(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(400) for t in range(2)]
    expected = brute(rows)
    assert len(expected) == 3 and found(spark, rows) == expected


def test_odd_rows(spark):
    rows = [
        (1, None, None, None),
        (1, 0, "user", " \t\n "),
        (2, None, "", ""),
        (2, 0, "user", " \t\n "),
        (3, 5, "user", "x" * 100_000),
        (4, 5, "user", "x" * 100_000),
        (4, 6, "user", "again again"),
        (5, 1, "user", "same"),
        (5, 1, "user", "same"),
        (6, 1, "user", "same"),
        (-3, 1, "user", "Ünïcode 😀"),
        (None, 1, "user", "nobody's"),
    ]
    assert found(spark, rows) == brute(rows)
    assert found(spark, [(None, 1, "user", "nobody's")]) == {}
    assert found(spark, []) == {}


def tree(n, seed, shape):
    """(id, parent, value) of a forest: random, one path, a star, a path with leaves, or a few paths."""
    draw = random.Random(seed)
    parents = {
        "random": lambda i: draw.randrange(i),
        "path": lambda i: i - 1,
        "star": lambda i: 0,
        "caterpillar": lambda i: i - 1 if i % 2 else max(i - 2, 0),
        "forest": lambda i: None if i % 40 == 0 else i - 1,
        "binary": lambda i: (i - 1) // 2,
    }
    names = list(range(n))
    draw.shuffle(names)
    rows = []
    for i in range(n):
        parent = parents[shape](i) if i else None
        rows.append((names[i], None if parent is None else names[parent], draw.randint(-5, 9), 1))
    return rows


@pytest.mark.parametrize("shape", ["random", "path", "star", "caterpillar", "forest", "binary"])
def test_subtree_sums(spark, shape):
    rows = tree(300, 3, shape)
    above = {i: p for i, p, *_ in rows}
    expected = defaultdict(lambda: [0, 0])
    for i, _, value, one in rows:
        node = i
        while node is not None:
            expected[node][0] += value
            expected[node][1] += one
            node = above[node]
    nodes = spark.createDataFrame(rows, "id bigint, parent bigint, value bigint, one bigint")
    sums = tree_contraction.subtree_sums(Workspace(spark), nodes, ["value", "one"])
    assert {r.id: [r.value, r.one] for r in sums.collect()} == dict(expected)


def test_subtree_sums_of_nothing(spark):
    nodes = spark.createDataFrame([], "id bigint, parent bigint, value bigint")
    assert tree_contraction.subtree_sums(Workspace(spark), nodes, ["value"]).count() == 0
    alone = spark.range(1).select("id", F.lit(None).cast("long").alias("parent"), F.lit(4).cast("long").alias("value"))
    assert [tuple(r) for r in tree_contraction.subtree_sums(Workspace(spark), alone, ["value"]).collect()] == [(0, 4)]


def test_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    df = queries.queries()["op12_prefix_trie"](spark, folder)
    assert spark_rows(df) == duck_rows(connect(folder), queries.oracle_sql()["op12_prefix_trie"])
