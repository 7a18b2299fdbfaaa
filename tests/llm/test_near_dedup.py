import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from grantlens.llm import near_dedup
from grantlens.llm.components import components
from grantlens.workspace import Workspace
from tests.llm.helpers import frame, odd_rows


def shingles(text):
    words = (text or "").encode().lower().split()
    if len(words) >= 5:
        return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    return frozenset([tuple(words)]) if words else frozenset()


def brute(rows):
    """doc_id -> (set size, smallest doc_id reachable) by comparing all that share a shingle."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i in sorted(sets):
        common = Counter(j for s in sets[i] for j in holders[s])
        for j, n in common.items():
            if 100 * n >= 85 * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for s in sets[i]:
            holders[s].append(i)
    return {i: (len(sets[i]), root(i)) for i in sets}


def copies(n, seed):
    """Families of texts with a few words changed, from close to just too far."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        family = i % 7
        words = [f"w{random.Random(family * 1000 + k).randint(0, 400)}" for k in range(60 + 40 * family)]
        for _ in range(draw.choice([0, 1, 1, 2, 3, 5])):
            words[draw.randrange(len(words))] = f"new{draw.randint(0, 30)}"
        rows.append((i, " ".join(words)))
    return rows


def found(spark, rows):
    members = near_dedup.near_duplicates(frame(spark, rows)).members.collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in members)
    assert len(members) == len({i for i, _ in rows if i is not None})
    return {r.doc_id: (r.n_shingles, r.component_id) for r in members}


def test_components_equal_brute_force(spark):
    rows = copies(260, 3)
    expected = brute(rows)
    assert 7 < len({c for _, c in expected.values()}) < 200
    assert found(spark, rows) == expected


def test_odd_rows(spark):
    rows = [r for r in odd_rows() if r[0] not in (9, None)]
    assert found(spark, rows) == brute(rows)
    result = found(spark, odd_rows())
    assert result[2] == (0, 2) and result[3] == (0, 3) and result[4] == (0, 4)
    assert result[6][1] == 1
    assert near_dedup.near_duplicates(frame(spark, [])).members.count() == 0


def test_deduplicate_keeps_one_of_each_group(spark):
    docs = frame(spark, odd_rows())
    kept = near_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[1] == 1 and 6 not in ids  # equal texts
    assert ids[9] == 1  # repeated rows
    assert ids[None] == 1 and ids[2] == ids[3] == ids[4] == 1


@pytest.mark.parametrize("distance", [0, 1, 13, 27])
def test_index_finds_all_pairs_within_the_distance(distance):
    draw = np.random.default_rng(distance)
    for _ in range(50):
        one = draw.integers(0, 2**16, (1, near_dedup.SYMBOLS), dtype=np.uint16)
        two = one.copy()
        two[0, draw.choice(near_dedup.SYMBOLS, distance, replace=False)] ^= 1
        assert (near_dedup.chunk_keys(one) == near_dedup.chunk_keys(two)).any()


def test_distance_counts_differing_values(spark):
    draw = np.random.default_rng(5)
    one = draw.integers(0, 2**16, near_dedup.SYMBOLS, dtype=np.uint16)
    two = np.where(draw.random(near_dedup.SYMBOLS) < 0.4, one ^ np.uint16(0x8000), one)
    schema = ", ".join(f"{name} long" for name in near_dedup.SIGNATURE)
    planes = [near_dedup.to_planes(v[None, :]) for v in (one, two)]
    assert (near_dedup.from_planes(planes[0])[0] == one).all()
    x, y = (spark.createDataFrame([tuple(p[0].tolist())], schema) for p in planes)
    joined = x.alias("x").join(y.alias("y"))
    assert joined.select(near_dedup.differing("x", "y")).first()[0] == (one != two).sum()


def test_each_pair_has_one_first_key(spark):
    draw = np.random.default_rng(9)
    masks = [0, 1, 2**63, *(int(np.bitwise_or.reduce(1 << draw.choice(63, n))) for n in range(1, 28))]
    signed = [(m - 2**64 if m >= 2**63 else m,) for m in masks]
    df = spark.createDataFrame(signed, "m long")
    zero = np.zeros((1, near_dedup.SYMBOLS), np.uint16)
    for r in df.select("m", near_dedup.first_shared(df.m).alias("bit")).collect():
        other = np.array([[(r.m >> i) & 1 for i in range(near_dedup.SYMBOLS)]], np.uint16)
        same = np.flatnonzero(near_dedup.chunk_keys(zero)[0] == near_dedup.chunk_keys(other)[0])
        assert len(same) and (r.bit & (2**64 - 1)).bit_length() - 1 == same[0]


def test_components_of_chains_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)]
    links += [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(300, 300)]
    df = spark.createDataFrame(links, "a long, b long")
    result = {r.id: r.component for r in components(Workspace(spark), df).collect()}
    expected = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200 + i: 200 for i in range(9)}
    assert result == expected
