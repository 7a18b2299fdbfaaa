"""Near-dedup with a threshold other than op10's."""

import numpy as np
import pytest

from grantlens.llm import near_dedup
from tests.llm.helpers import frame
from tests.llm.test_near_dedup import copies, shingles


def lowest_linked(rows, percent):
    sets = {i: shingles(t) for i, t in rows}
    first = {i: i for i in sets}
    pairs = [(i, j) for i in sets for j in sets if i < j and sets[i]]
    links = [(i, j) for i, j in pairs if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    for _ in sets:
        for i, j in links:
            first[i] = first[j] = min(first[i], first[j])
    return first


def test_threshold_of_80_equals_brute_force(spark):
    rows = copies(120, 3)
    expected = lowest_linked(rows, 80)
    assert expected != lowest_linked(rows, 85)
    docs = frame(spark, rows)
    kept = near_dedup.deduplicate(docs, percent=80)
    assert {r.doc_id for r in kept.collect()} == {i for i, low in expected.items() if i == low}


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_index_misses_few_pairs_and_finds_the_others(percent):
    index = near_dedup.index_for(percent)
    assert near_dedup.missed(percent, index.distance) <= near_dedup.MISSED
    draw = np.random.default_rng(percent)
    for _ in range(50):
        one = draw.integers(0, 2**16, (1, near_dedup.SYMBOLS), dtype=np.uint16)
        two = one.copy()
        two[0, draw.choice(near_dedup.SYMBOLS, index.distance, replace=False)] ^= 1
        assert (near_dedup.chunk_keys(one, index) == near_dedup.chunk_keys(two, index)).any()


def test_default_index_and_too_low_thresholds():
    assert (near_dedup.DEFAULT.chunks, near_dedup.DEFAULT.distance) == (14, 27)
    assert near_dedup.index_for(80).distance == 31
    with pytest.raises(ValueError):
        near_dedup.index_for(5)
