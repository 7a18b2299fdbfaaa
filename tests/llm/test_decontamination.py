import random
from functools import partial

import numpy as np
import pytest

from grantlens.llm import decontamination as dc
from grantlens.operators import skew
from tests.llm.helpers import CLASHES, PROSE, frame, odd_rows


def brute(item, text, shortest=5):
    done_i, done_t, tiles = [0] * len(item), [0] * len(text), []
    while True:
        best, most = [], shortest
        for p in range(len(item)):
            for t in range(len(text)):
                k = 0
                while (p + k < len(item) and t + k < len(text) and not done_i[p + k]
                       and not done_t[t + k] and item[p + k] == text[t + k]):
                    k += 1
                if k > most:
                    best, most = [(p, t)], k
                elif k == most:
                    best.append((p, t))
        if not best:
            return sorted(tiles)
        for p, t in best:
            if not any(done_i[p : p + most]) and not any(done_t[t : t + most]):
                done_i[p : p + most] = [1] * most
                done_t[t : t + most] = [1] * most
                tiles.append((most, p, t))


def test_tiles_equal_brute_force():
    draw = random.Random(5)
    for _ in range(150):
        item, text = ([draw.randint(1, 4) for _ in range(draw.randint(5, n))] for n in (40, 60))
        assert sorted(dc.tile(np.array(item, np.uint64), np.array(text, np.uint64))) == brute(item, text)
    same = np.arange(1, 300, dtype=np.uint64)
    assert dc.tile(same, same) == [(299, 0, 0)]


ITEM = " ".join(f"question{k} about{k % 7}" for k in range(20))


@pytest.fixture
def benchmark(spark):
    rows = [(1, ITEM, "x"), (2, None, "x"), (3, "", "x"), (4, "too short", "x"), (None, "no id but some words in it", "x")]
    return spark.createDataFrame(rows, "item_id long, text string, doc_id string")


def passages():
    words = ITEM.split()
    reordered = " ".join([*words[20:], "and", *words[:20]])
    return [
        (10, f"{PROSE} {ITEM} {PROSE}"),
        (11, PROSE + "\n" + reordered.upper().replace(" ", ",  ")),
        (12, " ".join(words[:30])),  # three quarters: under the coverage
        (13, " ".join(f"{w} gap" for w in words)),
        (14, "He said: no id, but some words in it!"),
        (15, " ".join(words[:34])),
        (15, " ".join(words[:34])),
    ]


def test_leaks_are_found_in_any_order(spark, benchmark):
    found = dc.leaks(frame(spark, passages() + odd_rows()), benchmark).collect()
    assert sorted((r.doc_id, r.item_id or 0) for r in found) == [(10, 1), (11, 1), (14, 0), (15, 1), (15, 1)]
    by_id = {r.doc_id: r for r in found}
    assert by_id[10].coverage == 1.0 and by_id[10].longest_tile == 40
    assert by_id[11].coverage == 1.0 and by_id[11].n_tiles == 2
    assert by_id[15].coverage == 0.85


def test_documents_are_kept_whole(spark, benchmark):
    docs = frame(spark, passages() + odd_rows())
    kept = dc.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns and set(CLASHES) < set(kept.columns)
    rows = sorted((r.doc_id or 0, r.text or "") for r in kept.collect())
    assert rows == sorted((i or 0, t or "") for i, t in passages()[2:4] + odd_rows())


def test_empty_tables_and_full_filter(spark, benchmark, monkeypatch):
    docs = frame(spark, passages())
    assert dc.leaks(docs, benchmark.limit(0)).count() == 0
    assert dc.leaks(docs.limit(0), benchmark).count() == 0
    monkeypatch.setattr(dc, "FILTER_BITS", 64)
    assert dc.leaks(docs, benchmark).count() == 5


def tokens_of(text):
    """Letters and digits of each word, lower-cased, without words that have none."""
    words = ("".join(c for c in w if c.isascii() and c.isalnum()) for w in (text or "").lower().split())
    return [w for w in words if w]


def test_whole_query_equals_brute_force(spark, monkeypatch):
    """Every document row is tiled with every item row, without seeds; hot seeds take the split joins."""
    draw = random.Random(11)
    stock = "as everybody in this town has known for a very long time"
    items = [
        (k, " ".join(draw.choice("red blue green tall old cat dog ran sat the of".split()) for _ in range(draw.randint(3, 25))))
        for k in range(25)
    ]
    items += [(100, stock), (101, stock + " the cat sat on the mat"), (101, stock + " the cat sat on the mat"), (102, None)]
    rows = []
    for i in range(60):
        _, text = draw.choice(items)
        words = (text or "").split()
        at = draw.randint(0, len(words))
        kept = [w for w in words if draw.random() > draw.choice((0, 0, 0.1))]
        body = " ".join([*words[at:], "x", *words[:at]] if i % 3 == 0 else kept)
        rows.append((i // 2, f"{stock if i % 2 else ''} {body} {stock if i % 5 == 0 else ''}"))
    rows += rows[:4]
    expected = []
    for doc_id, text in rows:
        for item_id, item in items:
            numbers = {}
            a, b = ([numbers.setdefault(w, len(numbers)) for w in tokens_of(t)] for t in (item, text))
            tiles = brute(a, b)
            if len(a) >= 5 and sum(size for size, _, _ in tiles) >= 0.8 * len(a):
                expected.append((doc_id, item_id, len(tiles), max(tiles)[0]))
    split = partial(skew.balanced_join, hot_pairs=1, slice_rows=2)
    monkeypatch.setattr(dc, "balanced_join", split)
    schema = "item_id long, text string"
    found = dc.leaks(frame(spark, rows), spark.createDataFrame(items, schema))
    assert sorted((r.doc_id, r.item_id, r.n_tiles, r.longest_tile) for r in found.collect()) == sorted(expected)
    assert len(expected) > 60
    kept = dc.decontaminate(frame(spark, rows), spark.createDataFrame(items, schema)).collect()
    leaking = {text for _, text in rows if any(
        len(tokens_of(i)) >= 5 and 5 * sum(s for s, _, _ in brute(tokens_of(i), tokens_of(text))) >= 4 * len(tokens_of(i))
        for _, i in items)}
    assert sorted(r.text for r in kept) == sorted(text for _, text in rows if text not in leaking)


def test_seeds_every_leak_holds():
    """Tiles of five tokens hold the fewest seeds: one place each."""
    assert [dc.least_seeds(n) for n in (5, 6, 10, 25, 100)] == [1, 1, 2, 4, 16]
