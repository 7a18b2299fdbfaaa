import math
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.errors import PythonException

from grantlens.llm import language_model as lm
from grantlens.llm.batches import mix
from tests.llm.helpers import PROSE, frame, odd_rows

END = b"\x00 end"


def tokens(text):
    return [*(text or "").encode().lower().split(), END]


def brute(training, rows):
    """(tokens, known, N, base, score) of each row by counting in Python."""
    words, pairs = Counter(), Counter()
    for _, text in training:
        sequence = tokens(text)
        words.update(sequence)
        pairs.update(zip([b"\x00 start", *sequence], sequence, strict=False))
    n, v = sum(words.values()), len(words)
    left = Counter(w for _, w in pairs)
    after = defaultdict(list)
    for (c, _), k in pairs.items():
        after[c].append(k)
    d = lm.discounts(np.array([sum(x == k for x in pairs.values()) for k in (1, 2, 3, 4)]))
    e = lm.discounts(np.array([sum(x == k for x in left.values()) for k in (1, 2, 3, 4)]))
    spare = sum(e[min(x, 3)] for x in left.values()) / len(pairs) if pairs else 1.0

    def chance(c, w):
        p = spare / (v + 1) + (max(left[w] - e[min(left[w], 3)], 0) / len(pairs) if w in left else 0)
        if c not in after:
            return p
        total, k = sum(after[c]), pairs.get((c, w), 0)
        return max(k - d[min(k, 3)], 0) / total + sum(d[min(x, 3)] for x in after[c]) / total * p

    result = []
    for i, text in rows:
        sequence = tokens(text)
        base = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in sequence)
        steps = zip([b"\x00 start", *sequence], sequence, strict=False)
        score = sum(math.log10(chance(c, w)) for c, w in steps)
        result.append((i, len(sequence), sum(w in words for w in sequence), n, base, score))
    every = [chance(c, w) for c in list(after)[:3] for w in words]
    return result, every, len(words)


def check(spark, training, rows):
    found = lm.fit(frame(spark, training)).score(frame(spark, rows)).collect()
    expected, _, _ = brute(training, rows)
    order = lambda r: (r[0] is None, r)
    for got, want in zip(sorted(map(tuple, found), key=order), sorted(expected, key=order), strict=True):
        assert got[:4] == want[:4]
        assert np.allclose(got[4:], want[4:], rtol=1e-9, atol=1e-12)


def test_scores_equal_brute_force(spark):
    texts = [f"the cat {i % 3} sat on the mat {i % 5} and the dog {i % 2} ran" for i in range(60)]
    training = [(i, t) for i, t in enumerate(texts)] + odd_rows()
    check(spark, training, odd_rows() + [(100, "the unknown cat sat"), (101, "Unseen Words only")])


def test_little_or_no_training(spark):
    check(spark, [(1, "one")], [(1, "one"), (2, "two"), (3, None)])
    check(spark, [(1, None)], [(1, "one"), (3, "")])
    found = lm.fit(frame(spark, [])).score(frame(spark, [(1, PROSE), (2, None)])).collect()
    assert all(r.base_score == 0 and r.score == 0 and r.n_known == 0 and r.train_tokens == 0 for r in found)


@pytest.mark.parametrize("table", ["word", "pair", "context", "left"])
@pytest.mark.parametrize("harm", ["removed", "shortened", "changed"])
def test_a_file_that_differs_is_an_error(spark, table, harm):
    model = lm.fit(frame(spark, [(i, f"the cat {i} sat on the mat") for i in range(40)]))
    name = next(n for n, (entries, _) in sorted(model.manifest.files.items()) if n.startswith(table) and entries > 1)
    path = Path(model.manifest.folder, f"{name}.npy")
    values = np.load(path)
    if harm == "removed":
        path.unlink()
    else:
        np.save(path, values[:-1] if harm == "shortened" else values + 1)
    lm._table.cache_clear()
    with pytest.raises(PythonException, match="is not"):
        model.score(frame(spark, [(1, "the cat 7 sat")])).collect()


def test_paths_without_a_scheme_lie_in_the_default_file_system(spark):
    assert lm.qualified(spark, "/models").startswith("file:/")
    assert lm.shared_folder(lm.qualified(spark, "/models")) == "/models"
    with pytest.raises(ValueError, match="hdfs"):
        lm.shared_folder("hdfs://name/models")


def test_chances_sum_to_one():
    training = [(i, f"a b c {i % 4} a b {i % 7}") for i in range(30)]
    _, every, v = brute(training, [])
    sums = np.array(every).reshape(3, v).sum(axis=1)
    assert ((sums < 1) & (sums > 0.8)).all()  # the rest is for the unknown word


def test_blocks_and_hashes_are_inverted():
    values = np.random.default_rng(1).integers(0, 2**63, 1000, dtype=np.uint64)
    assert (lm.unmix(mix(values)) == values).all()
    assert (lm.unpack(lm.pack(values), 1000, np.uint64) == values).all()
