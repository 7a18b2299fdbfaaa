import random
import re
import zlib
from collections import Counter

from grantlens.llm import queries, spelling
from grantlens.workspace import Workspace
from tests.compare import connect, duck_rows, spark_rows
from tests.llm.helpers import frame, odd_rows


def edits(a, b):
    """Whether b is a with one letter less, more, or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) == 1:
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))
    return len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1


def brute(rows, damage=None):
    found = Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    words = {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in words if v != w and edits(v, w)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    result = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        result[w] = (form[w], root, words[w], len(near[w]), words.get(form[w]))
    return result


def found(spark, rows, damage=None):
    result = spelling.spelling_variants(frame(spark, rows, ("n", "word", "size", "rest", "run")), damage).collect()
    assert len(result) == len({r.word for r in result})
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in result}


def misspelt(seed, alphabet="abÀÿ", n=500):
    """Texts of a few words and their misspellings over a small alphabet, so that most are near others."""
    draw = random.Random(seed)
    words = ["".join(draw.choice(alphabet) for _ in range(draw.randint(7, 12))) for _ in range(25)]
    rows = []
    for i in range(n):
        text = []
        for _ in range(20):
            word = draw.choice(words[:3] if draw.random() < 0.7 else words)
            if draw.random() < 0.1:
                k = draw.randrange(len(word))
                word = word[:k] + draw.choice(["", "x", word[k] * 2]) + word[k + draw.randint(0, 1) :]
            text.append(word.upper() if draw.random() < 0.1 else word)
        rows.append((i, " ".join(text)))
    return rows


def test_equals_brute_force(spark):
    rows = misspelt(1)
    expected = brute(rows, 31)
    assert sum(f is not None for f, *_ in expected.values()) > 30
    assert max(n_near for *_, n_near, _ in expected.values()) > 5
    assert found(spark, rows, 31) == expected
    assert found(spark, rows) == brute(rows)


def test_only_ascii_is_lowered(spark):
    rows = [(1, "ÀBCDEFGH àbcdefgh àBCDEFGH"), (2, "abcdefg's abcdefg1abcdefg")]
    assert found(spark, rows) == {"àbcdefgh": (None, "àbcdefgh", 2, 0, None), "abcdefg": (None, "abcdefg", 3, 0, None)}


def test_forms_of_forms_and_ties(spark):
    words = {"aaaaaaaa": 2, "aaaaaaab": 20, "aaaaaabb": 200, "aaaaabbb": 2000, "baaaaaaa": 20, "ccccccc": 7, "cccccccc": 70}
    frame_of = spark.createDataFrame(list(words.items()), "word string, n bigint")
    workspace = Workspace(spark)
    staged = workspace.stage(frame_of, "words")
    rows = {r.word: (r.form, r.root, r.n_near, r.form_n) for r in spelling.variants(staged, workspace).collect()}
    assert rows["aaaaaaaa"] == ("aaaaaaab", "aaaaabbb", 2, 20)  # the smaller of two equally frequent ones
    assert rows["aaaaaaab"] == ("aaaaaabb", "aaaaabbb", 2, 200)
    assert rows["aaaaabbb"] == (None, "aaaaabbb", 1, None)
    assert rows["ccccccc"] == ("cccccccc", "cccccccc", 1, 70)


def test_every_place_of_an_edit(spark):
    """Insertions, deletions and replacements anywhere, in words of every length, also beside equal letters."""
    pairs = []
    for size in (7, 8, 9, 10, 11, 14):
        for word in ("abcdefghijklmnop"[:size], "a" * size, "aabbccddeeffgghh"[:size]):
            for k in range(size):
                pairs += [(word, word[:k] + "z" + word[k:]), (word, word[:k] + "z" + word[k + 1 :]), (word, word[:k] + word[k] + word[k:])]
            pairs.append((word, word + "z"))
    words = sorted({w for pair in pairs for w in pair})
    workspace = Workspace(spark)
    staged = workspace.stage(spark.createDataFrame([(w, 2) for w in words], "word string, n bigint"), "words")
    met = [frozenset((r.a, r.b)) for r in spelling.near_pairs(workspace, staged).df.collect()]
    assert len(met) == len(set(met))
    expected = {frozenset((a, b)) for i, a in enumerate(words) for b in words[:i] if edits(a, b)}
    assert expected == set(met)
    assert {frozenset(p) for p in pairs} <= expected


def test_odd_rows(spark):
    rows = [*odd_rows(), (None, "misspelling misspelling"), (None, "misspeling misspelling")]
    assert found(spark, rows, 31) == brute(rows, 31)
    assert found(spark, []) == {}
    assert found(spark, [(1, None), (2, "")]) == {}


def test_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    df = queries.queries()["op11_spelling"](spark, folder)
    assert spark_rows(df) == duck_rows(connect(folder), queries.oracle_sql()["op11_spelling"])
