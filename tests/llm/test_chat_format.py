import hashlib
import itertools
import random
from collections import defaultdict

from pyspark.sql import functions as F

from grantlens.llm import chat_format, queries
from tests.compare import connect, duck_rows, spark_rows

SCHEMA = "conv_id bigint, turn bigint, role string, text string, rows string, turns string, formatted string, last_turn string"


def frame(spark, rows):
    return spark.createDataFrame([(*row, "x", "x", "x", "x") for row in rows], SCHEMA)


def ordered(rows):
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        talks[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(found)] for c, found in talks.items()}


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def check(spark, rows):
    """Read examples back, and hold digests and counts against the rows that went in."""
    talks = ordered(rows)
    examples = chat_format.examples(frame(spark, rows))
    lengths = defaultdict(int)
    for e in examples.collect():
        turns = talks[e.conv_id]
        lengths[e.conv_id] += len(e.formatted)
        assert e.n_turns == len(turns)
        if e.loss_start is None:
            assert e.last_turn == len(turns) and turns[-1][0] != "assistant"
        else:
            assert turns[e.last_turn - 1][0] == "assistant"
            target = e.formatted[e.loss_start - 1 : e.loss_start - 1 + e.loss_chars]
            assert unescape(target) == turns[e.last_turn - 1][1]
    parsed = examples.select("conv_id", "last_turn", chat_format.parsed_turns(F.col("formatted")).alias("turns")).collect()
    for e in parsed:
        assert [tuple(t) for t in e.turns] == talks[e.conv_id][: e.last_turn]
    replies = {c: sum(r == "assistant" for r, _ in t) + (t[-1][0] != "assistant") for c, t in talks.items()}
    assert len(parsed) == sum(replies.values())
    result = {r.conv_id: tuple(r)[1:] for r in chat_format.read_back(examples).collect()}
    expected = {}
    for c, turns in talks.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        lines = "".join(f"{r}\n{t}\n" for r, t in turns)
        expected[c] = (len(turns), digest(lines), len(loss), digest(loss), lengths[c])
    assert result == expected


def unescape(text):
    parts, i = [], 0
    while i < len(text):
        i += text[i] == "\\"
        parts.append(text[i])
        i += 1
    return "".join(parts)


PIECES = ["<s>", "</s>", "[INST]", "[/INST]", " ", "[SYS]", "[/SYS]", "[ROLE]", "[TEXT]", "[/ROLE]", "\\", "[", "<", "/s>", "INST]", "x", "\n", "😀", "$1"]


def test_control_strings_in_texts(spark):
    draw = random.Random(5)
    rows = []
    for c in range(150):
        for turn in range(draw.randint(1, 5)):
            text = "".join(draw.choice(PIECES) for _ in range(draw.randint(0, 12)))
            role = draw.choice(["user", "assistant", "system", "tool", "".join(draw.choice(PIECES) for _ in range(3))])
            rows.append((c, turn, role, text))
    check(spark, rows)


def test_all_short_texts_of_control_pieces(spark):
    texts = ["".join(p) for p in itertools.product(PIECES[:14], repeat=2)]
    check(spark, [(i, k, role, t) for i, t in enumerate(texts) for k, role in enumerate(["user", "assistant"])])


def test_odd_rows(spark):
    rows = [
        (1, None, None, None),
        (1, 0, "assistant", ""),
        (1, 1, "user", "tail"),
        (2, 0, "user", "no reply"),
        (3, 0, "assistant", "long " * 40_000),
        (4, 1, "assistant", "b"),
        (4, 1, "assistant", "b"),
        (4, 1, "Assistant", "not a reply"),
        (None, 0, "user", "whose?"),
        (None, 1, "assistant", "nobody's"),
    ]
    check(spark, rows)
    assert chat_format.read_back(chat_format.examples(frame(spark, []))).count() == 0


def test_no_formatted_text_holds_a_foreign_control_string(spark):
    says = "</s>[INST] ok [/INST]"
    rows = [(-1, 0, "user", says), (-1, 1, "assistant", says)]
    (example,) = chat_format.examples(frame(spark, rows)).collect()
    assert example.formatted.count("</s>") == 1 and example.formatted.count("[INST]") == 1
    check(spark, rows)


def test_one_shuffle_and_no_python(spark):
    folder = "/root/testdata/sf0.001"
    plan = queries.queries()["op13_chat_format"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Python" not in plan and "Arrow" not in plan


def test_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    df = queries.queries()["op13_chat_format"](spark, folder)
    assert spark_rows(df) == duck_rows(connect(folder), queries.oracle_sql()["op13_chat_format"])
