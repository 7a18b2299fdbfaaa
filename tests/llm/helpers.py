"""Documents with everything that may go wrong in them."""

from __future__ import annotations

# Extra columns whose names operators use themselves.
CLASHES = ("score", "id", "key", "keys", "shard", "size", "row", "span", "run", "kept", "features", "n", "edited", "a")

PROSE = "The quick brown fox jumps over the lazy dog, and then it rests under a tree.\nNobody knows why it does so."


def frame(spark, rows, extra=CLASHES):
    """(doc_id, text) rows with the other columns of documents and clashing ones."""
    names = ["doc_id", "text", "lang", "source", "n_chars", *extra]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    schema += "".join(f", {name} string" for name in extra)
    data = [(i, t, "en", "src0", None if t is None else len(t), *["x"] * len(extra)) for i, t in rows]
    return spark.createDataFrame(data, schema).select(*names)


def odd_rows():
    long_text = " ".join(f"word{i % 977} part{i}" for i in range(30_000))
    return [
        (1, PROSE),
        (2, None),
        (3, ""),
        (4, " \n\t "),
        (5, long_text),
        (6, PROSE),
        (7, "x" * 3000),
        (8, "Ünïcode 😀 日本語 ß ▁ tab\tend"),
        (9, PROSE + " More words follow here."),
        (9, PROSE + " More words follow here."),
        (None, "A row without an id."),
    ]
