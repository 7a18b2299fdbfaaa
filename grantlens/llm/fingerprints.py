"""Document fingerprints: invertible Bloom lookup tables over hashed paragraphs.

Paragraphs are lines, cut into pieces of ``LEAST_WORDS`` to ``PIECE_WORDS`` words. A piece ends with the first word
that may end one by its last character, so that cuts fall in the same places after words were put in
or taken out; without such a word it has ``PIECE_WORDS`` words, or what is left of the line. Each different one has a 64-bit digest, which goes
to three cells of a table; a cell holds a count, the XOR of its digests and the XOR of their check
sums. Two tables subtract cell by cell; what both have is gone, cells with one digest left give it
away, and taking it from its other cells frees more (peeling). Where peeling ends early, the digests are
dealt to as many tables as hold them with ease, and any of those that still fails is made again with
twice the cells and other hashes, ``TRIES`` times; should the last one fail too, its few digests are compared
as lists, so that every count is exact. The likeness of two texts is the share of digests in common, from the
digests recovered.

All of it is built-in expressions within the row. The next document's text comes by a window over short
ranges of ids, so that each text is shuffled once.

Rows: every document once per input row. Null text is empty. A text without paragraphs is like any other
one without (1.0), unlike the rest (0.0). Rows with one doc_id follow each other in the order of their
texts; rows without one come last. A single row follows itself. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grantlens.workspace import Stage, Workspace

LEAST_WORDS = 5
PIECE_WORDS = 12

# Last characters of words that may end a piece: ASCII letters, digits and marks with codes of 3 modulo 4.
ENDS = "".join(chr(c) for c in range(ord("!"), 127) if c % 4 == 3 and chr(c) not in "[]\\^-")

_WORD = r"[^ \t\r\n]"
PIECE = (
    rf"(?:{_WORD}++[ \t]++){{{LEAST_WORDS - 1},{PIECE_WORDS - 1}}}?{_WORD}*[{ENDS}](?!{_WORD})"
    rf"|{_WORD}++(?:[ \t]++{_WORD}++){{0,{PIECE_WORDS - 1}}}"
)

# Cells of a fingerprint, and of each table that digests are dealt to: three groups, one cell in each.
CELLS = 24
DEALT_CELLS = 30

# Names of the groups of cells, one letter each.
GROUPS = "abc"

# Digests of both texts in one table, about, where they are dealt to several.
DEALT = 12

# Times that a table is made anew, each with twice the cells.
TRIES = 9

# Rounds of peeling; tables that need more count as failed and are made anew, larger.
ROUNDS = 12

# Rows per range of ids, about, and ranges that are broadcast at most.
RANGE_ROWS = 512
BROADCAST_ROWS = 1_000_000


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` a value that is computed once."""
    return F.transform(F.array(value), lambda v: use(v))[0]


def digests(text: Column) -> Column:
    """The different 64-bit digests of a text's paragraphs."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE), F.lit(0))
    return F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p)))


def _field(value: Column, place: int) -> Column:
    """20 bits of a 64-bit number."""
    return F.shiftrightunsigned(value, place).bitwiseAND(F.lit(0xFFFFF))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit("check")).bitwiseAND(F.lit(0xFFFFFFFF))


def _entries(items: Column, third: Column, seed: Column, key=lambda i: i, count=lambda i: F.lit(1)) -> Column:
    """What goes into the cells: count, key, check and the key's cell in each group (a, b, c)."""

    def entry(item: Column, h: Column) -> Column:
        k = key(item)
        return F.struct(
            count(item).cast("int").alias("n"),
            k.alias("k"),
            _check(k).alias("h"),
            *[((_field(h, 20 * g) % third).cast("int") + (third * g).cast("int")).alias(GROUPS[g]) for g in range(3)],
        )

    # Two passes rather than a value kept for each item: what is kept is copied.
    return F.zip_with(items, F.transform(items, lambda i: F.xxhash64(key(i), seed)), entry)


def _into(cell: Column, place: Column, entries: Column, sign: int, groups: str = GROUPS) -> Column:
    """A cell of one of the groups after adding (1) or taking away (-1) the entries that belong to it."""
    # A place is of one group only, so that places of other groups never equal it.
    own = F.filter(entries, lambda e: reduce(or_, [e[group] == place for group in groups]))
    return F.aggregate(
        own,
        cell,
        lambda c, e: F.struct(
            (c["n"] + e["n"] if sign > 0 else c["n"] - e["n"]).alias("n"), c["k"].bitwiseXOR(e["k"]).alias("k"), c["h"].bitwiseXOR(e["h"]).alias("h")
        ),
    )


def _filled(entries: Column, third: Column) -> Column:
    """The cells of a table that holds the entries."""
    empty = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("h"))

    def of(g: int, e: Column) -> Column:
        places = F.sequence((third * g).cast("int"), (third * (g + 1) - 1).cast("int"))
        return F.transform(places, lambda j: _into(empty, j, e, 1, GROUPS[g]))

    return _let(entries, lambda e: F.concat(*[of(g, e) for g in range(3)]))


def table(keys: Column, third: Column, seed: Column) -> Column:
    """The cells of a table of three times ``third`` cells."""
    return _filled(_entries(keys, third, seed), third)


def difference_table(left: Column, right: Column, third: Column, seed: Column) -> Column:
    """What ``subtract`` gives for the tables of two lists: the right one's digests go in with count -1."""
    against = _entries(right, third, seed, count=lambda _: F.lit(-1))
    return _filled(F.concat(_entries(left, third, seed), against), third)


def subtract(left: Column, right: Column) -> Column:
    return F.zip_with(
        left,
        right,
        lambda a, b: F.struct(
            (a["n"] - b["n"]).alias("n"), a["k"].bitwiseXOR(b["k"]).alias("k"), a["h"].bitwiseXOR(b["h"]).alias("h")
        ),
    )


def peel(cells: Column, third: Column, seed: Column) -> Column:
    """Recover the digests of a difference: ok, and how many only the left and only the right has."""
    none = F.lit(0)
    start = F.struct(cells.alias("cells"), none.alias("left"), none.alias("right"), F.lit(False).alias("done"))

    def left_of(cells: Column, g: int, e: Column) -> Column:
        """The cells of a group without the entries."""
        first = (third * g).cast("int")
        return _let(
            F.transform(e, lambda x: x[GROUPS[g]] - first),
            lambda touched: F.transform(
                F.slice(cells, first + 1, third.cast("int")),
                lambda c, j: F.when(F.array_contains(touched, j), _into(c, first + j, e, -1, GROUPS[g])).otherwise(c),
            ),
        )

    def step(state: Column) -> Column:
        pure = F.filter(state["cells"], lambda c: (F.abs(c["n"]) == 1) & (c["h"] == _check(c["k"])))

        def fresh(pure: Column) -> Column:
            # Distinct as plain numbers: structs would be compared pair by pair.
            def keys(sign: int) -> Column:
                return F.array_distinct(F.transform(F.filter(pure, lambda c: c["n"] == sign), lambda c: c["k"]))

            return F.struct(keys(1).alias("left"), keys(-1).alias("right"))

        def take(found: Column) -> Column:
            entries = F.concat(
                _entries(found["left"], third, seed), _entries(found["right"], third, seed, count=lambda _: F.lit(-1))
            )
            rest = _let(entries, lambda e: F.concat(*[left_of(state["cells"], g, e) for g in range(3)]))
            return F.struct(
                rest.alias("cells"),
                (state["left"] + F.size(found["left"])).alias("left"),
                (state["right"] + F.size(found["right"])).alias("right"),
                F.lit(False).alias("done"),
            )

        ended = F.struct(state["cells"].alias("cells"), state["left"].alias("left"), state["right"].alias("right"), F.lit(True).alias("done"))
        peeled = _let(pure, lambda p: F.when(F.size(p) == 0, ended).otherwise(_let(fresh(p), take)))
        return F.when(state["done"], state).otherwise(peeled)

    ended = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda state, _: step(state))
    return _let(
        ended,
        lambda s: F.struct(
            F.forall(s["cells"], lambda c: (c["n"] == 0) & (c["k"] == 0) & (c["h"] == 0)).alias("ok"),
            s["left"].alias("left"),
            s["right"].alias("right"),
        ),
    )


def _retried(left: Column, right: Column) -> Column:
    """The difference of two lists of digests by tables that grow until one peels."""
    empty = F.size(left) + F.size(right) == 0
    none = F.struct(empty.alias("ok"), F.lit(0).alias("left"), F.lit(0).alias("right"))

    def attempt(number: Column) -> Column:
        third = (F.lit(DEALT_CELLS // 3) * F.pow(F.lit(2), number - 1)).cast("int")
        return _let(
            third,
            lambda t: peel(difference_table(left, right, t, number), t, number),
        )

    tried = F.aggregate(
        F.sequence(F.lit(1), F.lit(TRIES)), none, lambda s, number: F.when(s["ok"], s).otherwise(attempt(number))
    )
    listed = F.struct(
        F.lit(True).alias("ok"),
        F.size(F.array_except(left, right)).alias("left"),
        F.size(F.array_except(right, left)).alias("right"),
    )
    return _let(tried, lambda s: F.when(s["ok"], s).otherwise(listed))


def _dealt(keys: Column, outer: Column, inner: Column) -> Column:
    """Digests dealt to outer x inner lists by their bits, in two steps to keep it short of quadratic."""
    first = F.transform(
        F.sequence(F.lit(0), outer - 1), lambda r: F.filter(keys, lambda k: _field(k, 0) % outer == r)
    )
    return F.flatten(
        F.transform(
            first,
            lambda part: F.transform(
                F.sequence(F.lit(0), inner - 1), lambda s: F.filter(part, lambda k: _field(k, 20) % inner == s)
            ),
        )
    )


def _differences(left: Column, right: Column) -> Column:
    """How many digests only the left and only the right list has, from several tables."""
    n = F.greatest(F.lit(1), F.ceil((F.size(left) + F.size(right)) / F.lit(float(DEALT))))
    outer = F.ceil(F.sqrt(n)).cast("int")
    sides = F.struct(outer.alias("outer"), F.ceil(n / outer).cast("int").alias("inner"))
    parts = _let(
        sides,
        lambda s: F.zip_with(
            _dealt(left, s["outer"], s["inner"]), _dealt(right, s["outer"], s["inner"]), lambda a, b: _retried(a, b)
        ),
    )
    none = F.struct(F.lit(0).alias("left"), F.lit(0).alias("right"))
    return F.aggregate(
        parts,
        none,
        lambda s, p: F.struct((s["left"] + p["left"]).alias("left"), (s["right"] + p["right"]).alias("right")),
    )


def _first_table(keys: Column) -> Column:
    return table(keys, F.lit(CELLS // 3), F.lit(0))


def likeness(left: Column, left_cells: Column, right: Column, right_cells: Column) -> Column:
    """Share of digests in common, from 0 to 1. The fingerprints' cells are tried first."""
    first = peel(subtract(left_cells, right_cells), F.lit(CELLS // 3), F.lit(0))
    found = _let(
        first,
        lambda p: F.when(p["ok"], F.struct(p["left"].alias("left"), p["right"].alias("right"))).otherwise(
            _differences(left, right)
        ),
    )
    union = lambda d: F.size(left) + d["right"]
    return _let(
        found,
        lambda d: F.when(union(d) == 0, F.lit(1.0)).otherwise((F.size(left) - d["left"]) / union(d)),
    ).cast("double")


def fingerprint_text(keys: Column, cells: Column) -> Column:
    """A fingerprint as text: the number of digests, then each cell in hex."""
    parts = F.transform(
        cells,
        lambda c: F.concat(
            F.lpad(F.hex(c["n"]), 4, "0"), F.lpad(F.hex(c["k"]), 16, "0"), F.lpad(F.hex(c["h"]), 8, "0")
        ),
    )
    return F.lower(F.concat(F.lpad(F.hex(F.size(keys)), 8, "0"), F.array_join(parts, "")))


# --- the next document -------------------------------------------------------------------


def _range_bits(ids: DataFrame) -> int:
    """Ranges of 2 ** bits ids hold about RANGE_ROWS rows where ids lie closest together, fewer elsewhere."""
    marks = ids.agg(
        F.count("doc_id").alias("n"),
        F.percentile_approx("doc_id", [k / 100 for k in range(101)], 1000).alias("at"),
    ).first()
    at = marks["at"] or []
    gaps = [b - a for a, b in zip(at, at[1:], strict=False) if b > a]
    spacing = max(1.0, min(gaps) * 100 / marks["n"]) if gaps else 1.0
    return min(62, int(spacing * RANGE_ROWS).bit_length() - 1)


def _heads(workspace: Workspace, ids: DataFrame) -> Stage:
    """For each range of ids (span): its highest id (top) and the range before it, descending (into).

    The range before the first is the last one.
    """
    ranges = workspace.stage(ids.groupBy("span").agg(F.max("doc_id").alias("top")), "fingerprint_ranges")
    pieces = ranges.rows // 100_000 + 1
    ordered = ranges.df.repartitionByRange(pieces, F.desc_nulls_last("span"))
    ordered = workspace.stage(ordered.withColumn("piece", F.spark_partition_id()), "fingerprint_order").df
    above = F.lag("span").over(Window.partitionBy("piece").orderBy(F.desc("span")))
    edges = ordered.groupBy("piece").agg(F.min("span").alias("last"))  # a row per piece
    edges = edges.select(
        "piece",
        F.lag("last").over(Window.orderBy("piece")).alias("above_piece"),
        F.min("last").over(Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("lowest"),
    )
    linked = ordered.withColumn("above", above).join(edges, "piece")
    into = F.coalesce("above", "above_piece", "lowest").alias("into")
    return workspace.stage(linked.select(F.col("span").alias("own"), into, "top"), "fingerprint_heads")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, keys and cells of every row, with those of the next row by descending doc_id.

    Ranges of ids are small groups of rows, dealt by hash. The first rows of each range are copied into
    the range before it, where they follow the last one. After the last row of all comes the first.
    """
    workspace = Workspace(docs.sparkSession)
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    ids = docs.select(doc_id)
    bits = _range_bits(ids)
    lowest = ids.agg(F.min("doc_id")).first()[0]
    # Rows without an id get a range of their own below all others.
    below = F.lit((lowest >> bits) - 1 if lowest is not None else 0).cast("long")
    span = F.coalesce(F.shiftright("doc_id", bits), below)
    heads = _heads(workspace, ids.withColumn("span", span))
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    rows = docs.select(doc_id, text).withColumn("span", span)
    own = F.broadcast(heads.df) if heads.rows <= BROADCAST_ROWS else heads.df
    known = rows.join(own, F.col("span") == F.col("own"))
    places = F.when(
        F.col("doc_id").eqNullSafe(F.col("top")),
        F.array(F.struct("span", F.lit(False).alias("copy")), F.struct(F.col("into").alias("span"), F.lit(True).alias("copy"))),
    ).otherwise(F.array(F.struct("span", F.lit(False).alias("copy"))))
    copied = known.select("doc_id", "text", digests(F.col("text")).alias("keys"), F.explode(places).alias("place"))
    copied = copied.withColumn("cells", _first_table(F.col("keys")))
    order = Window.partitionBy("place.span").orderBy("place.copy", F.desc_nulls_last("doc_id"), "text")
    followed = copied.select(
        "doc_id",
        "text",
        "keys",
        "cells",
        F.col("place.copy").alias("copy"),
        F.lead("text").over(order).alias("next_text"),
        F.lead("keys").over(order).alias("next_keys"),
        F.lead("cells").over(order).alias("next_cells"),
    )
    return followed.filter("NOT copy").drop("copy")


def edited_text(text: Column, following: Column) -> Column:
    """The text with its last floor(n / 2) code points replaced by the first as many of the next one."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the next text's are."""
    rows = with_next(docs).withColumn("edited", edited_text(F.col("text"), F.col("next_text")))
    rows = rows.withColumn("edited_keys", digests(F.col("edited")))
    rows = rows.withColumn("edited_cells", _first_table(F.col("edited_keys")))

    def alike(name: str) -> Column:
        return likeness(F.col("keys"), F.col("cells"), F.col(f"{name}_keys"), F.col(f"{name}_cells"))

    return rows.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint_text(F.col("keys"), F.col("cells")).alias("fingerprint"),
        fingerprint_text(F.col("edited_keys"), F.col("edited_cells")).alias("edited_fingerprint"),
        alike("edited").alias("near_edited"),
        alike("next").alias("near_next"),
    )
