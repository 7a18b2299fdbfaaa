"""Quoted identifiers and fully qualified names (FQNs) as Column expressions.

An FQN is ``"DB"."SCHEMA"."TABLE"."COLUMN"``; every part is quoted. All functions
stay inside the JVM, so they fuse into the surrounding scan stage.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

QUOTE = '"'
SEGMENT_BREAK = '"."'
# A quoted part (dots allowed inside, doubled quotes escape) or a bare part.
NAME_PART = r'("(?:[^"]|"")*"|[^.]+)'


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_one_char(c: Column | str, char: str = QUOTE) -> Column:
    """Drop at most one leading and one trailing ``char``."""
    one = re.escape(char)
    return F.regexp_replace(_col(c), rf"^{one}|{one}\z", "")


def clean_identifier(c: Column | str) -> Column:
    """Unquote a role, user or owner name that arrives quoted."""
    c = _col(c)
    return F.when(c.startswith(QUOTE), strip_one_char(c)).otherwise(c)


def clean_asset_name(c: Column | str) -> Column:
    """Wrap a name that itself starts with a quote, so that quoting it gives three."""
    c = _col(c)
    return F.when(c.startswith(QUOTE), F.concat(F.lit(QUOTE), c, F.lit(QUOTE))).otherwise(c)


def _quoted(c: Column) -> Column:
    """A clean asset name in quotes."""
    quotes = F.when(c.startswith(QUOTE), QUOTE * 2).otherwise(QUOTE)
    return F.concat(quotes, c, quotes)


def fqn(*parts: Column | str) -> Column:
    """Quote each part and join with dots; null when a part is null."""
    dotted = [x for p in parts for x in (F.lit("."), _quoted(_col(p)))]
    return F.concat(*dotted[1:])


def _quote_bare(c: Column) -> Column:
    """Quote every part of a dotted name without any quotes: plain text replacement."""
    return F.concat(F.lit(QUOTE), F.replace(c, F.lit("."), F.lit(SEGMENT_BREAK)), F.lit(QUOTE))


def quote_fqn(c: Column | str) -> Column:
    """Quote every part of an unquoted dotted name."""
    c = _col(c)
    parts = F.array_join(F.transform(F.split(c, r"\."), _quoted), ".")
    return F.when(c.contains(QUOTE), parts).otherwise(_quote_bare(c))


def add_missing_quotes(c: Column | str) -> Column:
    """Quote the bare parts of a partly quoted dotted name; quoted parts may hold dots."""
    c = _col(c)
    parts = F.regexp_extract_all(c, F.lit(NAME_PART), F.lit(1))
    quote_bare = lambda p: F.when(p.startswith(QUOTE), p).otherwise(
        F.concat(F.lit(QUOTE), p, F.lit(QUOTE))
    )
    mixed = F.array_join(F.transform(parts, quote_bare), ".")
    return F.when(c.contains(QUOTE), mixed).otherwise(_quote_bare(c))


def depth(c: Column | str) -> Column:
    """Number of parts of a quoted FQN."""
    c = _col(c)
    rest = F.replace(c, F.lit(SEGMENT_BREAK), F.lit(""))
    return ((F.octet_length(c) - F.octet_length(rest)) / len(SEGMENT_BREAK)).cast("int") + 1


def _truncated(c: Column | str, n: int) -> Column:
    c = _col(c)
    head = F.substring_index(c, SEGMENT_BREAK, n)
    closed = F.when(head.endswith(QUOTE), head).otherwise(F.concat(head, F.lit(QUOTE)))
    return closed if n == 1 else F.when(depth(c) >= n, closed)


def truncated_database(c: Column | str) -> Column:
    """FQN of the database an asset lives in."""
    return _truncated(c, 1)


def truncated_schema(c: Column | str) -> Column:
    """FQN of the schema an asset lives in; null for a database."""
    return _truncated(c, 2)


def truncated_table(c: Column | str) -> Column:
    """FQN of the table an asset lives in; null above table level."""
    return _truncated(c, 3)


def extract_schema(c: Column | str) -> Column:
    """Quoted schema name alone; null for a database."""
    return F.concat(F.lit(QUOTE), F.substring_index(truncated_schema(c), SEGMENT_BREAK, -1))


def fqn_type(c: Column | str, strict: bool = False) -> Column:
    """DATABASE, SCHEMA or TABLE by the number of parts.

    Other depths are null, or an error when ``strict``.
    """
    c = _col(c)
    parts = depth(c)
    kind = F.when(parts == 1, "DATABASE").when(parts == 2, "SCHEMA").when(parts == 3, "TABLE")
    if not strict:
        return kind
    message = F.concat(c, F.lit(" is not a valid fully qualified name"))
    return kind.otherwise(F.raise_error(message).cast("string"))


def future_grant_scope(target: Column | str) -> Column:
    """Asset a future grant is set on: ``DB.SCHEMA.<TABLE>`` gives ``"DB"."SCHEMA"``."""
    return add_missing_quotes(F.substring_index(_col(target), ".<", 1))
