"""License scans: sentences of a text become identifiers, and rules match sequences of identifiers.

A text is cut after sentence marks and at blank lines; what is lower-cased and freed of everything but letters and
digits is the normal form, so that quotes and comment marks do not matter. A known sentence may begin at any line
of a piece and run over several lines, if it ends where a line ends: of those that begin at a line the
longest counts, and one that begins inside another one does not. An SPDX tag is a sentence of its own, with
the whole expression; only single identifiers are known. Rules match where their identifiers stand in a row among
those found, the longest rule first, and an identifier that one rule took is gone for the others. All of
it is built-in expressions within the row: no shuffle, and no Python.

Rows: every document once per input row, also those without licences (empty strings, no rules). Null
text is empty. Repeated sentences give repeated identifiers. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence sentences, in their normal form, by identifier.
SENTENCES = {
    "apache-named": "licensed under the apache license version 2 0",
    "apache-grant": "licensed under the apache license version 2 0 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-asis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit-named": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-asis": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liable": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "gpl3-named": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-program": "this program is free software",
    "gpl3-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl2-version": "either version 2 of the license or at your option any later version",
    "gpl-useful": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl-implied": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-see": "see the gnu general public license for more details",
    "lgpl-library": "this library is free software",
    "lgpl2-terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "lgpl2-version": "either version 2 1 of the license or at your option any later version",
    "lgpl3-terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-useful": "this library is distributed in the hope that it will be useful but without any warranty",
    "lgpl-see": "see the gnu lesser general public license for more details",
    "agpl3-terms": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-see": "see the gnu affero general public license for more details",
    "mpl-subject": "this source code form is subject to the terms of the mozilla public license v",
    "mpl-copy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "mpl-copy-https": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-asis": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "isc-liable": "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-asis": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "bsd-liable": "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services",
    "bsd-loss": "loss of use data or profits",
    "bsd-advised": "or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "cc-by-nc-named": "licensed under cc by nc 4 0",
    "cc-by-named": "licensed under cc by 4 0",
    "cc-by-sa-named": "licensed under cc by sa 4 0",
    "cc-by-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc-work": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "reserved": "all rights reserved",
}

# Identifiers of SPDX tags. Each is a sentence after the tag, and a rule.
SPDX = (
    "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-NC-4.0",
    "CC-BY-SA-4.0", "CC0-1.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC",
    "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense",
)
SPDX_WORDS = "spdx license identifier"
SENTENCES |= {f"spdx-{name}": f"{SPDX_WORDS} {name.lower().replace('-', ' ').replace('.', ' ')}" for name in SPDX}

# Rules: name, licence, and identifiers in order.
RULES = (
    ("apache-2.0-notice", "Apache-2.0", ("apache-grant", "apache-comply", "apache-copy")),
    ("apache-2.0-full-notice", "Apache-2.0", ("apache-grant", "apache-comply", "apache-copy", "apache-asis", "apache-see")),
    ("apache-2.0-named", "Apache-2.0", ("apache-named",)),
    ("mit-full-text", "MIT", ("mit-grant", "mit-notice", "mit-asis", "mit-liable")),
    ("mit-text", "MIT", ("mit-grant", "mit-notice", "mit-asis")),
    ("mit-named", "MIT", ("mit-named",)),
    ("mit-licensed", "MIT", ("mit-licensed",)),
    ("gpl-3.0-notice", "GPL-3.0", ("gpl-program", "gpl3-terms", "gpl-useful", "gpl-implied", "gpl-see")),
    ("gpl-3.0-grant", "GPL-3.0", ("gpl-program", "gpl3-terms")),
    ("gpl-2.0-notice", "GPL-2.0", ("gpl-program", "gpl2-terms", "gpl2-version", "gpl-useful", "gpl-implied", "gpl-see")),
    ("gpl-2.0-grant", "GPL-2.0", ("gpl-program", "gpl2-terms", "gpl2-version")),
    # Copies that have commas or nothing in place of the colon and semicolons.
    ("gpl-3.0-uncut-notice", "GPL-3.0", ("gpl-free", "gpl-hope", "gpl-see")),
    ("gpl-3.0-uncut-grant", "GPL-3.0", ("gpl-free",)),
    ("gpl-2.0-uncut-notice", "GPL-2.0", ("gpl2-free", "gpl-hope", "gpl-see")),
    ("gpl-2.0-uncut-grant", "GPL-2.0", ("gpl2-free",)),
    ("lgpl-2.1-notice", "LGPL-2.1", ("lgpl-library", "lgpl2-terms", "lgpl2-version", "lgpl-useful", "gpl-implied", "lgpl-see")),
    ("lgpl-2.1-grant", "LGPL-2.1", ("lgpl-library", "lgpl2-terms", "lgpl2-version")),
    ("lgpl-3.0-notice", "LGPL-3.0", ("gpl-program", "lgpl3-terms", "gpl-useful", "gpl-implied", "lgpl-see")),
    ("lgpl-3.0-grant", "LGPL-3.0", ("gpl-program", "lgpl3-terms")),
    ("agpl-3.0-notice", "AGPL-3.0", ("gpl-program", "agpl3-terms", "gpl-useful", "gpl-implied", "agpl-see")),
    ("agpl-3.0-grant", "AGPL-3.0", ("gpl-program", "agpl3-terms")),
    ("mpl-2.0-notice", "MPL-2.0", ("mpl-subject", "mpl-copy")),
    ("mpl-2.0-https-notice", "MPL-2.0", ("mpl-subject", "mpl-copy-https")),
    ("isc-full-text", "ISC", ("isc-grant", "isc-asis", "isc-liable")),
    ("isc-text", "ISC", ("isc-grant", "isc-asis")),
    ("gpl-3.0-named", "GPL-3.0", ("gpl3-named",)),
    ("bsd-2-text", "BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("bsd-3-text", "BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("bsd-2-full-text", "BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-asis", "bsd-liable", "bsd-loss", "bsd-advised")),
    ("bsd-3-full-text", "BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-asis", "bsd-liable", "bsd-loss", "bsd-advised")),
    ("cc-by-nc-named", "CC-BY-NC-4.0", ("cc-by-nc-named",)),
    ("cc-by-nc-work", "CC-BY-NC-4.0", ("cc-by-nc-work",)),
    ("cc-by-named", "CC-BY-4.0", ("cc-by-named",)),
    ("cc-by-work", "CC-BY-4.0", ("cc-by-work",)),
    ("cc-by-sa-named", "CC-BY-SA-4.0", ("cc-by-sa-named",)),
    ("cc-by-sa-work", "CC-BY-SA-4.0", ("cc-by-sa-work",)),
    ("reserved", "All rights reserved", ("reserved",)),
    *((f"spdx-{name}", name, (f"spdx-{name}",)) for name in SPDX),
)

# A tag and its expression, to the end of the line.
TAG = r"spdx-license-identifier:[ \t]*([^\n]*)"
# A piece ends at these marks before white space, and at lines without letters and digits.
SENTENCE_END = r"[.!?;:][ \t\r\n]+"
NOISE = r"[^\p{L}\p{N}\n]+"
BLANK_LINE = r"\n *\n"

# Words by which sentences are looked up.
KEY_WORDS = 3


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` a value that is computed once."""
    return F.transform(F.array(value), lambda v: use(v))[0]


def _key(words: str) -> str:
    return " ".join(words.split(" ")[:KEY_WORDS])


def _longest(sentences: dict[str, str]) -> int:
    """Words of the longest sentence; it lies on so many lines at most."""
    return max(len(words.split(" ")) for words in sentences.values())


def pieces(text: Column) -> Column:
    """The pieces of a text, each a list of its lines in normal form. No line is empty."""
    tagged = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), TAG, f"\n\n{SPDX_WORDS} $1\n\n")
    plain = F.regexp_replace(F.regexp_replace(tagged, SENTENCE_END, "\n\n"), NOISE, " ")
    lines = lambda piece: F.filter(F.transform(F.split(piece, "\n"), lambda s: F.trim(s)), lambda s: s != "")
    return F.transform(F.split(plain, BLANK_LINE), lines)


def _found(lines: Column, sentences: dict[str, str]) -> Column:
    """Identifiers of the known sentences in the lines of a piece, in order."""
    longest = _longest(sentences)
    by_key: dict[str, list[tuple[str, str]]] = {}
    for name, words in sorted(sentences.items(), key=lambda item: -len(item[1])):
        by_key.setdefault(_key(words), []).append((name, words))
    table = F.create_map(
        *[
            x
            for key, known in by_key.items()
            for x in (
                F.lit(key),
                F.array(*[F.struct(F.lit(name).alias("name"), F.lit(words).alias("words")) for name, words in known]),
            )
        ]
    )

    def at_line(known: Column, start: Column) -> Column:
        """The longest sentence that begins at a line, or null."""

        def match(rest: Column) -> Column:
            fits = F.filter(
                known,
                lambda s: F.startswith(F.translate(rest, "\n", " "), s["words"])
                & F.substring(rest, F.length(s["words"]) + 1, F.lit(1)).isin("", "\n"),
            )
            within = lambda s: F.substring(rest, F.lit(1), F.length(s["words"]))
            n_lines = lambda s: F.size(F.split(within(s), "\n"))
            return F.transform(
                F.slice(fits, 1, 1),
                lambda s: F.struct(s["name"].alias("name"), start.alias("start"), (start + n_lines(s)).alias("end")),
            )

        return _let(F.array_join(F.slice(lines, start + 1, longest), "\n"), match)

    def begin(_: Column, k: Column) -> Column:
        key = F.substring_index(F.array_join(F.slice(lines, k + 1, KEY_WORDS), " "), " ", KEY_WORDS)
        return F.struct(k.alias("start"), table[key].alias("known"))

    begun = F.filter(F.transform(lines, begin), lambda b: b["known"].isNotNull())
    hits = F.flatten(F.transform(begun, lambda b: at_line(b["known"], b["start"])))

    def outermost(found: Column) -> Column:
        # No more hits than lines of one sentence can lie between a hit and another one that holds it.
        before = lambda k: F.slice(found, F.greatest(F.lit(1), k - longest + 1), F.least(k, F.lit(longest)))
        kept = F.filter(found, lambda hit, k: ~F.exists(before(k), lambda other: other["end"] > hit["start"]))
        return F.transform(kept, lambda hit: hit["name"])

    return _let(hits, outermost)


def sentence_ids(text: Column, sentences: dict[str, str] = SENTENCES) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    return F.flatten(F.transform(pieces(text), lambda lines: _found(lines, sentences)))


def _by_length(rules):
    """Rules in the order in which they match: the longest first, equally long ones as listed."""
    return sorted(rules, key=lambda rule: -len(rule[2]))


def _sequence(names) -> str:
    return "".join(f"<{name}>" for name in names)


def matched_rules(ids: Column, rules=RULES) -> Column:
    """Names of the rules whose identifiers stand in a row in ``ids``, the longest first; each identifier counts once."""
    chain = F.concat(F.lit("<"), F.array_join(ids, "><"), F.lit(">"))
    start = F.struct(chain.alias("chain"), F.array().cast("array<string>").alias("names"))
    ordered = F.array(
        *[F.struct(F.lit(name).alias("name"), F.lit(_sequence(seq)).alias("seq")) for name, _, seq in _by_length(rules)]
    )
    # What a rule took becomes a bar, so that nothing matches across it.
    step = lambda s, rule: F.when(
        F.contains(s["chain"], rule["seq"]),
        F.struct(
            F.replace(s["chain"], rule["seq"], F.lit("|")).alias("chain"),
            F.concat(s["names"], F.array(rule["name"])).alias("names"),
        ),
    ).otherwise(s)
    nothing = F.array().cast("array<string>")
    return F.when(F.size(ids) == 0, nothing).otherwise(F.aggregate(ordered, start, step, lambda s: s["names"]))


def scan(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules=RULES) -> DataFrame:
    """doc_id, the identifiers found, the rules matched and their licences, for every document."""
    licence = F.create_map(*[F.lit(x) for name, spdx, _ in rules for x in (name, spdx)])
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), sentence_ids(F.col("text"), sentences).alias("ids"))
    ruled = found.withColumn("rules", matched_rules(F.col("ids"), rules))
    spdx = F.array_sort(F.array_distinct(F.transform("rules", lambda name: licence[name])))
    return ruled.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_sentences"),
        F.array_join("ids", ">").alias("sentence_ids"),
        F.array_join("rules", ",").alias("rules"),
        F.array_join(spdx, ",").alias("licenses"),
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def scan_sql(sentences: dict[str, str] = SENTENCES, rules=RULES) -> str:
    """The same rows in plain SQL."""
    names = ", ".join(f"({_quoted(words)}, {_quoted(name)}, {_quoted(_key(words))})" for name, words in sentences.items())
    ordered = _by_length(rules)
    named = ", ".join(f"({k}, {_quoted(name)}, {_quoted(spdx)})" for k, (name, spdx, _) in enumerate(ordered))
    steps = "".join(
        f", replace(c{k}, {_quoted(_sequence(seq))}, '|') AS c{k + 1}" for k, (_, _, seq) in enumerate(ordered)
    )
    taken = ", ".join(f"CASE WHEN c{k} <> c{k + 1} THEN {k} END" for k in range(len(ordered)))
    longest = _longest(sentences)
    return f"""
    WITH known(words, name, key) AS (VALUES {names}),
    rule(k, name, spdx) AS (VALUES {named}),
    cut AS (
        SELECT row_number() OVER () AS r, doc_id, string_split_regex(regexp_replace(regexp_replace(regexp_replace(
            lower(coalesce(text, '')), '{TAG}', chr(10) || chr(10) || '{SPDX_WORDS} \\1' || chr(10) || chr(10), 'g'),
            '{SENTENCE_END}', chr(10) || chr(10), 'g'),
            '{NOISE}', ' ', 'g'), '{BLANK_LINE}') AS parts FROM documents
    ),
    piece AS (SELECT r, unnest(parts) AS part, generate_subscripts(parts, 1) AS p FROM cut),
    raw_line AS (
        SELECT r, p, unnest(string_split(part, chr(10))) AS words,
            generate_subscripts(string_split(part, chr(10)), 1) AS k FROM piece
    ),
    line AS (
        SELECT r, p, trim(words) AS words, row_number() OVER (PARTITION BY r, p ORDER BY k) AS k
        FROM raw_line WHERE trim(words) <> ''
    ),
    keyed AS (
        SELECT *, array_to_string(string_split(concat_ws(' ', words, lead(words, 1) OVER w, lead(words, 2) OVER w), ' ')[1:{KEY_WORDS}], ' ') AS key
        FROM line WINDOW w AS (PARTITION BY r, p ORDER BY k)
    ),
    begun AS (SELECT r, p, k FROM keyed WHERE key IN (SELECT key FROM known)),
    rest AS (
        SELECT b.r, b.p, b.k, string_agg(l.words, chr(10) ORDER BY l.k) AS rest
        FROM begun AS b JOIN line AS l ON l.r = b.r AND l.p = b.p AND l.k >= b.k AND l.k < b.k + {longest}
        GROUP BY b.r, b.p, b.k
    ),
    hit AS (
        SELECT r, p, k, arg_max(name, length(words)) AS name, max(length(words)) AS n, any_value(rest) AS rest
        FROM rest JOIN known ON starts_with(replace(rest, chr(10), ' '), words)
            AND substr(rest, length(words) + 1, 1) IN ('', chr(10))
        GROUP BY r, p, k
    ),
    spanned AS (
        SELECT *, max(k + length(substr(rest, 1, n)) - length(replace(substr(rest, 1, n), chr(10), '')) + 1)
            OVER (PARTITION BY r, p ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM hit
    ),
    chain AS (
        SELECT r, count(*) AS n, string_agg(name, '>' ORDER BY p, k) AS ids, string_agg('<' || name || '>', '' ORDER BY p, k) AS c0
        FROM spanned WHERE held IS NULL OR held <= k GROUP BY r
    ),
    taking AS (SELECT r{steps} FROM chain),
    taken AS (SELECT r, unnest([{taken}]) AS k FROM (SELECT chain.r, c0, taking.* EXCLUDE (r) FROM chain JOIN taking USING (r))),
    matched AS (
        SELECT r, string_agg(name, ',' ORDER BY k) AS rules, string_agg(DISTINCT spdx, ',' ORDER BY spdx) AS licenses
        FROM taken JOIN rule USING (k) GROUP BY r
    )
    SELECT doc_id, coalesce(n, 0) AS n_sentences, coalesce(ids, '') AS sentence_ids,
        coalesce(rules, '') AS rules, coalesce(licenses, '') AS licenses
    FROM cut LEFT JOIN chain USING (r) LEFT JOIN matched USING (r)
    """
