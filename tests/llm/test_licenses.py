import re

import duckdb

from grantlens.llm import licenses
from tests.llm.helpers import frame, odd_rows

MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
    "to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions "
    'of the Software.\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING '
    "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
)


def rows():
    notice = MIT.split("\n")
    return odd_rows() + [
        (20, "Some prose. Released under the MIT License. More prose."),
        (21, f"Title\n{MIT}\nEnd"),
        (22, "\n".join([notice[2], notice[0]])),  # out of order: identifiers, but no rule
        (23, "All rights reserved.\nLicensed under CC BY-NC 4.0.\nAll rights reserved."),
        (24, "All rights were reserved."),
    ]


def test_rules_need_their_sequence(spark):
    found = {r.doc_id: r for r in licenses.scan(frame(spark, rows())).collect()}
    assert found[20].licenses == "MIT" and found[20].rules == "mit-named"
    assert found[21].rules == "mit-text" and found[21].sentence_ids == "mit-grant>mit-notice>mit-asis"
    assert found[22].n_sentences == 2 and found[22].rules == ""
    assert found[23].licenses == "All rights reserved,CC-BY-NC-4.0" and found[23].n_sentences == 3
    assert found[24].n_sentences == 0 and found[2].licenses == "" == found[3].rules
    assert licenses.scan(frame(spark, [])).count() == 0


def test_equal_to_sql_and_without_python(spark):
    docs = frame(spark, rows())
    df = licenses.scan(docs)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    key = lambda r: (r[0] is None, r)
    expected = con.execute(f"SELECT {', '.join(df.columns)} FROM ({licenses.scan_sql()})").fetchall()
    expected = [(None if r[0] != r[0] else r[0], *r[1:]) for r in expected]
    assert sorted(map(tuple, df.collect()), key=key) == sorted(expected, key=key)
    assert not re.search("Python|Arrow|Exchange", df._jdf.queryExecution().executedPlan().toString())


def test_known_sentences_are_in_normal_form(spark):
    df = spark.createDataFrame([(s,) for s in licenses.SENTENCES.values()], "s string")
    assert all(r[0] == [[r[1]]] for r in df.select(licenses.pieces(df.s), "s").collect())
    assert {name for _, _, seq in licenses.RULES for name in seq} <= set(licenses.SENTENCES)
    assert len(set(licenses.SENTENCES.values())) == len(licenses.SENTENCES)
