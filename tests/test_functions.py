import pytest
from pyspark.sql import functions as F

from grantlens.functions import identifiers as ids
from grantlens.functions import names, scoring, text


def apply(spark, function, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(function(F.col("v"))).collect()]


@pytest.mark.parametrize(
    ("function", "cases"),
    [
        (ids.strip_one_char, {'"a"': "a", '"a': "a", 'a"': "a", '""a""': '"a"', "a": "a", '"': "",
                              "": "", 'a"\n': 'a"\n'}),
        (lambda c: ids.strip_one_char(c, "."), {".a.": "a", "axb": "axb"}),
        (ids.clean_identifier, {'"my role"': "my role", "ROLE": "ROLE", 'R"': 'R"', None: None}),
        (ids.clean_asset_name, {'"t"': '""t""', "T": "T"}),
        (ids.fqn, {"A": '"A"', '"a"': '"""a"""', None: None}),
        (ids.quote_fqn, {"A.B.C": '"A"."B"."C"', "A": '"A"', 'A."b"': '"A"."""b"""'}),
        (ids.add_missing_quotes, {
            "A.B.C": '"A"."B"."C"',
            'A."b c".C': '"A"."b c"."C"',
            '"a.b".C': '"a.b"."C"',
            '"a""b".C': '"a""b"."C"',
            None: None,
        }),
        (ids.truncated_database, {'"A"."B"."C"': '"A"', '"A"': '"A"'}),
        (ids.truncated_schema, {'"A"."B"."C"."D"': '"A"."B"', '"A"."B"': '"A"."B"', '"A"': None}),
        (ids.truncated_table, {
            '"A"."B"."C"."D"': '"A"."B"."C"', '"A"."B"."C"': '"A"."B"."C"', '"A"."B"': None,
        }),
        (ids.extract_schema, {'"A"."B"."C"': '"B"', '"A"."x.y"': '"x.y"', '"A"': None}),
        (ids.fqn_type, {
            '"A"': "DATABASE", '"A"."B"': "SCHEMA", '"A"."B"."C"': "TABLE",
            '"A"."B"."C"."D"': None, '"a.b"': "DATABASE",
        }),
        (ids.future_grant_scope, {
            "DB.<TABLE>": '"DB"', "DB.SC.<VIEW>": '"DB"."SC"', 'DB."s.c".<TABLE>': '"DB"."s.c"',
        }),
    ],
)
def test_identifiers(spark, function, cases):
    assert apply(spark, function, cases) == list(cases.values())


def test_fqn_of_several_parts(spark):
    df = spark.sql("SELECT 'A' a, 'b.c' b, '\"d\"' c, CAST(NULL AS STRING) n")
    assert df.select(ids.fqn("a", "b", "c")).first()[0] == '"A"."b.c"."""d"""'
    assert df.select(ids.fqn("a", "n")).first()[0] is None


def test_strict_fqn_type_rejects_columns(spark):
    with pytest.raises(Exception, match="not a valid fully qualified name"):
        apply(spark, lambda c: ids.fqn_type(c, strict=True), ['"A"."B"."C"."D"'])


def test_sensitive_names(spark):
    expected = {
        "email": True, "WORK_EMAIL": True, "EMAIL_HASHED": False, "page": False, "age": True,
        "AGE": True, "zip4": True, "unzip": False, "clip": False, "ip_addr": True,
        "client_ip": True, "name": True, "username": False, "amount": True, "amounts": False,
        "safe_phone": False, "masked_address": False, "latitude": True, "flat": False,
        "e-mail": True, "longest": True, "cc_number": True, "acc": False,
    }
    assert apply(spark, names.is_sensitive, expected) == list(expected.values())
    assert len(names.SENSITIVE_TERMS) == 29


def test_user_space(spark):
    expected = {
        '"DB"."S"."T"': True, '"DB"': True, '"SNOWFLAKE"."S"."T"': False,
        '"SNOWFLAKE_SAMPLE_DATA"."S"."T"': False, '"DB"."INFORMATION_SCHEMA"."T"': False,
        '"DB"."INFO"."T"': True,
    }
    assert apply(spark, names.in_user_space, expected) == list(expected.values())


def test_status_steps(spark):
    cases = [
        (None, "UNKNOWN"), (-2.0, "INSIGHT"), (-1.0, "INFO"), (0.0, "FAIL"), (0.4999, "FAIL"),
        (0.5, "WARN"), (0.8999, "WARN"), (0.9, "PASS"), (1.0, "PASS"),
    ]
    assert apply(spark, scoring.status, [c[0] for c in cases], "double") == [c[1] for c in cases]


def test_sort_key(spark):
    found = apply(spark, scoring.sort_key, [None, -2.0, -1.0, 0.3], "double")
    assert found == [100.0, 99.0, 98.0, 0.3]


def test_grades(spark):
    cases = [
        (None, "?"), (0.0, "F"), (0.2499, "F"), (0.25, "D-"), (0.5, "C-"), (0.8999, "A-"),
        (0.9, "A-"), (0.9999, "A"), (1.0, "A+"), (1.2, "A+"),
    ]
    assert apply(spark, scoring.grade, [c[0] for c in cases], "double") == [c[1] for c in cases]


def test_grade_falls_one_letter_per_step(spark):
    steps = [0.25 + 0.75 * (i + 0.5) / 11 for i in range(11)]
    found = apply(spark, scoring.grade, steps, "double")
    assert found == list(reversed(scoring.GRADES[1:12]))


def test_wording(spark):
    counted = apply(spark, lambda c: text.counted(c, "user"), [0, 1, 1234], "bigint")
    assert counted == ["0 users", "1 user", "1,234 users"]
    assert apply(spark, text.percent, [0.25227], "double") == [25.23]
    flags = spark.createDataFrame(
        [(1, False, False), (2, False, True), (3, True, False), (4, True, True)],
        "i int, d boolean, s boolean",
    )
    level = text.missing_level(F.col("d"), F.col("s"))
    found = [r[0] for r in flags.orderBy("i").select(level).collect()]
    assert found == ["both", "database", "schema", None]
