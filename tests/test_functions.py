"""Column functions on awkward values."""

import base64

import pytest
from pyspark.sql import functions as F

from parcelry.functions.cursors import decode_cursor, encode_cursor
from parcelry.functions.disclosure import define_names, define_records
from parcelry.functions.literals import row_tuple, sql_literal
from parcelry.functions.paths import is_hostile, is_restricted, path_key, relative_path, relative_value, resolved, top_root
from parcelry.functions.scalars import bounded_message, iso_utc, to_integer


def apply(spark, values, function):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["out"] for r in df.select("i", function(F.col("v")).alias("out")).orderBy("i").collect()]


def test_literal(spark):
    values = [None, "", "0123", "O'Brien", "back\\slash", "a\nb\rc", "nul\0", "sub\x1a", "\\'", "ü😀"]
    want = ["NULL", "''", "'0123'", "'O\\'Brien'", "'back\\\\slash'", "'a\\nb\\rc'", "'nul\\0'", "'sub\\Z'", "'\\\\\\''", "'ü😀'"]
    assert apply(spark, values, sql_literal) == want


def test_row_tuple_types(spark):
    df = spark.sql(
        "select 7 as i, 12345678.5D as d, timestamp_ntz'2024-01-02 03:04:05.6' as t, date'2024-01-02' as day, true as b, "
        "cast(null as double) as n, 'x' as s"
    )
    assert df.select(row_tuple(df)).first()[0] == "('7','12345678.50','2024-01-02 03:04:05.600000','2024-01-02','1',NULL,'x')"


RESTRICTED = [
    "wp-config.php", "q/Wp-Config.Php", "wp-config.php.1", "x\\wp-config.php~", "wp-config-staging.php", "q/wp-config.php//", "wp-config.php.9",
    ".ENV", "q/r/.env.7", "q\\.env", "orders.sql", "./ORDERS.SQL.GZ", "orders.sql.zip", "/chain.PEM", "./././sign.key", "id_rsa_7",
]
FREE = [
    "Wp-Config-Sample.Php", "my.wp-config.php", "wp-config.txt", "wp-config.php7", ".envrc", "a.env", "env", "q/orders.sql", "q\\chain.pem", "./q/id_rsa",
    "orders.sql.bz2", "my_id_rsa", "key.md", " ",
]


def test_restricted(spark):
    assert apply(spark, RESTRICTED, is_restricted) == [True] * len(RESTRICTED)
    assert apply(spark, FREE, is_restricted) == [False] * len(FREE)


def test_hostile(spark):
    bad = ["..", "../a", "a/..", "a/../b", "a\\..\\b", "..\\x", "a\0b"]
    good = ["a..b", "...", "a/...", "..a/b", ".", "a/.b", ""]
    assert apply(spark, bad, is_hostile) == [True] * len(bad)
    assert apply(spark, good, is_hostile) == [False] * len(good)


def test_resolved(spark):
    assert apply(spark, ["a/b", "./a//b", "/a/./b/", "a/.b", ".", "a..b/c"], resolved) == ["a/b", "a/b", "a/b", "a/.b", "", "a..b/c"]


def test_path_order_and_root(spark):
    listed = [".hidden", "a/a1.txt", "a/a2.txt", "b.txt", "foo/bar.txt", "foo/inner/deep.txt", "foo.txt", "z.txt"]
    df = spark.createDataFrame([(p,) for p in reversed(listed)], "p string")
    assert [r["p"] for r in df.orderBy(path_key(F.col("p"))).collect()] == listed
    assert sorted(listed) != listed
    assert apply(spark, ["a/b/c", "a", "/x"], top_root) == ["a", "a", ""]


def test_cursors(spark):
    paths = ["a", "a/b.txt", "x" * 200 + "/ü", "a?>b~"]
    tokens = apply(spark, paths, encode_cursor)
    assert tokens == [base64.urlsafe_b64encode(p.encode()).decode().rstrip("=") for p in paths]
    assert apply(spark, tokens, decode_cursor) == paths
    bad = ["", "not base64!!", "a", "=", "YQ=", "YQ===", "Y=Q="]
    bad += [base64.urlsafe_b64encode(p.encode()).decode() for p in ["../etc/passwd", "/a", "a//b", "a/./b", "a/", "a\0b"]]
    assert apply(spark, bad, decode_cursor) == [None] * len(bad)
    assert apply(spark, ["YQ==", " Y Q\n"], decode_cursor) == ["a", "a"]


@pytest.mark.parametrize(
    "path, want",
    [
        ("/srv/site", ""), ("/srv/site/", ""), ("/srv/site/a/b", "a/b"), ("/srv/site2/a", "../site2/a"), ("/srv", ".."),
        ("/var/log", "../../var/log"), ("\\srv\\site\\x", "x"), ("/srv//site///x", "x"), ("c:/x", "../../C:/x"),
    ],
)
def test_relative(spark, path, want):
    assert apply(spark, [path], lambda c: relative_path(c, F.lit("/srv/site/"))) == [want]


def test_relative_value_leaves_plain_text(spark):
    values = ["/srv/site/a", "c:\\x", "https://h/a", "localhost:/tmp/s", "", "a/b"]
    want = ["a", "../../C:/x", "https://h/a", "localhost:/tmp/s", "", "a/b"]
    assert apply(spark, values, lambda c: relative_value(c, F.lit("/srv/site"))) == want


def test_disclosure(spark):
    rows = [
        ("WP_DEBUG", "1", "included", "1"), ("ABSPATH", "/srv/site/", "included", ""), ("AUTH_KEY", "k", "secret", None),
        ("My_Token_X", "k", "secret", None), ("OTHER", "o", "not_allow_listed", None), ("wp_debug", "1", "not_allow_listed", None),
        ("MINE", "m", "included", "m"), ("MY_LICENCE", "m", "secret", None),
    ]
    df = spark.createDataFrame([(n, v) for n, v, *_ in rows], "name string, value string")
    got = {r["name"]: (r["disclosure"], r["value"]) for r in define_records(df, F.lit("/srv/site"), ["MINE", "MY_LICENCE"]).collect()}
    assert got == {n: (d, v) for n, _, d, v in rows}


def test_define_names(spark):
    source = """define('A', 1); define ( "B_2" , x); define('A', 2); undefine('C'); xdefine('D'); Define('E');
    define(F); define('9G'); édefine('H'); if(define("I",1))"""
    assert apply(spark, [source], define_names) == [["A", "B_2", "H", "I"]]


def test_scalars(spark):
    texts = ["12", " 12 ", "-7", "12.9", "-12.9", "1e3", ".5", "abc", "", None, "12abc", "9" * 30, "-" + "9" * 30, "1e400"]
    want = [12, 12, -7, 12, -12, 1000, 0, 0, 0, 0, 0, 2**63 - 1, -(2**63), 0]
    assert apply(spark, texts, to_integer) == want
    assert apply(spark, ["é" * 300, "é" * 301, None], bounded_message) == ["é" * 300, "é" * 300 + "…", None]
    assert spark.range(1).select(iso_utc(F.lit(1706659200))).first()[0] == "2024-01-31T00:00:00Z"


def test_numbers_and_null_fields_survive_rendering(spark):
    values = [0.1, 1 / 3, 2.5, 1e300, -5e-324, 0.005, 123456789.125, 99999999999999.99, -0.0, 0.0, float("inf"), float("nan"), None]
    df = spark.createDataFrame([(v, (v, None), [None, v]) for v in values], "v double, `s``t` struct<a: double, b: string>, l array<double>")
    import json
    import math

    from parcelry.functions.literals import canonical_text, row_size, row_tuple

    texts = df.select(*[canonical_text(F.col(f"`{n.replace('`', '``')}`"), df.schema[n].dataType) for n in df.columns]).collect()
    for value, (text, nested, listed) in zip(values, texts):
        if value is None:
            assert text is None
        elif math.isnan(value):
            assert text == "NaN"
        else:
            assert float(text) == value and math.copysign(1, float(text)) == math.copysign(1, value)
        assert set(json.loads(nested)) == {"a", "b"} and len(json.loads(listed)) == 2
    assert [t[0] for t in texts[:3]] == ["0.10", "0.3333333333333333", "2.50"]
    sizes = df.select(row_size(df).alias("n"), F.octet_length(row_tuple(df)).alias("m")).collect()
    assert all(r["n"] == r["m"] for r in sizes)
    small = spark.createDataFrame([(0.1,), (1.5,), (3e38,)], "f float")
    assert [r[0] for r in small.select(canonical_text(F.col("f"), small.schema["f"].dataType)).collect()] == ["0.10", "1.50", "3.0E38"]


def test_definitions_keep_names(spark):
    from parcelry.sources.tables import structure_text

    schema = spark.createDataFrame([], "`a``b` struct<Inner: map<string,array<double>>, `x y`: decimal(5,2)>").schema
    text = structure_text("t`u", schema)
    assert "`a``b` STRUCT<Inner:MAP<STRING,ARRAY<DOUBLE>>,`x y`:DECIMAL(5,2)>" in text and "CREATE TABLE `t``u` (" in text
