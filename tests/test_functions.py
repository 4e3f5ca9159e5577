from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from registry_analytics.functions import (clean_token, format_month, month_text, to_double,
                                          to_int, to_month, year_prefix, year_text)
from registry_analytics.functions.text import WHITESPACE, sanitize_names

from .conftest import rows


# tokens and what is left of them, written out
CLEANED = [
    ("", ""), (",", ""), ('"', ""), ('""', ""), ("a,b,", "ab"), (' "a" ', "a"), ('" a "', " a "),
    ("\xa0a\t", "a"), ('a"b', 'a"b'), ('"a""', "a"), ("\u3000x\n", "x"), (', "a', "a"),
    ('" ,"', " "), ("a b", "a b"),
]


def test_clean_token_table(spark):
    df = spark.createDataFrame([(v,) for v, _ in CLEANED], "v string")
    assert [r[0] for r in df.select(clean_token("v")).collect()] == [w for _, w in CLEANED]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=[" ", '"', ",", "a", "b", "\t", "\xa0", " ", "\n"],
                        max_size=8), min_size=1, max_size=300))
def test_clean_token_properties(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    once = df.select("v", clean_token("v").alias("c"))
    for v, c in rows(once):
        assert c in v.replace(",", "") and [x for x in c if x in "ab"] == [x for x in v if x in "ab"]
        assert not c.startswith('"') and not c.endswith('"')


def test_whitespace_set_is_python_strip_set():
    assert all(c.isspace() for c in WHITESPACE)
    assert " " in WHITESPACE and "\xa0" in WHITESPACE and "　" in WHITESPACE


def test_clean_token_examples(spark):
    data = ['"x"', ' "x" ', '" x "', "a,b", "\xa0x\xa0", "", None, '""', '"Study, no 1"']
    df = spark.createDataFrame([(v,) for v in data], "v string")
    got = [r[0] for r in df.select(clean_token("v")).collect()]
    assert got == ["x", "x", " x ", "ab", "x", "", None, "", "Study no 1"]


def test_dates(spark):
    data = ["2023-05-17", "2023-05", "2023-5", "2023", "May 2023", "2023-13", "", None]
    df = spark.createDataFrame([(v,) for v in data], "d string")
    out = rows(df.select(to_month("d").alias("m")).select("m", format_month("m")))
    assert out == [
        ("2023-05", "May 2023"), ("2023-05", "May 2023"), ("2023-5", "May 2023"),
        ("2023", "2023"), ("May 2023", "May 2023"), ("2023-13", "2023-13"), ("", ""),
        (None, None)]


def test_year_month_parts_never_fail_under_ansi(spark):
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    df = spark.createDataFrame([("2023-05",), ("2023",), ("",), (None,)], "d string")
    out = rows(df.select(year_text("d"), month_text("d"), year_prefix("d")))
    assert out == [("2023", "05", "2023"), ("2023", None, "2023"), ("", None, ""),
                   (None, None, None)]


def test_numbers(spark):
    data = ["12", " 12 ", "12.5", "abc", "", "99999999999", None]
    df = spark.createDataFrame([(v,) for v in data], "v string")
    out = rows(df.select(to_int("v"), to_double("v")))
    assert out == [(12, 12.0), (12, 12.0), (None, 12.5), (None, None), (None, None),
                   (None, 9.9999999999e10), (None, None)]


def test_sanitize_names(spark):
    df = spark.createDataFrame([(1, 2)], ['"Id', 'Completion",'])
    assert sanitize_names(df).columns == ["Id", "Completion"]
    assert df.select(F.lit(1)).count() == 1
