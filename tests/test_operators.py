from pyspark.sql import functions as F

from registry_analytics.operators import frequency as fq
from registry_analytics.operators.exclusion import exclude_listed, listed_names, top_unlisted
from registry_analytics.operators.numeric import (avg_by, histogram, int_histogram,
                                                  min_max_scale, sum_by)
from registry_analytics.operators.periods import completed_by_month, counts_by_year

from .conftest import rows


def test_value_counts_order_and_ties(spark):
    df = spark.createDataFrame([(k,) for k in "bbaaccd"], "k string")
    assert rows(fq.value_counts(df, "k", "desc", 3)) == [("a", 2), ("b", 2), ("c", 2)]
    assert rows(fq.value_counts(df, "k", "asc")) == [("d", 1), ("a", 2), ("b", 2), ("c", 2)]
    assert rows(fq.value_counts(df, "k", "key"))[0] == ("a", 2)


def test_frequencies_sum_to_row_count(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"))
    total = fq.value_counts(df, "k", None).agg(F.sum("count")).first()[0]
    assert total == 1000


def test_token_counts(spark):
    df = spark.createDataFrame([("a|b",), ("a||b",), (" a | a",), ("",), (None,)], "c string")
    assert rows(fq.token_counts(df, "c")) == [("a", 4), ("b", 2)]
    untrimmed = rows(fq.token_counts(df, "c", trim=False))
    # grouped as written: "a" (2), " a " (1), " a" (1), "b" (2); shown stripped
    assert sorted(untrimmed) == [("a", 1), ("a", 1), ("a", 2), ("b", 2)]


def test_distinct_counts(spark):
    df = spark.createDataFrame([("1", "x"), ("1", "x"), ("1", "y"), ("2", "x"), (None, "z")],
                               "id string, v string")
    assert fq.distinct_keys(df, "id").first()[0] == 2
    assert fq.distinct_rows(df).first()[0] == 4
    assert fq.row_count(df).first()[0] == 5


def test_share_rounds_half_up_and_sums(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("c", 6)], "k string, count long")
    out = dict((k, p) for k, _, p in rows(fq.share(df)))
    assert out == {"a": 12.5, "b": 12.5, "c": 75.0}
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, count long")
    assert sorted(r[2] for r in rows(fq.share(df))) == [33.3, 66.7]


def companies(spark, names):
    return spark.createDataFrame([(n,) for n in names], "Parent_Company string")


def test_exclusion_null_blank_and_commas(spark):
    trials = spark.createDataFrame([(s,) for s in ["Acme Inc", "Acme Inc", "Beta", "Gamma",
                                                   None, ""]], "Sponsor string")
    listed = companies(spark, ["Acme, Inc", None, "  ", '"Beta"'])
    kept = sorted(rows(exclude_listed(trials, "Sponsor", listed, "Parent_Company")),
                  key=str)
    # NULL/blank names in the list do not empty the result; NULL keys are kept
    assert kept == [("",), ("Gamma",), (None,)]
    top = rows(top_unlisted(trials, "Sponsor", listed, "Parent_Company", k=10))
    assert sorted(top, key=str) == [("", 1), ("Gamma", 1), (None, 1)]
    literal = rows(top_unlisted(trials, "Sponsor", listed, "Parent_Company", normalize=False,
                                drop_blank_keys=True))
    assert sorted(literal) == [("Acme Inc", 2), ("Beta", 1), ("Gamma", 1)]


def test_exclusion_plan_broadcast_only_when_small(spark):
    trials = spark.range(100).select(F.concat(F.lit("s"), (F.col("id") % 10).cast("string"))
                                     .alias("Sponsor"))
    listed = companies(spark, ["s1", "s2"])
    small = top_unlisted(trials, "Sponsor", listed, "Parent_Company")
    rows(small)  # adaptive execution decides from runtime sizes
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert len(rows(small)) == 8
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        big = top_unlisted(trials, "Sponsor", listed, "Parent_Company")
        assert "SortMergeJoin" in big._jdf.queryExecution().executedPlan().toString()
        assert sorted(rows(big)) == sorted(rows(small))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_listed_names_are_clean(spark):
    assert listed_names(companies(spark, ["a", "a", None, "", " "]), "Parent_Company").count() == 1


def test_numeric_text_aggregates(spark):
    df = spark.createDataFrame([("x", "10"), ("x", "12.5"), ("x", "abc"), ("y", ""),
                                ("y", " 4 ")], "k string, v string")
    assert sorted(rows(avg_by(df, "k", "v", "avg"))) == [("x", 11.25), ("y", 4.0)]
    assert rows(sum_by(df, "k", "v", "total")) == [("x", 10), ("y", 4)]
    assert dict(sum_by(df, "k", "v", "total").dtypes)["total"] == "bigint"


def test_histogram(spark):
    df = spark.createDataFrame([(str(v),) for v in [0, 1, 5, 10, 10]] + [("bad",)], "v string")
    h = rows(int_histogram(df, "v", bins=5))
    assert [r[0] for r in h] == [0, 1, 2, 3, 4]
    assert sum(r[3] for r in h) == 5  # counts sum to parsed values
    assert h[0][3] == 2 and h[4][3] == 2  # last bin closed
    same = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert [r[3] for r in rows(histogram(same, "v", 4))] == [2, 0, 0, 0]


def test_min_max_scale(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (5.0,)], "r double")
    assert [r[1] for r in rows(min_max_scale(df, "r", "n"))] == [0.0, 0.5, 1.0]
    flat = spark.createDataFrame([(2.0,), (2.0,)], "r double")
    assert [r[1] for r in rows(min_max_scale(flat, "r", "n"))] == [None, None]


def test_periods(spark):
    df = spark.createDataFrame([
        ("COMPLETED", "2023-05"), ("COMPLETED", "2023-05"), ("COMPLETED", "2023"),
        ("COMPLETED", "2023-11"), ("RECRUITING", "2023-05"), ("COMPLETED", "2022-05"),
        ("COMPLETED", '2023-"07')], "Status string, Completion_Cleaned string")
    assert rows(completed_by_month(df, 2023)) == [("05", 2), ("07", 1), ("11", 1)]
    assert rows(completed_by_month(df, 2023, keep_null_month=True))[0] == (None, 1)
    years = spark.createDataFrame([("2021-01",), ("2021-02",), ("",)], "Start_Cleaned string")
    assert rows(counts_by_year(years)) == [("", 1), ("2021", 2)]


def test_month_as_int_orders_numerically(spark):
    df = spark.createDataFrame([("COMPLETED", "2023-10"), ("COMPLETED", "2023-5"),
                                ("COMPLETED", "2023-5")], "Status string, Completion_Cleaned string")
    assert rows(completed_by_month(df, 2023)) == [("10", 1), ("5", 2)]
    out = completed_by_month(df, 2023, month_as_int=True)
    assert rows(out) == [(5, 2), (10, 1)] and dict(out.dtypes)["Month"] == "int"
