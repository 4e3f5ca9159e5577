"""Remaining SURVEY §2 items: views, filters, date columns, random split, grids."""

from registry_analytics.functions import is_int_text, with_date_columns
from registry_analytics.operators import frequency as fq
from registry_analytics.operators import recommend as rc
from registry_analytics.plans import sql as sq

from .conftest import rows


def test_register_views_and_read_back(spark):
    trials = spark.createDataFrame([("1", "A"), ("2", "B")], "Id string, Type string")
    companies = spark.createDataFrame([("X",)], "Parent_Company string")
    sq.register(trials, "clinical_trials_t", companies, "parent_companies_t")
    assert spark.table("clinical_trials_t").count() == 2
    assert rows(spark.sql("SELECT count(*) FROM parent_companies_t")) == [(1,)]


def test_int_text_filter_and_not_null_option(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,), ("2",), ("2",)], "v string")
    assert [r[0] for r in rows(df.filter(is_int_text("v")))] == ["1", "2", "2"]
    assert rows(fq.value_counts(df, "v", "desc", drop_null=True))[0] == ("2", 2)
    assert (None, 1) in rows(fq.value_counts(df, "v", "desc"))


def test_with_date_columns(spark):
    df = spark.createDataFrame([("2023-05-17", "2024-01")], "Start string, Completion string")
    out = with_date_columns(df)
    assert out.columns == ["Start_Cleaned", "Completion_Cleaned", "Start_Date",
                           "Completion_Date"]
    assert rows(out) == [("2023-05", "2024-01", "May 2023", "Jan 2024")]


def test_random_split_option(spark):
    df = spark.range(2000).repartition(4)
    a, b = rc.random_split(df)
    assert a.count() + b.count() == 2000
    assert 0.7 < a.count() / 2000 < 0.9
    assert a.join(b, "id").count() == 0


def test_fixed_grids():
    assert rc.GRIDS["grid_a"] == {"maxIter": [5, 10, 15], "rank": [5, 10, 15],
                                  "regParam": [0.01, 0.1, 0.2]}
    assert all(len(rc.grid_points(g)) == 27 for g in rc.GRIDS.values())
    als = rc.make_als()
    assert len(rc.param_grid(als, rc.GRIDS["grid_b"])) == 27
    assert als.getColdStartStrategy() == "drop" and als.getRank() == 10
