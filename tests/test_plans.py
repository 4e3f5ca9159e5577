import duckdb
import pytest

import __spark_entry__ as entry
from registry_analytics.plans import catalog as cat
from registry_analytics.plans import questions as qn
from registry_analytics.plans import sql as sq
from registry_analytics.plans.oracle import ORACLE

from .conftest import SF_SMALL, rows

PAIRS = {
    "study_types": ("sql_study_types", None),
    "top_conditions": ("sql_top_conditions", None),
    "top_unlisted_sponsors": ("sql_top_unlisted_sponsors", None),
    "row_count": ("sql_row_count", None),
    "avg_enrollment_by_funder": ("sql_avg_enrollment", None),
    "enrollment_by_sponsor": ("sql_enrollment_by_sponsor", None),
}


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("df_name", sorted(PAIRS))
def test_dataframe_and_sql_forms_agree(spark, df_name):
    q = entry.queries()
    assert same(q[df_name](spark, SF_SMALL), q[PAIRS[df_name][0]](spark, SF_SMALL))


def test_month_question_sql_form(spark):
    q = entry.queries()
    a = q["completed_by_month"](spark, SF_SMALL).withColumnRenamed("count", "n")
    b = q["sql_completed_by_month"](spark, SF_SMALL).withColumnRenamed("completed_studies", "n")
    assert same(a, b)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["Sponsor", "count"]
    assert 0 < len(df.collect()) <= 10


def test_every_query_has_an_oracle():
    assert set(cat.QUERIES) == set(ORACLE)
    assert set(entry.oracle_sql()) <= set(entry.queries())


# the 27 fits of the search run in the slow test below
ORACLE_NAMES = sorted(set(ORACLE) - {"als_tuned", "als_tuned_b", "als_tuned_c"})


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ["nation", "customer", "orders", "lineitem"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", ORACLE_NAMES)
def test_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF_SMALL)
    res = duck.execute(entry.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    got = sorted(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())
    idx = [ocols.index(c) for c in sorted(df.columns)]
    want = sorted(repr(tuple(r[i] for i in idx)) for r in res.fetchall())
    assert got == want


def test_fixture_counts_differ(spark, duck):
    """Repeated lines and ids: without a distinct, one of these would equal another."""
    n = {q: duck.execute(ORACLE[q]).fetchone()[0]
         for q in ("distinct_studies", "distinct_rows", "row_count")}
    assert n["distinct_studies"] < n["distinct_rows"] < n["row_count"]


def test_exclusion_forms_agree_on_uncleaned_names(spark):
    raw = cat.narrow(spark, SF_SMALL)
    listed = cat.companies(spark, SF_SMALL)
    assert same(qn.top_unlisted_sponsors(raw, listed, 1000),
                sq.top_unlisted_sponsors(spark, raw, listed, 1000))


@pytest.mark.parametrize("name", ["als_tuned", "als_tuned_b", "als_tuned_c"])
def test_full_grid_search_matches_oracle(spark, duck, name):
    got = cat.QUERIES[name](spark, SF_SMALL).first().asDict()
    res = duck.execute(ORACLE[name])
    assert got == dict(zip([d[0] for d in res.description], res.fetchone()))


def test_share_sums_to_100(spark):
    out = rows(qn.study_design_share(cat.wide(spark, SF_SMALL)))
    assert abs(sum(r[2] for r in out) - 100.0) <= 0.1 * len(out)


def test_sql_text_uses_no_ansi_unsafe_forms():
    for text in (sq.COMPLETED_BY_MONTH, sq.AVG_ENROLLMENT, sq.ENROLLMENT_BY_SPONSOR):
        assert "CAST(" not in text.replace("try_cast(", "")
        assert "NOT IN" not in text
