import os

from registry_analytics.operators.exclusion import top_unlisted
from registry_analytics.plans import catalog
from registry_analytics.sources import fixtures, read_company_list, read_interactions

from .conftest import SF_SMALL, rows


def test_company_list_reads_one_quoted_column(spark, tmp_path):
    path = tmp_path / "companies.csv"
    path.write_text('Company,Parent_Company,Country\n'
                    '"a","Acme, Inc","US"\n'
                    '"b","",DE\n'
                    '"c","Beta Labs","FR"\n')
    df = read_company_list(spark, str(path))
    assert df.columns == ["Parent_Company"]
    assert sorted(rows(df), key=str) == [("Acme, Inc",), ("Beta Labs",), (None,)]
    trials = spark.createDataFrame([("Acme Inc",), ("Gamma",), ("Beta Labs",)], "Sponsor string")
    out = rows(top_unlisted(trials, "Sponsor", df, "Parent_Company"))
    assert out == [("Gamma", 1)]


def test_interactions_typed_and_permissive(spark, tmp_path):
    path = tmp_path / "inter.csv"
    path.write_text("member Id,Name of the Game,member behaviour,Status\n"
                    "151603712,The Elder Scrolls,purchase,1.0\n"
                    "151603712,Fallout,play,273.0\n"
                    "oops,Fallout,play,x\n")
    df = read_interactions(spark, str(path))
    assert [t for _, t in df.dtypes] == ["double", "string", "string", "double"]
    assert rows(df) == [(151603712.0, "The Elder Scrolls", "purchase", 1.0),
                        (151603712.0, "Fallout", "play", 273.0),
                        (None, "Fallout", "play", None)]


def test_a_query_writes_only_the_fixtures_it_reads(spark, tmp_path):
    os.symlink(SF_SMALL, tmp_path / "tables")
    here = str(tmp_path / "tables")

    def written():
        return {n for (_, d), paths in fixtures._WRITTEN.items() if d == here for n in paths}

    assert catalog.QUERIES["stream_study_types"](spark, here).count() == 6
    assert written() == {"wide"}
    first = fixtures.materialize(spark, here, "wide")["wide"]
    assert catalog.QUERIES["starts_by_year"](spark, here).count() == 8
    assert written() == {"wide", "wide_clean"}
    assert fixtures.materialize(spark, here)["wide"] == first  # written once
    assert written() == {"wide", "wide_clean", "narrow", "companies", "interactions_csv",
                         "interactions"}
