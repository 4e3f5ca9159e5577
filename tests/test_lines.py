import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from registry_analytics.schemas import WIDE_COLUMNS
from registry_analytics.sources import load_release, parse_lines, read_lines

from .conftest import rows

COLS = ["a", "b", "c"]


def lines_df(spark, values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_pad_drop_long_and_header(spark):
    df = lines_df(spark, ['"a\tb\tc"', '"1\t2"', '"1\t2\t3\t4"', ' " x "\t, y,\t"z" ',
                          "a\tb\tc", ""])
    out = rows(parse_lines(df, COLS, "\t"))
    assert out == [("1", "2", ""), (" x ", "y", "z"), ("", "", "")]


def test_no_header_keeps_all(spark):
    df = lines_df(spark, ["a\tb\tc", "1\t2\t3"])
    assert len(rows(parse_lines(df, COLS, "\t", header=None))) == 2


def test_custom_header_names(spark):
    df = lines_df(spark, ["A|B|C", "1|2|3"])
    out = rows(parse_lines(df, COLS, "|", clean=False, header=["A", "B", "C"]))
    assert out == [("1", "2", "3")]


def test_raw_rule_keeps_tokens(spark):
    df = lines_df(spark, ['a|b|c', ' "1", |2'])
    out = rows(parse_lines(df, COLS, "|", clean="none"))
    assert out == [(' "1", ', "2", "")]


def test_edges_rule(spark):
    df = lines_df(spark, ['  "a\tb\tc"  ', '"1,\t "2" \t3"', '"1\t2"'])
    out = rows(parse_lines(df, COLS, "\t", clean="edges"))
    # commas go everywhere, quotes only at the first/last column, short rows pad NULL
    assert out == [("1", ' "2" ', "3"), ("1", '2"', None)]


def test_header_row_that_only_resembles_header_is_kept(spark):
    df = lines_df(spark, ["a\tb\tc", "a\tb\tx", "xa\tb\tc"])
    assert rows(parse_lines(df, COLS, "\t")) == [("a", "b", "x"), ("xa", "b", "c")]


def test_bad_rule():
    with pytest.raises(ValueError):
        parse_lines(None, COLS, clean="nope")


def test_multi_file_release_with_source(spark, tmp_path):
    header = "\t".join(WIDE_COLUMNS)
    row = "\t".join(["NCT1", "T"] + [""] * 12)
    for i in range(2):
        (tmp_path / f"part{i}.txt").write_text(header + "\n" + row.replace("NCT1", f"NCT{i}")
                                               + "\n")
    df = load_release(spark, str(tmp_path), with_source=True, dates=True)
    out = df.select("Id", "source_file", "Start_Cleaned", "Start_Date").orderBy("Id").collect()
    assert [r.Id for r in out] == ["NCT0", "NCT1"]
    assert out[0].source_file.endswith("part0.txt")
    assert read_lines(spark, str(tmp_path)).count() == 4


def test_header_from_first_line(spark):
    df = lines_df(spark, ['"ID"\tTITLE\tWHEN', "1\t2\t3", "ID\tTITLE\tWHEN", "4\t5"])
    out = rows(parse_lines(df.coalesce(1), COLS, "\t", header="first"))
    assert out == [("1", "2", "3"), ("4", "5", "")]
    empty = lines_df(spark, []).limit(0)
    assert parse_lines(empty, COLS, "\t", header="first").count() == 0


# hand-written lines with the fields they must give
PARSED = [
    ('"1\t2\t3"', ("1", "2", "3")), ("1\t2", ("1", "2", "")), ("", ("", "", "")),
    (' 4,5 \t"x y"\t,', ("45", "x y", "")), ('\xa0a\xa0\t""\t"b', ("a", "", "b")),
    ('a\t"b" \t ab ', None), ('"a\tb\tab"', None), ("1\t2\t3\t4", None),
    ("a\tb\tab\t", None), ("a\tb\tabc", ("a", "b", "abc")), ("xa\tb\tab", ("xa", "b", "ab")),
]


def test_written_out_lines(spark):
    df = spark.createDataFrame([(v,) for v, _ in PARSED], "value string").coalesce(1)
    want = [fields for _, fields in PARSED if fields is not None]
    assert rows(parse_lines(df, ["a", "b", "ab"], "\t")) == want


LINE = st.text(alphabet=["a", "b", '"', ",", " ", "\t", "\xa0"], max_size=12)


@settings(max_examples=6, deadline=None)
@given(st.lists(LINE, min_size=1, max_size=150))
def test_parser_properties(spark, lines):
    header = ("p", "q", "pq")  # letters that no drawn line holds
    data = ["p\tq\tpq"] + lines + ['"p"\tq\t,pq']
    df = spark.createDataFrame([(v,) for v in data], "value string").coalesce(1)
    got = rows(parse_lines(df, list(header), "\t"))
    short = [line for line in lines if line.count("\t") <= 2]
    assert len(got) == len(short) and header not in got
    for line, fields in zip(short, got):  # order is kept, letters are neither lost nor moved
        raw = line.split("\t") + [""] * (2 - line.count("\t"))
        for cell, value in zip(raw, fields):
            assert [c for c in value if c in "ab"] == [c for c in cell if c in "ab"]
            assert "," not in value and value[:1] != '"' and value[-1:] != '"'


def test_header_whose_first_cell_holds_a_comma(spark):
    df = lines_df(spark, ["Id, no|b|c", "1|2|3"])
    for header in (["Id, no", "b", "c"], "first"):
        assert rows(parse_lines(df.coalesce(1), COLS, "|", clean="none", header=header)) == [
            ("1", "2", "3")]


def test_lines_are_split_once(spark):
    df = parse_lines(lines_df(spark, ["a|b|c", "1|2|3"]), COLS, "|").select("b")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    project = [x for x in plan.split("\n") if "Project" in x]
    assert sum(x.count("split(") for x in project) == 1
