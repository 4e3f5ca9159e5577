"""Tables between the steps go when the last step that reads them is over."""

import os

import pytest

import corpus_pipeline as cp
from registry_analytics.llm import line_dedup, ngram_join
from registry_analytics.llm.common import scratch, written
from registry_analytics.session import ensure_checkpoint_dir

from ..conftest import SF_SMALL
from .helpers import SCHEMA, random_documents


def tables(spark):
    folder = ensure_checkpoint_dir(spark).removeprefix("file:") + "/llm"
    return {name: os.path.join(folder, name)
            for name in (os.listdir(folder) if os.path.isdir(folder) else [])}


def left_by(spark, work):
    before = set(tables(spark))
    out = work()
    return out, sorted(name.rsplit("-", 1)[0] for name in set(tables(spark)) - before)


def families():
    docs = random_documents(20, words=5000)
    return (docs + [(100 + d[0], d[1] + " more", *d[2:]) for d in docs if len(d[1].split()) > 40]
            + [(200 + d[0], *d[1:]) for d in docs[:4]])


def test_scratch_removes_all_but_lasting_tables(spark):
    def work():
        with scratch(spark):
            with scratch(spark):
                written(spark.range(3), "inner")
                outer = written(spark.range(4), "outer", lasting=True)
            assert outer.count() == 4
            return written(outer, "result", lasting=True)

    out, left = left_by(spark, work)
    assert left == ["result"] and out.count() == 4


def test_scratch_ends_with_an_error(spark):
    def work():
        with pytest.raises(ValueError):
            with scratch(spark):
                written(spark.range(3), "inner")
                raise ValueError

    assert left_by(spark, work)[1] == []
    assert left_by(spark, lambda: written(spark.range(3), "after"))[1] == ["after"]


def test_line_dedup_leaves_the_removed_lines(spark):
    df = spark.createDataFrame(families(), SCHEMA)
    out, left = left_by(spark, lambda: line_dedup.dedup_lines(df))
    assert left == ["lines-gone"] and out.count() == len(families())


def test_near_duplicates_leave_the_groups(spark):
    df = spark.createDataFrame(families(), SCHEMA)
    out, left = left_by(spark, lambda: cp.near_duplicates(spark, df, SF_SMALL))
    assert left == ["stage-near"]
    assert sorted(r.doc_id for r in out.collect()) == list(range(20))


def test_sketches_are_written_once(spark, monkeypatch):
    wide = []

    def spied(df, label, lasting=False):
        if "sketches" in df.columns or "parts" in df.columns:
            wide.append(label)
        return written(df, label, lasting)

    monkeypatch.setattr(ngram_join, "written", spied)
    df = spark.createDataFrame(families(), SCHEMA)
    out, left = left_by(spark, lambda: ngram_join.jaccard_components(df))
    assert wide == ["join-rows"] and left == ["join-named", "join-rows"]
    assert out.count() == len(families())


def test_many_members_are_joined_without_a_broadcast(spark, monkeypatch):
    df = spark.createDataFrame(families(), SCHEMA)
    want = sorted(map(tuple, ngram_join.jaccard_components(df).collect()))
    monkeypatch.setattr(ngram_join, "MAX_BROADCAST_ROWS", 0)
    assert sorted(map(tuple, ngram_join.jaccard_components(df).collect())) == want
    assert len({r[-1] for r in want}) == 20
