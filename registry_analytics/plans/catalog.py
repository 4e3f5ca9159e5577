"""Named queries over a data directory: each is ``(spark, sf_dir) -> DataFrame``.

Inputs are derived from the parquet tables of ``sf_dir`` by ``sources.fixtures`` and
then go through the same ingest the library applies to real extracts (line parsing,
cleaning, header and length rules), so every query reads whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sanitize_names
from ..operators import frequency as fq
from ..operators import recommend as rc
from ..schemas import ACTION_COL, ITEM_COL, RATING_COL, USER_COL
from ..session import ensure_checkpoint_dir
from ..sources import fixtures as fx
from ..sources.csv import read_company_list
from ..sources.lines import (load_release, parse_narrow, parse_wide, read_lines,
                             read_release_table)
from ..streaming.ingest import counts_table
from . import questions as qn
from . import sql as sq

# Year used by the month question (the fixture's completion dates span 1995-2002).
MONTH_YEAR = 1998


def fixture(spark: SparkSession, sf_dir: str, name: str) -> str:
    return fx.materialize(spark, sf_dir, name)[name]


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_wide(read_lines(spark, fixture(spark, sf_dir, "wide")))


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned wide release as saved once by the ingest (parquet)."""
    return read_release_table(spark, fixture(spark, sf_dir, "wide_clean"))


def narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_narrow(read_lines(spark, fixture(spark, sf_dir, "narrow")))


def edge_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_wide(read_lines(spark, fixture(spark, sf_dir, "wide")), clean="edges")


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_company_list(spark, fixture(spark, sf_dir, "companies"))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interactions, ingested once from their CSV into parquet."""
    return spark.read.parquet(fixture(spark, sf_dir, "interactions"))


def planted_rating(user_col: str = USER_COL, item_col: str = ITEM_COL):
    """A rating of rank one from the keys: what a factor model can find and an average
    cannot (line quantities, the raw ratings, are independent of user and item)."""
    part = F.substring(F.col(item_col), 2, 20).cast("long")
    return (F.col(user_col).cast("int") % 7 + 1) / F.lit(7.0) * ((part % 5 + 1) / F.lit(5.0))


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validated, indexed, normalised ratings (planted), written once.

    ALS passes over its input several times while building its rating blocks, and the
    test split is scored afterwards; the Parquet files (in the shared checkpoint
    directory, a third of the size of a checkpoint) hold the result of the joins, the index
    and the scaling, so no pass repeats the source join or a shuffle join with a large index.
    They also cut the lineage (a lost executor re-reads files) and leave no cached data behind.
    """
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/registry-ratings/{uuid.uuid4().hex}"
    r = rc.valid_ratings(ratings(spark, sf_dir)).withColumn(RATING_COL, planted_rating())
    r = rc.normalize_ratings(r).filter(F.col(rc.NORMALIZED_COL).isNotNull())
    r = rc.with_item_index(r)  # every valid row has an item
    r.select("interaction_id", USER_COL, rc.INDEX_COL, rc.NORMALIZED_COL).write.parquet(path)
    return spark.read.parquet(path)


def user_means(train: DataFrame, test: DataFrame) -> DataFrame:
    """``test`` with the user's average training rating as ``prediction`` (users without
    training rows left out)."""
    means = train.groupBy(USER_COL).agg(F.avg(rc.NORMALIZED_COL).alias("prediction"))
    return test.join(means, USER_COL)


def _verdict(train: DataFrame, test: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row: test rows, scored rows, and whether the model beats the users' averages."""
    model = rc.rmse_frame(predictions).withColumnRenamed("rmse", "_model")
    plain = rc.rmse_frame(user_means(train, test)).select(F.col("rmse").alias("_plain"))
    return test.agg(F.count(F.lit(1)).alias("n_test")).select(
        "n_test", model.select("n_scored").scalar().alias("n_scored"),
        (model.select("_model").scalar() < plain.scalar()).alias("beats_user_mean"))


def als_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = rc.split_by_key(_prepared(spark, sf_dir), "interaction_id")
    model = rc.fit_als(train, **rc.FIT_DEFAULTS)
    return _verdict(train, test, model.transform(test))


def als_tuned(spark: SparkSession, sf_dir: str, grid: str = "grid_a") -> DataFrame:
    """One of the three full 27-point searches, its best model scored on the test rows."""
    train, test = rc.split_by_key(_prepared(spark, sf_dir), "interaction_id")
    res = rc.tune(train, rc.GRIDS[grid], train_ratio=0.8)
    points = len(res.model.getEstimatorParamMaps())
    return _verdict(train, test, res.model.bestModel.transform(test)).withColumn(
        "n_points", F.lit(points).cast("long"))


def user_mean_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = rc.split_by_key(_prepared(spark, sf_dir), "interaction_id")
    return rc.rmse_frame(user_means(train, test)).withColumn("rmse", F.round("rmse", 6))


def item_index_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of all ratings on one item, spread over tasks of at most 1,000 rows."""
    hot = ratings(spark, sf_dir).withColumn(
        ITEM_COL, F.when(F.col("interaction_id") % 3 == 0, "HOT").otherwise(F.col(ITEM_COL)))
    return fq.value_counts(rc.with_item_index(hot, rows_per_task=1_000),
                           [ITEM_COL, rc.INDEX_COL], None)


def loaded_release_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load_release(spark, fixture(spark, sf_dir, "wide"), dates=True, with_source=True)
    return df.select("Id", "Start_Cleaned", "Completion_Cleaned", "Start_Date",
                     "Completion_Date", F.col("source_file").isNotNull().alias("has_source"))


def view_study_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's own SQL over the registered view."""
    sq.register(trials(spark, sf_dir), "clinical_trials")
    return spark.sql("SELECT Type, count(*) AS count FROM clinical_trials GROUP BY Type")


def sanitized_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trials(spark, sf_dir)
    return sanitize_names(t.select(F.col("Id").alias('"Id'), F.col("Type").alias('Type",')))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    # ingest
    "clean_wide_rows": wide,
    "clean_narrow_rows": narrow,
    "clean_edge_quotes": edge_quotes,
    "month_truncation": lambda s, d: qn.month_columns(wide(s, d)).select(
        "Id", "Start_Cleaned", "Completion_Cleaned"),
    "month_labels": lambda s, d: qn.month_columns(wide(s, d)).select(
        "Id", "Start_Date", "Completion_Date"),
    # the five questions, DataFrame form
    "distinct_studies": lambda s, d: qn.distinct_studies(trials(s, d)),
    "distinct_rows": lambda s, d: qn.distinct_rows(trials(s, d)),
    "row_count": lambda s, d: qn.row_count(trials(s, d)),
    "study_types": lambda s, d: qn.study_types(trials(s, d)),
    "top_conditions": lambda s, d: qn.top_conditions(trials(s, d), 5),
    "top_conditions_untrimmed": lambda s, d: qn.top_conditions(trials(s, d), 5, trim=False),
    "top_unlisted_sponsors": lambda s, d: qn.top_unlisted_sponsors(trials(s, d),
                                                                   companies(s, d), 10),
    "unlisted_sponsor_rows": lambda s, d: qn.unlisted_sponsor_rows(trials(s, d),
                                                                   companies(s, d), 10),
    "completed_by_month": lambda s, d: qn.completed_months(trials(s, d), MONTH_YEAR),
    # further analyses
    "top_collaborators": lambda s, d: qn.top_collaborators(trials(s, d), 10),
    "status_counts": lambda s, d: qn.status_counts(trials(s, d)),
    "top_sponsors": lambda s, d: qn.top_sponsors(trials(s, d), 5),
    "funder_counts": lambda s, d: qn.funder_counts(trials(s, d)),
    "study_design_share": lambda s, d: qn.study_design_share(trials(s, d)),
    "starts_by_year": lambda s, d: qn.starts_by_year(trials(s, d)),
    "starts_by_year_split": lambda s, d: qn.starts_by_year_split(trials(s, d)),
    "enrollment_histogram": lambda s, d: qn.enrollment_histogram(trials(s, d), 20),
    "avg_enrollment_by_funder": lambda s, d: qn.avg_enrollment_by_funder(trials(s, d)),
    "enrollment_by_sponsor": lambda s, d: qn.enrollment_by_sponsor(trials(s, d), 10),
    "narrow_status_counts": lambda s, d: qn.status_counts(narrow(s, d)),
    # SQL form
    "sql_row_count": lambda s, d: sq.row_count(s, trials(s, d)),
    "sql_study_types": lambda s, d: sq.study_types(s, trials(s, d)),
    "sql_top_conditions": lambda s, d: sq.top_conditions(s, trials(s, d), 5),
    "sql_top_unlisted_sponsors": lambda s, d: sq.top_unlisted_sponsors(
        s, trials(s, d), companies(s, d), 10),
    "sql_completed_by_month": lambda s, d: sq.completed_by_month(s, trials(s, d), MONTH_YEAR),
    "sql_avg_enrollment": lambda s, d: sq.avg_enrollment(s, trials(s, d)),
    "sql_enrollment_by_sponsor": lambda s, d: sq.enrollment_by_sponsor(s, trials(s, d), 10),
    # streaming: the same parser over a file stream, run to the end of the input
    "stream_study_types": lambda s, d: counts_table(
        s, fixture(s, d, "wide"), "Type", max_files_per_trigger=2),
    # interactions and recommender
    "action_counts": lambda s, d: fq.value_counts(
        ratings(s, d), [USER_COL, ITEM_COL, RATING_COL, ACTION_COL], None),
    "top_played": lambda s, d: rc.top_items(ratings(s, d), "play", 10),
    "top_purchased": lambda s, d: rc.top_items(ratings(s, d), "purchase", 10),
    "member_count": lambda s, d: rc.distinct_members(ratings(s, d)),
    "behaviour_counts": lambda s, d: fq.value_counts(ratings(s, d).select(ACTION_COL),
                                                     ACTION_COL, "desc"),
    "item_index": lambda s, d: rc.item_index(rc.valid_ratings(ratings(s, d))),
    "rating_normalized": lambda s, d: rc.normalize_ratings(ratings(s, d)).select(
        "interaction_id", F.round(rc.NORMALIZED_COL, 6).alias(rc.NORMALIZED_COL)),
    "split_sizes": lambda s, d: _split_sizes(ratings(s, d)),
    "completed_by_month_int": lambda s, d: qn.completed_months(trials(s, d), MONTH_YEAR,
                                                               month_as_int=True),
    "completed_by_month_with_null": lambda s, d: qn.completed_months(
        trials(s, d), MONTH_YEAR, keep_null_month=True),
    "loaded_release_dates": loaded_release_dates,
    "narrow_conditions": lambda s, d: qn.top_conditions(narrow(s, d), 5, sep=","),
    "narrow_completed_by_month": lambda s, d: qn.completed_months(narrow(s, d), MONTH_YEAR),
    "view_study_types": view_study_types,
    "sanitized_columns": sanitized_columns,
    "item_index_hot": item_index_hot,
    "user_mean_rmse": user_mean_rmse,
    "als_rmse": als_rmse,
    "als_tuned": als_tuned,
    "als_tuned_b": lambda s, d: als_tuned(s, d, "grid_b"),
    "als_tuned_c": lambda s, d: als_tuned(s, d, "grid_c"),
}


def _split_sizes(r: DataFrame) -> DataFrame:
    train, test = rc.split_by_key(r, "interaction_id")
    both = train.select(F.lit("train").alias("split")).unionByName(
        test.select(F.lit("test").alias("split")))
    return fq.value_counts(both, "split", None)


FLAGSHIP = "top_unlisted_sponsors"
