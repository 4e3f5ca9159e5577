"""Counts per calendar period, from date text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import month_text, year_prefix, year_text
from .frequency import value_counts


def completed_by_month(df: DataFrame, year: str | int, status: str = "COMPLETED",
                       date_col: str = "Completion_Cleaned", status_col: str = "Status",
                       keep_null_month: bool = False, count_col: str = "count",
                       month_col: str = "Month", month_as_int: bool = False) -> DataFrame:
    """Rows with ``status`` whose ``date_col`` falls in ``year``, counted per month.

    Month is the second ``-``-separated part as text (NULL when the date has no month;
    those rows are dropped unless ``keep_null_month``); ``month_as_int`` makes it an INT
    so ``5`` sorts before ``10``. The status and prefix predicates are plain
    comparisons, so they are pushed into the scan of a columnar source.
    """
    year = str(year)
    month = month_text(date_col)
    if month_as_int:
        month = month.try_cast("int")
    rows = (df.filter((F.col(status_col) == status) & F.col(date_col).startswith(year))
            .select(year_text(date_col).alias("_year"), month.alias(month_col))
            .filter(F.col("_year") == year))
    if not keep_null_month:
        rows = rows.filter(F.col(month_col).isNotNull())
    return value_counts(rows, [month_col], order="key", count_col=count_col)


def counts_by_year(df: DataFrame, date_col: str = "Start_Cleaned", rule: str = "prefix",
                   year_col: str = "start_year", count_col: str = "count") -> DataFrame:
    """Rows per year of ``date_col``: ``prefix`` = first four characters, ``split`` =
    text before the first ``-``."""
    year = year_prefix(date_col) if rule == "prefix" else year_text(date_col)
    return value_counts(df.select(year.alias(year_col)), [year_col], order="key",
                        count_col=count_col)
