"""The registry questions, each a DataFrame plan over a cleaned release table.

``trials`` is the output of the line parser (optionally with the date columns from
``functions.dates.with_date_columns``). Every function returns a lazy DataFrame with
aliased columns; top-k results are ordered with a key tie-break.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import format_month, to_month
from ..functions.numbers import to_int
from ..operators import frequency as fq
from ..operators.exclusion import exclude_listed, top_unlisted
from ..operators.numeric import avg_by, histogram, sum_by
from ..operators.periods import completed_by_month, counts_by_year
from ..schemas import COMPANY_COLUMN


def distinct_studies(trials: DataFrame) -> DataFrame:
    """Distinct study ids (the default meaning of "number of studies")."""
    return fq.distinct_keys(trials, "Id", "distinct_studies")


def distinct_rows(trials: DataFrame) -> DataFrame:
    return fq.distinct_rows(trials, "distinct_rows")


def row_count(trials: DataFrame) -> DataFrame:
    return fq.row_count(trials, "row_count")


def study_types(trials: DataFrame, limit: int | None = None) -> DataFrame:
    return fq.value_counts(trials.select("Type"), "Type", "desc", limit)


def top_conditions(trials: DataFrame, k: int = 5, trim: bool = True,
                   sep: str = "|") -> DataFrame:
    """``sep``: the wide release joins conditions with ``|``, older ones with ``,``."""
    return fq.token_counts(trials, "Conditions", sep, trim=trim, out_col="condition", limit=k)


def top_unlisted_sponsors(trials: DataFrame, companies: DataFrame, k: int = 10,
                          normalize: bool = True) -> DataFrame:
    return top_unlisted(trials, "Sponsor", companies, COMPANY_COLUMN, k, normalize=normalize)


def unlisted_sponsor_rows(trials: DataFrame, companies: DataFrame, k: int = 10) -> DataFrame:
    """Same question, row-wise: anti join every trial row against the list (keeps
    duplicates, like a set subtraction that is not de-duplicated), then count."""
    rows = exclude_listed(trials.select("Sponsor"), "Sponsor", companies, COMPANY_COLUMN)
    return fq.value_counts(rows, "Sponsor", "desc", k)


def completed_months(trials: DataFrame, year: str | int, month_as_int: bool = False,
                     keep_null_month: bool = False) -> DataFrame:
    """Completed studies per month of ``year``.

    Month truncation only drops a ``-DD`` suffix, so year and month are the same parts of
    the raw date; without ``Completion_Cleaned`` the raw column is read, where the year
    prefix is pushed into the scan (``StringStartsWith`` lets parquet skip row groups).
    """
    date = "Completion_Cleaned" if "Completion_Cleaned" in trials.columns else "Completion"
    return completed_by_month(trials, year, date_col=date, month_as_int=month_as_int,
                              keep_null_month=keep_null_month)


def top_collaborators(trials: DataFrame, k: int = 10) -> DataFrame:
    return fq.value_counts(trials.select("Collaborators"), "Collaborators", "desc", k)


def status_counts(trials: DataFrame) -> DataFrame:
    return fq.value_counts(trials.select("Status"), "Status", "asc")


def top_sponsors(trials: DataFrame, k: int = 5) -> DataFrame:
    return fq.value_counts(trials.select("Sponsor"), "Sponsor", "desc", k)


def funder_counts(trials: DataFrame) -> DataFrame:
    return fq.value_counts(trials.select("Funder Type"), "Funder Type", "asc")


def study_design_share(trials: DataFrame, digits: int = 1) -> DataFrame:
    counts = fq.value_counts(trials.select("Study Design"), "Study Design", None)
    return fq.share(counts, "count", "pct", digits).orderBy(
        F.col("count").asc(), F.col("Study Design").asc())


def starts_by_year(trials: DataFrame) -> DataFrame:
    # truncation to the month leaves the first four characters alone
    date = "Start_Cleaned" if "Start_Cleaned" in trials.columns else "Start"
    return counts_by_year(trials, date, "prefix", "start_year")


def starts_by_year_split(trials: DataFrame) -> DataFrame:
    """Trials per start year, year = text before the first ``-`` of ``Start``."""
    return counts_by_year(trials, "Start", "split", "start_year")


def enrollment_histogram(trials: DataFrame, bins: int = 20) -> DataFrame:
    return histogram(trials, to_int("Enrollment"), bins)


def avg_enrollment_by_funder(trials: DataFrame, digits: int | None = 4) -> DataFrame:
    return avg_by(trials, "Funder Type", "Enrollment", "avg_enrollment", "desc", digits)


def enrollment_by_sponsor(trials: DataFrame, k: int = 10) -> DataFrame:
    return sum_by(trials, "Sponsor", "Enrollment", "total_enrollment", "desc", k)


def month_columns(trials: DataFrame) -> DataFrame:
    """Id with month text and month labels of both dates."""
    sc, cc = to_month("Start"), to_month("Completion")
    return trials.select("Id", sc.alias("Start_Cleaned"), cc.alias("Completion_Cleaned"),
                         format_month(sc).alias("Start_Date"),
                         format_month(cc).alias("Completion_Date"))
