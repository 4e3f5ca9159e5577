"""Date-text expressions. Dates stay text (``YYYY-MM-DD`` or ``YYYY-MM``) as in the
extracts; these derive month text, month labels, year and month numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col

# Fixed values (they must equal the registry conventions):
#   day-dropping pattern: a whole-word YYYY-MM-DD date keeps its YYYY-MM part
#   month text parsed as year-month (month with or without a leading zero): yyyy-M
#   month label: abbreviated English month, space, four-digit year ("May 2023"): MMM yyyy
#   date parts are separated by "-"
_DAY_PATTERN = r"\b(\d{4}-\d{2})-\d{2}\b"
MONTH_PARSE_FORMAT = "yyyy-M"
MONTH_LABEL_FORMAT = "MMM yyyy"
DATE_SEP = "-"


def to_month(c) -> Column:
    """``2023-05-17`` -> ``2023-05``; anything else unchanged; null stays null."""
    return F.regexp_replace(_col(c), _DAY_PATTERN, "$1")


def format_month(c) -> Column:
    """``2023-05`` / ``2023-5`` -> ``May 2023``; unparseable or blank text passes through.

    ``try_to_timestamp`` returns NULL instead of failing under ANSI mode, and the
    ``coalesce`` falls back to the input text exactly like a failed parse would.
    """
    c = _col(c)
    parsed = F.try_to_timestamp(c, F.lit(MONTH_PARSE_FORMAT))
    return F.coalesce(F.date_format(parsed, MONTH_LABEL_FORMAT), c)


def part_of(c, k: int, sep: str = DATE_SEP) -> Column:
    """k-th (0-based) ``sep``-separated part, NULL when absent (never an index error)."""
    return F.get(F.split(_col(c), r"\Q" + sep + r"\E", -1), k)


def year_text(c) -> Column:
    return part_of(c, 0)


def month_text(c) -> Column:
    """Month part of ``YYYY-MM[-DD]`` text with stray ``,`` and ``"`` removed."""
    return F.translate(part_of(c, 1), ',"', "")


def year_prefix(c) -> Column:
    """First four characters (the start-year rule)."""
    return F.substring(_col(c), 1, 4)


def with_date_columns(df, start: str = "Start", completion: str = "Completion",
                      drop_originals: bool = True):
    """Add ``Start_Cleaned``, ``Completion_Cleaned`` (month text) and ``Start_Date``,
    ``Completion_Date`` (month labels); drop the original columns by default."""
    out = df.select(
        "*",
        to_month(start).alias("Start_Cleaned"),
        to_month(completion).alias("Completion_Cleaned"),
    )
    out = out.select(
        "*",
        format_month("Start_Cleaned").alias("Start_Date"),
        format_month("Completion_Cleaned").alias("Completion_Date"),
    )
    if drop_originals:
        out = out.drop(start, completion)
    return out
