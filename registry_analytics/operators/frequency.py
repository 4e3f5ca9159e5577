"""Counting operators: distinct counts, frequencies, multi-valued token frequencies,
shares. Each frequency is one partial + final hash aggregate around a single shuffle;
a top-k is ``orderBy().limit()``, planned as TakeOrderedAndProject (no full sort)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import split_literal, strip_space

ORDERS = ("desc", "asc", "key", None)


def _keys(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def sort_columns(keys: Sequence[str], count_col: str, order: str | None) -> list[Column]:
    """Sort spec with a key tie-break so every result is deterministic."""
    if order == "desc":
        return [F.col(count_col).desc()] + [F.col(k).asc() for k in keys]
    if order == "asc":
        return [F.col(count_col).asc()] + [F.col(k).asc() for k in keys]
    if order == "key":
        return [F.col(k).asc() for k in keys]
    if order is None:
        return []
    raise ValueError(f"order must be one of {ORDERS}")


def ordered(df: DataFrame, keys, count_col: str, order: str | None,
            limit: int | None) -> DataFrame:
    spec = sort_columns(_keys(keys), count_col, order)
    if spec:
        df = df.orderBy(*spec)
    if limit is not None:
        df = df.limit(limit)
    return df


def value_counts(df: DataFrame, keys, order: str | None = "desc", limit: int | None = None,
                 count_col: str = "count", drop_null: bool = False) -> DataFrame:
    """Frequency of each key (or key tuple)."""
    keys = _keys(keys)
    if drop_null:
        df = df.dropna(subset=keys)
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count_col))
    return ordered(out, keys, count_col, order, limit)


def token_counts(df: DataFrame, column: str, sep: str = "|", trim: bool = True,
                 drop_blank: bool = True, out_col: str | None = None,
                 order: str | None = "desc", limit: int | None = None,
                 count_col: str = "count") -> DataFrame:
    """Frequency of the items of a ``sep``-joined multi-valued column.

    ``trim=True`` groups by the white-space-stripped item. ``trim=False`` groups by the
    item as written and only strips it for display, so one label can appear twice
    (the literal SQL behaviour). The explode stays before the aggregate, so each map
    task combines its own items before the shuffle.
    """
    out_col = out_col or column
    items = df.select(F.explode(split_literal(F.col(column), sep)).alias("_item"))
    if trim:
        items = items.select(strip_space("_item").alias(out_col))
        if drop_blank:
            items = items.filter(F.col(out_col) != "")
        counts = items.groupBy(out_col).agg(F.count(F.lit(1)).alias(count_col))
        return ordered(counts, [out_col], count_col, order, limit)
    if drop_blank:
        items = items.filter(F.col("_item") != "")
    counts = items.groupBy("_item").agg(F.count(F.lit(1)).alias(count_col))
    counts = counts.select(strip_space("_item").alias(out_col), count_col, "_item")
    spec = sort_columns([out_col, "_item"], count_col, order)
    if spec:
        counts = counts.orderBy(*spec)
    if limit is not None:
        counts = counts.limit(limit)
    return counts.drop("_item")


def distinct_keys(df: DataFrame, key: str, out_col: str = "distinct_count") -> DataFrame:
    """Number of distinct non-null values of ``key`` (a one-row DataFrame).

    Planned as a two-level aggregate: partial dedupe per map task, shuffle on the key,
    then a count — a hot key collapses map-side.
    """
    return df.agg(F.count_distinct(F.col(key)).alias(out_col))


def distinct_rows(df: DataFrame, out_col: str = "distinct_rows") -> DataFrame:
    """Number of distinct whole rows."""
    return df.distinct().agg(F.count(F.lit(1)).alias(out_col))


def row_count(df: DataFrame, out_col: str = "row_count") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(out_col))


def share(counts: DataFrame, count_col: str = "count", out_col: str = "pct",
          digits: int = 1) -> DataFrame:
    """Percentage of each group in the total, rounded half-up to ``digits`` decimals.

    The total is a scalar subquery, so the groups stay distributed however many there
    are. Rounding is exact integer arithmetic, free of binary-fraction ties.
    """
    total = counts.agg(F.sum(F.col(count_col))).scalar()
    return counts.withColumn(out_col, _half_up_percent(F.col(count_col), total, digits))


def _half_up_percent(part: Column, total: Column, digits: int) -> Column:
    """``round(part * 100 / total, digits)`` half-up: floor((2 * part * 100 * 10^d +
    total) / (2 * total)) / 10^d, with the floor taken on integers."""
    scale = 10 ** digits
    num = part * (200 * scale) + total
    den = total * 2
    units = ((num - F.pmod(num, den)) / den).cast("long")
    return units.cast("double") / F.lit(float(scale))
