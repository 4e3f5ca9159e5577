"""Exclusion by a list: "the most common X that are not on list L".

Plan: aggregate the big side first (partial + final hash aggregate on the key), then
remove the listed keys from the *aggregated* rows. The list side is normalised,
de-duplicated and stripped of NULL/blank names (a NULL in a NOT IN list would empty
the result). No join is hinted: adaptive execution broadcasts the list when its runtime
size allows and otherwise shuffles the per-key counts - one row per key, never the raw
rows. Building a plan runs no job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_name
from .frequency import ordered


def listed_names(listed: DataFrame, list_col: str, normalize: bool = True) -> DataFrame:
    """Distinct, non-blank names of the list as column ``_listed``."""
    name = normalize_name(F.col(list_col)) if normalize else F.col(list_col)
    return (listed.select(name.alias("_listed"))
            .filter(F.col("_listed").isNotNull() & (F.col("_listed") != ""))
            .distinct())


def exclude_listed(df: DataFrame, key: str, listed: DataFrame, list_col: str,
                   normalize: bool = True) -> DataFrame:
    """Rows of ``df`` whose ``key`` is not on the list (anti join; rows with a NULL key
    are kept, duplicates on the left are kept)."""
    names = listed_names(listed, list_col, normalize)
    left_key = normalize_name(F.col(key)) if normalize else F.col(key)
    return df.join(names, left_key == F.col("_listed"), "left_anti")


def top_unlisted(df: DataFrame, key: str, listed: DataFrame, list_col: str, k: int = 10,
                 normalize: bool = True, drop_blank_keys: bool = False,
                 count_col: str = "count") -> DataFrame:
    """Top-k most frequent ``key`` values that are not on the list."""
    rows = df.select(key)
    if drop_blank_keys:
        rows = rows.filter(F.col(key).isNotNull() & (F.col(key) != ""))
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias(count_col))
    names = listed_names(listed, list_col, normalize)
    left_key = normalize_name(F.col(key)) if normalize else F.col(key)
    # Left outer + null test instead of left_anti: the optimizer would push a left
    # anti join below the aggregate (onto raw rows); the outer join keeps the
    # exclusion on the aggregated rows, one per key.
    kept = (counts.join(names, left_key == F.col("_listed"), "left_outer")
            .filter(F.col("_listed").isNull()).drop("_listed"))
    return ordered(kept, [key], count_col, "desc", k)
