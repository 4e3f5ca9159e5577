"""DataFrame operators: frequencies, exclusion by a list, periods, numbers, recommender."""

from .exclusion import exclude_listed, top_unlisted
from .frequency import distinct_keys, distinct_rows, row_count, share, token_counts, value_counts
from .numeric import avg_by, histogram, int_histogram, min_max, min_max_scale, sum_by
from .periods import completed_by_month, counts_by_year

__all__ = [
    "exclude_listed", "top_unlisted", "distinct_keys", "distinct_rows", "row_count", "share",
    "token_counts", "value_counts", "avg_by", "histogram",
    "int_histogram", "min_max", "min_max_scale", "sum_by", "completed_by_month",
    "counts_by_year",
]
