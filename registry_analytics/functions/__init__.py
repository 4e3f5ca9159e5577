from .dates import (format_month, month_text, part_of, to_month, with_date_columns,
                    year_prefix, year_text)
from .numbers import is_int_text, to_double, to_int
from .text import (clean_token, delete_commas, normalize_name, sanitize_name, sanitize_names,
                   split_literal, strip_quotes, strip_space)

__all__ = [
    "clean_token", "delete_commas", "normalize_name", "sanitize_name", "sanitize_names",
    "split_literal", "strip_quotes", "strip_space", "format_month", "month_text", "part_of",
    "to_month", "with_date_columns", "year_prefix", "year_text", "is_int_text", "to_double",
    "to_int",
]
