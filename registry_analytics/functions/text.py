"""Token-level text expressions (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (the registry cleaning rule): every "," is deleted, then white space is
# stripped at both ends, then every leading and trailing '"'.
DELETED_CHARS = ","
QUOTE = '"'

# Characters a Python ``str.strip()`` removes (every code point whose ``isspace()`` is
# true; none lies above U+3000). Derived by rule, so it stays in step with Python.
WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def delete_commas(c) -> Column:
    """Remove every ``,`` (translate is a char map, cheaper than a regex)."""
    return F.translate(_col(c), DELETED_CHARS, "")


def strip_space(c) -> Column:
    """Strip white space at both ends (Spark's plain trim only removes ASCII blanks)."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def strip_quotes(c) -> Column:
    """Strip every leading and trailing double quote."""
    return F.btrim(_col(c), F.lit(QUOTE))


def clean_token(c) -> Column:
    """Registry token cleaning: delete commas, strip white space, then strip quotes.

    Two nested trims and a character map: no regular expression, so the per-field
    cost stays small enough to clean every column of wide extracts.
    """
    return strip_quotes(strip_space(delete_commas(c)))


def normalize_name(c) -> Column:
    """Name key used to match names across sources (same rule as token cleaning)."""
    return clean_token(c)


def sanitize_name(name: str) -> str:
    """Column-name sanitising: strip ``,`` then ``"`` at both ends (a driver-side string op
    on schema names, not on data)."""
    return name.strip(",").strip('"')


def sanitize_names(df):
    """Rename every column with :func:`sanitize_name`."""
    return df.toDF(*[sanitize_name(c) for c in df.columns])


def split_literal(c, sep: str) -> Column:
    """Split on a literal separator (Spark's split takes a regex; quote it)."""
    return F.split(_col(c), r"\Q" + sep + r"\E", -1)
