"""Lenient delimited-line ingest.

Registry extracts are text files, one record per line, fields separated by a single
character, with stray commas, quotes and white space around fields, short lines that
need padding, over-long lines that must be dropped and a header line (repeated once per
file when a release is split into several files).

Everything here is a narrow, per-row transformation of ``spark.read.text``: no job is
triggered, nothing is collected, and column pruning removes the cleaning work of every
column a query does not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import clean_token, delete_commas, split_literal, strip_quotes, strip_space
from ..schemas import NARROW_COLUMNS, WIDE_COLUMNS

# Cleaning rules for one token:
#   "full"  - delete commas, strip white space, strip quotes (the wide release rule)
#   "none"  - keep the token as read (the narrow release rule)
#   "edges" - delete commas in every token, strip quotes only in the first and the last
#             column, strip the whole line once before splitting, pad with NULL
CLEAN_RULES = ("full", "none", "edges")


def read_lines(spark: SparkSession, path: str | Sequence[str], with_source: bool = False,
               line_sep: str | None = None) -> DataFrame:
    """Scan text lines from a file, a directory, a glob or a list of those.

    ``with_source`` adds ``source_file`` from the hidden ``_metadata`` column so a
    multi-file release keeps its provenance without an extra pass.
    """
    reader = spark.read
    if line_sep is not None:
        reader = reader.option("lineSep", line_sep)
    df = reader.text(path if isinstance(path, str) else list(path))
    if with_source:
        df = df.select("value", F.col("_metadata.file_path").alias("source_file"))
    return df


def _names(columns) -> list[str]:
    if isinstance(columns, StructType):
        return [f.name for f in columns.fields]
    return list(columns)


def parse_lines(lines: DataFrame, columns: Sequence[str] | StructType, sep: str = "\t",
                clean: str | bool = "full", header: Sequence[str] | str | None = "columns",
                value_col: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """Turn a DataFrame of raw lines into one string column per field.

    * split ``value_col`` on the literal ``sep``;
    * drop lines with more tokens than ``columns``;
    * pad missing trailing fields (``''``; NULL for the ``edges`` rule);
    * clean each token by ``clean`` (see ``CLEAN_RULES``; ``True``/``False`` mean
      ``full``/``none``);
    * drop every line that equals the header. ``header="columns"`` takes the header names
      from ``columns``; ``"first"`` takes them from the first line of the input (one line
      is read, a bounded single row); pass a list when a release names its header
      differently, or ``None`` to keep all lines.

    ``keep`` lists extra input columns (e.g. ``source_file``) carried through unchanged.
    """
    if clean is True:
        clean = "full"
    elif clean is False:
        clean = "none"
    if clean not in CLEAN_RULES:
        raise ValueError(f"clean must be one of {CLEAN_RULES}, got {clean!r}")
    names = _names(columns)
    n = len(names)

    line = F.col(value_col)
    if clean == "edges":
        line = strip_space(line)
    # separators are counted, so an over-long line is never split
    n_seps = (F.length(line) - F.length(F.replace(line, F.lit(sep)))) / len(sep)
    rows = lines.filter(n_seps < n)
    if header == "columns":
        header_names = names
    elif header == "first":
        first = parse_lines(lines.select(value_col).limit(1), names, sep, clean, None,
                            value_col).first()
        header_names = None if first is None else ["" if v is None else v for v in first]
    else:
        header_names = None if header is None else list(header)
    if header_names is not None:
        if len(header_names) != n:
            raise ValueError("header must name every column")
        rows = rows.filter(~_is_header(line, sep, header_names, clean))
    tok = rows.select(*keep, split_literal(line, sep).alias("_tok"))

    def field(i: int) -> Column:
        raw = F.get(F.col("_tok"), i)
        if clean == "full":
            return F.coalesce(clean_token(raw), F.lit(""))
        if clean == "none":
            return F.coalesce(raw, F.lit(""))
        c = delete_commas(raw)
        if i in (0, n - 1):
            c = strip_quotes(c)
        return c

    return tok.select(*keep, *[field(i).alias(name) for i, name in enumerate(names)])


def _cleaned_tokens(tok: Column, clean: str, n: int) -> Column:
    """All tokens of a row cleaned by ``clean`` and padded to ``n``, as one array.

    A higher-order ``transform`` keeps the generated code of the filter small whatever
    the number of columns (one call instead of one inlined expression per column).
    """
    if clean == "full":
        arr = F.transform(tok, lambda x: F.coalesce(clean_token(x), F.lit("")))
    elif clean == "none":
        arr = tok
    else:
        arr = F.transform(tok, lambda x, i: F.when((i == 0) | (i == n - 1),
                                                  strip_quotes(delete_commas(x)))
                          .otherwise(delete_commas(x)))
    pad = F.lit(None).cast("string") if clean == "edges" else F.lit("")
    missing = F.greatest(F.lit(n) - F.size(tok), F.lit(0))
    return F.concat(arr, F.array_repeat(pad, missing))


def _is_header(line: Column, sep: str, header_names: list[str], clean: str) -> Column:
    """True exactly for lines whose cleaned, padded fields equal the header names.

    A cheap necessary condition comes first: the line up to the first named column, with
    the characters that the rule deletes taken out, holds that name. Only such candidates
    are split and compared in full.
    """
    n = len(header_names)
    expected = F.array(*[F.lit(h) for h in header_names])
    full = _cleaned_tokens(split_literal(line, sep), clean, n).eqNullSafe(expected)
    first = next((i for i, h in enumerate(header_names) if h), None)
    if first is None:
        return full
    start = F.substring_index(line, sep, first + 1)
    if clean != "none":
        start = delete_commas(start)
    return F.when(F.instr(start, header_names[first]) > 0, full).otherwise(F.lit(False))


def parse_wide(lines: DataFrame, clean: str | bool = "full", header="columns",
               value_col: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """The 14-field tab-separated layout."""
    return parse_lines(lines, WIDE_COLUMNS, "\t", clean, header, value_col, keep)


def parse_narrow(lines: DataFrame, clean: str | bool = "none", header="columns",
                 value_col: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """The 9-field pipe-separated layout (older releases; not cleaned by default)."""
    return parse_lines(lines, NARROW_COLUMNS, "|", clean, header, value_col, keep)


def load_release(spark: SparkSession, path, columns=WIDE_COLUMNS, sep: str = "\t",
                 clean: str | bool = "full", header="columns", with_source: bool = False,
                 dates: bool = False) -> DataFrame:
    """One loader for every release layout: read lines, parse, optionally add the
    month/label date columns."""
    lines = read_lines(spark, path, with_source=with_source)
    keep = ("source_file",) if with_source else ()
    df = parse_lines(lines, columns, sep, clean, header, keep=keep)
    if dates:
        from ..functions.dates import with_date_columns
        df = with_date_columns(df)
    return df


def save_release(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Write a cleaned release as a parquet table (ingest once, query many times).

    Questions then read only the columns they use and get filters pushed into the
    scan, instead of re-splitting and re-cleaning every text line per question.
    """
    df.write.mode(mode).parquet(path)
    return path


def read_release_table(spark: SparkSession, path: str) -> DataFrame:
    """Read a table written by :func:`save_release`."""
    return spark.read.parquet(path)
