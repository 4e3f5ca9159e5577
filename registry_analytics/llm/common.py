"""Helpers shared by the pipeline operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, release_unused, removed

# a word is a run of characters other than space, tab, newline, VT, FF and CR
WORD = r"[^\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# paths of the tables of every open ``scratch``, the innermost last
_SCRATCH: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


def written(df: DataFrame, label: str, lasting: bool = False) -> DataFrame:
    """``df`` written once as Parquet under the shared checkpoint folder and read back.

    Cuts the lineage: later reads come from files that survive the loss of executors,
    and a plan that uses the table several times computes it once. A ``lasting`` table
    outlives the ``scratch`` that it is written in (not one around that).
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    around = _SCRATCH.get()[:-1] if lasting else _SCRATCH.get()
    if around:
        around[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """The tables ``written`` inside are removed at the end, the shuffle files of their jobs too.
    A DataFrame that is used later must read lasting ones only."""
    paths: list[str] = []
    token = _SCRATCH.set((*_SCRATCH.get(), paths))
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        for path in paths:
            removed(spark, path)
        release_unused(spark)


def row_hash(seed: int, columns: list[str]) -> Column:
    """64-bit hash of a whole row; NULL differs from any value by its flag."""
    flags = F.concat_ws("", *[F.col(f"`{c}`").isNull().cast("string") for c in columns])
    return F.xxhash64(F.lit(seed), flags, *[F.col(f"`{c}`") for c in columns])


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def unit_interval(*parts: Column) -> Column:
    """A number in (0, 1) that is a function of ``parts``."""
    bits = F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(2 ** 53))


_HELD: dict[Hashable, Any] = {}


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """``make()``, kept by a Python worker until ``released``. Workers outlive the stages of a job;
    so one key is kept at a time, and whoever brings another frees the tables of the one before.
    """
    if key not in _HELD:
        released()
        _HELD[key] = make()
    return _HELD[key]


def released() -> None:
    """Drop what ``held`` keeps. At the end of a task: Spark deals tasks to its idle workers in turn,
    and there are as many of them as the stage with the most Python steps had at once, so tables
    kept between tasks would stand in all of them."""
    _HELD.clear()
    freed()


def freed() -> None:
    """Give memory that is no longer used back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, the way
    ``spark-submit --py-files`` would. The archive is made in a temporary folder of the
    driver, from where Spark serves it."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="py-files-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)
