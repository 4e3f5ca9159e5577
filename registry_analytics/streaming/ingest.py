"""Structured Streaming over a folder where registry extracts arrive.

The batch parser is a set of stateless per-row expressions, so it applies unchanged to
``readStream.text``: every new file is split, padded, cleaned and stripped of its header
line as it lands. Running counts are a streaming aggregation (state = one row per key
in the state store); the result is kept as a table by ``foreachBatch``, which rewrites
the full counts each micro-batch (idempotent on replay).

For large key sets set ``spark.sql.streaming.stateStore.providerClass`` to the RocksDB
provider so state lives off-heap and is checkpointed incrementally.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import WIDE_COLUMNS
from ..session import ensure_checkpoint_dir
from ..sources.lines import parse_lines


def stream_lines(spark: SparkSession, path: str, max_files_per_trigger: int | None = None,
                 with_source: bool = False,
                 max_bytes_per_trigger: int | None = None) -> DataFrame:
    """Text lines of the files arriving under ``path``. Bound each micro-batch by file
    count and/or bytes so a backlog of large extracts is taken in steps."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    if max_bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", int(max_bytes_per_trigger))
    df = reader.load(path)
    if with_source:
        df = df.select("value", F.col("_metadata.file_path").alias("source_file"))
    return df


def stream_release(spark: SparkSession, path: str, columns=WIDE_COLUMNS, sep: str = "\t",
                   clean="full", header="columns", max_files_per_trigger: int | None = None,
                   max_bytes_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of cleaned release rows."""
    lines = stream_lines(spark, path, max_files_per_trigger,
                         max_bytes_per_trigger=max_bytes_per_trigger)
    return parse_lines(lines, columns, sep, clean, header)


def running_counts(rows: DataFrame, key: str, count_col: str = "count") -> DataFrame:
    """Streaming frequency of ``key`` (partial aggregation per micro-batch, merged with
    the state of earlier batches)."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias(count_col))


def scratch_location(spark: SparkSession, kind: str) -> str:
    """A fresh folder under the session's checkpoint directory."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/registry-streams/{kind}-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, out_path: str, checkpoint: str,
                  output_mode: str = "complete") -> str:
    """Process everything available now, write the full result of each micro-batch as
    parquet under ``out_path``, stop. Returns ``out_path``.

    Every batch has a folder of its own, whose files appear when the write commits: a
    reader (see :func:`latest`) always finds the last whole result, and a batch that is
    run again after a crash replaces its own folder only.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/epoch={epoch}")

    q = (stream.writeStream.outputMode(output_mode).foreachBatch(write)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return out_path


def latest(spark: SparkSession, out_path: str) -> DataFrame:
    """The result of the last committed micro-batch under ``out_path``."""
    df = spark.read.parquet(out_path)
    return df.filter(F.col("epoch") == df.select(F.max("epoch")).scalar()).drop("epoch")


def counts_table(spark: SparkSession, path: str, key: str, columns=WIDE_COLUMNS,
                 sep: str = "\t", clean="full", max_files_per_trigger: int | None = None,
                 count_col: str = "count",
                 max_bytes_per_trigger: int | None = None) -> DataFrame:
    """Stream the extracts under ``path`` to the end, return the frequency table of
    ``key`` as a batch DataFrame read back from the stream's output."""
    rows = stream_release(spark, path, columns, sep, clean,
                          max_files_per_trigger=max_files_per_trigger,
                          max_bytes_per_trigger=max_bytes_per_trigger)
    counts = running_counts(rows, key, count_col)
    out = scratch_location(spark, "out")
    run_available(counts, out, scratch_location(spark, "state"))
    return latest(spark, out)
