"""Uniform shuffle into shards of exact sizes (native).

1. Rows fall into blocks by a hash; the block sizes are counted.
2. A hypergeometric communication matrix (``split_tree``) says how many rows of each
   block go to each chunk of each shard. Chunk sizes are fixed beforehand, so shard
   sizes are exact: any two differ by at most one row.
3. Within its block a row takes its place in a random order, which names its chunk.
4. The rows are exchanged to their chunks and permuted again; the chunk's first slot plus
   the place within it is the row's slot.

Only hashes of the row decide, so a recomputed task deals the same rows. No task ever
holds a whole shard: blocks and chunks grow in number with the shuffle partitions.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import row_hash, shuffle_partitions
from .split_tree import chunk_offset, even_sizes, locate, running, split_tree

LAW = "rows"


def shard(df: DataFrame, n_shards: int, seed: int = 17, n_blocks: int | None = None) -> DataFrame:
    """All rows of ``df`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in each
    shard).

    Columns of ``df`` may hold any hashable type and NULLs; columns named ``shard`` or
    ``slot`` are replaced. Wholly equal rows are kept, each with a slot of its own; which
    of them gets which slot has no meaning. An empty frame gives an empty result. With
    fewer rows than shards the first shards get one row each. Send only the columns that
    shall travel: every row is exchanged twice.
    """
    spark = df.sparkSession
    blocks = n_blocks or 4 * shuffle_partitions(spark)
    chunks = max(1, math.ceil(blocks / n_shards))
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")
    rows = df.select(row, row_hash(seed, df.columns).alias("h"),
                     row_hash(seed + 1, df.columns).alias("h2"))
    rows = rows.withColumn("block", F.pmod("h", F.lit(blocks)).cast("int"))

    sizes = (spark.range(blocks).select(F.col("id").cast("int").alias("block"))
             .join(rows.groupBy("block").count(), "block", "left")
             .agg(F.sort_array(F.collect_list(F.struct("block", F.coalesce("count", F.lit(0))
                                                       .alias("n")))).alias("b"))
             .select(F.transform("b", lambda x: x["n"]).alias("sizes")))
    total = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    root = (sizes.select("sizes", total.alias("total"))
            .select("sizes", "total", even_sizes(F.col("total"), n_shards, chunks).alias("counts")))
    matrix = split_tree(root, blocks, seed, shuffle_partitions(spark)).select(
        F.col("leaf").alias("block"), running(F.col("counts")).alias("ends"), "total")

    local = Window.partitionBy("block").orderBy("h", "h2")
    placed = (rows.withColumn("place", F.row_number().over(local) - 1)
              .join(matrix, "block")
              .select("row", "h", "h2", "total",
                      locate(F.col("ends"), F.col("place"), n_shards * chunks).alias("chunk")))
    again = Window.partitionBy("chunk").orderBy("h2", "h")
    shard_of = F.floor(F.col("chunk") / chunks).cast("int")
    slot = (chunk_offset(F.col("total"), F.col("chunk"), n_shards, chunks)
            + F.row_number().over(again) - 1)
    return (placed.withColumn("slot", slot.cast("long"))
            .select("row.*", shard_of.alias("shard"), "slot"))
