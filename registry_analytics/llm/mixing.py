"""Mixing sources to target weights (native).

Each source gets a target share of all words. The sources' documents stand in a random
order of their own; a source whose target exceeds its size is read in whole rounds first,
and the rest of its target is drawn from the order. One block of the mix is one copy of a
document, so a source's quota is an exact number of blocks.

A multivariate hypergeometric splitting tree (``split_tree``) divides the quotas among
the chunks of the output shards: every chunk has a fixed size, every source's quota is used
up exactly. A chunk then draws its disjoint run of each source's blocks in their random
order, and its rows are shuffled locally.

Orders within a source come from two levels (hash bucket, place within the bucket), so a
source with a third of all rows is spread over as many tasks as there are buckets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, row_hash, shuffle_partitions, written
from .split_tree import chunk_offset, even_sizes, locate, running, split_tree

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3


def word_count(text: Column) -> Column:
    """Words of a text; NULL has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Target words of each source. ``sizes``: one row per source with ``src`` (a sort key),
    ``words`` and any further columns.

    Sources in order of ``src`` weigh ``weights`` in turn and share the sum of all words.
    A target stops at ``max_repeat`` times its source's words and the excess is reshared
    by weight until none is above: every target is min(cap, level x weight) with one level.
    In ascending order of cap / weight the first source whose cap is not below its share of
    what is left fixes the level. One row per source passes through; sources are names of a
    catalogue, not data.
    """
    everything = Window.orderBy("src")
    ix = F.row_number().over(everything) - 1
    table = F.array(*[F.lit(float(w)) for w in weights])
    df = sizes.withColumn("src_ix", ix).withColumn(
        "weight", F.element_at(table, (F.col("src_ix") % len(weights) + 1).cast("int")))
    df = df.withColumn("cap", F.col("words") * max_repeat).withColumn(
        "edge", F.col("cap") / F.col("weight"))
    by_edge = Window.orderBy("edge", "src_ix")
    all_rows = Window.partitionBy()
    before = by_edge.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("words").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weight_left = F.sum("weight").over(by_edge.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumn("level", left / weight_left)
    fixed = F.min(F.when(F.col("edge") >= F.col("level"), F.struct("edge", "src_ix", "level")))
    df = df.withColumn("level", fixed.over(all_rows)["level"])
    return df.withColumn("target", F.least(F.col("cap").cast("double"),
                                           F.col("level") * F.col("weight"))) \
             .drop("cap", "edge", "weight", "level")


def _keyed(df: DataFrame, source_col: str, size_col: str, seed: int, buckets: int) -> DataFrame:
    src = F.col(f"`{source_col}`").cast("string")
    return df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
        # NULL sorts after every name
        F.when(src.isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), src)).alias("src"),
        F.greatest(F.coalesce(F.col(f"`{size_col}`").cast("long"), F.lit(0)),
                   F.lit(0).cast("long")).alias("size"),
        row_hash(seed, df.columns).alias("h"), row_hash(seed + 1, df.columns).alias("h2"),
    ).withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))


def _next_run(state: DataFrame, placed: DataFrame) -> DataFrame:
    """Of each source the rows behind ``at`` that are not above what is missing, in order
    while they fit together: ``src``, ``bucket``, ``place``, ``size``, ``nth`` (from 0). Rows
    before ``at`` are taken or larger than what was missing then, and so never fit again."""
    key = ["src", "bucket"]
    seek = F.broadcast(state.select("src", "missing", "at"))  # one row per source
    free = written(
        placed.filter(F.col("size") > 0).select(*key, "place", "size").join(seek, "src")
        .filter((F.col("place") > F.col("at")) & (F.col("size") <= F.col("missing"))), "mix-free")
    ahead = Window.partitionBy("src").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    before = free.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("w")).select(
        *key, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("n0"),
        F.coalesce(F.sum("w").over(ahead), F.lit(0)).alias("w0"))
    local = Window.partitionBy(*key).orderBy("place")
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    return (free.join(before, key)
            .withColumn("nth", F.col("n0") + F.row_number().over(local) - 1)
            .withColumn("end", F.col("w0") + F.sum("size").over(upto))
            .filter(F.col("end") <= F.col("missing")).select(*key, "place", "size", "nth"))


def _advance(state: DataFrame, run: DataFrame) -> DataFrame:
    """``state`` after the rows of ``run``."""
    got = run.groupBy("src").agg(F.sum("size").alias("g"), F.count(F.lit(1)).alias("c"),
                                 F.max("place").alias("p"))
    return state.join(got, "src", "left").withColumns({
        "missing": F.col("missing") - F.coalesce("g", F.lit(0)),
        "taken": F.col("taken") + F.coalesce("c", F.lit(0)),
        "at": F.greatest("at", F.coalesce("p", F.lit(-1)))}).drop("g", "c", "p")


def _fill(state: DataFrame, placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the partial round behind its first prefix: runs that fit until no row fits,
    then of each source one row if it brings the source nearer to its target. Returns the
    state and ``src``, ``bucket``, ``place``, ``seat`` of these rows.

    Each run takes a row if one fits, and ends before a row larger than what it leaves, so
    what is missing falls below the size of a row that was met at random."""
    key = ["src", "bucket"]
    extra = None
    while True:
        run = written(_next_run(state, placed).join(
            F.broadcast(state.select("src", "taken")), "src").select(
            *key, "place", "size", (F.col("taken") + F.col("nth")).alias("seat")), "mix-run")
        if extra is not None and run.isEmpty():
            break
        extra = run if extra is None else extra.unionByName(run)
        state = written(_advance(state, run), "mix-quotas")
    # every free row is larger than what is missing now
    off = F.col("size") - F.col("missing")
    free = placed.filter(~F.col("fits") & (F.col("size") > 0)).select(*key, "place", "size").join(
        F.broadcast(state.select("src", "missing", "taken")), "src").filter(
        (off > 0) & (off < F.col("missing"))).join(extra.select(*key, "place"),
                                                   [*key, "place"], "left_anti")
    best = free.groupBy("src").agg(F.min(F.struct(
        off.alias("off"), "place", "bucket", "size", "taken")).alias("b"))
    last = written(best.select("src", "b.bucket", "b.place", "b.size",
                               F.col("b.taken").alias("seat")), "mix-run")
    return (written(_advance(state, last), "mix-quotas"),
            written(extra.unionByName(last).drop("size"), "mix-extra"))


def draw(df: DataFrame, n_shards: int = 8, source_col: str = "source", size_col: str = "size",
         weights=WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = 29) -> DataFrame:
    """What the mix takes of every row.

    Returns ``row`` (the input row), ``size``, ``source_size``, ``target``, ``copies long``,
    ``chunks array<int>`` (the chunk of each copy), ``h2``, ``total`` (copies in the mix)
    and ``chunks_per_shard``. A source takes ``floor(target / words)`` whole rounds; in the
    last, partial round it takes rows in random order while they fit, goes on behind the row
    that did not until no row is left that fits, and then takes one more if that brings it
    nearer to its target. No row is taken more than ``max_repeat``
    times. A NULL source is a source of its own, sorted last; NULL or negative sizes count
    as 0, and such rows are taken in every round their place falls into, without
    changing any sum. Wholly equal rows are separate rows. An empty frame stays empty.
    """
    spark = df.sparkSession
    parts = shuffle_partitions(spark)
    rows = written(_keyed(df, source_col, size_col, seed, parts), "mix-rows")

    per_bucket = rows.groupBy("src", "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("w"))
    ahead = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = per_bucket.select(
        "src", "bucket", "n", "w", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("n0"),
        F.coalesce(F.sum("w").over(ahead), F.lit(0)).alias("w0"))
    sources = source_targets(
        per_bucket.groupBy("src").agg(F.sum("w").alias("words"), F.sum("n").alias("rows")),
        weights, max_repeat)
    rounds = F.when(F.col("words") > 0,
                    F.least(F.floor(F.col("target") / F.col("words")), F.lit(max_repeat))
                    ).otherwise(0).cast("long")
    sources = written(sources.withColumn("rounds", rounds).withColumn(
        "rest", F.greatest(F.col("target") - F.col("rounds") * F.col("words"), F.lit(0.0))),
        "mix-sources")
    buckets = written(per_bucket.join(sources, "src"), "mix-buckets")

    local = Window.partitionBy("src", "bucket").orderBy("h", "h2")
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    key = ["src", "bucket"]
    placed = written(
        rows.join(buckets.select(*key, "n0", "w0", "rest"), key)
        .select("row", "src", "bucket", "size", "h2",
                (F.col("n0") + F.row_number().over(local) - 1).alias("place"),
                (F.col("w0") + F.sum("size").over(upto)).alias("end"), "rest")
        .withColumn("fits", F.col("end") <= F.col("rest")).drop("rest"), "mix-placed")

    # the partial round: rows that fit, run by run, then one that comes nearer
    fit = placed.groupBy("src").agg(F.max(F.when(F.col("fits"), F.col("end"))).alias("got"),
                                    F.count_if("fits").alias("n_fit"))
    state = sources.join(fit, "src").withColumn(
        "missing", F.col("rest") - F.coalesce("got", F.lit(0)))
    state = written(state.withColumn("taken", F.col("n_fit")).withColumn(
        "at", F.col("n_fit") - 1), "mix-quotas")
    state, extra = _fill(state, placed)
    quotas = state.withColumn("quota", F.col("rounds") * F.col("rows") + F.col("taken"))

    # quotas into chunks: one tree over all sources
    chunks = max(1, math.ceil(4 * parts / n_shards))
    leaves = n_shards * chunks
    root = quotas.agg(F.sort_array(F.collect_list(F.struct("src_ix", "quota"))).alias("q")).select(
        F.transform("q", lambda x: x["quota"]).alias("counts"))
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    root = root.withColumn("total", total).withColumn(
        "sizes", even_sizes(F.col("total"), n_shards, chunks)).filter(F.size("counts") > 0)
    matrix = split_tree(root, leaves, seed, parts).select(
        "leaf", "total", F.posexplode("counts").alias("src_ix", "n"))
    ends = (matrix.groupBy("src_ix", "total")
            .agg(F.sort_array(F.collect_list(F.struct("leaf", "n"))).alias("by_leaf"))
            .select("src_ix", "total",
                    running(F.transform("by_leaf", lambda x: x["n"])).alias("ends")))
    plan = quotas.select("src", "src_ix", "words", "rows", "target", "rounds")
    plan = buckets.select(*key).join(plan.join(ends, "src_ix"), "src")

    picked = F.col("fits") | F.col("extra").isNotNull()
    copies = (F.col("rounds") + picked.cast("long")).alias("copies")
    seat = F.when(F.col("fits"), F.col("place")).otherwise(F.col("extra"))
    df = placed.join(extra.withColumnRenamed("seat", "extra"), [*key, "place"], "left")
    df = df.join(plan, key).select(
        "row", "size", F.col("words").alias("source_size"), "target", copies, "h2", "total",
        "ends", "rounds", "rows", "place", seat.alias("seat"))
    block = F.when(F.col("copies") > 0, F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("copies") - 1),
        lambda e: locate(F.col("ends"), e * F.col("rows") + F.when(
            e < F.col("rounds"), F.col("place")).otherwise(F.col("seat")), leaves))).otherwise(
        F.array().cast("array<int>"))
    return df.select("row", "size", "source_size", "target", "copies", block.alias("chunks"),
                     "h2", "total", F.lit(chunks).alias("chunks_per_shard"))


def mix(df: DataFrame, n_shards: int = 8, **options) -> DataFrame:
    """The mix itself: one row per taken copy with all columns of ``df``, ``shard`` (int)
    and ``slot`` (long, gapless from 0 in each shard); columns of ``df`` with these names
    are replaced. Options and special cases as in ``draw``."""
    drawn = draw(df, n_shards, **options)
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    copies = drawn.select("row", "h2", "total", "chunks_per_shard",
                          F.posexplode("chunks").alias("copy", "chunk"))
    again = Window.partitionBy("chunk").orderBy(
        F.xxhash64(F.lit(3), "h2", "copy"), "h2", "copy")
    chunks = max(1, math.ceil(4 * shuffle_partitions(df.sparkSession) / n_shards))
    return copies.withColumn("nth", F.row_number().over(again) - 1).select(
        *[F.col("row").getField(c).alias(c) for c in kept],
        F.floor(F.col("chunk") / chunks).cast("int").alias("shard"),
        (chunk_offset(F.col("total"), F.col("chunk"), n_shards, chunks)
         + F.col("nth")).cast("long").alias("slot"))
