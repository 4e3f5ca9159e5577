"""Exact multivariate hypergeometric counts by recursive halving, in DataFrame functions.

``split_tree`` answers: an urn holds ``counts[c]`` items of category ``c``; its items are
dealt at random into leaves of fixed sizes. How many items of each category does each
leaf get? A node of the tree covers a run of leaves. The share of its left half is one
multivariate hypergeometric draw, made category by category from univariate ones; the
right half gets the rest. Every draw takes its random number from a hash of (seed, node,
category), so reruns and recomputed tasks agree, and row and column sums hold exactly.

The work is O(leaves x categories); no row of the data itself passes through here.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, unit_interval

# Draws look at this many standard deviations around the mode. The mass beyond is below
# 1e-30, far under the resolution of the random number itself.
_SPAN = 12.0
# The tree is spread over tasks once it has this many levels.
_SPREAD_LEVEL = 5


def _draw(total: Column, good: Column, taken: Column, *seed: Column) -> Column:
    """Hypergeometric draw: of ``total`` items ``good`` are marked; how many marked ones are
    among ``taken``?

    One pass over the possible values k with weights proportional to P(k), from the ratio
    P(k + 1) / P(k); value k replaces the choice so far with probability
    weight(k) / (sum of weights up to k), which leaves each value chosen with P(k).
    """
    n, g, t = (c.cast("double") for c in (total, good, taken))
    sd = F.sqrt(t * g / n * (n - g) / n * (n - t) / F.greatest(n - 1, F.lit(1.0)))
    half = F.ceil(sd * _SPAN + _SPAN)
    mode = F.floor((t + 1) * (g + 1) / (n + 2))
    ks = F.sequence(F.greatest(F.lit(0), good + taken - total, mode - half),
                    F.least(good, taken, mode + half))

    def step(acc: Column, k: Column) -> Column:
        mass = acc["mass"] + acc["weight"]
        ratio = (g - k) * (t - k) / ((k + 1) * (n - g - t + k + 1))
        return F.struct(
            (acc["weight"] * ratio).alias("weight"), mass.alias("mass"),
            F.when(unit_interval(*seed, k) * mass <= acc["weight"], k)
            .otherwise(acc["k"]).alias("k"))

    start = F.struct(F.lit(1.0).alias("weight"), F.lit(0.0).alias("mass"),
                     F.lit(0).cast("long").alias("k"))
    return (F.when((good == 0) | (taken == 0), F.lit(0).cast("long"))
            .when(good == total, taken).when(taken == total, good)
            .otherwise(F.aggregate(ks, start, step)["k"]))


def _left_counts(counts: Column, left: Column, seed: int, node: Column, width: Column) -> Column:
    """Category counts of the left child, which holds ``left`` of the node's items."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    start = F.struct(total.alias("rest"), left.cast("long").alias("room"),
                     F.array().cast("array<long>").alias("out"))

    def step(acc: Column, i: Column) -> Column:
        drawn = _draw(acc["rest"], counts[i], acc["room"], F.lit(seed), node, width, i)
        return let(drawn, lambda k: F.struct(
            (acc["rest"] - counts[i]).alias("rest"), (acc["room"] - k).alias("room"),
            F.concat(acc["out"], F.array(k)).alias("out")))

    return F.aggregate(F.sequence(F.lit(0), F.size(counts) - 1), start, step)["out"]


def split_tree(root: DataFrame, n_leaves: int, seed: int, tasks: int) -> DataFrame:
    """``root``: one row of ``sizes array<long>`` (one per leaf) and ``counts array<long>``
    (one per category, not empty), both with the same sum ``total``. Returns ``leaf int``,
    ``counts array<long>`` and ``total long`` for every leaf."""
    # the same expressions serve every level
    width = F.size("sizes")
    half = F.floor(width / 2).cast("int")
    left_total = F.aggregate(F.slice("sizes", F.lit(1), half), F.lit(0).cast("long"),
                             lambda a, x: a + x)
    got = F.when(width > 1, _left_counts(F.col("counts"), left_total, seed, F.col("first"), width))
    halves = F.array(
        F.struct("first", F.slice("sizes", F.lit(1), half).alias("sizes"),
                 F.col("got").alias("counts")),
        F.struct((F.col("first") + half).alias("first"),
                 F.slice("sizes", half + 1, width - half).alias("sizes"),
                 F.zip_with("counts", "got", lambda a, b: a - b).alias("counts")))
    whole = F.array(F.struct("first", "sizes", "counts"))
    nodes = F.explode(F.when(width == 1, whole).otherwise(halves)).alias("n")

    df = root.select(F.lit(0).alias("first"), "sizes", "counts", "total")
    for level in range(max(0, math.ceil(math.log2(max(1, n_leaves))))):
        if level == _SPREAD_LEVEL:
            df = df.repartition(tasks, "first")
        df = (df.withColumn("got", got).select(nodes, "total")
              .select("n.first", "n.sizes", "n.counts", "total"))
    return df.select(F.col("first").alias("leaf"), "counts", "total")


def even_sizes(total: Column, n_shards: int, chunks: int) -> Column:
    """Sizes of ``n_shards * chunks`` chunks: shards at most one apart, and so are the
    chunks within a shard."""
    def one(i: Column) -> Column:
        s, c = F.floor(i / chunks), i % chunks
        return let(shard_size(total, s, n_shards),
                   lambda m: F.floor(m / chunks) + (c < m % chunks).cast("long"))

    return F.transform(F.sequence(F.lit(0), F.lit(n_shards * chunks - 1)),
                       lambda i: one(i).cast("long"))


def shard_size(total: Column, shard: Column, n_shards: int) -> Column:
    return F.floor(total / n_shards) + (shard < total % n_shards).cast("long")


def chunk_offset(total: Column, leaf: Column, n_shards: int, chunks: int) -> Column:
    """First slot of a chunk within its shard."""
    c = leaf % chunks
    return let(shard_size(total, F.floor(leaf / chunks), n_shards),
               lambda m: c * F.floor(m / chunks) + F.least(c, m % chunks)).cast("long")


def running(counts: Column) -> Column:
    """Inclusive prefix sums of an array."""
    return F.aggregate(
        counts, F.struct(F.lit(0).cast("long").alias("s"),
                         F.array().cast("array<long>").alias("out")),
        lambda acc, x: F.struct((acc["s"] + x).alias("s"),
                                F.concat(acc["out"], F.array(acc["s"] + x)).alias("out")))["out"]


def locate(ends: Column, position: Column, n: int) -> Column:
    """Index of the first of ``n`` non-decreasing ``ends`` above ``position`` (binary
    search)."""
    steps = max(1, math.ceil(math.log2(n)) + 1)
    found = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)),
        F.struct(F.lit(0).alias("lo"), F.lit(n - 1).alias("hi")),
        lambda acc, _: let(
            F.floor((acc["lo"] + acc["hi"]) / 2).cast("int"),
            lambda mid: F.when(acc["lo"] >= acc["hi"], acc)
            .when(ends[mid] > position, F.struct(acc["lo"].alias("lo"), mid.alias("hi")))
            .otherwise(F.struct((mid + 1).alias("lo"), acc["hi"].alias("hi")))))
    return found["lo"]
