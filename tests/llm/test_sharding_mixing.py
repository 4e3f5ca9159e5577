from collections import Counter, defaultdict
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from registry_analytics.llm import mixing, sharding, split_tree

from .helpers import SCHEMA, odd_documents, plain_words, random_documents


def test_draw_follows_the_hypergeometric_law(spark):
    n = 40_000
    df = spark.range(n).select(split_tree._draw(
        F.lit(50).cast("long"), F.lit(20).cast("long"), F.lit(15).cast("long"), F.col("id"))
        .alias("k"))
    got = np.bincount([r.k for r in df.collect()], minlength=16) / n
    want = [comb(20, k) * comb(30, 15 - k) / comb(50, 15) for k in range(16)]
    assert np.abs(got - want).max() < 0.01


def test_tree_keeps_row_and_column_sums(spark):
    sizes, counts = [5, 0, 7, 3, 10, 1, 4], [12, 0, 18]
    root = spark.createDataFrame([(sizes, counts, 30)],
                                 "sizes array<long>, counts array<long>, total long")
    rows = {r.leaf: r.counts for r in split_tree.split_tree(root, 7, 5, 2).collect()}
    assert [sum(rows[i]) for i in range(7)] == sizes
    assert [sum(c) for c in zip(*rows.values())] == counts


@pytest.mark.parametrize("n", [0, 1, 5, 203])
def test_shards_are_exact_and_gapless(spark, n):
    df = spark.createDataFrame(random_documents(n), SCHEMA).select("doc_id", "source")
    got = sharding.shard(df, 8, n_blocks=6).collect()
    assert sorted(r.doc_id for r in got) == list(range(n))
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    sizes = [len(slots[s]) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    again = {(r.doc_id, r.shard, r.slot) for r in sharding.shard(df, 8, n_blocks=6).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in got}


def test_shuffle_is_uniform(spark):
    rows = spark.range(800).withColumnRenamed("id", "doc_id")
    first = Counter()
    for seed in range(6):
        got = sharding.shard(rows, 4, seed=seed, n_blocks=5).collect()
        first.update(r.shard for r in got if r.doc_id < 200)
    # 300 of 1200 expected in each shard; sd about 13
    assert all(abs(first[s] - 300) < 70 for s in range(4))


def test_sharding_odd_rows_and_clashing_names(spark):
    df = spark.createDataFrame(odd_documents(), SCHEMA).withColumn("shard", F.lit("old")) \
        .withColumn("block", F.lit(1)).withColumn("h", F.lit(2))
    got = sharding.shard(df, 3).collect()
    assert len(got) == len(odd_documents())
    assert {r.shard for r in got} == {0, 1, 2} and {r.block for r in got} == {1}


def plain_targets(sizes):
    """Water filling, one source after another."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, target, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not above:
            target |= share
            break
        target |= {s: 3.0 * sizes[s] for s in above}
        open_ -= above
    return target


def drawn(spark, docs, **options):
    df = spark.createDataFrame(docs, SCHEMA).select(
        "doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    return mixing.draw(df, 4, **options).select(
        "row.doc_id", "row.source", "size", "source_size", "target", "copies").collect()


def test_mix_meets_targets(spark):
    docs = random_documents(300, sources=7)
    docs += [(1000, "a b c", "en", "tiny", 5), (1001, "a b", "en", None, 3)]
    sizes = Counter()
    for _, text, _, source, _ in docs:
        sizes[source] += len(plain_words(text))
    want, got = plain_targets(sizes), drawn(spark, docs)
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.02 * want[s] + 1
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, drawn(spark, docs)), key=str)


def test_mix_fills_up_behind_a_very_long_document(spark):
    """One document holds a third of each source's words: it overflows the rest in most
    orders, and many normal documents must fill what it leaves."""
    rng = np.random.default_rng(5)
    rows = [(s * 1000 + i, f"s{s}", int(n)) for s in range(12)
            for i, n in enumerate([*rng.integers(100, 600, 200), 35_000])]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    weights = tuple([3, 7] * 6)  # targets of 0.6 and 1.4 of a source
    got = mixing.draw(df, 4, weights=weights).select(
        "row.source", "size", "target", "copies", F.size("chunks").alias("n")).collect()
    taken, target = Counter(), {}
    for r in got:
        assert r.n == r.copies
        taken[r.source] += r.copies * r.size
        target[r.source] = r.target
    assert max(abs(taken[s] - target[s]) / target[s] for s in target) < 0.002
    assert len({round(t / 105_000, 1) for t in target.values()}) > 1
    chunks = mixing.mix(df, 4, weights=weights).groupBy("shard").agg(
        F.count(F.lit(1)).alias("n"), F.max("slot").alias("last")).collect()
    assert all(r.n == r.last + 1 for r in chunks) and sum(r.n for r in chunks) == sum(
        r.copies for r in got)


def test_mix_rows_match_the_draw(spark):
    docs = random_documents(120)
    df = spark.createDataFrame(docs, SCHEMA).withColumn("shard", F.lit("old")) \
        .withColumn("size", mixing.word_count(F.col("text")))
    got = mixing.mix(df, 4).collect()
    copies = {r.doc_id: r.copies for r in mixing.draw(df, 4).select(
        "row.doc_id", "copies").collect()}
    assert Counter(r.doc_id for r in got) == Counter({k: v for k, v in copies.items() if v})
    for s in range(4):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert {tuple(r)[:5] for r in got} <= set(docs)


def test_mix_odd_and_empty(spark):
    got = drawn(spark, odd_documents())
    assert len(got) == len(odd_documents())
    assert drawn(spark, []) == []
    nothing = drawn(spark, [(1, None, None, "a", None), (2, "", None, "b", 0)])
    assert [r.target for r in nothing] == [0.0, 0.0]


def test_word_count(spark):
    texts = [None, "", " ", "a\tb\x0bc\x0cd\re\nf  g", "a b　c", "\x1ca \x1d b"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r[0] for r in df.select(mixing.word_count(F.col("text"))).collect()]
    assert got == [len(plain_words(t)) for t in texts]
