"""One key holding a third of all rows: results stay whole and exact."""

from collections import Counter

from pyspark.sql import functions as F

from registry_analytics.operators import frequency as fq
from registry_analytics.operators import recommend as rc
from registry_analytics.operators.exclusion import top_unlisted

from .conftest import rows

N = 30_000


def hot_frame(spark, col="k"):
    # a third of the rows share one key; the rest spread over 2,000 keys
    return spark.range(N).select(
        F.when(F.col("id") % 3 == 0, F.lit("HOT"))
        .otherwise(F.concat(F.lit("k"), (F.col("id") % 2000).cast("string"))).alias(col)
    ).repartition(16)


def expected_counts():
    return Counter("HOT" if i % 3 == 0 else f"k{i % 2000}" for i in range(N))


def test_value_counts_with_hot_key(spark):
    got = dict(rows(fq.value_counts(hot_frame(spark), "k", None)))
    assert got == dict(expected_counts())


def test_exclusion_with_hot_key_without_broadcast(spark):
    trials = hot_frame(spark, "Sponsor")
    listed = spark.createDataFrame([("k1",), ("k2",)], "Parent_Company string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        got = rows(top_unlisted(trials, "Sponsor", listed, "Parent_Company", k=3))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    exp = sorted(((k, v) for k, v in expected_counts().items() if k not in ("k1", "k2")),
                 key=lambda kv: (-kv[1], kv[0]))[:3]
    assert got == exp


def test_item_index_and_join_with_hot_item(spark):
    df = hot_frame(spark, "g")
    idx = dict(rows(rc.item_index(df, "g", "idx")))
    ranked = sorted(expected_counts().items(), key=lambda kv: (-kv[1], kv[0]))
    assert idx == {k: float(i) for i, (k, _) in enumerate(ranked)}
    for size in (100, 1_000_000):  # the hot item over 100 salts, or one
        joined = rc.with_item_index(df, "g", "idx", rows_per_task=size)
        assert joined.count() == N  # nothing dropped or duplicated
        assert joined.filter(F.col("g") == "HOT").select("idx").distinct().first()[0] == 0.0


def test_distinct_with_hot_duplicates(spark):
    df = hot_frame(spark)
    assert fq.distinct_keys(df, "k").first()[0] == 2001
    assert fq.distinct_rows(df).first()[0] == 2001


def test_kept_plus_excluded_is_everything(spark):
    from registry_analytics.operators.exclusion import exclude_listed, listed_names
    trials = hot_frame(spark, "Sponsor")
    listed = spark.createDataFrame([("HOT",), ("k7",), (None,)], "Parent_Company string")
    kept = exclude_listed(trials, "Sponsor", listed, "Parent_Company").count()
    names = listed_names(listed, "Parent_Company")
    excluded = trials.join(names, F.col("Sponsor") == F.col("_listed"), "left_semi").count()
    assert kept + excluded == N
    assert excluded == N // 3 + sum(1 for i in range(N) if i % 3 and i % 2000 == 7)


def test_normalized_ratings_in_unit_interval(spark):
    df = spark.range(5000).select((F.col("id") % 97).cast("double").alias("r"))
    out = rc.normalize_ratings(df, "r", "n").agg(F.min("n"), F.max("n")).first()
    assert (out[0], out[1]) == (0.0, 1.0)


def test_salted_index_join_equals_plain_join(spark):
    df = hot_frame(spark, "g").withColumn("r", F.hash("g") % 1000)
    salted = rc.with_item_index(df, "g", "idx", rows_per_task=50)
    plain = df.join(rc.item_index(df, "g", "idx"), "g")
    assert salted.columns == plain.columns
    assert sorted(rows(salted)) == sorted(rows(plain))


def test_rows_without_an_item_or_key(spark):
    df = spark.createDataFrame([("a", 1), (None, 12), ("a", None)], "g string, k long")
    assert rows(rc.item_index(df, "g", "idx")) == [("a", 0.0)]
    assert rc.with_item_index(df, "g", "idx").count() == 2
    train, test = rc.split_by_key(df, "k")
    assert train.count() + test.count() == 3
    labels = dict(rows(df.groupBy(rc.split_label("k").alias("s")).count()))
    assert labels.get("train", 0) == train.count() and labels.get("test", 0) == test.count()
    assert train.filter("k is null").count() == 1
