"""Registry-shaped inputs derived, with Spark, from the TPC-H-style parquet tables.

The library's real inputs are text extracts (``read_lines``), a company CSV and an
interaction CSV. For tests, the bench and the SQL oracle the same shapes are derived
from ``orders``, ``customer``, ``nation`` and ``lineitem`` so that every query's work
grows with those tables:

* ``wide_lines``   - one tab-separated, quote-wrapped line per order, plus a header line;
                     stray commas, spaces, quotes, short and over-long lines included.
* ``narrow_lines`` - the 9-field pipe layout of older releases.
* ``company_list`` - nation names of one region, as ``Parent_Company``.
* ``interactions`` - one rating per line item: customer, part, play/purchase, quantity.

The derivation rules are spelled out once in ``FIXTURES.md``; the oracle SQL in
``plans/oracle.py`` restates them directly on the cleaned values.
"""

from __future__ import annotations

import os
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import (ACTION_COL, ITEM_COL, NARROW_COLUMNS, RATING_COL, USER_COL,
                       WIDE_COLUMNS)
from ..session import ensure_checkpoint_dir, session_key
from .csv import read_interactions
from .lines import parse_wide, read_lines, save_release

EXCLUDED_REGION = 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders ⋈ customer ⋈ nation, only the columns the fixtures use.

    No join is hinted: nation is small enough for the planner to broadcast by itself, and
    the orders/customer join is sort-merge at scale (AQE skew split).
    """
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
        "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    cn = c.join(n, c.c_nationkey == n.n_nationkey)
    return o.join(cn, o.o_custkey == cn.c_custkey)


def _raw_fields(k: Column) -> dict[str, Column]:
    d = F.date_format("o_orderdate", "yyyy-MM-dd")
    done = F.date_format(F.date_add(F.col("o_orderdate").cast("date"), (k % 400).cast("int")),
                         "yyyy-MM-dd")
    prio, seg = F.col("o_orderpriority"), F.col("c_mktsegment")
    return {
        "Id": F.concat(F.lit("NCT"), F.lpad(k.cast("string"), 8, "0")),
        "Study Title": F.concat(F.lit("Study, no "), k.cast("string")),
        "Acronym": F.lit(""),
        "Status": (F.when(F.col("o_orderstatus") == "F", "COMPLETED")
                   .when(F.col("o_orderstatus") == "O", "RECRUITING")
                   .when(F.col("o_orderstatus") == "P", "UNKNOWN")
                   .otherwise(F.col("o_orderstatus"))),
        "Conditions": (F.when(k % 7 == 0, F.lit(""))
                       .when(k % 3 == 0, F.concat(prio, F.lit("|"), seg))
                       .otherwise(F.concat(prio, F.lit("| "), seg))),
        "Interventions": F.lit(""),
        "Sponsor": (F.when(k % 23 == 0, F.concat(F.col("n_name"), F.lit(" ")))
                    .when(k % 31 == 0, F.regexp_replace("n_name", "_", ",_"))
                    .otherwise(F.col("n_name"))),
        "Collaborators": F.when(k % 4 == 0, F.lit("")).otherwise(seg),
        "Enrollment": (F.when(k % 11 == 0, F.lit(""))
                       .when(k % 37 == 0, F.lit("n/a"))
                       .when(k % 41 == 0, F.concat(F.floor(F.col("o_totalprice") / 1000)
                                                   .cast("string"), F.lit(".5")))
                       .otherwise(F.floor(F.col("o_totalprice") / 1000).cast("string"))),
        "Funder Type": (F.when(F.col("n_regionkey") == 0, "INDUSTRY")
                        .when(F.col("n_regionkey") == 1, "NIH")
                        .when(F.col("n_regionkey") == 2, "OTHER_GOV")
                        .when(F.col("n_regionkey") == 3, "FED")
                        .otherwise("OTHER")),
        "Type": F.when(k % 29 == 0, F.concat(F.lit('"'), prio, F.lit('"'))).otherwise(prio),
        "Study Design": seg,
        "Start": d,
        "Completion": (F.when(k % 13 == 0, F.lit(""))
                       .when(k % 59 == 0, F.substring(done, 1, 4))
                       .when(k % 61 == 0, F.concat(F.substring(done, 1, 5), F.lit('",'),
                                                F.substring(done, 6, 2)))
                       .when(k % 5 == 0, F.substring(done, 1, 7))
                       .otherwise(done)),
    }


def wide_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tab-separated, quote-wrapped 14-field lines (``value``), header line included.

    Per order key k: k%17=0 over-long (an extra field), k%19=0 cut after 10 fields,
    k%43=0 spaces outside the quotes, k%47=0 the line twice, k%53=0 a second line of the
    same Id with another status.
    """
    k = F.col("o_orderkey")
    times = F.when((k % 47 == 0) | (k % 53 == 0), 2).otherwise(1)
    src = _orders_customers(spark, sf_dir).withColumn(
        "_nth", F.explode(F.sequence(F.lit(1), times)))
    f = _raw_fields(k)
    f["Status"] = F.when((F.col("_nth") == 2) & (k % 53 == 0), "WITHDRAWN").otherwise(f["Status"])
    full = F.concat_ws("\t", *[f[c] for c in WIDE_COLUMNS])
    short = F.concat_ws("\t", *[f[c] for c in WIDE_COLUMNS[:10]])
    body = (F.when(k % 17 == 0, F.concat(full, F.lit("\textra")))
            .when(k % 19 == 0, short).otherwise(full))
    line = F.concat(F.lit('"'), body, F.lit('"'))
    line = F.when(k % 43 == 0, F.concat(F.lit(" "), line, F.lit(" "))).otherwise(line)
    rows = src.select(line.alias("value"))
    header = spark.range(1).select(F.lit('"' + "\t".join(WIDE_COLUMNS) + '"').alias("value"))
    return header.unionByName(rows)


def narrow_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipe-separated 9-field lines, header line included; conditions use ``,``.

    k%17=0 over-long, k%19=0 cut after 5 fields.
    """
    src = _orders_customers(spark, sf_dir)
    k = F.col("o_orderkey")
    f = _raw_fields(k)
    f["Submission"] = F.lit("")
    f["Conditions"] = F.when(k % 7 == 0, F.lit("")).otherwise(
        F.concat(F.col("o_orderpriority"), F.lit(","), F.col("c_mktsegment")))
    full = F.concat_ws("|", *[f[c] for c in NARROW_COLUMNS])
    short = F.concat_ws("|", *[f[c] for c in NARROW_COLUMNS[:5]])
    body = (F.when(k % 17 == 0, F.concat(full, F.lit("|extra")))
            .when(k % 19 == 0, short).otherwise(full))
    rows = src.select(body.alias("value"))
    header = spark.range(1).select(F.lit("|".join(NARROW_COLUMNS)).alias("value"))
    return header.unionByName(rows)


def company_list(spark: SparkSession, sf_dir: str, region: int = EXCLUDED_REGION) -> DataFrame:
    """``Parent_Company``: the nations of one region by name, those of the next region in
    other spellings of the same name (a comma, spaces, quotes), a blank and a NULL."""
    n = table(spark, sf_dir, "nation")
    other = F.concat(F.lit(' "'), F.regexp_replace("n_name", "_", "_,"), F.lit('" '))
    named = n.filter(F.col("n_regionkey").isin(region, region + 1)).select(
        F.when(F.col("n_regionkey") == region, F.col("n_name")).otherwise(other)
        .alias("Parent_Company"))
    blank = spark.range(2).select(F.when(F.col("id") == 0, F.lit(" ")).alias("Parent_Company"))
    return named.unionByName(blank)


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One explicit rating per line item (the 4-field interaction layout plus a key).

    ``interaction_id`` = l_orderkey * 8 + l_linenumber identifies a row (a line number is
    at most 7) and drives the deterministic train/test split.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select(
        F.col("o_custkey").cast("double").alias(USER_COL),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias(ITEM_COL),
        F.when(F.col("l_returnflag") == "R", "purchase").otherwise("play").alias(ACTION_COL),
        F.col("l_quantity").alias(RATING_COL),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("interaction_id"),
    )


_WRITTEN: dict[tuple[str, str], dict[str, str]] = {}
_LOCK = threading.Lock()


def materialize(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, str]:
    """Write the text-shaped fixtures ``names`` (all of them if none is named) as files, once
    per session and data directory.

    The registry inputs are files in real use (text extracts, a company CSV), so the
    queries read them back with the same readers a user calls. The files go under the
    session's checkpoint directory (the shared folder named by ``spark.checkpoint.dir``
    on a cluster). A query names what it reads, so that it does not wait for, nor fill the
    disk with, the files of others. Returns the paths written so far: ``wide``, ``narrow``
    (text folders), ``companies`` (header CSV, every value quoted), ``wide_clean`` (the
    parsed wide release saved as parquet: ingest once, query many times),
    ``interactions_csv`` and ``interactions`` (the same ratings read back through the typed
    CSV reader and saved as parquet).
    """
    key = (session_key(spark), os.path.abspath(sf_dir))
    with _LOCK:  # concurrent callers wait for one writer instead of writing twice
        paths = _WRITTEN.setdefault(key, {})
        for name in names or _WRITERS:
            _write(spark, sf_dir, name, paths)
        return dict(paths)


def _write(spark: SparkSession, sf_dir: str, name: str, paths: dict[str, str]) -> str:
    """The path of a fixture, written (after the one it is made of) if ``paths`` lacks it."""
    if name not in paths:
        made_of, write = _WRITERS[name]
        source = _write(spark, sf_dir, made_of, paths) if made_of else sf_dir
        root = ensure_checkpoint_dir(spark).rstrip("/")
        path = f"{root}/registry-fixtures/{uuid.uuid4().hex}/{name}"
        write(spark, source, path)
        paths[name] = path
    return paths[name]


def _write_wide(spark: SparkSession, sf_dir: str, path: str) -> None:
    wide_lines(spark, sf_dir).write.mode("overwrite").text(path)


def _write_wide_clean(spark: SparkSession, wide: str, path: str) -> None:
    # the cleaned table, parsed from the written text like a real release
    save_release(parse_wide(read_lines(spark, wide)), path)


def _write_narrow(spark: SparkSession, sf_dir: str, path: str) -> None:
    narrow_lines(spark, sf_dir).write.mode("overwrite").text(path)


def _write_companies(spark: SparkSession, sf_dir: str, path: str) -> None:
    (company_list(spark, sf_dir).write.mode("overwrite").option("header", True)
     .option("quoteAll", True).csv(path))


def _write_interactions_csv(spark: SparkSession, sf_dir: str, path: str) -> None:
    interactions(spark, sf_dir).write.mode("overwrite").option("header", True).csv(path)


def _write_interactions(spark: SparkSession, csv: str, path: str) -> None:
    # interactions arrive as a header CSV; ingest once through the typed reader
    (read_interactions(spark, csv, key_col="interaction_id")
     .write.mode("overwrite").parquet(path))


# the fixture each is made of (none: the tables) and its writer
_WRITERS = {
    "wide": (None, _write_wide),
    "wide_clean": ("wide", _write_wide_clean),
    "narrow": (None, _write_narrow),
    "companies": (None, _write_companies),
    "interactions_csv": (None, _write_interactions_csv),
    "interactions": ("interactions_csv", _write_interactions),
}
