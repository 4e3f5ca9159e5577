"""Command line: clean a release and answer every question.

    python -m registry_analytics.cli RELEASE_PATH --companies CSV --year 2023 \
        --out OUT_DIR [--layout narrow] [--save-clean PATH] [--format csv]

(``scripts/registry_report.py`` is the same entry point for ``spark-submit``.)

Questions whose columns the layout lacks are skipped.

The session comes from the launcher (cluster settings, ``spark.checkpoint.dir``).
"""

from __future__ import annotations

import argparse
import uuid

from pyspark.sql import SparkSession

from .schemas import NARROW_COLUMNS, WIDE_COLUMNS
from .session import ensure_checkpoint_dir
from .sources import load_release, read_company_list, read_release_table, save_release
from .plans.report import release_questions, save_results


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="registry_analytics")
    ap.add_argument("release", help="file, folder or glob of extract lines")
    ap.add_argument("--out", required=True, help="folder for the answers")
    ap.add_argument("--companies", help="header CSV with a Parent_Company column")
    ap.add_argument("--year", help="year of the completed-per-month question")
    ap.add_argument("--layout", choices=["wide", "narrow"], default="wide")
    ap.add_argument("--save-clean", help="keep the cleaned release here (parquet; default: under the checkpoint folder)")
    ap.add_argument("--format", default="parquet", choices=["parquet", "csv", "json"])
    args = ap.parse_args(argv)

    spark = SparkSession.builder.appName("registry-analytics").getOrCreate()
    if args.layout == "wide":
        trials = load_release(spark, args.release, WIDE_COLUMNS, "\t", clean="full")
    else:
        trials = load_release(spark, args.release, NARROW_COLUMNS, "|", clean="none")
    # the text is parsed once, whatever the number of questions
    clean = args.save_clean or (f"{ensure_checkpoint_dir(spark).rstrip('/')}"
                                f"/registry-clean/{uuid.uuid4().hex}")
    trials = read_release_table(spark, save_release(trials, clean))
    companies = read_company_list(spark, args.companies) if args.companies else None
    results = release_questions(trials, companies, args.year,
                                conditions_sep="|" if args.layout == "wide" else ",")
    save_results(results, args.out, args.format)


if __name__ == "__main__":
    main()
