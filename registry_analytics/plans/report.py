"""All questions over one release, as lazy DataFrames, and a writer for them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import frequency as fq
from . import questions as qn

# Columns each question reads; a question is offered only when its release has them
# (the narrow layout lacks Collaborators, Enrollment, Funder Type and Study Design).
NEEDS = {
    "distinct_studies": ["Id"],
    "distinct_rows": [],
    "row_count": [],
    "study_types": ["Type"],
    "top_conditions": ["Conditions"],
    "top_collaborators": ["Collaborators"],
    "status_counts": ["Status"],
    "top_sponsors": ["Sponsor"],
    "funder_counts": ["Funder Type"],
    "study_design_share": ["Study Design"],
    "starts_by_year": ["Start"],
    "enrollment_histogram": ["Enrollment"],
    "avg_enrollment_by_funder": ["Enrollment", "Funder Type"],
    "enrollment_by_sponsor": ["Enrollment", "Sponsor"],
    "top_unlisted_sponsors": ["Sponsor"],
    "completed_by_month": ["Status", "Completion"],
}


def release_questions(trials: DataFrame, companies: DataFrame | None = None,
                      year: int | str | None = None, top_k: int = 10,
                      top_conditions: int = 5, conditions_sep: str = "|") -> dict[str, DataFrame]:
    """Every registry question the release's columns allow.

    Questions that need the company list or a year are left out when those are not
    given. Nothing runs until a result is written or collected.
    """
    build = {
        "distinct_studies": lambda: qn.distinct_studies(trials),
        "distinct_rows": lambda: qn.distinct_rows(trials),
        "row_count": lambda: qn.row_count(trials),
        "study_types": lambda: qn.study_types(trials),
        "top_conditions": lambda: fq.token_counts(trials, "Conditions", conditions_sep,
                                                  out_col="condition", limit=top_conditions),
        "top_collaborators": lambda: qn.top_collaborators(trials, top_k),
        "status_counts": lambda: qn.status_counts(trials),
        "top_sponsors": lambda: qn.top_sponsors(trials, 5),
        "funder_counts": lambda: qn.funder_counts(trials),
        "study_design_share": lambda: qn.study_design_share(trials),
        "starts_by_year": lambda: qn.starts_by_year(trials),
        "enrollment_histogram": lambda: qn.enrollment_histogram(trials),
        "avg_enrollment_by_funder": lambda: qn.avg_enrollment_by_funder(trials),
        "enrollment_by_sponsor": lambda: qn.enrollment_by_sponsor(trials, top_k),
    }
    if companies is not None:
        build["top_unlisted_sponsors"] = lambda: qn.top_unlisted_sponsors(trials, companies,
                                                                          top_k)
    if year is not None:
        build["completed_by_month"] = lambda: qn.completed_months(trials, year)
    have = set(trials.columns)
    return {name: make() for name, make in build.items() if set(NEEDS[name]) <= have}


def save_results(results: dict[str, DataFrame], out_dir: str, fmt: str = "parquet",
                 mode: str = "overwrite") -> list[str]:
    """Write each result to ``out_dir/<name>``. The results are small aggregates, but
    they are still written by the executors; nothing passes through the driver."""
    paths = []
    for name, df in results.items():
        path = f"{out_dir.rstrip('/')}/{name}"
        writer = df.write.mode(mode).format(fmt)
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.save(path)
        paths.append(path)
    return paths
