"""The same questions written in Spark SQL.

DataFrames are passed to ``spark.sql`` as named arguments (``{trials}``), so no
session-wide temp view name is taken and concurrent callers cannot collide. The text
avoids the constructs that fail under ANSI mode (``[i]`` on a short array, ``CAST`` of
bad text) and the null-aware ``NOT IN`` (which can only run as a broadcast or a nested
loop join): exclusion is an outer join of the per-sponsor counts with a null-free list,
keeping the unmatched rows. (A ``NOT EXISTS`` anti join would be pushed below the
aggregate onto raw rows; the outer join keeps it on one row per sponsor.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import WHITESPACE

STUDY_TYPES = """
SELECT Type, count(*) AS count
FROM {trials}
GROUP BY Type
ORDER BY count DESC, Type
"""

TOP_CONDITIONS = """
SELECT condition, count(*) AS count
FROM (SELECT btrim(c, {ws}) AS condition
      FROM {trials} LATERAL VIEW explode(split(Conditions, '[|]', -1)) t AS c)
WHERE condition <> ''
GROUP BY condition
ORDER BY count DESC, condition
LIMIT {k}
"""

TOP_UNLISTED_SPONSORS = """
WITH counts AS (
  SELECT Sponsor, count(*) AS count FROM {trials} GROUP BY Sponsor
), listed AS (
  SELECT DISTINCT name FROM (
    SELECT btrim(btrim(translate(Parent_Company, ',', ''), {ws}), '"') AS name
    FROM {companies})
  WHERE name IS NOT NULL AND name <> ''
)
SELECT c.Sponsor, c.count
FROM counts c LEFT JOIN listed l
  ON l.name = btrim(btrim(translate(c.Sponsor, ',', ''), {ws}), '"')
WHERE l.name IS NULL
ORDER BY count DESC, Sponsor
LIMIT {k}
"""

COMPLETED_BY_MONTH = """
SELECT Month, count(*) AS completed_studies
FROM (
  SELECT get(split(Completion, '-', -1), 0) AS Year,
         translate(get(split(Completion, '-', -1), 1), ',"', '') AS Month
  FROM {trials}
  WHERE Status = 'COMPLETED' AND startswith(Completion, {year})
)
WHERE Year = {year} AND Month IS NOT NULL
GROUP BY Month
ORDER BY Month
"""

AVG_ENROLLMENT = """
SELECT `Funder Type`, round(avg(try_cast(Enrollment AS DOUBLE)), 4) AS avg_enrollment
FROM {trials}
GROUP BY `Funder Type`
ORDER BY avg_enrollment DESC NULLS LAST, `Funder Type`
"""

ENROLLMENT_BY_SPONSOR = """
SELECT Sponsor, sum(try_cast(Enrollment AS INT)) AS total_enrollment
FROM {trials}
GROUP BY Sponsor
ORDER BY total_enrollment DESC NULLS LAST, Sponsor
LIMIT {k}
"""

ROW_COUNT = "SELECT count(*) AS row_count FROM {trials}"


def study_types(spark: SparkSession, trials: DataFrame) -> DataFrame:
    return spark.sql(STUDY_TYPES, trials=trials)


def top_conditions(spark: SparkSession, trials: DataFrame, k: int = 5) -> DataFrame:
    return spark.sql(TOP_CONDITIONS, trials=trials, k=int(k), ws=WHITESPACE)


def top_unlisted_sponsors(spark: SparkSession, trials: DataFrame, companies: DataFrame,
                          k: int = 10) -> DataFrame:
    return spark.sql(TOP_UNLISTED_SPONSORS, trials=trials, companies=companies, k=int(k),
                     ws=WHITESPACE)


def completed_by_month(spark: SparkSession, trials: DataFrame, year: str | int) -> DataFrame:
    year = str(int(year))
    return spark.sql(COMPLETED_BY_MONTH, trials=trials, year=year)


def avg_enrollment(spark: SparkSession, trials: DataFrame) -> DataFrame:
    return spark.sql(AVG_ENROLLMENT, trials=trials)


def enrollment_by_sponsor(spark: SparkSession, trials: DataFrame, k: int = 10) -> DataFrame:
    return spark.sql(ENROLLMENT_BY_SPONSOR, trials=trials, k=int(k))


def row_count(spark: SparkSession, trials: DataFrame) -> DataFrame:
    return spark.sql(ROW_COUNT, trials=trials)


def register(trials: DataFrame, name: str = "clinical_trials",
             companies: DataFrame | None = None,
             companies_name: str = "parent_companies") -> None:
    """Register the cleaned table (and optionally the company list) as session temp
    views, for users who write their own SQL against fixed names."""
    trials.createOrReplaceTempView(name)
    if companies is not None:
        companies.createOrReplaceTempView(companies_name)
