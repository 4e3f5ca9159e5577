"""CSV sources: the company list and the interaction table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..schemas import COMPANY_COLUMN, INTERACTION_SCHEMA


def read_company_list(spark: SparkSession, path: str, column: str = COMPANY_COLUMN) -> DataFrame:
    """Header CSV (quoted, all strings); only the name column is kept, so the scan
    reads one column."""
    return spark.read.option("header", True).csv(path).select(F.col(column).alias(COMPANY_COLUMN))


def read_interactions(spark: SparkSession, path: str, key_col: str | None = None) -> DataFrame:
    """Interaction CSV with the explicit 4-field schema (no inference pass), plus an
    optional trailing BIGINT row key. Unparseable numbers read as NULL (PERMISSIVE)."""
    schema = INTERACTION_SCHEMA
    if key_col:
        schema = StructType(schema.fields + [StructField(key_col, LongType(), True)])
    return (spark.read.option("header", True).option("mode", "PERMISSIVE")
            .schema(schema).csv(path))
