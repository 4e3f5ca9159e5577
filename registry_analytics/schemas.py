"""Fixed input layouts.

Fixed values (they must equal the column layouts of the registry extracts):
  wide release, 14 tab-separated fields, in file order:
    Id, Study Title, Acronym, Status, Conditions, Interventions, Sponsor,
    Collaborators, Enrollment, Funder Type, Type, Study Design, Start, Completion
  narrow release, 9 pipe-separated fields, in file order:
    Id, Sponsor, Status, Start, Completion, Type, Submission, Conditions, Interventions
  interactions CSV, 4 fields with header:
    member Id (double), Name of the Game (string), member behaviour (string), Status (double)
  company list CSV: header row, the column used is Parent_Company
"""

from __future__ import annotations

from pyspark.sql.types import DoubleType, StringType, StructField, StructType

WIDE_COLUMNS = [
    "Id", "Study Title", "Acronym", "Status", "Conditions", "Interventions", "Sponsor",
    "Collaborators", "Enrollment", "Funder Type", "Type", "Study Design", "Start", "Completion",
]

NARROW_COLUMNS = [
    "Id", "Sponsor", "Status", "Start", "Completion", "Type", "Submission", "Conditions",
    "Interventions",
]

COMPANY_COLUMN = "Parent_Company"

USER_COL = "member Id"
ITEM_COL = "Name of the Game"
ACTION_COL = "member behaviour"
RATING_COL = "Status"


def string_schema(names: list[str]) -> StructType:
    """All-string, all-nullable schema, one field per name."""
    return StructType([StructField(n, StringType(), True) for n in names])


WIDE_SCHEMA = string_schema(WIDE_COLUMNS)
NARROW_SCHEMA = string_schema(NARROW_COLUMNS)

INTERACTION_SCHEMA = StructType([
    StructField(USER_COL, DoubleType(), True),
    StructField(ITEM_COL, StringType(), True),
    StructField(ACTION_COL, StringType(), True),
    StructField(RATING_COL, DoubleType(), True),
])
