"""The registry questions: DataFrame plans, SQL forms, the report of a release, and the
registered queries with their DuckDB oracle."""

from . import questions, sql
from .report import release_questions, save_results

__all__ = ["questions", "sql", "release_questions", "save_results"]
