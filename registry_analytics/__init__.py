"""Spark-native registry analytics and recommendation toolkit.

Layout:
  sources/    line, CSV and interaction readers; the lenient delimited-line parser
  functions/  column expressions (token cleaning, dates, numbers)
  operators/  DataFrame operators: frequencies, exclusion, periods, numeric, recommender
  plans/      the named questions, in DataFrame and in SQL form
  streaming/  the same parser applied to a file stream of arriving extracts
"""

__all__ = ["functions", "operators", "plans", "sources", "streaming", "session", "schemas"]
