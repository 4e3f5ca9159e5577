"""Lenient number parsing for numbers stored as text. ANSI-safe: bad text -> NULL."""

from __future__ import annotations

from pyspark.sql import Column

from .text import _col


def to_int(c) -> Column:
    """``' 12 '`` -> 12; ``12.5``, ``abc``, ``''``, overflow -> NULL."""
    return _col(c).try_cast("int")


def to_double(c) -> Column:
    """``12.5`` -> 12.5; ``abc``, ``''`` -> NULL."""
    return _col(c).try_cast("double")


def is_int_text(c) -> Column:
    return to_int(c).isNotNull()
