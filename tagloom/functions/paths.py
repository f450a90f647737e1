"""Detect and shorten absolute paths in string values (JVM only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.functions.cleaning import strip

# What marks a column as holding paths, and what makes a value
# look absolute (root slash, or a drive / scheme / share mark near the start).
PATH_COLUMN_MARKS = ("path", "file", "dir")
ABSOLUTE_VALUE = r"^(?:/|.{0,3}(?::\\|:/|\\\\))"
ABSOLUTE_PAYLOAD = r"^(?:/|\\|.{0,10}(?::\\|:/|\\\\)|.{0,9}://)"


def is_path_column(name: str) -> bool:
    return any(mark in name.lower() for mark in PATH_COLUMN_MARKS)


def looks_absolute(col: Column) -> Column:
    return F.coalesce(strip(col).rlike("(?s)" + ABSOLUTE_VALUE), F.lit(False))


def relative_path(col: Column, root: str) -> Column:
    """Absolute value → path below ``root``; outside the root → base name."""
    base = root.rstrip("/")
    inside = F.startswith(col, F.lit(base + "/"))
    below = F.substring(col, F.lit(len(base) + 2), F.length(col))
    name = F.regexp_extract(F.regexp_replace(col, "/+$", ""), r"([^/]*)$", 1)
    shortened = F.when(col == base, F.lit(".")).when(inside, below).otherwise(name)
    return F.when(looks_absolute(col), shortened).otherwise(col)
