"""Integer functions of the pipeline language."""

from __future__ import annotations

from pyspark.sql import Column

OPERATIONS = {"*": lambda a, b: a * b, "+": lambda a, b: a + b, "-": lambda a, b: a - b}


def arithmetic(op: str, left: Column, right: Column) -> Column:
    """left op right; wraps around where it is built without ANSI mode."""
    return OPERATIONS[op](left, right)
