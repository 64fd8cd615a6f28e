"""Rounding and fixed-point text on the exact binary value of a double.

Spark's ``round`` and ``format_string`` work on the shortest decimal text of a
double, so 2.675 becomes 2.68 although its binary value lies below the tie.
``format_number`` rounds the binary value itself, ties to even (2.67), which is
what reports show. Digits beyond the 15 or so a double carries are zeros.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def fixed(x: Column, digits: int, signed: bool = False) -> Column:
    """``x`` as text with exactly ``digits`` decimals; null stays null."""
    pattern = "0." + "0" * digits if digits else "0"
    text = F.call_function("format_number", x.cast("double"), F.lit(pattern))
    return F.when(x < 0, text).otherwise(F.concat(F.lit("+"), text)) if signed else text


def round_exact(x: Column, digits: int) -> Column:
    """``x`` rounded to ``digits`` decimals, as DOUBLE; null stays null."""
    return fixed(x, digits).cast("double")


def percent(part: Column, total: Column) -> Column:
    """``part`` of ``total`` in percent; null unless ``total`` is positive."""
    return F.when(total > 0, part / total * F.lit(100.0))
