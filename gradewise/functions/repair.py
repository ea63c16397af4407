"""Malformed-decimal repair as a native expression (no UDF).

Trim; empty -> NULL; at most one dot -> parse; otherwise keep the first dot
and delete the later ones (``12.345.678`` -> 12.345678).  Text that is not
a number becomes NULL (the reference raises) and is counted as rejected.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dots(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit("."), F.lit("")))


def repair_decimal(raw: Column) -> Column:
    x = F.trim(raw)
    head = F.substring_index(x, ".", 1)
    tail = F.replace(F.substr(x, F.instr(x, ".") + 1), F.lit("."), F.lit(""))
    fixed = F.when(dots(x) <= 1, x).otherwise(F.concat(head, F.lit("."), tail))
    value = fixed.try_cast("double")
    null = F.lit(None).cast("double")
    return F.when(F.length(x) == 0, null).otherwise(F.nanvl(value, null))


def is_rejected(raw: Column) -> Column:
    """Non-empty text that does not parse after repair."""
    x = F.trim(raw)
    return raw.isNotNull() & (F.length(x) > 0) & repair_decimal(raw).isNull()
