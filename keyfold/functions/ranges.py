"""One rule for inclusive index ranges with negative ends, shared by strings, lists and sorted sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bounds(start: int | Column, stop: int | Column, n: Column) -> tuple[Column, Column]:
    """0-based first and last index in a sequence of n; first > last where the range is empty.

    Negative indices count from the end; a stop before the first element gives an empty range.
    """
    s, e = (F.lit(x).cast("long") if isinstance(x, int) else x for x in (start, stop))
    return F.when(s < 0, F.greatest(n + s, F.lit(0))).otherwise(s), F.when(e < 0, n + e).otherwise(F.least(e, n - 1))


def inside(index: Column, start: int | Column, stop: int | Column, n: Column) -> Column:
    s, e = bounds(start, stop, n)
    return index.between(s, e)
