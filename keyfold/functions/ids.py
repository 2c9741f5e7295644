"""Stream ids: a pair (ms, seq) of BIGINTs, ordered as a struct."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

MOST = (1 << 63) - 1


def stream_id(ms: Column | None = None, seq: Column | None = None) -> Column:
    ms, seq = F.col("ms") if ms is None else ms, F.col("seq") if seq is None else seq
    return F.struct(ms.cast("long").alias("ms"), seq.cast("long").alias("seq"))


def literal(text: str) -> Column:
    """`ms-seq`, `-` (the least) or `+` (the greatest)."""
    if text in "-+":
        n = 0 if text == "-" else MOST
        return stream_id(F.lit(n), F.lit(n))
    ms, _, seq = text.partition("-")
    return stream_id(F.lit(int(ms)), F.lit(int(seq or 0)))


def parsed(text: Column) -> Column:
    """Null unless the text is two whole numbers that fit."""
    ok = text.rlike(r"^\d{1,19}-\d{1,19}$")
    part = lambda i: F.split_part(text, F.lit("-"), F.lit(i)).try_cast("long")
    return F.when(ok & part(1).isNotNull() & part(2).isNotNull(), stream_id(part(1), part(2)))


def shown(ms: str = "ms", seq: str = "seq") -> Column:
    return F.concat_ws("-", F.col(ms), F.col(seq))


def next_seq(keys: list[str], arrival: str) -> Column:
    """Sequence numbers of entries of one millisecond, by arrival."""
    return F.row_number().over(Window.partitionBy(*keys, "ms").orderBy(arrival)).cast("long") - 1
