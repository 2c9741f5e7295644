"""Sorted sets as rows: db, key, member, score; ordered by (score, member)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfold.functions.ranges import bounds, inside
from keyfold.operators.common import KEY, last_write, per_key, upsert

_ROW = [*KEY, "member"]


def _order(descending: bool) -> list[Column]:
    cols = [F.col("score"), F.col("member")]
    return [c.desc() for c in cols] if descending else cols


def add(zsets: DataFrame, incoming: DataFrame) -> DataFrame:
    """ZADD: incoming has pos; the last score of a member holds."""
    return upsert(zsets.select(*_ROW, "score"), last_write(incoming, _ROW, "score", "pos"), _ROW)


def remove(zsets: DataFrame, gone: DataFrame) -> DataFrame:
    return zsets.join(gone.select(*_ROW), _ROW, "left_anti")


def score(zsets: DataFrame, asked: DataFrame) -> DataFrame:
    return asked.select(*_ROW).join(zsets, _ROW, "left").select(*_ROW, "score")


def cardinality(zsets: DataFrame) -> DataFrame:
    return zsets.groupBy(*KEY).agg(F.count("*").alias("n"))


def ranked(zsets: DataFrame, descending: bool = False) -> DataFrame:
    """ZRANK, ZREVRANK of every member: rank from 0."""
    return zsets.withColumn("rank", F.row_number().over(per_key(*_order(descending))).cast("long") - 1)


def first(zsets: DataFrame, n: int, descending: bool = False) -> DataFrame:
    """The first n of every key, with rank; the bound is on row_number itself, so that n rows a key go into the shuffle."""
    rows = zsets.withColumn("nth", F.row_number().over(per_key(*_order(descending)))).where(F.col("nth") <= n)
    return rows.withColumn("rank", F.col("nth").cast("long") - 1).drop("nth")


def range_by_rank(zsets: DataFrame, start: int, stop: int, descending: bool = False) -> DataFrame:
    """ZRANGE, ZREVRANGE. Ranges with ends from the front need no length: a top-k keeps k rows a key before the shuffle."""
    if start >= 0 and stop >= 0:
        return first(zsets, stop + 1, descending).where(F.col("rank") >= start)
    if start < 0 and stop < 0:  # from the other end: also a top-k
        back = first(zsets, -start, not descending).where(F.col("rank") >= -stop - 1)
        sizes = cardinality(zsets)
        return back.join(sizes, KEY).select(*_ROW, "score", (F.col("n") - 1 - F.col("rank")).alias("rank"))
    return ranked(zsets, descending).join(cardinality(zsets), KEY).where(inside(F.col("rank"), start, stop, F.col("n"))).drop("n")


def range_by_score(zsets: DataFrame, low: float, high: float) -> DataFrame:
    """ZRANGEBYSCORE: inclusive; the filter reaches the scan."""
    return zsets.where(F.col("score").between(low, high))


def count(zsets: DataFrame, low: float, high: float) -> DataFrame:
    """ZCOUNT of every key, 0 included."""
    return zsets.groupBy(*KEY).agg(F.count_if(F.col("score").between(low, high)).alias("n"))


def increment(zsets: DataFrame, deltas: DataFrame) -> DataFrame:
    """ZINCRBY: (db, key, member, score) of the members written."""
    total = deltas.groupBy(*_ROW).agg(F.sum("delta").alias("delta"))
    return total.join(zsets, _ROW, "left").select(*_ROW, (F.coalesce("score", F.lit(0.0)) + F.col("delta")).alias("score"))


def pop(zsets: DataFrame, n: int, highest: bool = False) -> DataFrame:
    """ZPOPMIN, ZPOPMAX: the rows taken, with rank."""
    return first(zsets, n, highest)


def popped(zsets: DataFrame, n: int, highest: bool = False) -> DataFrame:
    """The rows left: an anti-join with the few that are taken, so that keys aren't sorted."""
    return remove(zsets, first(zsets, n, highest))


def without_ranks(zsets: DataFrame, start: int, stop: int) -> DataFrame:
    """ZREMRANGEBYRANK: the rows left. Ranges from one end are an anti-join with a top-k."""
    if (start >= 0) == (stop >= 0):
        return remove(zsets, range_by_rank(zsets, start, stop))
    rows = ranked(zsets).join(cardinality(zsets), KEY)
    s, e = bounds(start, stop, F.col("n"))
    return rows.where(~F.col("rank").between(s, e)).drop("rank", "n")


def without_scores(zsets: DataFrame, low: float, high: float) -> DataFrame:
    """ZREMRANGEBYSCORE: the rows left."""
    return zsets.where(~F.coalesce(F.col("score").between(low, high), F.lit(False)))


def _lex(member: Column, bound: str, lower: bool) -> Column:
    if bound in "-+":
        return F.lit((bound == "-") == lower)
    value, closed = F.lit(bound[1:]).cast("binary"), bound[0] == "["
    own = member.cast("binary")
    if lower:
        return own >= value if closed else own > value
    return own <= value if closed else own < value


def without_lex(zsets: DataFrame, low: str, high: str) -> DataFrame:
    """ZREMRANGEBYLEX: bounds `[x`, `(x`, `-` or `+` compare member bytes."""
    return zsets.where(~(_lex(F.col("member"), low, True) & _lex(F.col("member"), high, False)))
