"""Lists as rows: db, key, pos, value. pos orders a list and may have gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyfold.functions.ranges import inside
from keyfold.operators.common import KEY, per_key



def indexed(lists: DataFrame) -> DataFrame:
    """With index (0-based) and n, the list's length."""
    return lists.withColumn("index", F.row_number().over(per_key("pos")).cast("long") - 1).withColumn("n", F.count("*").over(Window.partitionBy(*KEY)))


def push(lists: DataFrame, incoming: DataFrame, head: bool) -> DataFrame:
    """All rows after LPUSH (head) or RPUSH. incoming: db, key, arg, value; the last argument ends outermost."""
    ends = lists.groupBy(*KEY).agg(F.min("pos").alias("low"), F.max("pos").alias("high"))
    placed = incoming.join(ends, KEY, "left").withColumn("step", F.row_number().over(per_key("arg")))
    pos = F.coalesce("low", F.lit(0)) - F.col("step") if head else F.coalesce("high", F.lit(-1)) + F.col("step")
    return lists.unionByName(placed.select(*KEY, pos.cast("long").alias("pos"), "value"))


def pop(lists: DataFrame, head: bool) -> DataFrame:
    """(db, key, value): the element that LPOP or RPOP takes; one aggregation, no sort."""
    return lists.groupBy(*KEY).agg((F.min_by if head else F.max_by)("value", "pos").alias("value"))


def popped(lists: DataFrame, head: bool) -> DataFrame:
    """The rows left after one pop of every list."""
    end = lists.groupBy(*KEY).agg((F.min if head else F.max)("pos").alias("pos"))
    return lists.join(end, [*KEY, "pos"], "left_anti")


def length(lists: DataFrame) -> DataFrame:
    return lists.groupBy(*KEY).agg(F.count("*").alias("n"))


def slice_of(lists: DataFrame, start: int, stop: int) -> DataFrame:
    """LRANGE: rows with their index."""
    return indexed(lists).where(inside(F.col("index"), start, stop, F.col("n")))


def trim(lists: DataFrame, start: int, stop: int) -> DataFrame:
    """LTRIM: the rows kept."""
    return slice_of(lists, start, stop).drop("index", "n")


def at(lists: DataFrame, index: int) -> DataFrame:
    """LINDEX: (db, key, value); lists too short give no row."""
    order = F.col("pos") if index >= 0 else F.col("pos").desc()
    place = index + 1 if index >= 0 else -index
    return lists.withColumn("i", F.row_number().over(per_key(order))).where(F.col("i") == place).select(*KEY, "value")


def set_at(lists: DataFrame, index: int, value: str) -> DataFrame:
    """LSET: (db, key, index, value, error); error is index_out_of_range on lists too short, else null."""
    place = F.lit(index) if index >= 0 else F.col("n") + index
    error = F.when((place < 0) | (place >= F.col("n")), "index_out_of_range")
    return indexed(lists).select(*KEY, "index", F.when(F.col("index") == place, F.lit(value)).otherwise(F.col("value")).alias("value"), error.alias("error"))


def remove(lists: DataFrame, value: str, count: int) -> DataFrame:
    """LREM: the rows left; count > 0 from the head, < 0 from the tail, 0 all."""
    if count == 0:
        return lists.where(~F.col("value").eqNullSafe(F.lit(value)))
    order = F.col("pos") if count > 0 else F.col("pos").desc()
    nth = F.row_number().over(Window.partitionBy(*KEY, "value").orderBy(order))
    return lists.withColumn("nth", nth).where(~F.col("value").eqNullSafe(F.lit(value)) | (F.col("nth") > abs(count))).drop("nth")


def blocking_pop(lists: DataFrame, requests: DataFrame, head: bool = True) -> DataFrame:
    """(request, key, value): BLPOP on tables as they stand. requests: db, request, keys ARRAY.

    Each request takes from the first of its keys that has elements; requests of one key
    are served in order of request, the n-th taking the n-th element.
    """
    asked = requests.select("db", "request", F.posexplode("keys").alias("arg", "key"))
    full = asked.join(length(lists).select(*KEY), KEY, "left_semi")
    chosen = full.groupBy("db", "request").agg(F.min_by("key", "arg").alias("key"))
    turn = chosen.withColumn("turn", F.row_number().over(per_key("request")))
    order = F.col("pos") if head else F.col("pos").desc()
    offered = lists.withColumn("turn", F.row_number().over(per_key(order)))
    return turn.join(offered, [*KEY, "turn"], "left").select("request", "key", "value")
