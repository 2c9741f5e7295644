"""Sets as rows: db, key, member, unique."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyfold.operators.common import KEY

_ROW = [*KEY, "member"]


def add(sets: DataFrame, incoming: DataFrame) -> DataFrame:
    return sets.unionByName(incoming.select(*_ROW).distinct().join(sets, _ROW, "left_anti"))


def added(sets: DataFrame, incoming: DataFrame) -> DataFrame:
    """(db, key, added): new members only."""
    return incoming.select(*_ROW).distinct().join(sets, _ROW, "left_anti").groupBy(*KEY).agg(F.count("*").alias("added"))


def remove(sets: DataFrame, gone: DataFrame) -> DataFrame:
    return sets.join(gone.select(*_ROW), _ROW, "left_anti")


def is_member(sets: DataFrame, asked: DataFrame) -> DataFrame:
    """(db, key, member, found 0/1)."""
    return asked.select(*_ROW).join(sets.select(*_ROW, F.lit(1).alias("hit")), _ROW, "left").select(*_ROW, F.coalesce("hit", F.lit(0)).alias("found"))


def cardinality(sets: DataFrame) -> DataFrame:
    return sets.groupBy(*KEY).agg(F.count("*").alias("n"))


def union(sets: DataFrame, keys: list[str]) -> DataFrame:
    """(db, member), in each database: a missing key is the empty set."""
    return sets.where(F.col("key").isin(keys)).select("db", "member").distinct()


def intersection(sets: DataFrame, keys: list[str]) -> DataFrame:
    """(db, member): in all keys of a database; one aggregation for any number of sets."""
    wanted = list(dict.fromkeys(keys))
    return sets.where(F.col("key").isin(wanted)).groupBy("db", "member").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("db", "member")


def difference(sets: DataFrame, first: str, rest: list[str]) -> DataFrame:
    """(db, member): in first and in none of rest of the same database."""
    others = sets.where(F.col("key").isin(rest)).select("db", "member")
    return sets.where(F.col("key") == first).select("db", "member").join(others, ["db", "member"], "left_anti")


def sample(sets: DataFrame, count: int, seed: int) -> DataFrame:
    """SRANDMEMBER: count >= 0 distinct members, < 0 that many with replacement. The draw follows from seed and member."""
    mixed = F.xxhash64(*_ROW, F.lit(seed))
    nth = F.row_number().over(Window.partitionBy(*KEY).orderBy(mixed, "member"))
    if count >= 0:
        return sets.withColumn("nth", nth).where(F.col("nth") <= count).drop("nth")
    numbered = sets.withColumn("nth", nth)
    sizes = sets.groupBy(*KEY).agg(F.count("*").alias("n"))
    draws = sizes.select(*KEY, "n", F.explode(F.sequence(F.lit(1), F.lit(-count))).alias("draw"))
    draws = draws.withColumn("nth", (F.pmod(F.xxhash64(*KEY, "draw", F.lit(seed)), F.col("n")) + 1).cast("int"))
    return draws.join(numbered, [*KEY, "nth"]).select(*KEY, "draw", "member")


def pop(sets: DataFrame, count: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """SPOP: (popped, left)."""
    taken = sample(sets, count, seed)
    return taken, remove(sets, taken)
