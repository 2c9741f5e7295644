"""Shared by all operator modules. A table has `db` and `key`, then its own columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["db", "key"]


def per_key(*order: Column | str):
    return Window.partitionBy(*KEY).orderBy(*order)


def live(now: Column) -> Column:
    """Whether a keyspace row is valid: the one rule of expiry, used everywhere."""
    return F.col("expires_at").isNull() | (F.col("expires_at") > now)


def upsert(base: DataFrame, incoming: DataFrame, on: list[str], when: str = "always") -> DataFrame:
    """Rows after the write. when: always, absent (insert only) or present (update only)."""
    if when == "absent":
        return base.unionByName(incoming.join(base, on, "left_anti"))
    if when == "present":
        incoming = incoming.join(base.select(*on), on, "left_semi")
    return base.join(incoming.select(*on), on, "left_anti").unionByName(incoming)


def last_write(incoming: DataFrame, on: list[str], value: str, order: str) -> DataFrame:
    """One row per key: of duplicates the last by order."""
    return incoming.groupBy(*on).agg(F.max_by(value, order).alias(value))


def integer(text: Column) -> Column:
    """The number that a text stands for, null for any other text (blanks are not skipped)."""
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("long"))


# Commands that write, by which of their arguments are keys.
FIRST = (
    "SET", "SETNX", "SETEX", "PSETEX", "GETSET", "APPEND", "INCR", "INCRBY", "DECR", "DECRBY", "SETRANGE", "SETBIT",
    "LPUSH", "RPUSH", "LPOP", "RPOP", "LSET", "LTRIM", "LREM", "SADD", "SREM", "SPOP", "HSET", "HMSET", "HDEL", "HINCRBY",
    "ZADD", "ZREM", "ZINCRBY", "ZPOPMIN", "ZPOPMAX", "ZREMRANGEBYRANK", "ZREMRANGEBYSCORE", "ZREMRANGEBYLEX",
    "EXPIRE", "PEXPIRE", "PERSIST", "XADD", "XDEL", "XTRIM",
)
ALL = ("DEL",)
ALL_BUT_LAST = ("BLPOP", "BRPOP")
PAIRS = ("MSET",)
FIRST_TWO = ("RENAME", "RENAMENX")
FLUSHES = ("FLUSHDB", "FLUSHALL")


def is_write(name: Column) -> Column:
    return name.isin(*FIRST, *ALL, *ALL_BUT_LAST, *PAIRS, *FIRST_TWO, *FLUSHES)
