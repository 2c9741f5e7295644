"""Keys of any type: db, key, type, expires_at TIMESTAMP, version. `now` is always given, never read from a clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyfold.functions import glob as globs
from keyfold.operators.common import KEY, live


def alive(keys: DataFrame, now: Column) -> DataFrame:
    return keys.where(live(now))


def exists(keys: DataFrame, asked: DataFrame, now: Column) -> DataFrame:
    """(request, n): repeated arguments count again. asked: db, request, key."""
    hits = asked.join(alive(keys, now).select(*KEY, F.lit(1).alias("hit")), KEY, "left")
    return hits.groupBy("request").agg(F.count("hit").alias("n"))


def type_of(keys: DataFrame, asked: DataFrame, now: Column) -> DataFrame:
    """(db, key, type), `none` where absent or expired."""
    return asked.select(*KEY).join(alive(keys, now), KEY, "left").select(*KEY, F.coalesce("type", F.lit("none")).alias("type"))


def ttl(keys: DataFrame, asked: DataFrame, now: Column, unit_us: int = 1_000_000) -> DataFrame:
    """(db, key, ttl): rounded up to the unit; -1 without a limit, -2 where absent or expired. unit_us 1000 is PTTL."""
    left = F.unix_micros("expires_at") - F.unix_micros(now)
    found = asked.select(*KEY).join(alive(keys, now).withColumn("there", F.lit(True)), KEY, "left")
    value = F.when(F.col("there").isNull(), F.lit(-2)).when(F.col("expires_at").isNull(), F.lit(-1)).otherwise(F.ceil(left / unit_us))
    return found.select(*KEY, value.cast("long").alias("ttl"))


def expire(keys: DataFrame, limits: DataFrame, now: Column) -> DataFrame:
    """Live keys after EXPIRE or PEXPIRE. limits: db, key, ms; of 0 or less deletes the key."""
    rows = alive(keys, now).join(limits.select(*KEY, "ms"), KEY, "left").where("ms is null or ms > 0")
    until = F.timestamp_millis(F.unix_millis(now) + F.col("ms"))
    return rows.withColumn("expires_at", F.when(F.col("ms").isNotNull(), until).otherwise(F.col("expires_at"))).drop("ms")


def persist(keys: DataFrame, asked: DataFrame, now: Column) -> DataFrame:
    """(db, key, done): 1 where there was a limit to drop."""
    found = asked.select(*KEY).join(alive(keys, now), KEY, "left")
    return found.select(*KEY, F.col("expires_at").isNotNull().cast("int").alias("done"))


def delete(keys: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of any table with db and key after DEL."""
    return keys.join(gone.select(*KEY), KEY, "left_anti")


def rename(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """Rows of any table after renaming db, key to db, new_key, overwriting; moves apply at once and have distinct sources and targets."""
    present = moves.join(rows.select(*KEY).distinct(), KEY, "left_semi")
    kept = rows.join(present.select("db", F.col("new_key").alias("key")), KEY, "left_anti").join(present.select(*KEY), KEY, "left_anti")
    moved = rows.join(present, KEY).drop("key").withColumnRenamed("new_key", "key")
    return kept.unionByName(moved.select(*rows.columns))


def rename_if_absent(keys: DataFrame, moves: DataFrame, now: Column) -> DataFrame:
    """(db, key, new_key, done): 1 where the source lives and the target does not; null where the source is absent."""
    there = alive(keys, now).select(*KEY, F.lit(1).alias("there"))
    target = there.select("db", F.col("key").alias("new_key"), F.col("there").alias("taken"))
    both = moves.join(there, KEY, "left").join(target, ["db", "new_key"], "left")
    return both.select(*KEY, "new_key", F.when(F.col("there").isNotNull(), F.col("taken").isNull().cast("int")).alias("done"))


def matching(keys: DataFrame, glob: str, now: Column) -> DataFrame:
    """KEYS: (db, key)."""
    return alive(keys, now).where(globs.matches(F.col("key"), glob)).select(*KEY)


def page(rows: DataFrame, within: list[str], name: str, after: str | None, count: int, glob: str | None = None) -> DataFrame:
    """One page of a SCAN by name: rows that follow `after`, `count` examined per group, then filtered by glob.

    A cursor is the last name examined, so a page is a filter that reaches the scan and a
    top-k per group, however far into the table it is. within: [] for the whole table
    (then one global top-k), [db, key] for HSCAN, SSCAN and ZSCAN.
    """
    rows = rows if after is None else rows.where(F.col(name) > F.lit(after))
    if within:
        nth = F.row_number().over(Window.partitionBy(*within).orderBy(name))
        rows = rows.withColumn("nth", nth).where(F.col("nth") <= count).drop("nth")
    else:
        rows = rows.orderBy(name).limit(count)
    return rows if glob is None else rows.where(globs.matches(F.col(name), glob))


def size(keys: DataFrame, now: Column) -> DataFrame:
    """DBSIZE of each database."""
    return alive(keys, now).groupBy("db").agg(F.count("*").alias("n"))


def flush(rows: DataFrame, db: int | None = None) -> DataFrame:
    """FLUSHDB, or FLUSHALL without db."""
    return rows.limit(0) if db is None else rows.where(F.col("db") != db)


def random_key(keys: DataFrame, now: Column, seed: int) -> DataFrame:
    """RANDOMKEY: the least hash under the seed, by a min over all keys; no sort."""
    return alive(keys, now).agg(F.min_by(F.struct(*KEY), F.xxhash64(*KEY, F.lit(seed))).alias("k")).select("k.db", "k.key")


def wrong_type(keys: DataFrame, asked: DataFrame, wanted: str, now: Column) -> DataFrame:
    """(db, key, error): WRONGTYPE for keys that live with another type than the command wants."""
    hit = asked.select(*KEY).join(alive(keys, now).where(F.col("type") != wanted), KEY, "left_semi")
    return hit.withColumn("error", F.lit("WRONGTYPE"))
