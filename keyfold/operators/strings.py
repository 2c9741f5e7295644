"""String values: set-level lookups, writes, counters, byte ranges and bits. Table: db, key, value (BINARY or STRING)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyfold.functions.ranges import bounds
from keyfold.operators.common import KEY, integer, last_write, upsert


def get(strings: DataFrame, keys: DataFrame) -> DataFrame:
    """(db, key, value) for every row of keys; value is null where the key is absent."""
    return keys.select(*KEY).join(strings, KEY, "left").select(*KEY, "value")


def mget(strings: DataFrame, requests: DataFrame) -> DataFrame:
    """(request, pos, key, value) in argument order. requests: db, request, keys ARRAY."""
    asked = requests.select("db", "request", F.posexplode("keys").alias("pos", "key"))
    return asked.join(strings, KEY, "left").select("request", "pos", "key", "value")


def put(strings: DataFrame, incoming: DataFrame, when: str = "always") -> DataFrame:
    """SET, MSET: incoming has db, key, value, pos; of a key's writes the last holds."""
    return upsert(strings.select(*KEY, "value"), last_write(incoming, KEY, "value", "pos"), KEY, when)


def put_for(strings: DataFrame, keys: DataFrame, incoming: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """SET, SETEX and PSETEX: (values, keyspace) after writes (db, key, value, pos, ms); ms is the limit, null clears what was set.

    A limit of 0 or less is refused: such a write changes nothing. Of a key's writes the
    last that isn't refused holds, value and limit alike, whatever the key's type was.
    """
    last = incoming.where("ms is null or ms > 0").groupBy(*KEY).agg(F.max_by(F.struct("value", "ms"), "pos").alias("w"))
    last = last.select(*KEY, "w.value", F.timestamp_millis(F.unix_millis(now) + F.col("w.ms")).alias("expires_at"))
    names = last.withColumn("type", F.lit("string"))
    left = keys.join(last.select(*KEY), KEY, "left_anti").unionByName(names.select(*KEY, "type", "expires_at"), allowMissingColumns=True)
    return upsert(strings.select(*KEY, "value"), last.select(*KEY, "value"), KEY), left


def set_if_absent(strings: DataFrame, incoming: DataFrame) -> DataFrame:
    """(db, key, pos, done): SETNX one after the other; only a key's first write can succeed."""
    first = F.row_number().over(Window.partitionBy(*KEY).orderBy("pos")) == 1
    there = strings.select(*KEY, F.lit(True).alias("there"))
    return incoming.withColumn("first", first).join(there, KEY, "left").select(*KEY, "pos", (F.col("first") & F.col("there").isNull()).cast("int").alias("done"))


def getset(strings: DataFrame, incoming: DataFrame) -> DataFrame:
    """(db, key, pos, old): the value that each write finds."""
    before = F.lag("value").over(Window.partitionBy(*KEY).orderBy("pos"))
    own = incoming.withColumn("before", before).withColumn("first", F.row_number().over(Window.partitionBy(*KEY).orderBy("pos")) == 1)
    there = strings.select(*KEY, F.col("value").alias("stored"))
    return own.join(there, KEY, "left").select(*KEY, "pos", F.when(F.col("first"), F.col("stored")).otherwise(F.col("before")).alias("old"))


def increment(strings: DataFrame, deltas: DataFrame) -> DataFrame:
    """(db, key, value, error): INCRBY and DECRBY of all deltas of a key. error: not_integer or overflow; then value stays null."""
    total = deltas.groupBy(*KEY).agg(F.sum(F.col("delta").cast("decimal(38,0)")).alias("delta"))
    both = total.join(strings.select(*KEY, F.col("value").alias("text")), KEY, "left")
    start = F.when(F.col("text").isNull(), F.lit(0)).otherwise(integer(F.col("text").cast("string")))
    value = (start.cast("decimal(38,0)") + F.col("delta")).try_cast("long")
    error = F.when(start.isNull(), "not_integer").when(value.isNull(), "overflow")
    return both.select(*KEY, value.alias("value"), error.alias("error"))


def append(strings: DataFrame, parts: DataFrame) -> DataFrame:
    """(db, key, value) of the keys written; parts (db, key, pos, part) follow in order of pos."""
    more = parts.groupBy(*KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]), "").alias("more"))
    return more.join(strings, KEY, "left").select(*KEY, F.concat(F.coalesce(F.col("value").cast("string"), F.lit("")), "more").alias("value"))


def strlen(strings: DataFrame, keys: DataFrame) -> DataFrame:
    """(db, key, length) in bytes, 0 where absent."""
    return get(strings, keys).select(*KEY, F.coalesce(F.octet_length("value"), F.lit(0)).cast("long").alias("length"))


def getrange(value: Column, start: int, stop: int) -> Column:
    """Inclusive byte range of a binary value."""
    n = F.octet_length(value).cast("long")
    s, e = bounds(start, stop, n)
    return F.when(s <= e, F.substring(value, (s + 1).cast("int"), (e - s + 1).cast("int"))).otherwise(F.lit(b""))


def setrange(value: Column, offset: int, part: bytes) -> Column:
    """The value with part at a byte offset, zero bytes in the gap."""
    value = F.coalesce(value, F.lit(b""))
    padded = F.rpad(value, F.greatest(F.lit(offset), F.octet_length(value)), F.lit(b"\x00"))
    return F.overlay(padded, F.lit(part), F.lit(offset + 1))


def byte_at(value: Column, offset: Column) -> Column:
    """The byte at a 0-based offset as a number, 0 beyond the end."""
    code = F.conv(F.hex(F.substring(value, (offset + 1).cast("int"), F.lit(1))), 16, 10).try_cast("long")
    return F.when(offset < F.octet_length(value), F.coalesce(code, F.lit(0))).otherwise(F.lit(0))


def getbit(value: Column, offset: int) -> Column:
    """Bit number offset, the most significant of a byte first."""
    return F.getbit(byte_at(value, F.lit(offset // 8)), F.lit(7 - offset % 8)).cast("long")


def setbit(value: Column, offset: int, bit: int) -> Column:
    """The value with one bit set or cleared, extended with zero bytes."""
    flag, at = 1 << (7 - offset % 8), F.lit(offset // 8)
    old = byte_at(value, at)
    new = old.bitwiseOR(F.lit(flag)) if bit else old.bitwiseAND(F.lit(255 - flag))
    padded = F.rpad(value, F.greatest(at + 1, F.octet_length(value)), F.lit(b"\x00"))
    return F.overlay(padded, F.unhex(F.lpad(F.hex(new), 2, "0")), F.lit(offset // 8 + 1))


def bitcount(value: Column, start: int = 0, stop: int = -1) -> Column:
    """Set bits in an inclusive byte range: of each hex digit, summed."""
    digits = F.hex(getrange(value, start, stop))
    counts = F.translate(digits, "0123456789ABCDEF", "0112122312232334")
    return F.aggregate(F.split(counts, ""), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x.try_cast("long"), F.lit(0)))
