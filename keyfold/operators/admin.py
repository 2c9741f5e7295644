"""Figures about the store and its log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyfold.operators.common import KEY, is_write

#: Fixed value: bytes that a stored value takes besides its content.
OVERHEAD = 24


def keyspace(keys: DataFrame) -> DataFrame:
    """INFO keyspace: (db, keys, expires)."""
    return keys.groupBy("db").agg(F.count("*").alias("keys"), F.count_if(F.col("expires_at").isNotNull()).alias("expires"))


def stats(log: DataFrame) -> DataFrame:
    """INFO stats of a command log: (commands, connections, writes, names)."""
    rows = log.select("conn", F.upper(F.get("argv", F.lit(0))).alias("name"))
    return rows.agg(F.count("*").alias("commands"), F.count_distinct("conn").alias("connections"), F.count_if(is_write(F.col("name"))).alias("writes"), F.count_distinct("name").alias("names"))


def command_stats(log: DataFrame) -> DataFrame:
    """INFO commandstats: (name, calls)."""
    return log.groupBy(F.upper(F.get("argv", F.lit(0))).alias("name")).agg(F.count("*").alias("calls"))


def memory_by_type(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """INFO memory: (type, keys, bytes) of tables by type, each with the columns that hold its content."""
    parts = [memory_stats(memory_usage(df, *columns)).agg(F.sum("keys").alias("keys"), F.sum("bytes").alias("bytes")).select(F.lit(kind).alias("type"), "keys", "bytes") for kind, (df, columns) in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def monitor(log: DataFrame) -> DataFrame:
    """MONITOR: (seq, line) of each command: time, database, client, and the words in quotes. Works on streams as on tables."""
    quoted = F.transform("argv", lambda a: F.concat(F.lit('"'), F.regexp_replace(a, r'(["\\])', r"\\$1"), F.lit('"')))
    micros = F.unix_micros("ts")
    time = F.concat_ws(".", F.floor(micros / 1_000_000), F.lpad(F.pmod(micros, F.lit(1_000_000)).cast("string"), 6, "0"))
    return log.select("seq", F.concat(time, F.lit(" ["), "db", F.lit(" "), "conn", F.lit("] "), F.array_join(quoted, " ")).alias("line"))


def hit_rate(reads: DataFrame) -> DataFrame:
    """(hits, misses, rate). reads: hit BOOLEAN."""
    return reads.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.avg(F.col("hit").cast("int")).alias("rate"))


def slowlog(log: DataFrame, threshold_us: int = 10_000, n: int = 128, args: int = 10, chars: int = 64) -> DataFrame:
    """The newest n commands at or above the threshold: id, ts, duration_us, argv (cut short), client. A global top-k."""
    cut = F.transform(F.slice("argv", 1, args), lambda a: F.substring(a, 1, chars))
    rows = log.where(F.col("duration_us") >= threshold_us).orderBy(F.desc("id")).limit(n)
    return rows.select("id", "ts", "duration_us", cut.alias("argv"), "client")


def memory_usage(rows: DataFrame, *columns: str) -> DataFrame:
    """(db, key, bytes): content of the columns and an overhead for each value."""
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + OVERHEAD for c in columns), F.lit(0))
    return rows.groupBy(*KEY).agg(F.sum(size.cast("long")).alias("bytes"))


def largest(usage: DataFrame, n: int = 10) -> DataFrame:
    """MEMORY DOCTOR: the n largest keys."""
    return usage.orderBy(F.desc("bytes"), *KEY).limit(n)


def memory_stats(usage: DataFrame) -> DataFrame:
    return usage.groupBy("db").agg(F.count("*").alias("keys"), F.sum("bytes").alias("bytes"), F.max("bytes").alias("most"))


def save_points(writes: DataFrame, rules: list[tuple[int, int]]) -> DataFrame:
    """(second, changes, rule): seconds in which a save rule (seconds, changes) is met by the changes in the time before.

    writes: ts TIMESTAMP. Changes are first counted per second, then summed over ranges of
    time, partitioned by day; a second is carried over to all days that the widest rule reaches.
    """
    per_second = writes.groupBy(F.unix_seconds("ts").alias("second")).agg(F.count("*").alias("changes"))
    widest = max(s for s, _ in rules)
    day = F.floor(F.col("second") / 86400)
    carried = per_second.select("*", F.explode(F.sequence(day, F.floor((F.col("second") + widest - 1) / 86400))).alias("day"))
    out = None
    for seconds, changes in rules:
        over = Window.partitionBy("day").orderBy("second").rangeBetween(-seconds + 1, 0)
        hits = carried.withColumn("total", F.sum("changes").over(over)).where((day == F.col("day")) & (F.col("total") >= changes))
        hits = hits.select("second", F.col("total").alias("changes"), F.lit(f"{seconds}/{changes}").alias("rule"))
        out = hits if out is None else out.unionByName(hits)
    return out
