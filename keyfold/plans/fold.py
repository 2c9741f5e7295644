"""State as a fold over an ordered command log: seq, ts, conn, db, argv.

Every fold is an aggregation: the last reset of a key (a write that forgets what was
before: SET, DEL, FLUSHDB and the like) is found by one, and what follows it is combined
by another. Nothing is sorted, and a hot key is combined before the shuffle. Only
`replies`, which tells the result of every single command, orders a key's commands.

A command counts as written in the log: one that changes nothing (DEL of an absent key)
is a reset all the same, which no fold can tell from the other. RENAME moves a state
that a fold only knows at its end, so `last_values` follows it backwards, step by step;
counters of renamed keys are not folded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyfold.functions.scratch import written
from keyfold.operators.common import ALL, ALL_BUT_LAST, FIRST, FIRST_TWO, KEY, PAIRS, integer

def commands(log: DataFrame) -> DataFrame:
    """With name (upper case), key (second word) and args (what follows)."""
    more = F.slice("argv", F.lit(3), F.greatest(F.size("argv") - 2, F.lit(0)))
    return log.select("seq", "ts", "conn", "db", F.upper(F.get("argv", F.lit(0))).alias("name"), F.get("argv", F.lit(1)).alias("key"), more.alias("args"))


def written_keys() -> Column:
    """Of a row of commands: the keys that it writes; empty for FLUSHDB, FLUSHALL and what only reads."""
    name, words = F.col("name"), F.concat(F.array("key"), F.col("args"))
    keys = F.when(name.isin(*FIRST), F.array("key")).when(name.isin(*ALL), words).when(name.isin(*ALL_BUT_LAST), F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))))
    keys = keys.when(name.isin(*PAIRS), F.filter(words, lambda x, i: i % 2 == 0)).when(name.isin(*FIRST_TWO), F.slice(words, 1, 2))
    return F.array_distinct(F.filter(F.coalesce(keys, F.array().cast("array<string>")), lambda x: x.isNotNull()))


def arg(i: int) -> Column:
    return F.get("args", F.lit(i))


def flushes(rows: DataFrame) -> tuple[DataFrame, int]:
    """((db, db_flushed) of each database's last FLUSHDB, the seq of the last FLUSHALL or -1)."""
    by_db = rows.where("name = 'FLUSHDB'").groupBy("db").agg(F.max("seq").alias("db_flushed"))
    last = rows.where("name = 'FLUSHALL'").agg(F.max("seq")).first()[0]
    return by_db, -1 if last is None else last


def unflushed(keyed: DataFrame, flushed: tuple[DataFrame, int], seq: str = "seq") -> DataFrame:
    """The rows after the last flush of their database and of all."""
    by_db, last = flushed
    return keyed.where(F.col(seq) > last).join(by_db, "db", "left").where(F.col("db_flushed").isNull() | (F.col(seq) > F.col("db_flushed"))).drop("db_flushed")


def _values(rows: DataFrame) -> DataFrame:
    """(db, key, seq, pos, step, value, source) of each write of a string: set, absent (SETNX), append, del or move (RENAME's target)."""
    name = F.col("name")
    step = lambda kind, key, value=None, source=None: F.struct(F.lit(kind).alias("step"), key.alias("key"), (F.lit(None).cast("string") if value is None else value).alias("value"), (F.lit(None).cast("string") if source is None else source).alias("source"))
    words = F.concat(F.array("key"), F.col("args"))
    pairs = F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 2) / 2).cast("int")), lambda i: step("set", F.get(words, 2 * i), F.get(words, 2 * i + 1)))
    steps = (
        F.when(name.isin("SET", "GETSET"), F.array(step("set", F.col("key"), arg(0))))
        .when(name.isin("SETEX", "PSETEX"), F.array(step("set", F.col("key"), arg(1))))
        .when((name == "MSET") & (F.size(words) > 1), pairs)
        .when(name == "SETNX", F.array(step("absent", F.col("key"), arg(0))))
        .when(name == "APPEND", F.array(step("append", F.col("key"), arg(0))))
        .when(name == "DEL", F.transform(words, lambda k: step("del", k)))
        .when((name == "RENAME") & (F.col("key") != arg(0)), F.array(step("del", F.col("key")), step("move", arg(0), source=F.col("key"))))
    )
    return rows.select("db", "seq", F.posexplode(steps).alias("pos", "s")).select("db", "s.key", "seq", "pos", "s.step", "s.value", "s.source")


def last_values(log: DataFrame) -> DataFrame:
    """(db, key, value, seq) of strings after SET, SETNX, SETEX, GETSET, MSET, APPEND, DEL, RENAME and flushes; seq is of the last command that changed the key.

    A key's value is its last reset's and what was appended since. Where the reset is a
    RENAME, it is the source's value at that time, looked up the same way, until no
    lookup is open.
    """
    rows = commands(log)
    steps = written(unflushed(_values(rows), flushes(rows)), "value-steps")
    # asked: the name's value is what a key was before a seq, then what has been appended since
    of_name, none = ["db", "name"], F.lit(None).cast("long")
    asked = steps.select("db", F.col("key").alias("name"), "key").distinct().select("*", none.alias("before"), F.lit("").alias("tail"), none.alias("changed"))
    done = None
    while True:
        found = asked.join(steps, KEY).where("before is null or seq < before")
        reset = found.where("step in ('set', 'del', 'move')").groupBy(*of_name).agg(F.max("seq").alias("at"), F.max_by(F.struct("step", "value", "source"), F.struct("seq", "pos")).alias("r"))
        later = found.where("step in ('append', 'absent')").join(reset.select(*of_name, "at"), of_name, "left").where("at is null or seq > at")
        later = later.groupBy(*of_name).agg(F.array_sort(F.collect_list(F.struct("seq", "step", "value"))).alias("more"))
        both = asked.join(reset, of_name, "left").join(later, of_name, "left")
        start = F.when(F.col("r.step") == "set", F.col("r.value"))
        # SETNX counts where nothing was there: first of all, or first after a DEL
        fresh = F.coalesce(F.col("r.step") == "del", F.lit(True))
        counted = F.filter(F.coalesce("more", F.array().cast("array<struct<seq:bigint,step:string,value:string>>")), lambda x, i: (x["step"] == "append") | (fresh & (i == 0)))
        text = F.concat(F.array_join(F.transform(counted, lambda x: x["value"]), ""), F.col("tail"))
        changed = F.coalesce("changed", F.get(F.transform(counted, lambda x: x["seq"]), F.size(counted) - 1), "at")
        there = start.isNotNull() | (F.size(counted) > 0) | (F.col("tail") != "")
        looked = both.select(*of_name, F.coalesce("r.step", F.lit("none")).alias("step"), "r.source", "at", changed.alias("changed"), text.alias("tail"), F.concat(F.coalesce(start, F.lit("")), text).alias("value"), there.alias("there"))
        looked = written(looked, "values")
        ended = looked.where("step != 'move' and there").select("db", F.col("name").alias("key"), "value", F.col("changed").alias("seq"))
        done = ended if done is None else done.unionByName(ended)
        asked = looked.where("step = 'move'").select(*of_name, F.col("source").alias("key"), F.col("at").alias("before"), "tail", "changed")
        if asked.isEmpty():
            return done


def _resets(rows: DataFrame) -> DataFrame:
    """(db, key, reset, text): the last SET (or its kin) or DEL of each key; text is null after DEL."""
    words = F.concat(F.array("key"), F.col("args"))
    named = rows.where("name = 'DEL'").select("db", F.explode(words).alias("key"), "seq", F.lit(None).cast("string").alias("text"))
    sets = rows.where("name in ('SET', 'GETSET', 'SETEX', 'PSETEX')").select("db", "key", "seq", F.when(F.col("name").isin("SETEX", "PSETEX"), arg(1)).otherwise(arg(0)).alias("text"))
    return named.unionByName(sets).groupBy(*KEY).agg(F.max_by(F.struct("text"), "seq")["text"].alias("text"), F.max("seq").alias("reset"))


def counters(log: DataFrame) -> DataFrame:
    """(db, key, value, error) of counters after SET and its kin, DEL, INCR, INCRBY, DECR, DECRBY and flushes.

    error is not_integer (a text or an amount that is no number) or overflow (the total
    since the reset is beyond 64 bits); value is null then.
    """
    rows = commands(log)
    amount = integer(arg(0)).cast("decimal(38,0)")
    delta = F.when(F.col("name") == "INCR", F.lit(1)).when(F.col("name") == "DECR", F.lit(-1)).when(F.col("name") == "INCRBY", amount).when(F.col("name") == "DECRBY", -amount)
    flushed = flushes(rows)
    resets = unflushed(_resets(rows), flushed, "reset")
    steps = rows.where("name in ('INCR', 'INCRBY', 'DECR', 'DECRBY')").select(*KEY, "seq", delta.cast("decimal(38,0)").alias("delta"))
    steps = unflushed(steps, flushed).join(resets.select(*KEY, "reset"), KEY, "left")
    sums = steps.where("reset is null or seq > reset").groupBy(*KEY).agg(F.sum("delta").alias("delta"), F.bool_or(F.col("delta").isNull()).alias("bad"))
    both = resets.join(sums, KEY, "full").where("delta is not null or bad or text is not null")
    start = F.when(F.col("text").isNull(), F.lit(0)).otherwise(integer(F.col("text")))
    total = (start.cast("decimal(38,0)") + F.coalesce("delta", F.lit(0))).try_cast("long")
    error = F.when(start.isNull() | F.coalesce("bad", F.lit(False)), "not_integer").when(total.isNull(), "overflow")
    return both.select(*KEY, F.when(error.isNull(), total).alias("value"), error.alias("error"))


def hashes(log: DataFrame) -> DataFrame:
    """(db, key, field, value, error) of hashes after HSET, HMSET, HDEL, HINCRBY, DEL and flushes; errors as in counters."""
    rows = commands(log)
    pairs = F.transform(F.sequence(F.lit(0), F.floor((F.size("args") - 2) / 2).cast("int")), lambda i: F.struct(F.get("args", 2 * i).alias("field"), F.get("args", 2 * i + 1).alias("text")))
    none = F.lit(None).cast("string")
    sets = rows.where("name in ('HSET', 'HMSET') and size(args) > 1").select(*KEY, "seq", F.posexplode(pairs).alias("pos", "p")).select(*KEY, "seq", "pos", "p.field", "p.text", F.lit(True).alias("sets"))
    gone = rows.where("name = 'HDEL'").select(*KEY, "seq", F.posexplode("args").alias("pos", "field")).withColumn("text", none).withColumn("sets", F.lit(False))
    keys = rows.where("name = 'DEL'").select("db", F.explode(F.concat(F.array("key"), "args")).alias("key"), "seq").groupBy(*KEY).agg(F.max("seq").alias("deleted"))

    flushed = flushes(rows)

    def after(df: DataFrame) -> DataFrame:
        return unflushed(df, flushed).join(keys, KEY, "left").where("deleted is null or seq > deleted").drop("deleted")

    field = [*KEY, "field"]
    last = after(sets.unionByName(gone)).groupBy(*field).agg(F.max_by(F.struct("text", "sets"), F.struct("seq", "pos")).alias("w"), F.max("seq").alias("reset"))
    adds = after(rows.where("name = 'HINCRBY'").select(*KEY, arg(0).alias("field"), "seq", integer(arg(1)).cast("decimal(38,0)").alias("delta")))
    sums = adds.join(last.select(*field, "reset"), field, "left").where("reset is null or seq > reset").groupBy(*field).agg(F.sum("delta").alias("delta"), F.bool_or(F.col("delta").isNull()).alias("bad"))
    both = last.join(sums, field, "full").where("w.sets or delta is not null or bad")
    text, counts = F.col("w.text"), F.col("delta").isNotNull() | F.coalesce("bad", F.lit(False))
    start = F.when(text.isNull(), F.lit(0)).otherwise(integer(text))
    total = (start.cast("decimal(38,0)") + F.col("delta")).try_cast("long")
    error = F.when(counts & (start.isNull() | F.coalesce("bad", F.lit(False))), "not_integer").when(counts & total.isNull(), "overflow")
    return both.select(*field, F.when(error.isNull(), F.when(counts, total.cast("string")).otherwise(text)).alias("value"), error.alias("error"))


def hash_counters(log: DataFrame) -> DataFrame:
    """(db, key, field, value, error): the fields that are numbers."""
    return hashes(log).select(*KEY, "field", integer(F.col("value")).alias("value"), "error").where("value is not null or error is not null")


def limits(log: DataFrame) -> DataFrame:
    """(db, key, expires_at) of keys with a limit after EXPIRE, PEXPIRE, SETEX and PSETEX; SET, GETSET, PERSIST, DEL and flushes clear it. Needs ts."""
    rows = commands(log)
    ms = F.when(F.col("name").isin("EXPIRE", "SETEX"), integer(arg(0)) * 1000).when(F.col("name").isin("PEXPIRE", "PSETEX"), integer(arg(0)))
    own = rows.where("name in ('EXPIRE', 'PEXPIRE', 'SETEX', 'PSETEX', 'SET', 'GETSET', 'PERSIST')").select(*KEY, "seq", F.when(ms.isNotNull(), F.timestamp_millis(F.unix_millis("ts") + ms)).alias("until"))
    gone = rows.where("name = 'DEL'").select("db", F.explode(F.concat(F.array("key"), "args")).alias("key"), "seq", F.lit(None).cast("timestamp").alias("until"))
    last = own.unionByName(gone).groupBy(*KEY).agg(F.max_by(F.struct("until"), "seq")["until"].alias("expires_at"), F.max("seq").alias("seq"))
    return unflushed(last, flushes(rows)).where("expires_at is not null").select(*KEY, "expires_at")


def replies(log: DataFrame) -> DataFrame:
    """(db, key, seq, name, reply) of every SET, GETSET, DEL, INCR, INCRBY, DECR and DECRBY of counters: running sums since the key's last reset."""
    rows = commands(log).where("name in ('SET', 'GETSET', 'DEL', 'INCR', 'INCRBY', 'DECR', 'DECRBY')")
    amount = integer(arg(0)).cast("decimal(38,0)")
    is_reset = F.col("name").isin("SET", "GETSET", "DEL")
    step = F.when(F.col("name") == "INCR", F.lit(1)).when(F.col("name") == "DECR", F.lit(-1)).when(F.col("name") == "DECRBY", -amount).when(F.col("name") == "DEL", F.lit(0)).otherwise(amount)
    in_order = Window.partitionBy(*KEY).orderBy("seq")
    rows = rows.withColumn("since", F.sum(is_reset.cast("int")).over(in_order))
    total = F.sum(step.cast("decimal(38,0)")).over(Window.partitionBy(*KEY, "since").orderBy("seq"))
    return rows.select(*KEY, "seq", "name", F.when(F.col("name") != "DEL", total.try_cast("long")).alias("reply"))


def since(log: DataFrame, offset: int) -> DataFrame:
    """Partial resync: what follows an offset; the filter reaches the scan."""
    return log.where(F.col("seq") > offset)
