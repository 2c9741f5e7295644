"""Queries that run streams to the end of their files, and round trips through sources and sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.functions.scratch import fresh_path
from keyfold.operators import admin
from keyfold.plans import fold
from keyfold.plans.fixtures import Tables, with_
from keyfold.plans.logs import _MSG, _ROUTE, _SUBS, _subs
from keyfold.plans.registry import query
from keyfold.sources import snapshot
from keyfold.sources.command_log import CommandLog
from keyfold.streaming import jobs


def _events(t: Tables, files: int | None = 64) -> DataFrame:
    return jobs.as_stream(f"{t.sf_dir}/event[s].parquet", t.table("events"), files).withColumn("ts", jobs.utc("ts"))


def _ran(t: Tables, stream: DataFrame, mode: str = "append", each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    path = fresh_path(t.spark, "stream")
    jobs.run_available(stream, f"{path}/rows", f"{path}/checkpoint", mode, each)
    return t.spark.read.parquet(f"{path}/rows")


@query("SELECT event_type, epoch_us(ts) // 3600000000 * 3600 AS hour, count(*) AS n FROM events GROUP BY 1, 2")
def streaming_windows(t: Tables) -> DataFrame:
    """Each batch writes the windows that it changed, and windows behind the watermark leave the state; of a window the newest batch holds."""
    rows = _ran(t, jobs.event_windows(_events(t)), "update").groupBy("event_type", "start").agg(F.max_by("n", "batch").alias("n"))
    return rows.select("event_type", F.unix_seconds("start").alias("hour"), "n")


@query("WITH s AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), n AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM s) SELECT user_id, min(epoch_us(ts)) AS start, count(*) AS n FROM n GROUP BY user_id, k")
def streaming_sessions(t: Tables) -> DataFrame:
    """Sessions are written once the watermark has passed them; an event of the end, a year later, closes those still open."""
    path = fresh_path(t.spark, "stream")
    end = t.events.agg((F.max("ts") + F.expr("interval 1 year")).alias("ts"))
    jobs.run_to_the_end(lambda events: jobs.sessions(events, "6 hours"), _events(t), end, ["user_id", "ts"], path)
    rows = t.spark.read.parquet(f"{path}/rows").where("user_id is not null")
    return rows.select("user_id", F.unix_micros("start").alias("start"), "n")


@query(f"WITH {_SUBS}, {_MSG}, {_ROUTE} SELECT msg, conn, via, topic FROM routed")
def streaming_router(t: Tables) -> DataFrame:
    messages = _events(t).select(F.col("event_id").alias("msg"), F.concat_ws(".", "event_type", "user_id").alias("channel"))
    return _ran(t, messages, each=jobs.router(_subs(t))).select("msg", "conn", "via", "topic")


@query("SELECT key, ms, event_id AS seq, 'w' || (n % 3) AS consumer, n AS nth FROM (SELECT event_type AS key, epoch_us(ts) // 1000 AS ms, event_id, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 1000, event_id) - 1 AS n FROM events)")
def streaming_group_delivery(t: Tables) -> DataFrame:
    """All files are one batch, as the entries of a later one may have lower ids and would be late."""
    entries = _events(t, files=None).select(F.col("event_type").alias("key"), F.floor(F.unix_micros("ts") / 1000).cast("long").alias("ms"), F.col("event_id").alias("seq"))
    return _ran(t, jobs.group_delivery(entries, 3)).where("not late").select("key", "ms", "seq", "consumer", "nth")


_SIDE = "SELECT 'q' || (user_id %% 10) AS key, event_id, row_number() OVER (PARTITION BY user_id %% 10 ORDER BY event_id) AS n FROM events WHERE event_type = '%s'"


@query(f"SELECT a.key, a.event_id AS pop, b.event_id AS push FROM ({_SIDE % 'view'}) a JOIN ({_SIDE % 'click'}) b USING (key, n)")
def streaming_blocking_queue(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "push").when(F.col("event_type") == "view", "pop")
    events = _events(t).select(F.concat(F.lit("q"), F.col("user_id") % 10).alias("key"), F.col("event_id").alias("seq"), kind.alias("kind")).where("kind is not null")
    return _ran(t, jobs.blocking_queue(events)).select("key", "pop", "push")


@query(
    with_(
        "log",
        body=""", r AS (SELECT slot, max(seq) AS reset, max_by(event_type, seq) AS kind, max_by(amount, seq) AS amount FROM log WHERE event_type IN ('signup', 'error') GROUP BY slot),
c AS (SELECT slot, max(seq) AS last FROM log WHERE event_type IN ('signup', 'error', 'click') GROUP BY slot),
k AS (SELECT log.slot, count(*) AS n FROM log LEFT JOIN r USING (slot) WHERE event_type = 'click' AND (reset IS NULL OR seq > reset) GROUP BY log.slot)
SELECT 'k:' || c.slot AS key, CAST(CASE WHEN kind = 'error' AND n IS NULL THEN NULL ELSE CASE WHEN kind = 'signup' THEN amount ELSE 0 END + coalesce(n, 0) END AS BIGINT) AS value FROM c LEFT JOIN r USING (slot) LEFT JOIN k USING (slot)""",
    )
)
def streaming_log_replay(t: Tables) -> DataFrame:
    """A replica: the live fold of the log, newest value of each key."""
    name = F.when(F.col("event_type") == "click", "INCR").when(F.col("event_type") == "signup", "SET").when(F.col("event_type") == "error", "DEL")
    log = _events(t).select(F.concat(F.lit("k:"), F.col("event_id") % 50).alias("key"), F.col("event_id").alias("seq"), name.alias("name"), F.floor("value").alias("amount")).where("name is not null")
    rows = _ran(t, jobs.live_counters(log), "update")
    return rows.groupBy("key").agg(F.max_by("value", "batch").alias("value"))


@query("SELECT event_id AS seq, (epoch_us(ts) // 1000000) || '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') || ' [0 ' || user_id || '] \"' || event_type || '\" \"say \\\"' || event_id || '\\\"\"' AS line FROM events")
def streaming_monitor(t: Tables) -> DataFrame:
    said = F.concat(F.lit('say "'), F.col("event_id").cast("string"), F.lit('"'))
    log = _events(t).select(F.col("event_id").alias("seq"), "ts", F.lit("0").alias("db"), F.col("user_id").cast("string").alias("conn"), F.array("event_type", said).alias("argv"))
    return _ran(t, admin.monitor(log)).select("seq", "line")


# ---------------------------------------------------------------- sources and sinks


@query(with_("ks", "hsh", body="SELECT ks.key, field, value FROM hsh JOIN ks USING (key) WHERE expires_at IS NULL OR expires_at > TIMESTAMP '1998-06-01'"))
def snapshot_roundtrip(t: Tables) -> DataFrame:
    """Hashes with the keyspace's limits, saved and loaded: what has expired does not come back."""
    path = fresh_path(t.spark, "snapshot")
    keys = t.keys.withColumn("db", F.lit(0))
    snapshot.save(path, {"hashes": t.hashes}, keys, t.now)
    return snapshot.load(t.spark, path, t.now)["hashes"].select("key", "field", "value")


@query("SELECT CAST(epoch_us(TIMESTAMP '1998-06-01') // 1000000 AS BIGINT) AS saved_at")
def snapshot_lastsave(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "snapshot")
    snapshot.save(path, {}, t.keys.limit(0), t.now)
    return snapshot.last_save(t.spark, path).select(F.unix_seconds("saved_at").alias("saved_at"))


@query(with_("log", body="SELECT 'h:' || slot AS key, count(*) AS commands, CAST(sum(amount) AS BIGINT) AS total FROM log WHERE event_type = 'purchase' GROUP BY slot"))
def log_source_replay(t: Tables) -> DataFrame:
    """The log written as command files in order of seq, in two appends, read again, and folded."""
    t.spark.dataSource.register(CommandLog)
    path = fresh_path(t.spark, "commands")
    first, second = t.log.where("seq <= 5000"), t.log.where("seq > 5000")
    for part in (first, second):
        ordered = part.repartitionByRange("seq").sortWithinPartitions("seq").select(F.lit("").alias("file"), F.lit(0).cast("long").alias("pos"), "argv")
        ordered.write.format("command_log").mode("append").save(path)
    back = t.spark.read.format("command_log").load(path)
    rows = fold.commands(back.select(F.col("pos").alias("seq"), F.lit(None).cast("timestamp").alias("ts"), F.lit(0).cast("long").alias("conn"), F.lit(0).alias("db"), "argv"))
    adds = rows.where("name = 'HINCRBY'")
    return adds.groupBy("key").agg(F.count("*").alias("commands"), F.sum(F.get("args", F.lit(1)).cast("long")).alias("total"))


@query(with_("log", body="SELECT 'k:' || slot AS key, max_by(CAST(amount AS VARCHAR), seq) AS value FROM log WHERE event_type IN ('signup', 'error') GROUP BY slot HAVING max_by(event_type, seq) = 'signup'"))
def log_compact(t: Tables) -> DataFrame:
    """BGREWRITEAOF: what the log comes to, as a base that loads without it."""
    path = fresh_path(t.spark, "base")
    snapshot.compact(fold.last_values(t.log.where("argv[0] in ('SET', 'DEL')")), path, t.now)
    return snapshot.load(t.spark, path, t.now)["strings"].select("key", "value")
