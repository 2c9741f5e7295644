"""Queries over messages, the command log, transactions and the store's figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.operators import admin, pubsub
from keyfold.plans import fold, procedures, transactions
from keyfold.plans.fixtures import Tables, with_
from keyfold.plans.registry import query

# ---------------------------------------------------------------- publish and subscribe

SUBS = [
    (1, "channel", "click.7"), (1, "pattern", "click.*"), (1, "pattern", "*.7"),
    (2, "pattern", "*.7"), (3, "pattern", "view.1?"), (3, "channel", "view.10"),
    (4, "channel", "nothing"), (5, "pattern", "*"), (6, "pattern", "a[b]c"), (7, "pattern", "error.\\*"),
]
_SUBS = "subs(conn, kind, topic) AS (VALUES " + ", ".join(f"({c}, '{k}', '{x}')" for c, k, x in SUBS) + ")"
_MSG = "msg AS (SELECT event_id AS msg, event_type || '.' || user_id AS channel FROM events)"
_ROUTE = """hit AS (
  SELECT msg, conn, kind AS via, topic FROM msg JOIN subs ON kind = 'channel' AND topic = channel
  UNION ALL SELECT msg, conn, kind, topic FROM msg JOIN subs ON kind = 'pattern' AND (
    topic = 'click.*' AND channel LIKE 'click.%' OR topic = '*.7' AND channel LIKE '%.7' OR topic = 'view.1?' AND channel LIKE 'view.1_' OR topic = '*')
), routed AS (SELECT msg, conn, min_by(via, (via, topic)) AS via, min_by(topic, (via, topic)) AS topic FROM hit GROUP BY msg, conn)"""


def _messages(t: Tables) -> DataFrame:
    return t.table("events").select(F.col("event_id").alias("msg"), F.concat_ws(".", "event_type", "user_id").alias("channel"))


def _subs(t: Tables) -> DataFrame:
    return t.literal(SUBS, "conn int, kind string, topic string")


@query(f"WITH {_SUBS}, {_MSG}, {_ROUTE} SELECT msg, conn, via, topic FROM routed")
def pubsub_route(t: Tables) -> DataFrame:
    return pubsub.route(_messages(t), _subs(t))


@query(f"WITH {_SUBS}, {_MSG}, {_ROUTE} SELECT msg, count(conn) AS n FROM msg LEFT JOIN routed USING (msg) GROUP BY msg")
def pubsub_publish_count(t: Tables) -> DataFrame:
    return pubsub.receivers(_messages(t), _subs(t))


@query(f"WITH {_SUBS}, {_MSG}, {_ROUTE} SELECT msg, conn, min(topic) AS topic FROM hit WHERE via = 'pattern' GROUP BY msg, conn")
def pubsub_pattern_only(t: Tables) -> DataFrame:
    return pubsub.route(_messages(t), _subs(t).where("kind = 'pattern'")).select("msg", "conn", "topic")


_CHANGES = "chg AS (SELECT user_id AS conn, 'channel' AS kind, 'ch' || (event_id % 6) AS topic, event_id AS seq, CASE WHEN event_type IN ('error', 'view') THEN 'unsub' ELSE 'sub' END AS op FROM events)"


def _changes(t: Tables) -> DataFrame:
    op = F.when(F.col("event_type").isin("error", "view"), "unsub").otherwise("sub")
    return t.table("events").select(F.col("user_id").alias("conn"), F.lit("channel").alias("kind"), F.concat(F.lit("ch"), F.col("event_id") % 6).alias("topic"), F.col("event_id").alias("seq"), op.alias("op"))


@query(f"WITH {_CHANGES}, s AS (SELECT conn, seq, CAST(op = 'sub' AS INT) - coalesce(lag(CAST(op = 'sub' AS INT)) OVER (PARTITION BY conn, topic ORDER BY seq), 0) AS d FROM chg) SELECT conn, seq, CAST(sum(d) OVER (PARTITION BY conn ORDER BY seq) AS BIGINT) AS n FROM s")
def pubsub_sub_count(t: Tables) -> DataFrame:
    return pubsub.subscription_counts(_changes(t))


@query(f"WITH {_CHANGES} SELECT conn, topic FROM chg WHERE conn % 10 <> 0 GROUP BY conn, topic HAVING max_by(op, seq) = 'sub' UNION ALL SELECT conn, topic FROM chg WHERE conn % 10 = 0 AND seq > 5000 GROUP BY conn, topic HAVING max_by(op, seq) = 'sub'")
def pubsub_live(t: Tables) -> DataFrame:
    """Connections that are a multiple of ten drop all channels at 5,000."""
    drops = _changes(t).where("conn % 10 = 0").select("conn", "kind").distinct().select("conn", "kind", F.lit(None).cast("string").alias("topic"), F.lit(5000).cast("long").alias("seq"), F.lit("unsub").alias("op"))
    return pubsub.live_subscriptions(_changes(t).unionByName(drops)).select("conn", "topic")


# ---------------------------------------------------------------- the log

_KEY = "'k:' || slot"


@query(with_("log", body=f"SELECT {_KEY} AS key, max_by(CAST(amount AS VARCHAR), seq) AS value, max(seq) AS seq FROM log WHERE event_type IN ('signup', 'error') GROUP BY slot HAVING max_by(event_type, seq) = 'signup'"))
def log_fold_lww(t: Tables) -> DataFrame:
    return fold.last_values(t.log).select("key", "value", "seq")


_PARTS = """, e AS (SELECT slot, seq, event_type AS kind, CAST(amount AS VARCHAR) AS text FROM log WHERE event_type IN ('signup', 'error', 'click', 'purchase')),
r AS (SELECT slot, max(seq) AS reset_at, max_by(kind, seq) AS kind, max_by(text, seq) AS text FROM e WHERE kind IN ('signup', 'error') GROUP BY slot),
l AS (SELECT e.slot, e.seq, e.kind, e.text, row_number() OVER (PARTITION BY e.slot ORDER BY e.seq) AS n, r.kind AS after FROM e LEFT JOIN r USING (slot) WHERE e.kind IN ('click', 'purchase') AND (reset_at IS NULL OR e.seq > reset_at)),
m AS (SELECT slot, string_agg(text, '' ORDER BY seq) AS more, max(seq) AS seq FROM l WHERE kind = 'click' OR n = 1 AND coalesce(after, 'error') = 'error' GROUP BY slot)
SELECT 'k:' || slot AS key, CASE WHEN kind = 'signup' THEN text ELSE '' END || coalesce(more, '') AS value, coalesce(seq, reset_at) AS seq FROM r FULL JOIN m USING (slot) WHERE kind = 'signup' OR more IS NOT NULL"""


@query(with_("log", body=_PARTS))
def log_fold_values(t: Tables) -> DataFrame:
    """SET, DEL, APPEND and SETNX of the same keys."""
    name = F.when(F.col("event_type") == "signup", "SET").when(F.col("event_type") == "error", "DEL").when(F.col("event_type") == "click", "APPEND").when(F.col("event_type") == "purchase", "SETNX")
    slot, amount = F.concat(F.lit("k:"), F.col("event_id") % 50), F.floor("value").cast("string")
    argv = F.when(name == "DEL", F.array(name, slot)).otherwise(F.array(name, slot, amount))
    rows = t.events.where(name.isNotNull()).select(F.col("event_id").alias("seq"), "ts", F.col("user_id").alias("conn"), F.lit(0).alias("db"), argv.alias("argv"))
    return fold.last_values(rows).select("key", "value", "seq")


_COUNTERS = """, r AS (SELECT slot, max(seq) AS reset, max_by(event_type, seq) AS kind, max_by(amount, seq) AS amount FROM log WHERE event_type IN ('signup', 'error') GROUP BY slot),
c AS (SELECT log.slot, count(*) AS n FROM log LEFT JOIN r USING (slot) WHERE event_type = 'click' AND (reset IS NULL OR seq > reset) GROUP BY log.slot)
SELECT 'k:' || coalesce(r.slot, c.slot) AS key, CAST(CASE WHEN kind = 'signup' THEN amount ELSE 0 END + coalesce(n, 0) AS BIGINT) AS value FROM r FULL JOIN c USING (slot) WHERE n IS NOT NULL OR kind = 'signup'"""


@query(with_("log", body=_COUNTERS))
def log_fold_counters(t: Tables) -> DataFrame:
    return fold.counters(t.log).select("key", "value")


@query(with_("log", body="SELECT 'h:' || slot AS key, 'n' AS field, CAST(sum(amount) AS BIGINT) AS value FROM log WHERE event_type = 'purchase' GROUP BY slot"))
def log_fold_hash_counters(t: Tables) -> DataFrame:
    return fold.hash_counters(t.log).select("key", "field", "value")


@query(with_("log", body=_COUNTERS))
def log_replay_counters(t: Tables) -> DataFrame:
    """The last reply of every counter gives what the aggregations give."""
    last = fold.replies(t.log).groupBy("key").agg(F.max_by(F.struct("name", "reply"), "seq").alias("r"))
    return last.where("r.name != 'DEL'").select("key", F.col("r.reply").alias("value"))


@query(with_("log", body="SELECT seq, event_type FROM log WHERE seq > 9000"))
def log_replay_offset(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("event_id").alias("seq"), "event_type")
    return fold.since(rows, 9000)


# ---------------------------------------------------------------- transactions


def _txn_log(t: Tables) -> DataFrame:
    """Blocks of ten events per connection: WATCH, a write, MULTI, three writes, EXEC (or DISCARD in every fourth block), two reads, a write.

    The writes outside MULTI are SET, SETEX, DEL of two keys, RENAME or, for the most part, reads.
    """
    rows = t.table("events").select((F.col("event_id") % 20).alias("conn"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.lit(0).alias("db"), F.floor(F.col("event_id") / 20).alias("i"))
    step, block = F.col("i") % 10, F.floor(F.col("i") / 10)
    own = F.concat(F.lit("k:"), (F.col("conn") * 3 + block * 7) % 40)
    other = F.concat(F.lit("k:"), (F.col("conn") + F.col("i") * 11) % 40)
    third = F.concat(F.lit("k:"), (F.col("conn") + F.col("i") * 5) % 40)
    kind = F.col("seq") % 12
    argv = (
        F.when(step == 0, F.array(F.lit("WATCH"), own))
        .when(step == 2, F.array(F.lit("MULTI")))
        .when(step.isin(3, 4, 5), F.array(F.lit("INCR"), other))
        .when(step == 6, F.array(F.when(block % 4 == 3, "DISCARD").otherwise("EXEC")))
        .when(step.isin(1, 9) & (kind == 0), F.array(F.lit("SET"), other, F.lit("1")))
        .when(step.isin(1, 9) & (kind == 3), F.array(F.lit("SETEX"), other, F.lit("10"), F.lit("1")))
        .when(step.isin(1, 9) & (kind == 6), F.array(F.lit("DEL"), third, other))
        .when(step.isin(1, 9) & (kind == 9), F.array(F.lit("RENAME"), third, other))
        .when(step.isin(1, 9), F.array(F.lit("GET"), other))
        .otherwise(F.array(F.lit("GET"), own))
    )
    return rows.select("seq", "ts", "conn", "db", argv.alias("argv"))


_TXN = """WITH e AS (SELECT event_id % 20 AS conn, event_id AS seq, event_id // 20 AS i FROM events),
l AS (
  SELECT conn, seq, i % 10 AS step, i // 10 AS block, 'k:' || ((conn * 3 + (i // 10) * 7) % 40) AS own, 'k:' || ((conn + i * 11) % 40) AS other, 'k:' || ((conn + i * 5) % 40) AS third FROM e
), w AS (SELECT *, step IN (1, 9) AND seq % 3 = 0 AS sets FROM l)"""


@query(_TXN + " SELECT conn, seq, CASE WHEN step BETWEEN 2 AND 6 THEN block + 1 END AS txn, CASE WHEN step = 2 THEN 'multi' WHEN step BETWEEN 3 AND 5 THEN 'queued' WHEN step = 6 THEN CASE WHEN block % 4 = 3 THEN 'discard' ELSE 'exec' END ELSE 'none' END AS role FROM w")
def txn_sessionize(t: Tables) -> DataFrame:
    return transactions.sessions(_txn_log(t)).select("conn", "seq", "txn", "role")


_WATCH = ", x AS (SELECT a.conn, a.block + 1 AS txn, a.own AS key, a.seq AS watch_seq, b.seq AS exec_seq FROM w a JOIN w b ON a.conn = b.conn AND a.block = b.block AND a.step = 0 AND b.step = 6 AND b.block % 4 <> 3)"


@query(_TXN + _WATCH + " SELECT * FROM x")
def txn_watched(t: Tables) -> DataFrame:
    return transactions.watched(_txn_log(t)).select("conn", "txn", "key", "watch_seq", "exec_seq")


_ROUNDS = 12
_ABORT = _WATCH + ", a0 AS (SELECT conn, txn FROM x WHERE false)" + "".join(
    f""", a{r + 1} AS (
  SELECT DISTINCT x.conn, x.txn FROM x JOIN (
    SELECT other AS key, seq AS eff FROM w WHERE sets UNION ALL SELECT third, seq FROM w WHERE sets AND seq % 12 IN (6, 9)
    UNION ALL SELECT a.other, b.seq FROM w a JOIN w b ON a.conn = b.conn AND a.block = b.block AND a.step IN (3, 4, 5) AND b.step = 6 AND b.block % 4 <> 3
      WHERE (a.conn, a.block + 1) NOT IN (SELECT (conn, txn) FROM a{r})
  ) wr ON wr.key = x.key AND eff > watch_seq AND eff < exec_seq)"""
    for r in range(_ROUNDS)
) + f", o AS (SELECT x.*, (conn, txn) IN (SELECT (conn, txn) FROM a{_ROUNDS}) AS aborted FROM x)"


@query(_TXN + _ABORT + " SELECT conn, txn, exec_seq, CAST(3 AS BIGINT) AS queued, aborted FROM o")
def txn_watch_abort(t: Tables) -> DataFrame:
    return transactions.outcomes(_txn_log(t)).select("conn", "txn", "exec_seq", "queued", "aborted")


@query(_TXN + _ABORT + " SELECT w.conn, w.seq, w.other AS key, o.exec_seq AS effect_seq FROM w JOIN o ON w.conn = o.conn AND w.block + 1 = o.txn AND step IN (3, 4, 5) AND NOT aborted")
def txn_exec_results(t: Tables) -> DataFrame:
    return transactions.effective(_txn_log(t)).where("role = 'queued'").select("conn", "seq", "key", F.col("at").alias("effect_seq"))


# ---------------------------------------------------------------- figures


@query(with_("log", body="SELECT count(*) AS commands, count(DISTINCT conn) AS connections, count(*) FILTER (event_type <> 'view') AS writes, count(DISTINCT event_type) AS names FROM log"))
def info_stats(t: Tables) -> DataFrame:
    return admin.stats(t.log)


@query(with_("log", body="SELECT CASE event_type WHEN 'click' THEN 'INCR' WHEN 'view' THEN 'GET' WHEN 'purchase' THEN 'HINCRBY' WHEN 'signup' THEN 'SET' ELSE 'DEL' END AS name, count(*) AS calls FROM log GROUP BY 1"))
def info_commandstats(t: Tables) -> DataFrame:
    return admin.command_stats(t.log)


@query(with_("hsh", "st", body="SELECT 'hash' AS type, count(DISTINCT key) AS keys, CAST(sum(strlen(field) + 24 + strlen(value) + 24) AS BIGINT) AS bytes FROM hsh UNION ALL SELECT 'set', count(DISTINCT key), CAST(sum(strlen(member) + 24) AS BIGINT) FROM st"))
def info_memory(t: Tables) -> DataFrame:
    return admin.memory_by_type({"hash": (t.hashes, ["field", "value"]), "set": (t.sets, ["member"])})


@query(with_("ks", body="SELECT db, count(*) AS keys, count(expires_at) AS expires FROM ks GROUP BY db"))
def info_keyspace(t: Tables) -> DataFrame:
    return admin.keyspace(t.keys)


@query("SELECT count(*) FILTER (WHERE value >= 50) AS hits, count(*) FILTER (WHERE value < 50) AS misses, avg(CAST(value >= 50 AS INT)) AS rate FROM events WHERE event_type = 'view'")
def info_hit_rate(t: Tables) -> DataFrame:
    return admin.hit_rate(t.table("events").where("event_type = 'view'").select((F.col("value") >= 50).alias("hit")))


@query("SELECT event_id AS id, CAST(round(value * 100) AS BIGINT) AS duration_us, user_id AS client, event_type || ' k:' || (event_id % 50) AS said FROM events WHERE CAST(round(value * 100) AS BIGINT) >= 10000 ORDER BY event_id DESC LIMIT 128")
def slowlog_top(t: Tables) -> DataFrame:
    rows = t.table("events").select(F.col("event_id").alias("id"), "ts", F.round(F.col("value") * 100).cast("long").alias("duration_us"), F.array("event_type", F.concat(F.lit("k:"), F.col("event_id") % 50)).alias("argv"), F.col("user_id").alias("client"))
    return admin.slowlog(rows).select("id", "duration_us", "client", F.array_join("argv", " ").alias("said"))


_USE = "SELECT key, CAST(sum(strlen(field) + 24 + strlen(value) + 24) AS BIGINT) AS bytes FROM hsh GROUP BY key"


@query(with_("hsh", body=_USE))
def memory_usage(t: Tables) -> DataFrame:
    return admin.memory_usage(t.hashes, "field", "value").select("key", "bytes")


@query(with_("hsh", body=f"SELECT * FROM ({_USE}) ORDER BY bytes DESC, key LIMIT 10"))
def memory_doctor_top10(t: Tables) -> DataFrame:
    return admin.largest(admin.memory_usage(t.hashes, "field", "value")).select("key", "bytes")


@query(with_("hsh", body=f"SELECT count(*) AS keys, CAST(sum(bytes) AS BIGINT) AS bytes, max(bytes) AS most FROM ({_USE})"))
def memory_stats(t: Tables) -> DataFrame:
    return admin.memory_stats(admin.memory_usage(t.hashes, "field", "value")).select("keys", "bytes", "most")


@query(
    """WITH s AS (SELECT epoch_us(ts) // 1000000 AS second, count(*) AS changes FROM events WHERE event_type <> 'view' GROUP BY 1),
o AS (SELECT second, sum(changes) OVER (ORDER BY second RANGE BETWEEN 899 PRECEDING AND CURRENT ROW) AS a, sum(changes) OVER (ORDER BY second RANGE BETWEEN 299 PRECEDING AND CURRENT ROW) AS b FROM s)
SELECT second, CAST(a AS BIGINT) AS changes, '900/7' AS rule FROM o WHERE a >= 7 UNION ALL SELECT second, CAST(b AS BIGINT), '300/4' FROM o WHERE b >= 4"""
)
def bgsave_rules(t: Tables) -> DataFrame:
    return admin.save_points(t.events.where("event_type != 'view'").select("ts"), [(900, 7), (300, 4)])


@query("SELECT CAST(1704067200 + 5 AS BIGINT) AS seconds, CAST(250000 AS BIGINT) AS micros, 'PONG' AS ping, 'said' AS echo")
def admin_time_ping_echo(t: Tables) -> DataFrame:
    now = F.lit("2024-01-01 00:00:05.25").cast("timestamp")
    return t.spark.range(1).select(F.unix_seconds(now).alias("seconds"), (F.unix_micros(now) % 1_000_000).alias("micros"), F.lit("PONG").alias("ping"), F.lit("said").alias("echo"))


@query(with_("log", body="SELECT conn, count(*) AS commands, max(seq) AS last_seq FROM log GROUP BY conn"))
def client_list(t: Tables) -> DataFrame:
    """A session table from the log, in place of live connections."""
    return t.log.groupBy("conn").agg(F.count("*").alias("commands"), F.max("seq").alias("last_seq"))


# ---------------------------------------------------------------- procedures


@query(with_("lst", body="SELECT key, value = 'click' AS deleted FROM (SELECT key, arg_max(value, pos) AS value FROM lst GROUP BY key)"))
def proc_compare_and_delete(t: Tables) -> DataFrame:
    current = t.lists.groupBy("db", "key").agg(F.max_by("value", "pos").alias("value"))
    asked = current.select("db", "key", F.lit("click").alias("expected"))
    return procedures.call(t.spark, "compare_and_delete", strings=current, asked=asked).select("key", "deleted")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 86400000000 ORDER BY event_id) <= 2 AS allowed FROM events")
def proc_rate_limit(t: Tables) -> DataFrame:
    calls = t.events.select(F.col("user_id").alias("client"), F.col("event_id").alias("call"), F.col("ms"))
    return procedures.call(t.spark, "rate_limit", calls=calls, window_ms=86_400_000, most=2).select(F.col("client").alias("user_id"), F.col("call").alias("event_id"), "allowed")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 3600000000 ORDER BY event_id) <= 1 AS allowed FROM events")
def proc_by_sha(t: Tables) -> DataFrame:
    """EVALSHA: the procedure by the SHA-1 of its source."""
    calls = t.events.select(F.col("user_id").alias("client"), F.col("event_id").alias("call"), F.col("ms"))
    found = procedures.call(t.spark, procedures.sha_of("rate_limit"), calls=calls, window_ms=3_600_000, most=1)
    return found.select(F.col("client").alias("user_id"), F.col("call").alias("event_id"), "allowed")


@query("SELECT * FROM (VALUES (1, 'loaded', true), (2, 'never loaded', false), (3, 'flushed', false), (4, 'by name', true)) AS t(step, asked, known)")
def proc_script(t: Tables) -> DataFrame:
    """SCRIPT LOAD, EXISTS and FLUSH on a registry of its own."""
    own = procedures.Registry()
    own.load(procedures.rate_limit)
    sha = own.sha_of("rate_limit")
    steps = [(1, "loaded", own.known(sha)[0]), (2, "never loaded", own.known("0" * 40)[0])]
    own.flush()
    steps += [(3, "flushed", own.known(sha)[0]), (4, "by name", own.has("rate_limit"))]
    return t.literal(steps, "step int, asked string, known boolean")
