"""Queries over the keyspace, streams and consumer groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfold.functions import ids
from keyfold.operators import keyspace, streams
from keyfold.plans.fixtures import NOW, Tables, db, with_
from keyfold.plans.registry import query

_LIVE = f"live AS (SELECT * FROM ks WHERE expires_at IS NULL OR expires_at > TIMESTAMP '{NOW}')"
_ASK = "ask AS (SELECT CAST(o_orderkey % 16 AS INT) AS db, unnest(['o:' || o_orderkey, 'none:' || o_orderkey]) AS key FROM orders WHERE o_orderkey % 3 = 0)"


def _asked(t: Tables) -> DataFrame:
    return t.table("orders").where("o_orderkey % 3 = 0").select((F.col("o_orderkey") % 16).cast("int").alias("db"), F.explode(F.array(F.concat(F.lit("o:"), "o_orderkey"), F.concat(F.lit("none:"), "o_orderkey"))).alias("key"))


@query(with_("ks", body=f", {_LIVE}, r AS (SELECT o_custkey AS request, CAST(o_orderkey % 16 AS INT) AS db, unnest(['o:' || o_orderkey, 'o:' || o_orderkey, 'x']) AS key FROM orders) SELECT request, count(live.key) AS n FROM r LEFT JOIN live USING (db, key) GROUP BY request"))
def key_exists(t: Tables) -> DataFrame:
    name = F.concat(F.lit("o:"), "o_orderkey")
    asked = t.table("orders").select(F.col("o_custkey").alias("request"), (F.col("o_orderkey") % 16).cast("int").alias("db"), F.explode(F.array(name, name, F.lit("x"))).alias("key"))
    return keyspace.exists(t.keys, asked, t.now)


@query(with_("ks", body=f", {_LIVE}, {_ASK} SELECT db, key, coalesce(type, 'none') AS type FROM ask LEFT JOIN live USING (db, key)"))
def key_type(t: Tables) -> DataFrame:
    return keyspace.type_of(t.keys, _asked(t), t.now)


_TTL = "SELECT db, key, CAST(CASE WHEN type IS NULL THEN -2 WHEN expires_at IS NULL THEN -1 ELSE ceil((epoch_us(expires_at) - epoch_us(TIMESTAMP '%s')) / %d) END AS BIGINT) AS ttl FROM ask LEFT JOIN live USING (db, key)"


@query(with_("ks", body=f", {_LIVE}, {_ASK} " + _TTL % (NOW, 1_000_000)))
def key_ttl(t: Tables) -> DataFrame:
    return keyspace.ttl(t.keys, _asked(t), t.now)


@query(with_("ks", body=f", {_LIVE}, {_ASK} " + _TTL % (NOW, 1000)))
def key_pttl(t: Tables) -> DataFrame:
    return keyspace.ttl(t.keys, _asked(t), t.now, unit_us=1000)


@query(with_("ks", body=f", {_LIVE}, l AS (SELECT CAST(o_orderkey % 16 AS INT) AS db, 'o:' || o_orderkey AS key, (o_orderkey % 9 - 2) * 1000 AS ms FROM orders WHERE o_orderkey % 4 = 0) SELECT db, key, epoch_us(CASE WHEN ms IS NULL THEN expires_at ELSE TIMESTAMP '{NOW}' + to_milliseconds(ms) END) AS until FROM live LEFT JOIN l USING (db, key) WHERE ms IS NULL OR ms > 0"))
def key_expire(t: Tables) -> DataFrame:
    limits = t.table("orders").where("o_orderkey % 4 = 0").select((F.col("o_orderkey") % 16).cast("int").alias("db"), F.concat(F.lit("o:"), "o_orderkey").alias("key"), ((F.col("o_orderkey") % 9 - 2) * 1000).alias("ms"))
    return keyspace.expire(t.keys, limits, t.now).select("db", "key", F.unix_micros("expires_at").alias("until"))


@query(with_("ks", body=f", {_LIVE}, {_ASK} SELECT db, key, CAST(expires_at IS NOT NULL AS INT) AS done FROM ask LEFT JOIN live USING (db, key)"))
def key_persist(t: Tables) -> DataFrame:
    return keyspace.persist(t.keys, _asked(t), t.now)


@query(with_("ks", body=f", {_LIVE} SELECT db, key, type FROM live"))
def key_live_filter(t: Tables) -> DataFrame:
    return keyspace.alive(t.keys, t.now).select("db", "key", "type")


@query(with_("ks", body=f", {_ASK} SELECT db, key, type FROM ks WHERE (db, key) NOT IN (SELECT (db, key) FROM ask)"))
def key_del(t: Tables) -> DataFrame:
    return keyspace.delete(t.keys, _asked(t)).select("db", "key", "type")


_MOVES = "mv AS (SELECT CAST(o_orderkey % 16 AS INT) AS db, 'o:' || o_orderkey AS key, 'o:' || (o_orderkey + 16) AS new_key FROM orders WHERE o_orderkey % 160 < 16)"


def _moves(t: Tables) -> DataFrame:
    rows = t.table("orders").where("o_orderkey % 160 < 16")
    return rows.select((F.col("o_orderkey") % 16).cast("int").alias("db"), F.concat(F.lit("o:"), "o_orderkey").alias("key"), F.concat(F.lit("o:"), (F.col("o_orderkey") + 16).cast("string")).alias("new_key"))


@query(with_("ks", body=f", {_MOVES} SELECT ks.db, coalesce(new_key, ks.key) AS key, type FROM ks LEFT JOIN mv USING (db, key) WHERE (ks.db, ks.key) NOT IN (SELECT (db, new_key) FROM mv)"))
def key_rename(t: Tables) -> DataFrame:
    return keyspace.rename(t.keys, _moves(t)).select("db", "key", "type")


@query(with_("ks", body=f", {_LIVE}, {_MOVES} SELECT mv.db, mv.key, new_key, CASE WHEN a.key IS NOT NULL THEN CAST(b.key IS NULL AS INT) END AS done FROM mv LEFT JOIN live a USING (db, key) LEFT JOIN live b ON b.db = mv.db AND b.key = new_key"))
def key_renamenx(t: Tables) -> DataFrame:
    return keyspace.rename_if_absent(t.keys, _moves(t), t.now)


@query(with_("ks", body=f", {_LIVE} SELECT db, key FROM live WHERE starts_with(key, 'o:12') UNION ALL SELECT 99, key FROM live WHERE regexp_full_match(key, 'o:.*7.', 's')"))
def key_glob(t: Tables) -> DataFrame:
    return keyspace.matching(t.keys, "o:12*", t.now).unionByName(keyspace.matching(t.keys, "o:*7?", t.now).withColumn("db", F.lit(99)))


@query(with_("ks", body=f", {_LIVE} SELECT db, key FROM live WHERE regexp_full_match(key, 'o:[1-3][^0-4].*', 's')"))
def key_glob_class(t: Tables) -> DataFrame:
    return keyspace.matching(t.keys, "o:[1-3][^0-4]*", t.now)


@query(with_("ks", body=f", {_LIVE} SELECT db, key FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY db ORDER BY key) AS n FROM live WHERE key > 'o:2') WHERE n <= 50) WHERE contains(key, '7')"))
def scan_page(t: Tables) -> DataFrame:
    return keyspace.page(keyspace.alive(t.keys, t.now), ["db"], "key", "o:2", 50, "*7*").select("db", "key")


@query(with_("hsh", body="SELECT key, field, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY field) AS n FROM hsh WHERE field > 'cust') WHERE n <= 1"))
def hscan_page(t: Tables) -> DataFrame:
    return keyspace.page(t.hashes, ["db", "key"], "field", "cust", 1).select("key", "field", "value")


@query(with_("st", body="SELECT key, member FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY member) AS n FROM st WHERE member > '15') WHERE n <= 30 AND member LIKE '1%'"))
def sscan_page(t: Tables) -> DataFrame:
    return keyspace.page(t.sets, ["db", "key"], "member", "15", 30, "1*").select("key", "member")


@query(with_("z1", body="SELECT key, member, score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY member) AS n FROM z1) WHERE n <= 4"))
def zscan_page(t: Tables) -> DataFrame:
    return keyspace.page(t.prices, ["db", "key"], "member", None, 4).select("key", "member", "score")


@query(with_("ks", body=f", {_LIVE} SELECT db, count(*) AS n FROM live GROUP BY db"))
def key_dbsize(t: Tables) -> DataFrame:
    return keyspace.size(t.keys, t.now)


@query(with_("ks", body="SELECT db, count(*) AS n FROM ks WHERE db <> 3 GROUP BY db"))
def key_flushdb(t: Tables) -> DataFrame:
    return keyspace.flush(t.keys, 3).groupBy("db").agg(F.count("*").alias("n"))


@query(with_("ks", body="SELECT 'before' AS time, db, count(*) AS n FROM ks GROUP BY db UNION ALL SELECT 'after', 99, 0"))
def key_flushall(t: Tables) -> DataFrame:
    """Numbers of keys before and after; 99 stands for all databases."""
    before = t.keys.groupBy("db").agg(F.count("*").alias("n")).select(F.lit("before").alias("time"), "db", "n")
    after = keyspace.flush(t.keys).agg(F.count("*").alias("n")).select(F.lit("after").alias("time"), F.lit(99).alias("db"), "n")
    return before.unionByName(after)


@query(with_("ks", body="SELECT key, type FROM ks WHERE db = 5"))
def key_select(t: Tables) -> DataFrame:
    return t.keys.where("db = 5").select("key", "type")


@query()
def key_random(t: Tables) -> DataFrame:
    return keyspace.random_key(t.keys, t.now, seed=11)


@query(with_("ks", body=f", {_LIVE}, {_ASK} SELECT db, key, 'WRONGTYPE' AS error FROM ask JOIN live USING (db, key) WHERE type <> 'zset'"))
def key_wrong_type(t: Tables) -> DataFrame:
    return keyspace.wrong_type(t.keys, _asked(t), "zset", t.now)


# ---------------------------------------------------------------- streams

_HOUR = "SELECT event_type AS key, epoch_us(ts) // 3600000000 * 3600000 AS ms, event_id, user_id FROM events"


def _plain(stream: DataFrame) -> DataFrame:
    return stream.select("key", "ms", "seq", F.col("fields")["user_id"].alias("user_id"))


@query(f"SELECT key, ms, row_number() OVER (PARTITION BY key, ms ORDER BY event_id) - 1 AS seq, user_id FROM ({_HOUR})")
def stream_add_ids(t: Tables) -> DataFrame:
    hours = t.events.select(db(), F.col("event_type").alias("key"), (F.floor(F.col("ms") / 3_600_000) * 3_600_000).alias("ms"), F.col("event_id").alias("arrival"), "user_id")
    return streams.add_auto(hours).select("key", "ms", "seq", "user_id")


@query("SELECT key, arrival, ms, seq, coalesce(ms * 1000 + seq > max(ms * 1000 + seq) OVER (PARTITION BY key ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ms * 1000 + seq > 0) AS accepted FROM (SELECT event_type AS key, event_id AS arrival, event_id * 37 % 1009 AS ms, event_id % 7 AS seq FROM events)")
def stream_monotonic_reject(t: Tables) -> DataFrame:
    rows = t.table("events").select(db(), F.col("event_type").alias("key"), F.col("event_id").alias("arrival"), (F.col("event_id") * 37 % 1009).alias("ms"), (F.col("event_id") % 7).alias("seq"))
    return streams.accepted(rows).select("key", "arrival", "ms", "seq", "accepted")


@query(with_("stm", body="SELECT key, count(*) AS n FROM stm GROUP BY key"))
def stream_len(t: Tables) -> DataFrame:
    return streams.length(t.stream).select("key", "n")


_FROM, _TO = 1_704_500_000_000, 1_705_500_000_000
_STM = "SELECT key, CAST(ms AS BIGINT) AS ms, seq, CAST(user_id AS VARCHAR) AS user_id FROM "


@query(with_("stm", body=f"{_STM} (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, seq) AS n FROM stm WHERE ms >= {_FROM} AND (ms < {_TO} OR ms = {_TO} AND seq <= 5)) WHERE n <= 100"))
def stream_range(t: Tables) -> DataFrame:
    return _plain(streams.range_of(t.stream, f"{_FROM}-0", f"{_TO}-5", 100))


@query(with_("stm", body=f"{_STM} (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms DESC, seq DESC) AS n FROM stm WHERE ms <= {_TO}) WHERE n <= 25"))
def stream_revrange(t: Tables) -> DataFrame:
    return _plain(streams.range_of(t.stream, "-", f"{_TO}-{ids.MOST}", 25, descending=True))


@query(with_("stm", body=f"{_STM} (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, seq) AS n FROM stm WHERE key <> 'error' AND ms > {_FROM} + length(key) * 1000000) WHERE n <= 40"))
def stream_read_offsets(t: Tables) -> DataFrame:
    offsets = t.table("events").where("event_type != 'error'").select(db(), F.col("event_type").alias("key")).distinct()
    offsets = offsets.select("db", "key", (F.lit(_FROM) + F.length("key") * 1_000_000).alias("after_ms"), F.lit(ids.MOST).alias("after_seq"))
    return _plain(streams.read(t.stream, offsets, 40))


@query(with_("stm", body=f"{_STM} (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms DESC, seq DESC) AS n FROM stm) WHERE n <= 100"))
def stream_trim_maxlen(t: Tables) -> DataFrame:
    return _plain(streams.trim_to_length(t.stream, 100))


@query(with_("stm", body=f"{_STM} stm WHERE ms >= {_TO}"))
def stream_trim_minid(t: Tables) -> DataFrame:
    return _plain(streams.trim_to_id(t.stream, f"{_TO}-0"))


@query(with_("stm", body=f"{_STM} stm WHERE user_id % 2 = 1"))
def stream_del(t: Tables) -> DataFrame:
    return _plain(streams.delete(t.stream, t.stream.where("fields['user_id'] % 2 = 0")))


@query(with_("stm", body="SELECT key, count(*) AS n, min_by(ms || '-' || seq, (ms, seq)) AS first_id, max_by(ms || '-' || seq, (ms, seq)) AS last_id FROM stm GROUP BY key"))
def stream_info(t: Tables) -> DataFrame:
    return streams.info(t.stream).select("key", "n", "first_id", "last_id")


# ---------------------------------------------------------------- groups

_PEL = "pel AS (SELECT key, ms, seq, 'w' || (user_id % 4) AS consumer, event_id FROM stm WHERE event_id % 3 <> 0)"
_EVENT_NOW = "(SELECT max(epoch_us(ts) // 1000) + 3600000 FROM events)"
_IDLE = f"{_EVENT_NOW} - ms"


def _wanted(t: Tables) -> DataFrame:
    names = t.table("events").select(db(), F.col("event_type").alias("key")).distinct()
    return names.select("db", "key", F.explode(F.array(F.struct(F.lit("g0").alias("grp"), F.lit(f"{_FROM}-0").alias("start")), F.struct(F.lit("g1").alias("grp"), F.lit("$").alias("start")))).alias("g")).select("db", "key", "g.*")


@query(with_("stm", body=f"SELECT key, 'g0' AS grp, CAST({_FROM} AS BIGINT) AS last_ms, CAST(0 AS BIGINT) AS last_seq FROM stm GROUP BY key UNION ALL SELECT key, 'g1', max(ms), max_by(seq, ms) FROM stm GROUP BY key"))
def group_create(t: Tables) -> DataFrame:
    return streams.create_groups(t.stream, _wanted(t)).select("key", "grp", "last_ms", "last_seq")


@query(with_("stm", body=f"SELECT key, CAST(ms AS BIGINT) AS ms, seq, (n - 1) // 30 AS request, 'w' || ((n - 1) // 30 % 3) AS consumer FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, seq) AS n FROM stm WHERE ms > {_FROM} OR ms = {_FROM} AND seq > 0) WHERE n <= 300"))
def group_deliver(t: Tables) -> DataFrame:
    groups = streams.create_groups(t.stream, _wanted(t).where("grp = 'g0'"))
    asks = F.explode(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.struct(i.cast("long").alias("request"), F.concat(F.lit("w"), (i % 3).cast("string")).alias("consumer"), F.lit(30).alias("count"))))
    requests = groups.select("db", "key", "grp", asks.alias("r")).select("db", "key", "grp", "r.*")
    return streams.deliver(t.stream, groups, requests, t.now).select("key", "ms", "seq", "request", "consumer")


@query(with_("stm", body=f", {_PEL} SELECT key, CAST(ms AS BIGINT) AS ms, seq, consumer FROM pel WHERE event_id % 5 <> 0"))
def group_ack(t: Tables) -> DataFrame:
    acks = t.pending.join(t.stream.where("fields['event_id'] % 5 = 0").select("db", "key", "ms", "seq"), ["db", "key", "ms", "seq"], "left_semi")
    return streams.acknowledge(t.pending, acks).select("key", "ms", "seq", "consumer")


@query(with_("stm", body=f", {_PEL} SELECT key, consumer, count(*) AS n, min_by(ms || '-' || seq, (ms, seq)) AS first_id, max_by(ms || '-' || seq, (ms, seq)) AS last_id FROM pel GROUP BY key, consumer"))
def group_pending_summary(t: Tables) -> DataFrame:
    return streams.pending_summary(t.pending).select("key", "consumer", "n", "first_id", "last_id")


@query(with_("stm", body=f", {_PEL} SELECT key, CAST(ms AS BIGINT) AS ms, seq, consumer, {_IDLE} AS idle FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, seq) AS n FROM pel WHERE consumer = 'w1' AND ms >= {_FROM}) WHERE n <= 50"))
def group_pending_detail(t: Tables) -> DataFrame:
    return streams.pending_detail(t.pending, _ms(t.event_now), f"{_FROM}-0", "+", 50, "w1").select("key", "ms", "seq", "consumer", "idle")


def _ms(now: Column) -> Column:
    return F.timestamp_millis(F.unix_millis(now))


_MIN_IDLE = 10 * 86_400_000


@query(with_("stm", body=f", {_PEL} SELECT key, CAST(ms AS BIGINT) AS ms, seq, CASE WHEN moved THEN 'w9' ELSE consumer END AS consumer, 1 + CAST(moved AS BIGINT) AS delivery_count FROM (SELECT *, seq % 2 = 0 AND consumer <> 'w2' AND {_IDLE} >= {_MIN_IDLE} AS moved FROM pel)"))
def group_claim_idle(t: Tables) -> DataFrame:
    wanted = t.pending.where("seq % 2 = 0 and consumer != 'w2'")
    return streams.claim(t.pending, wanted, "w9", _MIN_IDLE, _ms(t.event_now)).select("key", "ms", "seq", "consumer", "delivery_count")


@query(with_("stm", body=f", {_PEL} SELECT key, CAST(ms AS BIGINT) AS ms, seq, 'w9' AS consumer, consumer AS previous, CAST(2 AS BIGINT) AS delivery_count FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, seq) AS n FROM pel WHERE ms >= {_FROM} AND {_IDLE} >= {_MIN_IDLE}) WHERE n <= 100"))
def group_autoclaim(t: Tables) -> DataFrame:
    return streams.autoclaim(t.pending, "w9", _MIN_IDLE, f"{_FROM}-0", _ms(t.event_now)).select("key", "ms", "seq", "consumer", "previous", "delivery_count")


def _consumers(t: Tables) -> DataFrame:
    rows = t.events.groupBy(F.col("event_type").alias("key"), F.concat(F.lit("w"), F.col("user_id") % 5).alias("consumer"))
    return rows.agg(F.max("ts").alias("last_seen")).select(db(), "key", F.lit("g1").alias("grp"), "consumer", "last_seen")


@query(with_("stm", body=f", {_PEL} SELECT s.key, 'g1' AS grp, CAST(5 AS BIGINT) AS consumers, pending, last_id FROM (SELECT key, max_by(ms || '-' || seq, (ms, seq)) AS last_id FROM stm GROUP BY key) s JOIN (SELECT key, count(*) AS pending FROM pel GROUP BY key) USING (key)"))
def group_info(t: Tables) -> DataFrame:
    groups = streams.create_groups(t.stream, _wanted(t).where("grp = 'g1'"))
    return streams.group_info(groups, t.pending, _consumers(t)).select("key", "grp", "consumers", "pending", "last_id")


@query(with_("stm", body=f", {_PEL} SELECT c.key, c.consumer, coalesce(pending, 0) AS pending, {_EVENT_NOW} - seen AS idle FROM (SELECT event_type AS key, 'w' || (user_id % 5) AS consumer, max(epoch_us(ts) // 1000) AS seen FROM events GROUP BY 1, 2) c LEFT JOIN (SELECT key, consumer, count(*) AS pending FROM pel GROUP BY 1, 2) USING (key, consumer)"))
def group_consumers_info(t: Tables) -> DataFrame:
    return streams.consumer_info(_consumers(t), t.pending, _ms(t.event_now)).select("key", "consumer", "pending", "idle")


_SETID = f"SELECT key, 'g0' AS grp, CAST({_FROM} AS BIGINT) AS last_ms, CAST(0 AS BIGINT) AS last_seq FROM stm GROUP BY key UNION ALL SELECT key, 'g1', CASE WHEN key < 'm' THEN 5 ELSE max(ms) END, CASE WHEN key < 'm' THEN 3 ELSE max_by(seq, ms) END FROM stm GROUP BY key"


@query(with_("stm", body=_SETID))
def group_setid(t: Tables) -> DataFrame:
    """The cursors of some groups are set to an id; a group that doesn't exist is not made."""
    groups = streams.create_groups(t.stream, _wanted(t))
    wanted = _wanted(t).where("grp = 'g1' and key < 'm'").select("db", "key", F.explode(F.array(F.lit("g1"), F.lit("none"))).alias("grp"), F.lit("5-3").alias("start"))
    return streams.set_ids(groups, t.stream, wanted).select("key", "grp", "last_ms", "last_seq")


@query(with_("stm", body=f", {_PEL} SELECT key, count(*) AS pending FROM pel WHERE key >= 'm' GROUP BY key"))
def group_destroy(t: Tables) -> DataFrame:
    """What is pending once some groups are gone."""
    gone = _wanted(t).where("grp = 'g1' and key < 'm'")
    return streams.destroy_groups(t.pending, gone).groupBy("key").agg(F.count("*").alias("pending"))


@query("SELECT event_type AS key, unnest(['w1', 'w9']) AS consumer, unnest([CASE WHEN bool_or(user_id % 5 = 1) THEN 0 ELSE 1 END, 1]) AS created FROM events GROUP BY event_type")
def group_createconsumer(t: Tables) -> DataFrame:
    names = _consumers(t).select("db", "key", "grp").distinct()
    wanted = names.select("*", F.explode(F.array(F.lit("w1"), F.lit("w9"), F.lit("w9"))).alias("consumer"))
    return streams.create_consumers(_consumers(t), wanted, t.now)[1].select("key", "consumer", "created")


@query(with_("stm", body=f", {_PEL} SELECT key, count(*) AS dropped FROM pel WHERE consumer = 'w3' GROUP BY key"))
def group_delconsumer(t: Tables) -> DataFrame:
    return streams.delete_consumer(t.pending, "w3")[1].select("key", "dropped")


@query(with_("stm", body=f", {_PEL} SELECT key, CAST(ms AS BIGINT) AS ms, seq FROM pel WHERE consumer = 'w0' AND ms > {_TO}"))
def group_history(t: Tables) -> DataFrame:
    return streams.history(t.pending, "w0", f"{_TO}-{ids.MOST}").select("key", "ms", "seq")


@query(with_("stm", body=f"SELECT key, max(ms) AS last_ms FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, seq) AS n FROM stm WHERE ms > {_FROM}) WHERE n <= 300 GROUP BY key"))
def group_cursor_after_read(t: Tables) -> DataFrame:
    groups = streams.create_groups(t.stream, _wanted(t).where("grp = 'g0'"))
    requests = groups.select("db", "key", "grp", F.lit(1).cast("long").alias("request"), F.lit("w0").alias("consumer"), F.lit(300).alias("count"))
    return streams.cursors(groups, streams.deliver(t.stream, groups, requests, t.now)).select("key", "last_ms")
