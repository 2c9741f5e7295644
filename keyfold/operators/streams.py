"""Append-only streams: db, key, ms, seq, fields MAP; and their consumer groups.

grp: db, key, grp, last_ms, last_seq. pel: db, key, grp, ms, seq, consumer, delivered_at, delivery_count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyfold.functions import ids
from keyfold.operators.common import KEY

ENTRY = [*KEY, "ms", "seq"]
GROUP = [*KEY, "grp"]
PENDING = [*GROUP, "ms", "seq"]


def _by_id(descending: bool = False, keys: list[str] | None = None):
    order = [F.col("ms").desc(), F.col("seq").desc()] if descending else ["ms", "seq"]
    return Window.partitionBy(*(keys or KEY)).orderBy(*order)


def add_auto(entries: DataFrame) -> DataFrame:
    """XADD with `*`: entries (db, key, ms, arrival, fields) get seq by arrival within a millisecond."""
    return entries.withColumn("seq", ids.next_seq(KEY, "arrival"))


def accepted(entries: DataFrame) -> DataFrame:
    """XADD with given ids, in order of arrival: with `accepted`, true for ids above all before (0-0 never is)."""
    before = F.max(ids.stream_id()).over(Window.partitionBy(*KEY).orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1))
    own = ids.stream_id()
    # a rejected id is never the greatest so far, so the greatest of all before is the greatest accepted
    return entries.withColumn("accepted", (own > F.coalesce(before, ids.stream_id(F.lit(0), F.lit(0)))))


def length(stream: DataFrame) -> DataFrame:
    return stream.groupBy(*KEY).agg(F.count("*").alias("n"))


def range_of(stream: DataFrame, start: str, end: str, count: int | None = None, descending: bool = False) -> DataFrame:
    """XRANGE, XREVRANGE of every key; bounds on ms reach the scan besides."""
    lo, hi = ids.literal(start), ids.literal(end)
    rows = stream.where(F.col("ms").between(lo["ms"], hi["ms"]) & ids.stream_id().between(lo, hi))
    if count is None:
        return rows
    return rows.withColumn("nth", F.row_number().over(_by_id(descending))).where(F.col("nth") <= count).drop("nth")


def read(stream: DataFrame, offsets: DataFrame, count: int | None = None) -> DataFrame:
    """XREAD: entries after each key's offset. offsets: db, key, after_ms, after_seq."""
    rows = stream.join(offsets, KEY).where(ids.stream_id() > ids.stream_id(F.col("after_ms"), F.col("after_seq")))
    if count is not None:
        rows = rows.withColumn("nth", F.row_number().over(_by_id())).where(F.col("nth") <= count)
    return rows.select(*stream.columns)


def trim_to_length(stream: DataFrame, most: int) -> DataFrame:
    """XTRIM MAXLEN: the newest entries of each key."""
    return stream.withColumn("nth", F.row_number().over(_by_id(True))).where(F.col("nth") <= most).drop("nth")


def trim_to_id(stream: DataFrame, least: str) -> DataFrame:
    """XTRIM MINID."""
    return stream.where(ids.stream_id() >= ids.literal(least))


def delete(stream: DataFrame, gone: DataFrame) -> DataFrame:
    return stream.join(gone.select(*ENTRY), ENTRY, "left_anti")


def info(stream: DataFrame) -> DataFrame:
    """(db, key, n, first_id, last_id)."""
    own = ids.stream_id()
    text = lambda c: F.concat_ws("-", c["ms"], c["seq"])
    return stream.groupBy(*KEY).agg(F.count("*").alias("n"), text(F.min(own)).alias("first_id"), text(F.max(own)).alias("last_id"))


# ---------------------------------------------------------------- consumer groups


def create_groups(stream: DataFrame, wanted: DataFrame) -> DataFrame:
    """grp rows. wanted: db, key, grp, start (an id, or $ for the stream's end). The start id is honoured."""
    ends = stream.groupBy(*KEY).agg(F.max(ids.stream_id()).alias("end"))
    at = F.when(F.col("start") == "$", F.coalesce("end", ids.stream_id(F.lit(0), F.lit(0)))).otherwise(ids.parsed(F.col("start")))
    return wanted.join(ends, KEY, "left").select(*GROUP, at["ms"].alias("last_ms"), at["seq"].alias("last_seq"))


def deliver(stream: DataFrame, groups: DataFrame, requests: DataFrame, now: Column, span_ms: int = 3_600_000) -> DataFrame:
    """XREADGROUP with `>`: new pel rows, with request and fields.

    requests: db, key, grp, request, consumer, count. Requests of a group are served in
    order of request, each taking its count of the entries beyond the cursor. Entries are
    numbered within spans of `span_ms`, from the number of entries in the spans before, so
    that a long stream is not one task; each request becomes the numbers that it takes and
    that there are, and both meet by number: every entry meets one request at most.
    """
    fresh = stream.join(groups, KEY).where(ids.stream_id() > ids.stream_id(F.col("last_ms"), F.col("last_seq")))
    fresh = fresh.withColumn("span", F.floor(F.col("ms") / span_ms))
    spans = fresh.groupBy(*GROUP, "span").agg(F.count("*").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy(*GROUP).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select(*GROUP, "span", "n", earlier.alias("before"))
    inside = F.row_number().over(_by_id(keys=[*GROUP, "span"]))
    fresh = fresh.withColumn("at", inside).join(spans.drop("n"), [*GROUP, "span"]).withColumn("nth", F.col("before") + F.col("at")).drop("span", "at", "before")
    there = spans.groupBy(*GROUP).agg(F.sum("n").alias("there"))
    so_far = F.sum("count").over(Window.partitionBy(*GROUP).orderBy("request"))
    turns = requests.withColumn("to", so_far).withColumn("from", F.col("to") - F.col("count") + 1).join(there, GROUP).where(F.col("from") <= F.col("there")).where("count > 0")
    turns = turns.select(*GROUP, "request", "consumer", F.explode(F.sequence("from", F.least("to", "there"))).alias("nth"))
    served = fresh.join(turns, [*GROUP, "nth"])
    return served.select(*PENDING, "request", "consumer", now.alias("delivered_at"), F.lit(1).cast("long").alias("delivery_count"), "fields")


def cursors(groups: DataFrame, delivered: DataFrame) -> DataFrame:
    """grp rows after a delivery, acknowledged on the spot or not."""
    ends = delivered.groupBy(*GROUP).agg(F.max(ids.stream_id()).alias("end"))
    return groups.join(ends, GROUP, "left").select(*GROUP, F.coalesce("end.ms", "last_ms").alias("last_ms"), F.coalesce("end.seq", "last_seq").alias("last_seq"))


def history(pel: DataFrame, consumer: str, after: str) -> DataFrame:
    """XREADGROUP with an id: the consumer's own pending entries after it."""
    return pel.where((F.col("consumer") == consumer) & (ids.stream_id() > ids.literal(after)))


def acknowledge(pel: DataFrame, acks: DataFrame) -> DataFrame:
    return pel.join(acks.select(*PENDING), PENDING, "left_anti")


def pending_summary(pel: DataFrame) -> DataFrame:
    """(db, key, grp, consumer, n, first_id, last_id) of each consumer."""
    own = ids.stream_id()
    text = lambda c: F.concat_ws("-", c["ms"], c["seq"])
    return pel.groupBy(*GROUP, "consumer").agg(F.count("*").alias("n"), text(F.min(own)).alias("first_id"), text(F.max(own)).alias("last_id"))


def idle_ms(now: Column) -> Column:
    return F.unix_millis(now) - F.unix_millis("delivered_at")


def pending_detail(pel: DataFrame, now: Column, start: str, end: str, count: int, consumer: str | None = None) -> DataFrame:
    """(db, key, grp, ms, seq, consumer, idle, delivery_count): the first `count` of each group in the id range."""
    rows = pel if consumer is None else pel.where(F.col("consumer") == consumer)
    rows = rows.where(ids.stream_id().between(ids.literal(start), ids.literal(end)))
    rows = rows.withColumn("nth", F.row_number().over(_by_id(keys=GROUP))).where(F.col("nth") <= count)
    return rows.select(*PENDING, "consumer", idle_ms(now).alias("idle"), "delivery_count")


def claim(pel: DataFrame, wanted: DataFrame, consumer: str, min_idle: int, now: Column, force: bool = False) -> DataFrame:
    """All pel rows after XCLAIM: rows of wanted that are idle long enough go to the consumer. Missing rows are not made."""
    asked = wanted.select(*PENDING, F.lit(True).alias("asked")).distinct()
    rows = pel.join(asked, PENDING, "left")
    moves = F.col("asked").isNotNull() & (F.lit(force) | (idle_ms(now) >= min_idle))
    return rows.select(
        *PENDING,
        F.when(moves, F.lit(consumer)).otherwise(F.col("consumer")).alias("consumer"),
        F.when(moves, now).otherwise(F.col("delivered_at")).alias("delivered_at"),
        (F.col("delivery_count") + moves.cast("long")).alias("delivery_count"),
    )


def autoclaim(pel: DataFrame, consumer: str, min_idle: int, start: str, now: Column, count: int = 100) -> DataFrame:
    """(db, key, grp, ms, seq, consumer, previous, delivery_count): of each group the first idle rows from start on."""
    idle = pel.where((idle_ms(now) >= min_idle) & (ids.stream_id() >= ids.literal(start)))
    rows = idle.withColumn("nth", F.row_number().over(_by_id(keys=GROUP))).where(F.col("nth") <= count)
    return rows.select(*PENDING, F.lit(consumer).alias("consumer"), F.col("consumer").alias("previous"), (F.col("delivery_count") + 1).alias("delivery_count"))


def group_info(groups: DataFrame, pel: DataFrame, consumers: DataFrame) -> DataFrame:
    """(db, key, grp, consumers, pending, last_id)."""
    waiting = pel.groupBy(*GROUP).agg(F.count("*").alias("pending"))
    known = consumers.groupBy(*GROUP).agg(F.count_distinct("consumer").alias("consumers"))
    rows = groups.join(waiting, GROUP, "left").join(known, GROUP, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select(*GROUP, zero("consumers"), zero("pending"), F.concat_ws("-", "last_ms", "last_seq").alias("last_id"))


def consumer_info(consumers: DataFrame, pel: DataFrame, now: Column) -> DataFrame:
    """(db, key, grp, consumer, pending, idle). consumers: db, key, grp, consumer, last_seen."""
    waiting = pel.groupBy(*GROUP, "consumer").agg(F.count("*").alias("pending"))
    rows = consumers.join(waiting, [*GROUP, "consumer"], "left")
    return rows.select(*GROUP, "consumer", F.coalesce("pending", F.lit(0)).alias("pending"), (F.unix_millis(now) - F.unix_millis("last_seen")).alias("idle"))


def set_ids(groups: DataFrame, stream: DataFrame, wanted: DataFrame) -> DataFrame:
    """XGROUP SETID: all grp rows, with the cursors of wanted (db, key, grp, start) set as create_groups sets them. Groups that don't exist are not made."""
    new = create_groups(stream, wanted).select(*GROUP, F.col("last_ms").alias("new_ms"), F.col("last_seq").alias("new_seq"))
    return groups.join(new, GROUP, "left").select(*GROUP, F.coalesce("new_ms", "last_ms").alias("last_ms"), F.coalesce("new_seq", "last_seq").alias("last_seq"))


def destroy_groups(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """XGROUP DESTROY: what is left of a table by group: grp, pel or consumers."""
    return rows.join(gone.select(*GROUP), GROUP, "left_anti")


def create_consumers(consumers: DataFrame, wanted: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """XGROUP CREATECONSUMER: (all consumers, (db, key, grp, consumer, created 0/1) of wanted)."""
    asked = wanted.select(*GROUP, "consumer").distinct()
    known = consumers.select(*GROUP, "consumer", F.lit(1).alias("there"))
    told = asked.join(known, [*GROUP, "consumer"], "left").select(*GROUP, "consumer", F.when(F.col("there").isNull(), 1).otherwise(0).alias("created"))
    new = told.where("created = 1").select(*GROUP, "consumer", now.alias("last_seen"))
    return consumers.unionByName(new), told


def delete_consumer(pel: DataFrame, consumer: str) -> tuple[DataFrame, DataFrame]:
    """XGROUP DELCONSUMER: (pel rows left, dropped rows per group)."""
    gone = pel.where(F.col("consumer") == consumer)
    return pel.where(F.col("consumer") != consumer), gone.groupBy(*GROUP).agg(F.count("*").alias("dropped"))
