"""Publish and subscribe as joins. subs: conn, kind (channel or pattern), topic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyfold.functions.glob import regex_column

#: Characters of a pattern's literal start or end, and of one inside, by which it is looked up.
KEY_CHARS, GRAM = 8, 3


def live_subscriptions(log: DataFrame) -> DataFrame:
    """Subscriptions that stand after a change log: conn, kind, topic (null: all of the kind), seq, op (sub or unsub)."""
    everything = log.where("topic is null and op = 'unsub'").groupBy("conn", "kind").agg(F.max("seq").alias("all_at"))
    last = log.where("topic is not null").groupBy("conn", "kind", "topic").agg(F.max_by("op", "seq").alias("op"), F.max("seq").alias("seq"))
    rows = last.join(everything, ["conn", "kind"], "left")
    return rows.where("op = 'sub' and (all_at is null or seq > all_at)").select("conn", "kind", "topic")


def subscription_counts(log: DataFrame) -> DataFrame:
    """(conn, seq, n): the number of subscriptions a connection has after each change of one topic."""
    order = Window.partitionBy("conn", "kind", "topic").orderBy("seq")
    steps = log.where("topic is not null").withColumn("on", (F.col("op") == "sub").cast("int"))
    steps = steps.withColumn("step", F.col("on") - F.coalesce(F.lag("on").over(order), F.lit(0)))
    return steps.select("conn", "seq", F.sum("step").over(Window.partitionBy("conn").orderBy("seq")).alias("n"))


def literal_of(topic: Column) -> Column:
    """(side, text) of a pattern: characters that a match has for sure, at its start, at its end or anywhere; without any, the side is none."""
    run = r"[^*?\\]+"
    start, end = (F.regexp_extract(topic, x, 0) for x in (f"^{run}", f"{run}$"))
    inner = F.array_max(F.transform(F.regexp_extract_all(topic, F.lit(f"({run})"), 1), lambda x: F.struct(F.length(x).alias("n"), x.alias("text"))))["text"]
    key = lambda side, text: F.struct(F.lit(side).alias("side"), text.alias("text"))
    return (
        F.when((start != "") & (F.length(start) >= F.length(end)), key("start", F.substring(start, 1, KEY_CHARS)))
        .when(end != "", key("end", F.substring(end, F.greatest(F.length(end) - KEY_CHARS + 1, F.lit(1)), F.lit(KEY_CHARS))))
        .when(inner.isNotNull(), key("inside", F.substring(inner, 1, GRAM)))
        .otherwise(key("none", F.lit("")))
    )


def literals_in(channel: Column) -> Column:
    """All keys by which literal_of can name a pattern that matches the channel: some thirty, and its runs of up to GRAM characters."""
    n = F.length(channel)
    up_to = lambda most: F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(most)), F.lit(1)))
    key = lambda side, text: F.struct(F.lit(side).alias("side"), text.alias("text"))
    starts = F.transform(up_to(KEY_CHARS), lambda i: key("start", F.substring(channel, F.lit(1), i)))
    ends = F.transform(up_to(KEY_CHARS), lambda i: key("end", F.substring(channel, n - i + 1, i)))
    at = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    inside = F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(1), F.greatest(F.least(n - i + 1, F.lit(GRAM)), F.lit(1))), lambda k: key("inside", F.substring(channel, i, k)))))
    return F.array_distinct(F.concat(starts, ends, inside, F.array(key("none", F.lit("")))))


def route(messages: DataFrame, subs: DataFrame) -> DataFrame:
    """(msg, conn, via, topic): each connection gets a message once, by its channel before any pattern, then by the least pattern.

    messages: msg, channel. Channels are an equi-join. Patterns meet distinct channels by
    a literal that both have, also an equi-join whatever their number, and are then
    matched; what matched joins back by channel. Only patterns made of * and ? alone meet
    every channel, of which they match most.
    """
    exact = subs.where("kind = 'channel'").select(F.col("topic").alias("channel"), "conn", F.lit("channel").alias("via"), "topic")
    patterns = subs.where("kind = 'pattern'").select("topic").distinct().select("topic", literal_of(F.col("topic")).alias("literal"), regex_column(F.col("topic")).alias("regex"))
    wanted_literals = patterns.select("literal").distinct()
    channels = messages.select("channel").distinct().select("channel", F.explode(literals_in(F.col("channel"))).alias("literal")).join(wanted_literals, "literal", "left_semi")
    pairs = channels.join(patterns, "literal").where(F.rlike("channel", F.col("regex"))).select("channel", "topic")
    by_pattern = pairs.join(subs.where("kind = 'pattern'").select("topic", "conn"), "topic").select("channel", "conn", F.lit("pattern").alias("via"), "topic")
    wanted = exact.unionByName(by_pattern).groupBy("channel", "conn").agg(F.min(F.struct("via", "topic")).alias("best"))
    return messages.select("msg", "channel").join(wanted, "channel").select("msg", "conn", "best.via", "best.topic")


def receivers(messages: DataFrame, subs: DataFrame) -> DataFrame:
    """(msg, n): what PUBLISH replies, 0 included."""
    counted = route(messages, subs).groupBy("msg").agg(F.count("*").alias("n"))
    return messages.select("msg").join(counted, "msg", "left").select("msg", F.coalesce("n", F.lit(0)).alias("n"))
