"""Live twins of the batch operators on Structured Streaming.

Every function takes streaming DataFrames and returns one, or a `Stepped` stream;
`run_available` drives either to the end of what its source holds. State is per key (or
key and group): serial inside, parallel across keys, but for delivery to groups, which is
parallel inside a key too. It lives in the checkpoint, so a lost executor loses nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from keyfold.functions.scratch import written
from keyfold.operators import pubsub


def event_windows(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(event_type, start, n, total) by event-time window; rows later than `late` behind the newest are dropped."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    counted = events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counted.select("event_type", F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, n): runs of events of a user with gaps below `gap`."""
    counted = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return counted.select("user_id", F.col("w.start").alias("start"), "n")


def router(subs: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """What to do with each batch of messages (msg, channel): the batch operator. A message needs no state."""
    return lambda batch: pubsub.route(batch, subs)


@dataclass(frozen=True)
class Stepped:
    """A stream whose batches are jobs of their own: step makes of a batch and the state before it its rows and the state after it."""

    stream: DataFrame
    state: str
    step: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


def group_delivery(entries: DataFrame, consumers: int) -> Stepped:
    """(key, ms, seq, consumer, nth, late) of a stream of entries (key, ms, seq): the group's cursor and turn are state.

    Entries go to consumers in turn, in order of id; an entry at or below the cursor is
    late: it is told, not delivered. A batch is dealt over tasks by ranges of ids, in which
    its entries are numbered from the number of those in the ranges before, so that a long
    stream is not one task.
    """
    own = F.struct("ms", "seq")

    def deliver(batch: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
        # written, as another run may deal rows otherwise; equal ids are in one range
        dealt = written(batch.select("key", "ms", "seq").repartitionByRange("key", "ms", "seq").withColumn("range", F.spark_partition_id()), "entries")
        before = state.select(F.col("key").alias("group"), F.struct("ms", "seq").alias("cursor"), "nth")
        rows = dealt.join(before, F.col("key").eqNullSafe(F.col("group")), "left")
        inside = Window.partitionBy("range", "key").orderBy("ms", "seq")
        late = F.coalesce(own <= F.col("cursor"), F.lit(False)) | F.coalesce(own == F.lag(own).over(inside), F.lit(False))
        rows = rows.withColumn("late", late).withColumn("at", F.sum((~F.col("late")).cast("long")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        rows = written(rows.select("key", "ms", "seq", "range", "late", "at", F.coalesce("nth", F.lit(0)).alias("nth")), "ranges")
        ranges = rows.groupBy("key", "range").agg(F.max("at").alias("n"))
        earlier = F.sum("n").over(Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
        ranges = ranges.select(F.col("key").alias("group"), F.col("range").alias("part"), F.coalesce(earlier, F.lit(0)).alias("earlier"))
        nth = F.when(~F.col("late"), F.col("nth") + F.col("earlier") + F.col("at") - 1)
        told = rows.join(ranges, F.col("key").eqNullSafe(F.col("group")) & (F.col("range") == F.col("part"))).withColumn("nth", nth)
        told = told.select("key", "ms", "seq", F.concat(F.lit("w"), F.col("nth") % consumers).alias("consumer"), "nth", "late")
        newest = rows.groupBy("key").agg(F.max(F.when(~F.col("late"), own)).alias("end"), F.sum((~F.col("late")).cast("long")).alias("n"))
        newest = newest.where("end is not null").select("key", "end.ms", "end.seq", F.col("n").alias("nth"))
        after = state.unionByName(newest).groupBy("key").agg(F.max(own).alias("end"), F.sum("nth").alias("nth")).select("key", "end.ms", "end.seq", "nth")
        return told, after

    return Stepped(entries, "key string, ms long, seq long, nth long", deliver)


def blocking_queue(events: DataFrame) -> DataFrame:
    """(key, pop, push) from a stream of (key, seq, kind push or pop): waiters are served first come, first served.

    Pushes without waiters and waiters without pushes are state until their match comes.
    """

    def match(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pushes, pops = (list(state.get[0]), list(state.get[1])) if state.exists else ([], [])
        for r in pd.concat(list(batches)).sort_values("seq").itertuples(index=False):
            (pushes if r.kind == "push" else pops).append(int(r.seq))
        n = min(len(pushes), len(pops))
        state.update((pushes[n:], pops[n:]))
        yield pd.DataFrame({"key": [key[0]] * n, "pop": pops[:n], "push": pushes[:n]})

    return events.groupBy("key").applyInPandasWithState(match, "key string, pop long, push long", "pushes array<long>, pops array<long>", "append", GroupStateTimeout.NoTimeout)


def live_counters(log: DataFrame) -> DataFrame:
    """(key, value) after each batch that touches a counter, from a stream of (key, seq, name, amount): SET, INCR or DEL."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value = state.get[0] if state.exists else None
        for r in pd.concat(list(batches)).sort_values("seq").itertuples(index=False):
            value = None if r.name == "DEL" else int(r.amount) if r.name == "SET" else (value or 0) + 1
        state.update((value,))
        yield pd.DataFrame({"key": [key[0]], "value": pd.array([value], "Int64")})

    return log.groupBy("key").applyInPandasWithState(fold, "key string, value long", "value long", "update", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame | Stepped, path: str, checkpoint: str, mode: str = "append", each: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Process what the source holds, in micro-batches, and write the rows, or what `each` makes of them, to Parquet.

    A batch is written under its own number and overwrites what an earlier attempt left,
    so each batch counts once. In update mode the newest row of a key, by `batch`, holds.
    The state after a batch of a `Stepped` stream lies under that number in the checkpoint.
    """
    stepped = stream if isinstance(stream, Stepped) else None

    def put(batch: DataFrame, number: int) -> None:
        if stepped:
            reader = batch.sparkSession.read.schema(stepped.state)
            before = reader.parquet(f"{checkpoint}/groups/batch={number - 1}") if number else batch.sparkSession.createDataFrame([], stepped.state)
            batch, after = stepped.step(batch, before)
            after.write.mode("overwrite").parquet(f"{checkpoint}/groups/batch={number}")
        (each(batch) if each else batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    source = stepped.stream if stepped else stream
    query = source.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def run_to_the_end(job: Callable[[DataFrame], DataFrame], events: DataFrame, end: DataFrame, columns: list[str], path: str) -> None:
    """An append-mode job over a stream that ends: what the watermark still holds back is closed by the row `end`.

    The stream and a folder of its own for `end` are one source. The job first runs to the
    end of the stream, then `end` arrives, whose other columns are null, and the job goes
    on from its checkpoint. Rows are in `path`/rows, those of `end` among them if it closes.
    """
    spark = events.sparkSession
    events = events.select(*columns)
    marks = spark.createDataFrame([], events.schema)
    marks.write.parquet(f"{path}/end")
    for last in (False, True):
        if last:
            end.select(*(F.col(c) if c in end.columns else F.lit(None).cast(events.schema[c].dataType).alias(c) for c in columns)).write.mode("append").parquet(f"{path}/end")
        both = events.unionByName(spark.readStream.schema(marks.schema).parquet(f"{path}/end"))
        run_available(job(both), f"{path}/rows", f"{path}/checkpoint")


def as_stream(df_dir: str, static: DataFrame, files: int | None = 64) -> DataFrame:
    """The files of a table as a stream, with the table's schema: so many files a batch, or all that there are."""
    reader = static.sparkSession.readStream.schema(static.schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(df_dir)


def utc(column: str) -> Column:
    """A timestamp without time zone as one with: watermarks need it."""
    return F.col(column).cast("timestamp")
