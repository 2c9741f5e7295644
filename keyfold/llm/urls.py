"""URL filters by a temporal list join, in DataFrame operations only.

1. Dated list changes (add, remove) become validity intervals [added, until): a window
   orders the changes of each (list, pattern).
2. Every capture is looked up under each suffix of its host, at its fetch time: an
   equi-join on (pattern, period), where periods of `period_s` seconds cut time so that
   a long history meets only captures of its own time, then the exact bounds. It is an
   ordinary shuffle join: AQE splits hot hosts, and Spark broadcasts the intervals only
   where their measured size allows.
3. One aggregation per capture collects the lists that were active.

A pattern is a host name, and covers the host itself and all hosts below it.

Defined results: a capture with a null URL, host or fetch time matches nothing and is
kept; one with a null id is evaluated like any other; repeated captures give one row each; of changes to the same (list, pattern) at
one time a remove holds; a second add goes on with the interval; changes with a null
in any column are ignored; without an end an interval is open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyfold.llm import common as C


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and trailing dot; null where there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    return F.nullif(F.rtrim(host, F.lit(".")), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and its parents down to two labels; a single label stands for itself."""
    labels = F.split(host, r"\.")
    last = F.greatest(F.size(labels) - 1, F.lit(1))
    return F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def intervals(changes: DataFrame) -> DataFrame:
    """(list, pattern, added, until): until is null while an entry stands. changes: list, pattern, at (long), op (add or remove)."""
    known = changes.select("list", F.lower("pattern").alias("pattern"), "at", "op").dropna().where("op in ('add', 'remove')")
    known = known.groupBy("list", "pattern", "at").agg(F.max("op").alias("op"))  # remove holds
    order = Window.partitionBy("list", "pattern").orderBy("at")
    steps = known.withColumn("until", F.lead("at").over(order))
    return steps.where("op = 'add'").select("list", "pattern", F.col("at").alias("added"), "until")


def evaluate(captures: DataFrame, changes: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched", period_s: int = 30 * 86400) -> DataFrame:
    """One row per capture: id, host, fetched, lists (active then, sorted), patterns (that matched, sorted), blocked."""
    rows = captures.select(captures[id_col].alias("id"), host_of(captures[url_col]).alias("host"), captures[time_col].cast("long").alias("fetched"))
    rows = C.saved(rows.groupBy("id", "host", "fetched").agg(F.count("*").alias("copies")), "captures")
    first, last = rows.agg(F.min("fetched"), F.max("fetched")).first()
    period = lambda t: F.floor(t / period_s).cast("long")
    looked = rows.where("host is not null and fetched is not null").select("id", "host", "fetched", period(F.col("fetched")).alias("period"), F.explode(suffixes(F.col("host"))).alias("pattern"))
    valid = intervals(changes).where((F.col("added") <= F.lit(last)) & (F.col("until").isNull() | (F.col("until") > F.lit(first))))
    span = F.sequence(period(F.greatest("added", F.lit(first))), period(F.least(F.coalesce(F.col("until") - 1, F.lit(last)), F.lit(last))))
    valid = valid.select("list", "pattern", "added", "until", F.explode(span).alias("period"))
    hits = looked.join(valid, ["pattern", "period"]).where("added <= fetched and (until is null or fetched < until)")
    active = hits.groupBy("id", "host", "fetched").agg(F.array_sort(F.collect_set("list")).alias("lists"), F.array_sort(F.collect_set("pattern")).alias("patterns"))
    active = active.select(F.col("id").alias("__id"), F.col("host").alias("__host"), F.col("fetched").alias("__fetched"), "lists", "patterns")
    whole = rows.join(active, F.col("id").eqNullSafe(F.col("__id")) & (F.col("host") == F.col("__host")) & (F.col("fetched") == F.col("__fetched")), "left")
    none = F.expr("cast(array() as array<string>)")
    return whole.withColumn("copy", F.explode(F.expr("array_repeat(1, cast(copies as int))"))).select(
        F.col("id").alias(id_col), "host", F.col("fetched").alias(time_col), F.coalesce("lists", none).alias("lists"), F.coalesce("patterns", none).alias("patterns"), F.col("lists").isNotNull().alias("blocked")
    )
