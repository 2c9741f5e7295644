"""Transactions as windows and joins over the command log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyfold.functions.scratch import written
from keyfold.operators.common import is_write
from keyfold.plans.fold import commands, written_keys


def _conn():
    return Window.partitionBy("conn").orderBy("seq")


def sessions(log: DataFrame) -> DataFrame:
    """With txn (numbered per connection from 1, null outside MULTI ... EXEC or DISCARD) and role: multi, queued, exec, discard or none."""
    rows = commands(log)
    # state after each command: the last of MULTI, EXEC and DISCARD, and how many MULTI began a block
    mark = F.when(F.col("name").isin("MULTI", "EXEC", "DISCARD"), F.col("name"))
    before = F.last(mark, ignorenulls=True).over(_conn().rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("open", F.coalesce(before == "MULTI", F.lit(False)))
    begins = (F.col("name") == "MULTI") & ~F.col("open")
    role = F.when(begins, "multi").when(F.col("open") & (F.col("name") == "EXEC"), "exec").when(F.col("open") & (F.col("name") == "DISCARD"), "discard").when(F.col("open"), "queued").otherwise("none")
    rows = rows.withColumn("role", role).withColumn("number", F.sum(begins.cast("int")).over(_conn()))
    return rows.withColumn("txn", F.when(F.col("role") != "none", F.col("number"))).drop("open", "number")


def watched(log: DataFrame) -> DataFrame:
    """(conn, txn, db, key, watch_seq, exec_seq): keys that an EXEC has to find unchanged. EXEC, DISCARD and UNWATCH drop watches."""
    return _watched(sessions(log))


def _watched(rows: DataFrame) -> DataFrame:
    """watched, of rows of sessions."""
    end = F.when(F.col("role").isin("exec", "discard") | (F.col("name") == "UNWATCH") & (F.col("role") == "none"), F.struct("seq", "role", "txn"))
    keys = F.when((F.col("name") == "WATCH") & (F.col("role") == "none"), F.concat(F.array("key"), "args"))
    marks = rows.select("conn", "db", "seq", end.alias("end"), keys.alias("keys")).where("end is not null or keys is not null")
    # backwards: a frame that runs to the end of its partition is worked out anew for each row
    following = F.last("end", ignorenulls=True).over(Window.partitionBy("conn").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1))
    closed = marks.withColumn("following", following).where("keys is not null and following.role = 'exec'")
    return closed.select("conn", "following.txn", "db", F.explode("keys").alias("key"), F.col("seq").alias("watch_seq"), F.col("following.seq").alias("exec_seq")).where("key is not null")


def _scopes(key: Column, db: Column) -> Column:
    """What a watch of a key looks out for: writes of the key, flushes of its database, flushes of all."""
    scope = lambda kind, d, k: F.struct(F.lit(kind).alias("kind"), d.alias("db"), k.alias("key"))
    return F.array(scope("key", db, key), scope("db", db, F.lit("")), scope("all", F.lit(-1), F.lit("")))


def writes(rows: DataFrame) -> DataFrame:
    """rows of sessions, one for each thing written: with scope (kind key, db or all; db; key)."""
    keys = F.transform(written_keys(), lambda k: _scopes(k, F.col("db"))[0])
    flush = F.when(F.col("name") == "FLUSHDB", F.array(_scopes(F.lit(""), F.col("db"))[1])).when(F.col("name") == "FLUSHALL", F.array(_scopes(F.lit(""), F.col("db"))[2]))
    return rows.where(is_write(F.col("name"))).withColumn("scope", F.explode(F.coalesce(flush, keys)))


def conflicts(log: DataFrame, period: int = 1024) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sessions, broken, edges): broken (exec_seq) by commands outside transactions; edges (source, target): target is broken if source commits.

    Watches and writes meet by what is written and by periods of seq, then by exact
    bounds, so a key that is written all the time meets each watch only while it is open.
    """
    rows = written(sessions(log), "sessions")
    watches = _watched(rows).select("exec_seq", "watch_seq", F.explode(_scopes(F.col("key"), F.col("db"))).alias("scope")).groupBy("exec_seq", "scope").agg(F.min("watch_seq").alias("watch_seq"))
    span = F.sequence(F.floor(F.col("watch_seq") / period), F.floor(F.col("exec_seq") / period))
    watches = written(watches.select("exec_seq", "watch_seq", "scope", F.explode(span).alias("period")), "watches")
    execs = rows.where("role = 'exec'").select("conn", "txn", F.col("seq").alias("at"))
    done = writes(rows.where("role = 'none'")).select("scope", F.col("seq").alias("at"))
    queued = writes(rows.where("role = 'queued'")).join(execs, ["conn", "txn"]).select("scope", "at").distinct()

    def met(some: DataFrame) -> DataFrame:
        some = some.withColumn("period", F.floor(F.col("at") / period))
        return watches.join(some, ["scope", "period"]).where("watch_seq < at and at < exec_seq")

    broken = written(met(done).select("exec_seq").distinct(), "broken")
    edges = met(queued).select(F.col("at").alias("source"), F.col("exec_seq").alias("target")).distinct()
    return rows, broken, written(edges, "edges")


def outcomes(log: DataFrame) -> DataFrame:
    """(conn, txn, exec_seq, queued, aborted) of every EXEC: aborted if a watched key was written between WATCH and EXEC.

    A queued write counts at its EXEC, and only if that one isn't aborted itself. What
    can break what is found once; then transactions that nothing open can break commit,
    those that they break are aborted, and both leave with their edges, until no edge is
    left. An edge leads to a later EXEC, so each round settles the earliest at least.
    """
    return _settled(*conflicts(log))


def _settled(rows: DataFrame, broken: DataFrame, edges: DataFrame) -> DataFrame:
    """outcomes, of what conflicts gives."""
    parts = [broken]

    def without(some: DataFrame, gone: DataFrame) -> DataFrame:
        for end in ("source", "target"):
            some = some.join(gone.select(F.col("exec_seq").alias(end)), end, "left_anti")
        return some

    edges = written(without(edges, broken), "edges")
    while not edges.isEmpty():
        sure = edges.join(edges.select(F.col("target").alias("source")), "source", "left_anti")
        gone = sure.select(F.col("target").alias("exec_seq")).distinct()
        parts.append(gone)  # follows from written edges, so it is only worked out again at the end
        edges = written(without(edges, gone), "edges")
        if len(parts) == 16:  # long chains don't make long plans
            parts = [written(reduce(DataFrame.unionByName, parts), "aborted")]
    aborted = reduce(DataFrame.unionByName, parts)
    execs = rows.where("role = 'exec'").select("conn", "txn", F.col("seq").alias("exec_seq"))
    queued = rows.where("role = 'queued'").groupBy("conn", "txn").agg(F.count("*").alias("queued"))
    both = execs.join(queued, ["conn", "txn"], "left").join(aborted.withColumn("aborted", F.lit(True)), "exec_seq", "left")
    return both.select("conn", "txn", "exec_seq", F.coalesce("queued", F.lit(0)).alias("queued"), F.coalesce("aborted", F.lit(False)).alias("aborted"))


def effective(log: DataFrame) -> DataFrame:
    """The commands that take effect, with `at`, the seq of their effect: queued ones of committed transactions at their EXEC."""
    rows, broken, edges = conflicts(log)
    done = _settled(rows, broken, edges).where("not aborted").select("conn", "txn", "exec_seq")
    queued = rows.where("role = 'queued'").join(done, ["conn", "txn"]).withColumn("at", F.col("exec_seq"))
    return rows.where("role = 'none'").withColumn("at", F.col("seq")).unionByName(queued.select(*rows.columns, "at"))
