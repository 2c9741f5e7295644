"""The driver's tables as canonical tables: strings, lists, sets, hashes, sorted sets, keys, streams, groups and logs.

`SQL` has the same tables as DuckDB text, for the oracles. Timestamps are cast once, in
UTC; `now` is a constant or follows from the data, never from a clock.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

def db() -> Column:
    return F.lit(0).alias("db")

NOW = "1998-06-01 00:00:00"

SQL = {
    "str": "SELECT 'c:' || c_custkey AS key, c_name AS value FROM customer",
    "num": "SELECT 'p:' || p_partkey AS key, CAST(p_size AS VARCHAR) AS value FROM part",
    "lst": "SELECT 'u:' || user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, event_type AS value FROM events",
    "lst2": "SELECT 'o:' || l_orderkey AS key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos, CAST(l_partkey AS VARCHAR) AS value FROM lineitem",
    "st": "SELECT DISTINCT 'y:' || year(o_orderdate) AS key, CAST(o_custkey AS VARCHAR) AS member FROM orders",
    "hsh": "SELECT 'o:' || o_orderkey AS key, 'status' AS field, o_orderstatus AS value FROM orders UNION ALL SELECT 'o:' || o_orderkey, 'priority', o_orderpriority FROM orders UNION ALL SELECT 'o:' || o_orderkey, 'cust', CAST(o_custkey AS VARCHAR) FROM orders",
    "z1": "SELECT 'c:' || o_custkey AS key, CAST(o_orderkey AS VARCHAR) AS member, o_totalprice AS score FROM orders",
    "z2": "SELECT 's:' || l_suppkey AS key, CAST(l_partkey AS VARCHAR) AS member, max(l_quantity) AS score FROM lineitem GROUP BY 1, 2",
    "ks": "SELECT CAST(o_orderkey % 16 AS INT) AS db, 'o:' || o_orderkey AS key, (['string', 'list', 'set', 'hash', 'zset', 'stream'])[o_orderkey % 6 + 1] AS type, CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) + to_days(CAST(o_orderkey % 90 AS INT)) END AS expires_at FROM orders",
    "stm": "SELECT event_type AS key, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY event_type, epoch_us(ts) // 1000 ORDER BY event_id) - 1 AS seq, user_id, value, event_id FROM events",
    "log": "SELECT event_id AS seq, ts, user_id AS conn, (event_id % 50) AS slot, event_type, CAST(floor(value) AS BIGINT) AS amount FROM events",
}


def with_(*names: str, body: str) -> str:
    """The canonical tables as common table expressions; a body that starts with a comma goes on with its own."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + ("" if body.startswith(",") else " ") + body


class Tables:
    """Canonical tables of one data folder; every one is a plan until it is used."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def literal(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    @property
    def now(self) -> Column:
        return F.lit(NOW).cast("timestamp")

    @property
    def strings(self) -> DataFrame:
        return self.table("customer").select(db(), F.concat(F.lit("c:"), "c_custkey").alias("key"), F.col("c_name").alias("value"))

    @property
    def numbers(self) -> DataFrame:
        return self.table("part").select(db(), F.concat(F.lit("p:"), "p_partkey").alias("key"), F.col("p_size").cast("string").alias("value"))

    @property
    def lists(self) -> DataFrame:
        pos = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long") - 1
        return self.table("events").select(db(), F.concat(F.lit("u:"), "user_id").alias("key"), pos.alias("pos"), F.col("event_type").alias("value"))

    @property
    def order_lists(self) -> DataFrame:
        pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).cast("long") - 1
        return self.table("lineitem").select(db(), F.concat(F.lit("o:"), "l_orderkey").alias("key"), pos.alias("pos"), F.col("l_partkey").cast("string").alias("value"))

    @property
    def sets(self) -> DataFrame:
        return self.table("orders").select(db(), F.concat(F.lit("y:"), F.year("o_orderdate")).alias("key"), F.col("o_custkey").cast("string").alias("member")).distinct()

    @property
    def hashes(self) -> DataFrame:
        fields = F.array(*(F.struct(F.lit(n).alias("field"), F.col(c).cast("string").alias("value")) for n, c in (("status", "o_orderstatus"), ("priority", "o_orderpriority"), ("cust", "o_custkey"))))
        return self.table("orders").select(db(), F.concat(F.lit("o:"), "o_orderkey").alias("key"), F.inline(fields))

    @property
    def prices(self) -> DataFrame:
        return self.table("orders").select(db(), F.concat(F.lit("c:"), "o_custkey").alias("key"), F.col("o_orderkey").cast("string").alias("member"), F.col("o_totalprice").alias("score"))

    @property
    def quantities(self) -> DataFrame:
        rows = self.table("lineitem").select(db(), F.concat(F.lit("s:"), "l_suppkey").alias("key"), F.col("l_partkey").cast("string").alias("member"), "l_quantity")
        return rows.groupBy("db", "key", "member").agg(F.max("l_quantity").alias("score"))

    @property
    def keys(self) -> DataFrame:
        kinds = F.array(*(F.lit(x) for x in ("string", "list", "set", "hash", "zset", "stream")))
        until = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(days=(F.col("o_orderkey") % 90).cast("int"))
        return self.table("orders").select(
            (F.col("o_orderkey") % 16).cast("int").alias("db"),
            F.concat(F.lit("o:"), "o_orderkey").alias("key"),
            F.element_at(kinds, (F.col("o_orderkey") % 6 + 1).cast("int")).alias("type"),
            F.when(F.col("o_orderkey") % 10 != 0, until).alias("expires_at"),
        )

    @property
    def events(self) -> DataFrame:
        """events with ts as TIMESTAMP and ms, its whole milliseconds."""
        return self.table("events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("ms", F.floor(F.unix_micros("ts") / 1000).cast("long"))

    @property
    def stream(self) -> DataFrame:
        seq = F.row_number().over(Window.partitionBy("event_type", "ms").orderBy("event_id")).cast("long") - 1
        fields = F.map_from_arrays(F.array(F.lit("user_id"), F.lit("value"), F.lit("event_id")), F.array(*(F.col(c).cast("string") for c in ("user_id", "value", "event_id"))))
        return self.events.select(db(), F.col("event_type").alias("key"), "ms", seq.alias("seq"), fields.alias("fields"))

    @cached_property
    def event_now(self) -> Column:
        """An hour after the last event."""
        return F.lit(self.events.agg(F.max("ts")).first()[0]) + F.expr("interval 1 hour")

    @property
    def pending(self) -> DataFrame:
        """Group g1 after delivery of everything: entries of events that are not a multiple of three."""
        seq = F.row_number().over(Window.partitionBy("event_type", "ms").orderBy("event_id")).cast("long") - 1
        rows = self.events.withColumn("seq", seq).where("event_id % 3 != 0")
        return rows.select(db(), F.col("event_type").alias("key"), F.lit("g1").alias("grp"), "ms", "seq", F.concat(F.lit("w"), F.col("user_id") % 4).alias("consumer"), F.col("ts").alias("delivered_at"), F.lit(1).cast("long").alias("delivery_count"))

    @property
    def log(self) -> DataFrame:
        slot = F.concat(F.lit("k:"), F.col("event_id") % 50)
        amount = F.floor("value").cast("string")
        argv = (
            F.when(F.col("event_type") == "click", F.array(F.lit("INCR"), slot))
            .when(F.col("event_type") == "view", F.array(F.lit("GET"), slot))
            .when(F.col("event_type") == "purchase", F.array(F.lit("HINCRBY"), F.concat(F.lit("h:"), F.col("event_id") % 50), F.lit("n"), amount))
            .when(F.col("event_type") == "signup", F.array(F.lit("SET"), slot, amount))
            .otherwise(F.array(F.lit("DEL"), slot))
        )
        return self.events.select(F.col("event_id").alias("seq"), "ts", F.col("user_id").alias("conn"), F.lit(0).alias("db"), argv.alias("argv"))
