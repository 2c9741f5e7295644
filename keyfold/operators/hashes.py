"""Hashes as rows: db, key, field, value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.operators.common import KEY, integer, last_write, upsert

_ROW = [*KEY, "field"]


def put(hashes: DataFrame, incoming: DataFrame) -> DataFrame:
    """HSET and HMSET: incoming has pos; the last write of a field holds."""
    return upsert(hashes.select(*_ROW, "value"), last_write(incoming, _ROW, "value", "pos"), _ROW)


def added(hashes: DataFrame, incoming: DataFrame) -> DataFrame:
    """(db, key, added): distinct new fields."""
    return incoming.select(*_ROW).distinct().join(hashes, _ROW, "left_anti").groupBy(*KEY).agg(F.count("*").alias("added"))


def get(hashes: DataFrame, asked: DataFrame) -> DataFrame:
    return asked.select(*_ROW).join(hashes, _ROW, "left").select(*_ROW, "value")


def mget(hashes: DataFrame, fields: list[str]) -> DataFrame:
    """(db, key, pos, field, value): every hash, fields in order, null where missing."""
    found = hashes.where(F.col("field").isin(fields)).groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("m"))
    rows = hashes.select(*KEY).distinct().join(found, KEY, "left").select(*KEY, "m", F.posexplode(F.array(*(F.lit(f) for f in fields))).alias("pos", "field"))
    return rows.select(*KEY, "pos", "field", F.try_element_at("m", "field").alias("value"))


def packed(hashes: DataFrame) -> DataFrame:
    """(db, key, fields MAP): HGETALL of every hash in one row; HKEYS and HVALS are columns of the rows themselves."""
    return hashes.groupBy(*KEY).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"))


def delete(hashes: DataFrame, gone: DataFrame) -> DataFrame:
    return hashes.join(gone.select(*_ROW), _ROW, "left_anti")


def length(hashes: DataFrame) -> DataFrame:
    return hashes.groupBy(*KEY).agg(F.count("*").alias("n"))


def exists(hashes: DataFrame, asked: DataFrame) -> DataFrame:
    return asked.select(*_ROW).join(hashes.select(*_ROW, F.lit(1).alias("hit")), _ROW, "left").select(*_ROW, F.coalesce("hit", F.lit(0)).alias("found"))


def increment(hashes: DataFrame, deltas: DataFrame) -> DataFrame:
    """(db, key, field, value, error) of all deltas of a field; error: not_integer or overflow."""
    total = deltas.groupBy(*_ROW).agg(F.sum(F.col("delta").cast("decimal(38,0)")).alias("delta"))
    both = total.join(hashes.select(*_ROW, F.col("value").alias("text")), _ROW, "left")
    start = F.when(F.col("text").isNull(), F.lit(0)).otherwise(integer(F.col("text")))
    value = (start.cast("decimal(38,0)") + F.col("delta")).try_cast("long")
    return both.select(*_ROW, value.alias("value"), F.when(start.isNull(), "not_integer").when(value.isNull(), "overflow").alias("error"))
