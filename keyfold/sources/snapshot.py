"""Snapshots: every value table as Parquet by type, in a folder of its own, with a manifest that is written last."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.operators.common import KEY, live

_MANIFEST = "number long, name string, folder string, saved_at timestamp"


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all saves under the path, one for each table of each."""
    try:
        return spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException:  # nothing was saved yet
        return spark.createDataFrame([], _MANIFEST)


def save(path: str, tables: dict[str, DataFrame], keys: DataFrame, saved_at: Column) -> None:
    """SAVE: a new folder for each save, one below for each table, `keys` (the keyspace) among them.

    A save counts from when its rows are in the manifest, all at once; until then, and if
    it breaks off, the one before is what loads.
    """
    spark, folder = keys.sparkSession, f"data-{uuid.uuid4().hex}"
    for name, table in {**tables, "keys": keys}.items():
        table.write.parquet(f"{path}/{folder}/{name}")
    last = _manifest(spark, path).agg(F.max("number")).first()[0]
    rows = [(0 if last is None else last + 1, name, folder) for name in [*tables, "keys"]]
    new = spark.createDataFrame(rows, "number long, name string, folder string").withColumn("saved_at", saved_at.cast("timestamp"))
    new.coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def last_save(spark: SparkSession, path: str) -> DataFrame:
    """LASTSAVE: (saved_at) of the newest save."""
    return _manifest(spark, path).agg(F.max_by("saved_at", "number").alias("saved_at"))


def load(spark: SparkSession, path: str, now: Column) -> dict[str, DataFrame]:
    """Tables of the newest snapshot; keys that have expired since, and their values, are left out."""
    manifest = _manifest(spark, path)
    newest = manifest.agg(F.max("number")).first()[0]
    if newest is None:
        raise ValueError(f"no snapshot under {path}")
    rows = manifest.where(F.col("number") == newest).select("name", "folder").collect()  # one row per table
    read = {r["name"]: spark.read.parquet(f"{path}/{r['folder']}/{r['name']}") for r in rows}
    keys = read.pop("keys").where(live(now))
    return {"keys": keys, **{name: table.join(keys.select(*KEY), KEY, "left_semi") for name, table in read.items()}}


def compact(state: DataFrame, path: str, saved_at: Column) -> None:
    """BGREWRITEAOF: the fold of a log (db, key, value) becomes a new base, from which the log before it can go."""
    save(path, {"strings": state.select(*KEY, "value")}, state.select(*KEY, F.lit("string").alias("type"), F.lit(None).cast("timestamp").alias("expires_at")), saved_at)
