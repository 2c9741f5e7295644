"""Registered procedures: named functions of DataFrames, called by name or by the SHA-1 of their source."""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

class Registry:
    """Procedures by name and by SHA-1."""

    def __init__(self) -> None:
        self.by_name: dict[str, Callable[..., DataFrame]] = {}
        self.by_sha: dict[str, str] = {}

    def load(self, f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        """SCRIPT LOAD: the procedure composes lazy plans, so what it does is one job with its caller's."""
        self.by_name[f.__name__] = f
        self.by_sha[hashlib.sha1(inspect.getsource(f).encode()).hexdigest()] = f.__name__
        return f

    def known(self, *shas: str) -> list[bool]:
        """SCRIPT EXISTS."""
        return [s in self.by_sha for s in shas]

    def has(self, name: str) -> bool:
        return name in self.by_name

    def sha_of(self, name: str) -> str:
        return next(s for s, n in self.by_sha.items() if n == name)

    def flush(self) -> None:
        """SCRIPT FLUSH: by SHA-1 no procedure is known any more; names stay."""
        self.by_sha.clear()

    def call(self, spark: SparkSession, name_or_sha: str, **arguments) -> DataFrame:
        """EVAL by name, EVALSHA by SHA-1."""
        name = self.by_sha.get(name_or_sha, name_or_sha)
        if name not in self.by_name:
            raise KeyError(f"NOSCRIPT {name_or_sha}")
        return self.by_name[name](**arguments)


_OWN = Registry()
procedure, known, sha_of, call = _OWN.load, _OWN.known, _OWN.sha_of, _OWN.call


@procedure
def compare_and_delete(strings: DataFrame, asked: DataFrame) -> DataFrame:
    """(db, key, deleted): a key goes if it has the expected value, as when a lock is released."""
    both = asked.join(strings, ["db", "key"], "left")
    return both.select("db", "key", F.coalesce(F.col("value") == F.col("expected"), F.lit(False)).alias("deleted"))


@procedure
def rate_limit(calls: DataFrame, window_ms: int, most: int) -> DataFrame:
    """(client, call, allowed): the first calls of each client in each window of time."""
    window = Window.partitionBy("client", F.floor(F.col("ms") / window_ms)).orderBy("call")
    return calls.select("client", "call", (F.row_number().over(window) <= most).alias("allowed"))
