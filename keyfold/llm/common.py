"""What several operators share: scratch tables and vectorised views of a text column.

The Python tasks get Arrow batches. A batch is cut into pieces of whole rows of a
few MB, and each piece is handled as one byte buffer with the rows' offsets, so
memory follows the piece (or the longest single text), not the batch.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PIECE_BYTES = 2 << 20


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir).

    Where the setting is absent on one machine, as in tests, a temporary folder is set for
    the session; a cluster needs a shared one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="keyfold-")
        spark.conf.set("spark.checkpoint.dir", root)
    app = spark.sparkContext.applicationId
    return f"{root.rstrip('/')}/keyfold-{app}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """The same rows read back from a table in the shared folder: cuts the lineage, survives executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_names(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until the table has no such columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def row_hash(id_: Column, digest: Column) -> Column:
    return F.xxhash64(id_, digest)


def may_hold(hashes: DataFrame, bits: int = 1 << 24) -> Callable[[Column], Column]:
    """Whether a hash may be among those of (h): a bitmap of fixed size, given to tasks as one value.

    No for sure, or maybe: so of a large table only the rows in question go into a join.
    """
    at = F.col("h").bitwiseAND(bits - 1)
    words = hashes.select(F.shiftright(at, 6).alias("word"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("flag")).groupBy("word").agg(F.bit_or("flag").alias("flags")).toPandas()
    flags = np.zeros(bits // 64, np.int64)
    flags[words["word"].to_numpy(np.int64)] = words["flags"].to_numpy(np.int64)
    table = saved(hashes.sparkSession.createDataFrame(pa.table({"flags": pa.array([flags], pa.list_(pa.int64()))}), "flags array<long>"), "bitmap")

    def test(h: Column) -> Column:
        word = F.get(table.select("flags").scalar(), F.shiftright(h.bitwiseAND(bits - 1), 6).cast("int"))
        return F.bit_get(word, h.bitwiseAND(63).cast("int")) == 1

    return test


def rows_of(docs: DataFrame, some: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(docs without, docs with) the id and text of some (id, digest), where digest is xxhash64 of the text and nulls are equal.

    Only rows that may be meant are joined, so texts of others aren't shuffled.
    """
    some_id, some_digest = new_names(docs, "some_id", "some_digest")
    digest = F.xxhash64(docs[text_col])
    maybe = F.coalesce(may_hold(some.select(row_hash(F.col("id"), F.col("digest")).alias("h")))(row_hash(docs[id_col], digest)), F.lit(False))
    some = some.select(F.col("id").alias(some_id), F.col("digest").alias(some_digest))
    same = docs[id_col].eqNullSafe(F.col(some_id)) & (digest == F.col(some_digest))
    asked = docs.where(maybe)
    return docs.where(~maybe).unionByName(asked.join(some, same, "left_anti")), asked.join(some, same, "left_semi")


# ---------------------------------------------------------------- pieces of a batch


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows end to end, and len + 1 offsets. A null reads as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]], off - off[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of whole rows with at most max_bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = text_buffer(batch.column(text))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(off, off[first] + max_bytes, side="right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


# ---------------------------------------------------------------- words


def byte_table(keep) -> np.ndarray:
    return np.array([bool(keep(b)) for b in range(256)])


#: Bytes of the words `[^\x20\x09-\x0D]+`.
SPACED = byte_table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Bytes of the words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`; in UTF-8 every byte of a letter beyond ASCII is 0x80 or more.
ALNUM = byte_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
#: A-Z to a-z, all else as it is.
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True that stay within one row."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = off[:-1][off[:-1] < n]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cuts[cuts > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends


def per_row(starts: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Row i has the runs first[i] to first[i + 1]."""
    return np.searchsorted(starts, off)


# ---------------------------------------------------------------- hashes

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = 0x9E3779B97F4A7C15
_RADIX = 0xD6E8FEB86659FD93
_GRAM = np.uint64(0xA0761D6478BD642F)
_BLOCK = 1 << 21


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


_BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_STEP))
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, _BLOCK + (1 << 16))
        both = []
        for radix in (_RADIX, pow(_RADIX, -1, 1 << 64)):
            p = np.full(size, radix, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers = (both[0], both[1])
    return _powers


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes, the same wherever the span stands: prefix sums of a rolling hash."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + _BLOCK, side="right")))
        size = int(ends[j - 1]) - base
        up, down = _power_tables(size + 1)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(_BYTE_CODES[data[base : base + size]] * up[:size], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * _M2)
        i = j
    return out


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive word hashes; row limits are the caller's matter."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = words[:m].copy()
    for j in range(1, n):
        h *= _GRAM
        h += words[j : m + j]
    return mix(h)


def gram_rows(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """Of each n-gram start: whether its n words stay within one row."""
    inside = np.zeros(max(0, total - n + 1), bool)
    if not len(inside):
        return inside
    edge = np.zeros(len(inside) + 1, np.int64)
    have = (first[1:] - first[:-1]) >= n
    np.add.at(edge, first[:-1][have], 1)
    np.add.at(edge, first[1:][have] - n + 1, -1)
    return np.cumsum(edge[:-1]) > 0


def covered(starts: np.ndarray, length: int, total: int) -> np.ndarray:
    """Which of total positions lie in [s, s + length) for some start s."""
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, total), -1)
    return np.cumsum(edge[:-1]) > 0


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i + 1]] for each i."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
