"""Benchmark decontamination by winnowing.

A span of `window` words is winnowed: of its k-grams of words, the smallest hash is
its fingerprint. Training and benchmark spans with equal words have equal
fingerprints, so every shared span of `window` words is found; a benchmark item with
fewer words is one span of its own length, winnowed alike at that length.

1. Benchmark: a map gives each item's spans with fingerprints; equal spans are
   grouped with the list of their items, and written to the shared folder.
2. A bitmap of fixed size (`filter_bits`, whatever the benchmark's size) over the
   fingerprints and the hashes of whole spans goes to the tasks.
3. Documents: a map winnows each whole text, looks fingerprints up in the bitmap and
   extends those that hit to the spans they stand for. Surviving spans leave the map
   with their words; each document leaves one head row besides.
4. Join on (fingerprint, words of the span): equality of the words verifies. Spark
   broadcasts the benchmark's spans only if their table is below its threshold, else
   both sides are shuffled, and AQE splits a span that very many documents share.
   Head rows have keys of their own, so they don't meet in one task.
5. One aggregation per document merges the spans.

Defined results: a null text or item has no words and no hits; repeated rows and rows
with a null id give one row each; two items with equal text both count; an item with a
null id is left out; an empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.llm import common as C

_U = np.uint64


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values, by doubling."""
    have, low = 1, values
    while have * 2 <= width:
        low = np.minimum(low[: len(low) - have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    return low


class Words:
    """The words of a piece of rows: `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z."""

    def __init__(self, column: pa.Array) -> None:
        data, off = C.text_buffer(column)
        self.data = C.LOWER[data]
        self.starts, self.ends = C.runs(C.ALNUM[self.data], off)
        self.first = C.per_row(self.starts, off)
        self.count = np.diff(self.first)
        self.hashes = C.span_hashes(self.data, self.starts, self.ends)
        self.off = off
        self._grams: dict[int, np.ndarray] = {}

    def grams(self, n: int) -> np.ndarray:
        if n not in self._grams:
            self._grams[n] = C.gram_hashes(self.hashes, n)
        return self._grams[n]

    def fingerprints(self, window: int, k: int) -> np.ndarray:
        """Of each span of `window` words: the smallest hash of its k-grams."""
        k = min(k, window)
        grams = self.grams(k)
        return sliding_minimum(grams, window - k + 1) if len(self.hashes) >= window else np.zeros(0, _U)

    def text(self, at: int, window: int) -> str:
        part = slice(at, at + window)
        return " ".join(self.data[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(self.starts[part], self.ends[part], strict=True))

    def row_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, side="right") - 1


def benchmark_spans(bench: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = 10, k: int = 4) -> DataFrame:
    """(size, fp, whole, span, items): distinct spans of the benchmark; whole is the hash of all words of the span."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in C.pieces(batches, "__text"):
            w = Words(piece.column("__text"))
            out: dict[str, list] = {c: [] for c in ("item", "size", "fp", "whole", "span")}
            ids = piece.column("__id").to_pylist()
            for size in np.unique(np.minimum(w.count, window)).tolist():
                if not size:
                    continue
                fit = np.flatnonzero(C.gram_rows(w.first, size, len(w.hashes)))
                row = w.row_of(fit)
                fit, row = (x[np.minimum(w.count[row], window) == size] for x in (fit, row))
                out["item"] += [ids[r] for r in row]
                out["size"] += [size] * len(fit)
                out["fp"].append(w.fingerprints(size, k)[fit])
                out["whole"].append(w.grams(size)[fit])
                out["span"] += [w.text(a, size) for a in fit.tolist()]
            longs = {c: pa.array(np.concatenate([np.zeros(0, _U), *out[c]]).view(np.int64)) for c in ("fp", "whole")}
            yield pa.RecordBatch.from_arrays([pa.array(out["item"], pa.string()), pa.array(out["size"], pa.int32()), longs["fp"], longs["whole"], pa.array(out["span"], pa.string())], list(out))

    items = bench.select(bench[id_col].cast("string").alias("__id"), bench[text_col].alias("__text")).where("__id is not null")
    spans = items.mapInArrow(work, "item string, size int, fp long, whole long, span string")
    return spans.groupBy("size", "fp", "whole", "span").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _bitmap(spans: DataFrame, bits: int) -> np.ndarray:
    """2 * bits flags: over the fingerprints, then over the whole spans' hashes."""
    at = F.explode(F.array(F.col("fp").bitwiseAND(bits - 1), F.col("whole").bitwiseAND(bits - 1) + bits)).alias("at")
    words = spans.select(at).groupBy(F.expr("shiftright(at, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("flags")).toPandas()
    flags = np.zeros(2 * bits // 64, np.int64)
    flags[words["word"].to_numpy(np.int64)] = words["flags"].to_numpy(np.int64)
    return flags.view(_U)


def _set(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (flags[(at >> _U(6)).astype(np.int64)] >> (at & _U(63))) & _U(1) == 1


def hits_of(docs: DataFrame, bench: DataFrame, id_col: str, text_col: str, item_col: str = "item_id", item_text_col: str = "text", window: int = 10, k: int = 4, filter_bits: int = 1 << 24) -> DataFrame:
    """(id, digest, n_words, copies, hits, items) of each id and text: hits are (start, end) by start, digest is xxhash64 of the text."""
    known = C.saved(benchmark_spans(bench, item_col, item_text_col, window, k), "benchmark-spans")
    sizes = sorted(r["size"] for r in known.select("size").distinct().collect())  # `window` values at most
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(known, filter_bits))
    low = _U(filter_bits - 1)

    def winnow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        flags = shared.value
        for piece in C.pieces(batches, "__text"):
            w = Words(piece.column("__text"))
            raw, off = C.text_buffer(piece.column("__text"))
            digest = np.array([xxhash.xxh64_intdigest(raw[s:e].tobytes(), 42) for s, e in zip(off[:-1], off[1:], strict=True)], _U)
            rows, starts, lengths, fps, texts = [np.arange(piece.num_rows)], [np.full(piece.num_rows, -1)], [np.zeros(piece.num_rows, np.int64)], [digest], [f"\n{d:x}" for d in digest.tolist()]
            for size in sizes:
                fp = w.fingerprints(size, k)
                if not len(fp):
                    continue
                # spans in a row mostly have one fingerprint: it is looked up once
                head = np.flatnonzero(np.concatenate(([True], fp[1:] != fp[:-1])))
                hit = np.repeat(_set(flags, fp[head] & low), np.diff(np.append(head, len(fp))))
                at = np.flatnonzero(hit & C.gram_rows(w.first, size, len(w.hashes)))
                at = at[_set(flags, (w.grams(size)[at] & low) + _U(filter_bits))] if len(at) else at
                row = w.row_of(at)
                rows.append(row), starts.append(at - w.first[row]), lengths.append(np.full(len(at), size)), fps.append(fp[at])
                texts += [w.text(a, size) for a in at.tolist()]
            rows = np.concatenate(rows)
            columns = [pc.take(piece.column("__id"), pa.array(rows)), pa.array(digest[rows].view(np.int64)), pa.array(w.count[rows]), pa.array(np.concatenate(starts)), pa.array(np.concatenate(lengths)), pa.array(np.concatenate(fps).view(np.int64)), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "digest", "n_words", "start", "length", "fp", "span"])

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("__id"), docs[text_col].alias("__text")).mapInArrow(winnow, f"id {id_type}, digest long, n_words long, start long, length long, fp long, span string")
    return rows.join(known.select("fp", "span", "items"), ["fp", "span"], "left").groupBy("id", "digest", "n_words").agg(
        F.count(F.when(F.col("start") < 0, 1)).alias("copies"),
        F.array_sort(F.collect_set(F.when(F.col("items").isNotNull(), F.struct("start", (F.col("start") + F.col("length")).alias("end"))))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: n_words, n_hit, items (ids as sorted strings), spans (merged word ranges), contaminated. Options are those of hits_of."""
    merged = F.aggregate(
        "hits",
        F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"),
        lambda done, x: F.when((F.size(done) > 0) & (F.element_at(done, -1)["end"] >= x["start"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end"))))).otherwise(
            F.concat(done, F.array(x))
        ),
    )
    # words hit, and the end of what is counted
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    longer = lambda done, x: F.struct((done["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(done["upto"], x["start"]))).alias("n"), F.greatest(done["upto"], x["end"]).alias("upto"))
    n_hit = F.aggregate("hits", none, longer, lambda done: done["n"])
    found = hits_of(docs, bench, id_col, text_col, **options).withColumn("copy", F.explode(F.expr("array_repeat(1, cast(copies as int))")))
    return found.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), "items", merged.alias("spans"), (F.size("hits") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose text holds no span of the benchmark, with all their columns; a row goes by its own id and text."""
    gone = hits_of(docs, bench, id_col, text_col).where(F.size("hits") > 0).select("id", "digest")
    return C.rows_of(docs, C.saved(gone, "contaminated"), id_col, text_col)[0]
