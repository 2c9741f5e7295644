"""Quality rules by repetition coverage.

Rolling hashes of n-grams of several lengths (in numpy, over whole texts) find the
words that lie in a repeated n-gram of their document; the characters of those
words, and of lines that repeat an earlier line, are set against all characters of
the document's words. A map over rows: no shuffle, memory of one piece of rows.

A longer n-gram can only repeat where its first words repeat, so lengths beyond the
first look at the starts left over by the length before.

Defined results: a null text has no words (all counts 0, base_failed, not kept); an
empty one likewise. Repeated rows are judged one by one. Other columns are ignored
by `repetition_coverage` and kept as they are by `keep_quality`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from keyfold.llm import common as C


@dataclass(frozen=True)
class Rules:
    """Limits as shares of all word characters; a document above any of them is rejected."""

    #: (n, share of characters inside n-grams found twice or more)
    grams: tuple[tuple[int, float], ...] = ((5, 0.30), (6, 0.28), (7, 0.26), (8, 0.24), (9, 0.22), (10, 0.20))
    line_chars: float = 0.30
    symbols_per_word: float = 0.30
    min_words: int = 10
    repeat_percent: int = 20


#: Bytes that are not the first of a code point.
_TAIL = C.byte_table(lambda b: 0x80 <= b <= 0xBF)
#: The symbols `[#*$%&|<>]`.
_SYMBOL = C.byte_table(lambda b: b in b"#*$%&|<>")


def measure(column: pa.Array, rules: Rules) -> dict[str, np.ndarray]:
    """Counts and shares of each text of a column."""
    data, off = C.text_buffer(column)
    rows = len(off) - 1
    starts, ends = C.runs(C.SPACED[data], off)
    first = C.per_row(starts, off)
    n_words = np.diff(first)
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~_TAIL[data], out=heads[1:])
    chars = heads[ends] - heads[starts]
    word_chars = C.sums(chars, first)
    words = C.span_hashes(data, starts, ends)
    of_row = np.repeat(np.arange(rows), n_words)

    share: dict[int, np.ndarray] = {}
    n_repeat = np.zeros(rows, np.int64)
    left = None
    for n in sorted({5, *(n for n, _ in rules.grams)}):  # n_repeat_words goes by five words whatever the rules
        grams = C.gram_hashes(words, n)
        at = np.flatnonzero(C.gram_rows(first, n, len(words)))
        if left is not None:
            at = at[left[at]]
        left = np.zeros(len(words) + 1, bool)
        if len(at):
            key = C.mix(grams[at] + of_row[at].astype(np.uint64) * np.uint64(C._STEP))
            order = np.argsort(key, kind="stable")
            same = key[order][1:] == key[order][:-1]
            twice = np.zeros(len(at), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            at = at[twice]
            left[at] = True
        hit = C.covered(at, n, len(words)) if len(words) else np.zeros(0, bool)
        share[n] = C.sums(np.where(hit, chars, 0), first) / np.maximum(word_chars, 1)
        if n == 5:
            n_repeat = C.sums(hit, first)

    line_starts, line_ends = C.runs(data != 0x0A, off)
    n_lines, line_share = _repeated_lines(data, line_starts, line_ends, off, starts, chars)
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": C.sums(_SYMBOL[data], off),
        "n_dup_lines": n_lines,
        "n_repeat_words": n_repeat,
        "line_share": line_share / np.maximum(word_chars, 1),
        **{f"gram{n}_share": v for n, v in share.items()},
    }


def _repeated_lines(data, line_starts, line_ends, off, starts, chars) -> tuple[np.ndarray, np.ndarray]:
    """Of each row: lines with a word that equal an earlier line, and the word characters in them."""
    rows = len(off) - 1
    at = np.searchsorted(starts, line_starts)
    to = np.searchsorted(starts, line_ends)
    some = to > at
    line_starts, line_ends, at, to = line_starts[some], line_ends[some], at[some], to[some]
    if not len(at):
        return np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    of_row = np.searchsorted(off, line_starts, side="right") - 1
    key = C.mix(C.span_hashes(data, line_starts, line_ends) + of_row.astype(np.uint64) * np.uint64(C._STEP))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:][key[order][1:] == key[order][:-1]]] = True
    total = np.zeros(len(chars) + 1, np.int64)
    np.cumsum(chars, out=total[1:])
    count = np.bincount(of_row[again], minlength=rows)
    inside = np.bincount(of_row[again], weights=(total[to] - total[at])[again], minlength=rows)
    return count.astype(np.int64), inside.astype(np.int64)


def verdicts(m: dict[str, np.ndarray], rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept)."""
    base_failed = (m["n_words"] < rules.min_words) | (100 * m["n_repeat_words"] > rules.repeat_percent * m["n_words"])
    bad = (m["line_share"] > rules.line_chars) | (m["n_symbols"] > rules.symbols_per_word * m["n_words"])
    for n, most in rules.grams:
        bad |= m[f"gram{n}_share"] > most
    return base_failed, ~base_failed & ~bad


def repetition_coverage(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """One row per document: counts, repetition shares and the verdict."""
    shares = ["line_share", *(f"gram{n}_share" for n, _ in sorted(rules.grams))]
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, " + ", ".join(f"{c} long" for c in counts) + ", base_failed boolean, kept boolean, " + ", ".join(f"{c} double" for c in shares)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in C.pieces(batches, "__text"):
            m = measure(piece.column("__text"), rules)
            base_failed, kept = verdicts(m, rules)
            columns = [piece.column("__id"), *(pa.array(m[c], pa.int64()) for c in counts), pa.array(base_failed), pa.array(kept), *(pa.array(m[c]) for c in shares)]
            yield pa.RecordBatch.from_arrays(columns, [id_col, *counts, "base_failed", "kept", *shares])

    return docs.select(docs[id_col].alias("__id"), docs[text_col].alias("__text")).mapInArrow(judge, schema)


def keep_quality(docs: DataFrame, text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The documents that pass, with all their columns."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in C.pieces(batches, text_col):
            yield piece.filter(pa.array(verdicts(measure(piece.column(text_col), rules), rules)[1]))

    return docs.mapInArrow(judge, docs.schema)
