"""Language-model scoring by context-tree weighting over bytes.

A text is its bytes, A-Z lower-cased, then one end symbol (0xFF, which UTF-8 never
has); it starts after `DEPTH` end symbols. Each byte is eight binary decisions, each
made in every context of 0 to DEPTH bytes. A node (context, bits so far) has the
Krichevsky-Trofimov estimate of its counts; the tree mixes the estimates of all depths
with the weights that the training text gives them:

    P(node) = 1/2 KT(node) + 1/2 product of P(children),   weight = 1/2 KT(node) / P(node)

Training: a map counts byte n-grams of all texts (0 times in those held out) and words
of training texts, combined within the task, and Spark sums them; the tree is then
built from the deepest level up, one aggregation a level. Nothing is sampled.

Scoring: each distinct n-gram of the corpus gets its log10 probability once, from the
whole tree: nodes and n-grams are dealt by the hash of the nearest `NEAR` context bytes,
so that a task has all deeper nodes that its n-grams can meet; the shallower ones, whose
number has a bound, go to all tasks. A node that was not seen has probability 1/2, as an
estimate without counts has. Every decision is a distribution, so scores are
probabilities. Texts are then read once: the values of frequent n-grams (2**j or more
occurrences, with the smallest j that leaves at most `TOP_NGRAMS`) go along; of the other
n-grams each text gives a row with its number of occurrences, which is joined with the
n-gram's value. Nothing is left out, and texts themselves are not shuffled.

Base score: the same with words, their counts and `TOP_WORDS`.

Defined results: a null text is empty (the end symbol alone is scored); a null id
hashes as the empty string; repeated rows give one row each; without training
documents each decision has probability 1/2 and base_score is 0 a token.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfold.llm import common as C

DEPTH = 5
#: Nodes of contexts of fewer bytes go to all tasks.
NEAR = 3
#: Nodes and n-grams scored in a task.
DEALT = 1 << 20
#: N-grams and words whose values go to all tasks.
TOP_NGRAMS, TOP_WORDS = 2 << 20, 1 << 20
#: Symbols handled at once: one takes some 100 bytes on the way.
PIECE = 1 << 19
_U = np.uint64
_END_WORD = C.mix(np.array([0xE4D], _U))[0]
_NGRAM, _WORD, _TEXT = 0, 1, 2

# ---------------------------------------------------------------- texts as symbols


class Symbols:
    """The symbols of rows of text, as n-grams: DEPTH context bytes and the symbol. Row i has those from bounds[i] to bounds[i + 1]."""

    def __init__(self, data: np.ndarray, off: np.ndarray) -> None:
        rows = np.arange(len(off) - 1)
        self.bounds = np.append(off[:-1] + rows, off[-1] + len(rows))
        gap, low = b"\xff" * DEPTH, C.LOWER[data].tobytes()
        self.framed = np.frombuffer(gap + gap.join(low[s:e] for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)) + gap, np.uint8)
        # after each row the first byte of the gap is its end symbol, the others are context only
        self.none = (np.add.outer(off[1:] + rows * DEPTH + 1, np.arange(DEPTH - 1))).ravel()

    def slices(self, step: int = 2 * PIECE) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the first symbol, n-grams), at most step at once, whatever the length of a text."""
        number = 0
        for first in range(0, len(self.framed) - DEPTH if len(self.bounds) > 1 else 0, step):
            n = min(step, len(self.framed) - DEPTH - first)
            grams = self.framed[first : first + n].astype(_U)
            for j in range(1, DEPTH + 1):
                grams <<= _U(8)
                grams |= self.framed[first + j : first + j + n]
            keep = np.ones(n, bool)
            keep[self.none[slice(*np.searchsorted(self.none, [first, first + n]))] - first] = False
            grams = grams[keep]
            if len(grams):
                yield number, grams
            number += len(grams)

    def sums(self, first: int, values: np.ndarray) -> np.ndarray:
        """Sums by row of a slice's values."""
        out = np.zeros(len(self.bounds) - 1)
        low, high = np.searchsorted(self.bounds, [first, first + len(values) - 1], side="right") - 1
        out[low : high + 1] = np.add.reduceat(values, np.maximum(self.bounds[low : high + 1] - first, 0))
        return out


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all rows, bounds of the rows), the end token left out."""
    low = C.LOWER[data]
    starts, ends = C.runs(C.SPACED[low], off)
    return C.span_hashes(low, starts, ends), C.per_row(starts, off)


class Tally:
    """Counts of 64-bit keys, combined whenever many have gathered."""

    def __init__(self, most: int = 1_000_000) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held, self.most = 0, most

    def add(self, keys: np.ndarray, times: int = 1) -> None:
        """Each key counts `times`; with 0 it is only known to occur."""
        keys = np.sort(keys)
        at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        self.parts.append((keys[at], np.diff(np.append(at, len(keys))) * times))
        self.held += len(at)

    def full(self) -> bool:
        return self.held > self.most and self.combine() > self.most // 2

    def combine(self) -> int:
        if self.parts:
            keys, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
            self.parts = [(keys[at], np.add.reduceat(n[order], at) if len(at) else n)]
            self.held = len(at)
        return self.held

    def take(self, step: int = 100_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self.combine()
        for keys, n in self.parts:
            for i in range(0, len(keys), step):
                yield keys[i : i + step], n[i : i + step]
        self.parts, self.held = [], 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tallies = {_NGRAM: Tally(), _WORD: Tally()}
    texts = 0

    def out(kind):
        for keys, n in tallies[kind].take():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n)], ["kind", "key", "n"])

    for piece in C.pieces(batches, "text", PIECE):
        held = piece.filter(piece.column("held"))
        for _, grams in Symbols(*C.text_buffer(held.column("text"))).slices() if held.num_rows else ():
            tallies[_NGRAM].add(grams, 0)
            if tallies[_NGRAM].full():
                yield from out(_NGRAM)
        piece = piece.filter(pc.invert(piece.column("held")))
        if not piece.num_rows:
            continue
        data, off = C.text_buffer(piece.column("text"))
        texts += piece.num_rows
        for _, grams in Symbols(data, off).slices():
            tallies[_NGRAM].add(grams)
            if tallies[_NGRAM].full():
                yield from out(_NGRAM)
        tallies[_WORD].add(tokens(data, off)[0])
        if tallies[_WORD].full():
            yield from out(_WORD)
    for kind in tallies:
        yield from out(kind)
    if texts:
        yield pa.RecordBatch.from_arrays([pa.array([_TEXT], pa.int32()), pa.array([0], pa.int64()), pa.array([texts], pa.int64())], ["kind", "key", "n"])


# ---------------------------------------------------------------- the tree


def _lgamma(x: Column) -> Column:
    """ln of the gamma function by Stirling's series at x + 8."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y)
    product = x
    for i in range(1, 8):
        product = product * (x + i)
    return series - F.log(product)


def _ln_kt(zeros: Column, ones: Column) -> Column:
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1.0) - math.log(math.pi)


def tree_levels(ngrams: DataFrame) -> list[DataFrame]:
    """Nodes by depth, deepest first: (node, zeros, ones, ratio); ratio = ln KT(node) - ln P(children), null at the deepest.

    ngrams: (key, n). A node is context bytes << 8 | (1 and the bits so far).
    """
    bits = ngrams.select("key", "n", F.explode(F.array(*(F.lit(k) for k in range(8)))).alias("k"))
    prefix = F.expr("shiftleft(1L, k) | shiftright(key & 255, 8 - k)")
    one = F.expr("shiftright(key & 255, 7 - k) & 1")
    nodes = bits.select(F.expr("key & ~255L").bitwiseOR(prefix).alias("node"), ((1 - one) * F.col("n")).alias("zeros"), (one * F.col("n")).alias("ones"))
    nodes = nodes.groupBy("node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.lit(None).cast("double").alias("below"))
    levels = []
    for depth in range(DEPTH, -1, -1):
        kt = nodes.withColumn("kt", _ln_kt(F.col("zeros").cast("double"), F.col("ones").cast("double")))
        high, low = F.greatest("kt", "below"), F.least("kt", "below")
        total = F.when(F.col("below").isNull(), F.col("kt")).otherwise(high + F.log1p(F.exp(low - high)) - math.log(2))
        level = C.saved(kt.select("node", "zeros", "ones", (F.col("kt") - F.col("below")).alias("ratio"), total.alias("total")), f"tree-{depth}")
        levels.append(level.select("node", "zeros", "ones", "ratio"))
        if depth:
            parent = F.col("node").bitwiseAND((1 << (8 * depth)) - 1)  # without the byte farthest away
            nodes = level.groupBy(parent.alias("node")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("total").alias("below"))
    return levels


def node_keys(node: np.ndarray, depth: int) -> np.ndarray:
    return node | _U((depth + 1) << 56)


def least_power(rows: DataFrame, number: str, most: int) -> int:
    """The smallest j so that at most `most` rows have 2**j or more of number."""
    power = F.floor(F.log2(number)).cast("int")
    sizes = {r["j"]: r["n"] for r in rows.groupBy(power.alias("j")).agg(F.count("*").alias("n")).collect()}  # 64 rows at most
    j, total = max(sizes, default=0) + 1, 0
    while j > 0 and total + sizes.get(j - 1, 0) <= most:
        j -= 1
        total += sizes.get(j, 0)
    return j


class Index:
    """64-bit keys by open addressing: the cell of each. Made for a number of distinct keys, which are added in parts."""

    def __init__(self, most: int) -> None:
        self.size = 1 << max(4, (most * 4 // 3).bit_length())
        self.keys, self.used = np.zeros(self.size, _U), np.zeros(self.size, bool)

    def add(self, keys: np.ndarray) -> np.ndarray:
        """The new cells."""
        cells = np.zeros(len(keys), np.int64)
        left, at = np.arange(len(keys)), self._first(keys)
        while len(left):
            free = ~self.used[at]
            self.keys[at[free]] = keys[left[free]]
            self.used[at[free]] = True
            mine = free & (self.keys[at] == keys[left])
            cells[left[mine]] = at[mine]
            left, at = left[~mine], (at[~mine] + 1) & (self.size - 1)
        return cells

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return (C.mix(keys) & _U(self.size - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The cell, or -1."""
        at = self._first(keys)
        out = np.where(self.used[at], np.where(self.keys[at] == keys, at, -2), -1)
        left = np.flatnonzero(out == -2)
        at = at[left]
        while len(left):
            at = (at + 1) & (self.size - 1)
            new = np.where(self.used[at], np.where(self.keys[at] == keys[left], at, -2), -1)
            out[left] = new
            left, at = left[new == -2], at[new == -2]
        return out


def parts(n: int, step: int = 1 << 17) -> list[slice]:
    return [slice(i, i + step) for i in range(0, n, step)]


class Model:
    """Of each node: the probability of a one, and the weight of stopping there."""

    def __init__(self, keys: np.ndarray, p: np.ndarray, w: np.ndarray) -> None:
        self.index = Index(len(keys))
        self.values = np.zeros((self.index.size, 2))
        for part in parts(len(keys)):
            cells = self.index.add(keys[part])
            self.values[cells, 0], self.values[cells, 1] = p[part], w[part]


def weighted(levels: list[DataFrame]) -> list[DataFrame]:
    """Nodes by depth, deepest first: (key, p, w), what Model takes."""
    weight = F.when(F.col("ratio").isNull(), 1.0).otherwise(1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.col("ratio")))))
    p = (F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1)
    keys = [F.col("node").bitwiseOR(F.lit((depth + 1) << 56)) for depth in range(DEPTH, -1, -1)]
    return [level.select(key.alias("key"), p.alias("p"), weight.alias("w")) for key, level in zip(keys, levels, strict=True)]


def ngram_scores(ngrams: DataFrame, levels: list[DataFrame], dealt: int = DEALT) -> DataFrame:
    """(key, n, value): log10 probability of each n-gram's symbol by the whole tree. ngrams: (key, n), keys distinct."""
    nodes = weighted(levels)
    rows = ngrams.select("key", "n", F.lit(None).cast("double").alias("p"), F.lit(None).cast("double").alias("w"))
    for level in nodes[: DEPTH + 1 - NEAR]:
        rows = rows.unionByName(level, allowMissingColumns=True)
    near = F.shiftright("key", 8).bitwiseAND((1 << (8 * NEAR)) - 1)
    rows = rows.withColumn("part", F.pmod(F.xxhash64(near), F.lit(-(-rows.count() // dealt) or 1)))
    few = nodes[DEPTH + 1 - NEAR]
    for level in nodes[DEPTH + 2 - NEAR :]:
        few = few.unionByName(level)
    got = few.toArrow()  # contexts of less than NEAR bytes
    shallow = ngrams.sparkSession.sparkContext.broadcast((got.column("key").to_numpy().view(_U), got.column("p").to_numpy(), got.column("w").to_numpy()))

    def work(group: pa.Table) -> pa.Table:
        is_node = group.column("p").is_valid().to_numpy()
        keys = group.column("key").to_numpy().view(_U)
        own = (keys[is_node], *(group.column(c).drop_null().to_numpy() for c in ("p", "w")))
        model = Model(*(np.concatenate(x) for x in zip(shallow.value, own, strict=True)))
        grams = keys[~is_node]
        order = np.argsort(grams)
        grams = grams[order]
        value = np.concatenate([np.zeros(0), *(log_probabilities(model, grams[part]) for part in parts(len(grams), 65536))])
        return pa.table({"key": grams.view(np.int64), "n": group.column("n").drop_null().to_numpy()[order], "value": value})

    scores = C.saved(rows.groupBy("part").applyInArrow(work, "key long, n long, value double"), "ngram-scores")
    shallow.destroy()
    return scores


def log_probabilities(model: Model, grams: np.ndarray) -> np.ndarray:
    """log10 probability of the last symbol of each n-gram."""
    out = np.zeros(len(grams))
    for k in range(8):
        prefix = (_U(1) << _U(k)) | ((grams & _U(255)) >> _U(8 - k))
        one = (grams >> _U(7 - k)) & _U(1) == 1
        p = np.full(len(grams), 0.5)
        for depth in range(DEPTH, -1, -1):
            context = grams & _U(((1 << (8 * depth)) - 1) << 8)
            cell = model.index.find(node_keys(context | prefix, depth))
            got = model.values[cell]
            p = np.where(cell >= 0, got[:, 1] * got[:, 0] + (1 - got[:, 1]) * p, p)
        out += np.log10(np.where(one, p, 1 - p))
    return out


# ---------------------------------------------------------------- what goes to all tasks


class Known:
    """64-bit keys to numbers above or below 0."""

    def __init__(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        self.index = Index(len(keys))
        self.numbers = np.zeros(self.index.size, numbers.dtype)
        for part in parts(len(keys)):
            self.numbers[self.index.add(keys[part])] = numbers[part]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number, or 0."""
        out = np.zeros(len(keys), self.numbers.dtype)
        for part in parts(len(keys)):
            cell = self.index.find(keys[part])
            out[part] = np.where(cell >= 0, self.numbers[cell], 0)
        return out


def frequent(rows: DataFrame, number: str, most: int) -> tuple[Known, DataFrame]:
    """(key to number of the most frequent rows, the other rows). rows: key, n, and the number."""
    least = 1 << least_power(rows, "n", most)
    got = rows.where(F.col("n") >= least).select("key", number).toArrow()
    return Known(got.column("key").to_numpy().view(_U), got.column(number).to_numpy()), rows.where(F.col("n") < least)


def tallied(row: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, times) of the distinct pairs."""
    order = np.lexsort((keys, row))
    row, keys = row[order], keys[order]
    new = np.ones(len(row), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return row[at], keys[at], np.diff(np.append(at, len(row)))


# ---------------------------------------------------------------- scores


def held_out(id_col: str, folds: int = 7, fold: int = 2) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds == fold


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, fold: int = 2, dealt: int = DEALT, top_ngrams: int = TOP_NGRAMS, top_words: int = TOP_WORDS) -> DataFrame:
    """One row per document: held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    spark = docs.sparkSession
    docs = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    counted = docs.select("text", held_out("id", folds, fold).alias("held")).mapInArrow(_count, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    counted = C.saved(counted, "counts")
    totals = {r["kind"]: (r["v"], r["n"]) for r in counted.groupBy("kind").agg(F.count("*").alias("v"), F.sum("n").alias("n")).collect()}
    texts = totals.get(_TEXT, (0, 0))[1]
    n = totals.get(_WORD, (0, 0))[1] + texts
    v = totals.get(_WORD, (0, 0))[0] + (texts > 0)
    ngrams = counted.where(F.col("kind") == _NGRAM)
    # n-grams of held-out texts alone count as one
    scores = ngram_scores(ngrams.select("key", F.greatest("n", F.lit(1)).alias("n")), tree_levels(ngrams.where("n > 0").select("key", "n")), dealt)
    known_ngrams, other_ngrams = frequent(scores, "value", top_ngrams)
    known_words, other_words = frequent(counted.where(F.col("kind") == _WORD).select("key", "n"), "n", top_words)
    known = spark.sparkContext.broadcast((known_ngrams, known_words))
    floor = math.log10(n + v + 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        values, counts = known.value
        for piece in C.pieces(batches, "text", PIECE):
            data, off = C.text_buffer(piece.column("text"))
            digest = np.array([xxhash.xxh64_intdigest(data[s:e].tobytes()) for s, e in zip(off[:-1], off[1:], strict=True)], _U)
            text = Symbols(data, off)
            rows, score = np.arange(piece.num_rows), np.zeros(piece.num_rows)
            others: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = [(_TEXT, rows, digest, np.zeros(len(rows), np.int64))]
            for first, grams in text.slices():
                value = values.find(grams)
                score += text.sums(first, value)
                if len(rare := np.flatnonzero(value == 0)):
                    row = np.searchsorted(text.bounds, first + rare, side="right") - 1
                    others.append((_NGRAM, *tallied(row, grams[rare])))
            keys, first = tokens(data, off)
            count = counts.find(keys)
            row = np.repeat(rows, np.diff(first))
            sure = count > 0
            logs = np.bincount(row[sure], np.log10(count[sure] + 1.0), minlength=len(rows)) + math.log10(texts + 1)
            n_known = np.bincount(row[sure], minlength=len(rows)) + (texts > 0)
            others.append((_WORD, *tallied(row[~sure], keys[~sure])))
            more = sum(len(x[1]) for x in others) - len(rows)  # the rows beside those of the texts themselves
            of_text = lambda x: np.concatenate([x, np.zeros(more, x.dtype)])
            row = np.concatenate([x[1] for x in others])
            columns = {
                "id": pc.take(piece.column("id"), pa.array(row)),
                "digest": digest[row].view(np.int64),
                "kind": np.concatenate([np.full(len(x[1]), x[0], np.int32) for x in others]),
                "key": np.concatenate([x[2] for x in others]).view(np.int64),
                "times": np.concatenate([x[3] for x in others]),
                "n_tokens": of_text(np.diff(first) + 1),
                "n_known": of_text(n_known),
                "logs": of_text(logs),
                "score": of_text(score),
                "symbols": of_text(np.diff(text.bounds)),
            }
            yield pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in columns.values()], list(columns))

    id_type = docs.schema["id"].dataType.simpleString()
    rows = docs.mapInArrow(work, f"id {id_type}, digest long, kind int, key long, times long, n_tokens long, n_known long, logs double, score double, symbols long")
    rows = C.saved(rows, "scores")  # scored once, whatever is lost later; what went along can go
    known.destroy()
    number = lambda kind, c: F.lit(None).cast(kind).alias(c)
    others = other_words.select(F.lit(_WORD).alias("kind"), "key", "n", number("double", "value")).unionByName(other_ngrams.select(F.lit(_NGRAM).alias("kind"), "key", number("long", "n"), "value"))
    joined = rows.join(others, ["kind", "key"], "left")
    is_word, times = F.col("kind") == _WORD, F.col("times")
    texts_of = joined.groupBy("id", "digest").agg(
        F.count(F.when(F.col("kind") == _TEXT, 1)).alias("copies"),
        F.max("n_tokens").alias("n_tokens"),
        F.max(F.when(F.col("kind") == _TEXT, F.col("n_known"))).alias("sure"),
        F.max(F.when(F.col("kind") == _TEXT, F.col("logs"))).alias("logs"),
        F.sum(F.col("score") + F.coalesce(times * F.col("value"), F.lit(0.0))).alias("score"),
        F.max("symbols").alias("symbols"),
        F.sum(F.when(is_word & (F.col("n") > 0), times)).alias("known"),
        F.sum(F.when(is_word, times * F.log10(F.coalesce("n", F.lit(0)) + 1.0))).alias("more"),
    )
    copies = F.col("copies")
    return texts_of.withColumn("copy", F.explode(F.expr("array_repeat(1, cast(copies as int))"))).select(
        F.col("id").alias(id_col),
        held_out("id", folds, fold).alias("held_out"),
        "n_tokens",
        (F.col("sure") + F.coalesce((F.col("known") / copies).cast("long"), F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce(F.col("more") / copies, F.lit(0.0)) - F.col("n_tokens") * floor).alias("base_score"),
        (F.col("score") / copies).alias("score"),
        (-F.col("score") / copies * math.log2(10) / F.col("symbols")).alias("bits_per_byte"),
    )
