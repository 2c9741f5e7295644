"""Best-fit packing of tokenised documents, with certified bin counts.

1. A map tokenises whole texts and cuts only those longer than a sequence; what goes
   on is a row of some 40 bytes per piece, written to the shared folder.
2. Pieces are dealt evenly into partitions of bounded size. Each runs best-fit
   decreasing and computes lower bounds from dual-feasible functions; a partition
   whose number of sequences equals its bound is certified: no packing of it is
   smaller.
3. Partitions with a gap give up the documents of their sequences that are not full;
   these are pooled, dealt anew and packed again, as long as that saves sequences and
   for `rounds` rounds at most. The rest stays as packed.

Defined results: a null text is the separator token alone, like an empty one; repeated
rows are packed one by one; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.llm import common as C

SEQUENCE = 2048
PARTITION_PIECES = 16_384
#: The faster library's time grows with the square of a run of blanks, and in the end it runs out of stack.
BLANKS = 500
_BLANKS = re.compile(r"(?<!\s)\s{%d}" % BLANKS)


@dataclass(frozen=True)
class Tokenizer:
    """A byte-level BPE vocabulary by file names of `public_tokenizers`, or by paths.

    The same ids are found by two libraries: the ranks file is the faster by far; a text
    with a special token's string goes to the other, which gives that token's own id, and
    so does a text with a very long run of blanks, which only the other can split.
    """

    json: str = "byte_bpe_50k.json"
    ranks: str = "byte_bpe_50k.tiktoken"
    special: str = "<|endoftext|>"

    def _path(self, name: str) -> str:
        import public_tokenizers

        return name if "/" in name else public_tokenizers.path(name)

    def encoder(self):
        """A function from text to ids; made once in a task."""
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer as Plain

        with open(self._path(self.ranks), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        slow: list = []

        def encode(text: str) -> list[int]:
            if self.special not in text and not (len(text) >= BLANKS and _BLANKS.search(text)):
                return fast.encode_ordinary(text)
            if not slow:
                slow.append(Plain.from_file(self._path(self.json)))
            return slow[0].encode(text, add_special_tokens=False).ids

        return encode


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: Tokenizer = Tokenizer(), sequence: int = SEQUENCE, separator: int = 0) -> DataFrame:
    """(id, piece, start, length, ids_crc32): the first piece of a long document takes the remainder."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer.encoder()
        for piece in C.pieces(batches, "__text"):
            row, number, start, length, crc = [], [], [], [], []
            for r, text in enumerate(piece.column("__text").to_pylist()):
                ids = np.array([*encode(text or ""), separator], "<u4").tobytes()
                total = len(ids) // 4
                at, k = 0, 0
                while at < total:
                    size = (total % sequence or sequence) if k == 0 else sequence
                    row.append(r), number.append(k), start.append(at), length.append(size)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                    at, k = at + size, k + 1
            yield pa.RecordBatch.from_arrays(
                [pc.take(piece.column("__id"), pa.array(row, pa.int64())), pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], [id_col, "piece", "start", "length", "ids_crc32"]
            )

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("__id"), docs[text_col].alias("__text")).mapInArrow(work, f"`{id_col}` {id_type}, piece int, start long, length long, ids_crc32 long")


# ---------------------------------------------------------------- one partition


def lower_bound(counts: np.ndarray, sequence: int = SEQUENCE) -> int:
    """Least number of sequences for counts[s] pieces of each size s, by dual-feasible functions."""
    size = np.arange(sequence + 1)
    total = np.concatenate(([0], np.cumsum(counts * size)))
    number = np.concatenate(([0], np.cumsum(counts)))
    between = lambda sums, a, b: int(sums[b + 1] - sums[a])  # noqa: E731  sizes a to b
    best = -(-between(total, 0, sequence) // sequence)
    half = sequence // 2
    for t in range(1, half + 1):  # sizes above sequence - t count as a whole sequence, below t as nothing
        large = between(number, half + 1, sequence)
        room = between(number, half + 1, sequence - t) * sequence - between(total, half + 1, sequence - t)
        best = max(best, large + max(0, -(-(between(total, t, half) - room) // sequence)))
    for k in range(1, 33):  # floor((k + 1) x) / k, but x where (k + 1) x is whole
        scaled = (k + 1) * size
        value = np.where(scaled % sequence == 0, k * size, sequence * (scaled // sequence))
        best = max(best, -(-int((counts * value).sum()) // (k * sequence)))
    return best


def best_fit_decreasing(lengths: np.ndarray, sequence: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each piece, and how full each bin is."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets, fill = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    open_bins: list[list[int]] = [[] for _ in range(sequence + 1)]
    free = 0  # bit r: some bin has r tokens left
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = free >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                free ^= 1 << room
        else:
            room, b = sequence, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
        if room > size:
            open_bins[room - size].append(b)
            free |= 1 << (room - size)
    return bins, offsets, np.array(fill, np.int64)


# ---------------------------------------------------------------- rounds


def _packed(pieces: DataFrame, count: int, round_no: int, sequence: int, partition_pieces: int) -> DataFrame:
    """The pieces dealt evenly and packed: with part, bin, offset, fill, bins and bound of the part."""
    parts = max(1, -(-count // partition_pieces))
    own = [c for c in pieces.columns if c not in ("part", "round", "bin", "offset", "fill", "bins", "bound")]
    dealt = pieces.select(*own, F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(round_no)), F.lit(parts)).cast("int").alias("part"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema) + ", round int, bin long, offset long, fill long, bins long, bound long"

    def pack(group: pa.Table) -> pa.Table:
        lengths = group.column("length").to_numpy()
        bins, offsets, fill = best_fit_decreasing(lengths, sequence)
        bound = lower_bound(np.bincount(lengths, minlength=sequence + 1), sequence)
        n = len(lengths)
        for name, values in (("round", np.full(n, round_no, np.int32)), ("bin", bins), ("offset", offsets), ("fill", fill[bins]), ("bins", np.full(n, len(fill))), ("bound", np.full(n, bound))):
            group = group.append_column(name, pa.array(values))
        return group

    return dealt.groupBy("part").applyInArrow(pack, schema)


def pack(pieces: DataFrame, sequence: int = SEQUENCE, partition_pieces: int = PARTITION_PIECES, rounds: int = 3) -> DataFrame:
    """All columns of pieces, then sequence_id, offset, certified. pieces has length."""
    count = pieces.count()
    current = C.saved(_packed(pieces, count, 0, sequence, partition_pieces), "packed-0")
    done = None
    for n in range(1, rounds + 1):
        kept = current.where("bins <= bound or fill = %d" % sequence)
        loose = C.saved(current.where("bins > bound and fill < %d" % sequence), f"loose-{n}")
        before = loose.select("part", "bin").distinct().count()
        pool = loose.count()
        if before < 2:
            break
        again = C.saved(_packed(loose, pool, n, sequence, partition_pieces), f"packed-{n}")
        after = again.select("part", "bin").distinct().count()
        if after >= before:
            break
        done = kept if done is None else done.unionByName(kept)
        current = again
    whole = current if done is None else done.unionByName(current)
    sequence_id = F.col("round").cast("long") * (1 << 56) + F.col("part").cast("long") * (1 << 28) + F.col("bin")
    return whole.select(*pieces.columns, sequence_id.alias("sequence_id"), "offset", (F.col("bins") == F.col("bound")).alias("certified"))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: Tokenizer = Tokenizer(), sequence: int = SEQUENCE, partition_pieces: int = PARTITION_PIECES) -> DataFrame:
    pieces = C.saved(token_pieces(docs, id_col, text_col, tokenizer, sequence), "pieces")
    return pack(pieces, sequence, partition_pieces)
