"""SimHash near-duplicates with pivot distance tables.

1. Each text's 64-bit fingerprint is computed in a map (numpy, XXH64 of the shingles)
   and written to a table in the shared folder: 16 bytes a document.
2. Distinct fingerprints only go on; copies of a text never meet as pairs.
3. Two fingerprints within `distance` bits agree on all bits of at least
   `blocks - distance` of `blocks` bit blocks, so each fingerprint is sent to one
   bucket per choice of that many blocks: 15 buckets of 21 bits for 6 blocks. Beyond
   some hundred million fingerprints, 7 blocks (35 buckets of 27 bits) keep buckets
   small; the results are the same.
4. In a bucket, each fingerprint has its row of the pivot table: Hamming distances to
   `PIVOTS` reference fingerprints. By the triangle inequality no coordinate of a
   linked pair differs by more than `distance`: sorted by the first coordinate, only
   that band is looked at, pairs with a larger difference in any coordinate are
   discarded, and survivors are verified bit by bit. A bucket gives out a spanning
   forest of its links, not its pairs.
5. Buckets above `bucket_rows` are cut by blocks of the bits that are left, likewise
   without loss. What is hot even so has 35 bits in common; its rows are cut into parts
   whose pairs are shared out over tasks, so it is neither one task nor capped.
6. Components: labels spread to neighbours and are jumped through until nothing
   changes; each round is written to the shared folder.

Pivots alone can't find candidates here: distances between unrelated 64-bit
fingerprints lie within 32 +- 4, so a distance of 4 hardly splits them. The bit blocks
supply candidates without loss, the pivot table discards, the exact check decides.

`near_copies` finds texts whose sets of five-word shingles have a Jaccard similarity of
0.8 or more, which differ in some 15% of all bits, too many for bit blocks without loss:

1. Fingerprints of `LANES` * 64 bits over the distinct shingles. Two choices of the bits
   are cut into 16-bit values, 64 in all: a pair at 0.8 shares one of them with a
   probability of 0.99, at 0.85 of 0.999, at 0.9 of almost 1.
2. In a bucket, whose rows bring `CARRIED` lanes, pivots are rows of the bucket. Of the
   pairs within the widest distance that a similarity of 0.8 makes likely (four standard
   deviations) a bucket gives out a minimum spanning forest: the nearest links that join
   what all its pairs join.
3. Links so near in all lanes that a similarity below 0.8 is out of question (three
   standard deviations) hold. The others are verified by their shingle sets, the nearest
   of each component first, until no link between two components is open.

Defined results: null or empty texts have fingerprint 0 and link like any other; rows
that share an id are one document if their texts are equal, else each row counts with
its own fingerprint; a null id links like any other, is never the smallest, and stands
for a component only if there is no other id; the empty table gives an empty result.
`drop_near_duplicates` decides by row: of each component the row with the smallest id
stays (of several texts with that id one, of rows that repeat id and text one).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyfold.llm import common as C

SEED = 42
PIVOTS = 16
#: Of the long fingerprints: 64-bit lanes, those that go along into buckets, bits of a bucket.
LANES, CARRIED, VALUE = 8, 4, 16
#: Shingles hashed, and pairs of a bucket compared, at once.
SHINGLES, PAIRS = 1 << 18, 1 << 21
_U = np.uint64


def fingerprints_of(column: pa.Array, words: int = 4) -> np.ndarray:
    """Fingerprint of each text: bit b is set if over half of its shingles' hashes have it."""
    import xxhash

    data, off = C.text_buffer(column)
    rows = len(off) - 1
    data = C.LOWER[data]
    starts, ends = C.runs(C.SPACED[data], off)
    first = C.per_row(starts, off)
    # the words again, one space apart: a shingle is then one slice
    length = ends - starts
    place = np.zeros(len(length) + 1, np.int64)
    np.cumsum(length + 1, out=place[1:])
    plain = np.full(int(place[-1]), 0x20, np.uint8)
    inside = C.SPACED[data]
    where = np.arange(len(data))[inside] - np.repeat(starts - place[:-1], length)
    plain[where] = data[inside]
    buffer = plain.tobytes()
    count = np.maximum(np.diff(first) - words + 1, np.minimum(np.diff(first), 1))
    begin = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(int(count.sum()))
    last = np.minimum(begin + words, np.repeat(first[1:], count))
    digest = xxhash.xxh64_intdigest
    hashes = np.empty(len(begin), _U)
    for i in range(0, len(begin), SHINGLES):
        part = slice(i, i + SHINGLES)
        spans = zip(place[begin[part]].tolist(), (place[last[part]] - 1).tolist(), strict=True)
        hashes[part] = np.fromiter((digest(buffer[s:e], SEED) for s, e in spans), _U)
    of_row = np.repeat(np.arange(rows), count)
    out = np.zeros(rows, _U)
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
    for at in range(0, rows, 4096):  # a table of 256 byte values for each row and byte
        part = slice(*np.searchsorted(of_row, [at, at + 4096]))
        n = min(4096, rows - at)
        for byte in range(8):
            value = ((hashes[part] >> _U(8 * byte)) & _U(255)).astype(np.int64)
            table = np.bincount((of_row[part] - at) * 256 + value, minlength=n * 256).reshape(n, 256)
            ones = (table @ bits) * 2 > count[at : at + n, None]
            out[at : at + n] |= (ones @ (1 << np.arange(8))).astype(_U) << _U(8 * byte)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id, fp long): one row per document row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in C.pieces(batches, "__text"):
            yield pa.RecordBatch.from_arrays([piece.column("__id"), pa.array(fingerprints_of(piece.column("__text"), words).view(np.int64))], [id_col, "fp"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("__id"), docs[text_col].alias("__text")).mapInArrow(work, f"`{id_col}` {id_type}, fp long")


# ---------------------------------------------------------------- candidates and links


def block_masks(blocks: int, distance: int, shared: int = 0) -> list[int]:
    """Bits of each choice of the `blocks - distance` blocks of the bits beside `shared` that linked fingerprints have in common for sure."""
    left = [1 << i for i in range(64) if not shared >> i & 1]
    edges = [len(left) * i // blocks for i in range(blocks + 1)]
    masks = [sum(left[edges[i] : edges[i + 1]]) for i in range(blocks)]
    return [shared + sum(pick) for pick in combinations(masks, blocks - distance)]


def pivot_codes() -> np.ndarray:
    return C.mix(np.arange(1, PIVOTS + 1, dtype=_U) * _U(0xD1342543DE82EF95))


def pivot_table(fp: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to the pivots."""
    return np.bitwise_count(fp[:, None] ^ pivot_codes()[None, :]).astype(np.int8)


class Forest:
    """Union-find over the rows of one bucket."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def linked_pairs(fp: np.ndarray, side: np.ndarray, distance: int, table: np.ndarray | None = None, step: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within `distance`, found with the pivot table; if there are two sides, pairs across them only."""
    table = pivot_table(fp) if table is None else table
    across = bool(side.any())
    order = np.argsort(table[:, 0], kind="stable")
    fp, side, table = fp[order], side[order], table[order]
    reach = np.searchsorted(table[:, 0], table[:, 0] + distance, side="right")
    step = step or max(1, min(512, PAIRS // max(1, len(fp))))
    for i in range(0, len(fp), step):
        to = int(reach[min(i + step, len(fp)) - 1])
        a, b = np.nonzero(~np.tri(min(step, len(fp) - i), to - i, dtype=bool))
        a, b = a + i, b + i
        keep = b < reach[a]
        if across:
            keep &= side[a] != side[b]
        a, b = a[keep], b[keep]
        for p in range(1, PIVOTS):
            near = np.abs(table[a, p] - table[b, p]) <= distance
            a, b = a[near], b[near]
            if len(a) < 64:
                break
        near = np.bitwise_count(fp[a] ^ fp[b]) <= distance
        yield order[a[near]], order[b[near]]


def _bucket_links(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket; a bucket may go on in the next batch."""
    held = {k: [] for k in ("bucket", "part", "fp", "side")}

    def links(bucket, part, fp, side):
        cut = np.flatnonzero((bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])) + 1
        bounds = np.concatenate(([0], cut, [len(fp)]))
        size = np.diff(bounds)
        left, right = [], []
        two = bounds[:-1][size == 2]  # most buckets: one pair each, checked all at once
        near = np.abs(pivot_table(fp[two]) - pivot_table(fp[two + 1])).max(axis=1, initial=0) <= distance
        two = two[near]
        two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= distance]
        left.append(fp[two]), right.append(fp[two + 1])
        for s, e in zip(bounds[:-1][size > 2], bounds[1:][size > 2], strict=True):
            forest = Forest(e - s)
            own = fp[s:e]
            for a, b in linked_pairs(own, side[s:e], distance):
                new = [(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True) if forest.join(x, y)]
                if new:
                    x, y = np.array(new).T
                    left.append(own[x]), right.append(own[y])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (left, right)], ["a", "b"])

    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        new = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in held}
        new["fp"] = new["fp"].view(_U)
        for k in held:
            held[k].append(new[k])
        rows += batch.num_rows
        whole = {k: np.concatenate(v) for k, v in held.items()}
        last = (whole["bucket"] == whole["bucket"][-1]) & (whole["part"] == whole["part"][-1])
        cut = int(np.argmax(last))  # the last bucket may go on
        if cut:
            yield links(*(whole[k][:cut] for k in held))
        held = {k: [v[cut:]] for k, v in whole.items()}
        rows -= cut
    if rows:
        yield links(*(np.concatenate(v) for v in held.values()))


def links(distinct: DataFrame, distance: int = 4, blocks: int = 6, bucket_rows: int = 20_000) -> DataFrame:
    """(a, b): links that join the same fingerprints as all pairs within `distance` do. distinct: (fp)."""
    masks = block_masks(blocks, distance)
    signed = lambda m: F.lit(m - (1 << 64) if m >> 63 else m)
    fp = F.col("fp")
    rows = distinct.select("fp", F.posexplode(F.array(*(fp.bitwiseAND(signed(m)) for m in masks))).alias("choice", "bits"))
    rows = rows.select("fp", "choice", F.xxhash64("choice", "bits").alias("bucket"))
    crowded = lambda some: some.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > bucket_rows)
    hot = C.saved(crowded(rows).select("bucket"), "hot-buckets")
    # a hot bucket is cut by blocks of the bits that its choice leaves, just as all were cut by blocks
    finer = F.array(*(F.array(*(signed(x) for x in block_masks(blocks, distance, m))) for m in masks))
    fine = rows.join(hot, "bucket", "left_semi").select("fp", "choice", F.posexplode(F.transform(F.get(finer, F.col("choice")), lambda m: fp.bitwiseAND(m))).alias("finer", "bits"))
    fine = fine.select("fp", F.xxhash64("choice", "finer", "bits").alias("bucket"))
    # what still is hot lies close together, so it has a bound; it is dealt into parts
    hotter = C.saved(crowded(fine).select("bucket", F.ceil(F.col("n") / bucket_rows).cast("int").alias("cuts")), "hotter-buckets")
    cold = rows.join(hot, "bucket", "left_anti").select("fp", "bucket", F.lit(None).cast("int").alias("cuts"))
    rows = cold.unionByName(fine.join(hotter, "bucket", "left"))
    rows = rows.select("fp", "bucket", F.inline(in_parts(fp, F.col("cuts"))))
    rows = rows.repartition("bucket", "part").sortWithinPartitions("bucket", "part")
    return rows.select("bucket", "part", "fp", "side").mapInArrow(lambda b: _bucket_links(b, distance), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable, for every node with an edge. edges: (a, b) long, without nulls."""
    both = C.saved(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    label = C.saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:  # labels only fall, so this ends
        near = both.join(label.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = label.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("low"))
        jump = label.select(F.col("node").alias("low"), F.col("label").alias("far"))
        new = C.saved(low.join(jump, "low", "left").select("node", "old", F.least("low", F.coalesce("far", "low")).alias("label")), "labels")
        label = new.select("node", "label")
        if new.where("label < old").isEmpty():
            return label


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distance: int = 4, blocks: int = 6) -> DataFrame:
    """(id, fp long, component_id): component_id is the smallest id reachable over links."""
    fps = C.saved(fingerprints(docs, id_col, text_col, words), "fingerprints")
    nodes = C.saved(fps.groupBy("fp").agg(F.min(id_col).alias("id")), "nodes")
    labels = components(C.saved(links(nodes.select("fp"), distance, blocks), "links"))
    linked = C.saved(nodes.join(labels, nodes["fp"] == labels["node"]).select("fp", "id", "label"), "linked")
    least = linked.groupBy("label").agg(F.min("id").alias("component_id"))
    named = nodes.join(linked.join(least, "label").select("fp", "component_id"), "fp", "left")
    # a node without links stands for itself; one id may have several where rows repeat it with another text
    return fps.join(named.select("fp", F.coalesce("component_id", "id").alias("component_id")), "fp").select(id_col, "fp", "component_id")


# ---------------------------------------------------------------- near copies by similarity


def shingle_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct shingles of all rows, bounds of the rows); a text of fewer words is one shingle."""
    data, off = C.text_buffer(column)
    data = C.LOWER[data]
    starts, ends = C.runs(C.SPACED[data], off)
    first = C.per_row(starts, off)
    hashes = C.span_hashes(data, starts, ends)
    n = np.diff(first)
    row, keys = [], []
    for size in range(1, words + 1):
        grams = C.gram_hashes(hashes, size)
        at = np.flatnonzero(C.gram_rows(first, size, len(hashes)))
        of = np.searchsorted(first, at, side="right") - 1
        fit = np.flatnonzero(n[of] >= words if size == words else n[of] == size)
        row.append(of[fit]), keys.append(C.mix(grams[at[fit]] + _U(size)))
    row, keys = np.concatenate(row), np.concatenate(keys)
    order = np.lexsort((keys, row))
    row, keys = row[order], keys[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (keys[1:] != keys[:-1])
    return keys[new], np.searchsorted(row[new], np.arange(len(off)))


def long_fingerprints(column: pa.Array, words: int) -> np.ndarray:
    """(rows, LANES): bit b is set if over half of the distinct shingles' hashes have it."""
    hashes, bounds = shingle_sets(column, words)
    rows, count = len(bounds) - 1, np.diff(bounds)
    of_row = np.repeat(np.arange(rows), count)
    bits = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float32)
    out = np.zeros((rows, LANES), _U)
    for lane in range(LANES):
        own = C.mix(hashes + _U((lane + 1) * C._STEP & (1 << 64) - 1)).view(np.uint8).reshape(-1, 8)
        for at in range(0, rows, 1024):
            a, b = np.searchsorted(of_row, [at, at + 1024])
            n = min(1024, rows - at)
            place = (of_row[a:b] - at) * 256
            for byte in range(8):
                table = np.bincount(place + own[a:b, byte], minlength=n * 256).reshape(n, 256)
                ones = (table.astype(np.float32) @ bits) * 2 > count[at : at + n, None]
                out[at : at + n, lane] |= (ones @ (1 << np.arange(8))).astype(_U) << _U(8 * byte)
    return out


def bucket_values(fps: np.ndarray) -> np.ndarray:
    """(rows, tables): values of VALUE bits from two choices of the bits of long fingerprints, with the table's number above them."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(len(fps), -1), axis=1)
    turned = np.argsort(C.mix(np.arange(bits.shape[1], dtype=_U)), kind="stable")
    values = np.concatenate([np.ascontiguousarray(np.packbits(bits[:, order], axis=1)).view(np.uint16) for order in (np.arange(bits.shape[1]), turned)], axis=1)
    return values.astype(np.int64) + (np.arange(values.shape[1], dtype=np.int64) << VALUE)


def distances(similarity: float, lanes: int) -> tuple[int, int]:
    """(sure, far): how many bits of some lanes a pair of this similarity hardly falls below, and hardly exceeds."""
    bits = 64 * lanes
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    spread = np.sqrt(bits * p * (1 - p))
    return int(bits * p - 3 * spread), int(np.ceil(bits * p + 4 * spread))


def spanning_forest(n: int, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Indices of a minimum spanning forest of the links a - b with lengths d, over n nodes."""
    label, chosen = np.arange(n), []
    order = np.argsort(d, kind="stable")
    cuts = np.flatnonzero(np.diff(d[order])) + 1
    for level in np.split(order, cuts):
        while len(level := level[label[a[level]] != label[b[level]]]):
            # one link of each component at once; each that still joins two is taken
            pick = level[np.unique(label[a[level]], return_index=True)[1]]
            up: dict[int, int] = {}
            for i, x, y in zip(pick.tolist(), label[a[pick]].tolist(), label[b[pick]].tolist(), strict=True):
                while x in up:
                    x = up[x]
                while y in up:
                    y = up[y]
                if x != y:
                    up[max(x, y)] = min(x, y)
                    chosen.append(i)
            if up:
                jump = np.arange(n)
                jump[list(up)] = list(up.values())
                while (jump[jump] != jump).any():
                    jump = jump[jump]
                label = jump[label]
    return np.array(chosen, np.int64)


def _near_pairs(fp: np.ndarray, far: int, table: np.ndarray, rows: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, distance) of the pairs rows x others within far; what the pivot table rules out isn't compared."""
    for p in range(table.shape[1]):
        near = np.abs(table[rows, p] - table[others, p]) <= far
        rows, others = rows[near], others[near]
    d = np.bitwise_count(fp[rows] ^ fp[others]).sum(axis=1, dtype=np.int64)
    near = d <= far
    return rows[near], others[near], d[near]


def _bucket_forest(fp: np.ndarray, side: np.ndarray, far: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A minimum spanning forest of one bucket; if there are two sides, of the pairs across them."""
    n = len(fp)
    pivots = fp[np.linspace(0, n - 1, min(n, PIVOTS)).astype(int)]
    table = np.bitwise_count(fp[:, None, :] ^ pivots[None, :, :]).sum(axis=2, dtype=np.int64)
    a = b = d = np.zeros(0, np.int64)
    across = bool(side.any())
    step = max(1, PAIRS // n)
    for i in range(0, n, step):
        rows, others = np.nonzero(~np.tri(min(step, n - i), n, i, dtype=bool))
        rows = rows + i
        if across:
            keep = side[rows] != side[others]
            rows, others = rows[keep], others[keep]
        new = _near_pairs(fp, far, table, rows, others)
        a, b, d = (np.concatenate(x) for x in zip((a, b, d), new, strict=True))
        chosen = spanning_forest(n, a, b, d)
        a, b, d = a[chosen], b[chosen], d[chosen]
    return a, b, d


def _value_links(bucket: np.ndarray, part: np.ndarray, side: np.ndarray, node: np.ndarray, fp: np.ndarray, far: int, small: int = 64) -> pa.RecordBatch:
    """Forests of whole buckets, which come in order."""
    bounds = np.concatenate(([0], np.flatnonzero((bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])) + 1, [len(node)]))
    size = np.diff(bounds)
    left, right, apart = [], [], []
    # small buckets, which are most, all at once: row i with row i + lag
    last = np.repeat(np.where(size <= small, bounds[1:], 0), size)
    across = np.repeat(np.maximum.reduceat(side, bounds[:-1]) > 0, size)  # two sides: pairs across them only
    at, found = np.flatnonzero(last > 0), []
    for lag in range(1, small):
        at = at[at + lag < last[at]]
        if not len(at):
            break
        for i in range(0, len(at), PAIRS):
            rows = at[i : i + PAIRS]
            rows = rows[~across[rows] | (side[rows] != side[rows + lag])]
            d = np.bitwise_count(fp[rows] ^ fp[rows + lag]).sum(axis=1, dtype=np.int64)
            near = d <= far
            found.append((rows[near], rows[near] + lag, d[near]))
    forests = []
    if found:
        a, b, d = (np.concatenate(x) for x in zip(*found, strict=True))
        chosen = spanning_forest(len(node), a, b, d)
        forests.append((a[chosen], b[chosen], d[chosen]))
    for s, e in zip(bounds[:-1][size > small].tolist(), bounds[1:][size > small].tolist(), strict=True):
        a, b, d = _bucket_forest(fp[s:e], side[s:e], far)
        forests.append((a + s, b + s, d))
    for a, b, d in forests:
        left.append(np.minimum(node[a], node[b])), right.append(np.maximum(node[a], node[b])), apart.append(d)
    none = [np.zeros(0, np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(none + x)) for x in (left, right, apart)], ["a", "b", "d"])


def _whole_buckets(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of runs of whole (bucket, part): rows come sorted by them, and one may go on in the next batch."""
    held: dict[str, list[np.ndarray]] = {k: [] for k in names}
    for batch in batches:
        if not batch.num_rows:
            continue
        for k in names:
            held[k].append(batch.column(k).to_numpy(zero_copy_only=False))
        if all(held[k][0][0] == held[k][-1][-1] for k in ("bucket", "part")):
            continue  # one bucket so far
        whole = {k: np.concatenate(v) for k, v in held.items()}
        cut = int(np.argmax((whole["bucket"] == whole["bucket"][-1]) & (whole["part"] == whole["part"][-1])))
        yield {k: v[:cut] for k, v in whole.items()}
        held = {k: [v[cut:]] for k, v in whole.items()}
    if held[names[0]]:
        yield {k: np.concatenate(v) for k, v in held.items()}


def value_links(nodes: DataFrame, far: int, bucket_rows: int = 20_000) -> DataFrame:
    """(a, b, d): links between nodes within far of each other that share a bucket. nodes: (node, lanes array, values array)."""
    carried = [f"fp{i}" for i in range(CARRIED)]
    lanes = [F.get("lanes", F.lit(i)).alias(c) for i, c in enumerate(carried)]
    values = nodes.select("node", F.explode("values").alias("bucket"))
    hot = values.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > bucket_rows)
    hot = C.saved(hot.select("bucket", F.ceil(F.col("n") / bucket_rows).cast("int").alias("cuts")), "hot-buckets")
    rows = nodes.select("node", *lanes, F.explode("values").alias("bucket")).join(hot, "bucket", "left")
    rows = rows.select("node", *carried, "bucket", F.inline(in_parts(F.col("node"), F.col("cuts"))))
    rows = rows.repartition("bucket", "part").sortWithinPartitions("bucket", "part")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _whole_buckets(batches, ["bucket", "part", "side", "node", *carried]):
            yield _value_links(c["bucket"], c["part"], c["side"], c["node"], np.stack([c[k] for k in carried], axis=1).view(_U), far)

    found = rows.select("bucket", "part", "side", "node", *carried).mapInArrow(work, "a long, b long, d long")
    return found.groupBy("a", "b").agg(F.min("d").alias("d"))


def in_parts(key, cuts):
    """[(part, side)]: a hot bucket is dealt into `cuts` parts of bounded size, and every two parts meet somewhere."""
    own = F.pmod(F.xxhash64(key, F.lit(7)), cuts).cast("int")
    meets = F.transform(F.sequence(F.lit(0), cuts - 1), lambda o: F.struct((F.least(own, o) * 1_000_000 + F.greatest(own, o)).alias("part"), (own > o).cast("int").alias("side")))
    return F.when(cuts.isNull(), F.array(F.struct(F.lit(-1).alias("part"), F.lit(0).alias("side")))).otherwise(meets)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, digest, component long) of every row: digest is xxhash64 of the text; rows of one component are near copies of each other."""
    own = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("digest"))
    id_type = own.schema["id"].dataType.simpleString()

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in C.pieces(batches, "text"):
            fps = long_fingerprints(piece.column("text"), words)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("digest"), lists(fps.view(np.int64)), lists(bucket_values(fps))], ["id", "digest", "lanes", "values"])

    marks = own.mapInArrow(mark, f"id {id_type}, digest long, lanes array<long>, values array<long>")
    marks = C.saved(marks.select("id", "digest", F.xxhash64("lanes").alias("node"), "lanes", "values"), "marks")
    nodes = C.saved(marks.groupBy("node").agg(F.first("lanes").alias("lanes"), F.first("values").alias("values")), "nodes")
    found = value_links(nodes, distances(similarity, CARRIED)[1])
    # by all lanes a pair's similarity shows more sharply than by those in the bucket
    for end in ("a", "b"):
        found = found.join(nodes.select(F.col("node").alias(end), F.col("lanes").alias(f"lanes_{end}")), end)
    apart = F.aggregate(F.zip_with("lanes_a", "lanes_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    sure, far = distances(similarity, LANES)
    found = C.saved(found.select("a", "b", apart.alias("d")).where(F.col("d") <= far), "links")
    accepted = found.where(F.col("d") <= sure).select("a", "b")
    labels = C.saved(components(accepted), "joined")
    still_open = C.saved(_between(found.where(F.col("d") > sure), labels), "open-links")
    shingles = _shingles_of(own, marks, still_open, words)
    most = 4
    while not still_open.isEmpty():
        # the nearest links of each component first: what they join needs no further look
        ends = still_open.select("a", "b", "d", F.explode(F.array("of_a", "of_b")).alias("component"))
        nearest = F.row_number().over(Window.partitionBy("component").orderBy("d", "a", "b"))
        chosen = C.saved(ends.withColumn("nth", nearest).where(F.col("nth") <= most).select("a", "b").distinct(), "chosen-links")
        accepted = accepted.unionByName(C.saved(_similar(chosen, shingles, similarity), "verified"))
        labels = C.saved(components(accepted), "joined")
        still_open = C.saved(_between(still_open.select("a", "b", "d").join(chosen, ["a", "b"], "left_anti"), labels), "open-links")
        most *= 16
    return marks.select("id", "digest", "node").join(labels, "node", "left").select(F.col("id").alias(id_col), "digest", F.coalesce("label", "node").alias("component"))


def _between(links_: DataFrame, labels: DataFrame) -> DataFrame:
    """The links (a, b, d) whose ends are in different components, with of_a and of_b."""
    for end in ("a", "b"):
        links_ = links_.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"of_{end}")), end, "left")
    links_ = links_.select("a", "b", "d", F.coalesce("of_a", "a").alias("of_a"), F.coalesce("of_b", "b").alias("of_b"))
    return links_.where("of_a != of_b")


def _shingles_of(own: DataFrame, marks: DataFrame, some: DataFrame, words: int) -> DataFrame:
    """(node, shingles array) of the nodes at the ends of links. own: (id, text, digest), marks: (id, digest, node)."""
    ends = some.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = marks.join(ends, "node").groupBy("node").agg(F.min(F.struct("id", "digest")).alias("w"))
    wanted = C.saved(wanted.select("node", F.col("w.id").alias("w_id"), F.col("w.digest").alias("w_digest")), "open-texts")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in C.pieces(batches, "text"):
            hashes, bounds = shingle_sets(piece.column("text"), words)
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([piece.column("node"), lists], ["node", "shingles"])

    # texts that may be wanted; the others aren't shuffled
    own = own.where(C.may_hold(wanted.select(C.row_hash(F.col("w_id"), F.col("w_digest")).alias("h")))(C.row_hash(own["id"], own["digest"])))
    texts = own.join(wanted, own["id"].eqNullSafe(wanted["w_id"]) & (own["digest"] == wanted["w_digest"])).select("node", "text")
    # rows that repeat id and text give the set again
    return C.saved(texts.mapInArrow(sets, "node long, shingles array<long>").groupBy("node").agg(F.first("shingles").alias("shingles")), "shingles")


def _similar(some: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """The links (a, b) whose sets have the Jaccard similarity."""
    wanted = shingles.join(C.saved(some.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ends"), "node", "left_semi")
    side = lambda end: wanted.select(F.col("node").alias(end), F.col("shingles").alias(f"set_{end}"))
    both = some.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return both.where(shared >= F.lit(similarity) * (F.size("set_a") + F.size("set_b") - shared) - 1e-9).select("a", "b")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each component of near copies stays, that with the smallest id, with all its columns."""
    rows = near_copies(docs, id_col, text_col, words, similarity).select(F.col(id_col).alias("id"), "digest", "component")
    rows = C.saved(rows.groupBy("id", "digest", "component").agg(F.count("*").alias("n")), "near-copies")
    own = F.struct(F.col("id").isNull().alias("none"), "id", "digest")
    best = rows.groupBy("component").agg(F.min(own).alias("best"))
    kept = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("digest") == F.col("best.digest"))
    marked = C.saved(rows.join(best, "component").withColumn("kept", kept).where("not kept or n > 1").select("id", "digest", "kept"), "gone")
    others, _ = C.rows_of(docs, marked.select("id", "digest"), id_col, text_col)
    # of rows that repeat id and text one stays: combined in the tasks, so that few are shuffled
    _, repeated = C.rows_of(docs, marked.where("kept").select("id", "digest"), id_col, text_col)
    own_id, own_digest = C.new_names(docs, "own_id", "own_digest")
    one = repeated.groupBy(F.col(id_col).alias(own_id), F.xxhash64(text_col).alias(own_digest)).agg(F.first(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias("row"))
    return others.unionByName(one.select("row.*"))
