"""Scoring, archives, packing and sharding against plain Python."""

import heapq
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keyfold.llm import common as C
from keyfold.llm import ctw, packing, sharding, warc
from tests.llm import plain
from tests.llm.test_maps import ODD, SCHEMA


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# ---------------------------------------------------------------- context-tree weighting


class Tree:
    """The same tree by dictionaries."""

    def __init__(self, texts):
        self.counts = [defaultdict(lambda: [0, 0]) for _ in range(ctw.DEPTH + 1)]
        for t in texts:
            for context, byte in self.steps(t):
                for bits, one in self.bits(byte):
                    for d in range(ctw.DEPTH + 1):
                        self.counts[d][context[ctw.DEPTH - d :], bits][one] += 1
        self.ln = [{} for _ in self.counts]
        self.weight = [{} for _ in self.counts]
        below = {}
        for d in range(ctw.DEPTH, -1, -1):
            up = defaultdict(float)
            for (context, bits), (a, b) in self.counts[d].items():
                kt = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
                low = below.get((context, bits))
                total = kt if low is None else np.logaddexp(kt, low) - math.log(2)
                self.weight[d][context, bits] = 1.0 if low is None else 1 / (1 + math.exp(min(700, low - kt)))
                up[context[1:], bits] += total
            below = up

    @staticmethod
    def steps(text):
        data = b"\xff" * ctw.DEPTH + plain.low(text).encode() + b"\xff"
        for i in range(ctw.DEPTH, len(data)):
            yield data[i - ctw.DEPTH : i], data[i]

    @staticmethod
    def bits(byte):
        for k in range(8):
            yield (1 << k) | (byte >> (8 - k)), byte >> (7 - k) & 1

    def score(self, text):
        total = 0.0
        for context, byte in self.steps(text):
            for bits, one in self.bits(byte):
                p = 0.5
                for d in range(ctw.DEPTH, -1, -1):
                    key = context[ctw.DEPTH - d :], bits
                    if key in self.counts[d]:
                        a, b = self.counts[d][key]
                        kt, w = (b + 0.5) / (a + b + 1), self.weight[d][key]
                        p = w * kt + (1 - w) * p
                total += math.log10(p if one else 1 - p)
        return total


def _scores(df, **options):
    rows = df.select("doc_id", "text").collect()
    out = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    train = [r.text for r in rows if not out(r.doc_id)]
    words = Counter(w for t in train for w in [*plain.SPACED.findall(plain.low(t)), None])
    n, v = sum(words.values()), len(words)
    tree = Tree(train)
    got = ctw.score_texts(df, **options).collect()
    assert len(got) == len(rows)
    texts = {r.doc_id: r.text for r in rows}
    for r in got:
        toks = [*plain.SPACED.findall(plain.low(texts[r.doc_id])), None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out(r.doc_id), len(toks), sum(t in words for t in toks), n)
        assert r.base_score == pytest.approx(sum(math.log10((words[t] + 1) / (n + v + 1)) for t in toks), rel=1e-9)
        assert r.score == pytest.approx(tree.score(texts[r.doc_id]), rel=1e-5)
        size = len((texts[r.doc_id] or "").encode()) + 1
        assert r.bits_per_byte == pytest.approx(-r.score * math.log2(10) / size)
    return got


def test_scores(docs, odd, none):
    some = docs.where("doc_id < 40")
    for words in (ctw.TOP_WORDS, 50, 0):
        _scores(some, top_words=words)
    _scores(odd.where("length(text) < 1000 or text is null"))
    assert ctw.score_texts(none).count() == 0


def test_scores_by_the_whole_tree(docs):
    """Many tasks, and few or no n-grams that go along: no n-gram and no node is left out."""
    for most in (0, 3000):
        _scores(docs.where("doc_id < 20"), top_ngrams=most, top_words=most, dealt=20_000)


def test_scores_of_repeated_rows(spark):
    text = "the quick brown fox jumps over the lazy dog " * 3
    df = spark.createDataFrame([(i % 3, text if i % 2 else text + "Again.") for i in range(12)], "doc_id long, text string")
    options = ({"top_ngrams": 0, "top_words": 0}, {})
    first, second = (sorted((r.doc_id, r.n_known, round(r.base_score, 9), round(r.score, 9)) for r in ctw.score_texts(df, **o).collect()) for o in options)
    assert len(first) == 12 and first == second


def test_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = ctw.score_texts(docs).where("held_out and n_tokens > 50").collect()
    assert rows and np.mean([r.bits_per_byte for r in rows]) < 2.2
    assert np.mean([r.score > r.base_score for r in rows]) > 0.8


def test_decisions_are_distributions():
    rng = np.random.default_rng(3)
    keys = np.concatenate([ctw.node_keys((np.uint64(c) << np.uint64(8)) | np.arange(1, 256, dtype=np.uint64), d) for d, c in enumerate((0, 0x64, 0x6364, 0x626364, 0x61626364, 0x6061626364))])
    keys = keys[rng.random(len(keys)) < 0.7]
    model = ctw.Model(keys, *rng.random((2, len(keys))))
    grams = np.uint64(0x606162636400) | np.arange(256, dtype=np.uint64)
    assert (10.0 ** ctw.log_probabilities(model, grams)).sum() == pytest.approx(1, abs=1e-6)


def test_known_keys():
    keys = np.random.default_rng(0).integers(0, 2**63, 5000, dtype=np.uint64)
    table = ctw.Known(keys, np.arange(5000))
    assert (table.find(keys) == np.arange(5000)).all() and (table.find(keys + np.uint64(1)) == 0).all()
    assert (ctw.Known(keys[:0], np.zeros(0, np.int64)).find(keys) == 0).all()


# ---------------------------------------------------------------- archives


def _pages(rows, least=100):
    first = {}
    for i, html in sorted((i, h or "") for i, h in rows):
        first.setdefault(html, i)
    out = []
    for i, h in rows:
        h = h or ""
        again = len(h.encode()) >= least and first[h] != i
        out.append((i, len(h.encode()), plain.digest(h), "revisit" if again else "response", first[h] if again else None))
    return sorted(out)


def _archived(spark, df):
    root = C.scratch_path(spark, "test")
    warc.write_archives(df, root)
    return root, warc.read_archives(spark, root)


def test_archives(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = [(r.page_id, r.html) for r in pages.collect()]
    more = [(100_000 + i, h) for i, h in [(1, None), (2, ""), (3, "x" * 99), (4, "x" * 99), (5, "é" * 50), (6, "é" * 50), (0, "é" * 50), (7, rows[3][1])]]
    df = pages.unionByName(spark.createDataFrame([(i, "http://a.b/\r\nX: y", h) for i, h in more], "page_id long, url string, html string"))
    root, back = _archived(spark, df.withColumn("shard", F.lit("x")))
    got = back.collect()
    assert sorted(tuple(r)[:1] + (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == _pages([*rows, *more])
    texts = dict([*rows, *more])
    assert all(r.payload == (texts[r.page_id] or "") for r in got if r.record_type == "response")
    again, _ = _archived(spark, df.repartition(3))
    names = [x.name for x in spark.read.format("binaryFile").load(f"{root}/*.gz").selectExpr("element_at(split(path, '/'), -1) as name").collect()]
    assert names
    for name in names:
        a, b = (spark.read.format("binaryFile").load(f"{r}/{name}").first()["content"] for r in (root, again))
        assert bytes(a) == bytes(b)


def test_archives_of_odd_tables(spark):
    schema = "page_id long, url string, html string"
    assert _archived(spark, spark.createDataFrame([], schema))[1].count() == 0
    rows = [(5, None, "y" * 200), (5, None, "y" * 200), (None, "u", "z"), (4, "u", "w" * 200), (9, "u", "w" * 200)]
    got = sorted((str(r.page_id), r.record_type, r.refers_to) for r in _archived(spark, spark.createDataFrame(rows, schema))[1].collect())
    assert got == [("4", "response", None), ("5", "response", None), ("5", "revisit", 5), ("9", "revisit", 4), ("None", "response", None)]


def test_rolls_by_compressed_size(spark):
    df = spark.createDataFrame([(i, None, str(np.random.default_rng(i).integers(0, 9, 400))) for i in range(60)], "page_id long, url string, html string")
    root = C.scratch_path(spark, "rolls")
    warc.write_archives(df, root, roll_bytes=4000)
    files = spark.read.format("binaryFile").load(f"{root}/*.gz").collect()
    assert len(files) > 3 and warc.read_archives(spark, root).count() == 60


def test_a_damaged_record_is_told(spark):
    import gzip
    import io

    member = warc.response_or_revisit(1, "u", b"payload", plain.digest("payload"), None, 0, "d")
    assert [h["warc-type"] for h, _ in warc.read_members(io.BytesIO(member * 2))] == ["response"] * 2
    broken = gzip.compress(gzip.decompress(member).replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n"))
    with pytest.raises(ValueError):
        list(warc.read_members(io.BytesIO(broken)))


# ---------------------------------------------------------------- packing


def test_token_pieces(docs, odd):
    from tokenizers import Tokenizer

    import public_tokenizers

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    df = docs.select("doc_id", "text").union(odd.where("doc_id != 9").selectExpr("doc_id + 100000", "text"))
    df = df.union(df.sparkSession.createDataFrame([(200_000, "a <|endoftext|> b\x1c \x85 ١٢ don't"), (200_001, "a" + " \n" * 400_000 + "b")], "doc_id long, text string"))
    got = defaultdict(list)
    for r in packing.token_pieces(df).collect():
        got[r.doc_id].append(r)
    for r in df.collect():
        ids = np.array([*exact.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        parts, at = sorted(got[r.doc_id], key=lambda x: x.piece), 0
        for k, p in enumerate(parts):
            assert (p.piece, p.start) == (k, at) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            assert p.length <= 2048 and (len(parts) == 1 or k == 0 or p.length == 2048)
            at += p.length
        assert at == len(ids)


def _sound(rows, sequence=2048):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= sequence
    return len(by)


def test_packing(spark, docs, none):
    rows = packing.pack_documents(docs).collect()
    lengths = np.array([r.length for r in rows])
    assert _sound(rows) <= packing.lower_bound(np.bincount(lengths, minlength=2049)) + 1
    assert packing.pack_documents(none).count() == 0
    rng = np.random.default_rng(2)
    sizes = [*map(int, rng.integers(1, 2049, 3000)), *[700] * 500]
    df = C.saved(spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "doc_id long, length long"), "sizes")
    rows = packing.pack(df, partition_pieces=200).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(sizes)))
    assert _sound(rows) <= packing.lower_bound(np.bincount(sizes, minlength=2049)) * 1.02


def test_bounds_hold():
    rng = np.random.default_rng(4)
    for _ in range(60):
        size = int(rng.integers(4, 20))
        lengths = rng.integers(1, size + 1, int(rng.integers(1, 9)))
        bins, offsets, fill = packing.best_fit_decreasing(lengths, size)
        assert (np.bincount(bins, lengths) == fill).all() and fill.max() <= size
        assert packing.lower_bound(np.bincount(lengths, minlength=size + 1), size) <= _fewest(lengths.tolist(), size) <= len(fill)


def _fewest(lengths, size):
    best = len(lengths)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for b in {x: j for j, x in enumerate(bins) if x + lengths[i] <= size}.values():
            go(i + 1, [x + lengths[i] * (j == b) for j, x in enumerate(bins)])
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best


# ---------------------------------------------------------------- sharding


def _plain_loads(sizes, shards):
    """Loads of the plain rule, one group after the other."""
    heap = [(0, s) for s in range(shards)]
    for n in sorted(sizes, reverse=True):
        heapq.heapreplace(heap, (heap[0][0] + n, heap[0][1]))
    return sorted(load for load, _ in heap)


def _sharded(df, shards=24):
    texts, groups = Counter(), Counter()
    for r in df.collect():
        texts[r.doc_id, r.text or ""] += 1
        groups[r.text or ""] += len((r.text or "").encode()) + 8
    got = sharding.shard_documents(df, shards).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter({(i, len(t.encode()) + 8, zlib.crc32(t.encode())): n for (i, t), n in texts.items()})
    load, slots, where = Counter({s: 0 for s in range(shards)}), defaultdict(list), {}
    for r in got:
        assert where.setdefault((r.size, r.text_crc32), r.shard) == r.shard
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted(load.values()) == _plain_loads(groups.values(), shards)
    return load


def test_sharding(spark, docs, odd, none):
    _sharded(docs)
    _sharded(odd)
    assert sharding.shard_documents(none).count() == 0
    nameless = spark.createDataFrame([(None if i % 2 else 7, "abc" if i % 3 else None) for i in range(60)], SCHEMA.split(", ")[0] + ", text string")
    _sharded(nameless, 5)


@pytest.mark.parametrize("part", [0.0, 0.5, 0.8, 3.0])
def test_sharding_with_a_large_group(spark, part):
    rng = np.random.default_rng(2)
    texts = ["x" * int(n) + str(i) for i, n in enumerate(rng.lognormal(4, 1, 3000))]
    mean = sum(len(t) + 8 for t in texts) / 8
    texts += ["y" * 1000] * int(part * mean / 1008)
    _sharded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 8)


def test_runs_of_equal_groups():
    rng = np.random.default_rng(5)
    for _ in range(300):
        shards = int(rng.integers(1, 9))
        heap = [(int(x), s) for s, x in enumerate(rng.integers(0, 200, shards))]
        heapq.heapify(heap)
        size, count = int(rng.integers(0, 40)), int(rng.integers(1, 120))
        want, plain_heap = Counter(), list(heap)
        for _ in range(count):
            load, s = plain_heap[0]
            want[s] += 1
            heapq.heapreplace(plain_heap, (load + size, s))
        assert sharding.deal(heap, size, count) == want and sorted(heap) == sorted(plain_heap)
