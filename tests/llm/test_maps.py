"""Quality rules, SimHash, decontamination and secret scans against plain Python."""

import base64
import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keyfold.llm import common as C
from keyfold.llm import decontaminate, quality, secrets, simhash
from tests.llm import plain

SCHEMA = "doc_id long, text string, source string, bucket string, spans int"
ODD = [
    (1, None, "a", "x", 1),
    (2, "", "a", "x", 1),
    (3, "one", "a", "x", 1),
    (4, "É à x y \x1f z\x0b\x0cq " * 3, "a", "x", 1),
    (5, "a b c d e\na b c d e\n\n \nz\na b c d e", "a", "x", 1),
    (6, "x" * 300_000, "a", "x", 1),
    (7, "lorem ipsum " * 40_000, "a", "x", 1),
    (8, "The quick brown fox jumps over the lazy dog near the old river bank", "a", "x", 1),
    (9, "The quick brown fox jumps over the lazy dog near the old river bank", "b", "x", 1),
    (9, "The quick brown fox jumps over the lazy dog near the old river bank", "b", "x", 1),
    (None, "no id here at all, none, not one, nothing to see in this row", None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality(docs, odd, none):
    for df in (docs, odd):
        texts = sorted(((r.doc_id or -1, r.text) for r in df.collect()), key=str)
        got = sorted(((r.doc_id or -1, r) for r in quality.repetition_coverage(df).collect()), key=lambda x: str(x[0]))
        want = sorted((i, *plain.quality(t)) for i, t in texts)
        assert sorted((i, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for i, r in got) == want
        assert not any(r.kept and r.base_failed for _, r in got)
    assert quality.repetition_coverage(none).count() == 0
    kept = quality.keep_quality(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {8, 9, None}


def test_quality_labels(spark, sf, docs):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.repetition_coverage(docs).join(labels, "doc_id").collect()
    assert all(r.kept for r in rows if r.quality == 1 and not r.base_failed)
    low = [r.kept for r in rows if r.quality == 0]
    assert sum(low) <= 0.1 * len(low)


def test_repeats_across_pieces():
    texts = pa.array(["a b c d e f", "a b c d e f", None, "q"])
    assert quality.measure(texts, quality.Rules())["n_repeat_words"].tolist() == [0, 0, 0, 0]


def test_simhash(docs, odd, none):
    for df in (docs, odd):
        prints = {r.doc_id: plain.fingerprint(r.text) for r in df.collect()}
        want = plain.components({i: f for i, f in prints.items() if i is not None})
        want[None] = None
        got = simhash.near_duplicates(df).collect()
        assert len(got) == df.count()
        assert all(prints[r.doc_id] == r.fp % 2**64 and want[r.doc_id] == r.component_id for r in got)
    assert simhash.near_duplicates(none).count() == 0


def test_null_ids_link(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 4
    df = spark.createDataFrame([(3, words + "x"), (None, words + "x"), (None, "other words altogether"), (5, "other words altogether"), (None, "alone")], "doc_id long, text string")
    assert sorted(str((r.doc_id, r.component_id)) for r in simhash.near_duplicates(df).collect()) == ["(3, 3)", "(5, 5)", "(None, 3)", "(None, 5)", "(None, None)"]


# ---------------------------------------------------------------- near copies


def test_drop_near_duplicates_of_odd_tables(spark, odd, none):
    got = simhash.drop_near_duplicates(none.withColumnRenamed("source", "some_id"))
    assert got.columns == ["doc_id", "text", "some_id", "bucket", "spans"] and got.count() == 0
    assert sorted(str(r.doc_id) for r in simhash.drop_near_duplicates(odd).collect()) == ["1", "3", "4", "5", "6", "7", "8", "None"]
    t, u = "one text of some words that is here more than once", "another text that is not like the first in any way"
    rows = [(1, t), (1, t), (2, t), (1, u), (7, u), (7, "this one stands alone"), (None, t), (None, "no id but unlike all of the others"), (None, "no id but unlike all of the others")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("some_digest", F.lit(1))
    got = simhash.drop_near_duplicates(df).collect()
    assert sorted(str(r.doc_id) + r.text for r in got) == sorted([f"1{t}", f"1{u}", "7this one stands alone", "Noneno id but unlike all of the others"])


def _copies(rng, n, share):
    """Texts with copies in which words are replaced at about the rate `share`."""
    out = []
    for i in range(n):
        words = [f"w{x}" for x in rng.integers(0, 3000, int(rng.integers(30, 200)))]
        out.append(" ".join(words))
        for _ in range(2):
            out.append(" ".join(f"n{rng.integers(0, 9999)}" if rng.random() < share else w for w in words))
    return out


def test_near_copies_are_found(spark):
    rng = np.random.default_rng(8)
    texts = [t for share in (0.005, 0.01, 0.02, 0.03, 0.05) for t in _copies(rng, 120, share)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component for r in simhash.near_copies(df).collect()}
    want = plain.near_copies(texts)
    linked = [(want[i], i) for i in range(len(texts)) if want[i] != i]
    assert len(linked) > 400
    assert np.mean([got[a] == got[b] for a, b in linked]) > 0.985
    groups = {}
    for i, c in got.items():
        groups.setdefault(c, []).append(i)
    for members in groups.values():  # no member without a partner at 0.8
        assert len(members) == 1 or all(max(plain.similarity(texts[i], texts[j]) for j in members if j != i) >= 0.79 for i in members)


def test_near_copies_in_hot_buckets(spark):
    rng = np.random.default_rng(9)
    base = [f"w{x}" for x in rng.integers(0, 3000, 120)]
    texts = {" ".join(f"n{rng.integers(0, 9999)}" if i == k or i == 60 else w for i, w in enumerate(base)) for k in range(120) for _ in range(2)}
    texts = [*texts, *(f"no {i} such {i} text {i} as {i} this" for i in range(40))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component for r in simhash.near_copies(df).collect()}
    want = plain.near_copies(texts)
    assert len({(want[i], got[i]) for i in got}) == len(set(want)) == len(set(got.values()))
    marks = pa.array(texts)
    fps = simhash.long_fingerprints(marks, 5)
    nodes = spark.createDataFrame([(i, list(map(int, f.view(np.int64))), list(map(int, v))) for i, (f, v) in enumerate(zip(fps, simhash.bucket_values(fps), strict=True))], "node long, lanes array<long>, values array<long>")
    far = simhash.distances(0.8, simhash.CARRIED)[1]
    want = simhash.components(simhash.value_links(nodes, far)).collect()
    for rows in (11, 150):
        assert sorted(simhash.components(simhash.value_links(nodes, far, bucket_rows=rows)).collect()) == sorted(want)


def test_spanning_forests_are_least():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n = int(rng.integers(2, 40))
        a, b = np.triu_indices(n, 1)
        keep = rng.random(len(a)) < 0.2
        a, b = a[keep], b[keep]
        d = rng.integers(0, 9, len(a))
        chosen = set(simhash.spanning_forest(n, a, b, d).tolist())
        total, forest = 0, simhash.Forest(n)
        for i in np.argsort(d, kind="stable").tolist():
            total += int(d[i]) if forest.join(int(a[i]), int(b[i])) else 0
        assert sum(int(d[i]) for i in chosen) == total and len(chosen) == n - len({forest.root(x) for x in range(n)})


def test_links_in_hot_buckets(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 3, dtype=np.uint64)
    prints = {int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 63, (60, 2))}
    df = spark.createDataFrame([(x,) for x in prints], "fp long")
    want = plain.components({x: x for x in prints})
    for bucket_rows, blocks in ((7, 6), (20_000, 6), (20_000, 7), (9, 5)):
        edges = simhash.links(df, blocks=blocks, bucket_rows=bucket_rows)
        got = {r.node: r.label for r in simhash.components(edges).collect()}
        assert {x: got.get(x, x) for x in prints} == want


def test_links_on_long_paths(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 300)] + [(1000, 1001), (1001, 1000)], "a long, b long")
    got = {r.node: r.label for r in simhash.components(edges).collect()}
    assert all(got[i] == 0 for i in range(301)) and got[1001] == 1000


def test_pivots_discard_only_far_pairs():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 200, dtype=np.uint64)
    fp = np.concatenate([a, a ^ np.uint64(0b1011), a ^ (np.uint64(1) << rng.integers(0, 63, 200, dtype=np.uint64))])
    got = {tuple(sorted(p)) for x, y in simhash.linked_pairs(fp, np.zeros(len(fp), int), 4, step=64) for p in zip(x.tolist(), y.tolist(), strict=True)}
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4
    assert got == {(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i < j}


def _contaminated(df, bench):
    items = [(r.item_id, r.text) for r in bench.collect() if r.item_id is not None]
    want = sorted((str(r.doc_id), *plain.contamination(r.text, items)) for r in df.collect())
    got = decontaminate.contamination(df, bench).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, list(r["items"])) for r in got) == want
    assert all(r.contaminated == (r.n_hit > 0) == bool(r.spans) for r in got)


def test_contamination(spark, sf, docs, odd, none):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    _contaminated(docs, bench)
    short = spark.createDataFrame([(1, "Quick brown"), (10, "lazy DOG near the old RIVER"), (2, "lorem"), (3, None), (4, "--"), (5, "the quick brown fox jumps over the lazy dog near"), (6, "the quick brown fox jumps over the lazy dog near"), (None, "lorem ipsum")], "item_id long, text string")
    _contaminated(odd, short)
    assert decontaminate.contamination(none, short).count() == 0
    assert decontaminate.contamination(odd, short.limit(0)).where("contaminated").count() == 0
    assert {r.doc_id for r in decontaminate.drop_contaminated(odd, short.where("item_id = 5")).collect()} == {1, 2, 3, 4, 5, 6, 7, None}


def test_contamination_with_a_full_filter(spark, odd):
    bench = spark.createDataFrame([(i, f"{a} {b} {c} the lazy dog near the old river bank w{i}") for i, (a, b, c) in enumerate((("x", "jumps", "over"), ("fox", "jumps", "over")))], "item_id long, text string")
    items = [(r.item_id, r.text) for r in bench.collect()]
    got = decontaminate.contamination(odd, bench, filter_bits=64).where("n_hit > 0").collect()
    assert got and all((r.n_words, r.n_hit, list(r["items"])) == plain.contamination(ODD[7][1], items) for r in got)


def test_sliding_minimum():
    v = np.random.default_rng(0).integers(0, 99, 50).astype(np.uint64)
    for width in range(1, 12):
        assert decontaminate.sliding_minimum(v, width).tolist() == [v[i : i + width].min() for i in range(51 - width)]


def _der(tag, body):
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2, "big")) + body


RSA = _der(0x30, b"".join(_der(2, bytes([1] * n)) for n in (1, 120, 3, 120, 60, 60, 60, 60, 60)))
PKCS8 = _der(0x30, _der(2, b"\0") + _der(0x30, _der(6, b"\x2a\x86\x48") + _der(5, b"")) + _der(4, RSA))


def _64(x):
    return base64.b64encode(x).decode()


def _token(header, payload="{}", signature="c2ln"):
    return ".".join((*(base64.urlsafe_b64encode(x.encode()).decode().rstrip("=") for x in (header, payload)), signature))


def test_structures():
    assert secrets.is_key(PKCS8) and secrets.is_key(RSA)
    assert not secrets.is_key(PKCS8[:-1]) and not secrets.is_key(PKCS8 + b"\0") and not secrets.is_key(b"")
    field = lambda x: len(x).to_bytes(4, "big") + x
    assert secrets.is_key(field(b"ssh-ed25519") + field(bytes(32)))
    assert not secrets.is_key(field(b"ssh-ed25519") + field(bytes(32))[:-1])
    container = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(b"\1" * 51) + field(b"\2" * 80)
    assert secrets.is_key(container) and not secrets.is_key(container[:-3])


def test_secret_kinds():
    pem = f"-----BEGIN PRIVATE KEY-----\n{_64(PKCS8)}\n-----END PRIVATE KEY-----"
    token = _token(json.dumps({"alg": "HS256", "typ": "JWT"}))
    texts = [
        f"é {pem} é",
        f"é {token}.",
        f"x {_64(RSA)} y",
        f"x {PKCS8.hex().upper()} y",
        _token('{"typ": "JWT"}') + " " + "A" * 80 + " " + _64(RSA[:-2]) + pem.replace("END PRIVATE", "END OTHER")[:40],
        None,
        "PassWord = 'hunter22' api_key:abc tokEn=\"a.b/c+d=\" AKIA" + "Z9" * 8 + " ſecret=abcdefgh " + "0a" * 12,
    ]
    got = [[(secrets.KINDS[k], s, e) for s, k, e in x] for x in secrets.find_spans(pa.array(texts))]
    assert ("pem", 2, 2 + len(pem)) in got[0]
    assert ("jwt", 2, 2 + len(token)) in got[1]
    assert [x[0] for x in got[2]] == ["key64"] and ("keyhex", 2, 2 + 2 * len(PKCS8)) in got[3]
    assert got[4] == [] and got[5] == []
    assert [(s, k, e) for s, k, e in secrets.find_spans(pa.array([texts[6]]))[0] if k < 3] == plain.base_spans(texts[6])


def test_hostile_texts_take_linear_time():
    import time

    began = time.process_time()
    texts = ["eyJ" * 200_000, "-----BEGIN PRIVATE KEY-----\n" * 20_000, "token" + " " * 500_000, "A" * 600_000, "30" * 300_000, "." * 500_000, "eyJ." * 100_000]
    assert all(all(k < 3 for _, k, _ in x) for x in secrets.find_spans(pa.array(texts)))
    assert time.process_time() - began < 20


def test_scan_and_redact(docs, odd, none):
    for df in (docs, odd):
        want = sorted((str(r.doc_id), *(sum(k == kind for _, k, _ in plain.base_spans(r.text)) for kind in range(3)), plain.digest(secrets.said(plain.base_spans(r.text)))) for r in df.collect())
        got = secrets.scan(df).collect()
        assert sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == want
    assert secrets.scan(none).count() == 0
    clean = secrets.redact(docs)
    assert clean.schema == docs.schema and clean.count() == docs.count()
    assert secrets.scan(clean).where("spans != ''").count() == 0
    assert clean.where(F.length("text") != F.col("n_chars")).count() == 0
    assert secrets.redact(odd).exceptAll(odd).count() == 0


def test_pieces_keep_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "", "b" * 50, "c"])], ["text"])
    got = [p.num_rows for p in C.pieces(iter([batch, batch.slice(0, 0)]), "text", 20)]
    assert sum(got) == 5 and len(got) > 1


def test_secrets_in_wider_windows():
    key = base64.b64encode(RSA).decode()
    lines = [key[i : i + 64] for i in range(0, len(key), 64)]
    pem = lambda br: br.join(["-----BEGIN RSA PRIVATE KEY-----", *lines, "-----END RSA PRIVATE KEY-----"])
    url = lambda x: base64.urlsafe_b64encode(x.encode()).rstrip(b"=").decode()
    token = url('{ "alg": "HS256"}') + "." + url('{"sub": 1}') + "." + url("signature")
    kinds = lambda t: {secrets.KINDS[k]: t[s:e] for s, k, e in secrets.find_spans(pa.array([t]))[0] if k > 2}
    for br in ("\n", "\\n", "\\r\\n"):
        assert kinds(f'x "{pem(br)}{br}" y')["pem"] == pem(br)
        assert kinds("see " + br.join(lines) + " end")["key64"] == br.join(lines)
    for before in ("key/", "id_", "\\n"):
        assert kinds(f"a {before}{key} b")["key64"] == key
    assert kinds(f"a {token} b") == {"jwt": token} and kinds(f"x.{token}") == {"jwt": token}
    assert not kinds("M" * 5000 + " " + "MIIEvAIB" * 500)


def test_rows_by_id_and_text(spark):
    rows = [(i % 40 if i % 7 else None, f"text {i % 9}" if i % 5 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, text string")
    some = [(None, "text 1"), (3, "text 3"), (12, None), (None, None), (5, "not there")]
    wanted = spark.createDataFrame(some, "id long, text string").select("id", F.xxhash64("text").alias("digest"))
    without, with_ = C.rows_of(df, wanted, "id", "text")
    text = lambda x: sorted(map(str, map(tuple, x)))
    assert text(with_.collect()) == text(r for r in rows if r in some) and text(without.collect()) == text(r for r in rows if r not in some)
    assert C.rows_of(df, wanted.limit(0), "id", "text")[0].count() == 400
    maybe = C.may_hold(spark.range(0, 3000, 3).select(F.xxhash64("id").alias("h")), bits=1 << 12)
    got = {r.id for r in spark.range(3000).where(maybe(F.xxhash64("id"))).collect()}
    assert set(range(0, 3000, 3)) <= got and len(got) < 2000
