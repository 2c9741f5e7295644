"""URL filters and license scans against plain Python, and the pipeline as a whole."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from keyfold.llm import common as C
from keyfold.llm import licenses, urls
from tests.llm import plain
from tests.llm.test_jobs import _sound
from tests.llm.test_maps import ODD, SCHEMA

CHANGES = "list string, pattern string, at long, op string"
CAPTURES = "page_id long, url string, fetched long, lists int, pattern string"


def _active(host, at, changes):
    """(lists, patterns) by replaying all changes up to the time."""
    state = {}
    for name, pattern, t, op in sorted((c for c in changes if None not in c), key=lambda c: (c[2], c[3])):
        if t <= at:
            state[name, pattern.lower()] = op
    labels = host.split(".")
    ends = {".".join(labels[i:]) for i in range(max(1, len(labels) - 1))}
    on = [(n, p) for (n, p), op in state.items() if op == "add" and p in ends]
    return sorted({n for n, _ in on}), sorted({p for _, p in on})


def test_hosts(spark):
    cases = {"http://A.b.C:80/x?y": "a.b.c", "https://u:p@h.org.": "h.org", "ftp://x": "x", "no url": None, "": None, "http:///p": None, None: None}
    df = spark.createDataFrame([(k,) for k in cases], "url string").select("url", urls.host_of(F.col("url")).alias("h"), urls.suffixes(urls.host_of(F.col("url"))).alias("s"))
    got = {r.url: (r.h, r.s) for r in df.collect()}
    assert {k: v[0] for k, v in got.items()} == cases
    assert got["http://A.b.C:80/x?y"][1] == ["a.b.c", "b.c"] and got["ftp://x"][1] == ["x"]


def test_url_filter(spark):
    rng = random.Random(3)
    hosts = ["a.example.org", "example.org", "b.a.example.org", "other.net", "x", "example.organic"]
    changes = [(rng.choice("pq"), rng.choice(["example.org", "A.example.org", "other.net", "x", "org"]), rng.randrange(0, 1000), rng.choice(["add", "remove"])) for _ in range(120)]
    changes += [("p", "example.org", 500, "add"), ("p", "example.org", 500, "remove"), (None, "x", 1, "add"), ("p", None, 1, "add"), ("p", "x", None, "add"), ("p", "x", 3, None)]
    captures = [(i, f"http://{rng.choice(hosts)}/p", rng.randrange(0, 1100), 1, "z") for i in range(400)]
    captures += [(7000, None, 5, 1, "z"), (7001, "http://x/", None, 1, "z"), (None, "http://x/", 500, 1, "z"), captures[0], captures[0]]
    got = urls.evaluate(spark.createDataFrame(captures, CAPTURES), spark.createDataFrame(changes, CHANGES), period_s=90).collect()
    want = []
    for i, url, at, *_ in captures:
        lists, patterns = _active(url[7:].split("/")[0], at, changes) if url and at is not None else ([], [])
        want.append((str(i), str(at), lists, patterns, bool(lists)))
    assert sorted((str(r.page_id), str(r.fetched), r.lists, r.patterns, r.blocked) for r in got) == sorted(want)


def test_url_filter_of_empty_tables(spark):
    captures, changes = spark.createDataFrame([], CAPTURES), spark.createDataFrame([], CHANGES)
    some = spark.createDataFrame([(1, "http://x/", 5, 1, "z")], CAPTURES)
    assert urls.evaluate(captures, changes).count() == 0
    assert [r.blocked for r in urls.evaluate(some, changes).collect()] == [False]


def _shingle_list(text):
    w = plain.ALNUM.findall(plain.low(text))
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


KNOWN = licenses.TEMPLATES | licenses.whole_texts()
WANTED = {name: _shingle_list(t) for name, t in KNOWN.items()}
SETS = {name: set(x) for name, x in WANTED.items()}


def _licenses(text, containment=0.8):
    """All windows against all templates, without bands."""
    own, found = _shingle_list(text), {}
    for name, wanted in WANTED.items():
        width = 1 << (len(wanted) - 1).bit_length()
        for i in range(0, len(own), width):
            share = len(SETS[name].intersection(own[i : i + 2 * width])) / len(SETS[name])
            if share >= containment:
                found[name] = max(share, found.get(name, 0))
    twins = lambda a, b: a != b and 2 * len(SETS[a] & SETS[b]) >= max(len(SETS[a]), len(SETS[b]))
    return sorted(a for a in found if not any(twins(a, b) and found[b] > found[a] for b in found))


def test_licenses(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rng = random.Random(1)
    more = []
    for k, (name, t) in enumerate(sorted(KNOWN.items())):
        words = t.split()
        fill = [rng.choice("abcdefghij") * rng.randrange(1, 5) for _ in range(300)]
        at = rng.randrange(300)
        more.append((10_000 + k, " ".join(fill[:at] + words + fill[at:])))
        if len(words) > 30:
            words[len(words) // 2] = "changed"
        else:
            words = words[: len(words) // 2]
        more.append((20_000 + k, " ".join(fill[:at] + words + fill[at:]).upper()))
    df = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string")).union(spark.createDataFrame(ODD, SCHEMA).select("doc_id", "text"))
    got = sorted((str(r.doc_id), [m.template for m in r.matches]) for r in licenses.scan(df).collect())
    assert got == sorted((str(r.doc_id), _licenses(r.text)) for r in df.collect())
    planted = {i: m for i, m in got if i != "None" and 10_000 <= int(i) < 20_000}
    assert all(name in planted[str(10_000 + k)] for k, name in enumerate(sorted(KNOWN)))
    assert licenses.scan(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(df, templates={"x": "too few words"})


def test_templates_of_a_table(spark):
    rows = [("A/1", "one two three four five six"), ("B/1", "one two three four five seven eight"), (None, "x"), ("C/1", None), ("A/1", "one two three four five six")]
    table = spark.createDataFrame(rows, "name string, text string")
    assert licenses.templates_of(table) == {"A/1": rows[0][1], "B/1": rows[1][1]}
    docs = spark.createDataFrame([(1, "zero " + rows[1][1]), (2, rows[0][1] + " and more")], "doc_id long, text string")
    assert {r.doc_id: r.licenses for r in licenses.scan(docs, templates=table).collect()} == {1: ["B"], 2: ["A"]}
    with pytest.raises(ValueError):
        licenses.templates_of(spark.range(5).selectExpr("concat('L/', id) as name", "repeat('x ', 500000) as text"))


def test_headers_by_their_own_name(spark):
    names = ["AGPL-3.0/1", "GPL-2.0/1", "GPL-3.0/2", "LGPL-2.1/1", "LGPL-3.0/1", "BSL-1.0/1", "Zlib/1", "EPL-2.0/1", "0BSD/1"]
    docs = spark.createDataFrame([(i, "some code " + KNOWN[n] + " more code") for i, n in enumerate(names)] + [(99, KNOWN["AGPL-3.0/1"] + " or " + KNOWN["GPL-3.0/2"])], "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in licenses.scan(docs).collect()}
    assert all(n.split("/")[0] in got[i] and len(got[i]) <= 2 for i, n in enumerate(names)) and got[0] == ["AGPL-3.0"] and got[4] == ["LGPL-3.0"]
    assert got[99] == ["AGPL-3.0", "GPL-3.0"]


def test_halved_blocks():
    bounds = pa.array([0, 3, 3, 4, 8]).to_numpy()
    starts, new = licenses._halved(bounds)
    assert starts.tolist() == [0, 2, 3, 4, 6] and new.tolist() == [0, 2, 2, 3, 5]


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "secrets", "packing"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = C.saved(stage(spark, kept, sf), name)
        assert new.schema.names == docs.schema.names and 0 < new.count() <= kept.count()
        kept = new
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    good = {i: t for i, t in texts.items() if not plain.quality(t)[5]}
    assert ids <= set(good)
    order = sorted(good)
    groups = dict(zip(order, plain.near_copies([good[i] for i in order]), strict=True))
    assert all(plain.contamination(texts[i], items)[1] == 0 for i in ids)
    assert len({groups[i] for i in ids}) == len(ids)
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} == ids
    _sound(rows)


def test_pipeline_of_odd_rows(spark):
    odd = spark.createDataFrame(ODD, SCHEMA)
    bench = C.scratch_path(spark, "odd")
    spark.createDataFrame([(1, "no id here at all, none, not one, nothing to see")], "item_id long, text string").write.parquet(f"{bench}/benchmark.parquet")
    for df in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            df = C.saved(stage(spark, df, bench), "odd")
    assert df.count() == 0
