"""Edge cases of single operators, small tables written out."""

import io
import random
import re

import pytest
from pyspark.sql import functions as F

from keyfold.functions import glob, ids
from keyfold.operators import admin, keyspace, lists, pubsub, sets, streams, strings, zsets
from keyfold.plans import fold, live, procedures, transactions  # noqa: F401
from keyfold.plans.registry import QUERIES
from keyfold.sources import command_log, snapshot
from keyfold.streaming import jobs


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# ---------------------------------------------------------------- values


@pytest.mark.parametrize("start,stop", [(s, e) for s in (-9, -3, -1, 0, 1, 3, 9) for e in (-9, -4, -3, -1, 0, 2, 3, 9)])
def test_ranges_follow_slices(spark, start, stop):
    text = "abcd"
    n = len(text)
    s, e = max(n + start, 0) if start < 0 else start, n + stop if stop < 0 else stop
    want = text[s : e + 1] if s <= e else ""
    df = table(spark, [(0, "k", bytearray(text.encode()))], "db int, key string, value binary")
    assert bytes(df.select(strings.getrange(F.col("value"), start, stop)).first()[0]).decode() == want
    rows = table(spark, [(0, "k", i, c) for i, c in enumerate(text)], "db int, key string, pos long, value string")
    got = {r["index"]: r["value"] for r in lists.slice_of(rows, start, stop).collect()}
    assert "".join(got[i] for i in sorted(got)) == want
    scored = table(spark, [(0, "k", c, float(i)) for i, c in enumerate(text)], "db int, key string, member string, score double")
    got = {r["rank"]: r["member"] for r in zsets.range_by_rank(scored, start, stop).collect()}
    assert "".join(got[i] for i in sorted(got)) == want
    assert "".join(sorted(r["member"] for r in zsets.without_ranks(scored, start, stop).collect())) == "".join(c for c in text if c not in want)


def test_counters_at_their_limits(spark):
    top = 2**63 - 1
    base = table(spark, [(0, "a", str(top)), (0, "b", str(-top - 1)), (0, "c", " 12"), (0, "d", "1x"), (0, "e", "-12345")], "db int, key string, value string")
    deltas = table(spark, [(0, k, 1) for k in "abcdef"], "db int, key string, delta long")
    got = {r.key: (r.value, r.error) for r in strings.increment(base, deltas).collect()}
    assert got == {"a": (None, "overflow"), "b": (-top, None), "c": (None, "not_integer"), "d": (None, "not_integer"), "e": (-12344, None), "f": (1, None)}


def test_bits(spark):
    df = table(spark, [(bytearray(b"\x80\x01"),), (bytearray(b""),), (bytearray(b"\xff\xff\xff"),)], "value binary")
    v = F.col("value")
    got = df.select(strings.getbit(v, 0), strings.getbit(v, 15), strings.getbit(v, 99), strings.bitcount(v), strings.bitcount(v, 1, 1), F.hex(strings.setbit(v, 9, 1)), F.hex(strings.setbit(v, 0, 0))).collect()
    assert [tuple(r) for r in got] == [(1, 1, 0, 2, 1, "8041", "0001"), (0, 0, 0, 0, 0, "0040", "00"), (1, 1, 0, 24, 8, "FFFFFF", "7FFFFF")]


def test_lists_against_python(spark):
    rng = random.Random(1)
    values = [rng.choice("xyz") for _ in range(30)]
    rows = table(spark, [(0, "k", i * 3, v) for i, v in enumerate(values)], "db int, key string, pos long, value string")
    for count in (-4, -1, 0, 1, 5, 99):
        left = list(reversed(values)) if count < 0 else list(values)
        n = abs(count) or 99
        for _ in range(min(n, left.count("x"))):
            left.remove("x")
        want = list(reversed(left)) if count < 0 else left
        assert [r.value for r in lists.remove(rows, "x", count).orderBy("pos").collect()] == want
    assert lists.at(rows, 99).count() == lists.at(rows, -99).count() == 0
    assert {r.error for r in lists.set_at(rows, 30, "q").collect()} == {"index_out_of_range"}
    pushed = lists.push(rows, table(spark, [(0, "k", 1, "a"), (0, "k", 2, "b"), (0, "new", 1, "c")], "db int, key string, arg int, value string"), head=True)
    assert [r.value for r in pushed.where("key = 'k'").orderBy("pos").limit(2).collect()] == ["b", "a"]


def test_random_members(spark):
    rows = table(spark, [(0, k, str(i)) for k, n in (("a", 3), ("b", 50)) for i in range(n)], "db int, key string, member string")
    got = sets.sample(rows, 10, seed=1).collect()
    assert len({(r.key, r.member) for r in got}) == len(got) == 13
    drawn = sets.sample(rows, -40, seed=1).collect()
    assert len(drawn) == 80
    taken, left = sets.pop(rows, 2, seed=3)
    assert taken.count() == 4 and left.count() == 49 and left.join(taken, ["key", "member"]).count() == 0
    assert sets.intersection(rows, ["a", "b", "none"]).count() == 0


def test_lexical_bounds(spark):
    rows = table(spark, [(0, "k", m, 0.0) for m in ("a", "b", "é", "c")], "db int, key string, member string, score double")
    left = lambda *b: sorted(r.member for r in zsets.without_lex(rows, *b).collect())
    assert left("-", "+") == [] and left("[b", "(c") == ["a", "c", "é"] and left("(b", "+") == ["a", "b"] and left("[z", "[y") == ["a", "b", "c", "é"]


def test_nan_ranks_last(spark):
    rows = table(spark, [(0, "k", m, s) for m, s in (("n", float("nan")), ("i", float("inf")), ("m", float("-inf")), ("a", 1.0), ("b", 1.0))], "db int, key string, member string, score double")
    assert [r.member for r in zsets.ranked(rows).orderBy("rank").collect()] == ["m", "a", "b", "i", "n"]


# ---------------------------------------------------------------- keys and globs


@pytest.mark.parametrize(
    "pattern,yes,no",
    [
        ("a*c", ["ac", "abc", "a\nc"], ["acb", "bac"]), ("?", ["x"], ["", "xy"]), ("[a-c]x", ["ax", "cx"], ["dx"]), ("[c-a]", ["b"], ["d"]), ("[^x]", ["y"], ["x"]),
        ("a\\*", ["a*"], ["ab"]), ("plain", ["plain"], ["plain2"]), ("pre*", ["pre", "prefix"], ["xpre"]), ("a.b", ["a.b"], ["axb"]), ("[abc", [], ["a", "[abc"]), ("$^", ["$^"], [""]), ("a$", ["a$"], ["a", "a\n"]), ("*", ["", "x"], []),
    ],
)
def test_globs(spark, pattern, yes, no):
    df = table(spark, [(x,) for x in yes + no], "s string")
    assert [r[0] for r in df.where(glob.matches(F.col("s"), pattern)).collect()] == yes


def test_pages_cover_all_once(spark):
    rows = table(spark, [(0, f"k{i:03d}", i) for i in range(57)], "db int, key string, v int")
    after, seen = None, []
    while page := [r.key for r in keyspace.page(rows, [], "key", after, 10).collect()]:
        seen += page
        after = max(page)
    assert sorted(seen) == [f"k{i:03d}" for i in range(57)] and len(seen) == 57


def test_limits_of_time(spark):
    now = F.lit("2024-01-01").cast("timestamp")
    rows = table(spark, [(0, "a", "string", "2024-01-01 00:00:01.5"), (0, "b", "list", None), (0, "c", "set", "2023-12-31"), (0, "d", "set", "2024-01-01")], "db int, key string, type string, t string").withColumn("expires_at", F.col("t").cast("timestamp")).drop("t")
    asked = table(spark, [(0, k) for k in "abcde"], "db int, key string")
    assert {r.key: r.ttl for r in keyspace.ttl(rows, asked, now).collect()} == {"a": 2, "b": -1, "c": -2, "d": -2, "e": -2}
    limits = table(spark, [(0, "a", 0), (0, "b", 1500), (0, "c", 9000)], "db int, key string, ms long")
    got = keyspace.expire(rows, limits, now)
    assert {r.key for r in got.collect()} == {"b"} and keyspace.ttl(got, asked, now, 1000).where("key = 'b'").first().ttl == 1500


def test_sets_of_two_databases(spark):
    rows = table(spark, [(0, "a", "x"), (0, "b", "y"), (1, "a", "x"), (1, "b", "x"), (1, "a", "z"), (0, "a", "z")], "db int, key string, member string")
    got = lambda df: sorted(tuple(r) for r in df.collect())
    assert got(sets.intersection(rows, ["a", "b"])) == [(1, "x")]
    assert got(sets.difference(rows, "a", ["b"])) == [(0, "x"), (0, "z"), (1, "z")]
    assert got(sets.union(rows, ["a", "b"])) == [(0, "x"), (0, "y"), (0, "z"), (1, "x"), (1, "z")]


def test_nulls_stay_in_lists(spark):
    rows = table(spark, [(0, "l", i, v) for i, v in enumerate(["a", None, "a", "b"])], "db int, key string, pos long, value string")
    left = lambda n: [r.value for r in lists.remove(rows, "a", n).orderBy("pos").collect()]
    assert (left(0), left(1), left(-1)) == ([None, "b"], [None, "a", "b"], ["a", None, "b"])


def test_save_rules_of_many_days(spark):
    day = 86_400
    writes = table(spark, [(t,) for t in (0, day, 2 * day - 1, 9 * day)], "t long").select(F.timestamp_seconds("t").alias("ts"))
    got = {(r.second, r.changes, r.rule) for r in admin.save_points(writes, [(3 * day, 3), (10 * day, 4)]).collect()}
    assert got == {(2 * day - 1, 3, f"{3 * day}/3"), (9 * day, 4, f"{10 * day}/4")}


def test_scratch_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    from keyfold.functions import scratch

    remote = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        scratch.fresh_path(remote, "x")


# ---------------------------------------------------------------- streams


def test_ids(spark):
    df = table(spark, [("5-1",), ("x",), ("5",), ("99999999999999999999-1",), ("9223372036854775807-0",), ("9223372036854775808-0",)], "t string")
    got = [None if r[0] is None else tuple(r[0]) for r in df.select(ids.parsed(F.col("t"))).collect()]
    assert got == [(5, 1), None, None, None, (2**63 - 1, 0), None]
    rows = table(spark, [(0, "s", 1000, 0), (0, "s", 1000, 1), (0, "s", 1001, 0), (0, "s", 1002, 0)], "db int, key string, ms long, seq long")
    assert streams.range_of(rows, "-", "+").count() == 4
    assert streams.range_of(rows, "1000-1", "1001-0").count() == 2
    assert streams.range_of(rows, "-", "999-9").count() == 0
    assert [(r.ms, r.seq) for r in streams.range_of(rows, "-", "+", 2, descending=True).orderBy("ms").collect()] == [(1001, 0), (1002, 0)]


def test_given_ids_must_rise(spark):
    rows = [(0, 0), (5, 0), (5, 0), (4, 9), (5, 1), (6, 0), (5, 9)]
    df = table(spark, [(0, "s", i, m, s) for i, (m, s) in enumerate(rows)], "db int, key string, arrival long, ms long, seq long")
    assert [r.accepted for r in streams.accepted(df).orderBy("arrival").collect()] == [False, True, False, False, True, True, False]


def test_claims(spark):
    now = F.lit("2024-01-01 01:00:00").cast("timestamp")
    pel = table(spark, [(0, "s", "g", 1, 0, "a", "2024-01-01 00:00:00", 1), (0, "s", "g", 2, 0, "b", "2024-01-01 00:59:59", 1)], "db int, key string, grp string, ms long, seq long, consumer string, t string, delivery_count long").withColumn("delivered_at", F.col("t").cast("timestamp")).drop("t")
    wanted = table(spark, [(0, "s", "g", i, 0) for i in (1, 2, 3)], "db int, key string, grp string, ms long, seq long")
    got = lambda **o: {r.ms: (r.consumer, r.delivery_count) for r in streams.claim(pel, wanted, "c", 60_000, now, **o).collect()}
    assert got() == {1: ("c", 2), 2: ("b", 1)} and got(force=True) == {1: ("c", 2), 2: ("c", 2)}
    assert [(r.ms, r.previous) for r in streams.autoclaim(pel, "c", 60_000, "0-0", now).collect()] == [(1, "a")]


def test_dollar_starts_at_the_end(spark):
    stream = table(spark, [(0, "s", 7, 2)], "db int, key string, ms long, seq long")
    wanted = table(spark, [(0, "s", "g", "$"), (0, "none", "g", "$"), (0, "s", "h", "3-4")], "db int, key string, grp string, start string")
    got = {(r.key, r.grp): (r.last_ms, r.last_seq) for r in streams.create_groups(stream, wanted).collect()}
    assert got == {("s", "g"): (7, 2), ("none", "g"): (0, 0), ("s", "h"): (3, 4)}


def test_delivery_in_spans(spark):
    rng = random.Random(1)
    entries = sorted({(rng.randrange(0, 400), rng.randrange(3)) for _ in range(200)})
    stream = table(spark, [(0, "s", ms, seq, {"f": "v"}) for ms, seq in entries], "db int, key string, ms long, seq long, fields map<string,string>")
    groups = table(spark, [(0, "s", "g", 20, 1), (0, "s", "h", 399, 9)], "db int, key string, grp string, last_ms long, last_seq long")
    asks = [(0, "s", g, i, f"w{i % 3}", rng.choice([0, 1, 5, 40])) for g in "gh" for i in range(12)]
    requests = table(spark, asks, "db int, key string, grp string, request long, consumer string, count int")
    fresh, want = [e for e in entries if e > (20, 1)], {}
    for _, _, g, i, consumer, n in asks:
        if g == "g":
            want.update({e: (i, consumer) for e in fresh[:n]})
            fresh = fresh[n:]
    for span in (7, 3_600_000):
        got = streams.deliver(stream, groups, requests, F.lit("2024-01-01").cast("timestamp"), span).collect()
        assert {(r.ms, r.seq): (r.request, r.consumer) for r in got} == want and len(got) == len(want)


# ---------------------------------------------------------------- messages, logs, transactions


def test_routes_by_any_literal(spark):
    topics = ["*", "?", "a*", "*a", "*ab*", "a?c*x", "long.prefix.of.it*", "*.and.a.long.suffix", "\\*x", "x\\?*", "*\\?", "??", "[a]*", "a.b", "*b?d*", "é*", ""]
    channels = ["", "a", "ab", "ba", "xaby", "abc.x", "azc", "long.prefix.of.it", "long.prefix.of.its", "x.and.a.long.suffix", "*x", "yx", "x?", "x?y", "xy", "[a]b", "a.b", "abcd", "zbcdz", "éa", "long.and.a.long.suffix"]
    subs = table(spark, [(i, "pattern", t) for i, t in enumerate(topics)], "conn int, kind string, topic string")
    messages = table(spark, list(enumerate(channels)), "msg int, channel string")

    def fits(topic, channel):
        parts = re.findall(r"\\(.)|(\*)|(\?)|(.)", topic, re.S)
        return re.fullmatch("".join(re.escape(e or c) if e or c else ".*" if star else "." for e, star, _, c in parts), channel, re.S) is not None

    want = {(m, i) for m, c in enumerate(channels) for i, t in enumerate(topics) if fits(t, c)}
    assert {(r.msg, r.conn) for r in pubsub.route(messages, subs).collect()} == want


def test_channel_wins_over_patterns(spark):
    subs = table(spark, [(1, "channel", "a.b"), (1, "pattern", "a.*"), (2, "pattern", "a.?"), (2, "pattern", "*"), (3, "pattern", "[a].b")], "conn int, kind string, topic string")
    got = sorted(tuple(r) for r in pubsub.route(table(spark, [(1, "a.b"), (2, "axb")], "msg int, channel string"), subs).collect())
    assert got == [(1, 1, "channel", "a.b"), (1, 2, "pattern", "*"), (2, 2, "pattern", "*")]


def _log(spark, rows):
    return table(spark, [(i, conn, 0, argv.split()) for i, (conn, argv) in enumerate(rows)], "seq long, conn long, db int, argv array<string>").withColumn("ts", F.lit(None).cast("timestamp"))


class Store:
    """The same commands one after the other, on dictionaries by database."""

    def __init__(self):
        self.data, self.limit = {}, {}

    def run(self, db, now, name, *args):
        """The reply; an error is its name."""
        data, limit = self.data.setdefault(db, {}), self.limit.setdefault(db, {})
        key = args[0] if args else None
        whole = lambda text: int(text) if re.fullmatch(r"[+-]?[0-9]+", text) else None
        if name in ("INCR", "DECR", "INCRBY", "DECRBY"):
            old, step = whole(data.get(key, "0")), whole(args[1]) if name.endswith("BY") else 1
            if old is None or step is None:
                return "not_integer"
            data[key] = str(old + (step if name.startswith("INCR") else -step))
            return int(data[key])
        if name in ("SET", "GETSET"):
            data[key] = args[1]
            limit.pop(key, None)
        if name in ("SETEX", "PSETEX"):
            data[key], limit[key] = args[2], now + int(args[1]) * (1000 if name == "SETEX" else 1)
        if name == "MSET":
            data.update(zip(args[::2], args[1::2], strict=True))
        if name == "SETNX":
            data.setdefault(key, args[1])
        if name == "APPEND":
            data[key] = data.get(key, "") + args[1]
        if name == "DEL":
            for k in args:
                data.pop(k, None), limit.pop(k, None)
        if name == "EXPIRE":
            limit[key] = now + int(args[1]) * 1000
        if name == "PERSIST":
            limit.pop(key, None)
        if name == "RENAME" and key in data:
            data[args[1]] = data.pop(key)
        if name in ("HSET", "HMSET"):
            data.setdefault(key, {}).update(zip(args[1::2], args[2::2], strict=True))
        if name == "HDEL":
            for f in args[1:]:
                data.get(key, {}).pop(f, None)
        if name == "HINCRBY":
            row = data.setdefault(key, {})
            row[args[1]] = str(int(row.get(args[1], "0")) + int(args[2]))
        if name == "FLUSHDB":
            data.clear(), limit.clear()
        if name == "FLUSHALL":
            for d in [*self.data.values(), *self.limit.values()]:
                d.clear()
        return None


def _mixed(spark, rng, forms, n=400):
    """(log, store after it): commands of three keys, other keys, numbers and texts in two databases."""
    rows, store = [], Store()
    for seq in range(n):
        form = rng.choice(forms) if rng.random() > 0.02 else rng.choice(["FLUSHDB", "FLUSHALL"]) if rng.random() < 0.3 else forms[0]
        text = form.format(*rng.sample("abcde", 3), n=rng.randrange(-9, 9), s=rng.randrange(1, 99))
        db = rng.randrange(2)
        name, *args = text.split()
        if name == "RENAME" and args[0] not in store.data.get(db, {}):
            continue  # logs hold what took effect
        store.run(db, 1000 * seq, name, *args)
        rows.append((seq, 0, db, text.lower().split()[:1] + args, seq))
    log = table(spark, rows, "seq long, conn long, db int, argv array<string>, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    return log, store


def test_folds_of_counters(spark):
    rng = random.Random(7)
    log, store = _mixed(spark, rng, ["SET {0} {n}", "INCR {0}", "INCRBY {0} {n}", "DECR {0}", "DECRBY {0} {n}", "DEL {0}", "DEL {0} {1}", "GETSET {0} {n}", "SETEX {0} 5 {n}"])
    want = {(db, k): int(v) for db, d in store.data.items() for k, v in d.items()}
    assert {(r.db, r.key): r.value for r in fold.counters(log).collect()} == want
    odd = _log(spark, [(0, "SET a x"), (0, "INCR a"), (0, "SET b 9223372036854775807"), (0, "INCR b"), (0, "INCRBY c z"), (0, "SET d 5"), (0, "DECR d"), (0, "DEL b c x y z")][:7])
    assert {r.key: (r.value, r.error) for r in fold.counters(odd).collect()} == {"a": (None, "not_integer"), "b": (None, "overflow"), "c": (None, "not_integer"), "d": (4, None)}
    last = {}
    for r in fold.replies(log.where("upper(argv[0]) not in ('SETEX', 'FLUSHDB', 'FLUSHALL') and size(argv) < 4 and not (argv[0] = 'del' and size(argv) > 2)")).collect():
        last[r.seq] = r.reply
    again = Store()
    for r in log.where("upper(argv[0]) not in ('SETEX', 'FLUSHDB', 'FLUSHALL') and size(argv) < 4 and not (argv[0] = 'del' and size(argv) > 2)").orderBy("seq").collect():
        again.run(r.db, 0, r.argv[0].upper(), *r.argv[1:])
        value = again.data[r.db].get(r.argv[1])
        assert last[r.seq] == (None if value is None else int(value))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_folds_of_strings(spark, seed):
    rng = random.Random(seed)
    log, store = _mixed(spark, rng, ["SET {0} {s}", "APPEND {0} {s}", "APPEND {0} x", "SETNX {0} {s}", "SETNX {1} y", "DEL {0}", "DEL {0} {1} {2}", "GETSET {0} {s}", "SETEX {0} 5 {s}", "MSET {0} p {1} q", "RENAME {0} {1}", "RENAME {2} {1}"], 250)
    want = {(db, k): v for db, d in store.data.items() for k, v in d.items()}
    assert {(r.db, r.key): r.value for r in fold.last_values(log).collect()} == want


def test_folds_of_hashes_and_limits(spark):
    rng = random.Random(4)
    log, store = _mixed(spark, rng, ["HSET {0} f {n} g {s}", "HSET {0} h {n} h {s}", "HINCRBY {0} f {n}", "HINCRBY {0} k {n}", "HDEL {0} f g", "HDEL {0} k", "DEL {0} {1}"])
    want = {(db, k, f): v for db, d in store.data.items() for k, row in d.items() for f, v in row.items()}
    assert {(r.db, r.key, r.field): r.value for r in fold.hashes(log).collect()} == want
    odd = _log(spark, [(0, "HSET a f x"), (0, "HINCRBY a f 1"), (0, "HINCRBY a g 9223372036854775807"), (0, "HINCRBY a g 1")])
    assert {r.field: (r.value, r.error) for r in fold.hash_counters(odd).collect()} == {"f": (None, "not_integer"), "g": (None, "overflow")}
    log, store = _mixed(spark, rng, ["SET {0} 1", "EXPIRE {0} {s}", "SETEX {0} {s} v", "PSETEX {0} {s} v", "PERSIST {0}", "DEL {0} {1}", "GETSET {0} v"])
    want = {(db, k): ms for db, d in store.limit.items() for k, ms in d.items()}
    assert {(r.db, r.key): int(r.expires_at.timestamp() * 1000 + 0.5) for r in fold.limits(log).collect()} == want


def test_long_commands_are_whole(spark):
    log = _log(spark, [(0, "DEL " + " ".join(f"k{i}" for i in range(3000))), (0, "PING")])
    assert fold.commands(log).select(F.size("args")).orderBy("seq").first()[0] == 2999
    assert fold.commands(log).select(F.size(fold.written_keys()).alias("n"), "seq").orderBy("seq").collect()[0].n == 3000


def _outcomes(rows):
    """EXEC outcomes by running the log: {exec seq: aborted}."""
    watch, open_, version, out = {}, {}, {}, {}
    for seq, (conn, text) in enumerate(rows):
        name, *args = text.split()
        if name == "EXEC" and conn in open_:
            queue = open_.pop(conn)
            out[seq] = any(version.get(k, -1) > at for k, at in watch.pop(conn, {}).items())
            if not out[seq]:
                for n, ks in queue:
                    version.update(dict.fromkeys(_written(n, ks), seq))
        elif name == "DISCARD" and conn in open_:
            open_.pop(conn), watch.pop(conn, None)
        elif conn in open_:
            open_[conn].append((name, args))
        elif name == "MULTI":
            open_[conn] = []
        elif name == "WATCH":
            for k in args:
                watch.setdefault(conn, {}).setdefault(k, seq)
        elif name == "UNWATCH":
            watch.pop(conn, None)
        else:
            version.update(dict.fromkeys(_written(name, args), seq))
    return out


def _written(name, args):
    if name in ("FLUSHDB", "FLUSHALL"):
        return "abcd"
    if name in ("SET", "SETEX", "LPOP", "ZREMRANGEBYRANK", "XADD"):
        return args[:1]
    return {"DEL": args, "MSET": args[::2], "RENAME": args[:2], "BLPOP": args[:-1]}.get(name, [])


def test_transactions_against_a_run(spark):
    rng = random.Random(5)
    rows = []
    forms = ["WATCH {}", "WATCH {} {}", "MULTI", "MULTI", "SET {} 1", "SETEX {} 1 1", "DEL {} {}", "MSET {} 1 {} 2", "RENAME {} {}", "BLPOP {} {}", "LPOP {}", "GET {}", "GET {}", "GET {}", "GET {}", "EXEC", "EXEC", "EXEC", "DISCARD", "UNWATCH"]
    for i in range(900):
        forms[-1] = ("FLUSHDB" if i % 2 else "FLUSHALL") if rng.random() < 0.1 else "UNWATCH"
        rows.append((rng.randrange(4), rng.choice(forms).format(rng.choice("abcd"), rng.choice("abcd"))))
    got = {r.exec_seq: r.aborted for r in transactions.outcomes(_log(spark, rows)).collect()}
    assert got == _outcomes(rows) and 5 < sum(got.values()) < len(got)
    sessions, broken, edges = transactions.conflicts(_log(spark, rows), period=7)
    assert sorted(map(tuple, edges.collect())) == sorted(map(tuple, transactions.conflicts(_log(spark, rows))[2].collect()))


@pytest.mark.parametrize("write", ["SETEX a 1 v", "DEL x a", "RENAME x a", "RENAME a x", "MSET x 1 a 2", "FLUSHDB", "FLUSHALL", "LTRIM a 0 1", "XADD a * f v", "SPOP a", "EXPIRE a 1"])
def test_a_watch_sees_every_write(spark, write):
    rows = [(1, "WATCH a"), (2, write), (1, "MULTI"), (1, "GET a"), (1, "EXEC"), (3, "WATCH b"), (3, "MULTI"), (3, "EXEC")]
    got = {r.exec_seq: r.aborted for r in transactions.outcomes(_log(spark, rows)).collect()}
    assert got == {4: True, 7: False}
    queued = [(1, "WATCH a"), (2, "MULTI"), (2, write), (2, "EXEC"), (1, "MULTI"), (1, "EXEC")]
    assert {r.exec_seq: r.aborted for r in transactions.outcomes(_log(spark, queued)).collect()} == {3: False, 5: True}


def test_watches_are_closed_by_what_comes_next(spark):
    text = ["WATCH a b", "WATCH a", "GET a", "MULTI", "WATCH c", "UNWATCH", "EXEC", "WATCH a", "UNWATCH", "WATCH b", "MULTI", "DISCARD", "WATCH c", "EXEC", "MULTI", "EXEC", "WATCH a", "MULTI"]
    found = transactions.watched(_log(spark, [(1, x) for x in text] + [(2, x) for x in text[:7]]))
    want = [(1, 1, "a", 0, 6), (1, 1, "a", 1, 6), (1, 1, "b", 0, 6), (1, 3, "c", 12, 15), (2, 1, "a", 18, 24), (2, 1, "a", 19, 24), (2, 1, "b", 18, 24)]
    assert sorted((r.conn, r.txn, r.key, r.watch_seq, r.exec_seq) for r in found.collect()) == want
    # such a frame takes time by the square of a connection's commands
    assert "unboundedfollowing" not in found._jdf.queryExecution().optimizedPlan().toString().lower()


@pytest.mark.parametrize(("job", "n"), [("outcomes", 2), ("effective", 4)])
def test_sessions_are_worked_out_once(spark, monkeypatch, job, n):
    calls, plain = [], transactions.sessions
    monkeypatch.setattr(transactions, "sessions", lambda log: calls.append(log) or plain(log))
    rows = [(1, "WATCH a"), (2, "SET a 1"), (1, "MULTI"), (1, "SET b 1"), (1, "EXEC"), (3, "WATCH b"), (3, "MULTI"), (3, "SET c 1"), (3, "EXEC")]
    found = getattr(transactions, job)(_log(spark, rows))
    assert len(calls) == 1
    assert found.count() == n


def test_procedures(spark):
    sha = procedures.sha_of("rate_limit")
    calls = table(spark, [("a", i, i * 400) for i in range(6)], "client string, call long, ms long")
    for name in ("rate_limit", sha):
        assert [r.allowed for r in procedures.call(spark, name, calls=calls, window_ms=1000, most=2).orderBy("call").collect()] == [True, True, False, True, True, True]
    assert procedures.known(sha, "0" * 40) == [True, False]
    with pytest.raises(KeyError):
        procedures.call(spark, "0" * 40)


# ---------------------------------------------------------------- sources, sinks, live jobs


def test_command_files(spark):
    argv = [["SET", "k", "é\r\n"], ["GET", ""], []]
    data = b"".join(map(command_log.encode, argv))
    assert list(command_log.decode(io.BytesIO(data))) == argv
    assert list(command_log.decode(io.BytesIO(data + b"*2\r\n$3\r\nGE"), "ignore")) == argv
    for bad in (data + b"*1\r\n$9\r\nGE", b"+OK\r\n", b"*1\r\n:1\r\n"):
        with pytest.raises(ValueError):
            list(command_log.decode(io.BytesIO(bad)))


def test_appended_and_overwritten_logs(spark, tmp_path):
    spark.dataSource.register(command_log.CommandLog)
    path = f"file://{tmp_path}/log"
    rows = lambda *names: table(spark, [("", 0, [n, "k"]) for n in names], "file string, pos long, argv array<string>").repartition(2)
    read = lambda: [r.argv[0] for r in spark.read.format("command_log").load(path).orderBy("pos").collect()]
    for names in (["A", "B"], ["C"], ["D"]):
        rows(*names).write.format("command_log").mode("append").save(path)
    assert sorted(read()[:2]) == ["A", "B"] and read()[2:] == ["C", "D"]
    rows("E").write.format("command_log").mode("overwrite").save(path)
    rows("F").write.format("command_log").mode("append").save(path)
    assert read() == ["E", "F"]
    (tmp_path / "plain").mkdir()
    for name, word in (("b", "SECOND"), ("a", "FIRST")):
        (tmp_path / "plain" / name).write_bytes(command_log.encode([word]))
    path = f"file://{tmp_path}/plain"
    assert read() == ["FIRST", "SECOND"]
    rows("THIRD").write.format("command_log").mode("append").save(path)
    assert read() == ["FIRST", "SECOND", "THIRD"]


def test_a_save_that_breaks_off_is_not_seen(spark, tmp_path):
    keys = table(spark, [(0, "a")], "db int, key string").withColumn("expires_at", F.lit(None).cast("timestamp"))
    values = lambda v: table(spark, [(0, "a", v)], "db int, key string, value string")
    now, path = F.lit("2024-01-01").cast("timestamp"), f"file://{tmp_path}/s"
    with pytest.raises(ValueError):
        snapshot.load(spark, path, now)
    snapshot.save(path, {"strings": values("1")}, keys, now)
    with pytest.raises(Exception):
        snapshot.save(path, {"strings": values("2"), "broken": values("3").select(F.raise_error(F.lit("lost")).alias("x"))}, keys, now)
    assert [r.value for r in snapshot.load(spark, path, now)["strings"].collect()] == ["1"]
    snapshot.save(path, {"strings": values("4")}, keys, now + F.expr("interval 1 day"))
    assert [r.value for r in snapshot.load(spark, path, now)["strings"].collect()] == ["4"]
    assert str(snapshot.last_save(spark, path).first()[0]) == "2024-01-02 00:00:00"


def test_snapshot_needs_its_manifest(spark, tmp_path):
    keys = table(spark, [(0, "a", None), (0, "b", "2023-01-01")], "db int, key string, t string").withColumn("expires_at", F.col("t").cast("timestamp")).drop("t")
    values = table(spark, [(0, "a", "1"), (0, "b", "2")], "db int, key string, value string")
    now = F.lit("2024-01-01").cast("timestamp")
    snapshot.save(f"file://{tmp_path}/s", {"strings": values}, keys, now)
    assert [r.key for r in snapshot.load(spark, f"file://{tmp_path}/s", now)["strings"].collect()] == ["a"]


def _stream(spark, path, rows, schema, parts):
    """Files that arrive one after the other, a micro-batch each."""
    size = -(-len(rows) // parts)
    for i in range(parts):
        table(spark, rows[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_state_carries_over_batches(spark, tmp_path):
    rows = [("q", i, "push" if i % 3 else "pop") for i in range(30)]
    stream = _stream(spark, f"{tmp_path}/in", rows, "key string, seq long, kind string", 4)
    jobs.run_available(jobs.blocking_queue(stream), f"{tmp_path}/out", f"{tmp_path}/c")
    pops, pushes = [s for _, s, k in rows if k == "pop"], [s for _, s, k in rows if k == "push"]
    assert sorted((r["pop"], r["push"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(zip(pops, pushes, strict=False))


def test_late_entries_are_told(spark, tmp_path):
    rows = [("s", ms, 0) for ms in (1, 2, 5, 3, 6, 6)]
    stream = _stream(spark, f"{tmp_path}/in", rows, "key string, ms long, seq long", 2)
    jobs.run_available(jobs.group_delivery(stream, 2), f"{tmp_path}/out", f"{tmp_path}/c")
    got = sorted((r.ms, r.late, r.consumer) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(1, False, "w0"), (2, False, "w1"), (3, True, None), (5, False, "w0"), (6, False, "w1"), (6, True, None)]


def test_delivery_deals_a_key_over_tasks(spark):
    rng = random.Random(6)
    batches = [[(rng.choice(["a", "b", None]), rng.randrange(40 * i, 40 * i + 60), rng.randrange(3)) for _ in range(200)] for i in range(3)]
    job = jobs.group_delivery(None, 3)
    state, cursor, nth, got, want = spark.createDataFrame([], job.state), {}, {}, [], []
    for rows in batches:
        told, state = job.step(table(spark, rows, "key string, ms long, seq long"), state)
        assert "pandas" not in told._jdf.queryExecution().executedPlan().toString().lower()
        got += [tuple(r) for r in told.select("key", "ms", "seq", "consumer", "nth", "late").collect()]
        for k, *own in sorted(rows, key=lambda r: r[1:]):
            late = own <= cursor.get(k, [-1, -1])
            if not late:
                cursor[k], nth[k] = own, nth.get(k, -1) + 1
            want.append((k, *own, None if late else f"w{nth[k] % 3}", None if late else nth[k], late))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r.key: ([r.ms, r.seq], r.nth) for r in state.collect()} == {k: (cursor[k], nth[k] + 1) for k in cursor}


def test_delivery_of_many_files_out_of_order_is_whole(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(70, "event_id").write.option("maxRecordsPerFile", 10).parquet(f"{tmp_path}/events.parquet")
    assert len(list((tmp_path / "events.parquet").glob("*.parquet"))) > 64
    got = QUERIES["streaming_group_delivery"](spark, str(tmp_path))
    want = QUERIES["streaming_group_delivery"](spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == events.count()
