"""Queries over strings, bits, lists, sets, hashes and sorted sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.operators import hashes, lists, sets, strings, zsets
from keyfold.plans.fixtures import NOW, Tables, db, with_
from keyfold.plans.registry import query

# ---------------------------------------------------------------- strings


def _keys(t: Tables, step: int = 3, prefix: str = "c:", table: str = "customer", column: str = "c_custkey") -> DataFrame:
    """Every step-th key of a table, each with a sibling that is absent."""
    rows = t.table(table).where(F.col(column) % step == 0)
    return rows.select(db(), F.explode(F.array(F.concat(F.lit(prefix), column), F.concat(F.lit("none:"), column))).alias("key"))


_KEYS = "keys AS (SELECT unnest(['c:' || c_custkey, 'none:' || c_custkey]) AS key FROM customer WHERE c_custkey % 3 = 0)"
_NEW = "new AS (SELECT 'c:' || (c_custkey * 2) AS key, 'new ' || c_custkey AS value, c_custkey AS pos FROM customer UNION ALL SELECT 'c:' || (c_custkey * 2), 'newer ' || c_custkey, c_custkey + 1000000 FROM customer WHERE c_custkey % 5 = 0)"
_LAST = "last AS (SELECT key, max_by(value, pos) AS value FROM new GROUP BY key)"


def _writes(t: Tables) -> DataFrame:
    """Writes to even keys, half of them beyond the table, some written twice."""
    rows = t.table("customer")
    key = F.concat(F.lit("c:"), (F.col("c_custkey") * 2).cast("string")).alias("key")
    one = rows.select(db(), key, F.concat(F.lit("new "), "c_custkey").alias("value"), F.col("c_custkey").alias("pos"))
    two = rows.where("c_custkey % 5 = 0").select(db(), key, F.concat(F.lit("newer "), "c_custkey").alias("value"), (F.col("c_custkey") + 1_000_000).alias("pos"))
    return one.unionByName(two)


@query(with_("str", body=f", {_KEYS} SELECT keys.key, value FROM keys LEFT JOIN str USING (key)"))
def str_get(t: Tables) -> DataFrame:
    return strings.get(t.strings, _keys(t)).select("key", "value")


@query(
    with_(
        "str",
        body="SELECT request, CAST(pos AS BIGINT) AS pos, k AS key, value FROM (SELECT c_nationkey AS request, unnest(range(3)) AS pos, unnest(['c:' || c_custkey, 'c:' || (c_custkey + 1), 'c:x']) AS k FROM customer WHERE c_custkey % 7 = 0) LEFT JOIN str ON k = str.key",
    )
)
def str_mget(t: Tables) -> DataFrame:
    asked = t.table("customer").where("c_custkey % 7 = 0").select(db(), F.col("c_nationkey").alias("request"), F.array(F.concat(F.lit("c:"), "c_custkey"), F.concat(F.lit("c:"), (F.col("c_custkey") + 1).cast("string")), F.lit("c:x")).alias("keys"))
    return strings.mget(t.strings, asked).withColumn("pos", F.col("pos").cast("long"))


@query(with_("str", body=f", {_NEW}, {_LAST} SELECT * FROM last UNION ALL SELECT key, value FROM str WHERE key NOT IN (SELECT key FROM last)"))
def str_set_upsert(t: Tables) -> DataFrame:
    return strings.put(t.strings, _writes(t)).select("key", "value")


_TIMED = f""", k AS (SELECT 'c:' || c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN epoch_us(TIMESTAMP '{NOW}') + 86400000000 END AS until FROM customer),
w AS (
  SELECT 'c:' || c_custkey AS key, 'timed' AS value, 1 AS pos, (c_custkey % 5 - 1) * 1000 AS ms FROM customer WHERE c_custkey % 4 = 0
  UNION ALL SELECT 'c:' || c_custkey, 'plain', 2, NULL FROM customer WHERE c_custkey % 6 = 0
), l AS (SELECT key, value AS new, ms FROM w WHERE ms IS NULL OR ms > 0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY pos DESC) = 1)
SELECT key, coalesce(new, value) AS value, CASE WHEN new IS NULL THEN until ELSE epoch_us(TIMESTAMP '{NOW}') + ms * 1000 END AS until FROM str JOIN k USING (key) LEFT JOIN l USING (key)"""


@query(with_("str", body=_TIMED))
def str_setex(t: Tables) -> DataFrame:
    """SETEX and PSETEX set value and limit, a later SET clears the limit, and limits of 0 or less are refused."""
    rows = t.table("customer")
    name = F.concat(F.lit("c:"), "c_custkey").alias("key")
    keys = rows.select(db(), name, F.lit("string").alias("type"), F.when(F.col("c_custkey") % 2 == 0, t.now + F.expr("interval 1 day")).alias("expires_at"))
    timed = rows.where("c_custkey % 4 = 0").select(db(), name, F.lit("timed").alias("value"), F.lit(1).alias("pos"), ((F.col("c_custkey") % 5 - 1) * 1000).cast("long").alias("ms"))
    plain = rows.where("c_custkey % 6 = 0").select(db(), name, F.lit("plain").alias("value"), F.lit(2).alias("pos"), F.lit(None).cast("long").alias("ms"))
    values, names = strings.put_for(t.strings, keys, timed.unionByName(plain), t.now)
    return values.join(names, ["db", "key"]).select("key", "value", F.unix_micros("expires_at").alias("until"))


@query(with_("str", body=f", {_NEW} SELECT key, pos, CAST(row_number() OVER (PARTITION BY key ORDER BY pos) = 1 AND key NOT IN (SELECT key FROM str) AS INT) AS done FROM new"))
def str_setnx(t: Tables) -> DataFrame:
    return strings.set_if_absent(t.strings, _writes(t)).select("key", "pos", "done")


@query(with_("str", body=f", {_NEW}, {_LAST} SELECT key, coalesce(last.value, str.value) AS value FROM str LEFT JOIN last USING (key)"))
def str_set_xx(t: Tables) -> DataFrame:
    return strings.put(t.strings, _writes(t), "present").select("key", "value")


@query(with_("str", body=f", {_NEW} SELECT new.key, pos, CASE WHEN row_number() OVER w = 1 THEN str.value ELSE lag(new.value) OVER w END AS old FROM new LEFT JOIN str USING (key) WINDOW w AS (PARTITION BY new.key ORDER BY pos)"))
def str_getset(t: Tables) -> DataFrame:
    return strings.getset(t.strings, _writes(t)).select("key", "pos", "old")


@query(with_("num", body="SELECT key, CAST(value AS BIGINT) + 1 AS value FROM num"))
def str_incr(t: Tables) -> DataFrame:
    return strings.increment(t.numbers, t.numbers.select("db", "key", F.lit(1).alias("delta"))).select("key", "value")


@query(with_("num", body="SELECT 'p:' || l_partkey AS key, CAST(coalesce(max(CAST(value AS BIGINT)), 0) + sum(l_linenumber) AS BIGINT) AS value FROM lineitem LEFT JOIN num ON key = 'p:' || l_partkey GROUP BY 1"))
def str_incrby_sum(t: Tables) -> DataFrame:
    deltas = t.table("lineitem").select(db(), F.concat(F.lit("p:"), "l_partkey").alias("key"), F.col("l_linenumber").cast("long").alias("delta"))
    return strings.increment(t.numbers, deltas).select("key", "value")


@query("SELECT key, CASE WHEN regexp_full_match(v, '[+-]?[0-9]+') THEN CAST(v AS BIGINT) - 1 END AS value, CASE WHEN NOT regexp_full_match(v, '[+-]?[0-9]+') THEN 'not_integer' END AS error FROM (SELECT 'c:' || c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN ' ' || c_custkey ELSE CAST(c_custkey AS VARCHAR) END AS v FROM customer)")
def str_decr(t: Tables) -> DataFrame:
    value = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit(" "), "c_custkey")).otherwise(F.col("c_custkey").cast("string"))
    base = t.table("customer").select(db(), F.concat(F.lit("c:"), "c_custkey").alias("key"), value.alias("value"))
    return strings.increment(base, base.select("db", "key", F.lit(-1).alias("delta"))).select("key", "value", "error")


@query(with_("str", body="SELECT p.key, coalesce(any_value(str.value), '') || string_agg(part, '' ORDER BY pos) AS value FROM (SELECT 'c:' || o_custkey AS key, o_orderkey AS pos, o_orderstatus AS part FROM orders) p LEFT JOIN str USING (key) GROUP BY p.key"))
def str_append(t: Tables) -> DataFrame:
    parts = t.table("orders").select(db(), F.concat(F.lit("c:"), "o_custkey").alias("key"), F.col("o_orderkey").alias("pos"), F.col("o_orderstatus").alias("part"))
    return strings.append(t.strings, parts).select("key", "value")


@query(with_("str", body=f", {_KEYS} SELECT keys.key, CAST(coalesce(strlen(value), 0) AS BIGINT) AS length FROM keys LEFT JOIN str USING (key)"))
def str_strlen(t: Tables) -> DataFrame:
    return strings.strlen(t.strings, _keys(t)).select("key", "length")


@query(with_("str", body="SELECT key, substr(value, length(value) - 3, 3) AS tail, value[3 : 8] AS middle, '' AS empty FROM str"))
def str_getrange(t: Tables) -> DataFrame:
    raw = F.col("value").cast("binary")
    part = lambda s, e, n: strings.getrange(raw, s, e).cast("string").alias(n)
    return t.strings.select("key", part(-4, -2, "tail"), part(2, 7, "middle"), part(5, -200, "empty"))


@query(with_("str", body="SELECT key, substr(value, 1, 3) || '<here>' || substr(value, 10) AS inside, upper(hex(CAST(value AS BLOB))) || '0000' || '7A' AS beyond FROM str"))
def str_setrange(t: Tables) -> DataFrame:
    raw = F.col("value").cast("binary")
    n = F.octet_length("value")
    return t.strings.where(n == 18).select("key", strings.setrange(raw, 3, b"<here>").cast("string").alias("inside"), F.hex(strings.setrange(raw, 20, b"z")).alias("beyond"))


# ---------------------------------------------------------------- bits


@query(with_("str", body="SELECT key, CAST(ascii(substr(value, 18, 1)) AS BIGINT) >> 0 & 1 AS b143, CAST(ascii(substr(value, 1, 1)) AS BIGINT) >> 6 & 1 AS b1, CAST(0 AS BIGINT) AS b9000 FROM str"))
def bit_getbit(t: Tables) -> DataFrame:
    raw = F.col("value").cast("binary")
    return t.strings.select("key", *(strings.getbit(raw, i).alias(f"b{i}") for i in (143, 1, 9000)))


@query(with_("str", body="SELECT key, 'c' || substr(value, 2) AS on_value, upper(hex(CAST(value AS BLOB))) || '0080' AS longer, chr(ascii(substr(value, 1, 1)) & 191) || substr(value, 2) AS off_value FROM str"))
def bit_setbit(t: Tables) -> DataFrame:
    raw = F.col("value").cast("binary")
    text = lambda i, b, n: strings.setbit(raw, i, b).cast("string").alias(n)
    return t.strings.where(F.octet_length("value") == 18).select("key", text(2, 1, "on_value"), F.hex(strings.setbit(raw, 152, 1)).alias("longer"), text(1, 0, "off_value"))


@query(with_("str", body="SELECT key, CAST(list_sum(list_transform(range(1, length(value) + 1), lambda i: bit_count(ascii(substr(value, i, 1))))) AS BIGINT) AS bits, CAST(list_sum(list_transform(range(10, length(value)), lambda i: bit_count(ascii(substr(value, i, 1))))) AS BIGINT) AS part, CAST(0 AS BIGINT) AS none FROM str"))
def bit_bitcount(t: Tables) -> DataFrame:
    raw = F.col("value").cast("binary")
    return t.strings.select("key", strings.bitcount(raw).alias("bits"), strings.bitcount(raw, 9, -2).alias("part"), strings.bitcount(raw, 9, 3).alias("none"))


# ---------------------------------------------------------------- lists


@query(with_("lst", body="SELECT key, CAST(pos AS BIGINT) AS pos, value FROM lst UNION ALL SELECT 'u:' || o_custkey AS key, coalesce(low, 0) - row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey), o_orderstatus FROM orders LEFT JOIN (SELECT key, min(pos) AS low FROM lst GROUP BY key) e ON e.key = 'u:' || o_custkey"))
def list_push(t: Tables) -> DataFrame:
    more = t.table("orders").select(db(), F.concat(F.lit("u:"), "o_custkey").alias("key"), F.col("o_orderkey").alias("arg"), F.col("o_orderstatus").alias("value"))
    return lists.push(t.lists, more, head=True).select("key", "pos", "value")


@query(with_("lst", body="SELECT key, CAST(pos AS BIGINT) AS pos, value FROM lst UNION ALL SELECT 'u:' || o_custkey AS key, coalesce(high, -1) + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey), o_orderstatus FROM orders LEFT JOIN (SELECT key, max(pos) AS high FROM lst GROUP BY key) e ON e.key = 'u:' || o_custkey"))
def list_rpush(t: Tables) -> DataFrame:
    more = t.table("orders").select(db(), F.concat(F.lit("u:"), "o_custkey").alias("key"), F.col("o_orderkey").alias("arg"), F.col("o_orderstatus").alias("value"))
    return lists.push(t.lists, more, head=False).select("key", "pos", "value")


@query(with_("lst", body="SELECT key, min_by(value, pos) AS value FROM lst GROUP BY key"))
def list_lpop(t: Tables) -> DataFrame:
    return lists.pop(t.lists, head=True).select("key", "value")


@query(with_("lst", body="SELECT key, value, CAST(pos AS BIGINT) AS pos FROM (SELECT *, min(pos) OVER (PARTITION BY key) AS m FROM lst) WHERE pos > m"))
def list_lpop_left(t: Tables) -> DataFrame:
    return lists.popped(t.lists, head=True).select("key", "value", "pos")


@query(with_("lst", body="SELECT key, max_by(value, pos) AS value FROM lst GROUP BY key"))
def list_rpop_taken(t: Tables) -> DataFrame:
    return lists.pop(t.lists, head=False).select("key", "value")


@query(with_("lst", body="SELECT key, value, CAST(pos AS BIGINT) AS pos FROM (SELECT *, max(pos) OVER (PARTITION BY key) AS m FROM lst) WHERE pos < m"))
def list_rpop(t: Tables) -> DataFrame:
    return lists.popped(t.lists, head=False).select("key", "value", "pos")


@query(with_("lst", body="SELECT key, count(*) AS n FROM lst GROUP BY key"))
def list_llen(t: Tables) -> DataFrame:
    return lists.length(t.lists).select("key", "n")


@query(with_("lst", body="SELECT key, CAST(pos AS BIGINT) AS index, value FROM (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM lst) WHERE pos >= greatest(n - 5, 0) AND pos <= n - 2"))
def list_lrange(t: Tables) -> DataFrame:
    return lists.slice_of(t.lists, -5, -2).select("key", "index", "value")


@query(with_("lst2", body="SELECT key, value, 2 AS i FROM lst2 WHERE pos = 2 UNION ALL SELECT key, value, -1 FROM (SELECT *, max(pos) OVER (PARTITION BY key) AS m FROM lst2) WHERE pos = m"))
def list_lindex(t: Tables) -> DataFrame:
    return lists.at(t.order_lists, 2).select("key", "value", F.lit(2).alias("i")).unionByName(lists.at(t.order_lists, -1).select("key", "value", F.lit(-1).alias("i")))


@query(with_("lst2", body="SELECT key, CAST(pos AS BIGINT) AS index, CASE WHEN pos = 4 THEN 'set' ELSE value END AS value, CASE WHEN count(*) OVER (PARTITION BY key) <= 4 THEN 'index_out_of_range' END AS error FROM lst2"))
def list_lset(t: Tables) -> DataFrame:
    return lists.set_at(t.order_lists, 4, "set").select("key", "index", "value", "error")


@query(with_("lst2", body="SELECT key, CAST(pos AS BIGINT) AS pos, value FROM (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM lst2) WHERE pos BETWEEN 1 AND n - 2"))
def list_ltrim(t: Tables) -> DataFrame:
    return lists.trim(t.order_lists, 1, -2).select("key", "pos", "value")


_LREM = "SELECT key, CAST(pos AS BIGINT) AS pos, value FROM (SELECT *, row_number() OVER (PARTITION BY key, value ORDER BY pos %s) AS k FROM lst) WHERE value <> 'click' OR k > %d"


@query(with_("lst", body=_LREM % ("", 2)))
def list_lrem_head(t: Tables) -> DataFrame:
    return lists.remove(t.lists, "click", 2).select("key", "pos", "value")


@query(with_("lst", body=_LREM % ("DESC", 3)))
def list_lrem_tail(t: Tables) -> DataFrame:
    return lists.remove(t.lists, "click", -3).select("key", "pos", "value")


@query(with_("lst", body="SELECT key, CAST(pos AS BIGINT) AS pos, value FROM lst WHERE value <> 'click'"))
def list_lrem_all(t: Tables) -> DataFrame:
    return lists.remove(t.lists, "click", 0).select("key", "pos", "value")


@query(
    with_(
        "lst",
        body="""SELECT request, key, value FROM (
  SELECT request, key, row_number() OVER (PARTITION BY key ORDER BY request) - 1 AS pos FROM (
    SELECT request, min_by(k, arg) AS key FROM (SELECT c_custkey AS request, unnest([0, 1, 2]) AS arg, unnest(['none', 'u:' || (c_custkey % 211), 'u:' || (c_custkey % 7)]) AS k FROM customer)
    WHERE k IN (SELECT key FROM lst) GROUP BY request)
) LEFT JOIN lst USING (key, pos)""",
    )
)
def list_blpop_priority(t: Tables) -> DataFrame:
    name = lambda m: F.concat(F.lit("u:"), (F.col("c_custkey") % m).cast("string"))
    asked = t.table("customer").select(db(), F.col("c_custkey").alias("request"), F.array(F.lit("none"), name(211), name(7)).alias("keys"))
    return lists.blocking_pop(t.lists, asked)


@query(
    with_(
        "lst",
        body="""SELECT request, key, value FROM (
  SELECT request, key, row_number() OVER (PARTITION BY key ORDER BY request) AS n FROM (
    SELECT request, min_by(k, arg) AS key FROM (SELECT c_custkey AS request, unnest([0, 1, 2]) AS arg, unnest(['none', 'u:' || (c_custkey % 211), 'u:' || (c_custkey % 7)]) AS k FROM customer)
    WHERE k IN (SELECT key FROM lst) GROUP BY request)
) LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos DESC) AS n FROM lst) USING (key, n)""",
    )
)
def list_brpop_priority(t: Tables) -> DataFrame:
    name = lambda m: F.concat(F.lit("u:"), (F.col("c_custkey") % m).cast("string"))
    asked = t.table("customer").select(db(), F.col("c_custkey").alias("request"), F.array(F.lit("none"), name(211), name(7)).alias("keys"))
    return lists.blocking_pop(t.lists, asked, head=False)


# ---------------------------------------------------------------- sets


def _members(t: Tables) -> DataFrame:
    return t.table("customer").where("c_custkey % 2 = 0").select(db(), F.explode(F.array(F.lit("y:1996"), F.lit("y:2030"))).alias("key"), F.col("c_custkey").cast("string").alias("member"))


_MEM = "mem AS (SELECT unnest(['y:1996', 'y:2030']) AS key, CAST(c_custkey AS VARCHAR) AS member FROM customer WHERE c_custkey % 2 = 0)"


@query(with_("st", body=f", {_MEM} SELECT key, member FROM st UNION SELECT key, member FROM mem"))
def set_add(t: Tables) -> DataFrame:
    return sets.add(t.sets, _members(t)).select("key", "member")


@query(with_("st", body=f", {_MEM} SELECT key, count(*) AS added FROM (SELECT * FROM mem EXCEPT SELECT * FROM st) GROUP BY key"))
def set_added(t: Tables) -> DataFrame:
    return sets.added(t.sets, _members(t)).select("key", "added")


@query(with_("st", body=f", {_MEM} SELECT key, member FROM st EXCEPT SELECT key, member FROM mem"))
def set_rem(t: Tables) -> DataFrame:
    return sets.remove(t.sets, _members(t)).select("key", "member")


@query(with_("st", body="SELECT key, member FROM st WHERE key = 'y:1995'"))
def set_members(t: Tables) -> DataFrame:
    return t.sets.where("key = 'y:1995'").select("key", "member")


@query(with_("st", body=f", {_MEM} SELECT key, member, CAST((key, member) IN (SELECT (key, member) FROM st) AS INT) AS found FROM mem"))
def set_ismember(t: Tables) -> DataFrame:
    return sets.is_member(t.sets, _members(t)).select("key", "member", "found")


@query(with_("st", body="SELECT key, count(*) AS n FROM st GROUP BY key"))
def set_card(t: Tables) -> DataFrame:
    return sets.cardinality(t.sets).select("key", "n")


@query(with_("st", body="SELECT DISTINCT member FROM st WHERE key IN ('y:1995', 'y:1996', 'none')"))
def set_union(t: Tables) -> DataFrame:
    return sets.union(t.sets, ["y:1995", "y:1996", "none"]).select("member")


@query(with_("st", body="SELECT member FROM st WHERE key = 'y:1996' INTERSECT SELECT member FROM st WHERE key = 'y:1997'"))
def set_inter(t: Tables) -> DataFrame:
    return sets.intersection(t.sets, ["y:1996", "y:1997"]).select("member")


@query(with_("st", body="SELECT member FROM st WHERE key = 'y:1996' EXCEPT SELECT member FROM st WHERE key IN ('y:1997', 'none')"))
def set_diff(t: Tables) -> DataFrame:
    return sets.difference(t.sets, "y:1996", ["y:1997", "none"]).select("member")


@query(with_("st", body="SELECT member FROM st WHERE key IN ('y:1995', 'y:1996', 'y:1997', 'y:1998') GROUP BY member HAVING count(*) = 4"))
def set_inter_n(t: Tables) -> DataFrame:
    return sets.intersection(t.sets, [f"y:{y}" for y in (1995, 1996, 1997, 1998)]).select("member")


_DBS = "dbs AS (SELECT o_orderkey % 3 AS db, 'y:' || year(o_orderdate) AS key, o_custkey AS member FROM orders GROUP BY ALL)"


@query(f"WITH {_DBS} SELECT 'inter' AS op, db, member FROM dbs WHERE key IN ('y:1996', 'y:1997') GROUP BY db, member HAVING count(*) = 2 UNION ALL SELECT 'diff', db, member FROM dbs WHERE key = 'y:1996' AND (db, member) NOT IN (SELECT (db, member) FROM dbs WHERE key = 'y:1997') UNION ALL SELECT DISTINCT 'union', db, member FROM dbs WHERE key IN ('y:1996', 'y:1997')")
def set_operations_by_db(t: Tables) -> DataFrame:
    """Equal key names in three databases are different sets."""
    rows = t.table("orders").select((F.col("o_orderkey") % 3).alias("db"), F.concat(F.lit("y:"), F.year("o_orderdate")).alias("key"), F.col("o_custkey").alias("member")).distinct()
    both = ["y:1996", "y:1997"]
    found = {"inter": sets.intersection(rows, both), "diff": sets.difference(rows, *both[:1], both[1:]), "union": sets.union(rows, both)}
    return reduce(DataFrame.unionByName, [df.select(F.lit(op).alias("op"), "db", "member") for op, df in found.items()])


@query()
def set_spop(t: Tables) -> DataFrame:
    return sets.pop(t.sets, 5, seed=7)[0].select("key", "member")


@query()
def set_srandmember(t: Tables) -> DataFrame:
    return sets.sample(t.sets, -20, seed=7).select("key", "draw", "member")


# ---------------------------------------------------------------- hashes


def _fields(t: Tables) -> DataFrame:
    rows = t.table("orders").where("o_orderkey % 4 = 0")
    return rows.select(db(), F.concat(F.lit("o:"), "o_orderkey").alias("key"), F.explode(F.array(F.lit("status"), F.lit("note"))).alias("field"))


_FLD = "fld AS (SELECT 'o:' || o_orderkey AS key, unnest(['status', 'note']) AS field FROM orders WHERE o_orderkey % 4 = 0)"


@query(with_("hsh", body=f", {_FLD} SELECT key, field, 'new ' || field AS value FROM fld UNION ALL SELECT key, field, value FROM hsh WHERE (key, field) NOT IN (SELECT (key, field) FROM fld)"))
def hash_set(t: Tables) -> DataFrame:
    new = _fields(t).withColumn("value", F.concat(F.lit("new "), "field")).withColumn("pos", F.lit(2))
    old = _fields(t).withColumn("value", F.lit("lost")).withColumn("pos", F.lit(1))
    return hashes.put(t.hashes, new.unionByName(old)).select("key", "field", "value")


@query(with_("hsh", body=f", {_FLD} SELECT key, count(*) AS added FROM fld WHERE field = 'note' GROUP BY key"))
def hash_set_added(t: Tables) -> DataFrame:
    return hashes.added(t.hashes, _fields(t)).select("key", "added")


@query(with_("hsh", body=f", {_FLD} SELECT fld.key, fld.field, value FROM fld LEFT JOIN hsh USING (key, field)"))
def hash_get(t: Tables) -> DataFrame:
    return hashes.get(t.hashes, _fields(t)).select("key", "field", "value")


@query(with_("hsh", body="SELECT 'o:' || o_orderkey AS key, unnest([0, 1, 2]) AS pos, unnest(['priority', 'none', 'status']) AS field, unnest([o_orderpriority, NULL, o_orderstatus]) AS value FROM orders"))
def hash_mget(t: Tables) -> DataFrame:
    return hashes.mget(t.hashes, ["priority", "none", "status"]).select("key", "pos", "field", "value")


@query(with_("hsh", body="SELECT key, string_agg(field || '=' || value, ',' ORDER BY field) AS fields FROM hsh GROUP BY key"))
def hash_getall(t: Tables) -> DataFrame:
    pairs = F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return hashes.packed(t.hashes).select("key", F.array_join(pairs, ",").alias("fields"))


@query(with_("hsh", body=f", {_FLD} SELECT key, field, value FROM hsh WHERE (key, field) NOT IN (SELECT (key, field) FROM fld)"))
def hash_del(t: Tables) -> DataFrame:
    return hashes.delete(t.hashes, _fields(t)).select("key", "field", "value")


@query(with_("hsh", body="SELECT key, count(*) AS n FROM hsh GROUP BY key"))
def hash_len(t: Tables) -> DataFrame:
    return hashes.length(t.hashes).select("key", "n")


@query(with_("hsh", body=f", {_FLD} SELECT key, field, CAST(field = 'status' AS INT) AS found FROM fld"))
def hash_exists(t: Tables) -> DataFrame:
    return hashes.exists(t.hashes, _fields(t)).select("key", "field", "found")


@query(with_("hsh", body="SELECT key, field FROM hsh"))
def hash_keys(t: Tables) -> DataFrame:
    return t.hashes.select("key", "field")


@query(with_("hsh", body="SELECT key, value FROM hsh"))
def hash_vals(t: Tables) -> DataFrame:
    return t.hashes.select("key", "value")


@query("SELECT 'o:' || l_orderkey AS key, CAST(coalesce(max(o_custkey), 0) + sum(l_linenumber) AS BIGINT) AS value FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey")
def hash_incrby(t: Tables) -> DataFrame:
    deltas = t.table("lineitem").select(db(), F.concat(F.lit("o:"), "l_orderkey").alias("key"), F.lit("cust").alias("field"), F.col("l_linenumber").cast("long").alias("delta"))
    return hashes.increment(t.hashes, deltas).select("key", "value")


# ---------------------------------------------------------------- sorted sets


@query(with_("z1", body="SELECT key, member, CAST(CAST(member AS BIGINT) AS DOUBLE) AS score FROM z1 WHERE CAST(member AS BIGINT) % 3 = 0 UNION ALL SELECT key, member, score FROM z1 WHERE CAST(member AS BIGINT) % 3 <> 0 UNION ALL SELECT 'c:' || c_custkey, 'x', 1.5 FROM customer"))
def zset_add(t: Tables) -> DataFrame:
    new = t.prices.where("cast(member as long) % 3 = 0").select("db", "key", "member", F.col("member").cast("double").alias("score"), F.lit(2).alias("pos"))
    old = new.withColumn("score", F.lit(-1.0)).withColumn("pos", F.lit(1))
    more = t.strings.select("db", "key", F.lit("x").alias("member"), F.lit(1.5).alias("score"), F.lit(1).alias("pos"))
    return zsets.add(t.prices, new.unionByName(old).unionByName(more)).select("key", "member", "score")


@query(with_("z1", body="SELECT key, member, score FROM z1 WHERE score < 100000"))
def zset_rem(t: Tables) -> DataFrame:
    return zsets.remove(t.prices, t.prices.where("score >= 100000")).select("key", "member", "score")


@query(with_("z1", body="SELECT a.key, a.member, score FROM (SELECT key, member FROM z1 WHERE CAST(member AS BIGINT) % 5 = 0 UNION ALL SELECT 'c:' || c_custkey, 'none' FROM customer) a LEFT JOIN z1 USING (key, member)"))
def zset_score(t: Tables) -> DataFrame:
    asked = t.prices.where("cast(member as long) % 5 = 0").select("db", "key", "member").unionByName(t.strings.select("db", "key", F.lit("none").alias("member")))
    return zsets.score(t.prices, asked).select("key", "member", "score")


@query(with_("z2", body="SELECT key, count(*) AS n FROM z2 GROUP BY key"))
def zset_card(t: Tables) -> DataFrame:
    return zsets.cardinality(t.quantities).select("key", "n")


_RANK = "SELECT key, member, score, row_number() OVER (PARTITION BY key ORDER BY score %s, member %s) - 1 AS rank FROM %s"


@query(with_("z2", body=_RANK % ("", "", "z2")))
def zset_rank(t: Tables) -> DataFrame:
    return zsets.ranked(t.quantities).select("key", "member", "score", "rank")


@query(with_("z2", body=_RANK % ("DESC", "DESC", "z2")))
def zset_revrank(t: Tables) -> DataFrame:
    return zsets.ranked(t.quantities, descending=True).select("key", "member", "score", "rank")


@query(with_("z2", body=f"SELECT * FROM ({_RANK % ('', '', 'z2')}) WHERE rank BETWEEN 0 AND 9"))
def zset_range(t: Tables) -> DataFrame:
    return zsets.range_by_rank(t.quantities, 0, 9).select("key", "member", "score", "rank")


@query(with_("z2", body=f"SELECT r.* FROM ({_RANK % ('', '', 'z2')}) r JOIN (SELECT key, count(*) AS n FROM z2 GROUP BY key) USING (key) WHERE rank BETWEEN greatest(n - 5, 0) AND n - 2"))
def zset_range_tail(t: Tables) -> DataFrame:
    return zsets.range_by_rank(t.quantities, -5, -2).select("key", "member", "score", "rank")


@query(with_("z1", body=f"SELECT * FROM ({_RANK % ('DESC', 'DESC', 'z1')}) WHERE rank <= 2"))
def zset_revrange(t: Tables) -> DataFrame:
    return zsets.range_by_rank(t.prices, 0, 2, descending=True).select("key", "member", "score", "rank")


@query(with_("z1", body="SELECT key, member, score FROM z1 WHERE score BETWEEN 1000 AND 60000"))
def zset_rangebyscore(t: Tables) -> DataFrame:
    return zsets.range_by_score(t.prices, 1000, 60000).select("key", "member", "score")


@query(with_("z1", body=f"SELECT * FROM ({_RANK % ('DESC', 'DESC', '(SELECT * FROM z1 WHERE score BETWEEN 1000 AND 60000)')})"))
def zset_revrangebyscore(t: Tables) -> DataFrame:
    return zsets.ranked(zsets.range_by_score(t.prices, 1000, 60000), descending=True).select("key", "member", "score", "rank")


@query(with_("z2", body="SELECT key, count(*) FILTER (score BETWEEN 10 AND 20) AS n FROM z2 GROUP BY key"))
def zset_count(t: Tables) -> DataFrame:
    return zsets.count(t.quantities, 10, 20).select("key", "n")


@query(with_("z2", body="SELECT d.key, d.member, coalesce(score, 0) + delta AS score FROM (SELECT 's:' || l_suppkey AS key, CAST(l_partkey % 50 AS VARCHAR) AS member, CAST(sum(l_linenumber) AS DOUBLE) AS delta FROM lineitem GROUP BY 1, 2) d LEFT JOIN z2 USING (key, member)"))
def zset_incrby(t: Tables) -> DataFrame:
    deltas = t.table("lineitem").select(db(), F.concat(F.lit("s:"), "l_suppkey").alias("key"), (F.col("l_partkey") % 50).cast("string").alias("member"), F.col("l_linenumber").cast("double").alias("delta"))
    return zsets.increment(t.quantities, deltas).select("key", "member", "score")


@query(with_("z2", body=f"SELECT * FROM ({_RANK % ('', '', 'z2')}) WHERE rank < 3"))
def zset_popmin(t: Tables) -> DataFrame:
    return zsets.pop(t.quantities, 3).select("key", "member", "score", "rank")


@query(with_("z2", body=f"SELECT key, member, score FROM ({_RANK % ('', '', 'z2')}) WHERE rank >= 3"))
def zset_popmin_left(t: Tables) -> DataFrame:
    return zsets.popped(t.quantities, 3).select("key", "member", "score")


@query(with_("z2", body=f"SELECT * FROM ({_RANK % ('DESC', 'DESC', 'z2')}) WHERE rank < 3"))
def zset_popmax_taken(t: Tables) -> DataFrame:
    return zsets.pop(t.quantities, 3, highest=True).select("key", "member", "score", "rank")


@query(with_("z2", body=f"SELECT key, member, score FROM ({_RANK % ('DESC', 'DESC', 'z2')}) WHERE rank >= 3"))
def zset_popmax(t: Tables) -> DataFrame:
    return zsets.popped(t.quantities, 3, highest=True).select("key", "member", "score")


@query(with_("z1", body=f"SELECT key, member, score FROM ({_RANK % ('', '', 'z1')}) r JOIN (SELECT key, count(*) AS n FROM z1 GROUP BY key) USING (key) WHERE NOT rank BETWEEN 1 AND n - 2"))
def zset_remrangebyrank(t: Tables) -> DataFrame:
    return zsets.without_ranks(t.prices, 1, -2).select("key", "member", "score")


@query(with_("z1", body="SELECT key, member, score FROM z1 WHERE NOT score BETWEEN 5000 AND 150000"))
def zset_remrangebyscore(t: Tables) -> DataFrame:
    return zsets.without_scores(t.prices, 5000, 150000).select("key", "member", "score")


@query(with_("z1", body="SELECT key, member, score FROM z1 WHERE NOT (member >= '2' AND member < '5')"))
def zset_remrangebylex(t: Tables) -> DataFrame:
    return zsets.without_lex(t.prices, "[2", "(5").select("key", "member", "score")
