"""The engine's operators as queries over the test tables, each with the SQL that says the same.

Three versions of a table are derived from ``orders`` by rules on its key; ``FIXTURE_SQL`` and the
functions below state the same rules.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from branchframe.engine import grants
from branchframe.errors import SerializationError
from branchframe.functions import policies
from branchframe.functions.jsontext import canonical_json
from branchframe.functions.locations import located
from branchframe.functions.numeric import canonical_numeric, numeric_sort_key
from branchframe.functions.values import kv_violations
from branchframe.operators import diff as d
from branchframe.operators import lookup
from branchframe.operators import merge as m
from branchframe.plans.schema import Column, Index, Schema, merge_schemas

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


KEYS, VALUES = ["k"], {"s": 2, "p": 3, "r": 4}

_BASE = "SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS p, o_orderpriority AS r FROM orders"
_OURS = """SELECT k, s, p, CASE WHEN k % 7 = 0 THEN 'X' ELSE r END AS r FROM base WHERE k % 13 <> 0
    UNION ALL SELECT k + 10000000, s, p, r FROM base WHERE k % 17 = 0"""
_CLEAN = """SELECT k, s, CASE WHEN k % 5 = 0 AND k % 13 <> 0 THEN p + 1 ELSE p END AS p, r FROM base
    WHERE NOT (k % 11 = 0 AND k % 7 <> 0 AND k % 13 <> 0)
    UNION ALL SELECT k + 20000000, s, p, r FROM base WHERE k % 19 = 0"""
_CLASH = """SELECT k, s, p, CASE WHEN k % 5 = 0 THEN 'Y' ELSE r END AS r FROM base WHERE k % 11 <> 0
    UNION ALL SELECT k + 10000000, 'Z', p, r FROM base WHERE k % 19 = 0"""


def with_sides(clashing: bool) -> str:
    return f"WITH base AS ({_BASE}), ours AS ({_OURS}), theirs AS ({_CLASH if clashing else _CLEAN})"


def three(spark: SparkSession, sf_dir: str, clashing: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """base, ours, theirs as DataFrames."""
    base = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("p"), F.col("o_orderpriority").alias("r"))
    k = F.col("k")
    ours = base.filter(k % 13 != 0).withColumn("r", F.when(k % 7 == 0, "X").otherwise(F.col("r"))).union(base.filter(k % 17 == 0).withColumn("k", k + 10000000))
    if clashing:
        theirs = base.filter(k % 11 != 0).withColumn("r", F.when(k % 5 == 0, "Y").otherwise(F.col("r"))).union(base.filter(k % 19 == 0).withColumns({"k": k + 10000000, "s": F.lit("Z")}))
    else:
        theirs = base.filter(~((k % 11 == 0) & (k % 7 != 0) & (k % 13 != 0))).withColumn("p", F.when((k % 5 == 0) & (k % 13 != 0), F.col("p") + 1).otherwise(F.col("p")))
        theirs = theirs.union(base.filter(k % 19 == 0).withColumn("k", k + 20000000))
    return base, ours, theirs


# Diff

_DIFF_CELLS = """ SELECT kind, k, "column" FROM (
    SELECT 'added' AS kind, t.k, NULL::INT AS "column" FROM ours t LEFT JOIN base f ON f.k = t.k WHERE f.k IS NULL
    UNION ALL SELECT 'removed', f.k, NULL FROM base f LEFT JOIN ours t ON f.k = t.k WHERE t.k IS NULL
    UNION ALL SELECT 'modified', f.k, 2 FROM base f JOIN ours t ON f.k = t.k WHERE f.s IS DISTINCT FROM t.s
    UNION ALL SELECT 'modified', f.k, 3 FROM base f JOIN ours t ON f.k = t.k WHERE f.p IS DISTINCT FROM t.p
    UNION ALL SELECT 'modified', f.k, 4 FROM base f JOIN ours t ON f.k = t.k WHERE f.r IS DISTINCT FROM t.r)"""


@query(with_sides(False) + _DIFF_CELLS)
def table_diff_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, ours, _ = three(spark, sf_dir, False)
    return d.diff_cells(base, ours, KEYS, VALUES)


@query(with_sides(False) + """ SELECT CASE WHEN f.k IS NULL THEN 'added' WHEN t.k IS NULL THEN 'removed' ELSE 'modified' END AS kind, coalesce(f.k, t.k) AS k
    FROM base f FULL JOIN ours t ON f.k = t.k
    WHERE f.k IS NULL OR t.k IS NULL OR f.s IS DISTINCT FROM t.s OR f.p IS DISTINCT FROM t.p OR f.r IS DISTINCT FROM t.r""")
def table_diff_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, ours, _ = three(spark, sf_dir, False)
    return d.diff_rows(base, ours, KEYS, list(VALUES))


@query(with_sides(False) + " SELECT kind, count(*) AS n FROM (" + _DIFF_CELLS + ") GROUP BY kind")
def diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, ours, _ = three(spark, sf_dir, False)
    return d.diff_summary(d.diff_cells(base, ours, KEYS, VALUES))


@query(f"WITH base AS ({_BASE}) SELECT 'added' AS kind, k, NULL::INT AS \"column\" FROM base")
def diff_created(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, _, _ = three(spark, sf_dir, False)
    return d.diff_cells(base.limit(0), base, KEYS, VALUES)


@query(f"WITH base AS ({_BASE}) SELECT 'removed' AS kind, k, NULL::INT AS \"column\" FROM base")
def diff_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, _, _ = three(spark, sf_dir, False)
    return d.diff_cells(base, base.limit(0), KEYS, VALUES)


# Table merge

_PICK = "CASE WHEN o.{c} IS NOT DISTINCT FROM t.{c} OR t.{c} IS NOT DISTINCT FROM b.{c} THEN o.{c} WHEN o.{c} IS NOT DISTINCT FROM b.{c} THEN t.{c} ELSE b.{c} END"
_ALL = "(SELECT k FROM base UNION SELECT k FROM ours UNION SELECT k FROM theirs) a LEFT JOIN base b ON b.k = a.k LEFT JOIN ours o ON o.k = a.k LEFT JOIN theirs t ON t.k = a.k"
_ROW_SAME = "({x}.s IS NOT DISTINCT FROM b.s AND {x}.p IS NOT DISTINCT FROM b.p AND {x}.r IS NOT DISTINCT FROM b.r)"
_CELLS = ", ".join(f"CASE WHEN o.k IS NOT NULL AND t.k IS NOT NULL THEN {_PICK.format(c=c)} ELSE coalesce(o.{c}, t.{c}) END AS {c}" for c in "spr")
_MERGED = f" SELECT a.k, {_CELLS} FROM {_ALL} WHERE (o.k IS NOT NULL AND t.k IS NOT NULL) OR (b.k IS NULL AND (o.k IS NOT NULL OR t.k IS NOT NULL))"
_CONFLICTS = f""" SELECT k, "column", CASE WHEN "column" IS NULL THEN '{m.DELETED_CHANGED}' ELSE '{m.CHANGED_BOTH}' END AS reason FROM (
    SELECT a.k, NULL::INT AS "column" FROM {_ALL} WHERE b.k IS NOT NULL AND ((o.k IS NULL AND t.k IS NOT NULL AND NOT {_ROW_SAME.format(x="t")}) OR (t.k IS NULL AND o.k IS NOT NULL AND NOT {_ROW_SAME.format(x="o")}))
    """ + "".join(f"""UNION ALL SELECT a.k, {tag} FROM {_ALL} WHERE o.k IS NOT NULL AND t.k IS NOT NULL AND o.{c} IS DISTINCT FROM t.{c} AND o.{c} IS DISTINCT FROM b.{c} AND t.{c} IS DISTINCT FROM b.{c}
    """ for c, tag in VALUES.items()) + ")"  # fmt: skip


@query(with_sides(False) + _MERGED)
def table_merge_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.merge_rows(*three(spark, sf_dir, False), KEYS, VALUES).rows


@query(with_sides(True) + _CONFLICTS)
def table_merge_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.merge_rows(*three(spark, sf_dir, True), KEYS, VALUES).conflicts


@query(with_sides(True) + " SELECT k, s, p, r FROM ours")
def table_merge_ours_on_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = three(spark, sf_dir, True)
    return m.merge_rows(*sides, KEYS, VALUES).resolve(sides[1])


@query(with_sides(True) + f" SELECT a.k, {_PICK.format(c='r')} AS r, (o.r IS DISTINCT FROM t.r AND o.r IS DISTINCT FROM b.r AND t.r IS DISTINCT FROM b.r) AS clash FROM {_ALL}")
def scalar_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = m.sides(*three(spark, sf_dir, True), KEYS, list(VALUES))
    cells = [F.col(f"{s}.r") for s in "bot"]
    return both.select("k", policies.scalar(*cells).alias("r"), policies.scalar_clash(*cells).alias("clash"))


@query("SELECT event_id, (coalesce(user_id, 0) + (event_id % 5) + (event_id % 3))::BIGINT AS n FROM events")
def counter_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.coalesce(F.col("user_id"), F.lit(0))
    e = F.col("event_id")
    return _t(spark, sf_dir, "events").select("event_id", policies.counter(base, base + e % 5, base + e % 3).alias("n"))


@query("SELECT event_id, ((9223372036854775807::HUGEINT + 2 * (event_id % 4) + 9223372036854775808::HUGEINT) % 18446744073709551616::HUGEINT - 9223372036854775808::HUGEINT)::BIGINT AS n FROM events")
def counter_merge_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = F.lit(9223372036854775807).cast("bigint")
    return _t(spark, sf_dir, "events").select("event_id", policies.counter(F.lit(0).cast("bigint"), top, F.col("event_id") % 4 * 2).alias("n"))


# Scans and lookups

_CUSTOMER_KEYS = ["c_custkey"]


@query("SELECT * FROM customer")
def table_scan_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.scan(_t(spark, sf_dir, "customer"), _CUSTOMER_KEYS, ordered=True)


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey = 42")
def engine_point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = database(spark, "point").session("q").begin()
    t = tx.create_table("customer", CUSTOMER)
    t.insert(_t(spark, sf_dir, "customer").select(*[c.name for c in CUSTOMER.columns]))
    return spark.createDataFrame([t.get(42)], t.frame().schema)


@query("SELECT * FROM customer WHERE c_custkey = 42")
def table_point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.point_get(_t(spark, sf_dir, "customer"), {"c_custkey": 42})


@query("SELECT * FROM customer WHERE c_nationkey IS NOT DISTINCT FROM 7")
def index_lookup_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.index_lookup(_t(spark, sf_dir, "customer"), ["c_nationkey"], [7], _CUSTOMER_KEYS)


@query("SELECT * FROM customer WHERE c_nationkey IS NOT DISTINCT FROM 7")
def index_lookup_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.index_lookup(_t(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], [7], _CUSTOMER_KEYS)


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_nationkey END AS n FROM customer WHERE c_custkey % 7 = 0")
def index_lookup_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_nationkey")).alias("n"))
    return lookup.index_lookup(df, ["n"], [None], _CUSTOMER_KEYS)


@query("SELECT url, length(html)::BIGINT AS size FROM (SELECT url, max(html) AS html FROM pages GROUP BY url) WHERE url >= 'http://m' AND html IS NOT NULL")
def kv_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map of pages by URL, read from a key on in key order."""
    pages = _t(spark, sf_dir, "pages").groupBy("url").agg(F.max("html").alias("html")).filter("html is not null and url is not null")
    rows = pages.select(F.col("url").cast("binary").alias("key"), *[(F.col("html") if n == "bytes" else F.lit(m.BYTES) if n == "kind" else F.lit(None)).cast(k).alias(n) for n, k in m.KV_COLUMNS.items()])
    tx = database(spark, "range").session("q").begin()
    held = tx.create_kv("pages")
    held.put(rows)
    return held.scan_from(b"http://m").select(F.col("key").cast("string").alias("url"), F.length(F.col("bytes").cast("string")).cast("bigint").alias("size"))


# Key-value maps: flat rows of a value's members stand for the value

_TAGGED = """WITH m AS (SELECT o_custkey AS k, o_orderpriority AS e, o_orderkey AS g FROM orders),
    b AS (SELECT * FROM m WHERE g % 3 <> 0), o AS (SELECT * FROM m WHERE g % 3 = 1 OR (g % 3 = 2 AND g % 7 <> 0) OR (g % 3 = 0 AND g % 5 = 0)),
    t AS (SELECT * FROM m WHERE g % 3 = 2 OR (g % 3 = 1 AND g % 11 <> 0) OR (g % 3 = 0 AND g % 4 = 0))"""


def _grouped(df: DataFrame, kind: int, column: str, member: F.Column) -> DataFrame:
    """A map of one kind of value from rows of members."""
    cells = [(F.array_sort(F.collect_list(member)) if n == column else F.lit(kind) if n == "kind" else F.lit(None)).cast(k).alias(n) for n, k in m.KV_COLUMNS.items()]
    return df.groupBy(F.col("k").cast("string").cast("binary").alias("key")).agg(*cells)


def _tagged_sides(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    rows = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("e"), F.col("o_orderkey").alias("g"), F.col("o_totalprice").alias("p"))
    g = F.col("g")
    tests = [g % 3 != 0, (g % 3 == 1) | ((g % 3 == 2) & (g % 7 != 0)) | ((g % 3 == 0) & (g % 5 == 0)), (g % 3 == 2) | ((g % 3 == 1) & (g % 11 != 0)) | ((g % 3 == 0) & (g % 4 == 0))]
    return [rows.filter(x) for x in tests]


@query(_TAGGED + """, keys AS (SELECT k FROM b INTERSECT SELECT k FROM o INTERSECT SELECT k FROM t)
    SELECT k::VARCHAR AS k, e, g FROM (((SELECT * FROM o INTERSECT SELECT * FROM t) UNION (SELECT * FROM o EXCEPT SELECT * FROM b) UNION (SELECT * FROM t EXCEPT SELECT * FROM b))) WHERE k IN (SELECT k FROM keys)""")
def orset_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    member = F.struct(F.col("e").cast("binary").alias("elem"), F.col("g").cast("decimal(20,0)").alias("tag"))
    sides = [_grouped(df, m.SET, "members", member) for df in _tagged_sides(spark, sf_dir)]
    there = sides[0].select("key").join(sides[1].select("key"), "key", "left_semi").join(sides[2].select("key"), "key", "left_semi")
    rows = m.merge_kv(*[s.join(there, "key", "left_semi") for s in sides]).rows
    return rows.select(F.col("key").cast("string").alias("k"), F.explode("members").alias("x")).select("k", F.col("x.elem").cast("string").alias("e"), F.col("x.tag").cast("bigint").alias("g"))


_FIELDS = """WITH f AS (SELECT (o_orderkey // 4) AS k, 'f' || (o_orderkey % 4) AS n, o_orderkey AS g, o_orderpriority AS v FROM orders),
    b AS (SELECT k, n, v FROM f), o AS (SELECT k, n, CASE WHEN g % 6 = 0 THEN 'X' ELSE v END AS v FROM f WHERE g % 9 <> 1),
    t AS (SELECT k, n, CASE WHEN g % {d} = 0 THEN 'Y' ELSE v END AS v FROM f WHERE g % 8 <> 3),
    a AS (SELECT f.k, f.n, b.v AS b, o.v AS o, t.v AS t FROM f LEFT JOIN b USING (k, n) LEFT JOIN o USING (k, n) LEFT JOIN t USING (k, n)),
    c AS (SELECT *, (o IS DISTINCT FROM t AND o IS DISTINCT FROM b AND t IS DISTINCT FROM b) AS clash FROM a)"""


def _field_sides(spark: SparkSession, sf_dir: str, step: int) -> list[DataFrame]:
    g = F.col("o_orderkey")
    f = _t(spark, sf_dir, "orders").select(F.floor(g / 4).cast("bigint").alias("k"), F.concat(F.lit("f"), (g % 4).cast("string")).alias("n"), g.alias("g"), F.col("o_orderpriority").alias("v"))
    g = F.col("g")
    ours = f.filter(g % 9 != 1).withColumn("v", F.when(g % 6 == 0, "X").otherwise(F.col("v")))
    theirs = f.filter(g % 8 != 3).withColumn("v", F.when(g % step == 0, "Y").otherwise(F.col("v")))
    member = F.struct(F.col("n").cast("binary").alias("name"), F.col("v").cast("binary").alias("value"))
    return [_grouped(df, m.HASH, "fields", member) for df in (f, ours, theirs)]


@query(_FIELDS.format(d=10) + """ SELECT k::VARCHAR AS k, n, CASE WHEN o IS NOT DISTINCT FROM t OR t IS NOT DISTINCT FROM b THEN o WHEN o IS NOT DISTINCT FROM b THEN t ELSE b END AS v
    FROM c WHERE (CASE WHEN o IS NOT DISTINCT FROM t OR t IS NOT DISTINCT FROM b THEN o WHEN o IS NOT DISTINCT FROM b THEN t ELSE b END) IS NOT NULL""")
def hash_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = m.merge_kv(*_field_sides(spark, sf_dir, 10)).rows
    return rows.select(F.col("key").cast("string").alias("k"), F.explode("fields").alias("x")).select("k", F.col("x.name").cast("string").alias("n"), F.col("x.value").cast("string").alias("v"))


@query(_FIELDS.format(d=10) + f" SELECT k::VARCHAR AS k, n AS place, CASE WHEN o IS NULL OR t IS NULL THEN '{m.DELETED_CHANGED}' ELSE '{m.CHANGED_BOTH}' END AS reason FROM c WHERE clash")
def hash_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = m.merge_kv(*_field_sides(spark, sf_dir, 10)).conflicts
    return found.select(F.col("key").cast("string").alias("k"), F.col("place").cast("string").alias("place"), "reason")


@query(_TAGGED.replace("o_orderkey AS g FROM", "o_orderkey AS g, o_totalprice AS p FROM") + """, keys AS (SELECT k FROM b INTERSECT SELECT k FROM o INTERSECT SELECT k FROM t)
    SELECT k::VARCHAR AS k, e, g, p FROM (((SELECT * FROM o INTERSECT SELECT * FROM t) UNION (SELECT * FROM o EXCEPT SELECT * FROM b) UNION (SELECT * FROM t EXCEPT SELECT * FROM b))) WHERE k IN (SELECT k FROM keys)""")
def sortedset_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    member = F.struct(F.col("p").alias("score"), F.col("e").cast("binary").alias("member"), F.col("g").cast("decimal(20,0)").alias("tag"))
    sides = [_grouped(df, m.SORTED_SET, "scores", member) for df in _tagged_sides(spark, sf_dir)]
    there = sides[0].select("key").join(sides[1].select("key"), "key", "left_semi").join(sides[2].select("key"), "key", "left_semi")
    rows = m.merge_kv(*[s.join(there, "key", "left_semi") for s in sides]).rows
    return rows.select(F.col("key").cast("string").alias("k"), F.explode("scores").alias("x")).select("k", F.col("x.member").cast("string").alias("e"), F.col("x.tag").cast("bigint").alias("g"), F.col("x.score").alias("p"))


_SCORED = """WITH f AS (SELECT (o_orderkey // 4) AS k, 'm' || (o_orderkey % 4) AS n, o_orderkey AS g, o_totalprice AS p FROM orders),
    o AS (SELECT k, n, CASE WHEN g % 6 = 0 THEN p + 1 ELSE p END AS p FROM f WHERE g % 9 <> 1), t AS (SELECT k, n, CASE WHEN g % 10 = 0 THEN p + 2 ELSE p END AS p FROM f WHERE g % 8 <> 3),
    a AS (SELECT f.k, f.n, f.p AS b, o.p AS o, t.p AS t FROM f JOIN o USING (k, n) JOIN t USING (k, n))"""


@query(_SCORED + f" SELECT k::VARCHAR AS k, n AS place, '{m.CHANGED_BOTH}' AS reason FROM a WHERE o <> t AND o <> b AND t <> b")
def sortedset_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members that both sides scored anew, unlike; a member that one side removed is gone without a conflict."""
    g = F.col("o_orderkey")
    f = _t(spark, sf_dir, "orders").select(F.floor(g / 4).cast("bigint").alias("k"), F.concat(F.lit("m"), (g % 4).cast("string")).alias("n"), g.alias("g"), F.col("o_totalprice").alias("p"))
    g = F.col("g")
    ours, theirs = f.filter(g % 9 != 1).withColumn("p", F.when(g % 6 == 0, F.col("p") + 1).otherwise(F.col("p"))), f.filter(g % 8 != 3).withColumn("p", F.when(g % 10 == 0, F.col("p") + 2).otherwise(F.col("p")))
    member = F.struct(F.col("p").alias("score"), F.col("n").cast("binary").alias("member"), F.lit(1).cast("decimal(20,0)").alias("tag"))
    found = m.merge_kv(*[_grouped(df, m.SORTED_SET, "scores", member) for df in (f, ours, theirs)]).conflicts.filter("place is not null")
    return found.select(F.col("key").cast("string").alias("k"), F.col("place").cast("string").alias("place"), "reason")


_KV_BYTES = with_sides(True)


def _bytes_map(df: DataFrame) -> DataFrame:
    cells = [(F.col("r").cast("binary") if n == "bytes" else F.lit(m.BYTES) if n == "kind" else F.lit(None)).cast(k).alias(n) for n, k in m.KV_COLUMNS.items()]
    return df.select(F.col("k").cast("string").cast("binary").alias("key"), *cells)


@query(_KV_BYTES + f" SELECT a.k::VARCHAR AS k, {_PICK.format(c='r')} AS r FROM {_ALL} WHERE {_PICK.format(c='r')} IS NOT NULL")
def kv_merge_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = m.merge_kv(*map(_bytes_map, three(spark, sf_dir, True)))
    base, _, _ = map(_bytes_map, three(spark, sf_dir, True))
    kept = base.join(result.conflicts.select("key").distinct(), "key", "left_semi").select("key", "bytes")
    return result.rows.select("key", "bytes").unionByName(kept).select(F.col("key").cast("string").alias("k"), F.col("bytes").cast("string").alias("r"))


@query(_KV_BYTES + f""" SELECT a.k::VARCHAR AS k, CASE WHEN o.r IS NULL OR t.r IS NULL THEN '{m.DELETED_CHANGED}' WHEN b.r IS NULL THEN '{m.ADDED_BOTH}' ELSE '{m.CHANGED_BOTH}' END AS reason
    FROM {_ALL} WHERE o.r IS DISTINCT FROM t.r AND o.r IS DISTINCT FROM b.r AND t.r IS DISTINCT FROM b.r""")
def kv_merge_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.merge_kv(*map(_bytes_map, three(spark, sf_dir, True))).conflicts.select(F.col("key").cast("string").alias("k"), "reason")


@query(with_sides(False) + """ SELECT CASE WHEN f.k IS NULL THEN 'added' WHEN t.k IS NULL THEN 'removed' ELSE 'modified' END AS kind, coalesce(f.k, t.k)::VARCHAR AS k
    FROM base f FULL JOIN ours t ON f.k = t.k WHERE f.r IS DISTINCT FROM t.r""")
def kv_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, ours, _ = three(spark, sf_dir, False)
    found = d.diff_rows(_bytes_map(base), _bytes_map(ours), ["key"], list(m.KV_COLUMNS))
    return found.select("kind", F.col("key").cast("string").alias("k"))


# Documents

def _records(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    e = _t(spark, sf_dir, "events")
    i = F.col("event_id")
    doc = lambda a, b: F.to_json(F.struct(F.struct(a.alias("x"), b.alias("y")).alias("o"), F.col("event_type").alias("t")))
    base, ours, theirs = (i % 100, i % 50), (F.when(i % 3 == 0, i % 100 + 1000).otherwise(i % 100), i % 50), (i % 100, F.when(i % 2 == 0, i % 50 + 500).otherwise(i % 50))
    return [e.select(i.cast("string").cast("binary").alias("id"), doc(*x).alias("doc")) for x in (base, ours, theirs)]


@query("SELECT event_id::VARCHAR AS id, '{\"o\":{\"x\":' || (event_id % 100 + CASE WHEN event_id % 3 = 0 THEN 1000 ELSE 0 END) || ',\"y\":' || (event_id % 50 + CASE WHEN event_id % 2 = 0 THEN 500 ELSE 0 END) || '},\"t\":\"' || event_type || '\"}' AS doc FROM events")
def document_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.merge_documents(*_records(spark, sf_dir)).rows.select(F.col("id").cast("string").alias("id"), "doc")


@query("SELECT event_id::VARCHAR AS id, 'o/x' AS path, 'both sides wrote unlike values here' AS reason FROM events WHERE event_id % 6 = 0")
def tree_merge_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, ours, theirs = _records(spark, sf_dir)
    x = F.col("event_id")
    e = _t(spark, sf_dir, "events")
    other = e.select(x.cast("string").cast("binary").alias("id"), F.to_json(F.struct(F.struct(F.when(x % 2 == 0, x % 100 + 7000).otherwise(x % 100).alias("x"), (x % 50).alias("y")).alias("o"), F.col("event_type").alias("t"))).alias("doc"))
    return m.merge_documents(base, ours, other).conflicts.select(F.col("id").cast("string").alias("id"), "path", "reason")


@query("SELECT 'modified' AS kind, event_id::VARCHAR AS id FROM events WHERE event_id % 3 = 0")
def document_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, ours, _ = _records(spark, sf_dir)
    return d.diff_rows(base, ours, ["id"], ["doc"]).select("kind", F.col("id").cast("string").alias("id"))


@query("""WITH s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations),
    m AS (SELECT conv_id, i, 0 AS late, 'T' || i AS e FROM s WHERE i % 5 <> 1 UNION ALL SELECT conv_id, i, 1, 'N' || i FROM s WHERE i % 5 = 3)
    SELECT conv_id::VARCHAR AS k, (row_number() OVER (PARTITION BY conv_id ORDER BY i, late) - 1)::INT AS place, e FROM m""")
def sequence_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").cast("binary").alias("key")).agg(F.count("*").cast("int").alias("n"))
    places = F.sequence(F.lit(0), F.col("n") - 1)
    item = lambda mark, i: F.concat(F.lit(mark), i.cast("string")).cast("binary")
    base = F.transform(places, lambda i: item("T", i))
    ours = F.transform(F.filter(places, lambda i: i % 5 != 1), lambda i: item("T", i))  # deletions
    theirs = F.flatten(F.transform(places, lambda i: F.when(i % 5 == 3, F.array(item("T", i), item("N", i))).otherwise(F.array(item("T", i)))))  # insertions
    sides = [rows.select("key", *[(v if n == "seq" else F.lit(m.SEQUENCE) if n == "kind" else F.lit(None)).cast(k).alias(n) for n, k in m.KV_COLUMNS.items()]) for v in (base, ours, theirs)]
    merged = m.merge_kv(*sides).rows
    return merged.select(F.col("key").cast("string").alias("k"), F.posexplode("seq").alias("place", "e")).select("k", "place", F.col("e").cast("string").alias("e"))


# Schemas

CUSTOMER = Schema(
    (Column(1, "c_custkey", "int8"), Column(2, "c_name", "text"), Column(3, "c_nationkey", "int4"), Column(4, "c_acctbal", "float8"), Column(5, "c_mktsegment", "varchar", False, 20)),
    (1,), (Index(10, (3,)),),
)


def _evolved(*columns: Column, drop: tuple[int, ...] = ()) -> Schema:
    new = {c.tag: c for c in CUSTOMER.columns if c.tag not in drop} | {c.tag: c for c in columns}
    return Schema(tuple(new.values()), (1,), tuple(x for x in CUSTOMER.indexes if not set(x.columns) & set(drop)))


@query("SELECT *, NULL::VARCHAR AS phone FROM customer")
def schema_add_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.as_schema(_t(spark, sf_dir, "customer"), CUSTOMER, _evolved(Column(6, "phone", "text", True)))


@query("SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def schema_widen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.as_schema(_t(spark, sf_dir, "customer"), CUSTOMER, _evolved(Column(3, "c_nationkey", "int8")))


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def schema_drop_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.as_schema(_t(spark, sf_dir, "customer"), CUSTOMER, _evolved(drop=(3,)))


@query("SELECT c_custkey, c_name AS full_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def schema_rename_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged, clashes = merge_schemas(CUSTOMER, _evolved(Column(2, "full_name", "text")), _evolved(Column(3, "c_nationkey", "int8")))
    assert merged is not None and not clashes
    return m.as_schema(_t(spark, sf_dir, "customer"), CUSTOMER, merged)


# Writes and transactions

@query(_w := f"""WITH base AS ({_BASE}) SELECT * FROM base WHERE k % 10 NOT IN (0, 1) UNION ALL SELECT k, 'U', p + 1, NULL FROM base WHERE k % 10 = 0
    UNION ALL SELECT k + 90000000, s, p, r FROM base WHERE k % 25 = 0""")
def txn_insert_update_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, _, _ = three(spark, sf_dir, False)
    k = F.col("k")
    now = lookup.insert(base, base.filter(k % 25 == 0).withColumn("k", k + 90000000), KEYS)
    now = lookup.update(now, base.filter(k % 10 == 0).select("k", F.lit("U").alias("s"), (F.col("p") + 1).alias("p")), KEYS)
    return lookup.delete(now, base.filter(k % 10 == 1), KEYS)


@query(f"WITH base AS ({_BASE}) SELECT k, CASE WHEN k % 4 = 0 THEN 'U' ELSE s END AS s, CASE WHEN k % 4 = 0 THEN NULL ELSE p END AS p, CASE WHEN k % 4 = 0 THEN NULL ELSE r END AS r FROM base")
def upsert_full_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, _, _ = three(spark, sf_dir, False)
    return lookup.upsert(base, base.filter(F.col("k") % 4 == 0).select("k", F.lit("U").alias("s")), KEYS)


_TOUCHED = "(SELECT coalesce(b.k, x.k) AS k FROM base b FULL JOIN {x} x ON b.k = x.k WHERE b.k IS NULL OR x.k IS NULL OR b.s IS DISTINCT FROM x.s OR b.p IS DISTINCT FROM x.p OR b.r IS DISTINCT FROM x.r)"


@query(with_sides(False) + f" SELECT k FROM ({_TOUCHED.format(x='ours')} INTERSECT {_TOUCHED.format(x='theirs')})")
def txn_item_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, ours, theirs = three(spark, sf_dir, False)
    return d.diff_rows(base, ours, KEYS, list(VALUES)).select("k").join(d.diff_rows(base, theirs, KEYS, list(VALUES)).select("k"), "k", "left_semi")


@query(with_sides(False) + f" SELECT k FROM ({_TOUCHED.format(x='ours')} INTERSECT {_TOUCHED.format(x='theirs')})")
def rebase_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, ours, theirs = three(spark, sf_dir, False)
    return m.collisions(d.diff_rows(base, ours, KEYS, list(VALUES)), base, theirs, KEYS, list(VALUES))


@query(with_sides(False) + """, put AS (SELECT * FROM base WHERE k % 23 = 0) SELECT * FROM theirs WHERE k % 23 NOT IN (0, 1) OR k > 20000000 AND k NOT IN (SELECT k FROM put) AND NOT (k % 23 = 1 AND k < 20000000)
    UNION ALL SELECT k, 'R', p, r FROM put""")
def rebase_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, _, theirs = three(spark, sf_dir, False)
    k = F.col("k")
    return m.rebase(base.filter(k % 23 == 0).withColumn("s", F.lit("R")), base.filter(k % 23 == 1).select("k"), theirs, KEYS)


# Typed cells

@query("SELECT * FROM (VALUES ('1.50', '1.5'), ('-0', '0'), ('01', '1'), ('1.', '1'), ('.5', '0.5'), ('1e5', '100000'), ('1.5e3', '1500'), ('-0.0010', '-0.001'), ('12345678901234567890', '12345678901234567890'), ('1E-2', '0.01'), ('', NULL), ('-', NULL), ('.', NULL), ('e5', NULL), ('1e', NULL), ('1.2.3', NULL), ('abc', NULL), ('1 2', NULL), ('+1', NULL)) t(given, canonical)")
def numeric_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = ["1.50", "-0", "01", "1.", ".5", "1e5", "1.5e3", "-0.0010", "12345678901234567890", "1E-2", "", "-", ".", "e5", "1e", "1.2.3", "abc", "1 2", "+1"]
    return spark.createDataFrame([(x,) for x in given], "given string").select("given", canonical_numeric(F.col("given")).alias("canonical"))


@query("SELECT o_orderkey AS k, row_number() OVER (ORDER BY (o_totalprice - 200000)::DECIMAL(18,2), o_orderkey) AS place FROM orders")
def numeric_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = (F.col("o_totalprice") - 200000).cast("decimal(18,2)").cast("string")
    keyed = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), numeric_sort_key(canonical_numeric(text)).alias("key"))
    return lookup.ranked(keyed, [F.col("key"), F.col("k")]).select("k", "place")


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN '{"k":' || regexp_extract(props, '[0-9]+') || '}' WHEN 1 THEN '{"a":[true,null,"' || event_type || '"],"b":' || event_id || '}'
    WHEN 2 THEN event_id || '00' WHEN 3 THEN '{"x":{"y":[]},"z":"é/"}' WHEN 4 THEN NULL ELSE '[0.5,-' || (event_id + 1) || ',"\\n"]' END AS canonical FROM events""")
def json_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = F.col("event_id").cast("string"), F.col("event_id") % 6
    text = (
        F.when(i == 0, F.col("props")).when(i == 1, F.concat(F.lit('{ "b" : '), e, F.lit(' , "a":[ true, null, "'), F.col("event_type"), F.lit('" ] }')))
        .when(i == 2, F.concat(e, F.lit(".0e2"))).when(i == 3, F.lit('{"z":"\\u00e9\\/","x":{"y":[ ]}}')).when(i == 4, F.lit('{"a":1,"a":2}'))
        .otherwise(F.concat(F.lit('[5e-1,-'), (F.col("event_id") + 1).cast("string"), F.lit('.00,"\\n"]')))
    )
    return _t(spark, sf_dir, "events").select("event_id", canonical_json(text).alias("canonical"))


@query("SELECT count(*) AS n FROM part WHERE length(p_name) > 12")
def varchar_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = Schema((Column(1, "p_partkey", "int8"), Column(2, "p_name", "varchar", False, 12)), (1,))
    return _t(spark, sf_dir, "part").filter(lookup.violations(schema)).agg(F.count("*").alias("n"))


_FLOATS = "CASE WHEN c_custkey % 7 = 0 THEN 'NaN'::DOUBLE WHEN c_custkey % 7 = 1 THEN 'Infinity'::DOUBLE WHEN c_custkey % 7 = 2 THEN -0.0::DOUBLE WHEN c_custkey % 7 = 3 THEN 0.0::DOUBLE WHEN c_custkey % 7 = 4 THEN NULL ELSE c_acctbal END"


@query(f"SELECT c_custkey, row_number() OVER (ORDER BY {_FLOATS} NULLS FIRST, c_custkey) AS place FROM customer")
def float_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    x = F.when(k % 7 == 0, float("nan")).when(k % 7 == 1, float("inf")).when(k % 7 == 2, -0.0).when(k % 7 == 3, 0.0).when(k % 7 == 4, F.lit(None)).otherwise(F.col("c_acctbal"))
    return lookup.ranked(lookup.normalised(_t(spark, sf_dir, "customer").select(k, x.alias("x"))), [F.col("x"), k]).select(k, "place")


@query("SELECT event_id, row_number() OVER (ORDER BY CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id END NULLS FIRST, event_id) AS place FROM events")
def null_first_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return lookup.ranked(_t(spark, sf_dir, "events").select(e, F.when(e % 5 != 0, e).alias("x")), [F.col("x"), e]).select(e, "place")


# Sums by scan

@query("SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY c_mktsegment")
def balances_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT event_type, sum(regexp_extract(props, '[0-9]+')::BIGINT)::BIGINT AS total FROM events GROUP BY event_type")
def docfields_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("total"))


@query("SELECT sum(user_id)::BIGINT AS total, count(*) AS n FROM events")
def counter_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").agg(F.sum("user_id").alias("total"), F.count("*").alias("n"))


# What may be written

@query(with_sides(True) + """, c AS (SELECT k, 0 AS "column" FROM base WHERE k % 2 = 0) SELECT k::VARCHAR AS k, CASE WHEN k % 3 = 0 THEN '[[' || k || ']]' ELSE '[[' || k || '],' || (k % 3) || ']' END AS location,
    '[["K' || k || '"],["a","b"]]' AS path_location, '[[{"hex":"' || lower(hex(encode(k::VARCHAR))) || '"}]]' AS key_location FROM c""")
def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, _, _ = three(spark, sf_dir, True)
    rows = base.filter(F.col("k") % 2 == 0).select("k", F.concat(F.lit("K"), F.col("k").cast("string")).alias("name"), F.col("k").cast("string").cast("binary").alias("raw"))
    rows = located(rows, ["k"], F.when(F.col("k") % 3 != 0, (F.col("k") % 3).cast("int")))
    rows = located(located(rows, ["name"], F.array(F.lit("a"), F.lit("b")), "path_location"), ["raw"], name="key_location")
    return rows.select(F.col("k").cast("string").alias("k"), "location", "path_location", "key_location")


@query("""SELECT o_orderkey AS k, o_orderkey % 16 BETWEEN 1 AND 13 AS bad FROM orders""")
def kv_invalid_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule broken by each of most remainders: keys, kinds, payloads, repeats, NaN, sizes."""
    k, none = F.col("o_orderkey"), F.lit(None)
    r = k % 16
    raw = lambda text: F.lit(text).cast("binary")
    tag = lambda n: F.lit(n).cast("decimal(20,0)")
    big = lambda n: F.repeat(F.lit("x"), n).cast("binary")
    member = lambda e, t: F.struct(e.alias("elem"), tag(t).alias("tag"))
    score = lambda x, e, t: F.struct(F.lit(x).alias("score"), raw(e).alias("member"), tag(t).alias("tag"))
    field = lambda n, v: F.struct(raw(n).alias("name"), v.alias("value"))
    cells = {
        "key": F.when(r == 1, raw("")).when(r == 2, big(4097)).otherwise(k.cast("string").cast("binary")),
        "kind": F.when(r == 3, 9).when(r.isin(4, 5, 0), 1).when(r == 6, 2).when(r.isin(7, 8, 14), 3).when(r.isin(9, 10), 4).when(r.isin(11, 12, 15), 5).when(r == 13, 6).otherwise(1),
        "bytes": F.when(r == 4, big(262_145)).when(r == 5, none).when(r.isin(0, 1, 2, 3), raw("v")),
        "counter": F.when(r == 5, 1),  # and a counter (6) without a number
        "members": F.when(r == 7, F.array(member(raw("a"), 1), member(raw("b"), 2), member(raw("a"), 1))).when(r == 8, F.array(member(big(4097), 1)))
        .when(r == 14, F.array(member(raw("a"), 1), member(raw("a"), 2))),
        "fields": F.when(r == 9, F.array(field("n", raw("1")), field("n", raw("2")))).when(r == 10, F.array(field("n", none.cast("binary")))),
        "scores": F.when(r == 11, F.array(score(float("nan"), "a", 1))).when(r == 12, F.array(score(1.0, "a", 1), score(2.0, "a", 1)))
        .when(r == 15, F.array(score(1.0, "a", 1), score(1.0, "a", 2))),
        "seq": F.when(r == 13, F.transform(F.sequence(F.lit(1), F.lit(65)), lambda _: big(4096))),
    }
    rows = _t(spark, sf_dir, "orders").select(k.alias("k"), *[v.cast("binary" if n == "key" else m.KV_COLUMNS[n]).alias(n) for n, v in cells.items()])
    return rows.select("k", kv_violations().alias("bad"))


@query("""SELECT p_partkey, p_partkey % 5 IN (1, 2, 4) AS bad FROM part""")
def cell_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of 1 MiB in key order, their zero bytes counted twice, and keys of 4096 bytes."""
    k = F.col("p_partkey") % 5
    name = F.when(k == 1, F.repeat(F.lit("n"), 4094)).when(k == 2, F.repeat(F.lit("\x00"), 2100)).when(k == 3, F.repeat(F.lit("n"), 4093)).otherwise(F.lit("n"))
    note = F.when(k == 4, F.repeat(F.lit("x"), (1 << 20) - 2)).otherwise(F.lit("x"))
    schema = Schema((Column(1, "name", "text"), Column(2, "note", "text")), (1,))
    return _t(spark, sf_dir, "part").select("p_partkey", name.alias("name"), note.alias("note")).select("p_partkey", lookup.violations(schema).alias("bad"))


# The engine end to end

ORDERS = Schema((Column(1, "k", "int8"), Column(2, "s", "text", True), Column(3, "p", "float8", True), Column(4, "r", "text", True)), (1,))


def database(spark: SparkSession, name: str, **options):
    """A new database in the shared folder of the session (a temporary one where that is unset and Spark is local)."""
    import uuid

    from branchframe.engine.database import Database

    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="branchframe-db-")
    return Database.create(spark, f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}", **({"n_buckets": 8} | options))


def _write(session, now: DataFrame, before: DataFrame) -> None:
    """A transaction that turns the table's rows from ``before`` into ``now`` by inserts, updates and deletes."""
    tx = session.begin()
    t = tx.table("orders")
    t.insert(now.join(before.select("k"), "k", "left_anti").select(*now.columns))
    t.update(now.join(before, now.columns, "left_anti").join(before.select("k"), "k", "left_semi").select(*now.columns))
    t.delete(before.select("k").join(now.select("k"), "k", "left_anti"))
    tx.commit()


def _versions(spark: SparkSession, sf_dir: str, clashing: bool = False):
    """A database whose branches main and side hold a triple; merges may leave as many conflicts as there are."""
    base, ours, theirs = three(spark, sf_dir, clashing)
    db = database(spark, "orders", max_conflicts=None)
    s = db.session("q")
    tx = s.begin()
    tx.create_table("orders", ORDERS).insert(base)
    tx.commit()
    first = s.commit("base")
    s.create_branch("side")
    for branch, rows in (("main", ours), ("side", theirs)):
        own = db.session("q", branch)
        _write(own, rows, base)
        own.commit(branch)
    return db, s, first


@query(with_sides(False) + _MERGED)
def engine_branch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, s, _ = _versions(spark, sf_dir)
    s.merge("side", "both")
    return s.at("main", "orders")


@query(with_sides(True) + " SELECT k, s, p, r FROM ours")
def engine_merge_abort(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, s, _ = _versions(spark, sf_dir, True)
    head, conflicts = s.merge("side")
    if head is not None or conflicts is None:
        raise RuntimeError("no conflict was found")
    s.abort_merge()
    return s.begin().table("orders").frame()


@query(with_sides(True) + ", c AS (" + _CONFLICTS + """) SELECT CASE WHEN "column" IS NULL THEN '[[' || k || ']]' ELSE '[[' || k || '],' || "column" || ']' END AS location FROM c""")
def engine_conflict_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, s, _ = _versions(spark, sf_dir, True)
    return s.merge("side")[1].select("location")


@query(with_sides(False) + _DIFF_CELLS)
def engine_diff_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, s, first = _versions(spark, sf_dir)
    return s.diff(first, "main", "orders")


@query(f"WITH base AS ({_BASE}) SELECT * FROM base")
def engine_time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, s, first = _versions(spark, sf_dir)
    return s.at(first, "orders")


@query(with_sides(False) + " SELECT 'tag' AS ref, * FROM base UNION ALL SELECT 'branch', * FROM theirs UNION ALL SELECT 'commit', * FROM ours")
def engine_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    db, s, first = _versions(spark, sf_dir)
    db.create_tag("q", "v1", first)
    refs = {"tag": "v1", "branch": "side", "commit": db.resolve("main")}
    parts = [s.at(ref, "orders").select(F.lit(kind).alias("ref"), "*") for kind, ref in refs.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(with_sides(False) + """ SELECT k, CASE WHEN k % 4 = 0 THEN 'A' WHEN k % 4 = 1 THEN 'B' ELSE s END AS s, p, r FROM base""")
def engine_item_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two transactions from one snapshot: of different rows both land, a third that wrote the first one's rows doesn't."""
    base, _, _ = three(spark, sf_dir, False)
    s = database(spark, "items").session("q")
    tx = s.begin()
    tx.create_table("orders", ORDERS).insert(base)
    tx.commit()
    open_ones = [s.begin() for _ in range(3)]
    for tx, (rest, mark) in zip(open_ones, ((0, "A"), (1, "B"), (0, "C")), strict=True):
        tx.table("orders").update(base.filter(F.col("k") % 4 == rest).withColumn("s", F.lit(mark)))
    for tx in open_ones:
        try:
            tx.commit()
        except SerializationError:
            if tx is not open_ones[2]:
                raise
    return s.begin().table("orders").frame()


def _kv_rows(df: DataFrame, kind: int, **value: F.Column) -> DataFrame:
    return df.select(F.col("c_custkey").cast("string").cast("binary").alias("key"), *[(value[n] if n in value else F.lit(kind) if n == "kind" else F.lit(None)).cast(k).alias(n) for n, k in m.KV_COLUMNS.items()])


@query("SELECT c_custkey::VARCHAR AS k, 1000 + CASE WHEN c_custkey % 2 = 0 THEN 5 ELSE 0 END + CASE WHEN c_custkey % 3 = 0 THEN 7 ELSE 0 END AS n FROM customer")
def engine_counter_exemption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two transactions add to the same counters from one snapshot; both additions count."""
    c = _t(spark, sf_dir, "customer")
    s = database(spark, "counters").session("q")
    tx = s.begin()
    tx.create_kv("hits").put(_kv_rows(c, m.COUNTER, counter=F.lit(1000)))
    tx.commit()
    both = [s.begin(), s.begin()]
    for tx, step, more in zip(both, (2, 3), (5, 7), strict=True):
        tx.kv("hits").put(_kv_rows(c.filter(F.col("c_custkey") % step == 0), m.COUNTER, counter=F.lit(1000 + more)))
    for tx in both:
        tx.commit()
    return s.begin().kv("hits").frame().select(F.col("key").cast("string").alias("k"), F.col("counter").alias("n"))


@query("SELECT n_nationkey::VARCHAR AS k, CASE WHEN n_nationkey % 2 = 0 THEN 'second' ELSE n_name END AS v FROM nation")
def kv_put_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of one call with one key: the last counts."""
    rows = [(str(r["n_nationkey"]).encode(), r["n_name"].encode()) for r in _t(spark, sf_dir, "nation").collect()]
    rows += [(k, b"second") for k, _ in rows if int(k) % 2 == 0]
    tx = database(spark, "last").session("q").begin()
    names = tx.create_kv("names")
    names.put([{"key": k, "kind": m.BYTES, "bytes": v} for k, v in rows])
    return names.frame().select(F.col("key").cast("string").alias("k"), F.col("bytes").cast("string").alias("v"))


@query("SELECT c_custkey::VARCHAR AS k, c_name AS v FROM customer WHERE c_custkey = 42")
def kv_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = database(spark, "get").session("q").begin()
    names = tx.create_kv("names")
    names.put(_kv_rows(_t(spark, sf_dir, "customer"), m.BYTES, bytes=F.col("c_name").cast("binary")))
    found = names.get(b"42")
    return spark.createDataFrame([(found["key"].decode(), found["bytes"].decode())], "k string, v string")


@query("SELECT event_id::VARCHAR AS id, CASE WHEN event_id % 10 = 3 THEN '{\"k\":[]}' ELSE '{\"k\":' || regexp_extract(props, '[0-9]+') || '}' END AS doc FROM events WHERE event_id % 10 <> 4")
def document_put_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select(F.col("event_id").cast("string").cast("binary").alias("id"), F.col("props").alias("doc"), "event_id")
    tx = database(spark, "documents").session("q").begin()
    docs = tx.create_collection("events")
    docs.put(e.select("id", "doc"))
    docs.put(e.filter("event_id % 10 = 3").select("id", F.lit('{ "k" : [ ] }').alias("doc")))
    docs.delete(e.filter("event_id % 10 = 4").select("id"))
    return docs.scan().select(F.col("id").cast("string").alias("id"), "doc")


@query("SELECT r_name AS path, CASE r_regionkey % 3 WHEN 0 THEN 'removed' WHEN 1 THEN 'modified' ELSE 'added' END AS kind FROM region")
def namespace_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {r["r_regionkey"]: r["r_name"] for r in _t(spark, sf_dir, "region").collect()}
    s = database(spark, "names").session("q")
    entry = {"key": b"k", "kind": m.BYTES, "bytes": b"1"}
    tx = s.begin()
    for i, name in names.items():
        if i % 3 < 2:
            tx.create_kv(name).put([entry])
    tx.create_kv("same").put([entry])
    tx.commit()
    before = s.commit("before")
    tx = s.begin()
    for i, name in names.items():
        if i % 3 == 0:
            tx.drop(name)
        elif i % 3 == 1:
            tx.kv(name).put([entry | {"bytes": b"2"}])
        else:
            tx.create_kv(name)
    tx.commit()
    return s.diff_objects(before, s.commit("after"))


@query("SELECT row_number() OVER (ORDER BY r_regionkey DESC) - 1 AS place, r_name AS message FROM region UNION ALL SELECT (SELECT count(*) FROM region), 'initial commit'")
def log_newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = database(spark, "log").session("q")
    for r in _t(spark, sf_dir, "region").orderBy("r_regionkey").collect():
        s.commit(r["r_name"])
    return s.log().select(F.col("place").cast("bigint").alias("place"), "message")


@query("SELECT r_name AS name, 'kv' AS kind FROM region WHERE r_regionkey % 2 = 0")
def objects_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a principal may read: objects without a grant are left out."""
    held = grants.Grants()
    for permission in (grants.READ, grants.WRITE):
        held.grant("q", permission)
    db = database(spark, "objects", authorizer=held)
    tx = db.session("q").begin()
    for r in _t(spark, sf_dir, "region").collect():
        tx.create_kv(r["r_name"])
        if r["r_regionkey"] % 2 == 0:
            held.grant("guest", grants.READ, grants.Scope(grants.OBJECT, "main", r["r_name"]))
    tx.commit()
    return db.session("guest").objects_frame()


@query(with_sides(False) + " SELECT 'first' AS version, * FROM base UNION ALL SELECT 'side', * FROM theirs")
def gc_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection without grace deletes what a rolled-back write left, and nothing that a version reaches."""
    db, s, first = _versions(spark, sf_dir)
    db.collect("q", 0)
    db.collect("q", 0)
    return s.at(first, "orders").select(F.lit("first").alias("version"), "*").unionByName(s.at("side", "orders").select(F.lit("side").alias("version"), "*"))
