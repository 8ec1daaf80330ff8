"""Three-way merges as DataFrames: tagged union and one grouping, so one exchange, then expressions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from branchframe.errors import InvalidError
from branchframe.functions import jsontext, policies
from branchframe.operators.sequence import merge_sequences, merge_trees
from branchframe.plans.schema import Schema, dropped_tags, merge_schemas
from branchframe.sources.shipping import ship

#: Reasons of conflicts in rows, cells and map entries.
DELETED_CHANGED = "one side removed it, the other wrote to it"
ADDED_BOTH = "new on both sides, with unlike values"
CHANGED_BOTH = "both sides wrote unlike values"
OTHER_KINDS = "both sides made it a value of another kind"
CHANGED_LIST = "both sides edited one part of the list, unlike"


def sides(base: DataFrame, ours: DataFrame, theirs: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys and the structs b, o, t of each key's values, null where a side has no such row: one exchange."""
    packed = [df.select(*keys, F.lit(i).alias("_side"), F.struct(*([F.col(v) for v in values] or [F.lit(1).alias("_present")])).alias("_row")) for i, df in enumerate((base, ours, theirs))]
    union = reduce(DataFrame.unionByName, packed)
    one = lambda i: F.max(F.when(F.col("_side") == i, F.col("_row")))
    if _orderable(union.schema["_row"].dataType):
        grouped = union.groupBy(*keys).agg(one(0).alias("b"), one(1).alias("o"), one(2).alias("t"))
    else:
        pick = lambda i: F.any_value(F.when(F.col("_side") == i, F.col("_row")), F.lit(True))
        grouped = union.groupBy(*keys).agg(pick(0).alias("b"), pick(1).alias("o"), pick(2).alias("t"))
    return grouped


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, (T.MapType, T.VariantType)):
        return False
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _orderable(kind.elementType)
    return True


@dataclass
class MergeResult:
    """``rows``: what every key becomes without conflicts; ``conflicts``: where sides clash. ``flagged``: places to look at."""

    rows: DataFrame
    conflicts: DataFrame
    flagged: DataFrame | None = None

    def resolve(self, ours: DataFrame) -> DataFrame:
        """The merged rows, or ours untouched if there is any conflict: decided in the plan, by EXISTS."""
        clash = self.conflicts.select(F.lit(1)).exists()
        return self.rows.filter(~clash).unionByName(ours.select(*self.rows.columns).filter(clash))


def merge_rows(base: DataFrame, ours: DataFrame, theirs: DataFrame, keys: list[str], values: dict[str, int]) -> MergeResult:
    """Rows merge by key, cells by column. One side's change is taken; both removed is gone; removed against
    changed is a conflict at the row (null column), a cell changed twice, differently, at the cell. Of a row
    added on both sides a NULL cell yields to the other."""
    names = list(values)
    both = sides(base, ours, theirs, keys, names)
    b, o, t = F.col("b"), F.col("o"), F.col("t")
    one_gone = (o.isNull() != t.isNull()) & b.isNotNull()
    row_clash = one_gone & ~policies.same(F.coalesce(o, t), b)
    gone = (one_gone & ~row_clash) | (o.isNull() & t.isNull())
    cell = lambda side, name: F.col(f"{side}.{name}")
    two = o.isNotNull() & t.isNotNull()
    merged = [
        F.when(two, policies.scalar(cell("b", n), cell("o", n), cell("t", n))).otherwise(F.coalesce(o, t)[n]).alias(n) for n in names
    ]
    clashes = [F.when(two & policies.scalar_clash(cell("b", n), cell("o", n), cell("t", n)), F.lit(tag)) for n, tag in values.items()]
    places = F.when(row_clash, F.array(F.lit(None).cast("int"))).otherwise(F.filter(F.array(*clashes) if clashes else F.array().cast("array<int>"), lambda x: x.isNotNull()))
    conflicts = both.select(*keys, F.explode(places).alias("column")).withColumn("reason", F.when(F.col("column").isNull(), DELETED_CHANGED).otherwise(CHANGED_BOTH))
    return MergeResult(both.filter(~gone).select(*keys, *merged), conflicts)


def as_schema(df: DataFrame, old: Schema, new: Schema) -> DataFrame:
    """Rows of one schema under another, columns matched by tag: renamed, widened, added as NULL, dropped."""
    kinds = {f.name: f.dataType for f in new.struct()}
    hidden = [] if old.primary_key else ["_rowid"]
    out = []
    for c in new.columns:
        before = old.column(c.tag)
        out.append((F.col(before.name) if before else F.lit(None)).cast(kinds[c.name]).alias(c.name))
    return df.select(*hidden, *out)


def merge_tables(base: DataFrame, ours: DataFrame, theirs: DataFrame, base_schema: Schema, our_schema: Schema, their_schema: Schema) -> tuple[Schema, MergeResult]:
    """Schemas first, then rows and cells. Conflicts have a location: ``schema...`` or null for rows and cells."""
    merged, clashes = merge_schemas(base_schema, our_schema, their_schema)
    spark = base.sparkSession
    keys = base_schema.key_names or ["_rowid"]
    empty = spark.createDataFrame([(c.location, c.reason) for c in clashes], "location string, reason string")
    if merged is None:
        return our_schema, MergeResult(ours, empty)
    moved = [as_schema(df, s, merged) for df, s in ((base, base_schema), (ours, our_schema), (theirs, their_schema))]
    keys = merged.key_names or ["_rowid"]
    result = merge_rows(*moved, keys, {c.name: c.tag for c in merged.value_columns})
    lost = []
    for side, side_schema, other, other_schema in ((ours, our_schema, theirs, their_schema), (theirs, their_schema, ours, our_schema)):
        for tag in dropped_tags(base_schema, side_schema):
            written = other_schema.column(tag)
            if written is not None:
                lost.append(_written(base, base_schema, other, other_schema, tag))
    conflicts = result.conflicts.withColumn("location", F.lit(None).cast("string"))
    for more in lost:
        conflicts = conflicts.unionByName(more, allowMissingColumns=True)
    return merged, MergeResult(result.rows, conflicts)


def _written(base: DataFrame, base_schema: Schema, other: DataFrame, other_schema: Schema, tag: int) -> DataFrame:
    """One conflict if a column that one side dropped was written by the other."""
    keys = base_schema.key_names or ["_rowid"]
    other_keys = other_schema.key_names or ["_rowid"]
    old = base.select(*keys, F.struct(F.col(base_schema.column(tag).name).alias("c")).alias("f"))
    new = other.select(*[F.col(a).alias(b) for a, b in zip(other_keys, keys, strict=True)], F.struct(F.col(other_schema.column(tag).name).alias("c")).alias("t"))
    hit = old.join(new, keys, "full_outer").filter(F.col("t").isNotNull() & ~F.col("f.c").eqNullSafe(F.col("t.c")))
    return hit.limit(1).select(F.lit(f"schema/{tag}").alias("location"), F.lit("one side dropped the column, the other wrote cells of it").alias("reason"))


#: Kinds of key-value entries, and the columns that carry them.
BYTES, COUNTER, SET, HASH, SORTED_SET, SEQUENCE = range(1, 7)
KV_COLUMNS = {
    "kind": "tinyint", "bytes": "binary", "counter": "bigint", "members": "array<struct<elem:binary,tag:decimal(20,0)>>",
    "fields": "array<struct<name:binary,value:binary>>", "scores": "array<struct<score:double,member:binary,tag:decimal(20,0)>>", "seq": "array<binary>",
}
KV_SCHEMA = ", ".join(["key binary", *(f"{n} {k}" for n, k in KV_COLUMNS.items())])
_KV_ROW = f"struct<{','.join(f'{n}:{k}' for n, k in KV_COLUMNS.items())}>"


def _kv_value(kind: int, **value: Column) -> Column:
    cells = {"kind": F.lit(kind), **value}
    return F.struct(*[cells.get(n, F.lit(None)).cast(k).alias(n) for n, k in KV_COLUMNS.items()]).cast(_KV_ROW)


def _sequences(b: Column, o: Column, t: Column) -> Column:
    """Merged sequences by a UDF, for keys whose sequence both sides changed only."""

    @F.pandas_udf("struct<seq:array<binary>,clash:boolean,flagged:array<int>>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for base, ours, theirs in batches:
            rows = []
            for x, y, z in zip(base, ours, theirs, strict=True):
                if x is None or y is None or z is None:
                    rows.append((None, None, None))
                    continue
                m = merge_sequences(*([bytes(e) for e in side] for side in (x, y, z)))
                rows.append((m.value, bool(m.conflicts), [int(p[-1]) for p, _ in m.flagged]))
            yield pd.DataFrame(rows, columns=["seq", "clash", "flagged"])

    return run(b, o, t)


#: Kinds whose members merge one by one, and how each column's items show as (name, tag, cell).
_MEMBERED = {
    SET: ("members", lambda x: (x["elem"], x["tag"], F.lit(None).cast("binary"), F.lit(None).cast("double"))),
    HASH: ("fields", lambda x: (x["name"], F.lit(None).cast("decimal(20,0)"), x["value"], F.lit(None).cast("double"))),
    SORTED_SET: ("scores", lambda x: (x["member"], x["tag"], F.lit(None).cast("binary"), x["score"])),
}
_NO_SPOTS = "array<struct<place:binary,reason:string>>"


def _items(side: int, name: str) -> Column:
    """The items of a side's sets, hashes and sorted sets as one array of (side, name, tag, cell)."""

    def flat(shape):
        def one(x: Column) -> Column:
            member, tag, value, score = shape(x)
            return F.struct(F.lit(side).alias("side"), member.alias("name"), tag.alias("tag"), F.struct(value.alias("value"), score.alias("score")).alias("cell"))

        return one

    none = F.array().cast("array<struct<side:int,name:binary,tag:decimal(20,0),cell:struct<value:binary,score:double>>>")
    return F.concat(*[F.coalesce(F.transform(F.col(f"{name}.{column}"), flat(shape)), none) for column, shape in _MEMBERED.values()])


def merge_members(both: DataFrame) -> DataFrame:
    """(key, v, spots) of rows (key, mode, b, o, t) of sets, hashes and sorted sets: members are grouped by (key, member).

    However many members a value has, each is compared with itself only; nothing scans an array for another's member.
    """
    items = both.select("key", "mode", F.explode(F.concat(*[_items(i, s) for i, s in enumerate("bot")])).alias("x")).select("key", "mode", "x.*")
    one = lambda side: F.max(F.when(F.col("side") == side, F.col("cell")))
    each = items.groupBy("key", "mode", "name", "tag").agg(one(0).alias("b"), one(1).alias("o"), one(2).alias("t"))
    b, o, t, mode = F.col("b"), F.col("o"), F.col("t"), F.col("mode")
    observed = (o.isNotNull() & t.isNotNull()) | (b.isNull() & (o.isNotNull() | t.isNotNull()))
    field = policies.scalar(b, o, t)
    stays = F.when(mode == HASH, field.isNotNull()).otherwise(observed)
    cell = F.when(mode == HASH, field).otherwise(F.coalesce(policies.scalar(b, o, t), o, t))
    clash = policies.scalar_clash(b, o, t) & ((mode == HASH) | ((mode == SORTED_SET) & observed))
    why = F.when(o.isNull() | t.isNull(), DELETED_CHANGED).otherwise(CHANGED_BOTH)
    each = each.select("key", "mode", "name", "tag", stays.alias("stays"), cell.alias("cell"), F.when(clash, F.struct(F.col("name").alias("place"), why.alias("reason"))).alias("spot"))
    kept = lambda kind, *parts: F.sort_array(F.collect_list(F.when(F.col("stays") & (mode == kind), F.struct(*parts))))
    name, tag = F.col("name"), F.col("tag")
    value = {
        "members": kept(SET, name.alias("elem"), tag.alias("tag")), "fields": kept(HASH, name.alias("name"), F.col("cell.value").alias("value")),
        "scores": kept(SORTED_SET, F.col("cell.score").alias("score"), name.alias("member"), tag.alias("tag")),
    }
    grouped = each.groupBy("key", "mode").agg(*[v.alias(n) for n, v in value.items()], F.sort_array(F.collect_list("spot")).alias("spots"))
    kinds = F.coalesce(*[F.when(mode == k, _kv_value(k, **{column: F.col(column)})) for k, (column, _) in _MEMBERED.items()])
    return grouped.select("key", kinds.alias("v"), F.col("spots").cast(_NO_SPOTS).alias("spots"))


def merge_kv(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> MergeResult:
    """Key-value maps merge by key, values by kind: counters add changes (equal ones too), sets keep the
    observed-remove rule, hashes merge by field, sorted sets by member, sequences as diff3. conflicts:
    (key, place, reason), place null at the key itself; flagged: (key, position)."""
    names = list(KV_COLUMNS)
    ship(base.sparkSession)
    both = sides(base, ours, theirs, ["key"], names)
    b, o, t = F.col("b"), F.col("o"), F.col("t")
    kind = lambda side: F.col(f"{side}.kind")
    one_kind = (kind("b") == kind("o")) & (kind("o") == kind("t"))
    counters = F.coalesce(one_kind & (kind("o") == COUNTER), F.lit(False))
    plain = policies.same(o, b) | policies.same(t, b) | (policies.same(o, t) & ~counters)
    deep = ~plain & F.coalesce(one_kind, F.lit(False))
    both = both.withColumn("mode", F.when(plain, 0).when(deep, kind("o").cast("int")).otherwise(-1))
    mode = F.col("mode")
    whole, membered = both.filter(~mode.isin(*_MEMBERED)), both.filter(mode.isin(*_MEMBERED))
    whole = whole.withColumn("sequence", _sequences(*(F.when(mode == SEQUENCE, F.col(f"{s}.seq")) for s in "bot")))
    value = (
        F.when(mode == 0, policies.scalar(b, o, t).cast(_KV_ROW))
        .when(mode == COUNTER, _kv_value(COUNTER, counter=policies.counter(*(F.col(f"{s}.counter") for s in "bot"))))
        .when(mode == SEQUENCE, _kv_value(SEQUENCE, seq=F.col("sequence.seq")))
    )
    kinds_differ = o.isNotNull() & t.isNotNull() & (kind("o") != kind("t"))
    at_key = F.when((mode == -1) | (mode == BYTES), F.when(o.isNull() | t.isNull(), DELETED_CHANGED).when(kinds_differ, OTHER_KINDS).when(b.isNull(), ADDED_BOTH).otherwise(CHANGED_BOTH))
    at_key = F.coalesce(at_key, F.when(F.coalesce(F.col("sequence.clash"), F.lit(False)), CHANGED_LIST))
    spots = F.when(at_key.isNotNull(), F.array(F.struct(F.lit(None).cast("binary").alias("place"), at_key.alias("reason")))).otherwise(F.array().cast(_NO_SPOTS))
    done = whole.select("key", value.alias("v"), spots.alias("spots"), "sequence.flagged").unionByName(merge_members(membered), allowMissingColumns=True)
    rows = done.filter("v is not null").select("key", *[F.col(f"v.{n}").alias(n) for n in names])
    return MergeResult(rows, done.select("key", F.inline("spots")), done.select("key", F.explode("flagged").alias("position")))


_TREE = "struct<doc:string,conflicts:array<struct<path:string,reason:string>>,flagged:array<string>>"


def _trees(b: Column, o: Column, t: Column, counters: frozenset[str]) -> Column:
    @F.pandas_udf(_TREE)
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for base, ours, theirs in batches:
            rows = []
            for x, y, z in zip(base, ours, theirs, strict=True):
                if x is None or y is None or z is None:
                    rows.append((None, None, None))
                    continue
                m = merge_trees(*map(jsontext.parse, (x, y, z)), lambda path: "/".join(path) in counters)
                rows.append((jsontext.encode(m.value), [{"path": "/".join(p), "reason": r} for p, r in m.conflicts], ["/".join(p) for p, _ in m.flagged]))
            yield pd.DataFrame(rows, columns=["doc", "conflicts", "flagged"])

    return run(b, o, t)


def merge_documents(base: DataFrame, ours: DataFrame, theirs: DataFrame, counters: frozenset[str] = frozenset()) -> MergeResult:
    """Collections of (id, doc: canonical JSON) merge by id, and records that both sides changed by path.

    The tree merge runs in Python for those records alone. conflicts: (id, path, reason), path null at
    the record; flagged: (id, path). ``counters`` are paths whose integers add up.
    """
    ship(base.sparkSession)
    both = sides(base, ours, theirs, ["id"], ["doc"])
    b, o, t = F.col("b"), F.col("o"), F.col("t")
    plain = policies.same(o, b) | policies.same(t, b) | policies.same(o, t)
    deep = ~plain & b.isNotNull() & o.isNotNull() & t.isNotNull()
    both = both.withColumns({"plain": plain, "deep": deep, "m": _trees(*(F.when(deep, F.col(f"{s}.doc")) for s in "bot"), counters)})
    whole = F.when(~F.col("plain") & ~F.col("deep"), F.when(o.isNull() | t.isNull(), DELETED_CHANGED).otherwise(ADDED_BOTH))
    record = F.array(F.struct(F.lit(None).cast("string").alias("path"), whole.alias("reason")))
    conflicts = both.select("id", F.inline(F.when(whole.isNotNull(), record).otherwise(F.col("m.conflicts"))))
    doc = F.when(F.col("plain"), policies.scalar(b, o, t)["doc"]).when(F.col("deep"), F.col("m.doc"))
    return MergeResult(both.select("id", doc.alias("doc")).filter("doc is not null"), conflicts, both.select("id", F.explode("m.flagged").alias("path")))


def collisions(changed: DataFrame, base: DataFrame, onto: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys of ``changed`` that ``onto`` holds otherwise than ``base``, even to the same value: two writes of one item."""
    touched = changed.select(*keys).distinct()
    pack = lambda df, name: df.join(touched, keys, "left_semi").select(*keys, F.struct(*([F.col(v) for v in values] or [F.lit(1)])).alias(name))
    return pack(base, "f").join(pack(onto, "t"), keys, "full_outer").filter(~F.col("f").eqNullSafe(F.col("t"))).select(*keys)


def rebase(puts: DataFrame, deletes: DataFrame, onto: DataFrame, keys: list[str]) -> DataFrame:
    """``onto`` with the changes of a side: its rows put, its keys deleted. Check collisions() first."""
    gone = puts.select(*keys).unionByName(deletes.select(*keys))
    return onto.join(gone, keys, "left_anti").unionByName(puts.select(*onto.columns))


def require_clean(result: MergeResult) -> None:
    if not result.conflicts.isEmpty():
        raise InvalidError("the merge has conflicts")
