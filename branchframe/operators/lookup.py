"""Scans, point reads, index lookups, validation and writes of keyed rows, as plans that push filters down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from branchframe.errors import ExistsError, InvalidError, NotFoundError
from branchframe.functions.numeric import canonical_numeric
from branchframe.functions.values import over_limits
from branchframe.plans.schema import Schema


def scan(df: DataFrame, keys: list[str], ordered: bool = False) -> DataFrame:
    """All rows; in key order (nulls first, bytes of text) if asked."""
    return df.orderBy(*keys) if ordered else df


def point_get(df: DataFrame, key: dict) -> DataFrame:
    for name, value in key.items():
        df = df.filter(F.col(name) == F.lit(value))
    return df


def index_lookup(df: DataFrame, columns: list[str], values: list, keys: list[str]) -> DataFrame:
    """Rows whose first index columns equal ``values`` (None matches NULL), in index order."""
    if len(values) > len(columns):
        raise InvalidError("more values than index columns")
    for name, value in zip(columns, values, strict=False):
        df = df.filter(F.col(name).isNull() if value is None else F.col(name) == F.lit(value))
    return df.orderBy(*columns, *[k for k in keys if k not in columns])


def range_scan(df: DataFrame, key: str, start=None) -> DataFrame:
    """Rows from ``start`` on (inclusive; None is the first), in key order."""
    return (df if start is None else df.filter(F.col(key) >= F.lit(start))).orderBy(key)


def violations(schema: Schema) -> Column:
    """Whether a row breaks a rule of its columns: NULL, length, canonical decimals, sizes of uuid, jsonb, cells and keys, UTF-8.

    UTF-8 comes last: what is too long needs no reading.
    """
    bad, spelt = F.lit(False), F.lit(False)
    for c in schema.columns:
        x = F.col(c.name)
        if not c.nullable:
            bad = bad | x.isNull()
        if c.type == "varchar":
            bad = bad | F.coalesce(F.length(x) > c.max_len, F.lit(False))
        if c.type in ("text", "varchar", "jsonb"):
            spelt = spelt | F.coalesce(~F.is_valid_utf8(x), F.lit(False))
        if c.type == "numeric":
            bad = bad | (x.isNotNull() & ~canonical_numeric(x).eqNullSafe(x))
        if c.type == "uuid":
            bad = bad | F.coalesce(F.length(x) != 16, F.lit(False))
        if c.type == "jsonb":
            bad = bad | F.coalesce(F.length(x) == 0, F.lit(False))
    return bad | over_limits(schema) | spelt


def check_columns(df: DataFrame, schema: Schema, hidden: list[str] | None = None) -> DataFrame:
    """``df`` if its columns are exactly the schema's: values are never coerced."""
    want = {f.name: f.dataType for f in schema.struct()}
    have = {f.name: f.dataType for f in df.schema if f.name not in (hidden or [])}
    if want != have:
        raise InvalidError("the columns aren't the schema's: values are never coerced")
    return df


def check_rows(df: DataFrame, schema: Schema, hidden: list[str] | None = None) -> DataFrame:
    """``df`` if its columns are exactly the schema's and no row breaks a rule; one fused aggregate checks all."""
    if check_columns(df, schema, hidden).filter(violations(schema)).limit(1).count():
        raise InvalidError("a row breaks a rule of its columns")
    return df


def full_rows(df: DataFrame, schema: Schema) -> DataFrame:
    """Rows with the key and some other columns of a schema as whole rows: what they lack is NULL."""
    want = {f.name: f.dataType for f in schema.struct()}
    if any(f.name not in want or want[f.name] != f.dataType for f in df.schema) or not set(schema.key_names) <= set(df.columns):
        raise InvalidError("the columns aren't the schema's: values are never coerced")
    return df.select(*[(F.col(f"`{n}`") if n in df.columns else F.lit(None)).cast(k).alias(n) for n, k in want.items()])


def normalised(df: DataFrame) -> DataFrame:
    """-0.0 as 0.0 in floating-point columns, so equal rows have equal digests."""
    kinds = {f.name for f in df.schema if f.dataType.simpleString() in ("float", "double")}
    return df.withColumns({n: F.when(F.col(n) == 0, F.lit(0.0).cast(df.schema[n].dataType)).otherwise(F.col(n)) for n in kinds}) if kinds else df


def last_of_each(rows: list, keys: list[int]) -> list:
    """Rows of a list, of equal keys (places in a row) the last one only: a later write of one call replaces an earlier one."""
    return list({tuple(bytes(r[k]) if isinstance(r[k], bytearray) else r[k] for k in keys): r for r in rows}.values())


def insert(df: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` and new rows; ExistsError if a key is there already or comes twice."""
    found = rows.select(*keys).join(df.select(*keys), keys, "left_semi").limit(1).unionByName(rows.groupBy(*keys).count().filter("count > 1").select(*keys).limit(1))
    if not found.isEmpty():
        raise ExistsError("a key is taken")
    return df.unionByName(rows.select(*df.columns))


def update(df: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Whole rows replaced: columns that ``rows`` lacks become NULL; NotFoundError for a key that isn't there."""
    if not rows.select(*keys).join(df.select(*keys), keys, "left_anti").isEmpty():
        raise NotFoundError("no such row")
    return upsert(df, rows, keys)


def upsert(df: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    kinds = {f.name: f.dataType for f in df.schema}
    full = rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(kinds[n]).alias(n) for n in df.columns])
    return df.join(full.select(*keys), keys, "left_anti").unionByName(full)


def delete(df: DataFrame, gone: DataFrame, keys: list[str], must_exist: bool = True) -> DataFrame:
    """Rows without the given keys; a missing key is NotFoundError for tables, nothing for maps and documents."""
    if must_exist and not gone.select(*keys).join(df.select(*keys), keys, "left_anti").isEmpty():
        raise NotFoundError("no such row")
    return df.join(gone.select(*keys), keys, "left_anti")


def ranked(df: DataFrame, order: list[Column], name: str = "place", blocks: int = 64) -> DataFrame:
    """``df`` with each row's place from 1 on in the order of ``order``, which must tell all rows apart.

    Borders of blocks come from a bounded sample of rows (the first by a hash) and are literals of the plan, so a row's block is the
    same whenever it is computed. Blocks are counted, and rows numbered within theirs: no task sorts everything.
    """
    tidy = [F.struct(x.isNotNull().alias("known"), x.alias("value")).alias(f"k{i}") for i, x in enumerate(order)]  # NULL first
    key = F.struct(*tidy)
    sample = df.select(key.alias("key")).orderBy(F.xxhash64("key")).limit(30 * blocks)
    picked = sample.orderBy("key").collect()
    kind = sample.schema["key"].dataType
    step = max(1, len(picked) // blocks)
    borders = [_literal(r["key"], kind) for r in picked[step::step]]
    block, ahead, own = "_block", "_ahead", "_n"
    here = df.withColumn(block, F.size(F.filter(F.array(*borders), lambda x: x <= key)) if borders else F.lit(0))
    counts = here.groupBy(block).agg(F.count("*").alias(own))  # at most as many rows as blocks
    before = counts.withColumn(ahead, F.coalesce(F.sum(own).over(Window.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop(own)
    numbered = here.withColumn(name, F.row_number().over(Window.partitionBy(block).orderBy(key)))
    return numbered.join(F.broadcast(before), block).withColumn(name, F.col(name) + F.col(ahead)).drop(block, ahead)


def _literal(value, kind: T.DataType) -> Column:
    """A struct or plain value as a literal of a type."""
    if isinstance(kind, T.StructType):
        return F.struct(*[_literal(value[f.name], f.dataType).alias(f.name) for f in kind])
    return F.lit(value).cast(kind)
