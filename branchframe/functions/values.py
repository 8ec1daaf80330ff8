"""What a cell, a key or a map's value may be, as Column expressions that check whole frames in one pass."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from branchframe.plans.schema import Column as SchemaColumn
from branchframe.plans.schema import Schema

#: Fixed values of the data model, in bytes but for MAX_MEMBERS.
MAX_CELL, MAX_KEY = 1 << 20, 4096
MAX_VALUE, MAX_MEMBERS, MAX_MEMBER = 256 << 10, 65_536, 4096

#: Bytes of a cell of a fixed width, its presence mark included.
_FIXED = {"bool": 2, "int2": 3, "int4": 5, "int8": 9, "float4": 5, "float8": 9, "date": 5, "timestamp": 9, "timestamptz": 9, "uuid": 17}

#: The column that carries the value of each kind, 1 to 6.
PAYLOADS = ("bytes", "counter", "members", "fields", "scores", "seq")
BYTES, COUNTER, SET, HASH, SORTED_SET, SEQUENCE = range(1, 7)


def cell_bytes(column: SchemaColumn, zeros: Callable[[Column], Column] | None = None) -> Column:
    """Bytes of a cell in key order: a mark, then its content; zero bytes of texts (as many as ``zeros`` says) count twice, their end two."""
    x = F.col(column.name)
    if column.type in _FIXED:
        size = F.lit(_FIXED[column.type])
    elif column.type == "numeric":
        digits = F.length(F.regexp_replace(F.regexp_replace(x, r"[-.]", ""), r"^0+|0+$", ""))
        size = F.when(digits == 0, 2).otherwise(7 + digits)
    else:
        raw = x.cast("binary")
        size = 3 + F.octet_length(raw) + (zeros or _zero_bytes)(raw)
    return F.when(x.isNull(), 1).otherwise(size)


def _zero_bytes(raw: Column) -> Column:
    """How many bytes are zero: what a text of one character a byte loses when they are taken out."""
    one_each = F.decode(raw, "ISO-8859-1")
    return F.octet_length(one_each) - F.octet_length(F.replace(one_each, F.lit("\x00"), F.lit("")))


def _over(columns: list[SchemaColumn], limit: int) -> Column:
    """Whether cells take more than ``limit`` bytes together. Texts hold no zero byte at least and nothing else at most: only where
    that leaves it open are they searched."""
    least, most, exact = (reduce(add, [cell_bytes(c, zeros) for c in columns]) for zeros in (lambda _: F.lit(0), F.octet_length, _zero_bytes))
    return F.when(least > limit, True).when(most <= limit, False).otherwise(exact > limit)


def over_limits(schema: Schema) -> Column:
    """Whether a row has a cell over MAX_CELL bytes or a primary key over MAX_KEY."""
    out = F.lit(False)
    for column in schema.columns:
        if column.type not in _FIXED and column.type != "numeric":
            out = out | _over([column], MAX_CELL)
    key = [schema.column(t) for t in schema.primary_key]
    if any(c.type not in _FIXED for c in key):  # type: ignore[union-attr]
        out = out | _over(key, MAX_KEY)  # type: ignore[arg-type]
    return out


def canonical_kv(df: DataFrame) -> DataFrame:
    """Values in their one form: members by (element, tag), fields by name, scores by (score, member, tag) without -0.0."""
    flat = lambda s: F.struct(F.when(s["score"] == 0, F.lit(0.0)).otherwise(s["score"]).alias("score"), s["member"].alias("member"), s["tag"].alias("tag"))
    return df.withColumns({
        "members": F.sort_array("members"), "fields": F.sort_array("fields"), "scores": F.sort_array(F.transform("scores", flat)),
    })


def _varint_bytes(n: Column) -> Column:
    """Bytes of a length in groups of seven bits."""
    return 1 + (n >= 1 << 7).cast("int") + (n >= 1 << 14).cast("int") + (n >= 1 << 21).cast("int")


def _sized(x: Column) -> Column:
    n = F.octet_length(x)
    return n + _varint_bytes(n)


def _twice(items: Column) -> Column:
    """Whether two items are equal: sorted, they stand side by side."""
    ordered = F.sort_array(items)
    places = F.sequence(F.lit(1), F.size(items) - 1)
    return F.when(F.size(items) > 1, F.exists(places, lambda i: F.get(ordered, i).eqNullSafe(F.get(ordered, i - 1)))).otherwise(False)


def _total(items: Column, size) -> Column:
    return F.aggregate(items, F.lit(0).cast("bigint"), lambda sum_, x: sum_ + size(x))


def _wrong_member(member, missing):
    """Of an item: whether it, its name or a part of it is missing, or its name too long."""
    return lambda x: x.isNull() | member(x).isNull() | F.coalesce(F.octet_length(member(x)) > MAX_MEMBER, F.lit(False)) | F.coalesce(missing(x), F.lit(True))


def kv_violations() -> Column:
    """Whether a row of a map is none: its key, its kind, a payload of that kind alone, sizes, repeats, NULLs and NaN within."""
    kind, key = F.col("kind"), F.col("key")
    bad = key.isNull() | ~F.octet_length(key).between(1, MAX_KEY) | kind.isNull() | ~kind.between(BYTES, SEQUENCE)
    for number, name in enumerate(PAYLOADS, 1):
        bad = bad | (F.col(name).isNotNull() != (kind == number))
    inside = {
        "members": (lambda x: x["elem"], lambda x: x["tag"].isNull(), lambda x: 8 + _sized(x["elem"]), lambda x: x),
        "fields": (lambda x: x["name"], lambda x: x["value"].isNull(), lambda x: _sized(x["name"]) + _sized(x["value"]), lambda x: x["name"]),
        "scores": (
            lambda x: x["member"], lambda x: x["tag"].isNull() | x["score"].isNull() | F.isnan(x["score"]), lambda x: 16 + _sized(x["member"]),
            lambda x: F.struct(x["member"].alias("member"), x["tag"].alias("tag")),
        ),
        "seq": (lambda x: x, lambda _: F.lit(False), _sized, None),
    }
    bad = bad | F.coalesce(F.octet_length("bytes") > MAX_VALUE, F.lit(False))
    for name, (member, missing, size, identity) in inside.items():
        items = F.col(name)
        wrong = F.exists(items, _wrong_member(member, missing))
        rule = (F.size(items) > MAX_MEMBERS) | F.coalesce(wrong, F.lit(False)) | (_varint_bytes(F.size(items)) + _total(items, size) > MAX_VALUE)
        if identity is not None:
            rule = rule | _twice(F.transform(items, identity))
        bad = bad | F.coalesce(F.when(items.isNotNull(), rule), F.lit(False))
    return F.coalesce(bad, F.lit(True))
