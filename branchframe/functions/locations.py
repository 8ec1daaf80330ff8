"""Locations: one text for each place that a change or a conflict can be at, and back."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from branchframe.errors import InvalidError


@dataclass(frozen=True)
class Location:
    """A row or cell of a table, a key or a part of a map's value, a record or a path in it, or a place in a schema.

    ``key`` holds the key's values (bytes as hex, marked); ``below`` is the column tag, the field or
    member, or the path within a record; ``schema`` is "schema", "schema/<tag>" or "schema/index/<tag>".
    """

    key: tuple = ()
    below: int | str | tuple[str, ...] | None = None
    schema: str | None = None


_SCHEMA = re.compile(r"schema(/(index/)?[1-9][0-9]*)?\Z")


def _plain(value):
    if isinstance(value, (bytes, bytearray)):
        return {"hex": bytes(value).hex()}
    if value is None or isinstance(value, (bool, int, str)):
        return value
    raise InvalidError("not a key")


def encode_location(location: Location) -> str:
    """The one spelling of a place."""
    if location.schema is not None:
        if location.key or location.below is not None or not _SCHEMA.match(location.schema):
            raise InvalidError("not a place in a schema")
        return location.schema
    if not location.key:
        raise InvalidError("a place has a key")
    below = list(location.below) if isinstance(location.below, tuple) else location.below
    parts = [[_plain(v) for v in location.key]] + ([below] if below is not None else [])
    return json.dumps(parts, separators=(",", ":"), ensure_ascii=False, sort_keys=True)


def _json(x: Column, kind: T.DataType) -> Column:
    """A value as it stands in a location's text."""
    if isinstance(kind, T.BinaryType):
        text = F.concat(F.lit('{"hex":"'), F.lower(F.hex(x)), F.lit('"}'))
    elif isinstance(kind, (T.StringType, T.ArrayType)):
        whole = F.to_json(F.array(x))
        text = F.substr(whole, F.lit(2), F.length(whole) - 2)
    else:
        text = x.cast("string")
    return F.coalesce(text, F.lit("null"))


def located(df: DataFrame, keys: list[str], below: Column | None = None, name: str = "location") -> DataFrame:
    """``df`` with the text of each row's place, as encode_location() spells it: its key, and what ``below`` says unless null.

    Keys are binary, text, whole numbers or booleans; ``below`` is a column tag, a field or member, or an array of path steps.
    """
    key = F.concat(F.lit("["), F.concat_ws(",", *[_json(F.col(k), df.schema[k].dataType) for k in keys]), F.lit("]"))
    if below is None:
        return df.withColumn(name, F.concat(F.lit("["), key, F.lit("]")))
    kind = df.select(below.alias("below")).schema["below"].dataType
    part = F.when(below.isNull(), F.lit("")).otherwise(F.concat(F.lit(","), _json(below, kind)))
    return df.withColumn(name, F.concat(F.lit("["), key, part, F.lit("]")))


def parse_location(text: str) -> Location:
    """The place of a text; InvalidError unless encode_location would write exactly this text."""
    try:
        if text.startswith("schema"):
            found = Location(schema=text)
        else:
            key, *rest = json.loads(text)
            below = tuple(rest[0]) if rest and isinstance(rest[0], list) else rest[0] if rest else None
            found = Location(tuple(bytes.fromhex(v["hex"]) if isinstance(v, dict) else v for v in key), below)
        good = encode_location(found) == text
    except (ValueError, TypeError, KeyError, AttributeError) as error:
        raise InvalidError("not a location") from error
    if not good:
        raise InvalidError("not a location")
    return found
