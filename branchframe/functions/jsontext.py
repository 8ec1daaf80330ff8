"""Canonical JSON text: one spelling of equal values, within bounds."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from branchframe.errors import InvalidError
from branchframe.sources.shipping import ship

#: Fixed values of the data model.
MAX_DOCUMENT, MAX_DEPTH, MAX_NUMBER_DIGITS, MAX_EXPONENT_DIGITS = 1 << 20, 64, 1000, 6

_NUMBER = re.compile(r"(-?)(0|[1-9][0-9]*)(?:\.([0-9]+))?(?:[eE]([+-]?)([0-9]+))?\Z")


class Number(str):
    """A JSON number in its one spelling."""

    __slots__ = ()


def number(text: str) -> Number:
    """Plain decimal: no exponent, no zeros that say nothing."""
    match = _NUMBER.match(text)
    if not match:
        raise InvalidError("not a number")
    sign, whole, part, way, power = match.groups()
    part, power = part or "", (power or "").lstrip("0")
    if len(power) > MAX_EXPONENT_DIGITS:
        raise InvalidError("an exponent past the limit")
    digits = (whole + part).lstrip("0")
    point = len(whole) + int(f"{way or ''}{power or 0}") - (len(whole + part) - len(digits))
    digits = digits.rstrip("0")
    if not digits:
        return Number("0")
    if max(point, len(digits) - point) > MAX_NUMBER_DIGITS:
        raise InvalidError("a number past the digits allowed")
    if point <= 0:
        plain = "0." + "0" * -point + digits
    elif point >= len(digits):
        plain = digits + "0" * (point - len(digits))
    else:
        plain = f"{digits[:point]}.{digits[point:]}"
    return Number(sign + plain)


def _pairs(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise InvalidError("a field twice in one object")
    return out


def _constant(text: str):
    raise InvalidError("not a JSON value")


_DECODER = json.JSONDecoder(object_pairs_hook=_pairs, parse_float=number, parse_int=number, parse_constant=_constant)


def _nesting(value) -> int:
    deepest, todo = 0, [(value, 0)]
    while todo:
        v, d = todo.pop()
        if isinstance(v, (list, dict)):
            deepest = max(deepest, d + 1)
            todo += [(c, d + 1) for c in (v.values() if isinstance(v, dict) else v)]
    return deepest


def parse(text: str | bytes):
    """A value of dicts, lists, strings, Numbers, booleans and None; InvalidError for what is no document."""
    try:
        raw = text if isinstance(text, bytes) else text.encode()
        if len(raw) > MAX_DOCUMENT:
            raise InvalidError("a document past the limit")
        value, end = _DECODER.raw_decode(trimmed := raw.decode().strip(" \t\n\r"))
        if end != len(trimmed):
            raise InvalidError("bytes after the value")
        if _nesting(value) > MAX_DEPTH:
            raise InvalidError("nested too deep")
        if len(encode(value).encode()) > MAX_DOCUMENT:
            raise InvalidError("a document past the limit")
    except (ValueError, RecursionError) as error:  # also bad UTF-8 and lone surrogates
        raise InvalidError("not a JSON document") from error
    return value


_ESCAPES = {**{chr(i): f"\\u{i:04x}" for i in range(32)}, '"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
_SPECIAL = re.compile(r'["\\\x00-\x1f]')


def _string(text: str) -> str:
    return '"' + _SPECIAL.sub(lambda m: _ESCAPES[m[0]], text) + '"'


def encode(value) -> str:
    """The canonical text: fields in the byte order of their names, no white space, the least escapes."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, Number):
        return str(value)
    if isinstance(value, str):
        return _string(value)
    if isinstance(value, list):
        return "[" + ",".join(map(encode, value)) + "]"
    return "{" + ",".join(f"{_string(k)}:{encode(value[k])}" for k in sorted(value, key=str.encode)) + "}"


def canonical_or_none(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        return encode(parse(text))
    except InvalidError:
        return None


def canonical_json(text: Column) -> Column:
    """The canonical text of a JSON column; null where it is no document."""
    ship()

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(canonical_or_none)

    return run(text)
