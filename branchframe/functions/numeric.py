"""Exact decimal text of any size, in SQL functions: canonical form and order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the data model: bytes of the text as written, significant digits, the written exponent.
MAX_TEXT, MAX_DIGITS, MAX_EXPONENT = 1000, 1000, 999_999
_PATTERN = r"^(-?)([0-9]*)(?:\.([0-9]*))?(?:[eE](-?[0-9]{1,9}))?$"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it stands there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _parts(text: Column, body) -> Column:
    """``body`` of a struct: negative, significant digits, where the point falls among them, whether the text is a number."""
    take = lambda i: F.regexp_extract(text, _PATTERN, i)

    def measured(x: Column) -> Column:
        written = F.concat(x["whole"], x["part"])
        lead = F.length(written) - F.length(F.regexp_replace(written, "^0+", ""))
        power = F.coalesce(F.try_to_number(F.regexp_replace(x["power"], "^-", ""), F.lit("999999999")).cast("int"), F.lit(0))
        power = F.when(x["power"].startswith("-"), -power).otherwise(power)
        good = text.rlike(_PATTERN) & (F.length(written) > 0) & (F.octet_length(text) <= MAX_TEXT) & (F.abs(power) <= MAX_EXPONENT)
        return F.struct((x["sign"] == "-").alias("negative"), F.regexp_replace(written, "^0+|0+$", "").alias("digits"), (F.length(x["whole"]) + power - lead).alias("point"), good.alias("good"))

    return _let(_let(F.struct(take(1).alias("sign"), take(2).alias("whole"), take(3).alias("part"), take(4).alias("power")), measured), body)


def canonical_numeric(text: Column) -> Column:
    """The one spelling of a decimal: no exponent, no zeros that say nothing, ``-0`` is ``0``. Null if it is none or too long."""

    def spell(x: Column) -> Column:
        digits, point, size = x["digits"], x["point"], F.length(x["digits"])
        span = F.greatest(size, point) - F.least(point, F.lit(0))
        plain = (
            F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
            .when(point >= size, F.concat(digits, F.repeat(F.lit("0"), point - size)))
            .otherwise(F.concat(F.substr(digits, F.lit(1), point), F.lit("."), F.substr(digits, point + 1)))
        )
        return F.when(x["good"] & (size == 0), "0").when(x["good"] & (span <= MAX_DIGITS), F.concat(F.when(x["negative"], "-").otherwise(""), plain))

    return _parts(text, spell)


def numeric_sort_key(text: Column) -> Column:
    """A struct that orders canonical decimals by value: (sign, signed point, digits, complemented when negative)."""

    def key(x: Column) -> Column:
        zero = F.length(x["digits"]) == 0
        other_way = F.concat(F.translate(x["digits"], "0123456789", "9876543210"), F.lit("~"))
        return F.when(x["good"], F.struct(
            F.when(zero, 0).when(x["negative"], -1).otherwise(1).alias("sign"),
            F.when(zero, 0).when(x["negative"], -x["point"]).otherwise(x["point"]).alias("point"),
            F.when(zero, "").when(x["negative"], other_way).otherwise(x["digits"]).alias("digits"),
        ))

    return _parts(text, key)
