"""Diffs of two versions as DataFrames: one keyed full outer join, no driver work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from branchframe.errors import InvalidError
from branchframe.plans.schema import Schema

ADDED, REMOVED, MODIFIED = "added", "removed", "modified"


def _sides(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys, f and t (structs of the values, null where the row is absent)."""
    pack = lambda df, name: df.select(*keys, F.struct(*([F.col(v) for v in values] or [F.lit(1).alias("_present")])).alias(name))
    return pack(old, "f").join(pack(new, "t"), keys, "full_outer")


def _kind() -> Column:
    return F.when(F.col("f").isNull(), ADDED).when(F.col("t").isNull(), REMOVED).otherwise(MODIFIED)


def diff_cells(old: DataFrame, new: DataFrame, keys: list[str], values: dict[str, int]) -> DataFrame:
    """(kind, keys, column): a row added or removed is one change with a null column; a row that stays has
    one change for each cell that differs, named by its tag. NULL and NaN equal themselves."""
    both = _sides(old, new, keys, list(values))
    cells = [F.when(~F.col(f"f.{name}").eqNullSafe(F.col(f"t.{name}")), F.lit(tag)) for name, tag in values.items()]
    changed = F.filter(F.array(*cells) if cells else F.array().cast("array<int>"), lambda x: x.isNotNull())
    whole = F.col("f").isNull() | F.col("t").isNull()
    places = F.when(whole, F.array(F.lit(None).cast("int"))).otherwise(changed)
    return both.select(_kind().alias("kind"), *keys, F.explode(places).alias("column"))


def diff_rows(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(kind, keys): one change for each key whose row differs."""
    both = _sides(old, new, keys, values)
    return both.filter(~F.col("f").eqNullSafe(F.col("t"))).select(_kind().alias("kind"), *keys)


def diff_tables(old: DataFrame, new: DataFrame, old_schema: Schema, new_schema: Schema) -> DataFrame:
    """diff_cells of two versions under one schema; InvalidError where the schemas differ."""
    if old_schema != new_schema:
        raise InvalidError("the schema changed between the versions")
    keys = old_schema.key_names or ["_rowid"]
    return diff_cells(old, new, keys, {c.name: c.tag for c in old_schema.value_columns})


def diff_summary(changes: DataFrame) -> DataFrame:
    """(kind, n): how many changes of each kind."""
    return changes.groupBy("kind").agg(F.count("*").alias("n"))
