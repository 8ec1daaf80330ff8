"""Table schemas: columns known by tag for life, validation, evolution, three-way merge."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import types as T

from branchframe.errors import InvalidError

#: Fixed values of the data model.
MAX_COLUMNS, MAX_NAME_BYTES, MAX_INDEXES, MAX_VARCHAR = 1024, 128, 64, 1_048_576

#: The fifteen column types and what carries them in Spark.
TYPES: dict[str, T.DataType] = {
    "bool": T.BooleanType(), "int2": T.ShortType(), "int4": T.IntegerType(), "int8": T.LongType(),
    "float4": T.FloatType(), "float8": T.DoubleType(), "numeric": T.StringType(), "text": T.StringType(),
    "varchar": T.StringType(), "bytea": T.BinaryType(), "date": T.DateType(), "timestamp": T.TimestampNTZType(),
    "timestamptz": T.TimestampType(), "uuid": T.BinaryType(), "jsonb": T.StringType(),
}

_WIDER = {("int2", "int4"), ("int2", "int8"), ("int4", "int8"), ("float4", "float8"), ("varchar", "text")}


@dataclass(frozen=True)
class Column:
    tag: int
    name: str
    type: str
    nullable: bool = False
    max_len: int = 0


@dataclass(frozen=True)
class Index:
    tag: int
    columns: tuple[int, ...]


@dataclass(frozen=True)
class SchemaConflict:
    """Where two schemas disagree: ``schema``, ``schema/<tag>`` or ``schema/index/<tag>``."""

    location: str
    reason: str


@dataclass(frozen=True)
class Schema:
    columns: tuple[Column, ...]
    primary_key: tuple[int, ...] = ()
    indexes: tuple[Index, ...] = field(default=())

    def column(self, tag: int) -> Column | None:
        return next((c for c in self.columns if c.tag == tag), None)

    def index(self, tag: int) -> Index | None:
        return next((x for x in self.indexes if x.tag == tag), None)

    @property
    def key_names(self) -> list[str]:
        return [self.column(t).name for t in self.primary_key]  # type: ignore[union-attr]

    @property
    def value_columns(self) -> list[Column]:
        return [c for c in self.columns if c.tag not in self.primary_key]

    def validate(self) -> None:
        """Raise InvalidError unless these columns, key and indexes can be a table's."""
        tags, names = [c.tag for c in self.columns], [c.name for c in self.columns]
        rules = [
            (0 < len(tags) <= MAX_COLUMNS, "a table has 1 to 1024 columns"),
            (all(t > 0 for t in tags) and len(set(tags)) == len(tags), "column tags are positive and unique"),
            (all(0 < len(n.encode()) <= MAX_NAME_BYTES for n in names) and len(set(names)) == len(names), "column names have 1 to 128 bytes and are unique"),
            (all(c.type in TYPES for c in self.columns), "a column has an unknown type"),
            (all((1 <= c.max_len <= MAX_VARCHAR) if c.type == "varchar" else c.max_len == 0 for c in self.columns), "varchar has a length, and only varchar"),
            (len(set(self.primary_key)) == len(self.primary_key), "key columns are distinct"),
            (all((c := self.column(t)) is not None and not c.nullable for t in self.primary_key), "key columns exist and aren't nullable"),
            (len(self.indexes) <= MAX_INDEXES and len({x.tag for x in self.indexes}) == len(self.indexes) and all(x.tag > 0 for x in self.indexes), "index tags are positive, unique and at most 64"),
            (all(x.columns and len(set(x.columns)) == len(x.columns) and all(self.column(t) for t in x.columns) for x in self.indexes), "index columns exist and are distinct"),
        ]
        for good, what in rules:
            if not good:
                raise InvalidError(what)

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, TYPES[c.type], c.nullable, {"tag": c.tag}) for c in self.columns])

    def to_json(self) -> dict:
        return asdict(self)

    @staticmethod
    def from_json(data: dict) -> Schema:
        return Schema(tuple(Column(**c) for c in data["columns"]), tuple(data["primary_key"]), tuple(Index(x["tag"], tuple(x["columns"])) for x in data["indexes"]))


def convertible(old: Column, new: Column) -> bool:
    """Whether every value of a column can become the new type's (lengths and NULLs are checked on the rows)."""
    return old.type == new.type or (old.type, new.type) in _WIDER


def check_alterable(old: Schema, new: Schema) -> None:
    """Raise InvalidError unless rows of ``old`` can be kept under ``new``."""
    new.validate()
    if new.primary_key != old.primary_key:
        raise InvalidError("the primary key can't change")
    for column in new.columns:
        before = old.column(column.tag)
        if before is None:
            if not column.nullable:
                raise InvalidError("an added column must be nullable")
        elif column.tag in old.primary_key and (before.type, before.max_len) != (column.type, column.max_len):
            raise InvalidError("a key column's type can't change")
        elif not convertible(before, column):
            raise InvalidError("a column's type can only widen")


def three_way(base, ours, theirs):
    """(value, clean): the side that changed wins; two different changes keep the base and aren't clean."""
    if ours == theirs or theirs == base:
        return ours, True
    if ours == base:
        return theirs, True
    return base, False


def merge_schemas(base: Schema, ours: Schema, theirs: Schema) -> tuple[Schema | None, list[SchemaConflict]]:
    """One schema from two, by tag; or None and every conflict."""
    if not base.primary_key == ours.primary_key == theirs.primary_key:
        return None, [SchemaConflict("schema", "versions with unlike primary keys have no rows in common")]
    whole, clean = three_way(base, ours, theirs)
    if clean:
        return _fitting(whole, ours, theirs)
    found: list[SchemaConflict] = []

    def members(kind: str, of, merge_one) -> list:
        """Base members in their order, merged, then additions by tag."""
        out = []
        sides = [{m.tag: m for m in of(s)} for s in (base, ours, theirs)]
        for tag, b in sides[0].items():
            o, t = sides[1].get(tag), sides[2].get(tag)
            if o is None or t is None:
                left = o or t
                if left is not None and left != b:
                    found.append(SchemaConflict(f"{kind}{tag}", "one side removed the definition, the other edited it"))
                continue
            merged, reason = merge_one(b, o, t)
            if reason:
                found.append(SchemaConflict(f"{kind}{tag}", reason))
            else:
                out.append(merged)
        for tag in sorted((sides[1].keys() | sides[2].keys()) - sides[0].keys()):
            o, t = sides[1].get(tag), sides[2].get(tag)
            if o is not None and t is not None and o != t:
                found.append(SchemaConflict(f"{kind}{tag}", "two unlike definitions under one new tag"))
            else:
                out.append(o or t)
        return out

    def one_column(b: Column, o: Column, t: Column) -> tuple[Column, str]:
        merged = b
        for attribute, word in (("name", "name"), ("type", "type"), ("nullable", "nullability"), ("max_len", "length")):
            value, good = three_way(*(getattr(c, attribute) for c in (b, o, t)))
            if not good:
                return b, f"two unlike edits of the {word}"
            merged = replace(merged, **{attribute: value})
        return merged, ""

    def one_index(b: Index, o: Index, t: Index) -> tuple[Index, str]:
        value, good = three_way(b, o, t)
        return value, "" if good else "two unlike edits of the index"

    columns = members("schema/", lambda s: s.columns, one_column)
    present = {c.tag for c in columns}
    indexes = [x for x in members("schema/index/", lambda s: s.indexes, one_index) if present.issuperset(x.columns)]
    if found:
        return None, found
    return _fitting(Schema(tuple(columns), base.primary_key, tuple(indexes)), ours, theirs)


def _fitting(merged: Schema, *sides: Schema) -> tuple[Schema | None, list[SchemaConflict]]:
    """A merged schema that both sides' rows can be kept under, or a conflict."""
    try:
        for side in sides:
            check_alterable(side, merged)
    except InvalidError as error:
        return None, [SchemaConflict("schema", f"no row of both sides could be kept: {error}")]
    return merged, []


def dropped_tags(base: Schema, side: Schema) -> list[int]:
    return [c.tag for c in base.columns if side.column(c.tag) is None]
