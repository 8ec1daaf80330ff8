"""Object versions: Parquet in key-hash buckets, change folders on top, and manifests that name both.

A version is a manifest entry: kind, schema, the folder of each bucket, and the list of change folders
since the buckets' base was written. A change folder holds, for each key that a write touched, its row
before and after. Writing few rows adds one such folder; reading puts the pending ones over the buckets;
from time to time they are folded into the buckets they fall into. The list goes on across folds, so two
versions of one base differ by the folders after their common beginning: a diff or merge reads these and
nothing else, and its cost follows the change and not the table.

Row counts and an order-independent digest are kept up to date from what each write observes. Columns of
tables are stored under their tags, so a rename, a new nullable column, a dropped one or a wider type
changes the manifest only.
"""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from branchframe.errors import ExistsError, InvalidError, NotFoundError
from branchframe.operators.lookup import normalised
from branchframe.operators.merge import KV_SCHEMA, _orderable
from branchframe.plans.schema import Schema
from branchframe.sources.files import Files

TABLE, KV, DOCUMENTS, FILE, FOLDER = "table", "kv", "documents", "file", "folder"
DOCUMENT_SCHEMA = "id binary, doc string"
BUCKET = "_bucket"
#: Rows of a bucket beyond twice which buckets are split, and of a file.
BUCKET_ROWS, FILE_ROWS = 2_000_000, 5_000_000
#: Pending change folders, and their share of the rows, from which they are folded in; change folders kept in a list.
PENDING, SHARE, HISTORY = 12, 0.25, 256
#: Must the keys of a write be new, or there?
NEW, THERE = "new", "there"


@dataclass(frozen=True)
class Entry:
    """One object's version. ``deltas``: change folders since ``base``, ``skipped`` older ones left out; the first ``folded`` are in the buckets."""

    kind: str
    schema: dict | None
    n_buckets: int
    buckets: dict[str, str]
    base: str = ""
    rows: int = 0
    digest: tuple[int, int] = (0, 0)
    deltas: tuple[str, ...] = ()
    skipped: int = 0
    folded: int = 0
    pending_rows: int = 0
    retired: tuple[int, ...] = ()

    @property
    def table_schema(self) -> Schema:
        return Schema.from_json(self.schema)  # type: ignore[arg-type]

    @property
    def pending(self) -> tuple[str, ...]:
        return self.deltas[self.folded - self.skipped :]

    @property
    def folders(self) -> set[str]:
        """Names below data/ that hold this version and the history it can be compared by."""
        return {f.split("/")[1] for f in [*self.buckets.values(), *self.deltas]}

    def keys(self) -> list[str]:
        if self.kind == TABLE:
            return self.table_schema.key_names or ["_rowid"]
        return ["key"] if self.kind == KV else ["id"]

    def stored(self) -> dict[str, str]:
        """Logical names of columns by the names that they are stored under."""
        if self.kind != TABLE:
            return {f.name: f.name for f in T.StructType.fromDDL(KV_SCHEMA if self.kind == KV else DOCUMENT_SCHEMA)}
        schema = self.table_schema
        return ({} if schema.primary_key else {"_rowid": "_rowid"}) | {f"c{c.tag}": c.name for c in schema.columns}

    def stored_keys(self) -> list[str]:
        keys = set(self.keys())
        by_name = {v: k for k, v in self.stored().items()}
        return [by_name[k] for k in self.keys() if k in keys]

    def to_json(self) -> dict:
        return asdict(self) | {"digest": [str(x) for x in self.digest]}

    @staticmethod
    def from_json(data: dict) -> Entry:
        tuples = {k: tuple(data[k]) for k in ("deltas", "retired")}
        return Entry(**(data | tuples | {"digest": tuple(int(x) for x in data["digest"])}))


def same_content(a: Entry | None, b: Entry | None) -> bool:
    if a is None or b is None:
        return a is b
    tidy = lambda e: (e.kind, e.schema, e.rows, e.digest)
    return tidy(a) == tidy(b)


def bucket_of(keys: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


def _row_hash(salt: int, names: list[str], prefix: str = "") -> Column:
    """A 64-bit hash of a row as an exact number; NULLs and field borders count."""
    parts = [m for n in sorted(names) for m in (F.col(f"{prefix}{n}").isNull(), F.col(f"{prefix}{n}"))]
    return F.xxhash64(F.lit(salt), *parts).cast("decimal(38,0)")


def _number(rule: Column | str) -> Column:
    return F.count(F.when(F.col(rule) if isinstance(rule, str) else rule, 1))


class Store:
    """Reads and writes object versions below one root."""

    def __init__(self, spark: SparkSession, root: str, n_buckets: int = 16) -> None:
        self.spark, self.files, self.n_buckets = spark, Files(spark, root), n_buckets

    def struct(self, kind: str, schema: Schema | None) -> T.StructType:
        if kind == TABLE:
            hidden = [] if schema.primary_key else [T.StructField("_rowid", T.BinaryType(), False)]  # type: ignore[union-attr]
            return T.StructType([*hidden, *schema.struct().fields])  # type: ignore[union-attr]
        return T.StructType.fromDDL(KV_SCHEMA if kind == KV else DOCUMENT_SCHEMA)

    def empty(self, kind: str, schema: Schema | None = None) -> Entry:
        return Entry(kind, schema.to_json() if schema else None, self.n_buckets, {})

    # Stored form

    def _stored_struct(self, entry: Entry) -> T.StructType:
        logical = self.struct(entry.kind, entry.table_schema if entry.kind == TABLE else None)
        return T.StructType([T.StructField(s, logical[n].dataType) for s, n in entry.stored().items()])

    def _delta_struct(self, entry: Entry) -> T.StructType:
        full, keys = self._stored_struct(entry), entry.stored_keys()
        row = T.StructType([f for f in full if f.name not in keys] + [T.StructField("_present", T.IntegerType())])
        return T.StructType([*[full[k] for k in keys], T.StructField("_old", row), T.StructField("_new", row), T.StructField("_seq", T.LongType())])

    def _values(self, entry: Entry) -> list[str]:
        keys = entry.stored_keys()
        return [s for s in entry.stored() if s not in keys]

    def _row(self, entry: Entry) -> Column:
        return F.struct(*self._values(entry), F.lit(1).alias("_present"))

    def _inward(self, entry: Entry, df: DataFrame, bad: Column | None = None) -> DataFrame:
        """A logical frame under the stored names and types, floats tidied; _bad tells the rows that ``bad`` holds for."""
        kinds = self._stored_struct(entry)
        columns = [F.col(f"`{n}`").cast(kinds[s].dataType).alias(s) for s, n in entry.stored().items()]
        return normalised(df.select(*columns, *([] if bad is None else [F.coalesce(bad, F.lit(False)).alias("_bad")])))

    def _outward(self, entry: Entry, df: DataFrame) -> DataFrame:
        logical = self.struct(entry.kind, entry.table_schema if entry.kind == TABLE else None)
        return df.select(*[F.col(s).alias(n, metadata=logical[n].metadata) for s, n in entry.stored().items()])

    def _base(self, entry: Entry, only: set[str] | None) -> DataFrame:
        want = self._stored_struct(entry)
        folders = [self.files.at(f) for k, f in sorted(entry.buckets.items()) if only is None or k in only]
        return self.spark.read.schema(want).parquet(*folders) if folders else self.spark.createDataFrame([], want)

    def _net(self, entry: Entry, folders: tuple[str, ...]) -> DataFrame:
        """(keys, _old, _new) over some change folders in turn: the first before and the last after of each key."""
        rows = self.spark.read.schema(self._delta_struct(entry)).parquet(*[self.files.at(f) for f in folders])
        if len(folders) == 1:
            return rows.drop("_seq")
        return rows.groupBy(*entry.stored_keys()).agg(F.min_by("_old", "_seq").alias("_old"), F.max_by("_new", "_seq").alias("_new"))

    def _read(self, entry: Entry, only: set[str] | None = None) -> DataFrame:
        base, keys = self._base(entry, only), entry.stored_keys()
        if not entry.pending:
            return base
        net = self._net(entry, entry.pending)
        if only is not None:
            net = net.filter(bucket_of(keys, entry.n_buckets).isin([int(x) for x in only] or [-1]))
        there = net.filter("_new is not null").select(*keys, *[F.col(f"_new.{v}").alias(v) for v in self._values(entry)])
        return base.join(net.select(*keys), keys, "left_anti").unionByName(there.select(*base.columns))

    # Reads

    def read(self, entry: Entry, only: set[str] | None = None) -> DataFrame:
        """The rows of a version, or of some of its buckets."""
        return self._outward(entry, self._read(entry, only))

    def read_key(self, entry: Entry, key: dict) -> DataFrame:
        """Only the bucket that can hold the key is scanned, with the key pushed down."""
        kinds = self._stored_struct(entry)
        by_key = {s: F.lit(key[n]).cast(kinds[s].dataType) for s, n in zip(entry.stored_keys(), entry.keys(), strict=True)}
        where = reduce(lambda a, b: a & b, [F.col(s) == v for s, v in by_key.items()])
        if len(entry.buckets) > 1:
            row = self.spark.range(1).select(*[v.alias(s) for s, v in by_key.items()])
            only = {str(row.select(bucket_of(list(by_key), entry.n_buckets)).first()[0])}
        else:
            only = set(entry.buckets)
        found = self._base(entry, only).filter(where)
        if entry.pending:
            net = self._net(entry, entry.pending).filter(where)
            there = net.filter("_new is not null").select(*by_key, *[F.col(f"_new.{v}").alias(v) for v in self._values(entry)])
            found = found.join(net.select(*by_key), list(by_key), "left_anti").unionByName(there.select(*found.columns))
        return self._outward(entry, found)

    # Writes

    def _folder(self) -> str:
        return f"data/{uuid.uuid4().hex}"

    def _buckets_for(self, rows: int, least: int) -> int:
        n = least
        while rows > 2 * BUCKET_ROWS * n:
            n *= 2
        return n

    def _write_buckets(self, entry: Entry, stored: DataFrame, n: int) -> tuple[dict[str, str], dict]:
        """Write rows under a new folder by bucket; where each bucket is, and what was observed: n, h1, h2, bad."""
        keys, names, folder, seen = entry.stored_keys(), list(entry.stored()), self._folder(), Observation()
        rows = stored.withColumn(BUCKET, bucket_of(keys, n)).repartition(F.col(BUCKET)).sortWithinPartitions(BUCKET, *keys)
        counted = [F.count("*").alias("n"), *[F.sum(_row_hash(salt, names)).alias(f"h{salt}") for salt in (1, 2)]]
        rows = rows.observe(seen, *counted, _number("_bad" if "_bad" in stored.columns else F.lit(False)).alias("bad"))
        rows.select(*names, BUCKET).write.partitionBy(BUCKET).option("maxRecordsPerFile", FILE_ROWS).parquet(self.files.at(folder))
        made = [x for x in self.files.names(folder) if x.startswith(f"{BUCKET}=")]
        found = {x.split("=")[1]: f"{folder}/{x}" for x in made}
        if seen.get["bad"]:
            self.files.delete(folder)
            raise InvalidError("a row breaks a rule of its columns")
        return found, seen.get

    def write(self, entry: Entry, df: DataFrame, bad: Column | None = None) -> Entry:
        """A version that holds ``df`` and nothing else: a new base. ``bad`` says of a logical row that it can't be stored."""
        n = self._buckets_for(entry.rows, entry.n_buckets)
        buckets, seen = self._write_buckets(entry, self._inward(entry, df, bad), n)
        if seen["n"] > 2 * BUCKET_ROWS * n:  # more rows than were expected: once more, into more buckets
            flat = replace(entry, buckets=buckets, deltas=(), skipped=0, folded=0)
            n = self._buckets_for(seen["n"], n)
            buckets, _ = self._write_buckets(entry, self._base(flat, None), n)
        return replace(
            entry, n_buckets=n, buckets=dict(sorted(buckets.items())), base=uuid.uuid4().hex, rows=seen["n"], digest=(int(seen["h1"] or 0), int(seen["h2"] or 0)),
            deltas=(), skipped=0, folded=0, pending_rows=0,
        )

    def change(self, entry: Entry, puts: DataFrame | None, deletes: DataFrame | None, must: str | None = None, bad: Column | None = None, once: bool = False, known: DataFrame | None = None) -> Entry:
        """The version with rows put and keys deleted. The rows are staged first, then written with what they replace.

        ``must``: NEW raises ExistsError if a key is there, THERE NotFoundError if one isn't. ``once``: InvalidError if
        a key is put twice (with NEW that is an ExistsError always). ``bad``: InvalidError for a logical row it holds for.
        ``known``: the version's rows of all keys that are put or deleted, if they are at hand; else the version is read.
        """
        if puts is not None and deletes is None and not entry.rows and must != THERE:
            made = self.write(entry, puts, bad)
            if (once or must == NEW) and not self._repeats(self._base(made, None), made.stored_keys()).isEmpty():
                self._drop(made.folders)
                raise ExistsError("a key comes twice") if must == NEW else InvalidError("a key comes twice")
            return made
        keys, row, folder, seen = entry.stored_keys(), self._row(entry), self._folder(), Observation()
        parts = []
        if puts is not None:
            parts.append(self._inward(entry, puts, bad).select(*keys, row.alias("_new"), *(["_bad"] if bad is not None else [])))
        if deletes is not None:
            kinds = self._stored_struct(entry)
            gone = deletes.select(*[F.col(f"`{n}`").cast(kinds[s].dataType).alias(s) for s, n in zip(keys, entry.keys(), strict=True)])
            gone = gone.distinct().withColumn("_new", F.lit(None).cast(self._delta_struct(entry)["_new"].dataType))
            parts.append(gone.withColumn("_bad", F.lit(False)) if bad is not None and puts is not None else gone)
        staged = reduce(DataFrame.unionByName, parts)
        staged_at = f"{folder}/staged"
        if "_bad" in staged.columns:
            staged.observe(seen, _number("_bad").alias("bad")).drop("_bad").write.parquet(self.files.at(staged_at))
            if seen.get["bad"]:
                self.files.delete(folder)
                raise InvalidError("a row breaks a rule of its columns")
        else:
            staged.write.parquet(self.files.at(staged_at))
        delta = self._delta_struct(entry)
        staged = self.spark.read.schema(T.StructType([*[delta[k] for k in keys], delta["_new"]])).parquet(self.files.at(staged_at))
        if (once or must == NEW) and not self._repeats(staged, keys).isEmpty():
            self.files.delete(folder)
            raise ExistsError("a key comes twice") if must == NEW else InvalidError("a key comes twice")
        return self._add(entry, staged, folder, must, known)

    @staticmethod
    def _repeats(df: DataFrame, keys: list[str]) -> DataFrame:
        return df.groupBy(*keys).count().filter("count > 1").limit(1)

    def _drop(self, folders: set[str]) -> None:
        for f in folders:
            self.files.delete(f"data/{f}")

    def _add(self, entry: Entry, staged: DataFrame, folder: str, must: str | None, known: DataFrame | None = None) -> Entry:
        """Write (keys, _new) with the rows that they replace as the next change folder."""
        keys, names, seen = entry.stored_keys(), list(entry.stored()), Observation()
        now = (self._read(entry) if known is None else self._inward(entry, known)).join(staged.select(*keys), keys, "left_semi").select(*keys, self._row(entry).alias("_old"))
        seq = entry.skipped + len(entry.deltas)
        both = staged.join(now, keys, "left").select(*keys, "_old", "_new").withColumn("_seq", F.lit(seq).cast("bigint"))
        old, new = F.col("_old"), F.col("_new")
        differs = ~old.eqNullSafe(new)
        inside = lambda side: F.struct(*keys, *[F.col(f"{side}.{v}").alias(v) for v in self._values(entry)])
        hashed = lambda salt, side: F.when(F.col(side).isNotNull(), _row_hash(salt, names, f"_{side}_row."))
        watched = both.withColumns({"__old_row": inside("_old"), "__new_row": inside("_new")})
        sums = [F.sum(F.coalesce(hashed(salt, "_new"), F.lit(0)) - F.coalesce(hashed(salt, "_old"), F.lit(0))).alias(f"h{salt}") for salt in (1, 2)]
        watched = watched.observe(
            seen, _number(differs).alias("n"), _number(old.isNull()).alias("missing"), _number(old.isNotNull()).alias("found"),
            _number(new.isNotNull()).alias("puts"), *sums,
        )
        path = f"{folder}/changes"
        watched.filter(differs).select(*keys, "_old", "_new", "_seq").write.parquet(self.files.at(path))
        got = seen.get
        self.files.delete(f"{folder}/staged")
        if (must == NEW and got["found"]) or (must == THERE and got["missing"]):
            self.files.delete(folder)
            raise ExistsError("a key is taken") if must == NEW else NotFoundError("no such row")
        if not got["n"]:
            self.files.delete(folder)
            return entry
        skipped = max(0, seq + 1 - HISTORY)
        deltas = (*entry.deltas, path)[-HISTORY:]
        out = replace(
            entry, deltas=deltas, skipped=skipped, rows=entry.rows + got["puts"] - got["found"], pending_rows=entry.pending_rows + got["n"],
            digest=(entry.digest[0] + int(got["h1"] or 0), entry.digest[1] + int(got["h2"] or 0)), base=entry.base or uuid.uuid4().hex,
        )
        return self.fold(out) if len(out.pending) >= PENDING or out.pending_rows > max(1000, SHARE * out.rows) else out

    def fold(self, entry: Entry) -> Entry:
        """The same version with all changes in the buckets: those they fall into are written anew, or all if they get too large."""
        if not entry.pending:
            return entry
        n = self._buckets_for(entry.rows, entry.n_buckets)
        only = None
        if n == entry.n_buckets:
            touched = self._net(entry, entry.pending).select(bucket_of(entry.stored_keys(), n).alias("b")).distinct()
            only = {str(r[0]) for r in touched.collect()}
        made, _ = self._write_buckets(entry, self._read(entry, only), n)
        kept = {} if only is None else {k: f for k, f in entry.buckets.items() if k not in only}
        return replace(entry, n_buckets=n, buckets=dict(sorted((kept | made).items())), folded=entry.skipped + len(entry.deltas), pending_rows=0)

    # Versions of one base

    @staticmethod
    def fork(*entries: Entry | None) -> int | None:
        """How many change folders versions have in common from their base on; None if they can't be compared by these."""
        first = entries[0]
        if first is None or any(e is None or (e.base, e.kind, e.schema) != (first.base, first.kind, first.schema) for e in entries) or not first.base:
            return None
        low = max(e.skipped for e in entries)  # type: ignore[union-attr]
        high = min(e.skipped + len(e.deltas) for e in entries)  # type: ignore[union-attr]
        at = low
        while at < high and len({e.deltas[at - e.skipped] for e in entries}) == 1:  # type: ignore[union-attr]
            at += 1
        return at if low == 0 or at > low else None

    def changed(self, fork: int, *entries: Entry, hold: str | None = None) -> list[DataFrame]:
        """Each version's rows of the keys that any of them has changed since the fork. ``hold`` is a folder to put them in first."""
        first = entries[0]
        keys, values = first.stored_keys(), self._values(first)
        parts = [self._net(e, e.deltas[fork - e.skipped :]).withColumn("_side", F.lit(i)) for i, e in enumerate(entries) if len(e.deltas) > fork - e.skipped]
        if not parts:
            return [self.read(replace(e, buckets={}, deltas=(), skipped=0, folded=0)) for e in entries]
        union = reduce(DataFrame.unionByName, parts)
        pick = F.max if _orderable(union.schema["_old"].dataType) else (lambda c: F.any_value(c, F.lit(True)))
        there = [F.max(F.col("_side") == i).alias(f"_there{i}") for i in range(len(entries))]
        news = [pick(F.when(F.col("_side") == i, F.col("_new"))).alias(f"_new{i}") for i in range(len(entries))]
        each = union.groupBy(*keys).agg(pick("_old").alias("_fork"), *there, *news)
        if hold is not None:
            each.write.parquet(self.files.at(hold))
            each = self.spark.read.schema(each.schema).parquet(self.files.at(hold))
        out = []
        for i, entry in enumerate(entries):
            own = each.select(*keys, F.when(F.col(f"_there{i}"), F.col(f"_new{i}")).otherwise(F.col("_fork")).alias("_row")).filter("_row is not null")
            out.append(self._outward(entry, own.select(*keys, *[F.col(f"_row.{v}").alias(v) for v in values])))
        return out

    @staticmethod
    def differing(*entries: Entry | None) -> set[str] | None:
        """Buckets whose folders aren't the same in all versions; None (all) where changes are pending or bucket counts differ."""
        there = [e for e in entries if e is not None]
        if any(e.pending for e in there) or len({e.n_buckets for e in there}) > 1:
            return None
        every = {k for e in there for k in e.buckets}
        return {k for k in every if len({e.buckets.get(k) if e is not None else None for e in entries}) > 1}

    def renamed(self, entry: Entry, schema: Schema) -> Entry:
        """The version under another schema, rows untouched: pending changes are folded, and the history of changes begins anew."""
        flat = self.fold(entry)
        dropped = {c.tag for c in entry.table_schema.columns} - {c.tag for c in schema.columns}
        return replace(flat, schema=schema.to_json(), base=uuid.uuid4().hex, deltas=(), skipped=0, folded=0, retired=tuple(sorted({*entry.retired, *dropped})))

