"""Shared plumbing of the training-data operators: tables, shared storage, Arrow text access."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from branchframe.sources.shipping import ship

#: Rows and bytes of an Arrow batch at most (a longer row is a batch of its own).
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark (any file system it knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a temporary one where that is unset and Spark is local (tests)."""
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("branchframe.shared.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = tempfile.mkdtemp(prefix="branchframe-shared-")
        spark.conf.set("branchframe.shared.dir", known)
    return known.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/branchframe/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as a Parquet table in the shared folder and read it back.

    The table outlives any executor; its path is in the attribute ``shared_path`` of the result.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.shared_path = path
    return back


def discard(*frames: DataFrame) -> None:
    """Delete tables of materialise() that nothing will read again: the frames' own, and those in their attribute ``reads``."""
    for df in frames:
        path = getattr(df, "shared_path", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
        discard(*getattr(df, "reads", ()))


def id_crc(id_col: str) -> Column:
    """crc32 of the id as text: the fold of a row. Null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


def hash_sample(rows: DataFrame, group_col: str, id_col: str, most: int, groups: int) -> DataFrame:
    """(id, group, rank): of each of the ``groups`` largest groups the ``most`` rows that come first by a hash of the id.

    Groups are counted first (partial sums), and a row is looked at only if its hash is in the share
    that holds about four times ``most`` rows; so however large a group is, few rows are ranked.
    """
    counts = rows.groupBy(F.col(group_col).alias("group")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "group").limit(groups)
    place = F.shiftrightunsigned(F.xxhash64(id_col), 11) / F.lit(float(1 << 53))
    some = rows.select(F.col(id_col).alias("id"), F.col(group_col).alias("group"), place.alias("place")).join(F.broadcast(counts), "group").filter(F.col("place") * F.col("n") < 4.0 * most)
    order = Window.partitionBy("group").orderBy("place", "id")
    return some.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("id", "group", "rank")


def hash_top(rows: DataFrame, id_col: str, most: int) -> DataFrame:
    """(id, place): the ``most`` rows that come first by a hash of the id; each task keeps its own first ones, the driver merges them."""
    place = F.shiftrightunsigned(F.xxhash64(id_col), 11) / F.lit(float(1 << 53))
    return rows.select(F.col(id_col).alias("id"), place.alias("place")).filter("id is not null").orderBy("place", "id").limit(most)


def bounded_rows(rows: DataFrame, order: list[str], most_bytes: int) -> list:
    """Collected rows with a binary column ``text``, first ones in order first, of ``most_bytes`` together at most.

    Sizes come to the driver first; texts only of the rows that fit. ``rows`` hold a bounded sample of ids, and of rows
    that repeat one only the least text counts.
    """
    rows = rows.groupBy(*order).agg(F.min("text").alias("text"))
    sizes = sorted(tuple(r) for r in rows.select(*order, F.octet_length("text")).collect())
    upto = int(np.searchsorted(np.cumsum([x[-1] for x in sizes]), most_bytes, "right"))
    if upto < len(sizes):
        if not upto:
            return []
        rows = rows.filter(F.struct(*order) <= F.struct(*[F.lit(x).cast(rows.schema[c].dataType).alias(c) for c, x in zip(order, sizes[upto - 1], strict=False)]))
    return sorted(rows.collect(), key=lambda r: tuple(r[c] for c in order))


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers see by rows and, where Spark can, by bytes; ship the package.

    All operators use the same bounds: plans are lazy, so the last setting would hold for all of them.
    """
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    try:
        spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    except Exception:  # noqa: BLE001  a Spark without this setting
        return
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def tidy_after(batches: Iterator) -> Iterator:
    """The same batches; when a task has had the last one, freed memory goes back to the system.

    Python workers are used again by later stages, beside other workers and a growing JVM.
    """
    try:
        yield from batches
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def utf8_parts(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string array and the n + 1 offsets of its rows, without copies; nulls are empty."""
    if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type):
        kind = np.int64
    elif pa.types.is_string(array.type) or pa.types.is_binary(array.type):
        kind = np.int32
    else:
        return utf8_parts(array.cast(pa.large_string()))
    if array.null_count:
        array = array.fill_null("" if "string" in str(array.type) else b"")
    n, (_, offsets, data) = len(array), array.buffers()
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind, count=n + 1, offset=array.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int):
    """Runs [i, j) of rows of at most ``most`` bytes together, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i+1]] for each i; empty runs give 0."""
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def keep_rows(docs: DataFrame, decisions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stay by ``decisions(doc_id, kept, text_sha256)``: one row for each kept (id, text).

    Decisions come one a row or one a distinct (id, text), then with its number of rows as ``n``. Ids whose rows
    all stay aren't touched. Ids that lose rows leave by an anti-join (Spark broadcasts them only if they are
    few); of these the kept texts come back, each once. Null ids are one id, null texts are empty; helper
    columns take names that ``docs`` doesn't have.
    """
    rows = F.col("n") if "n" in decisions.columns else F.lit(1)
    per_id = decisions.groupBy("doc_id").agg(F.sum(rows).alias("n"), F.count(F.when(F.col("kept"), 1)).alias("k")).filter("k < n")
    per_id = materialise(per_id, "leaving")
    gone, sure, code, text = unused(docs, "gone", "sure", "code", "sure_text")
    stay = docs.join(per_id.select(F.col("doc_id").alias(gone)), F.col(id_col).eqNullSafe(F.col(gone)), "left_anti")
    part = per_id.filter("k > 0").select(F.col("doc_id").alias("part_id"))
    if part.isEmpty():
        stay.reads = [per_id, decisions]
        return stay
    back = decisions.filter("kept").join(part, F.col("doc_id").eqNullSafe(F.col("part_id")), "left_semi").select(F.col("doc_id").alias(sure), F.col("text_sha256").alias(text)).distinct()
    coded = docs.withColumn(code, F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    some = coded.join(back, F.col(id_col).eqNullSafe(F.col(sure)) & (F.col(code) == F.col(text)), "left_semi")
    out = stay.unionByName(some.dropDuplicates([id_col, code]).drop(code))
    out.reads = [per_id, decisions]
    return out
