"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations.

Equal vectors of one label collapse to a class first, so copies never meet as pairs. A class is
hashed in TABLES tables: HASHES pseudo-random rotations each (three rounds of random signs and a
fast Walsh-Hadamard transform), each giving the nearest signed axis. Every class stands in its own
bucket of each table and also probes the buckets next to it (second and third nearest axes).

Classes that stand in one bucket of more than HOT are compared there, by matrix products of blocks of
BLOCK at most; a pair with several such buckets in common counts in the least of them. Their number
of links and a spanning forest come out, never their pairs. Of all other pairs that meet, those go on
whose vectors, rotated, differ in few of 64 signs (a pair at the threshold in more than that with a
probability of about 1e-8); they hold ids only, are made distinct, joined with their vectors, and kept
if the cosine in double precision reaches the threshold.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from branchframe.llm.common import discard, materialise, small_batches, tidy_after
from branchframe.llm.components import connected_components
from branchframe.llm.near_copies import forest

TABLES, HASHES, SEED = 7, 2, 20240229
#: For each table the ranks of the axes that a probe takes, one for each hash; the first is the own bucket.
PROBES = ((0, 0), (0, 1), (1, 0), (1, 1), (0, 2), (2, 0))

#: Classes at home in a bucket from which they are compared there, and of a block at most.
HOT, BLOCK = 32, 1024

_KEYED = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("key", pa.binary()), ("vec", pa.binary())])
_BUCKETS = pa.schema([("bucket", pa.int64()), ("cid", pa.int64()), ("own", pa.bool_()), ("signs", pa.int64())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary", pa.bool_(): "boolean", pa.float64(): "double"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _keyed(batches):
    """Rows whose vector can link: (vec_id, label, digest of label and vector, vector as float64 bytes); others get a null key."""
    for batch in batches:
        ids, labels, vectors = batch.column(0), batch.column(1).to_pylist(), batch.column(2)
        keys, packed = [], []
        for label, v in zip(labels, vectors, strict=True):
            key = vec = None
            if label is not None and v.is_valid and len(v.values) and not v.values.null_count:
                x = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64) + 0.0
                if np.isfinite(x).all() and x.any():
                    vec = x.tobytes()
                    key = hashlib.blake2b(f"{label}\x00".encode() + vec, digest_size=16).digest()
            keys.append(key)
            packed.append(vec)
        yield pa.RecordBatch.from_arrays([ids, pa.array(labels, pa.string()), pa.array(keys, pa.binary()), pa.array(packed, pa.binary())], schema=_KEYED)


def _signs(n: int) -> np.ndarray:
    """The Walsh-Hadamard matrix of a power of two."""
    out = np.ones((1, 1))
    while len(out) < n:
        out = np.block([[out, out], [out, -out]])
    return out


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, three binary steps at a time; the width is a power of two."""
    rows, n = x.shape
    done = 1
    while done < n:
        step = min(8, n // done)
        x = (x.reshape(-1, step, done).swapaxes(1, 2).reshape(-1, step) @ _signs(step)).reshape(-1, done, step).swapaxes(1, 2).reshape(rows, n)
        done *= step
    return x


def rotated(x: np.ndarray, table: int, hashed: int) -> np.ndarray:
    """Each row after one random rotation."""
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    rng = np.random.default_rng((SEED, table, hashed, width))
    y = np.zeros((len(x), width))
    y[:, : x.shape[1]] = x
    for _ in range(3):
        y = hadamard(y * rng.choice((-1.0, 1.0), width)) / np.sqrt(width)
    return y


def axis_ranks(y: np.ndarray, ranks: int) -> np.ndarray:
    """The ``ranks`` nearest signed axes of each row, nearest first."""
    size = -np.abs(y)
    top = np.sort(np.argpartition(size, min(ranks, y.shape[1]) - 1, axis=1)[:, :ranks], axis=1)
    top = np.take_along_axis(top, np.argsort(np.take_along_axis(size, top, axis=1), axis=1, kind="stable"), axis=1)
    return top * 2 + (np.take_along_axis(y, top, axis=1) < 0)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bucket_rows(labels: list[str], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids as int64 [rows, tables, probes], probe 0 the row's own bucket; and 64 signs of rotated coordinates as a bigint."""
    unit = x / np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(axis=1, keepdims=True)
    salt = np.array([int.from_bytes(hashlib.blake2b(f"{label}/{x.shape[1]}".encode(), digest_size=8).digest(), "little") for label in labels], np.uint64)
    out = np.empty((len(x), TABLES, len(PROBES)), np.uint64)
    signs: list[np.ndarray] = []
    for t in range(TABLES):
        turned = [rotated(unit, t, h) for h in range(HASHES)]
        signs += [y[:, k] >= 0 for y in turned for k in range(y.shape[1]) if t * HASHES * y.shape[1] < 64][: 64 - len(signs)]
        axes = [axis_ranks(y, 3).astype(np.uint64) for y in turned]
        for p, ranks in enumerate(PROBES):
            code = salt + np.uint64(t + 1)
            for h, r in enumerate(ranks):
                code = _mix(code * np.uint64(0x9E3779B97F4A7C15) + axes[h][:, min(r, axes[h].shape[1] - 1)])
            out[:, t, p] = code
    signs += [np.zeros(len(x), bool)] * (64 - len(signs))
    return out.view(np.int64), np.packbits(np.stack(signs, axis=1), axis=1, bitorder="little").view("<i8").ravel()


def most_signs(threshold: float) -> int:
    """Signs that may differ at a cosine of ``threshold`` or more: the mean and six standard deviations."""
    share = float(np.arccos(min(1.0, threshold)) / np.pi)
    return int(np.ceil(64 * share + 6 * np.sqrt(64 * share * (1 - share))))


def _hashed(batches):
    for batch in batches:
        ids, labels, vectors = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        widths = np.array([len(v) for v in vectors])
        for width in np.unique(widths):
            own = np.flatnonzero(widths == width)
            x = np.frombuffer(b"".join(vectors[i] for i in own), np.float64).reshape(len(own), -1)
            buckets, signs = bucket_rows([labels[i] for i in own], x)
            cid = np.broadcast_to(ids[own][:, None, None], buckets.shape)
            first = np.zeros(buckets.shape, bool)
            first[:, :, 0] = True
            signs = np.broadcast_to(signs[:, None, None], buckets.shape)
            yield pa.RecordBatch.from_arrays([pa.array(buckets.ravel()), pa.array(cid.ravel()), pa.array(first.ravel()), pa.array(signs.ravel())], schema=_BUCKETS)


def cosines(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Cosines of float64 vectors given as bytes; vectors of unequal width get -1."""
    out = np.full(len(a), -1.0)
    widths = np.array([len(v) if len(v) == len(w) else 0 for v, w in zip(a, b, strict=True)])
    for width in np.unique(widths[widths > 0]):
        own = np.flatnonzero(widths == width)
        x, y = (np.frombuffer(b"".join(side[i] for i in own), np.float64).reshape(len(own), -1) for side in (a, b))
        x, y = (m / np.abs(m).max(axis=1, keepdims=True) for m in (x, y))
        out[own] = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
    return out


def _verifier(threshold: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def verify(batches):
        for batch in batches:
            keep = pa.array(cosines(batch.column(2).to_pylist(), batch.column(3).to_pylist()) >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], schema=schema)

    return verify


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("link", pa.bool_())])


def _first_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number that two rows of [n, k] ascending numbers have in common; rows are filled up with numbers of their own."""
    out = np.full(len(a), np.iinfo(np.int64).max)
    for k in range(a.shape[1]):
        column = a[:, k]
        out = np.minimum(out, np.where((b == column[:, None]).any(axis=1), column, np.iinfo(np.int64).max))
    return out


def cell_links(bucket: int, ids: np.ndarray, sizes: np.ndarray, blocks: np.ndarray | None, vectors: np.ndarray, homes: np.ndarray, threshold: float) -> tuple[np.ndarray, list]:
    """Of the members of a cell: linked vectors of each, in pairs that count here, and links that span the components.

    In a cell of two blocks, ``blocks``, members of one are compared with members of the other. ``homes``: each member's hot buckets.
    """
    unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    unit = unit / np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    good = unit @ unit.T >= threshold
    np.fill_diagonal(good, False)
    if blocks is not None:
        good &= blocks[:, None] != blocks[None, :]
    spanning = [(int(ids[i]), int(ids[j])) for i, j in forest(good, good.astype(np.float32), np.arange(len(ids)))]
    others = np.zeros(len(ids), np.int64)
    rows, columns = np.nonzero(np.triu(good, 1))
    for at in range(0, len(rows), 1 << 16):
        i, j = rows[at : at + (1 << 16)], columns[at : at + (1 << 16)]
        here = _first_common(homes[i], homes[j]) == bucket
        np.add.at(others, i[here], sizes[j[here]])
        np.add.at(others, j[here], sizes[i[here]])
    return others, spanning


def _hot_links(cells: DataFrame, threshold: float) -> DataFrame:
    """(a, b, link) of ``cells(cell, bucket, cid, n, block, vec, homes)``: links that span, and rows (cid, linked vectors, false)."""

    def run(batches):
        held: list[tuple] = []
        last = None

        def done():
            bucket = held[0][0] if held else 0
            for width in {len(r[4]) for r in held}:
                own = [r for r in held if len(r[4]) == width]
                if len(own) < 2:
                    continue
                ids, sizes, blocks = (np.array([r[i] for r in own], np.int64) for i in (1, 2, 3))
                fill = np.iinfo(np.int64).min
                homes = np.array([[*r[5], *[fill + i] * (TABLES - len(r[5]))] for i, r in enumerate(own)], np.int64)
                vectors = np.frombuffer(b"".join(r[4] for r in own), np.float64).reshape(len(own), -1)
                first, second = last.split("/")[1:]
                others, spanning = cell_links(bucket, ids, sizes, None if first == second else blocks, vectors, homes, threshold)
                rows = [(a, b, True) for a, b in spanning] + [(int(i), int(x), False) for i, x in zip(ids, others, strict=True) if x]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FOUND, strict=True)], schema=_FOUND)

        for batch in tidy_after(batches):
            for cell, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if cell != last:
                    yield from done()
                    held, last = [], cell
                held.append(tuple(row))
        yield from done()

    rows = cells.select("cell", "bucket", "cid", "n", "block", "vec", "homes").repartition("cell").sortWithinPartitions("cell", "cid")
    return rows.mapInArrow(run, "a bigint, b bigint, link boolean")


def _hot_cells(homes: DataFrame, hot: DataFrame, classes: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """(cid, homes: its hot buckets) and the cells: a bucket's members in blocks, a cell for each pair of blocks."""
    at_home = homes.join(hot, "bucket").select("bucket", "cid", F.ceil(F.col("n") / F.lit(block // 2)).alias("blocks"))
    lists = at_home.groupBy("cid").agg(F.array_sort(F.collect_list("bucket")).alias("homes"))
    blocks = F.when(F.col("blocks") <= 2, 1).otherwise(F.col("blocks"))
    own = at_home.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")))
    pairs = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    cell = F.concat_ws("/", F.col("bucket").cast("string"), F.least("block", "other").cast("string"), F.greatest("block", "other").cast("string"))
    return lists, pairs.select(cell.alias("cell"), "bucket", "cid", "block").join(lists, "cid").join(classes.select("cid", "n", "vec"), "cid")


def near_vectors(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Links join vectors of one label (not null) with cosine of at least ``threshold``. Vectors that
    are null, empty, zero, or hold null or non-finite components link with nothing: they are their
    own component. Repeated rows are vectors of their own that link with each other. Components
    carry the least id; an empty table gives an empty one.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    source = vectors.select(F.col(id_col).cast("bigint"), F.col(label_col).cast("string"), F.col(vec_col).cast("array<double>"))
    rows = materialise(source.mapInArrow(_keyed, _ddl(_KEYED)), "vectors")
    classes = materialise(
        rows.filter("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("vec").alias("vec"))
        .withColumn("cid", F.monotonically_increasing_id()), "vector-classes",
    )
    buckets = materialise(classes.select("cid", "label", "vec").mapInArrow(_hashed, _ddl(_BUCKETS)), "buckets")
    homes = buckets.filter("own").select("bucket", "cid")
    crowded = materialise(homes.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > hot), "crowded")
    lists, cells = _hot_cells(homes, crowded, classes, block)
    inside = materialise(_hot_links(cells, threshold), "inside")
    shared = lambda c: lists.select(F.col("cid").alias(c), F.col("homes").alias(f"{c}_homes"))
    home = buckets.filter("own").select("bucket", F.col("cid").alias("x"), F.col("signs").alias("x_signs")).join(shared("x"), "x", "left")
    away = buckets.join(crowded.select(F.col("bucket").alias("full")), F.col("own") & (F.col("bucket") == F.col("full")), "left_anti")
    probe = away.select("bucket", F.col("cid").alias("y"), F.col("signs").alias("y_signs")).join(shared("y"), "y", "left")
    seen_inside = F.coalesce(F.arrays_overlap("x_homes", "y_homes"), F.lit(False))
    alike = F.bit_count(F.col("x_signs").bitwiseXOR(F.col("y_signs"))) <= most_signs(threshold)
    met = home.join(probe, "bucket").filter((F.col("x") != F.col("y")) & alike & ~seen_inside).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    side = lambda c: classes.select(F.col("cid").alias(c), F.col("vec").alias(f"v{c}"))
    pairs = met.join(side("a"), "a").join(side("b"), "b").select("a", "b", "va", "vb")
    links = materialise(pairs.mapInArrow(_verifier(threshold), "a bigint, b bigint"), "links")
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    size = classes.select(F.col("cid").alias("b"), F.col("n").alias("m"))
    counted = both.join(size, "b").select("a", "m").union(inside.filter("not link").select("a", "b"))
    degree = counted.groupBy("a").agg(F.sum("m").alias("others"))
    edges = links.union(inside.filter("link").select("a", "b"))
    roots = connected_components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    labelled = classes.select("cid", "key", "rep", "n").join(degree, F.col("cid") == F.col("a"), "left").join(roots, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cid"))
    least = labelled.groupBy("root").agg(F.min("rep").alias("component_id"))
    found = materialise(labelled.join(least, "root").select("key", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id"), "found")
    discard(buckets, crowded, inside, links, classes, roots)
    out = rows.select("vec_id", "key").join(found, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
