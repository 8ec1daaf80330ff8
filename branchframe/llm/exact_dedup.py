"""Exact deduplication against a history: minimal perfect hashes over its distinct digests.

1. Every row gives a SHA-256 digest of its text; texts never leave the scan.
2. The history's distinct digests, each with its winner (largest id) and count, are dealt into
   buckets of about BUCKET digests. Each bucket gets a minimal perfect hash (hash and displace):
   slot i of n holds one full digest, the winner's locator and the count.
3. The incoming rows are first summed to distinct digests (a partial aggregate, so a text that a
   third of all rows share is one row by then), then looked up in their bucket's hash. The slot's
   full digest is compared byte by byte: equal ones are repeats of the history, the others form
   groups of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from branchframe.llm.common import discard, materialise, small_batches

#: Digests in a bucket on average: what one task holds at a time, whatever the input's size.
BUCKET = 1024

_WINNER = "struct<id:bigint,row:bigint>"
_INDEX = "bucket bigint, displacement binary, digests binary, win_id array<bigint>, win_row array<bigint>, n array<bigint>"
_GROUPS = "digest binary, keep_id bigint, keep_row bigint, n bigint"
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, digest): a row number makes repeated ids distinct; null text counts as empty."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)).alias("digest"),
    )


def distinct_digests(rows: DataFrame) -> DataFrame:
    """(digest, win, n): the winner is the largest (id, row)."""
    return rows.groupBy("digest").agg(F.max(F.struct(F.col("doc_id").alias("id"), "row")).cast(_WINNER).alias("win"), F.count("*").alias("n"))


def _words(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w = digests.view("<u8").reshape(-1, 4)
    return w[:, 1], w[:, 2], w[:, 3] | np.uint64(1)


def _slot(a: np.ndarray, b: np.ndarray, seed: np.ndarray | int, n: int) -> np.ndarray:
    x = a + np.asarray(seed, np.uint64) * b
    x = (x ^ (x >> np.uint64(31))) * _M1
    return ((x ^ (x >> np.uint64(29))) % np.uint64(n)).astype(np.int64)


def build_perfect_hash(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Displacements by group, and the slot of each of the n distinct 32-byte digests (a permutation).

    A group of one digest is displaced straight to a free slot, stored as -slot - 1; others take
    the first seed that puts all their digests into free slots.
    """
    n = len(digests)
    g, a, b = _words(digests)
    groups = max(1, (n + 3) // 4)
    group = (g % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    starts = np.searchsorted(group[order], np.arange(groups + 1))
    sizes = np.diff(starts)
    displacement, slots, taken = np.zeros(groups, np.int64), np.full(n, -1, np.int64), np.zeros(n, bool)
    by_size = np.argsort(-sizes, kind="stable")
    for k in by_size[sizes[by_size] > 1]:
        own, seed = order[starts[k] : starts[k + 1]], 1
        while True:
            at = _slot(a[own][None, :], b[own][None, :], np.arange(seed, seed + 64, dtype=np.uint64)[:, None], n)
            s = np.sort(at, axis=1)
            good = np.flatnonzero(~taken[at].any(axis=1) & (s[:, 1:] != s[:, :-1]).all(axis=1))
            if len(good):
                displacement[k] = seed + good[0]
                slots[own] = at[good[0]]
                taken[at[good[0]]] = True
                break
            seed += 64
    free = np.flatnonzero(~taken)
    single = order[starts[:-1][sizes == 1]]
    slots[single] = free[: len(single)]
    displacement[group[single]] = -free[: len(single)] - 1
    return displacement, slots


def find_slots(displacement: np.ndarray, n: int, digests: np.ndarray) -> np.ndarray:
    """The only slot each digest can have."""
    g, a, b = _words(digests)
    d = displacement[(g % np.uint64(len(displacement))).astype(np.int64)]
    return np.where(d < 0, -d - 1, _slot(a, b, np.maximum(d, 0).astype(np.uint64), n))


def _digest_matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def _build(table: pa.Table) -> pa.Table:
    digests = _digest_matrix(table["digest"])
    displacement, slots = build_perfect_hash(digests)
    at = np.argsort(slots)
    win = table["win"].combine_chunks()
    pick = lambda column: [column.take(pa.array(at)).to_pylist()]
    return pa.table({
        "bucket": [table["bucket"][0].as_py()], "displacement": [displacement.astype("<i8").tobytes()], "digests": [digests[at].tobytes()],
        "win_id": pick(win.field("id")), "win_row": pick(win.field("row")), "n": pick(table["n"]),
    }, schema=_arrow(_INDEX))


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def _look_up(incoming: pa.Table, index: pa.Table) -> pa.Table:
    """The groups of a bucket: the history's, each with its repeats, then the nonmembers'."""
    ids, rows, counts, digests = [], [], [], np.empty((0, 32), np.uint8)
    slots = np.empty(0, np.int64)
    if index.num_rows:
        row = index.slice(0, 1).to_pylist()[0]
        digests = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
        ids, rows, counts = list(row["win_id"]), list(row["win_row"]), list(row["n"])
    more = []
    if incoming.num_rows:
        own = _digest_matrix(incoming["digest"])
        wins, n = incoming["win"].to_pylist(), incoming["n"].to_pylist()
        if len(digests):
            slots = find_slots(np.frombuffer(row["displacement"], "<i8"), len(digests), own)
            member = (digests[slots] == own).all(axis=1)
        else:
            slots, member = np.zeros(len(own), np.int64), np.zeros(len(own), bool)
        low = lambda x: (x is not None, x or 0)  # noqa: E731  nulls sort first, as in Spark
        for i, (s, m) in enumerate(zip(slots.tolist(), member.tolist(), strict=True)):
            if not m:
                more.append((own[i].tobytes(), wins[i]["id"], wins[i]["row"], n[i]))
                continue
            counts[s] += n[i]
            if (low(wins[i]["id"]), wins[i]["row"]) > (low(ids[s]), rows[s]):
                ids[s], rows[s] = wins[i]["id"], wins[i]["row"]
    all_rows = [(digests[i].tobytes(), ids[i], rows[i], counts[i]) for i in range(len(ids))] + more
    columns = list(zip(*all_rows, strict=True)) if all_rows else [[], [], [], []]
    schema = _arrow(_GROUPS)
    return pa.table([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _bucketed(distinct: DataFrame, buckets: int) -> DataFrame:
    return distinct.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)))


def dedup(history: DataFrame, incoming: DataFrame) -> DataFrame:
    """(digest, keep_id, keep_row, n) of every distinct digest in either table of digest_rows().

    The winner of equal texts is the largest (id, row) over both. Empty tables are fine; null ids
    sort below all others.
    """
    buckets = max(64, (history.count() + incoming.count()) // (2 * BUCKET))
    old = _bucketed(distinct_digests(history), buckets)
    index = materialise(old.groupBy("bucket").applyInArrow(_build, _INDEX), "perfect-hash")
    new = _bucketed(distinct_digests(incoming), buckets)
    groups = new.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(_look_up, _GROUPS)
    done = materialise(groups, "digest-groups")
    discard(index)
    return done


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    The first half of the id range is the history, the rest arrives. Equal texts (null is empty)
    form a group; its largest id stays. Of rows that repeat that id too, exactly one is kept. A
    null id never beats another. An empty table gives an empty one; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = materialise(digest_rows(docs, id_col, text_col), "digests")
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    middle = 0 if low is None else low + (high - low) // 2
    old = F.coalesce(F.col("doc_id") <= F.lit(middle), F.lit(True))
    groups = dedup(rows.filter(old), rows.filter(~old))
    out = rows.join(groups, "digest").select(
        "doc_id", "keep_id", F.col("n").alias("group_size"),
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
    out.reads = [rows, groups]
    return out
