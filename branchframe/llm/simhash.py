"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint has 64 bits; those that differ in at most three are linked. Cut into four segments of
16 bits, two such fingerprints agree in one segment at least. The other 48 bits are two halves of 24,
and one half has at most one error: its first 23 bits are decoded by the perfect binary Golay code.
Any 23-bit word lies within three bits of exactly one codeword, so a word has the key of its own
codeword and those of the codewords of its 23 neighbours (one to six different keys). If two words
differ in one bit at most, the codeword of each is among the keys of the other. A key is therefore
(segment, half, the segment's bits, a codeword's 12-bit index).

Fingerprints are made distinct first, so copies never meet. Fingerprints with equal keys are sorted
next to each other; within such a run a spanning forest of the verified links comes out, never all
pairs. A run is held by one task, 8 bytes a fingerprint: only fingerprints that agree in 16 bits and
lie near one codeword share a key. Components are found over distinct fingerprints and joined back to
the documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from branchframe.llm.common import discard, materialise, small_batches, tidy_after, utf8_parts
from branchframe.llm.components import connected_components

#: Words in a shingle, and bits that may differ.
SHINGLE, DISTANCE = 3, 3
SEGMENTS = 4
#: The generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
_SHORT_RUN = 24
_ROWS = 1 << 18


def _golay_table() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the 2^23 words are looked up in two halves; the error of each of the 2^11 remainders."""

    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    single = np.array([remainder(1 << b) for b in range(23)], np.uint32)
    errors = np.zeros(1 << 11, np.uint32)
    for a in range(23):
        for b in range(a, 23):
            for c in range(b, 23):
                bits = {a, b, c}
                code = 0
                for x in bits:
                    code ^= int(single[x])
                errors[code] = sum(1 << x for x in bits)
    return single, errors


_SINGLE, _ERRORS = _golay_table()


def _halves() -> tuple[np.ndarray, np.ndarray]:
    low, high = np.zeros(1 << 12, np.uint32), np.zeros(1 << 11, np.uint32)
    for b in range(12):
        low[(np.arange(1 << 12) >> b & 1) == 1] ^= _SINGLE[b]
    for b in range(11):
        high[(np.arange(1 << 11) >> b & 1) == 1] ^= _SINGLE[12 + b]
    return low, high


_LOW, _HIGH = _halves()


def codeword_index(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit word."""
    syndrome = _LOW[words & 0xFFF] ^ _HIGH[words >> 12]
    return (words ^ _ERRORS[syndrome]) >> 11


def extended_code() -> np.ndarray:
    """[4096, 24] signs of the codewords in the order of their indices, with a parity bit; i and 4095 - i are opposite."""
    words = np.arange(1 << 12, dtype=np.uint32) << 11
    words ^= _LOW[words & 0xFFF] ^ _HIGH[words >> 12]
    bits = words[:, None] >> np.arange(23, dtype=np.uint32) & 1
    return 2.0 * np.concatenate([bits, bits.sum(axis=1, keepdims=True) & 1], axis=1) - 1


def nearby_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and indices of the distinct codewords nearest to a word or to one of its 23 neighbours."""
    around = np.concatenate([codeword_index(words)[None], *(codeword_index(words ^ np.uint32(1 << b))[None] for b in range(23))])
    around.sort(axis=0)
    keep = np.ones(around.shape, bool)
    keep[1:] = around[1:] != around[:-1]
    row, at = np.nonzero(keep.T)
    return row, around[at, row]


def golay_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every key of each fingerprint, as int64. Two within DISTANCE bits share one at least."""
    rows, keys = [], []
    for segment in range(SEGMENTS):
        own = prints >> np.uint64(16 * segment) & np.uint64(0xFFFF)
        under = prints & np.uint64((1 << 16 * segment) - 1)
        rest = under | (prints >> np.uint64(16 * segment + 16) << np.uint64(16 * segment) if segment < SEGMENTS - 1 else np.uint64(0))
        for half in range(2):
            word = (rest >> np.uint64(24 * half) & np.uint64(0x7FFFFF)).astype(np.uint32)
            row, index = nearby_indices(word)
            rows.append(row)
            keys.append(np.int64((segment * 2 + half) << 28) | (own[row] << np.uint64(12)).astype(np.int64) | index.astype(np.int64))
    return np.concatenate(rows), np.concatenate(keys)


def fingerprint(text: bytes) -> int:
    """The SimHash of a text's word shingles; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(sizes)
        begins = (ends - sizes)[: 1 - SHINGLE].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(begins, (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


_PRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
_KEYS = pa.schema([("key", pa.int64()), ("fp", pa.int64())])
_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint's bits as a bigint. Null texts count as empty."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in tidy_after(batches):
            raw, offsets = utf8_parts(batch.column(1))
            whole = raw.tobytes()
            prints = [fingerprint(whole[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64))], schema=_PRINTS)

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(run, "doc_id bigint, fp bigint")


def _keyed(batches):
    for batch in batches:
        prints = batch.column(0).to_numpy().view(np.uint64)
        for at in range(0, len(prints), 1 << 13):
            part = prints[at : at + (1 << 13)]
            rows, keys = golay_keys(part)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows].view(np.int64))], schema=_KEYS)


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= DISTANCE


def _forest(prints: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that span the components of distinct fingerprints: each one reached looks at those not reached yet."""
    edges, left = [], prints
    while len(left):
        queue, left = [left[:1]], left[1:]
        while queue and len(left):
            layer = queue.pop()
            for x in layer:
                near = _near(left, x)
                if near.any():
                    found, left = left[near], left[~near]
                    edges.append((np.full(len(found), x), found))
                    queue.append(found)
                    if not len(left):
                        break
    return edges


def _links(keys: np.ndarray, prints: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Verified links that span the components within each run of equal keys (keys are sorted)."""
    cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    begin, end = np.append(0, cut), np.append(cut, len(keys))
    size = end - begin
    short = np.repeat(size <= _SHORT_RUN, size)
    edges = []
    at = np.flatnonzero(short & np.append(keys[1:] == keys[:-1], False))
    for step in range(1, _SHORT_RUN):
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
        if not len(at):
            break
        near = at[_near(prints[at], prints[at + step])]
        edges.append((prints[near], prints[near + step]))
    for a, b in zip(begin[size > _SHORT_RUN].tolist(), end[size > _SHORT_RUN].tolist(), strict=True):
        edges += _forest(np.unique(prints[a:b]))
    return edges


def _linked(batches):
    """Runs may be cut by batches: the last run of what has come waits for the rest of it."""
    keys, prints = np.empty(0, np.int64), np.empty(0, np.uint64)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0

    def done(last: bool):
        nonlocal keys, prints, held, waiting
        keys, prints = np.concatenate([keys, *(k for k, _ in held)]), np.concatenate([prints, *(p for _, p in held)])
        held, waiting = [], 0
        upto = len(keys) if last or not len(keys) else int(np.searchsorted(keys, keys[-1], "left"))
        edges = _links(keys[:upto], prints[:upto]) if upto else []
        keys, prints = keys[upto:], prints[upto:]
        if edges:
            u, v = (np.concatenate(x).view(np.int64) for x in zip(*edges, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], schema=_EDGES)

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)))
        waiting += len(batch)
        if waiting >= max(_ROWS, len(keys)):
            yield from done(False)
    yield from done(True)


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """(u, v) links that span the components of the distinct fingerprints in column fp; none is over DISTANCE."""
    small_batches(distinct.sparkSession)
    keys = distinct.select("fp").mapInArrow(_keyed, "key bigint, fp bigint")
    return keys.repartition("key").sortWithinPartitions("key").mapInArrow(_linked, "u bigint, v bigint").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable).

    A-Z are lower-cased, words are runs of other than ASCII white space, shingles have three words
    and count as often as they occur; shorter texts are one shingle; null or empty texts have
    fingerprint zero and link like any other. Fingerprints link at three or fewer differing bits.
    Repeated rows stay rows; null ids never name a component unless it has no other. An empty table
    gives an empty one; other columns are ignored.
    """
    prints = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    links = materialise(fingerprint_links(classes), "fingerprint-links")
    roots = connected_components(links)
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = materialise(rooted.join(least, "root").select("fp", "component_id"), "components")
    discard(links, classes)
    return prints.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
