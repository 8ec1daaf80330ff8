"""Near copies by SimHash and Golay codes over five-word shingles; the sets of shingles decide.

Texts with the same set of shingles are one node. Its SimHash is wide: bit by bit, how many shingles
have a one. Each of TABLES tables takes two words of 24 bits, which are decoded to codewords of the
extended Golay code by the counts, not by the bits alone: a bit that shingles hardly agree on weighs
little. Of all pairs of codewords, dealt into CLASSES classes, the nearest one of each class is a key.
Two sets of similarity 0.8 differ in at most 15 % of the bits (their cosine is 8/9 at least) and share
a key of a table with a probability of 0.53 or more, so (1 - 0.53)^22 of such pairs share none: about
one in sixteen million.

Nodes with equal keys meet in one task, each with 128 more bits of its SimHash, and those that differ
in more than DISTANCE of them part again; what is left together is a cell. Much the same nodes meet
under many keys, so nodes that are linked by cells are one family, which takes the place of its cells
unless it has more than FAMILY nodes. Members of a cell or family come to one task with a sketch: the
SKETCH least hashes of their set, which is the whole set of most texts. All of them are compared there,
by matrix products, and only a spanning forest of the likely links leaves the task, never all pairs.
Whole sets decide every link that leaves. One with more than BLOCK members is never held by one task:
its members are first compared with one of them, and those still apart with blocks of the others. Where
a sketch isn't the whole set it may mislead, so such pairs that are likely and still apart are all
decided in a second pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from branchframe.llm.common import discard, materialise, small_batches, tidy_after, utf8_parts
from branchframe.llm.components import connected_components
from branchframe.llm.simhash import extended_code

#: Words in a shingle, and the least similarity of near copies.
SHINGLE, SIMILARITY = 5, 0.8
#: Tables of two words, keys of a node in each, codewords of a word that are looked at; keys of a node.
TABLES, CLASSES, NEAREST = 22, 8, 8
BANDS = TABLES * CLASSES
#: Of 128 other bits, how many may differ: of pairs at the similarity 0.8 two in 10^9 differ in more (4 of 5 shingles: 1.4 in 10^6).
DISTANCE = 46
#: Members of a key that one task compares by these bits (24 bytes each); of a key with more none part.
HELD = 1 << 15
#: Nodes in a family at most; in blocks of BLOCK all of them are compared.
FAMILY = 1 << 14
#: 64-bit hashes that a shingle's hash is mixed into, for 48 bits a table and 64 to compare; the hash itself gives 64 more.
LANES = -(-TABLES * 48 // 64) + 1
#: Hashes in a sketch, what an estimate from a cut set may be too low by (over four standard errors), members compared at once.
SKETCH, MARGIN, BLOCK = 512, 0.08, 1024
_COLUMNS = 4096
_SHORT_RUN, _ROWS, _EDGES_HELD = 24, 1 << 17, 1 << 18
_CODE = np.ascontiguousarray(extended_code()[:2048].T, np.float32)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)

_KEYED = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("node", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("keys", pa.list_(pa.int32()))])
_KEYED_DDL = "doc_id bigint, digest binary, node bigint, low bigint, high bigint, keys array<int>"
_MEMBERS = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("head", pa.int64()), ("n", pa.int64())])
_SETS = pa.schema([("node", pa.int64()), ("size", pa.int64()), ("sketch", pa.binary()), ("grams", pa.binary())])
_SETS_DDL = "node bigint, size bigint, sketch binary, grams binary"
_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's word shingles, ascending; a shorter text is one shingle."""
    words = text.lower().split()
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begins = np.append(0, ends[:-shingle]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], 42) for a, b in zip(begins, (ends[shingle - 1 :] - 1).tolist(), strict=True)], np.uint64))


def bit_counts(grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """[nodes, 64 * (LANES + 1)]: how many hashes of each set that begins at ``starts`` have a one there; the last 64 are the hash's own bits."""
    terms = np.random.default_rng(20).integers(0, 1 << 64, (LANES, 1), np.uint64)
    out = np.zeros((len(starts), 64 * (LANES + 1)), np.int32)
    for i, (begin, end) in enumerate(zip(starts, np.append(starts[1:], len(grams)), strict=True)):
        for at in range(begin, end, 4080):
            part = grams[at : min(at + 4080, end)]
            mixed = (part ^ terms) * np.uint64(0xFF51AFD7ED558CCD)
            mixed ^= mixed >> np.uint64(32)
            mixed *= np.uint64(0xC4CEB9FE1A85EC53)
            mixed ^= mixed >> np.uint64(29)
            every = np.ascontiguousarray(np.concatenate([mixed, part[None]]).T.astype("<u8", copy=False)).view(np.uint8)
            bits = np.unpackbits(every, axis=1, bitorder="little")
            for row in range(0, len(bits), 255):  # sums of bytes
                out[i] += np.add.reduce(bits[row : row + 255], axis=0, dtype=np.uint8)
    return out


def _nearest(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the NEAREST codewords of each of ``words`` [n, 24], and how much farther than the nearest each is."""
    codes, behind = np.empty((len(words), NEAREST), np.int64), np.empty((len(words), NEAREST), np.float32)
    for at in range(0, len(words), 512):
        score = words[at : at + 512] @ _CODE  # the other half of the code is opposite
        size = np.abs(score)
        row = np.arange(len(size))[:, None]
        top = np.argpartition(size.reshape(len(size), 32, 64).max(axis=1), 64 - NEAREST, axis=1)[:, 64 - NEAREST :]
        place = (top[:, :, None] + 64 * np.arange(32)).reshape(len(size), -1)
        held = size[row, place]
        best = np.argpartition(held, held.shape[1] - NEAREST, axis=1)[:, -NEAREST:]
        place, held = place[row, best], held[row, best]
        codes[at : at + 512] = np.where(score[row, place] > 0, place, 4095 - place)
        behind[at : at + 512] = held.max(axis=1, keepdims=True) - held
    return codes, behind


def golay_bands(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """[nodes, BANDS] keys of sets of ``sizes`` hashes by their bit_counts(); equal ones of two nodes are in one column."""
    tie = np.random.default_rng(21).uniform(-0.02, 0.02, (2 * TABLES, 24)).astype(np.float32)  # below any difference of scores, alike for all
    out = np.empty((len(counts), BANDS), np.int32)
    table = np.tile(np.arange(TABLES) << 24, 64)
    for at in range(0, len(counts), 64):
        words = (2 * counts[at : at + 64, : 48 * TABLES] - sizes[at : at + 64, None]).astype(np.float32).reshape(-1, 2 * TABLES, 24) + tie
        codes, behind = _nearest(words.reshape(-1, 24))
        codes, behind = codes.reshape(-1, 2, NEAREST), behind.reshape(-1, 2, NEAREST)
        pair = (codes[:, 0, :, None] << 12 | codes[:, 1, None, :]).reshape(len(codes), -1)
        far = (behind[:, 0, :, None] + behind[:, 1, None, :]).reshape(len(codes), -1)
        kind = pair.astype(np.uint32) * np.uint32(0x9E3779B1) >> np.uint32(29)
        nearest, row = np.argmin(far, axis=1), np.arange(len(codes))
        keys = np.empty((len(codes), CLASSES), np.int64)
        for c in range(CLASSES):
            own = np.where(kind == c, far, np.inf)
            best = np.argmin(own, axis=1)
            keys[:, c] = pair[row, np.where(np.isfinite(own[row, best]), best, nearest)]  # one in 1,400 classes has none
        out[at : at + 64] = (keys | table[: len(codes), None]).reshape(-1, BANDS)
    return out


def _sizes(grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.diff(np.append(starts, len(grams)))


def band_keys(grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """[nodes, BANDS] keys of the sets that begin at ``starts`` in ``grams``; none is empty."""
    return golay_bands(bit_counts(grams, starts), _sizes(grams, starts))


def _node(grams: np.ndarray) -> tuple[bytes, int]:
    held = grams.astype("<u8").tobytes()
    return held, xxhash.xxh64_intdigest(held, 42)


def _texts(batch: pa.RecordBatch, column: int):
    raw, offsets = utf8_parts(batch.column(column))
    whole = raw.tobytes()
    return (whole[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))


def _digest(text_col: str):
    return F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, digest of the text, node, 128 bits, keys) of each row of ``docs``. Null texts count as empty."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in tidy_after(batches):
            if not len(batch):
                continue
            sets = [shingle_set(t, shingle) for t in _texts(batch, 2)]
            sizes = np.array([len(s) for s in sets], np.int64)
            counts = bit_counts(np.concatenate(sets), np.cumsum(sizes) - sizes)
            bits = np.packbits(2 * counts[:, -128:] > sizes[:, None], axis=1, bitorder="little").view("<i8")
            keys = golay_bands(counts, sizes)
            nodes = np.array([_node(s)[1] for s in sets], np.uint64).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes), pa.array(bits[:, 0]), pa.array(bits[:, 1]), lists], schema=_KEYED)

    return docs.select(F.col(id_col).cast("bigint"), _digest(text_col), F.col(text_col)).mapInArrow(run, _KEYED_DDL)


def shingle_sets(texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(node, size, sketch, grams) of each row of ``texts(text)``."""
    small_batches(texts.sparkSession)

    def run(batches):
        for batch in tidy_after(batches):
            rows = []
            for text in _texts(batch, 0):
                grams = shingle_set(text, shingle)
                held, node = _node(grams)
                rows.append((node, len(grams), (grams[:SKETCH] >> np.uint64(32)).astype("<u4").tobytes(), held))
            if rows:
                nodes, sizes, sketches, grams = zip(*rows, strict=True)
                columns = [pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes), pa.array(sketches, pa.binary()), pa.array(grams, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=_SETS)

    return texts.select("text").mapInArrow(run, _SETS_DDL)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many of their bits rows [..., 2] differ."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _groups(keys: np.ndarray, bits: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of each row the first one of its group: rows of one run of equal keys that are linked by DISTANCE bits at most."""
    edges = []
    at = np.flatnonzero(np.repeat(size <= _SHORT_RUN, size) & np.append(keys[1:] == keys[:-1], False))
    for step in range(1, _SHORT_RUN):
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
        if not len(at):
            break
        near = at[_apart(bits[at], bits[at + step]) <= DISTANCE]
        edges.append((near, near + step))
    for first, n in zip(begin[size > _SHORT_RUN].tolist(), size[size > _SHORT_RUN].tolist(), strict=True):
        left = np.arange(first, first + n)
        while len(left):
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                one = queue.pop()
                near = _apart(bits[left], bits[one]) <= DISTANCE
                found, left = left[near], left[~near]
                edges.append((np.full(len(found), one), found))
                queue += found.tolist()
    least = np.arange(len(keys))
    if edges:
        u, v = (np.concatenate(x) for x in zip(*edges, strict=True))
        while True:
            low = np.minimum(least[u], least[v])
            if (low == least[u]).all() and (low == least[v]).all():
                break
            np.minimum.at(least, u, low)
            np.minimum.at(least, v, low)
    return least


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * _GOLDEN
    return x ^ x >> np.uint64(29)


def meeting(nodes: DataFrame, most: int = HELD) -> DataFrame:
    """Distinct (key, node, head, n) of the cells that ``nodes(node, low, high, keys)`` make; the head is a member, n their number (most + 1 of a key with more)."""

    def run(batches):
        held = [np.empty(0, np.int64)] * 4
        coming: list[list[np.ndarray]] = []
        large = head = None  # the last key and its first member, if more than ``most`` of its members have come

        def rows(keys, nodes, heads, n):
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(nodes), *(pa.array(np.broadcast_to(np.int64(x), len(keys)).copy()) for x in (heads, n))], schema=_MEMBERS)

        def done(last: bool):
            nonlocal held, coming, large, head
            held, coming = [np.concatenate(x) for x in zip(held, *coming, strict=True)], []
            if large is not None:
                more = int(np.searchsorted(held[0], large, "right"))
                if more:
                    yield rows(held[0][:more], held[1][:more], head, most + 1)
                held = [x[more:] for x in held]
            if not len(held[0]):
                return
            keys = held[0]
            begin = np.append(0, np.flatnonzero(keys[1:] != keys[:-1]) + 1)
            size = np.diff(np.append(begin, len(keys)))
            whole = len(begin) if last or size[-1] > most else len(begin) - 1
            large = int(keys[-1]) if size[-1] > most else None
            upto = len(keys) if whole == len(begin) else int(begin[-1])
            (keys, nodes, *bits), held = [x[:upto] for x in held], [x[upto:] for x in held]
            size = size[:whole]
            many = np.repeat(size > most, size)
            heads = nodes[np.repeat(begin[: len(size)], size)]
            if many.any():
                yield rows(keys[many], nodes[many], heads[many], most + 1)
                head = int(heads[-1])
            few = np.repeat((size > 1) & (size <= most), size)
            keys, nodes, bits = keys[few], nodes[few], np.stack(bits, axis=1)[few].view(np.uint64)
            size = size[(size > 1) & (size <= most)]
            group = _groups(keys, bits, np.cumsum(size) - size, size)
            n, name = np.bincount(group, minlength=len(keys)), np.zeros(len(keys), np.uint64)
            np.add.at(name, group, _mix(nodes.view(np.uint64)))
            name = _mix(name + n.astype(np.uint64)).view(np.int64)
            least = np.full(len(keys), np.iinfo(np.int64).max)
            np.minimum.at(least, group, nodes)
            met = n[group] > 1
            if met.any():
                yield rows(name[group[met]], nodes[met], least[group[met]], n[group[met]])

        for batch in batches:
            coming.append([c.to_numpy().astype(np.int64, copy=False) for c in batch.columns])
            if sum(len(c[0]) for c in coming) >= max(_ROWS, len(held[0])):
                yield from done(False)
        yield from done(True)

    small_batches(nodes.sparkSession)
    rows = nodes.select(F.explode("keys").alias("key"), "node", "low", "high")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key bigint, node bigint, head bigint, n bigint").distinct()


def _spanning(batches):
    """Fewer edges of the same components: in blocks of those of a task, each node's with the least of its component."""

    def done(block):
        ends, code = np.unique(np.concatenate([x for pair in zip(*block, strict=True) for x in pair]), return_inverse=True)
        parent = list(range(len(ends)))
        u, v = np.split(code, 2)
        for a, b in zip(u.tolist(), v.tolist(), strict=True):
            while parent[a] != a:
                parent[a] = a = parent[parent[a]]
            while parent[b] != b:
                parent[b] = b = parent[parent[b]]
            parent[max(a, b)] = min(a, b)
        for i, up in enumerate(parent):  # a parent is less
            parent[i] = parent[up]
        root = np.array(parent)
        below = root != np.arange(len(root))
        yield pa.RecordBatch.from_arrays([pa.array(ends[below]), pa.array(ends[root[below]])], schema=_EDGES)

    block: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        block.append(tuple(c.to_numpy() for c in batch.columns))
        if sum(len(x) for x, _ in block) >= _EDGES_HELD:
            yield from done(block)
            block = []
    if block:
        yield from done(block)


def families(cells: DataFrame, most: int = FAMILY) -> DataFrame:
    """(key, node, n): nodes that are linked by cells are one larger cell, where they are ``most`` at most; else the cells as they are.

    Under many keys much the same nodes meet, in ever other selections; so tasks first span what they read of ``cells``.
    """
    edges = cells.filter("node <> head").select("node", "head").mapInArrow(_spanning, "u bigint, v bigint")
    roots = connected_components(edges)
    sizes = materialise(roots.groupBy("root").agg(F.count("*").alias("n")), "sizes")
    out = roots.join(sizes.filter(F.col("n") <= most), "root").select(F.col("root").alias("key"), "node", "n")
    large = sizes.filter(F.col("n") > most)
    if not large.isEmpty():
        out = out.unionByName(cells.join(roots.join(large, "root").select("node"), "node", "left_semi").select("key", "node", "n"))
    done = materialise(out, "members")
    discard(cells, sizes, roots)
    return done


def likeness(sketches: list[np.ndarray], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarities of all sets, and whether each is exact (both sketches are whole sets).

    A cut sketch holds all hashes up to its last; two sets are compared by what they have up to the lesser last.
    """
    n = len(sketches)
    flat, row = np.concatenate(sketches), np.repeat(np.arange(n), [len(s) for s in sketches])
    kinds, code, often = np.unique(flat, return_inverse=True, return_counts=True)
    common, place = np.zeros((n, n), np.float32), np.cumsum(often > 1) - 1
    shared = often[code] > 1
    row, column = row[shared], place[code[shared]]
    for first in range(0, int((often > 1).sum()), _COLUMNS):
        here = (column >= first) & (column < first + _COLUMNS)
        block = np.zeros((n, min(_COLUMNS, int((often > 1).sum()) - first)), np.float32)
        block[row[here], column[here] - first] = 1
        common += block @ block.T
    whole = np.array([len(s) == size for s, size in zip(sketches, sizes, strict=True)])
    if whole.all():
        below = np.repeat(np.asarray(sizes, np.float32)[:, None], n, axis=1)
    else:
        last = np.array([0xFFFFFFFF if w else s[-1] for s, w in zip(sketches, whole, strict=True)], np.uint32)
        below = np.array([np.searchsorted(s, last, "right") for s in sketches], np.float32)
    return common / np.maximum(below + below.T - common, 1), whole[:, None] & whole[None, :]


def forest(good: np.ndarray, weight: np.ndarray, roots: np.ndarray) -> list[tuple[int, int]]:
    """Links that span the components of a symmetric relation over groups of equal roots: shallow, and none within a group."""
    if len(good) == 2:
        return [(0, 1)] if good[0, 1] and roots[0] != roots[1] else []
    left, out = np.ones(len(good), bool), []
    for start in np.argsort(-good.sum(axis=1), kind="stable").tolist():
        if not left[start]:
            continue
        group = left & (roots == roots[start])
        left &= ~group
        queue = [start, *(i for i in np.flatnonzero(group).tolist() if i != start)]
        for at in queue:
            near = np.flatnonzero(left & good[at])
            if len(near):
                near = near[np.argsort(-weight[at, near], kind="stable")]
                near = near[np.unique(roots[near], return_index=True)[1]]
                out += [(at, j) for j in near.tolist()]
                group = left & np.isin(roots, roots[near])
                left &= ~group
                queue += np.flatnonzero(group).tolist()
    return out


def _cell_links(nodes: np.ndarray, roots: np.ndarray, sketches: list[np.ndarray], sizes: np.ndarray, similarity: float, again: bool) -> list[tuple[int, int]]:
    """Likely links of the members of a cell: a spanning forest, and if ``again`` all between what is still apart and not exact."""
    likely, exact = likeness(sketches, sizes)
    good = likely >= np.where(exact, similarity - 1e-6, similarity - MARGIN)
    more: list[tuple[int, int]] = []
    if again:
        a, b = np.nonzero(np.triu(good & ~exact & (roots[:, None] != roots[None, :]), 1))
        more = list(zip(a.tolist(), b.tolist(), strict=True))
        good &= exact
    return [(int(nodes[i]), int(nodes[j])) for i, j in [*forest(good, likely, roots), *more]]


def likely_links(cells: DataFrame, sets: DataFrame, similarity: float, again: bool) -> DataFrame:
    """Distinct (u, v), u > v, of ``cells(cell, node, root)``; a cell has about BLOCK members at most."""

    def run(batches):
        held: list[tuple] = []
        last = None

        def done():
            if len({r[0] for r in held}) > 1 and len({r[1] for r in held}) > 1:
                nodes, roots, sizes = (np.array([r[i] for r in held], np.int64) for i in range(3))
                edges = _cell_links(nodes, roots, [np.frombuffer(r[3], "<u4") for r in held], sizes, similarity, again)
                if edges:
                    u, v = np.array(edges, np.int64).T
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], schema=_EDGES)

        for batch in tidy_after(batches):
            for cell, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if cell != last:
                    yield from done()
                    held, last = [], cell
                held.append(tuple(row))
        yield from done()

    small_batches(cells.sparkSession)
    rows = cells.join(sets.select("node", "size", "sketch"), "node").select("cell", "node", "root", "size", "sketch")
    return rows.repartition("cell").sortWithinPartitions("cell", "node").mapInArrow(run, "u bigint, v bigint").distinct()


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of ``pairs(u, v)`` those whose whole sets are similar enough."""

    def run(batches):
        for batch in tidy_after(batches):
            near = np.zeros(len(batch), bool)
            for i, (a, b) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(a.as_buffer(), "<u8"), np.frombuffer(b.as_buffer(), "<u8")
                common = len(np.intersect1d(x, y, assume_unique=True))
                near[i] = common >= similarity * (len(x) + len(y) - common) - 1e-9
            yield batch.select(["u", "v"]).filter(pa.array(near)).cast(_EDGES)

    own = sets.select(F.col("node").alias("u"), F.col("grams").alias("a")), sets.select(F.col("node").alias("v"), F.col("grams").alias("b"))
    small_batches(pairs.sparkSession)
    return pairs.join(own[0], "u").join(own[1], "v").select("u", "v", "a", "b").mapInArrow(run, "u bigint, v bigint")


def _head_pairs(members: DataFrame) -> DataFrame:
    """Distinct (u, v), u > v: every member of a key with one of the key's."""
    heads = members.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", "key").alias("place"), F.col("node").alias("head"))).alias("first")).select("key", "first.head")
    return members.join(heads, "key").filter("node <> head").select(F.greatest("node", "head").alias("u"), F.least("node", "head").alias("v")).distinct()


def _cells_apart(members: DataFrame, block: int) -> DataFrame:
    """(cell, node, root) of ``members(key, node, root)``, of keys with two roots or more.

    Members of a key's largest root aren't compared with each other. The others are dealt into blocks, which
    meet each other and the blocks of the largest root; a cell is a pair of blocks.
    """
    by_root = members.groupBy("key", "root").agg(F.count("*").alias("n"))
    largest = by_root.groupBy("key").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("all"), F.count("*").alias("roots")).filter("roots > 1")
    half = max(1, block // 2)
    blocks = largest.select(
        "key", F.col("top.root").alias("main"), F.ceil((F.col("all") - F.col("top.n")) / half).alias("few"), F.ceil(F.col("top.n") / half).alias("many"),
    )
    rows = members.join(blocks, "key")
    here = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    cell = lambda kind, a, b: F.concat_ws("/", F.col("key").cast("string"), F.lit(kind), a.cast("string"), b.cast("string")).alias("cell")
    apart, main = rows.filter("root <> main"), rows.filter("root = main")
    among = apart.withColumn("own", here("few")).withColumn("other", upto("few")).select(cell("a", F.least("own", "other"), F.greatest("own", "other")), "node", "root")
    left = apart.withColumn("own", here("few")).withColumn("other", upto("many")).select(cell("m", F.col("own"), F.col("other")), "node", "root")
    right = main.withColumn("own", here("many")).withColumn("other", upto("few")).select(cell("m", F.col("other"), F.col("own")), "node", "root")
    return among.unionByName(left).unionByName(right)


def node_roots(members: DataFrame, sets: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(node, root) of the linked nodes of ``members(key, node, n)``, n of a key; ``sets`` as of shingle_sets()."""
    small, large = members.filter(F.col("n") <= block), members.filter(F.col("n") > block)
    first = likely_links(small.select(F.col("key").alias("cell"), "node", F.col("node").alias("root")), sets, similarity, again=False)
    pairs = materialise(first.union(_head_pairs(large.select("key", "node"))).distinct(), "likely")
    links = materialise(_similar(pairs, sets, similarity), "near-links")
    roots = connected_components(links)
    discard(pairs, links)
    cut = sets.filter(F.octet_length("sketch") < 4 * F.col("size")).select(F.col("node").alias("cut_node")).distinct()
    keys = small.join(cut, F.col("node") == F.col("cut_node"), "left_semi").select("key").distinct()
    again = large.select("key", "node").unionByName(small.join(keys, "key", "left_semi").select("key", "node"))
    if again.isEmpty():
        return roots
    rooted = materialise(again.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "again")
    pairs = materialise(likely_links(_cells_apart(rooted, block), sets, similarity, again=True), "likely")
    of = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
    ends = [F.coalesce(f"{end}_root", end).alias(end) for end in "uv"]
    more = materialise(_similar(pairs, sets, similarity).join(of("u"), "u", "left").join(of("v"), "v", "left").select(*ends), "near-links")
    joined = connected_components(more).select(F.col("node").alias("old"), F.col("root").alias("new"))  # over roots: few rounds
    every = roots.select("node", "root").unionByName(more.select(F.explode(F.array("u", "v")).alias("node")).select("node", F.col("node").alias("root"))).distinct()
    out = materialise(every.join(joined, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root")).distinct(), "roots")
    discard(pairs, rooted, more, roots)
    return out


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """One row per distinct (doc_id, text) of ``docs``: doc_id, keep_id (least id of its group), kept, text_sha256, n (rows).

    Rows are near copies if the Jaccard similarity of their sets of word shingles is ``similarity`` or
    more; groups are the components of that. A-Z are lower-cased, words are runs of other than ASCII
    white space, texts without words (null, empty, blank) are equal. One (doc_id, text) of a group is
    kept: the one with the least id, of these the one with the least digest; a null id only if the group
    has no other. An empty table gives an empty one; other columns are ignored.
    """
    rows = materialise(keyed(docs, id_col, text_col, shingle), "keyed")
    ids = materialise(rows.groupBy("doc_id", "digest").agg(F.first("node").alias("node"), F.count("*").alias("n")), "ids")
    win = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("win")
    nodes = materialise(ids.groupBy("node").agg(win, F.min("digest").alias("rep")), "nodes")
    members = families(materialise(meeting(rows.dropDuplicates(["node"])), "cells"))
    reps = nodes.join(members.select("node").distinct(), "node", "left_semi").select(F.col("rep").alias("digest"))
    texts = docs.select(_digest(text_col).alias("digest"), F.col(text_col).alias("text")).join(reps, "digest", "left_semi").dropDuplicates(["digest"])
    sets = materialise(shingle_sets(texts, shingle), "sets")
    roots = node_roots(members, sets, similarity, block)
    rooted = nodes.join(roots, "node", "left").select("node", "win", F.coalesce("root", "node").alias("root"))
    best = rooted.groupBy("root").agg(F.min("win").alias("best"))
    wins = rooted.join(best, "root").select("node", "best")
    own = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("digest") == F.col("best.digest"))
    out = ids.join(wins, "node").select("doc_id", F.col("best.doc_id").alias("keep_id"), own.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "n")
    done = materialise(out, "near-copies")
    discard(rows, ids, nodes, members, sets, roots)
    return done
