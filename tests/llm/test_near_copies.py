"""Near copies of the pipeline against brute force on five-word shingles."""

import numpy as np

import corpus_pipeline
from branchframe.llm.common import materialise
from branchframe.llm.near_copies import CLASSES, DISTANCE, NEAREST, TABLES, band_keys, bit_counts, families, forest, golay_bands, likeness, meeting, near_copies, shingle_set
from branchframe.llm.simhash import extended_code
from tests.llm.test_dedup_ops import components

_WORDS = [f"w{i}" for i in range(5000)]


def near_stage(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return sorted(((r["doc_id"], r["text"]) for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "").collect()), key=str)


def edited(rng, words, changes):
    out = list(words)
    for at in rng.choice(len(words), changes, replace=False):
        out[at] = "changed" + str(rng.integers(1 << 30))
    return out


def test_near_stage_equals_brute_force_on_five_words(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(60):  # two to six changed words of 200: similarities from 0.74 to 0.9
        words = [_WORDS[k] for k in rng.integers(0, 5000, 200)]
        rows += [(i, " ".join(words)), (1000 + i, " ".join(edited(rng, words, 2 + i % 5))), (2000 + i, " ".join(edited(rng, words, 1)))]
    rows += [(3000, None), (3001, ""), (3002, " \t"), (3003, "One two"), (3004, "one  TWO"), (3005, "one two three")]
    sets = [{" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in ((t or "").lower().split() for _, t in rows)]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = components(len(rows), linked)
    assert near_stage(spark, rows) == sorted((rows[r] for r in {min((k for k in range(len(rows)) if root[k] == r), key=lambda k: rows[k][0]) for r in set(root)}), key=str)
    assert near_stage(spark, []) == []


def test_band_keys_meet_at_the_threshold():
    rng = np.random.default_rng(6)
    missed = 0
    for _ in range(300):
        x = rng.integers(0, 1 << 64, 110, np.uint64)
        a, b = np.unique(x[:100]), np.unique(np.append(x[:89], x[100:111]))  # 89 of 110: 0.81
        keys = band_keys(np.concatenate([a, b]), np.array([0, len(a)]))
        missed += not (keys[0] == keys[1]).any()
    assert missed == 0 and len(shingle_set(b"")) == 1 and len(shingle_set(b"a b c d e f")) == 2


def test_large_groups_are_compared_beyond_their_heads(spark):
    rng = np.random.default_rng(7)
    words, rows = [_WORDS[k] for k in range(100)], []
    for i in range(60):  # a chain: far ends are unlike
        rows.append((i, " ".join(words)))
        words = edited(rng, words, 1)
    assert near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).filter("kept").count() == 1


def test_near_stage_decides_by_row(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(_WORDS[k] for k in rng.integers(0, 5000, 120)) for _ in range(6)]
    copy = " ".join(edited(rng, texts[0].split(), 1))
    nulls = [(1, texts[0]), (None, copy), (None, texts[1]), (None, texts[2])]
    assert near_stage(spark, nulls) == sorted([(1, texts[0]), (None, texts[1]), (None, texts[2])], key=str)
    repeated = [(1, texts[0]), (2, copy), (2, texts[3])]
    assert near_stage(spark, repeated) == sorted([(1, texts[0]), (2, texts[3])], key=str)
    same_id, no_ids = near_stage(spark, [(7, texts[0]), (7, copy), (7, texts[4])]), near_stage(spark, [(None, texts[0]), (None, copy), (None, texts[5])])
    assert len(same_id) == len(no_ids) == 2 and (7, texts[4]) in same_id and (None, texts[5]) in no_ids
    assert len(near_stage(spark, [(3, texts[0]), (3, texts[0]), (4, copy), (5, None), (5, "")])) == 2


def brute_groups(rows):
    """The least index of each row's group."""
    sets = [{" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in ((t or "").lower().split() for _, t in rows)]
    return components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])


def test_keys_of_many_members_and_cut_sketches_lose_no_link(spark):
    rng = np.random.default_rng(9)
    base = [_WORDS[k] for k in rng.integers(0, 5000, 300)]
    rows = [(i, " ".join(edited(rng, base, int(rng.integers(0, 9))))) for i in range(80)]  # alike, some near and some not
    for i in range(12):  # more shingles than a sketch has; similarities from 0.73 to 0.9
        words = [_WORDS[k] for k in rng.integers(0, 5000, 900)]
        rows += [(1000 + i, " ".join(words)), (2000 + i, " ".join(edited(rng, words, 10 + 2 * i)))]
    root = brute_groups(rows)
    least = {r: min(rows[k][0] for k in range(len(rows)) if root[k] == r) for r in set(root)}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for block in (8, 1024):
        got = {r["doc_id"]: r["keep_id"] for r in near_copies(docs, block=block).collect()}
        assert got == {i: least[r] for (i, _), r in zip(rows, root, strict=True)}


def test_likeness_is_exact_for_whole_sets_and_the_forest_spans():
    rng = np.random.default_rng(10)
    sets = [np.unique(rng.integers(0, 400, 200, np.uint32)) for _ in range(30)]
    got, exact = likeness(sets, np.array([len(s) for s in sets]))
    assert exact.all() and all(abs(got[i, j] - len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j]))) < 1e-6 for i in range(30) for j in range(30))
    good = (got > 0.33) & ~np.eye(30, dtype=bool)
    every = [(i, j) for i in range(30) for j in range(i) if good[i, j]]
    links = forest(good, got, np.arange(30))
    assert components(30, links) == components(30, every) and len(links) == 30 - len(set(components(30, every)))
    roots = np.arange(30) // 3
    same = [(i, j) for i in range(30) for j in range(i) if roots[i] == roots[j]]
    links = forest(good, got, roots)
    assert components(30, links + same) == components(30, every + same) and len(links) == 10 - len(set(components(30, every + same)))


def test_near_stage_with_clashing_names_and_repeats(spark):
    rng = np.random.default_rng(11)
    texts = [" ".join(_WORDS[k] for k in rng.integers(0, 5000, 60)) for _ in range(3)]
    rows = [(3, texts[0], 1), (5, texts[0] + " more", 2), (5, texts[1], 3), (5, texts[1], 4), (7, texts[2], 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, gone long")
    for name in ("gone_id", "sure", "sure_id", "_code", "code", "n", "k", "part_id", "node", "keep_id"):
        docs = docs.withColumn(name, docs["gone"])
    got = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == sorted([(3, texts[0]), (5, texts[1]), (7, texts[2])])


def test_keys_are_the_nearest_golay_codewords_of_each_class():
    rng = np.random.default_rng(12)
    sets = [rng.integers(0, 1 << 64, n, np.uint64) for n in (1, 2, 7, 300, 5000)]
    sizes = np.array([len(s) for s in sets])
    counts = bit_counts(np.concatenate(sets), np.cumsum(sizes) - sizes)
    own = [[sum(int(h) >> b & 1 for h in s) for b in range(64)] for s in sets]
    assert counts[:, -64:].tolist() == own and counts.shape[1] >= 48 * TABLES + 128
    code = extended_code()
    assert {int(x) for x in np.unique(code @ code.T)} == {-24, -8, 0, 8, 24}
    keys = golay_bands(counts, sizes).reshape(len(sets), TABLES, CLASSES)
    sums = 2 * counts - sizes[:, None]
    kind = lambda x: (x * 0x9E3779B1 & 0xFFFFFFFF) >> 29
    for node, table in ((3, 0), (3, TABLES - 1), (4, 5)):
        scores = [code @ sums[node, 24 * w : 24 * w + 24] for w in (2 * table, 2 * table + 1)]
        best: dict = {}
        for a in np.argsort(-scores[0])[:NEAREST].tolist():
            for b in np.argsort(-scores[1])[:NEAREST].tolist():
                pair, score = a << 12 | b, scores[0][a] + scores[1][b]
                best[kind(pair)] = max(best.get(kind(pair), -np.inf), score)
        for c, key in enumerate(keys[node, table].tolist()):
            a, b = key >> 12 & 0xFFF, key & 0xFFF
            assert key >> 24 == table and kind(key & 0xFFFFFF) in (c, kind(int(np.argmax(scores[0])) << 12 | int(np.argmax(scores[1]))))
            assert kind(key & 0xFFFFFF) != c or scores[0][a] + scores[1][b] == best[c]


def test_sets_at_the_threshold_meet_in_many_tables_whatever_their_size():
    rng = np.random.default_rng(13)
    for one, other, both in ((0, 1, 4), (1, 1, 8), (5, 5, 40), (0, 100, 400)):
        sets = []
        for _ in range(100):
            x = rng.integers(0, 1 << 64, one + other + both, np.uint64)
            sets += [x[: one + both], x[one:]]
        sizes = np.array([len(s) for s in sets])
        counts = bit_counts(np.concatenate(sets), np.cumsum(sizes) - sizes)
        keys, bits = golay_bands(counts, sizes), 2 * counts[:, -128:] > sizes[:, None]
        met = (keys[::2] == keys[1::2]).reshape(100, TABLES, CLASSES).any(axis=2)
        assert met.mean() > 0.5 and met.any(axis=1).all() and (bits[::2] != bits[1::2]).sum(axis=1).max() <= DISTANCE


def test_nodes_meet_by_key_and_bits(spark):
    far = -1  # all 64 bits differ from 0
    rows = [(1, 0, 0, [5, 6]), (2, 1, 0, [5, 6]), (3, far, 0, [5, 7]), (4, 0, 0, [7, 8]), *((i, far * (i % 2), 0, [9]) for i in range(10, 16)), *((i, 0, 0, [2]) for i in range(1000, 4000))]
    got = meeting(spark.createDataFrame(rows, "node bigint, low bigint, high bigint, keys array<int>"), most=100)
    cells: dict = {}
    for r in got.collect():
        cells.setdefault((r["key"], r["n"]), set()).add(r["node"])
    assert cells.pop((2, 101)) == set(range(1000, 4000))  # over the block: all, not compared
    assert sorted((n, sorted(c)) for (_, n), c in cells.items()) == [(2, [1, 2]), (3, [10, 12, 14]), (3, [11, 13, 15])]
    for most, large in ((4000, False), (100, True)):  # families, and cells where a family would be too large
        found = {(r["key"], r["node"]): r["n"] for r in families(materialise(got, "cells"), most).collect()}
        groups: dict = {}
        for (key, node), n in found.items():
            groups.setdefault((key, n), set()).add(node)
        assert sorted((n, sorted(g)[:6]) for (_, n), g in groups.items()) == [(2, [1, 2]), (3, [10, 12, 14]), (3, [11, 13, 15]), (101 if large else 3000, list(range(1000, 1006)))]
