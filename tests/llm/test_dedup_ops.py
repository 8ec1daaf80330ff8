"""Exact dedup, SimHash, embeddings, WARC and chats against brute force on small fixtures with odd rows."""

import base64
import gzip
import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from branchframe.llm import queries as q
from branchframe.llm.chat import format_chats, maximal_conversations
from branchframe.llm.common import keep_rows
from branchframe.llm.components import connected_components
from branchframe.llm.embed_dedup import bucket_rows, cosines, hadamard, most_signs, near_vectors
from branchframe.llm.exact_dedup import build_perfect_hash, exact_dedup, find_slots
from branchframe.llm.simhash import _forest, codeword_index, fingerprint, golay_keys, near_duplicates
from branchframe.llm.warc import assemble, parse_archive, read_archives, warc_round_trip, write_archives
from tests.conftest import DATA
from tests.test_queries import compare


def components(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in linked:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("name", ["op4_warc", "op6_exact_dedup", "op8_chat_format", "op10_embedding_near_dedup"])
def test_query_equals_its_sql(spark, name):
    compare(q.queries()[name](spark, DATA), q.oracle_sql()[name])


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 201), (201, 202), (202, 200)] + [(5, 5), (1, 0)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {i: 200 for i in range(200, 203)}
    assert connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


# Exact dedup

def test_perfect_hash_is_a_permutation():
    for n in (1, 2, 3, 17, 1000):
        digests = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(n)), np.uint8).reshape(n, 32)
        displacement, slots = build_perfect_hash(digests)
        assert sorted(slots.tolist()) == list(range(n)) and (find_slots(displacement, n, digests) == slots).all()


def test_exact_dedup_of_odd_rows(spark):
    texts = ["a", "A", "", None, "a", "b ", "b", "é", "é", "x" * 200_000, "x" * 200_000, "a"]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(11, "a", "again"), (None, "b", "no id"), (None, "only null", "z")]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id bigint, text string, digest string")).collect()
    assert len(got) == len(rows)
    by = {}
    for i, t, _ in rows:
        by.setdefault(t or "", []).append(i)
    for r in got:
        own = next(ids for t, ids in by.items() if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
        top = max((i for i in own if i is not None), default=None)
        assert r["doc_id"] in own and r["keep_id"] == top and r["group_size"] == len(own)
        assert not r["kept"] or r["doc_id"] == top
    assert sum(r["kept"] for r in got) == len(by)
    assert exact_dedup(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_keep_rows_keeps_one_of_each(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (2, "a"), (3, "b"), (None, "c"), (None, "c")], "doc_id bigint, text string").withColumn("n", F.lit(1))
    got = keep_rows(docs, exact_dedup(docs)).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == [("2", "a"), ("3", "b"), ("None", "c")] and got[0].asDict().keys() == {"doc_id", "text", "n"}


# SimHash

def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if hashes and sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_golay_keys_meet_within_three_bits():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 64, 400, dtype=np.uint64)
    words = (base & np.uint64(0x7FFFFF)).astype(np.uint32)
    assert codeword_index(words).max() < 1 << 12
    keys = [set() for _ in base]
    for row, key in zip(*golay_keys(base), strict=True):
        keys[row].add(int(key))
    for d in range(4):
        other = np.array([x ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, d, replace=False))) for x in base], np.uint64)
        near = [set() for _ in base]
        for row, key in zip(*golay_keys(other), strict=True):
            near[row].add(int(key))
        assert all(a & b for a, b in zip(keys, near, strict=True))


def test_forest_spans_without_all_pairs():
    prints = np.unique(np.array([sum(1 << i for i in range(64) if x >> i & 1) for x in range(300)], np.uint64))
    edges = _forest(prints)
    pairs = [(int(u), int(v)) for a, b in edges for u, v in zip(a, b, strict=True)]
    assert len(pairs) < len(prints) and len(set(components(300, pairs))) == 1


def test_near_duplicates_equal_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").limit(150)
    rng = np.random.default_rng(1)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for i, t in rows[:40]:
        words = t.split(" ")
        words[int(rng.integers(len(words)))] = "changed"
        rows.append((i + 10_000, " ".join(words)))
    rows += [(20_000, None), (20_001, ""), (20_002, " \t"), (20_003, "one"), (20_004, "ONE"), (20_005, "one two"), (20_006, "w " * 60_000), (20_007, rows[0][1]), (20_007, rows[0][1])]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("fp", F.lit("clash"))).collect()
    prints = [brute_print(t) for _, t in rows]
    root = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        least[r] = min(least.get(r, i), i)
    want = sorted((i, f"{p:016x}", least[r]) for (i, _), p, r in zip(rows, prints, root, strict=True))
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want
    assert fingerprint(b"") == 0 and near_duplicates(docs.limit(0)).count() == 0


# Embeddings

def test_near_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 64))
    rows = [(i, (centres[i % 60] + rng.normal(size=64) * 0.08 * (i % 3)).astype(np.float32).tolist(), int(i % 60) % 4) for i in range(300)]
    rows += [(300, [0.0] * 64, 1), (301, None, 1), (302, [float("nan")] * 64, 1), (303, rows[0][1], None), (304, rows[0][1], 0), (305, rows[0][1], 0), (306, [None] * 64, 2), (307, [], 2), (308, [float("inf")] * 64, 0), (309, [2 * x for x in rows[1][1]], 1)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumn("key", F.lit(1))
    got = {r["vec_id"]: r for r in near_vectors(frame).collect()}
    good = lambda v: v is not None and len(v) == 64 and None not in v and np.isfinite(v).all() and np.any(v)
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if rows[i][2] is not None and rows[i][2] == rows[j][2] and good(rows[i][1]) and good(rows[j][1]) and cosines([np.array(rows[i][1], float).tobytes()], [np.array(rows[j][1], float).tobytes()])[0] >= 0.98]
    assert len(linked) > 100
    hot = {r["vec_id"]: r for r in near_vectors(frame, hot=1, block=4).collect()}  # all buckets are compared in blocks
    root, degree = components(len(rows), linked), np.bincount(np.array(linked).ravel(), minlength=len(rows))
    for i, r in enumerate(rows):
        assert (hot[r[0]]["n_links"], hot[r[0]]["component_id"]) == (degree[i], root[i])
        assert (got[r[0]]["n_links"], got[r[0]]["component_id"], got[r[0]]["kept"]) == (degree[i], root[i], root[i] == i)
    assert near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("width", [16, 64, 384, 1024])
def test_hashing_recall_at_the_threshold(width):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    (a, s), (b, t) = bucket_rows(["0"] * 1500, x), bucket_rows(["0"] * 1500, y)
    assert (np.bitwise_count((s ^ t).view(np.uint64)) <= most_signs(0.98)).all()
    met = (a[:, :, :1] == b).any(axis=(1, 2)) | (b[:, :, :1] == a).any(axis=(1, 2))
    assert met.mean() >= 0.995
    if width & (width - 1) == 0:
        assert np.allclose(hadamard(hadamard(x)) / width, x)


# WARC

PAGES = [(1, "http://a", "<p>one</p>"), (2, "http://b", "<p>one</p>"), (3, None, None), (4, "http://d", ""), (5, "http://e\r\nx", "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n"), (6, "http://é", "é" * 70_000), (2, "http://b", "<p>one</p>"), (None, "http://n", "none")]


def test_warc_of_odd_rows(spark):
    got = warc_round_trip(spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumn("kind", F.lit("clash"))).collect()
    assert len(got) == len(PAGES)
    want = []
    for i, _, html in PAGES:
        body = (html or "").encode()
        top = max((j for j, _, h in PAGES if (h or "") == (html or "") and j is not None), default=None)
        response = i is None or i == top
        want.append((str(i), len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if response else "revisit", None if response else top))
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == sorted(want, key=lambda x: (x[0], x[1]))
    assert warc_round_trip(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_archives_hold_three_records_a_page_and_assemble(spark, tmp_path):
    pages = spark.createDataFrame(PAGES[:6], "page_id bigint, url string, html string")
    write_archives(pages, path := str(tmp_path / "warc"), revisit_from=3)
    records = read_archives(spark, path)
    assert {r["kind"]: r["count"] for r in records.groupBy("kind").count().collect()} == {"request": 6, "response": 5, "revisit": 1, "metadata": 6}
    nested = {r["metadata"]["page_id"]: r for r in assemble(records).collect()}
    assert bytes(nested[5]["response"]["payload"]) == PAGES[4][2].encode() and nested[1]["response"]["kind"] == "revisit"
    assert nested[1]["response"]["refers_to"] == nested[2]["capture_id"] and bytes(nested[4]["request"]["payload"]).startswith(b"GET http://d ")
    plain = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [b for _, b in parse_archive(gzip.compress(plain) + gzip.compress(plain))] == [b"abc", b"abc"]
    with pytest.raises(ValueError, match="cut off"):
        list(parse_archive(plain[:-6]))


# Chats

def test_chats_keep_the_longest_of_snapshots(spark):
    turns = {1: "ab", 2: "abc", 3: "abc", 4: "abd", 5: "x", 6: "xy", 7: "bc", 8: "a"}
    rows = [(c, n, "user" if n % 2 == 0 else "assistant", t) for c, ts in turns.items() for n, t in enumerate(ts)] + [(9, 0, None, None), (10, 0, "user", ""), (None, 0, "user", "lone"), (11, 0, "user", "s"), (11, 0, "user", "s"), (12, 5, "user", "late"), (12, 2, "user", "soon")]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("code", F.lit("clash"))
    got = {r["conv_id"]: r for r in format_chats(frame).collect()}
    assert set(got) == {2, 4, 6, 7, 9, 10, None, 11, 12}
    assert got[2]["chat"] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\nc<|im_end|>\n" and got[2]["n_turns"] == 3
    assert got[11]["n_turns"] == 2 and got[12]["chat"].index("soon") < got[12]["chat"].index("late") and got[9]["chat"] == "<|im_start|>\n<|im_end|>\n"
    assert maximal_conversations(frame.limit(0)).count() == format_chats(frame.limit(0)).count() == 0


def test_chats_run_no_python(spark):
    plan = q.op8_chat_format(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
