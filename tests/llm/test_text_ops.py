"""Token counts, BPE round trips and packing against the tokenizers library; edge cases of each."""

import hashlib
import random
import subprocess
import sys
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from branchframe.llm import bpe
from branchframe.llm import token_counts as token_counts_module
from branchframe.llm.bpe import Encoder, bpe_round_trip, encoder
from branchframe.llm.packing import best_fit_decreasing, cut, lower_bound, pack
from branchframe.llm.token_counts import CountTransducer, count_tokens, scan, token_counts
from branchframe.llm.words import WordHashes
from tests.conftest import DATA

WORD, BYTE = (str(public_tokenizers.path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = [
    "", "a", "  ", "'s", "it's 're'll", "x 's y", " 'tis", "''s", "a\n\nb  c \n d", "<|endoftext|>", "a<|endoftext|> b<|startoftext|>c", "ΑΣ ΣΑΣ", "İstanbul", "éé é", "123 4567 ½",
    "aaaaaaaaaa aaaa", "😀😀 x😀", "漢字かな交じり", "a'sword 'dog'", "\ttab\t\ttabs", "end  ", "don't've", "\x1c\x1dq", "ﬁ ǅ ŉ", "...!!!???'s..'t", "1's2't", "x" * 3000 + "é" * 500, "ab" * 9000 + "!?" * 500,
]


def random_texts(n):
    rnd = random.Random(7)
    return ["".join(rnd.choice("ab 's\n\t'tréI<>|.9١é漢😀́ ") for _ in range(rnd.randint(1, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(i, t) for i, t in enumerate([*ODD, *random_texts(200)])] + [(900, None), (901, "same"), (901, "same"), (None, "no id")]
    return spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"n_tokens": F.lit("clash"), "piece": F.lit(1), "row": F.lit(2)})


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encoding_equals_the_library(path):
    library, own = Tokenizer.from_file(path), encoder(path)
    texts = [*ODD, *random_texts(800)]
    ids, at = own.encode(texts)
    for i, text in enumerate(texts):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids[at[i] : at[i + 1]].tolist() == want
        assert own.decode(ids[at[i] : at[i + 1]]).decode() == library.decode(want, skip_special_tokens=False)


def test_counts_equal_the_library():
    library, texts = Tokenizer.from_file(WORD), [*ODD, *random_texts(800)]
    assert count_tokens(WORD, texts).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_counts_and_round_trip_of_odd_rows(frame):
    library = Tokenizer.from_file(WORD)
    want = sorted((str(r["doc_id"]), len(library.encode(r["text"] or "", add_special_tokens=False).ids), len((r["text"] or "").encode())) for r in frame.collect())
    counted = token_counts(frame, WORD, limit=100).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_bytes"]) for r in counted) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 100) for r in counted)
    turned = bpe_round_trip(frame, WORD).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in turned) == [x[:2] for x in want]
    texts = {str(r["doc_id"]): r["text"] or "" for r in frame.collect()}
    for r in turned:
        ids = library.encode(texts[str(r["doc_id"])], add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    null = next(r for r in turned if r["doc_id"] == 900)
    assert (null["ids_sha256"], null["decoded_sha256"]) == (hashlib.sha256(b"").hexdigest(),) * 2


def thue_morse(n):
    """Two words of a and b that no polynomial hash modulo a power of two tells apart."""
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return [word, word.translate(str.maketrans("ab", "ba"))]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_words_with_equal_hashes_keep_their_own_ids(path):
    library, pair = Tokenizer.from_file(path), thue_morse(1024)
    points = np.array([list(map(ord, w)) for w in pair], np.uint32)
    hashes = WordHashes(2048)
    found = [hashes.of(p, np.array([0]), np.array([1024])) for p in points]
    assert found[0] == found[1]
    for words in (pair, pair[::-1]):
        own = Encoder(path)
        for texts in ([*words, *words], [words[1]], [" ".join([*words, "x", *words])]):
            ids, at = own.encode(texts)
            for i, text in enumerate(texts):
                assert ids[at[i] : at[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids


def test_words_wait_for_each_other_and_are_forgotten(monkeypatch):
    library, texts = Tokenizer.from_file(BYTE), [*ODD, *random_texts(400)]
    for block, letters, words in ((1, 1, 1), (50, 200, 40), (1 << 22, 1 << 21, 100)):
        for name, value in (("BLOCK", block), ("LETTERS", letters), ("WORDS", words), ("CHUNK", 300)):
            monkeypatch.setattr(bpe, name, value)
        got = [(tag, ids.tolist(), at.tolist()) for tag, ids, at in Encoder(BYTE).run((i, texts[i : i + 30]) for i in range(0, len(texts), 30))]
        assert [tag for tag, _, _ in got] == list(range(0, len(texts), 30))
        for tag, ids, at in got:
            for i, text in enumerate(texts[tag : tag + 30]):
                assert ids[at[i] : at[i + 1]] == library.encode(text, add_special_tokens=False).ids


def test_long_texts_are_cut_between_pieces():
    rnd = random.Random(11)
    for path in (WORD, BYTE):
        library = Tokenizer.from_file(path)
        for _ in range(200):
            text = "".join(rnd.choice(["a", "'s", " ", " ", "\n", "\t", "é", "e\u0301", "9", "!", "\x1c", "\u00a0", "Σ", "word"]) for _ in range(80))
            parts = bpe.segments(text, 7)
            assert "".join(parts) == text and sum((library.encode(x, add_special_tokens=False).ids for x in parts), []) == library.encode(text, add_special_tokens=False).ids


def test_a_long_text_takes_bounded_memory():
    code = f"""
import resource, sys
from branchframe.llm import bpe, token_counts
text = "the quick brown fox jumps over " * 650_000
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
ids, at = bpe.encoder({WORD!r}).encode([text])
n = token_counts.count_tokens({WORD!r}, [text])[0]
assert len(ids) == n > 3_000_000, (len(ids), n)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, check=True)
    assert int(out.stdout) < 400  # megabytes, for 20 MB of text


def test_scan_of_state_maps_equals_a_serial_run():
    rng = np.random.default_rng(12)
    for _ in range(100):
        n, states = int(rng.integers(1, 30)), int(rng.integers(1, 6))
        maps, constant = rng.integers(0, states, (n, states)), rng.random(n) < 0.3
        maps[constant] = maps[constant][:, :1]
        entry, now = int(rng.integers(states)), []
        for i in range(n):
            now.append(entry if i == 0 else int(maps[i - 1][now[-1]]))
        lane, state = np.divmod(rng.permutation(n * states), states)
        assert scan(lane, state, maps[lane, state], constant, entry).tolist() == now


def test_composition_of_state_maps_is_associative():
    model = CountTransducer(bpe.BpeModel(WORD))
    rnd = random.Random(13)
    for _ in range(20):
        a, b, c = ([rnd.choice(b"etaoinshr") for _ in range(rnd.randint(1, 30))] for _ in range(3))
        run = lambda symbols, s: [s := model._step(s, x)[0] for x in symbols][-1]
        for s in {0, run(a, 0), run(b, 0), run(c, 0)}:
            assert run(c, run(b, run(a, s))) == run(b + c, run(a, s)) == run(c, run(a + b, s)) == run(a + b + c, s)


def test_words_without_end_pass_through_chunks_and_blocks(monkeypatch):
    library, rnd = Tokenizer.from_file(WORD), random.Random(14)
    texts = ["a" * 900 + " b", "ab" * 700, "".join(rnd.choice("abcdefghi") for _ in range(3000)), "".join(rnd.choice(["the", "ing", "er", " "]) for _ in range(1500)), "x" * 4000]
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    for steps in (5, 16, 192):
        for name, value in (("STEPS", steps), ("BLOCK", steps * 8), ("STATES", 500)):
            monkeypatch.setattr(token_counts_module, name, value)
        token_counts_module._worker.cache_clear()
        assert count_tokens(WORD, texts).tolist() == want and count_tokens(WORD, texts[::-1]).tolist() == want[::-1]
        assert len(token_counts_module._worker(WORD)[1].states) <= 500 + steps * 8 + 1
    token_counts_module._worker.cache_clear()


def test_empty_tables(frame):
    none = frame.limit(0)
    assert token_counts(none, WORD).count() == bpe_round_trip(none, WORD).count() == pack(none, BYTE).count() == 0


def check_packing(rows, ids_of, capacity):
    docs, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        place = 0
        for offset, length in sorted(own):
            assert offset == place
            place += length
        assert place <= capacity
    for doc, ids in ids_of.items():
        own = sorted(docs[doc], key=lambda r: r["piece"])
        assert [r["start"] for r in own] == [s for s, _ in cut(len(ids), capacity)]
        assert all(r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in own)
    return len(bins)


def test_packing_places_every_token(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    library = Tokenizer.from_file(BYTE)
    ids_of = {r["doc_id"]: [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    n = check_packing(pack(docs, BYTE).collect(), ids_of, 2048)
    assert n <= -(-sum(map(len, ids_of.values())) // 2048) + 1


def test_packing_of_odd_rows(frame):
    library = Tokenizer.from_file(BYTE)
    once = frame.filter("doc_id is not null and doc_id <> 901")
    ids_of = {r["doc_id"]: [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in once.collect()}
    check_packing(pack(once, BYTE, capacity=64).collect(), ids_of, 64)
    twice = pack(frame.filter("doc_id = 901"), BYTE).collect()
    assert len(twice) == 2 and twice[0]["offset"] != twice[1]["offset"]


def test_repacking_in_many_partitions(spark, monkeypatch):
    from branchframe.llm import packing

    monkeypatch.setattr(packing, "PARTITION", 40)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    library = Tokenizer.from_file(BYTE)
    ids_of = {r["doc_id"]: [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    assert check_packing(pack(docs, BYTE).collect(), ids_of, 2048) <= -(-sum(map(len, ids_of.values())) // 2048) + 8


def test_last_bins_of_certified_partitions_meet(spark, monkeypatch):
    from branchframe.llm import packing

    monkeypatch.setattr(packing, "PARTITION", 200)
    docs = spark.range(1000).select("id", F.lit(None).cast("string").alias("text")).withColumnRenamed("id", "doc_id")
    assert check_packing(pack(docs, BYTE, capacity=64).collect(), {i: [0] for i in range(1000)}, 64) == -(-1000 // 64)


def test_bounds_and_best_fit():
    rng = np.random.default_rng(5)
    for _ in range(60):
        lengths = rng.integers(1, 101, rng.integers(1, 60))
        bins, offsets, fill = best_fit_decreasing(lengths, 100)
        assert fill.max() <= 100 and lower_bound(lengths, 100) <= len(fill) and fill.sum() == lengths.sum()
        assert all(offsets[i] + lengths[i] <= 100 for i in range(len(lengths))) and bins.max() + 1 == len(fill)
    assert lower_bound(np.array([51] * 7), 100) == 7 and lower_bound(np.array([34] * 6), 100) == 3 and lower_bound(np.empty(0, np.int64), 100) == 0
    assert cut(1, 8) == [(0, 1)] and cut(8, 8) == [(0, 8)] and cut(17, 8) == [(0, 1), (1, 8), (9, 8)] and cut(16, 8) == [(0, 8), (8, 8)]
