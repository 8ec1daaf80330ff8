"""Language identification and toxicity: exact code lengths, held-out accuracy, odd rows; the pipeline."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from branchframe.llm import language_id as lang
from branchframe.llm import queries as q
from branchframe.llm import toxicity as tox
from branchframe.llm.common import bounded_rows, slices, utf8_parts
from tests.conftest import DATA
from tests.llm.test_near_copies import brute_groups

SMALL = DATA.replace("sf0.001", "sf0.01")


def code_length(text, samples):
    fold = lambda t: bytes(lang.ORDER) + bytes(lang._FOLD[np.frombuffer(t, np.uint8)].tolist())
    seen = defaultdict(Counter)
    for t in map(fold, samples):
        for i in range(lang.ORDER, len(t)):
            for k in range(lang.ORDER + 1):
                seen[k, t[i - k : i]][t[i]] += 1
    bits, t = 0.0, fold(text)
    for i in range(lang.ORDER, len(t)):
        for k in range(lang.ORDER, -1, -1):
            after = seen.get((k, t[i - k : i]))
            if not after:
                continue
            total, kinds = sum(after.values()), len(after)
            if t[i] in after:
                bits -= math.log2(after[t[i]] / (total + kinds))
                break
            bits -= math.log2(kinds / (total + kinds))
        else:
            bits += 8
    return bits


def test_code_lengths_are_exact():
    samples = {"en": [b"the cat sat on the mat", b"that is the hat"], "fr": ["le chat est là".encode(), "été".encode()]}
    model = lang.train_on(samples)
    texts = ["the chat", "", "été the", "漢字 Q", "THE HAT 123"]
    raw, offsets = utf8_parts(pa.array(texts))
    got = model.code_lengths(raw, offsets)
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx([code_length(t.encode(), samples[x]) for x in model.languages], abs=1e-3)
    assert list(slices(np.array([0, 5, 6, 30, 31]), 6)) == [(0, 2), (2, 3), (3, 4)]


def test_languages_held_out(spark):
    got = q.op1_language_id(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.95


def test_languages_of_odd_rows(spark):
    train = [(i, t, x) for i, (t, x) in enumerate([("the cat and the dog are here", "en"), ("le chat et le chien sont ici", "fr")] * 12)]
    odd = [(100, None, "en"), (101, "", None), (102, "123 !?", None), (103, "the " * 40_000, None), (104, "漢字", None), (105, "the dog", None), (105, "the dog", None), (None, "le chien", "fr")]
    frame = spark.createDataFrame(train + odd, "doc_id bigint, text string, lang string").withColumns({"score": F.lit("clash"), "rank": F.lit(0)})
    rows = lang.identify_languages(frame).collect()
    got = {r["doc_id"]: r["lang_pred"] for r in rows}
    assert len(rows) == len(train + odd) and [got[i] for i in (100, 101, 102, 103, 105, None)] == ["und", "und", "und", "en", "en", "fr"] and got[104] in ("en", "fr")
    kept = lang.drop_unidentified(frame)
    assert kept.columns == frame.columns and sorted(str(r["doc_id"]) for r in kept.collect() if r["doc_id"] is None or r["doc_id"] >= 100) == ["103", "105", "105", "None"]
    nothing = frame.withColumn("lang", F.lit(None).cast("string"))
    assert {(r["lang_pred"], r["score"]) for r in lang.identify_languages(nothing).collect()} == {("und", 0.0)}
    assert lang.drop_unidentified(nothing).count() == len(train) + 5 and lang.identify_languages(frame.limit(0)).count() == 0


def test_windows_cover_texts_of_any_shape():
    for text in ("", " ", "a", "word " * 100, "x" * 1000, "aé" * 300 + " b " + "c" * 400):
        found = tox.windows(text.encode())
        assert bool(found) == bool(text.strip()) and all(len(w) <= 2 * tox.WINDOW + 1 for w in found)
        flat = " ".join(text.lower().split()).encode()
        assert all(w.strip() in flat for w in found) and (not flat or (flat.startswith(found[0].strip()[:8]) and flat.endswith(found[-1].strip()[-8:])))


def toxic_frames(spark, n=240):
    rng = np.random.default_rng(0)
    plain = ["".join(rng.choice(list("aeioumnrst"), 4)) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = rng.choice(plain, 80).tolist()
        if i % 3 == 0:
            for w in ("grobiwax", "zzkuffel", "plomptwig"):
                words.insert(int(rng.integers(80)), w)
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 3 == 0)))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_toxicity_held_out_and_odd_rows(spark):
    docs, labels = toxic_frames(spark)
    odd = spark.createDataFrame([(1000, None), (1001, ""), (1002, "x" * 100_000), (1003, "same words"), (1003, "same words"), (None, "no id")], "doc_id bigint, text string")
    frame = docs.unionByName(odd).withColumns({"toxic": F.lit("clash"), "score": F.lit(0)})
    rows = tox.score_toxicity(frame, labels.unionByName(spark.createDataFrame([(5, None), (None, 1)], "doc_id bigint, toxic int"))).collect()
    assert len(rows) == 246 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 1000]
    assert held and np.mean([r["predicted"] == (r["doc_id"] % 3 == 0) for r in held]) > 0.9
    kept = tox.drop_toxic(frame, labels)
    assert kept.columns == frame.columns and kept.count() < 200
    assert tox.score_toxicity(frame, labels.limit(0)).filter("predicted = 1").count() == 0 and tox.score_toxicity(frame.limit(0), labels).count() == 0


def by_definition(text, model):
    """The score of a text from its definition: windows, compressed lengths, shares over thresholds, logistic function."""
    def length(window, dictionary):
        return len(zstandard.ZstdCompressor(level=tox.LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False).compress(window))

    saved = [length(w, model.ordinary) - length(w, model.toxic) for w in tox.windows(text)]
    n = len(saved)
    over = [sum(x >= k for x in saved) for k in tox.STEPS]
    x = [0.0] * (2 * len(tox.STEPS) + 4)
    if n:
        x = [*((k / n) ** 0.5 for k in over), *(math.log(1 + k) for k in over), min(max(saved), 12) / 4, sum(saved) / n, math.log(1 + n), sum(max(k - 1, 0) for k in saved) / n]
    z = sum(w * (a - m) / s for w, a, m, s in zip(model.weights, x, model.mean, model.spread, strict=False)) + model.weights[-1]
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def test_toxicity_scores_equal_their_definition_and_are_calibrated(spark):
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect() if r["toxic"] in (0, 1)}
    fold = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in labels}
    parts = [[docs[i] for i in sorted(labels) if labels[i] == kind and not fold[i] and docs.get(i)] for kind in (1, 0)]
    model = tox.fit(*parts)
    odd = [b"", b" ", b"x" * 5000, "é stupid idiot".encode(), b"stupid worthless idiot " * 40]
    texts = [*odd, *[docs[i] for i in sorted(labels) if fold[i]][:60]]
    got = model.score(np.array([tox.features(tox.savings(t, model.ordinary, model.toxic)) for t in texts]))
    assert got == pytest.approx([by_definition(t, model) for t in texts], abs=1e-9)
    assert len(model.toxic) > len(model.ordinary) and model.toxic.endswith(model.ordinary)
    held = [(labels[i], model.score(np.array([tox.features(tox.savings(docs[i], model.ordinary, model.toxic))]))[0]) for i in sorted(labels) if fold[i] and i in docs]
    assert np.mean([(p >= 0.5) == y for y, p in held]) > 0.9
    sure = [y for y, p in held if p < 0.1]
    assert len(sure) > len(held) / 2 and np.mean(sure) < 0.15  # of those that score low few are toxic


def test_samples_are_bounded_by_bytes_and_repeats(spark):
    rows = spark.createDataFrame([(0.1, 1, b"aaaa"), (0.1, 1, b"zz"), (0.2, 2, b"bbb"), (0.3, 3, b"cc"), (0.4, 4, b"d")], "place double, id bigint, text binary")
    take = lambda most: [bytes(r["text"]) for r in bounded_rows(rows, ["place", "id"], most)]
    assert take(100) == [b"aaaa", b"bbb", b"cc", b"d"] and take(8) == [b"aaaa", b"bbb"] and take(1) == []


def test_foreign_bits_follow_the_sample():
    plain = {"en": [b"the cat sat on the mat and the dog sat on the log %d" % i for i in range(20)]}
    assert lang.foreign_bits(plain) == lang.FOREIGN_BITS and lang.foreign_bits({}) == lang.FOREIGN_BITS
    noise = {"en": [bytes(np.random.default_rng(i).integers(128, 256, 200, np.uint8)) for i in range(20)]}
    assert lang.foreign_bits(noise) > 7


def test_pipeline_stages_keep_columns_and_agree_with_operators(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    exact = dict(pipeline.STAGES)["exact_dedup"](spark, docs, DATA)
    ids = {r["doc_id"] for r in exact.collect()}
    assert exact.columns == docs.columns and ids == {r["doc_id"] for r in q.op6_exact_dedup(spark, DATA).filter("kept").collect()}
    near = dict(pipeline.STAGES)["near_dedup"](spark, docs, DATA)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    root = brute_groups(rows)
    assert {r["doc_id"] for r in near.collect()} == {min(rows[k][0] for k in range(len(rows)) if root[k] == r) for r in set(root)}
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "language", "exact_dedup", "near_dedup", "packing"]
    packed = pipeline.run(spark, DATA)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and 0 < packed.select("doc_id").distinct().count() <= len(ids)
