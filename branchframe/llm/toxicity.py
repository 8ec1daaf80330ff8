"""Toxicity by compression distance: one zstandard dictionary of ordinary text, one of toxic text.

Training uses a bounded sample of labelled documents. Zstandard trains one dictionary on windows of clean
documents, and another one on windows of toxic documents, cut tight around what these hold
significantly more often (a likelihood ratio over documents): most of a toxic document is ordinary
text. Every window of a text, about WINDOW bytes cut at white space, is compressed with the ordinary
dictionary alone and with the toxic one before it; where that saves bytes, the window resembles toxic
text. How many windows save how much, calibrated by logistic regression on sample documents that
neither dictionary saw, gives the score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from branchframe.llm.common import bounded_rows, hash_top, id_crc, small_batches, tidy_after, utf8_parts

#: Bytes of a window and of each dictionary at most; the level of compression.
WINDOW, ORDINARY_BYTES, TOXIC_BYTES, LEVEL = 72, 96 << 10, 16 << 10, 9
#: Segment and match sizes that zstandard's trainer looks for in ordinary and in toxic windows.
ORDINARY_SEGMENTS, TOXIC_SEGMENTS = (40, 6), (48, 8)
#: Bounds of the labelled sample: documents of each kind, characters of a document, bytes of each kind.
TOXIC_DOCS, CLEAN_DOCS, SAMPLE_CHARS, SAMPLE_BYTES = 1800, 4500, 16_384, 48 << 20
#: Shortest fragment in bytes; fragments that may look telling by chance, of all that are tried.
FRAGMENT, CHANCE = 4, 1.0
STEPS = (1, 2, 3, 4, 6)
_WORD = re.compile(rb"[A-Za-z0-9'\x80-\xff]+")


def windows(text: bytes) -> list[bytes]:
    """All of a text, lower-cased, in windows that share their border blanks; unbroken runs are cut with an overlap."""
    words = text.decode("utf-8", "replace").lower().encode().split()
    if not words:
        return []
    text, at, out = b" " + b" ".join(words) + b" ", 0, []
    while at < len(text) - 1:
        to = text.find(b" ", min(at + WINDOW, len(text) - 1), at + 2 * WINDOW)
        if to < 0:
            to = min(at + 2 * WINDOW, len(text) - 1)
            out.append(text[at : to + 1])
            at = to if to == len(text) - 1 else to - 16
        else:
            out.append(text[at : to + 1])
            at = to
    return out


@dataclass
class ToxicityModel:
    """Dictionaries and calibration; plain data, so that it can be sent to executors."""

    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    def score(self, features: np.ndarray) -> np.ndarray:
        x = (features - self.mean) / self.spread
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


@lru_cache(maxsize=4)
def _compressor(dictionary: bytes):
    known = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False).compress


def savings(text: bytes, ordinary: bytes, toxic: bytes) -> np.ndarray:
    """Bytes that the toxic dictionary saves in each window."""
    a, b = _compressor(ordinary), _compressor(toxic)
    return np.array([len(a(w)) - len(b(w)) for w in windows(text)], np.int64)


def features(saved: np.ndarray) -> list[float]:
    """Shares and numbers of windows by what they save, the most, the mean, and the number of windows."""
    n = len(saved)
    if not n:
        return [0.0] * (2 * len(STEPS) + 4)
    over = [int((saved >= k).sum()) for k in STEPS]
    return [*(math.sqrt(x / n) for x in over), *(math.log1p(x) for x in over), min(int(saved.max()), 12) / 4, float(saved.mean()), math.log1p(n), float(np.maximum(saved - 1, 0).mean())]


def _unlike(texts: list[bytes]) -> list[bytes]:
    """Without near copies of earlier texts, which would make any of their words telling: half of a sample of the five-word shingles seen."""
    seen: set[int] = set()
    out = []
    for text in texts:
        words = text.split()
        codes = {zlib.crc32(b" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))}
        some = {c for c in codes if c % 8 == 0} or codes
        if len(some & seen) * 2 < len(some):
            out.append(text)
        seen |= some
    return out


def _fragments(text: bytes) -> set[bytes]:
    """Words between blanks, and the beginnings of words."""
    out = set()
    for word in set(_WORD.findall(text.decode("utf-8", "replace").lower().encode())):
        out.add(b" " + word + b" ")
        out.update(b" " + word[:n] for n in range(FRAGMENT, min(len(word), 32)))
    return out


def _ratio(a: int, b: int, n: int, m: int) -> float:
    """G of a fragment in a of n toxic and b of m clean documents; negative if it is rarer in toxic ones."""
    share = (a + b) / (n + m)
    cells = ((a, n * share), (b, m * share), (n - a, n * (1 - share)), (m - b, m * (1 - share)))
    g = 2 * sum(o * math.log(o / e) for o, e in cells if o > 0 and e > 0)
    return g if a * m > b * n else -g


def telling_fragments(toxic: list[bytes], clean: list[bytes]) -> set[bytes]:
    """Fragments that toxic documents hold more often than chance explains."""
    seen: Counter = Counter()
    for text in toxic:
        seen.update(_fragments(text))
    seen = Counter({k: v for k, v in seen.items() if v >= 4})
    others: Counter = Counter()
    for text in clean:
        others.update(f for f in _fragments(text) if f in seen)
    telling = 2 * math.log(max(2.0, len(seen) / CHANCE))  # the chance of a larger G is about exp(-G / 2)
    return {f for f, a in seen.items() if _ratio(a, others[f], len(toxic), len(clean)) >= telling}


def tight_windows(texts: list[bytes], fragments: set[bytes]) -> list[bytes]:
    """Every place of a fragment in the texts, the longest fragment that stands there."""
    if not fragments:
        return []
    places = re.compile(b"|".join(map(re.escape, sorted(fragments, key=lambda f: (-len(f), f)))))
    return [m[0] for t in texts for m in places.finditer(b" " + b" ".join(t.decode("utf-8", "replace").lower().encode().split()) + b" ")]


def _dictionary(samples: list[bytes], size: int, segments: tuple[int, int]) -> bytes:
    """A dictionary that zstandard trains on the samples; too few to train on are the dictionary themselves."""
    k, d = segments
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=d, level=LEVEL).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:] or b"        "


def _ordinary(clean: list[bytes]) -> bytes:
    samples = [w for text in clean for w in windows(text)]
    return _dictionary(samples[:: max(1, len(samples) // 60_000)], ORDINARY_BYTES, ORDINARY_SEGMENTS)


def _toxic(toxic: list[bytes], clean: list[bytes]) -> bytes:
    return _dictionary(tight_windows(toxic, telling_fragments(toxic, clean)), TOXIC_BYTES, TOXIC_SEGMENTS)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    a, w = np.c_[(x - mean) / spread, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.eye(len(w)), a.T @ (p - y) + w)
    return mean, spread, w


def fit(toxic: list[bytes], clean: list[bytes]) -> ToxicityModel:
    """Two of three documents go to the dictionaries, the rest to the calibration."""
    toxic, clean = _unlike(toxic), _unlike(clean)
    mined = [[t for i, t in enumerate(x) if i % 3 != 2] for x in (toxic, clean)]
    ordinary = _ordinary(mined[1])
    both = _toxic(*mined) + ordinary
    rest = [(t, 1.0) for t in toxic[2::3]] + [(t, 0.0) for t in clean[2::3]]
    width = 2 * len(STEPS) + 4
    if not toxic[2::3] or not clean[2::3]:
        sure = 8.0 if toxic and not clean else -8.0
        return ToxicityModel(ordinary, both, np.zeros(width), np.ones(width), np.append(np.zeros(width), sure))
    x = np.array([features(savings(t, ordinary, both)) for t, _ in rest])
    return ToxicityModel(ordinary, both, *_logistic(x, np.array([y for _, y in rest])))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Fit on a bounded sample of labelled rows outside the held-out fold (crc32 of the id mod 5 is 0).

    The sample takes the rows of each label that come first by a hash of the id: TOXIC_DOCS and
    CLEAN_DOCS at most, of SAMPLE_CHARS at most, SAMPLE_BYTES of each label. Its ids are few, so they
    are broadcast.
    """
    own = labels.filter((id_crc("doc_id") % 5 != 0) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    kinds = []
    for kind, most in ((1, TOXIC_DOCS), (0, CLEAN_DOCS)):
        picked = hash_top(own.filter(F.col("toxic") == kind), "doc_id", most).withColumnRenamed("id", "label_id")
        texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(F.length("text").between(1, SAMPLE_CHARS))
        rows = texts.join(F.broadcast(picked), F.col("doc_id") == F.col("label_id")).select("place", "doc_id", F.col("text").cast("binary").alias("text"))
        kinds.append([bytes(r["text"]) for r in bounded_rows(rows, ["place", "doc_id"], SAMPLE_BYTES)][:most])
    return fit(*kinds)


_SCORES = "doc_id bigint, held_out boolean, score double, predicted int"


def _batch_scores(model: ToxicityModel, texts: pa.Array) -> np.ndarray:
    raw, offsets = utf8_parts(texts)
    whole = raw.tobytes()
    x = np.array([features(savings(whole[a:b], model.ordinary, model.toxic)) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
    return model.score(x.reshape(len(texts), -1))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= 0.5) of every row.

    ``labels`` has doc_id and toxic; labels, languages, sources and ids are no inputs of a score.
    Null and empty texts have no windows and get the score of such a text. Without labelled rows
    of both kinds every score is near 0 (or near 1 if only toxic ones are known). One row comes out
    for each row in; other columns are ignored. A null id is not held out.
    """
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(train(docs, labels, id_col, text_col))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches):
        for batch in tidy_after(batches):
            score = _batch_scores(model.value, batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], schema=schema)

    held_out = F.coalesce(id_crc(id_col) % 5 == 0, F.lit(False))
    return docs.select(F.col(id_col).cast("bigint"), held_out, F.col(text_col)).mapInArrow(run, _SCORES)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below the threshold; nothing is shuffled for it.

    Each row is decided by its own text: repeated rows and ids all stay or all go. Null and empty texts have
    the score of a text without windows, which stays if clean documents are common. A null id is no
    reason to go. Columns of any other name pass through; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(train(docs, labels, id_col, text_col))
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in tidy_after(batches):
            yield batch.filter(pa.array(_batch_scores(model.value, batch.column(at)) < threshold))

    return docs.mapInArrow(run, docs.schema)
