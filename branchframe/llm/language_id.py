"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of bytes up to ORDER deep, from a bounded sample of labelled texts.
The statistics are frozen: a byte seen c times after a context that was seen t times, with d
different bytes after it, has probability c / (t + d); another byte escapes with d / (t + d) to the
next shorter context (method C), and below the empty context all 256 bytes are equal. The sum of
-log2 of these probabilities is the exact code length of a text under a language; the shortest wins,
and the score is its posterior probability under equal priors.

The trees of all languages are flattened into one table for each order: the (context, byte) pairs
that any language has seen, with the finished code length in every language, escapes included. A
batch looks all its bytes up in the longest order, and what isn't there in the next shorter one.
"""

from __future__ import annotations

import pickle
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from branchframe.llm.common import bounded_rows, hash_sample, id_crc, slices, small_batches, tidy_after, utf8_parts

#: Bytes of context; bounds of the sample: documents of a language, characters of a document, languages, documents and bytes in all.
ORDER, SAMPLE_DOCS, SAMPLE_CHARS, LANGUAGES, SAMPLE_ALL, SAMPLE_BYTES = 4, 400, 16_384, 400, 8_000, 64 << 20
UNKNOWN = "und"
#: A text is in none of the learned languages if it takes FOREIGN_BITS bits a byte (no model makes it shorter than it is) and
#: FOREIGN_MARGIN more than any labelled text of FOREIGN_BYTES or more took under models of other sample texts.
FOREIGN_BITS, FOREIGN_MARGIN, FOREIGN_BYTES = 8.0, 1.0, 32
_BATCH = 1 << 18


def _fold_table() -> np.ndarray:
    """Bytes as the models see them: ASCII letters in lower case, other ASCII as blanks, the rest as they are."""
    out = np.arange(256, dtype=np.uint8)
    out[:128] = 32
    out[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
    out[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
    return out


_FOLD = _fold_table()
_LETTER = np.isin(_FOLD, np.arange(ord("a"), ord("z") + 1)).astype(np.int64)


def padded(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes with ORDER zeros before each text, and the place of every byte of a text among them."""
    sizes = np.diff(offsets)
    at = np.arange(len(raw)) + ORDER * np.repeat(np.arange(1, len(sizes) + 1), sizes)
    out = np.zeros(len(raw) + ORDER * (len(sizes) + 1), np.uint8)
    out[at] = _FOLD[raw]
    return out, at


def grams(folded: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` bytes that end at each place, as one number."""
    out = folded[at].astype(np.uint64)
    for back in range(1, size):
        out |= folded[at - back].astype(np.uint64) << np.uint64(8 * back)
    return out


class _Table:
    """Numbers to rows, by open addressing; the keys are distinct."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.slots, self.rows = np.full(1 << self.bits, ~np.uint64(0)), np.zeros(1 << self.bits, np.int32)
        rest, slot = np.arange(len(keys)), self._slot(keys)
        while len(rest):
            free = np.flatnonzero(self.slots[slot] == ~np.uint64(0))
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.slots[slot[won]], self.rows[slot[won]] = keys[rest[won]], rest[won]
            on = np.ones(len(rest), bool)
            on[won] = False
            rest, slot = rest[on], self._next(slot[on])

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def _next(self, slot: np.ndarray) -> np.ndarray:
        return (slot + np.uint64(1)) & np.uint64((1 << self.bits) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where there is none."""
        slot = self._slot(keys)
        found = self.slots[slot]
        out = np.where(found == keys, self.rows[slot], -1)
        rest = np.flatnonzero((found != keys) & (found != ~np.uint64(0)))
        slot = self._next(slot[rest])
        while len(rest):
            found = self.slots[slot]
            hit = found == keys[rest]
            out[rest[hit]] = self.rows[slot[hit]]
            on = ~hit & (found != ~np.uint64(0))
            rest, slot = rest[on], self._next(slot[on])
        return out


@dataclass
class LanguageModel:
    """Per order: the pairs seen by any language with code lengths [pairs, languages], and the escapes of contexts."""

    languages: list[str]
    pairs: list[np.ndarray]
    lengths: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]
    foreign: float = FOREIGN_BITS

    def __post_init__(self) -> None:
        self._tables: list | None = None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_tables"} | {"_tables": None}

    def _lookup(self) -> list:
        if self._tables is None:
            self._tables = [(_Table(p), _Table(c)) for p, c in zip(self.pairs, self.contexts, strict=True)]
        return self._tables

    def byte_lengths(self, folded: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Code length in bits of each byte under each language."""
        out = np.zeros((len(at), len(self.languages)), np.float32)
        full = grams(folded, at, ORDER + 1)
        rest = np.arange(len(at))
        for order in range(ORDER, -1, -1):
            pairs, contexts = self._lookup()[order]
            key = full[rest] & np.uint64((1 << 8 * (order + 1)) - 1)
            row = pairs.find(key)
            hit = row >= 0
            out[rest[hit]] += self.lengths[order][row[hit]]
            rest, key = rest[~hit], key[~hit]
            if not len(rest):
                return out
            row = contexts.find(key >> np.uint64(8))
            seen = row >= 0
            out[rest[seen]] += self.escapes[order][row[seen]]
        out[rest] += np.float32(8.0)
        return out

    def code_lengths(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length in bits of each text under each language."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        for i, j in slices(offsets, _BATCH):
            own = offsets[i : j + 1] - offsets[i]
            folded, at = padded(raw[offsets[i] : offsets[j]], own)
            owner = np.repeat(np.arange(i, j), np.diff(own))
            for a in range(0, len(at), _BATCH):
                bits = self.byte_lengths(folded, at[a : a + _BATCH])
                who = owner[a : a + _BATCH]
                if len(who):
                    first = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
                    out[who[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.float64)
        return out


def train_on(samples: dict[str, list[bytes]]) -> LanguageModel:
    """The frozen statistics of each language's texts."""
    languages = sorted(samples)
    counts: list[list[tuple[np.ndarray, np.ndarray]]] = []
    for language in languages:
        texts = samples[language]
        raw = np.frombuffer(b"".join(texts), np.uint8)
        folded, at = padded(raw, np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64))
        full = grams(folded, at, ORDER + 1)
        counts.append([np.unique(full & np.uint64((1 << 8 * (k + 1)) - 1), return_counts=True) for k in range(ORDER + 1)])
    pairs, lengths, contexts, escapes = [], [], [], []
    for k in range(ORDER + 1):
        keys = np.unique(np.concatenate([c[k][0] for c in counts])) if counts else np.empty(0, np.uint64)
        over = np.unique(keys >> np.uint64(8))
        length, escape = np.zeros((len(keys), len(languages))), np.zeros((len(over), len(languages)))
        for x, language_counts in enumerate(counts):
            own, n = language_counts[k]
            place = np.searchsorted(over, own >> np.uint64(8))
            total = np.bincount(place, n, len(over))
            kinds = np.bincount(place, minlength=len(over))
            known = total > 0
            escape[known, x] = -np.log2(kinds[known] / (total + kinds)[known])
            row = np.searchsorted(keys, own)
            if k:
                shorter = lengths[k - 1][np.searchsorted(pairs[k - 1], keys & np.uint64((1 << 8 * k) - 1)), x]
            else:
                shorter = np.full(len(keys), 8.0)
            length[:, x] = escape[np.searchsorted(over, keys >> np.uint64(8)), x] + shorter
            length[row, x] = -np.log2(n / (total + kinds)[place])
        pairs.append(keys)
        lengths.append(length)
        contexts.append(over)
        escapes.append(escape)
    return LanguageModel(languages, pairs, [x.astype(np.float32) for x in lengths], contexts, [x.astype(np.float32) for x in escapes])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fit on a bounded sample of rows with a language, outside the held-out fold (crc32 of the id mod 4 is 2).

    Of each language the SAMPLE_DOCS rows that come first by a hash of the id, of SAMPLE_CHARS at most;
    with many languages fewer of each, SAMPLE_ALL together, of SAMPLE_BYTES together.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    own = own.filter((id_crc("doc_id") % 4 != 2) & F.col("lang").isNotNull() & (F.length("text").between(1, SAMPLE_CHARS)))
    picked = hash_sample(own, "lang", "doc_id", SAMPLE_DOCS, LANGUAGES).groupBy(F.col("id").alias("picked_id")).agg(F.min("rank").alias("rank"))
    picked = picked.orderBy("rank", "picked_id").limit(SAMPLE_ALL)
    samples: dict[str, list] = {}
    rows = own.join(F.broadcast(picked), own["doc_id"] == picked["picked_id"]).select("lang", "rank", "picked_id", F.col("text").cast("binary").alias("text"))
    for row in bounded_rows(rows, ["rank", "picked_id", "lang"], SAMPLE_BYTES):
        samples.setdefault(row["lang"], []).append(bytes(row["text"]))
    samples = {k: v[:SAMPLE_DOCS] for k, v in samples.items()}
    model = train_on(samples)
    model.foreign = foreign_bits(samples)
    return model


def foreign_bits(samples: dict[str, list[bytes]]) -> float:
    """Bits a byte from which a text is foreign, from each half of the sample under the models of the other."""
    most = FOREIGN_BITS - FOREIGN_MARGIN
    for half in range(2):
        known, rest = ({k: [t for i, t in enumerate(v) if i % 2 == (half ^ side)] for k, v in samples.items()} for side in range(2))
        texts = [t for v in rest.values() for t in v if len(t) >= FOREIGN_BYTES]
        if texts and any(known.values()):
            sizes = np.array([len(t) for t in texts], np.int64)
            bits = train_on({k: v for k, v in known.items() if v}).code_lengths(np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum(sizes))))
            most = max(most, float((bits.min(axis=1) / sizes).max()))
    return most + FOREIGN_MARGIN


def predict(model: LanguageModel, raw: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, posterior probability, and bits a byte under the best language of each text."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    ascii_letters = np.concatenate(([0], np.cumsum(_LETTER[raw])))
    letters = ascii_letters[offsets[1:]] - ascii_letters[offsets[:-1]] > 0
    for i in np.flatnonzero(~letters & (sizes > 0)):
        letters[i] = any(map(str.isalpha, raw[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")))
    if not model.languages:
        return [UNKNOWN] * n, np.zeros(n), np.zeros(n)
    bits = model.code_lengths(raw, offsets)
    best = bits.argmin(axis=1)
    shortest = bits[np.arange(n), best]
    score = 1 / np.exp2(np.maximum(shortest[:, None] - bits, -1000)).sum(axis=1)
    found = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
    return found, np.where(letters, score, 0.0), shortest / np.maximum(sizes, 1)


@lru_cache(maxsize=1)
def _unpacked(packed: bytes) -> LanguageModel:
    """A worker's one model at a time; what was broadcast stays small."""
    return pickle.loads(zlib.decompress(packed))  # noqa: S301  our own bytes


_PREDICTIONS = "doc_id bigint, held_out boolean, lang_pred string, score double, bits_per_byte double"


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_byte of every row.

    Languages are learned from ``lang_col`` of rows outside the held-out fold; a prediction reads the
    whole text only. Null texts and texts without any letter are ``und`` with score 0, as is everything
    if no language can be learned; ties go to the language that sorts first. One row comes out for
    each row in; other columns are ignored. A null id is neither learned from nor held out.
    """
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(zlib.compress(pickle.dumps(train(docs, id_col, text_col, lang_col)), 1))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])

    def run(batches):
        own = _unpacked(model.value)
        for batch in tidy_after(batches):
            languages, score, bits = predict(own, *utf8_parts(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(languages, pa.string()), pa.array(score), pa.array(bits)], schema=schema)

    held_out = F.coalesce(id_crc(id_col) % 4 == 2, F.lit(False))
    return docs.select(F.col(id_col).cast("bigint"), held_out, F.col(text_col)).mapInArrow(run, _PREDICTIONS)


def drop_unidentified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, all columns, whose text is in a learned language.

    Null texts, texts without a letter, and texts that take as many bits a byte under every language as
    foreign text does (foreign_bits()) go. If no language can be learned, all rows stay that have a letter.
    Each row is decided by its own text: repeated rows and ids all stay or all go, null ids too. Columns of
    any other name pass through; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(zlib.compress(pickle.dumps(train(docs, id_col, text_col, lang_col)), 1))
    at = docs.columns.index(text_col)

    def run(batches):
        own = _unpacked(model.value)
        for batch in tidy_after(batches):
            languages, _, bits = predict(own, *utf8_parts(batch.column(at)))
            unknown = [x == UNKNOWN for x in languages]
            if not own.languages:
                unknown = [not any(map(str.isalpha, x or "")) for x in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(~np.array(unknown, bool) & (bits < own.foreign)))

    return docs.mapInArrow(run, docs.schema)
