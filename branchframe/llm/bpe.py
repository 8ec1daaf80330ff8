"""Byte-pair encoding by a pair occurrence index, and decoding.

All distinct new words of a partition (of blocks of it, if it is large) are laid out as one linked list
of symbols. The index maps each mergeable pair to all its positions; active ranks are taken in ascending
order, all positions of a rank are merged at once, and only the lists of the pairs beside them are
updated. Word encodings are kept in a bounded table, so a word that recurs is encoded once; words are
found there by hashes and told apart by their letters. Long texts are read in segments.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from branchframe.llm.common import small_batches, tidy_after
from branchframe.llm.words import WordHashes, WordTable, code_points, dropped_space_pieces, folded, kept_space_pieces, spans

#: Code points handled together, and words kept by a worker.
CHUNK, WORDS = 1 << 18, 250_000
#: Words, letters of new words, and batches that wait at most before new words are encoded.
BLOCK, LETTERS, BATCHES = 1 << 22, 1 << 21, 64
_NEVER = np.int64(1 << 40)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + others.index(b)) for b in range(256)]


class BpeModel:
    """A byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, letters = spec["model"], byte_letters()
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.drops_space = bool(spec.get("normalizer"))
        self.joiner = b"" if spec.get("decoder") else b" "
        self.specials = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.special_pattern = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.middle = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int64)
        self.tokens = [b""] * (max([*vocab.values(), *self.specials.values()]) + 1)
        for token, i in [*vocab.items(), *self.specials.items()]:
            self.tokens[i] = token.encode()
        pairs = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        left, right, new = (np.array(x, np.int64) for x in zip(*self.pairs, strict=True))
        keys = left << 20 | right
        order = np.argsort(keys)
        self._keys, self._ranks, self.merged = keys[order], order, new

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols; a large number where they don't merge."""
        keys = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where((self._keys[at] == keys) & (a >= 0) & (b >= 0), self._ranks[at], _NEVER)

    def encode_words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (bytes data[offsets[i]:offsets[i+1]], none empty) and how many each has."""
        n, final = len(data), offsets[1:] - 1
        sym = np.empty(n + 1, np.int32)
        sym[:n] = self.middle[data]
        sym[final], sym[n] = self.last[data[final]], -1
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        after[final], before[offsets[:-1]] = n, n
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def put(at: np.ndarray) -> None:
            """Enter the pairs that begin at these positions into the index."""
            rank = self.ranks(sym[at], sym[after[at]])
            live = rank < _NEVER
            at, rank = at[live], rank[live]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            bounds = [0, *cut.tolist(), len(at)]
            for i, r in enumerate(rank[bounds[:-1]].tolist()):
                own = at[bounds[i] : bounds[i + 1]]
                if r in index:
                    index[r].append(own)
                else:
                    index[r] = [own]
                    heapq.heappush(heap, r)

        for at in range(0, n, 1 << 20):
            put(np.arange(at, min(at + (1 << 20), n), dtype=np.int32))
        while heap:
            rank = heapq.heappop(heap)
            lists = index.pop(rank)
            a, b, new = self.pairs[rank]
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            other = after[at]
            good = (sym[at] == a) & (sym[other] == b)
            if a == b and len(at) > 1:  # of overlapping pairs every second one, from the left
                at, other = at[good], other[good]
                order = np.argsort(at)
                at, other = at[order], other[order]
                linked = np.append(False, at[1:] == other[:-1])
                place = np.arange(len(at))
                good = (place - np.maximum.accumulate(np.where(linked, 0, place))) % 2 == 0
            at, other = at[good], other[good]
            if not len(at):
                continue
            beyond = after[other]
            sym[at], sym[other] = new, -2
            after[at], before[beyond] = beyond, at
            left = before[at]
            touched = np.concatenate((left[left < n], at[beyond < n]))
            put(np.unique(touched) if len(touched) > 1 else touched)
        alive = sym[:n] >= 0
        total = np.concatenate(([0], np.cumsum(alive)))
        return sym[:n][alive], total[offsets[1:]] - total[offsets[:-1]]


_BORDER = re.compile(r"(?<=\S)[ \n]")


def segments(text: str, most: int) -> list[str]:
    """A text in segments of about ``most`` characters, cut where a blank or line break ends a piece: pieces never cross it."""
    if len(text) <= most:
        return [text]
    out, at = [], 0
    while len(text) - at > most and (border := _BORDER.search(text, at + most - 1)):
        out.append(text[at : border.start()])
        at = border.start()
    return [*out, text[at:]]


@dataclass
class _Chunk:
    """Some parts of texts: the numbers of their words, or in the end their ids and how many each part has."""

    words: np.ndarray | None
    edge: np.ndarray
    ids: np.ndarray | None = None


class Encoder:
    """Encodes batches of texts. Words are numbered as they are read, and new ones encoded for many batches together.

    What is read waits until BLOCK words or LETTERS letters of new words have come, or the partition ends;
    then one pair occurrence index covers all new words. The encodings of about WORDS words are kept.
    """

    def __init__(self, path: str) -> None:
        self.model = BpeModel(path)
        self.hashes = WordHashes(CHUNK + 16)
        self._clear()

    def _clear(self) -> None:
        self.table = WordTable()
        self.ids, self.used, self.encoded = np.zeros(1 << 16, np.uint32), 0, 0
        self.first, self.count = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self.open: list[_Chunk] = []

    def _learn(self) -> None:
        """Encode all words that are new, by one index."""
        table, old = self.table, self.encoded
        size = np.diff(table.begin[old : table.size + 1])
        if not len(size):
            return
        letters = table.letters[table.begin[old] : table.begin[table.size]]
        wide = 1 + (letters >= 0x80).astype(np.int8) + (letters >= 0x800) + (letters >= 0x10000)
        ends = np.cumsum(wide, dtype=np.int64)[np.cumsum(size) - 1]
        data = np.frombuffer(letters.tobytes().decode("utf-32-le").encode(), np.uint8)
        ids, counts = self.model.encode_words(data, np.concatenate(([0], ends)))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while table.size > len(self.first):
            self.first, self.count = (np.concatenate((x, np.zeros_like(x))) for x in (self.first, self.count))
        self.ids[self.used : self.used + len(ids)] = ids
        self.count[old : table.size] = counts
        self.first[old : table.size] = self.used + np.cumsum(counts) - counts
        self.used, self.encoded = self.used + len(ids), table.size

    def _settle(self) -> None:
        """Give everything that waits its ids; forget the words if they are too many."""
        self._learn()
        for chunk in self.open:
            counts = self.count[chunk.words].astype(np.int64)
            total = np.concatenate(([0], np.cumsum(counts)))
            chunk.ids = self.ids[spans(self.first[chunk.words], counts)]
            chunk.edge, chunk.words = np.diff(total[chunk.edge]), None
        self.open = []
        if self.table.size > WORDS:
            self._clear()

    def _chunk(self, parts: list[str]) -> _Chunk:
        points, begin = code_points(parts)
        start, end = (dropped_space_pieces if self.model.drops_space else kept_space_pieces)(points)
        hashes = self.hashes if len(points) <= CHUNK + 16 else WordHashes(len(points))
        out = _Chunk(self.table.numbers(points, start, end, *hashes.of(points, start, end)), np.searchsorted(start, begin))
        self.open.append(out)
        waiting = self.table.begin[self.table.size] - self.table.begin[self.encoded]
        if waiting >= LETTERS or self.table.size > 4 * WORDS:
            self._settle()
        return out

    def _read(self, texts: list[str]) -> tuple[list[_Chunk], np.ndarray, list[tuple[int, int]]]:
        """The chunks of a batch, the text of each part, and after which parts a special token stands."""
        model, chunks, owner, marks = self.model, [], [], []
        group: list[str] = []
        held = 0
        for i, text in enumerate(texts):
            at, pieces = 0, []
            if model.special_pattern and "<" in text:
                for m in model.special_pattern.finditer(text):
                    pieces.append((text[at : m.start()], model.specials[m[0]]))
                    at = m.end()
            for piece, special in [*pieces, (text[at:] if at else text, None)]:
                for part in segments(piece, CHUNK):
                    if group and held + len(part) >= CHUNK:
                        chunks.append(self._chunk(group))
                        group, held = [], 0
                    group.append(folded(part) if model.drops_space else part)
                    held += len(part) + 1
                    owner.append(i)
                if special is not None:
                    marks.append((len(owner), special))
        if group:
            chunks.append(self._chunk(group))
        return chunks, np.array(owner, np.int64), marks

    def run(self, batches: Iterable[tuple[Any, list[str]]]) -> Iterator[tuple[Any, np.ndarray, np.ndarray]]:
        """For each (tag, texts): the tag, ids of all texts in one array, and the n + 1 offsets of the texts in it."""
        held: list[tuple] = []
        for tag, texts in batches:
            held.append((tag, len(texts), *self._read(texts)))
            if sum(len(c.words) for c in self.open) >= BLOCK or len(held) >= BATCHES:
                self._settle()
            if not self.open:
                yield from self._done(held)
                held = []
        self._settle()
        yield from self._done(held)

    def _done(self, held: list[tuple]) -> Iterator[tuple[Any, np.ndarray, np.ndarray]]:
        for tag, n, chunks, owner, marks in held:
            ids = np.concatenate([c.ids for c in chunks]) if chunks else np.empty(0, np.uint32)
            counts = np.concatenate([c.edge for c in chunks]) if chunks else np.zeros(0, np.int64)
            if marks:
                ends = np.cumsum(counts)
                ids = np.insert(ids, [ends[k - 1] for k, _ in marks], [x for _, x in marks])
                for k, _ in marks:
                    counts[k - 1] += 1
            by_text = np.zeros(n + 1, np.int64)
            np.add.at(by_text, owner + 1, counts)
            yield tag, ids, np.cumsum(by_text)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the n + 1 offsets of the texts in it."""
        return next((ids, offsets) for _, ids, offsets in self.run([(None, texts)]))

    def decoded(self, ids: np.ndarray) -> Iterator[bytes]:
        """The tokens' strings in parts, joined as the vocabulary file asks for (byte-level letters are undone by a decoder)."""
        joiner, tokens, step = self.model.joiner, self.model.tokens, 1 << 16
        if joiner:
            for at in range(0, len(ids), step):
                yield (joiner if at else b"") + joiner.join(map(tokens.__getitem__, ids[at : at + step].tolist()))
            return
        back = {c: b for b, c in enumerate(byte_letters())}
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        for at in range(0, len(ids), step):
            joined = b"".join(map(tokens.__getitem__, ids[at : at + step].tolist())).decode()
            yield decoder.decode(bytes(map(back.__getitem__, joined)), at + step >= len(ids)).encode()

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self.decoded(ids))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file."""
    return Encoder(path)


_ROUND_TRIP = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
_ROUND_TRIP_ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text: doc_id, n_tokens, ids_sha256, decoded_sha256.

    ``path`` is a vocabulary file on every executor (a parameter, never shipped). Null texts are
    empty: no tokens. Special strings in a text become their ids, as is the library's default. One
    row comes out for each row in, repeated or not; other columns are ignored.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        own = encoder(path)
        read = ((batch.column(0), [x or "" for x in batch.column(1).to_pylist()]) for batch in tidy_after(batches))
        for doc_ids, ids, offsets in own.run(read):
            ids = ids.astype("<u4", copy=False)
            codes, back = [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                codes.append(hashlib.sha256(ids[a:b]).hexdigest())
                text = hashlib.sha256()
                for part in own.decoded(ids[a:b]):
                    text.update(part)
                back.append(text.hexdigest())
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(np.diff(offsets)), pa.array(codes, pa.string()), pa.array(back, pa.string())], schema=_ROUND_TRIP_ARROW)

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(run, _ROUND_TRIP)
