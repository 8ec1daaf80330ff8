"""Whole-batch pre-tokenization: code points, classes and word boundaries as arrays.

The pieces that a tokenizer's pattern finds are computed from character classes with array
operations, not by a regular expression at each word. The classes come from the tokenizer
library's own pattern engine, so both agree on every code point.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

SPACE, LETTER, NUMBER, OTHER, BREAK = range(5)
#: Stands between texts: no text can hold a lone surrogate.
SEPARATOR = "\ud800"
_QUOTE, _BLANK = 39, 32
_ONE, _TWO = np.array([ord(c) for c in "stmd"], np.uint32), [tuple(map(ord, x)) for x in ("re", "ve", "ll")]


@cache
def classes() -> np.ndarray:
    """The class of every code point."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    out = np.full(0x110000, OTHER, np.uint8)
    patterns = [(Split(Regex(p), "removed", invert=True), kind) for p, kind in ((r"\s+", SPACE), (r"\p{L}+", LETTER), (r"\p{N}+", NUMBER))]
    for first in range(0, 0x110000, 1 << 12):
        at = np.array([c for c in range(first, first + (1 << 12)) if not 0xD800 <= c < 0xE000])
        text = "".join(map(chr, at.tolist()))
        for pattern, kind in patterns:
            for _, (a, b) in pattern.pre_tokenize_str(text) if text else ():
                out[at[a:b]] = kind
    out[0xD800:0xE000] = BREAK
    return out


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, a separator before, between and after them, and where each text begins."""
    joined = SEPARATOR + SEPARATOR.join(texts) + SEPARATOR
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    begin = np.ones(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1, out=begin[1:])
    begin[1:] += 1
    return points, begin


def _contractions(points: np.ndarray, kinds: np.ndarray, after_blank: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where 's 't 'm 'd 're 've 'll stand at the start of a piece, and how many letters each has."""
    q = np.flatnonzero(points[:-2] == _QUOTE)
    q = q[(kinds[q - 1] != OTHER) & (kinds[q + 1] == LETTER)]
    if not after_blank:
        q = q[points[q - 1] != _BLANK]
    first, second = points[q + 1], points[np.minimum(q + 2, len(points) - 1)]
    size = np.where(np.isin(first, _ONE), 1, 0)
    for a, b in _TWO:
        size[(first == a) & (second == b)] = 2
    return q[size > 0], size[size > 0]


def dropped_space_pieces(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[start, end) of the pieces of  's|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+ ; white space is dropped."""
    kinds = classes()[points]
    solid = (kinds != SPACE) & (kinds != BREAK)
    start = solid.copy()
    start[1:] &= (kinds[1:] != kinds[:-1]) | (kinds[1:] == NUMBER)
    q, size = _contractions(points, kinds, True)
    start[q + 1] = False
    start[q + 1 + size] = solid[q + 1 + size]
    end = solid[:-1] & (start[1:] | ~solid[1:])
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def kept_space_pieces(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[start, end) of the pieces of  's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ ; they cover the texts."""
    kinds = classes()[points]
    start = np.ones(len(points), bool)
    start[1:] = kinds[1:] != kinds[:-1]
    run = np.flatnonzero(start)
    solid = run[(kinds[run] != SPACE) & (kinds[run] != BREAK)]
    spaced = solid[kinds[solid - 1] == SPACE]  # the last white space before a run: part of it if a blank, else alone
    start[spaced - 1] = True
    start[spaced[points[spaced - 1] == _BLANK]] = False
    q, size = _contractions(points, kinds, False)
    start[q + 1] = False
    start[q + 1 + size] = True
    at = np.flatnonzero(start)
    ends = np.append(at[1:], len(points))
    real = kinds[at] != BREAK
    return at[real], ends[real]


def folded(text: str) -> str:
    """NFC and lower case as the tokenizer library has them: each character by itself (no final sigma)."""
    if not text.isascii():
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if "Σ" in text:
            text = text.replace("Σ", "σ")
    return text.lower()


class WordHashes:
    """Two 64-bit polynomial hashes of any [start, end) of an array of code points; different words may share both."""

    def __init__(self, longest: int) -> None:
        self.power, self.inverse = [], []
        for base in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03):
            inverse = pow(base, -1, 1 << 64)
            for out, b in ((self.power, base), (self.inverse, inverse)):
                steps = np.full(longest + 1, b, np.uint64)
                steps[0] = 1
                out.append(np.multiply.accumulate(steps))

    def of(self, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = points.astype(np.uint64) + np.uint64(1)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(32)
        found = []
        for power, inverse in zip(self.power, self.inverse, strict=True):
            total = np.zeros(len(x) + 1, np.uint64)
            np.cumsum(x * power[: len(x)], out=total[1:])
            h = (total[end] - total[start]) * inverse[start]
            found.append(h ^ (h >> np.uint64(31)))
        return found[0] | np.uint64(1), found[1]


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the spans [start, start + size), one after the other."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


class WordTable:
    """Distinct words, numbered as they come: found by a pair of hashes, told apart by their letters.

    Words whose hashes are another word's are kept by their letters alone, so numbers don't depend on hashes.
    """

    def __init__(self, bits: int = 12) -> None:
        self.letters, self.begin, self.size = np.zeros(1 << 14, np.uint32), np.zeros(1 << 12, np.int64), 0
        self.odd: dict[bytes, int] = {}
        self._slots(bits)

    def _slots(self, bits: int) -> None:
        self.mask, self.used = np.uint64((1 << bits) - 1), 0
        self.key, self.check, self.value = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def _find(self, h: np.ndarray, check: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int32)
        rest, slot = np.arange(len(h)), (h >> np.uint64(20)) & self.mask
        while len(rest):
            key = self.key[slot]
            hit = (key == h[rest]) & (self.check[slot] == check[rest])
            out[rest[hit]] = self.value[slot[hit]]
            on = ~hit & (key != 0)
            rest, slot = rest[on], (slot[on] + np.uint64(1)) & self.mask
        return out

    def _enter(self, h: np.ndarray, check: np.ndarray, value: np.ndarray) -> None:
        """Distinct pairs of hashes that aren't there; the slots double while over half are taken."""
        bits = int(self.mask).bit_length()
        if 2 * (self.used + len(h)) > 1 << bits:
            there = np.flatnonzero(self.key)
            h, check, value = (np.concatenate((old[there], new)) for old, new in ((self.key, h), (self.check, check), (self.value, value)))
            self._slots(max(bits + 1, (2 * len(h)).bit_length()))
        rest, slot = np.arange(len(h)), (h >> np.uint64(20)) & self.mask
        while len(rest):
            free = np.flatnonzero(self.key[slot] == 0)
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.key[slot[won]], self.check[slot[won]], self.value[slot[won]] = h[rest[won]], check[rest[won]], value[rest[won]]
            on = np.ones(len(rest), bool)
            on[won] = False
            rest, slot = rest[on], (slot[on] + np.uint64(1)) & self.mask
        self.used += len(h)

    def _append(self, letters: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Numbers of new words, whose letters are kept."""
        at, upto = self.begin[self.size], self.begin[self.size] + len(letters)
        while upto > len(self.letters):
            self.letters = np.concatenate((self.letters, np.zeros_like(self.letters)))
        while self.size + len(sizes) >= len(self.begin):
            self.begin = np.concatenate((self.begin, np.zeros_like(self.begin)))
        self.letters[at:upto] = letters
        numbers = np.arange(self.size, self.size + len(sizes), dtype=np.int32)
        self.begin[numbers + 1] = at + np.cumsum(sizes)
        self.size += len(sizes)
        return numbers

    def _unlike(self, points: np.ndarray, start: np.ndarray, size: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Which of the words have other letters than the words of their numbers."""
        out = self.begin[word + 1] - self.begin[word] != size
        same = np.flatnonzero(~out)
        n = size[same]
        wrong = points[spans(start[same], n)] != self.letters[spans(self.begin[word[same]], n)]
        if wrong.any():
            out[np.repeat(same, n)[wrong]] = True
        return out

    def numbers(self, points: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The number of each word points[start:end]; words not seen before get the next ones."""
        size, out = end - start, self._find(h, check)
        known, new = np.flatnonzero(out >= 0), np.flatnonzero(out < 0)
        odd = known[self._unlike(points, start[known], size[known], out[known])]
        if len(new):
            _, first = np.unique(np.stack((h[new], check[new]), axis=1).view("V16").ravel(), return_index=True)
            fresh = new[first]
            self._enter(h[fresh], check[fresh], self._append(points[spans(start[fresh], size[fresh])], size[fresh]))
            out[new] = self._find(h[new], check[new])
            odd = np.concatenate((odd, new[self._unlike(points, start[new], size[new], out[new])]))
        for i in odd.tolist():
            letters = points[start[i] : end[i]]
            word = letters.tobytes()
            if word not in self.odd:
                self.odd[word] = int(self._append(letters, size[i : i + 1])[0])
            out[i] = self.odd[word]
        return out
