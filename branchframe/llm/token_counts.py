"""Token counts by a finite-state transducer compiled from a byte-pair vocabulary.

The encoding of a prefix of a word ends in one certain token, and a token t may follow a prefix
whose last token is s exactly if the pair (s, t) encodes to itself. So after any prefix it is enough
to know, for the places that a vocabulary entry could still span, the last token and the number of
tokens there: a finite state. A transition reads one byte (marked if it ends its word), is
annotated with the tokens it adds (which may be negative, when a longer token forms), and returns
to the start state after a word's last byte. States are determinised on demand, as lazy automata
are, and kept by each worker up to a bound.

A batch is cut into chunks of equal length that are run in lock step, one array operation for each
step. A chunk's state map is constant if a word ends in it, whatever state it is entered in, so the
bodies run first; other chunks' maps are tables. A prefix scan composes the maps, which gives every
chunk's entry state, and then the heads run. Long texts are read in segments.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from branchframe.llm.bpe import BpeModel, segments
from branchframe.llm.common import row_sums, small_batches, tidy_after
from branchframe.llm.words import code_points, dropped_space_pieces, folded, spans

#: Steps of a chunk, code points handled together, states kept by a worker, symbols after which states may be forgotten.
STEPS, CHUNK, STATES = 192, 1 << 18, 70_000
BLOCK = STEPS * 1024
END = 256


class CountTransducer:
    """From bytes with word-end marks (byte + 256) to changes in the number of tokens."""

    def __init__(self, model: BpeModel) -> None:
        self.base = [*model.middle.tolist(), *model.last.tolist()]
        self.rules = {(a, b): (rank, new) for rank, (a, b, new) in enumerate(model.pairs)}
        text = {token: chr(symbol) for symbol, token in enumerate(self.base)}
        for a, b, new in model.pairs:
            text[new] = text[a] + text[b]
        self.tokens = {s: i for i, s in text.items() if self._merge(s) == [i]}
        self.text = text
        self.prefixes = {s[:i] for s in self.tokens for i in range(len(s) + 1)}
        self._fits: dict[tuple[int, int], bool] = {}
        self._clear()

    def _clear(self) -> None:
        self.states, self.ids = [("", (-1,), (0,))], {("", (-1,), (0,)): 0}
        self.column, self.columns = np.zeros(2 * END, np.int64), 0
        self.known = np.zeros(2 * END, bool)
        self.moves = np.full((1 << 10, 64), -1, np.int32)  # next state * 256 + change + 128

    def _merge(self, symbols: str) -> list[int]:
        """Byte-pair encoding by definition: the lowest rank first, from the left."""
        ids = [self.base[ord(c)] for c in symbols]
        while len(ids) > 1:
            rank, at = min((self.rules.get(pair, (1 << 40,))[0], i) for i, pair in enumerate(zip(ids, ids[1:], strict=False)))
            if rank == 1 << 40:
                break
            ids[at : at + 2] = [self.rules[ids[at], ids[at + 1]][1]]
        return ids

    def _follows(self, a: int, b: int) -> bool:
        if (a, b) not in self._fits:
            if len(self._fits) > 2_000_000:
                self._fits.clear()
            self._fits[a, b] = self._merge(self.text[a] + self.text[b]) == [a, b]
        return self._fits[a, b]

    def _step(self, state: int, symbol: int) -> tuple[int, int]:
        """The state after a symbol, and the change in the number of tokens."""
        seen, last, count = self.states[state]
        seen += chr(symbol)
        for size in range(len(seen), 0, -1):
            token, before = self.tokens.get(seen[-size:]), last[len(last) - size]
            if token is not None and (before == -1 or self._follows(before, token)):
                break
        change = count[len(count) - size] + 1
        if symbol >= END:
            return 0, change
        keep = next(i for i in range(len(seen) + 1) if seen[i:] in self.prefixes)
        seen, width = seen[keep:], len(seen) - keep + 1
        open_at = [seen[i:] in self.prefixes for i in range(width)]  # places that no entry can span any more don't tell states apart
        key = (
            seen,
            tuple(x if o else -2 for x, o in zip((*last, token)[-width:], open_at, strict=True)),
            tuple(c - change if o else 0 for c, o in zip((*count, change)[-width:], open_at, strict=True)),
        )
        return self._number(key), change

    def _number(self, key: tuple) -> int:
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
        return self.ids[key]

    def _compile(self, states: np.ndarray, symbols: np.ndarray) -> None:
        for state, symbol in {(int(a), int(b)) for a, b in zip(states, symbols, strict=True)}:
            to, change = self._step(state, symbol)
            if len(self.states) > len(self.moves):
                self.moves = np.concatenate((self.moves, np.full((len(self.moves) // 4, self.moves.shape[1]), -1, np.int32)))
            self.moves[state, self.column[symbol]] = to * 256 + change + 128

    def _advance(self, state: np.ndarray, symbols: np.ndarray, column: np.ndarray) -> np.ndarray:
        """The moves of all lanes, packed; unknown ones are compiled first."""
        move = self.moves.ravel().take(state * self.moves.shape[1] + column)
        if move.min(initial=0) < 0:
            missing = np.flatnonzero(move < 0)
            self._compile(state[missing], symbols[missing])
            move = self.moves.ravel().take(state * self.moves.shape[1] + column)
        return move

    def _columns(self, symbols: np.ndarray) -> None:
        used = np.unique(symbols)
        fresh = used[~self.known[used]]
        self.column[fresh], self.known[fresh] = self.columns + np.arange(len(fresh)), True
        self.columns += len(fresh)
        while self.columns > self.moves.shape[1]:
            self.moves = np.concatenate((self.moves, np.full((len(self.moves), 32), -1, np.int32)), axis=1)

    def changes(self, symbols: np.ndarray) -> np.ndarray:
        """The annotation of every transition that the symbols take; the last one must be a word end.

        Blocks follow each other, so that states can be forgotten between them: all but the one reached.
        """
        out, entry = [np.zeros(0, np.int64)], 0
        for at in range(0, len(symbols), BLOCK):
            if len(self.states) > STATES:
                here = self.states[entry]
                self._clear()
                entry = self._number(here)
            block = symbols[at : at + BLOCK]
            self._columns(block)
            found, entry = self._block(block, entry)
            out.append(found)
        return np.concatenate(out)

    def _run(self, steps: np.ndarray, columns: np.ndarray, lanes: np.ndarray, state: np.ndarray, upto: np.ndarray | None = None, out: np.ndarray | None = None) -> np.ndarray:
        """The states of lanes (columns of ``steps``) after all symbols, or the first ``upto`` of each; moves go to ``out``."""
        state = state.copy()
        for t in range(len(steps) if upto is None else int(upto.max(initial=0))):
            on = slice(None) if upto is None else np.flatnonzero(upto > t)
            lane = lanes[on]
            move = self._advance(state[on], steps[t, lane], columns[t, lane])
            state[on] = move >> 8
            if out is not None:
                out[t, lane] = move
        return state

    def _block(self, symbols: np.ndarray, entry: int) -> tuple[np.ndarray, int]:
        n = len(symbols)
        lanes = -(-n // STEPS)
        padded = np.full(lanes * STEPS, symbols[-1], symbols.dtype)
        padded[:n] = symbols
        steps = np.ascontiguousarray(padded.reshape(lanes, STEPS).T)
        columns, ends, every = self.column[steps], steps >= END, np.arange(lanes)
        constant = ends.any(axis=0)
        head = np.where(constant, ends.argmax(axis=0) + 1, STEPS)  # symbols up to the first word end
        out = np.empty((STEPS, lanes), np.int32)
        begin = np.zeros(lanes, np.int64)
        begin[0] = entry
        after = self._run(steps, columns, every, begin, out=out)  # right from the first word end on
        entries = self._entries(steps, columns, constant, begin, after)
        wrong = np.flatnonzero(entries != begin)
        state = self._run(steps, columns, wrong, entries[wrong], head[wrong], out)
        after[wrong[~constant[wrong]]] = state[~constant[wrong]]
        return (out.T.ravel()[:n] & 255).astype(np.int64) - 128, int(after[-1])

    def _entries(self, steps: np.ndarray, columns: np.ndarray, constant: np.ndarray, begin: np.ndarray, after: np.ndarray) -> np.ndarray:
        """The state that each chunk is entered in, by a prefix scan over the chunks' state maps.

        The map of a chunk with a word end is constant. That of another is a table of the states it may be
        entered in: those its predecessor's map leads to. The tables of all chunks grow together until nothing
        is new, which takes few rounds, as what was read decides a state more than where it began.
        """
        lanes = len(begin)
        lane, state, to = np.arange(lanes), begin, after
        fresh = np.arange(lanes)
        while len(fresh):
            follows = fresh[lane[fresh] + 1 < lanes]
            follows = follows[~constant[lane[follows] + 1]]
            codes = np.unique((lane[follows] + 1) << 32 | to[follows])
            codes = codes[~np.isin(codes, lane << 32 | state)]
            fresh = len(lane) + np.arange(len(codes))
            new_lane, new_state = codes >> 32, codes & 0xFFFFFFFF
            new_to = self._run(steps, columns, new_lane, new_state) if len(codes) else codes
            lane, state, to = np.concatenate((lane, new_lane)), np.concatenate((state, new_state)), np.concatenate((to, new_to))
        return scan(lane, state, to, constant, int(begin[0]))


def scan(lane: np.ndarray, state: np.ndarray, to: np.ndarray, constant: np.ndarray, entry: int) -> np.ndarray:
    """Entry states of all chunks from their maps, rows (lane, state, to): maps are composed by doubling.

    A row points at the row of the next chunk's map that it leads to; the composition of two maps is one
    pointer after the other. Rows that nothing leads on from point at themselves.
    """
    lanes = len(constant)
    order = np.argsort(lane << 32 | state)
    codes = (lane << 32 | state)[order]
    own = np.arange(len(lane))
    wanted = (lane + 1) << 32 | to
    at = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
    jump = np.where((codes[at] == wanted) & (lane + 1 < lanes), order[at], own)
    row_of = order[np.searchsorted(codes, np.arange(lanes) << 32 | np.where(np.arange(lanes) == 0, entry, 0))]  # entered in the start state
    reset = np.append(True, constant[:-1])  # the chunk before is constant: its one exit is the entry
    first = np.maximum.accumulate(np.where(reset, np.arange(lanes), 0))
    seed = np.where(first > 0, to[row_of[np.maximum(first - 1, 0)]], entry)
    row = order[np.minimum(np.searchsorted(codes, first << 32 | seed), len(codes) - 1)]  # a table has its first entry
    far = np.arange(lanes) - first
    hops = np.maximum(far - 1, 0)
    for bit in range(int(hops.max(initial=0)).bit_length()):
        on = hops >> bit & 1 == 1
        row[on] = jump[row[on]]
        jump = jump[jump]
    return np.where(far == 0, seed, to[row])


@lru_cache(maxsize=2)
def _worker(path: str) -> tuple[BpeModel, CountTransducer]:
    model = BpeModel(path)
    if not model.drops_space:
        raise ValueError("this vocabulary doesn't mark word ends")
    return model, CountTransducer(model)


def count_tokens(path: str, texts: list[str]) -> np.ndarray:
    """The number of tokens of each text."""
    model, transducer = _worker(path)
    parts, owner = [], []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        split = [text]
        if model.special_pattern and "<" in text:
            split = model.special_pattern.split(text)
            counts[i] = len(split) - 1
        for part in split:
            for segment in segments(part, CHUNK):
                parts.append(folded(segment))
                owner.append(i)
    at = 0
    while at < len(parts):
        upto, held = at, 0
        while upto < len(parts) and (upto == at or held + len(parts[upto]) + 1 <= CHUNK):
            held += len(parts[upto]) + 1
            upto += 1
        points, begin = code_points(parts[at:upto])
        start, end = dropped_space_pieces(points)
        size = end - start
        letters = points[spans(start, size)]
        wide = 1 + (letters >= 0x80).astype(np.int64) + (letters >= 0x800) + (letters >= 0x10000)
        upto_byte = np.concatenate(([0], np.cumsum(wide)))
        symbols = np.frombuffer(letters.tobytes().decode("utf-32-le").encode(), np.uint8).astype(np.int64)
        symbols[upto_byte[np.cumsum(size)] - 1] += END
        first = np.concatenate(([0], np.cumsum(size)))[np.searchsorted(start, begin)]
        np.add.at(counts, np.array(owner[at:upto], np.int64), row_sums(transducer.changes(symbols), upto_byte[first]))
        at = upto
    return counts


_COUNTS = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row.

    ``path`` is a vocabulary file with word-end marks on every executor. Null texts are empty: no
    bytes, no tokens. Special strings in a text count as one token each, as is the library's
    default. One row comes out for each row in; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches):
        for batch in tidy_after(batches):
            n = count_tokens(path, [x or "" for x in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(n > limit)], schema=schema)

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("bigint"), F.octet_length(text).cast("bigint"), text).mapInArrow(run, _COUNTS)
