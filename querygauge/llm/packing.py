"""Order-preserving packing by dynamic programming.

The documents of a partition form one stream of token ids, in row order. Windows of at most ``window`` tokens
are cut from it at places that cost least: padding of the window plus a penalty for the cut (none at the end of a
document, a little at the end of a sentence, more inside one). With ``f`` the least cost up to a place and ``p`` its
position, f[j] = cut[j] + window - p[j] + min(f[i] + p[i]) over places i within a window of j; the minimum is kept
in a monotone queue. A window whose length is a power of two (from ``LEAST_POWER``) is not padded.

A stream is solved in blocks of about ``BLOCK`` tokens; the last window of a block is open and goes on in the next
one, so memory stays bounded and only a partition's last window is cut short by the end of the input. Partitions
are independent: no shuffle, and a lost one is packed again to the same sequences.

Defined results: a null or empty text is one document of the end id alone; repeated rows are packed each; a text of any length
is packed whole; an empty table gives no row.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from querygauge.llm.common import BLANKS, LOWER, slices, utf8_bytes, words_of

WINDOW = 2048
END = 1
LEAST_POWER = 256
SENTENCE_CUT, INNER_CUT = 6.0, 18.0  # tokens that a cut is worth
UNIT = 64  # places inside a sentence are so many tokens apart at most
BLOCK = 64 * WINDOW


def best_cuts(position: np.ndarray, penalty: np.ndarray, window: int = WINDOW, least_power: int = LEAST_POWER) -> list[int]:
    """Indexes of ``position`` (ascending from 0, steps of at most ``window``) at which the cheapest windows end."""
    n = len(position)
    p, cut = position.tolist(), penalty.tolist()
    powers = [1 << k for k in range(window.bit_length()) if least_power <= 1 << k < window]
    whole: dict[int, list[int]] = {}
    for w in powers:  # places exactly a power of two apart
        at = np.searchsorted(position, position - w)
        for j in np.flatnonzero((position >= w) & (position[at] == position - w)).tolist():
            whole.setdefault(j, []).append(int(at[j]))
    cost, back = [0.0] * n, [0] * n
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])  # f + p rises from left to right
    for j in range(1, n):
        while p[j] - p[queue[0][1]] > window:
            queue.popleft()
        value, i = queue[0]
        value += window - p[j]
        for k in whole.get(j, ()):
            if cost[k] < value:
                value, i = cost[k], k
        cost[j], back[j] = value + cut[j], i
        key = cost[j] + p[j]
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    ends, j = [], n - 1
    while j > 0:
        ends.append(j)
        j = back[j]
    return ends[::-1]


JOINED = 64
STOPS = {".", "!", "?"}
_MARK = np.isin(np.arange(256), [ord(c) for c in ".,!?;:"])
_PLAIN = np.isin(np.arange(256), [ord(c) for c in "0123456789abcdefghijklmnopqrstuvwxyz"])
_LOWER = np.frombuffer(LOWER, np.uint8)


def _marks_apart(column: pa.Array) -> pa.LargeStringArray:
    """Texts with A-Z lowered and a space between an ASCII letter or digit and a mark behind it.

    The tokenizer lowers texts itself and always parts letters and digits from marks, so ids stay the same while there are
    fewer distinct words. Texts that may hold a special token are not lowered: those are told apart by case."""
    starts, data = utf8_bytes(column)
    if b"<|" not in data.tobytes():
        data = _LOWER[data]
    before = np.concatenate([[False], _PLAIN[data[:-1]]]) if len(data) else np.zeros(0, bool)
    before[starts[:-1][starts[:-1] < len(data)]] = False
    places = np.flatnonzero(_MARK[data] & before)
    wide, moved = np.insert(data, places, 32), starts + np.searchsorted(places, starts, side="left")
    return pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(np.ascontiguousarray(moved)), pa.py_buffer(np.ascontiguousarray(wide)))


class Tokens:
    """Ids of texts by a tokenizer whose pieces never cross white space; each distinct word is encoded once.

    Encoded words are kept while there are fewer than ``most``; then those that came again stay, up to half as many."""

    def __init__(self, path: str, most: int = 600_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # ids that end a piece
        for token, i in vocabulary.items():
            self.last[i] = token.endswith("</w>")
        self._clear()

    def _clear(self) -> None:
        self.row: dict[str, int] = {}
        self.ids, self.end, self.stop = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, bool)
        self.seen = np.zeros(0, np.int32)  # parts of the input that held a word

    def _forget(self) -> None:
        """Keep the words that came in two parts or more, the most frequent ones if they are many."""
        most = self.most // 2
        keep = np.flatnonzero(self.seen > 1)
        if len(keep) > most:
            keep = np.sort(keep[np.argpartition(self.seen[keep], len(keep) - most)[len(keep) - most :]])
        words, sizes = list(self.row), np.diff(self.end)[keep]  # words stand in the order of their rows
        end = np.concatenate([[0], np.cumsum(sizes)])
        self.ids = self.ids[np.repeat(self.end[keep] - end[:-1], sizes) + np.arange(end[-1])]
        self.end, self.stop, self.seen = end, self.stop[keep], np.ones(len(keep), np.int32)
        self.row = {words[k]: i for i, k in enumerate(keep.tolist())}

    def _learn(self, units: list[str]) -> None:
        new = [u for u in units if u not in self.row]
        if not new:
            return
        letters, rest = [u for u in new if u.isalpha()], [u for u in new if not u.isalpha()]
        order, ids, sizes = [], [], []
        for at in range(0, len(letters), 80 * JOINED):  # units of letters are one piece each and go together, parted by spaces
            groups = [letters[k : k + JOINED] for k in range(at, min(at + 80 * JOINED, len(letters)), JOINED)]
            for own, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
                found = np.array(e.ids, np.uint32)
                ends = np.flatnonzero(self.last[found])
                if len(ends) == len(own):
                    order += own
                    ids.append(found)
                    sizes.append(np.diff(ends, prepend=-1))
                else:
                    rest += own
        for at in range(0, len(rest), 5000):
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(rest[at : at + 5000], add_special_tokens=False)]
            ids.append(np.fromiter(chain.from_iterable(lists), np.uint32))
            sizes.append(np.fromiter(map(len, lists), np.int64, len(lists)))
        order += rest
        first = len(self.row)
        self.row.update(zip(order, range(first, first + len(order))))
        self.ids = np.concatenate([self.ids, *ids])
        self.end = np.concatenate([self.end, self.end[-1] + np.cumsum(np.concatenate(sizes))])
        self.seen = np.concatenate([self.seen, np.zeros(len(order), np.int32)])
        self.stop = np.concatenate([self.stop, np.fromiter((u[-1:] in STOPS or u[:1] in STOPS for u in order), bool, len(order))])

    def documents(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids with the end id, ends of sentences) of each text."""
        for _, part in slices(column):
            if len(self.row) > self.most:
                self._forget()
            ends, flat = words_of(_marks_apart(part), BLANKS)
            coded = flat.dictionary_encode()
            words = coded.dictionary.to_pylist()
            self._learn(words)
            own_row = np.array(list(map(self.row.__getitem__, words)), np.int64)
            self.seen[own_row] += 1
            row = own_row[coded.indices.to_numpy()] if len(words) else own_row
            start, size = self.end[row], self.end[row + 1] - self.end[row] if len(row) else np.zeros(0, np.int64)
            upto = np.concatenate([[0], np.cumsum(size)])
            where = np.repeat(start - upto[:-1], size) + np.arange(upto[-1])
            ids, stops = self.ids[where], self.stop[row]
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                own = upto[a + 1 : b + 1][stops[a:b]] - upto[a]
                yield np.append(ids[upto[a] : upto[b]], np.uint32(END)), own


_TOKENS: dict[str, Tokens] = {}  # of this worker: tasks that follow each other share what was encoded


def _tokens(path: str) -> Tokens:
    if path not in _TOKENS:
        _TOKENS[path] = Tokens(path)
    return _TOKENS[path]


def _places(lengths: list[int], stops: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places where a stream of documents may be cut, and what a cut there costs."""
    at, kind, ahead = [np.zeros(1, np.int64)], [np.zeros(1)], 0
    for n, own in zip(lengths, stops):
        inner = own[(own > 0) & (own < n - 1)]
        if len(inner) > 1:
            inner = inner[np.append(True, inner[1:] > inner[:-1])]
        bounds = np.concatenate([[0], inner, [n]])
        gaps = np.diff(bounds)
        if (gaps > UNIT).any():
            more = np.concatenate([np.arange(a + UNIT, b, UNIT) for a, b in zip(bounds[:-1][gaps > UNIT], bounds[1:][gaps > UNIT])])
            every = np.concatenate([inner, more])
            order = np.argsort(every, kind="stable")
            every, cost = every[order], np.where(order < len(inner), SENTENCE_CUT, INNER_CUT)
        else:
            every, cost = inner, np.full(len(inner), SENTENCE_CUT)
        at += [every + ahead, np.array([ahead + n])]
        kind += [cost, np.zeros(1)]
        ahead += n
    return np.concatenate(at), np.concatenate(kind)


def pack_stream(documents: Iterator[tuple[object, np.ndarray, np.ndarray]], window: int = WINDOW, block: int = BLOCK) -> Iterator[tuple]:
    """Pieces (key, start, ids, document tokens, sequence, offset) of a stream of (key, ids, sentence ends)."""
    held: list[tuple[object, np.ndarray, np.ndarray, int, int]] = []  # key, ids left, stops, ids before, document tokens
    sequence = 0

    def solve(final: bool):
        nonlocal held, sequence
        position, penalty = _places([len(x[1]) for x in held], [x[2] for x in held])
        ends = best_cuts(position, penalty, window)
        bounds = [0, *[int(position[e]) for e in ends]]
        closed = len(bounds) - 1 if final else max(1, len(bounds) - 2)
        d, ahead = 0, 0  # current document and where it begins in the block
        for w in range(closed):
            at, offset = bounds[w], 0
            while at < bounds[w + 1]:
                key, ids, _, before, total = held[d]
                end = min(bounds[w + 1], ahead + len(ids))
                piece = ids[at - ahead : end - ahead]
                yield key, before + at - ahead, piece, total, sequence, offset
                offset += len(piece)
                at = end
                if at == ahead + len(ids):
                    ahead += len(ids)
                    d += 1
            sequence += 1
        rest = held[d:]
        if rest and (gone := bounds[closed] - ahead):
            key, ids, own, before, total = rest[0]
            rest[0] = (key, ids[gone:], own[own > gone] - gone, before + gone, total)
        held = rest

    tokens = 0
    for key, ids, own in documents:
        held.append((key, ids, own, 0, len(ids)))
        tokens += len(ids)
        if tokens >= block:
            yield from solve(False)
            tokens = sum(len(x[1]) for x in held)
    if held:
        yield from solve(True)


def pack(docs: DataFrame, tokenizer: str, keys: list[str], text_col: str = "text", window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """One row per piece: the ``keys`` columns, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``,
    ``offset`` and, if wanted, the piece's ``ids``. Order and partitions are those of ``docs``."""
    own = docs.select(*[F.col(k) for k in keys], F.col(text_col).cast("string").alias("_text"))
    fields = [(f.name, f.dataType.simpleString()) for f in own.schema.fields[:-1]]
    schema = ", ".join(f"`{n}` {t}" for n, t in fields) + ", start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part = _tokens(tokenizer), TaskContext.get().partitionId()
        waiting: deque = deque()  # key columns of the batches whose documents are still in the stream

        def documents():
            for number, batch in enumerate(batches):
                waiting.append((number, batch.select(list(range(batch.num_columns - 1)))))
                for i, (ids, own_stops) in enumerate(tokens.documents(batch.column(batch.num_columns - 1))):
                    yield (number, i), ids, own_stops

        def out(rows: list[tuple]) -> pa.RecordBatch:
            first = waiting[0][0]
            offsets = np.cumsum([0] + [b.num_rows for _, b in waiting])
            index = pa.array([int(offsets[n - first]) + i for (n, i), *_ in rows])
            taken = pa.Table.from_batches([b for _, b in waiting]).take(index).combine_chunks() if fields else None
            columns = [taken.column(k).combine_chunks() if taken.column(k).num_chunks != 1 else taken.column(k).chunk(0) for k in range(len(fields))]
            columns += [pa.array([r[1] for r in rows], pa.int64()), pa.array([len(r[2]) for r in rows], pa.int64()), pa.array([zlib.crc32(r[2].astype("<u4").tobytes()) for r in rows], pa.int64())]
            columns += [pa.array([r[3] for r in rows], pa.int64()), pa.array([(part << 33) | r[4] for r in rows], pa.int64()), pa.array([r[5] for r in rows], pa.int64())]
            if with_ids:
                ends = np.cumsum([0] + [len(r[2]) for r in rows]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([r[2] for r in rows]).astype(np.int32))))
            while len(waiting) > 1 and waiting[0][0] < rows[-1][0][0]:
                waiting.popleft()
            return pa.RecordBatch.from_arrays(columns, names=[n for n, _ in fields] + ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids)

        rows: list[tuple] = []
        for piece in pack_stream(documents(), window):
            rows.append(piece)
            if len(rows) >= 2000:
                yield out(rows)
                rows = []
        if rows:
            yield out(rows)

    return own.mapInArrow(run, schema)
