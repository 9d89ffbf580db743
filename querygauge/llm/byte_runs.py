"""Runs of bytes in a batch of texts, found and hashed with numpy."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from querygauge.llm.common import utf8_bytes

LONG = 64  # longer runs are hashed one by one by the C library


def _table() -> np.ndarray:
    """Remainders of all bytes for the reflected polynomial 0xEDB88320."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


CRC = _table()


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Start of each text (one more than there are texts) and the bytes of all, a line feed behind each text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_string()
    ended = pc.binary_join_element_wise(pc.fill_null(column.cast(kind), ""), pa.scalar("", kind), pa.scalar("\n", kind))
    return utf8_bytes(ended)


def byte_set(ranges: str) -> np.ndarray:
    """Table of 256 flags from pairs of end points: ``"azAZ"``."""
    flags = np.zeros(256, dtype=bool)
    for low, high in zip(ranges[::2], ranges[1::2]):
        flags[ord(low) : ord(high) + 1] = True
    return flags


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true."""
    edges = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def crc_of_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """Unsigned crc32 of data[start:end] of every run; ``before`` holds the crc32 of what precedes each run."""
    lengths = ends - starts
    crc = np.zeros(len(starts), dtype=np.uint32) if before is None else before.astype(np.uint32)
    order = np.argsort(-lengths, kind="stable")
    n_long = int(np.count_nonzero(lengths > LONG))
    for i in order[:n_long]:
        crc[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(crc[i]))
    rest = order[n_long:]
    at, left, state = starts[rest].copy(), np.sort(lengths[rest]), ~crc[rest]
    for j in range(int(left[-1]) if len(left) else 0):
        live = len(left) - int(np.searchsorted(left, j, side="right"))
        now = state[:live]
        state[:live] = CRC[(now ^ data[at[:live] + j]) & 0xFF] ^ (now >> 8)
    crc[rest] = ~state
    return crc


def texts_at(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keep: np.ndarray | None = None) -> pa.Array:
    """The runs as strings; of bytes outside ``keep`` none is taken."""
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    places = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)
    taken = data[places]
    if keep is not None:
        kept = keep[places]
        offsets = np.concatenate([[0], np.cumsum(kept)]).astype(np.int64)[offsets]
        taken = taken[kept]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(np.ascontiguousarray(taken)))
