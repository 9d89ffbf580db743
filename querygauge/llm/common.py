"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Byte maps: every blank (0x09-0x0D, 0x20) becomes a space; and A-Z become a-z as well. Bytes of other letters stay.
BLANKS = bytes(32 if 9 <= b <= 13 else b for b in range(256))
LOWER = bytes(b + 32 if 65 <= b <= 90 else BLANKS[b] for b in range(256))


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(-1))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The given names, each lengthened until no column of the table has it (names differ only by case clash too)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def utf8_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Start of each text (one more than there are texts) and the bytes of all of them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1, offset=8 * column.offset) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offsets - offsets[0], whole[offsets[0] : offsets[-1]]


def slices(column: pa.Array, most_bytes: int = 2_000_000):
    """Parts of a text column of about so many bytes each, so that arrays made from them stay small.

    A single text longer than that is a part of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    starts, _ = utf8_bytes(column)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(starts, starts[at] + most_bytes, side="right")) - 1)
        yield at, column.slice(at, end - at)
        at = end


def words_of(column: pa.Array, table: bytes) -> tuple[np.ndarray, pa.Array]:
    """First word of each text (one more than there are texts), and the words that spaces part once bytes are mapped."""
    starts, data = utf8_bytes(column)
    mapped = pa.py_buffer(data.tobytes().translate(table))
    texts = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(np.ascontiguousarray(starts)), mapped)
    lists = pc.split_pattern(texts, " ")
    flat, ends = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(real)])[ends], flat.filter(pa.array(real))


def letter_words(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """First word of each text (one more than there are texts) and the words of letters, lower case."""
    lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(column, "").cast(pa.large_string())), r"[^\p{L}]+")
    flat, ends = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(real)])
    return before[ends], flat.filter(pa.array(real))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixer (two multiply-xorshift rounds) over an array."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x
