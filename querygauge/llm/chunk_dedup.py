"""Substring deduplication by content-defined chunks.

A gear rolling hash over the last 16 bytes sets chunk ends, so an insertion moves only the ends near it. Chunks are
compared by 64-bit digest. A chunk repeats if its digest occurs at two places; its kept copy is the place with the
smallest (id, text hash, begin). A *repeat* is a run of neighbouring repeating chunks of ``MIN_WORDS`` words at least; the
chunks at both ends of a common passage are cut differently, so a run is shorter than the passage it comes from. Of each
repeat the chunks that are not kept copies are cut out of the text, as far as their characters are whole.

Defined results: null and empty texts have no chunk; a text of any length is chunked whole; a repeated row (same id and
text) is one document; a passage that repeats inside one document counts as well, with all its places. An empty table gives no
row. Rows with a null id take part; they are kept copies only where no other row holds the chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from querygauge.llm.common import mixed, slices, text_or_empty, utf8_bytes
from querygauge.session import cut_lineage

LEAST, MOST, MASK_BITS = 16, 128, 5  # bytes of a chunk; one place in 2**MASK_BITS may end one
MIN_WORDS = 20
_GEAR = (mixed(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(48)).astype(np.uint16)  # a rule in place of a table
_SPACE = np.array([b <= 32 for b in range(256)])


def _candidates(data: np.ndarray) -> np.ndarray:
    """Places after which a chunk may end: the gear hash of 16 bytes (16 bits, shifted by one for each byte) has leading zeros."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8):
        longer = h.copy()
        longer[step:] += h[:-step] << np.uint16(step)
        h = longer
    return np.flatnonzero(h >> np.uint16(16 - MASK_BITS) == 0) + 1


def cuts(size: int, candidates: list[int]) -> list[int]:
    """Ends of chunks of a text of ``size`` bytes."""
    out, start = [], 0
    for c in candidates:
        while c - start > MOST:
            start += MOST
            out.append(start)
        if c - start >= LEAST:
            out.append(c)
            start = c
    while size - start > MOST:
        start += MOST
        out.append(start)
    if size > start:
        out.append(size)
    return out


def chunks(column: pa.Array):
    """(ends, digests, words) of each text of an Arrow column."""
    for _, part in slices(column):
        starts, data = utf8_bytes(part)
        whole = data.tobytes()
        space = _SPACE[data]
        begins = np.concatenate([[0], np.cumsum(~space & np.concatenate([[True], space[:-1]]))]) if len(data) else np.zeros(1, np.int64)
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            ends = cuts(b - a, _candidates(data[a:b]).tolist())
            at = np.array([0, *ends]) + a
            digests = np.array([xxhash.xxh3_64_intdigest(whole[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist())], np.uint64)
            yield np.array(ends, np.int32), digests.view(np.int64), np.diff(begins[at]).astype(np.int32)


def _packed(begin: np.ndarray, end: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Begin, length and words (both below 256: a chunk has ``MOST`` bytes at most) in one number that orders by begin."""
    return begin.astype(np.int64) << 16 | (end - begin).astype(np.int64) << 8 | words.astype(np.int64)


def _chunk_list(column: pa.Array) -> pa.Array:
    every = list(chunks(column))
    offsets = np.cumsum([0] + [len(e) for e, _, _ in every]).astype(np.int32)
    places = [_packed(np.concatenate([[0], e[:-1]]).astype(np.int64) if len(e) else e, e, w) for e, _, w in every]
    flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (places, [d for _, d, _ in every])]
    values = pa.StructArray.from_arrays([pa.array(f) for f in flat], names=["at", "digest"])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _run_list(column: pa.Array) -> pa.Array:
    out = []
    for found in column.to_pylist():
        runs: list[dict] = []
        for at, kept in sorted((x["at"], x["kept"]) for x in found):
            begin = at >> 16
            x = {"begin": begin, "end": begin + (at >> 8 & 255), "words": at & 255, "kept": kept}
            if not runs or runs[-1]["end"] != x["begin"]:
                runs.append({"begin": x["begin"], "end": x["begin"], "words": 0, "chunks": 0, "kept": 0, "gone": []})
            runs[-1]["end"] = x["end"]
            runs[-1]["words"] += x["words"]
            runs[-1]["chunks"] += 1
            runs[-1]["kept"] += x["kept"]
            gone = runs[-1]["gone"]
            if not x["kept"] and gone and gone[-1]["end"] == x["begin"]:
                gone[-1]["end"] = x["end"]
            elif not x["kept"]:
                gone.append({"begin": x["begin"], "end": x["end"]})
        out.append([r for r in runs if r["words"] >= MIN_WORDS])
    places = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
    return pa.array(out, pa.list_(pa.struct([*((n, pa.int32()) for n in ("begin", "end", "words", "chunks", "kept")), ("gone", places)])))


def without_places(text: str, places: list[dict]) -> str:
    """``text`` without the given byte places of its UTF-8; a character that reaches out of a place stays."""
    data, at, parts = text.encode(), 0, []
    inside = lambda i: i < len(data) and data[i] & 0xC0 == 0x80  # noqa: E731  not the first byte of a character
    for x in sorted(places, key=lambda x: x["begin"]):
        begin, end = x["begin"], x["end"]
        while inside(begin):
            begin += 1
        while inside(end):
            end -= 1
        if begin < end:
            parts.append(data[at:begin])
            at = end
    return b"".join([*parts, data[at:]]).decode()


def chunk_list(text: Column) -> Column:
    """Chunks of any text column: ``at`` (see ``_packed``) and digest."""
    return F.arrow_udf(_chunk_list, "array<struct<at bigint, digest bigint>>")(text)


def _runs(found: Column) -> Column:
    return F.arrow_udf(_run_list, "array<struct<begin int, end int, words int, chunks int, kept int, gone array<struct<begin int, end int>>>>")(found)


def _repeat_lists(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document (id, text hash ``h``) with a repeating chunk: ``runs``, its repeats."""
    text = text_or_empty(F.col(text_col))
    rows = cut_lineage(docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), chunk_list(text).alias("l")))
    placed = rows.select("id", "h", F.explode("l").alias("x")).select("id", "h", "x.digest", "x.at")
    # digests alone are counted first: places move only where their digest is seen again
    often = placed.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest")
    again = cut_lineage(placed.join(often, "digest", "left_semi"))
    place = F.struct(F.col("id").isNull().alias("none"), "id", "h", "at")
    ends = again.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    kept = ends.filter(~F.col("first").eqNullSafe(F.col("last"))).select("digest", "first")  # rows that repeat as a whole have one place
    found = again.join(kept, "digest").select("id", "h", "at", place.eqNullSafe(F.col("first")).cast("int").alias("kept"))
    lists = found.groupBy("id", "h").agg(F.collect_set(F.struct("at", "kept")).alias("found"))  # chunks of one document
    return lists.select("id", "h", _runs("found").alias("runs"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per repeat: id, ``begin`` and ``end`` (bytes of the text's UTF-8), ``words``, ``chunks``, ``kept`` (how many of the
    chunks are the copies that stay), ``gone`` (places of the others) and ``text_hash``."""
    return _repeat_lists(docs, id_col, text_col).select(F.col("id").alias(id_col), F.col("h").alias("text_hash"), F.explode("runs").alias("r")).select(id_col, "r.*", "text_hash")


def _cut(text: Column, gone: Column) -> Column:
    """``text`` without the places ``gone``; as it is where that is null or empty."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array, places: pa.Array) -> pa.Array:
        return pa.array([t and without_places(t, p or []) for t, p in zip(texts.to_pylist(), places.to_pylist())], pa.string())

    some = F.coalesce(F.size(gone), F.lit(0)) > 0
    return F.when(some, cut(F.when(some, text.cast("string")), gone)).otherwise(text)


def _of_row(text_col: str, id_col: str, h: str) -> Column:
    return F.col(f"d.`{id_col}`").eqNullSafe(F.col("g._gone_id")) & (F.xxhash64(text_or_empty(F.col(f"d.`{text_col}`"))) == F.col(f"g.{h}"))


def without_repeats(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the chunks of the repeats ``found`` that are not kept copies cut out of the text; other columns stay."""
    gone = found.groupBy(F.col(id_col).alias("_gone_id"), F.col("text_hash").alias("_gone_hash")).agg(F.flatten(F.collect_list("gone")).alias("_gone"))
    joined = docs.alias("d").join(gone.alias("g"), _of_row(text_col, id_col, "_gone_hash"), "left")
    new = _cut(F.col(f"d.`{text_col}`"), F.col("g._gone")).alias(text_col)
    return joined.select(*[new if c == text_col else F.col(f"d.`{c}`") for c in docs.columns])


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The repeats (as in ``repeats``, without ``gone``) of each row of ``docs`` and, beside them, ``n_bytes`` and ``text_sha256`` of the
    row's text after the cut. A row without a repeat is there once, with null in the columns of a repeat."""
    gone = cut_lineage(_repeat_lists(docs, id_col, text_col).select(F.col("id").alias("_gone_id"), F.col("h").alias("_gone_hash"), "runs").filter(F.size("runs") > 0))
    docs.sparkSession.sparkContext._jvm.System.gc()  # the chunks' shuffle files go before the texts are shuffled
    joined = docs.select(id_col, text_col).alias("d").join(gone.alias("g"), _of_row(text_col, id_col, "_gone_hash"), "left")
    new = text_or_empty(_cut(F.col(f"d.`{text_col}`"), F.flatten(F.col("g.runs.gone"))))
    each = joined.select(F.col(f"d.`{id_col}`").alias(id_col), "g.runs", new.alias("new"))
    each = each.select(id_col, "runs", F.octet_length("new").cast("bigint").alias("n_bytes"), F.sha2(F.col("new").cast("binary"), 256).alias("text_sha256"))
    one = each.select(id_col, F.explode_outer("runs").alias("r"), "n_bytes", "text_sha256")
    return one.select(id_col, *[F.col(f"r.{c}").alias(c) for c in ("begin", "end", "words", "chunks", "kept")], "n_bytes", "text_sha256")
