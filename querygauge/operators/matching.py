"""Matching many texts with many: containment of golds in texts, and the nearest gold of each prediction.

Neither compares every pair.  Both list texts under the rarest of their character n-grams, meet lists of the
same n-gram, and verify what met.  A long list is split into parts of bounded length, and the other side is
repeated once per part, so no n-gram is one task's work.  Texts that repeat are matched once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from querygauge.operators.placement import spread
from querygauge.session import batches_of, cut_lineage, scratch_path

LIST = 10_000  # entries of one n-gram that meet the other side together


def meet(left: DataFrame, right: DataFrame, on: list[str], spread_by: str, sizes: DataFrame, most: int = LIST, placed: bool = False) -> DataFrame:
    """Inner join on n-grams; ``sizes`` (on, n) counts the right side's entries, longer lists are split into parts.

    ``placed``: both sides go to all shuffle partitions, where small lists make large work."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / most)).cast("int")
    long_lists = sizes.filter(F.col("n") > most).select(*on, parts.alias("_parts"))
    split = right.join(long_lists, on, "left").withColumn("_part", F.pmod(F.xxhash64(spread_by), F.coalesce("_parts", F.lit(1))).cast("int"))
    copies = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
    repeated = left.join(long_lists, on, "left").withColumn("_part", F.explode(copies))
    left, right = repeated.drop("_parts"), split.drop("_parts")
    if placed:
        left, right = (spread(side, *on, "_part") for side in (left, right))
    return left.join(right, [*on, "_part"]).drop("_part")


# --- containment --------------------------------------------------------------------------------

GRAM = 8  # bytes of an n-gram: they fill one 64-bit number, so equal numbers are equal n-grams
WINDOW = 8  # neighbouring n-grams of which a text lists the one with the smallest hash
LONG = GRAM + WINDOW - 1  # bytes from which a gold has a whole window
PIECE = 1 << 18  # bytes of texts that are looked through at once
TEXTS = 1_000  # texts that Python is handed at once
MARKS = 26  # most marks of asked n-grams, as a power of two
GOLD_GRAMS, PLACES = "_g string, size bigint, gram bigint, whole boolean", "_id bigint, size bigint, gram bigint"


def _packed(data: np.ndarray, size: int) -> np.ndarray:
    """Every run of ``size`` bytes as one number."""
    n = len(data) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(size if n > 0 else 0):
        out = (out << np.uint64(8)) | data[i : i + n]
    return out


def _hashes(grams: np.ndarray) -> np.ndarray:
    """One to one, so equal hashes are equal n-grams."""
    h = grams.copy()
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def _window_minima(grams: np.ndarray, window: int) -> np.ndarray:
    """The n-gram of smallest hash of each run of ``window`` neighbours (of all, if they are fewer), once each."""
    h = _hashes(grams)
    if len(grams) <= window:
        return grams[[np.argmin(h)]] if len(grams) else grams
    least, order = np.unique(h, return_index=True)
    minima = np.lib.stride_tricks.sliding_window_view(h, window).min(axis=1)
    return grams[order[np.searchsorted(least, np.unique(minima))]]


def _are_minima(grams: np.ndarray, window: int, whole: np.ndarray) -> np.ndarray:
    """Which n-grams have the smallest hash of a run of ``window`` (a power of two) neighbours; only runs whose start is ``whole`` count."""
    h = _hashes(grams)
    least, step = h, 1
    while step < window:  # the least of 2, 4, 8 neighbours
        least, step = np.minimum(least[:-step], least[step:]), 2 * step
    runs = np.zeros(len(h) + window - 1, np.uint64)  # and of the runs that hold an n-gram, the largest least
    runs[window - 1 : window - 1 + len(least)] = np.where(whole[: len(least)], least, np.uint64(0))
    step = 1
    while step < window:
        runs, step = np.maximum(runs[:-step], runs[step:]), 2 * step
    return runs == h


def _marks(grams: np.ndarray, size: int, bits: int) -> list[np.ndarray]:
    """The two marks of each n-gram, of 2 ** ``bits``."""
    return [((grams + np.uint64(size)) * np.uint64(factor) >> np.uint64(64 - bits)).view(np.int64) for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


def _gold_grams(golds: DataFrame) -> DataFrame:
    """(_g, size, gram, whole) of each gold: itself if it is shorter than an n-gram, else its n-grams, from ``LONG`` bytes its window minima.

    ``whole``: texts must list all n-grams to meet it.  An empty gold has size 0."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, found, held = [], [], 0
            for i, value in enumerate(batch.column(0)):
                data = np.frombuffer(value.as_py().encode(), np.uint8).astype(np.uint64)
                size = min(len(data), GRAM)
                own = _packed(data, size) if size else np.zeros(1, np.uint64)
                found.append(np.unique(own) if len(data) < LONG else _window_minima(own, WINDOW))
                kinds.append((i, size, GRAM <= len(data) < LONG))
                held += len(found[-1])
                if held >= PIECE or i + 1 == len(batch):
                    rows, sizes, whole = (pa.array(np.repeat(c, [len(g) for g in found])) for c in zip(*kinds, strict=True))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), sizes, pa.array(np.concatenate(found).view(np.int64)), whole], ["_g", "size", "gram", "whole"])
                    kinds, found, held = [], [], 0

    return golds.select("_g").mapInArrow(grams, GOLD_GRAMS)


def _marked(asked: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """Bits set at the marks of ``n`` n-grams (size, gram), and the power of two of their number: about 128 bits for each mark, up to 2 ** ``MARKS``."""
    bits = min(max(16, (2 * n - 1).bit_length() + 7), MARKS)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, gram = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            marks = np.concatenate([m for s in np.unique(size) for m in _marks(gram[size == s].view(np.uint64), int(s), bits)])
            yield pa.RecordBatch.from_arrays([pa.array(marks >> 6), pa.array((np.uint64(1) << (marks & 63).view(np.uint64)).view(np.int64))], ["word", "bit"])

    set_ = asked.select("size", "gram").mapInArrow(words, "word bigint, bit bigint").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[set_["word"].to_numpy()] = set_["bits"].to_numpy()
    return out.astype("<i8").view(np.uint8), bits


def _text_grams(texts: DataFrame, key: str, text: str, sizes: list[int], whole: bool, marked: tuple[np.ndarray, int]) -> DataFrame:
    """(key, size, gram) of the marked n-grams of each text: runs of each short size, and long n-grams, all of them or window minima.

    Texts of a batch are looked through as one run of bytes, by the piece.  Few n-grams that nobody asked for share the
    marks of others; one that stands in two pieces of a text comes twice."""
    kind = texts.schema[key].dataType
    (packed, bits), piece = marked, PIECE

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_marked = np.unpackbits(packed, bitorder="little").view(bool)
        for batch in batches:
            column = batch.column(1).cast(pa.large_string())
            ends = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
            if not len(column) or ends[-1] == ends[0]:
                continue
            data = np.frombuffer(column.buffers()[2], np.uint8, ends[-1] - ends[0], ends[0])
            ends = ends - ends[0]
            for start in range(0, len(data), piece):
                before = min(start, WINDOW - 1)  # runs that begin before the piece
                near = data[start - before : start + piece + LONG - 1].astype(np.uint64)
                runs = near
                for size in range(1, max(sizes) + 1):
                    runs = runs if size == 1 else (runs[:-1] << np.uint64(8)) | near[size - 1 :]
                    if size not in sizes:
                        continue
                    here = runs[before : before + piece]
                    marks = _marks(here, size, bits)
                    at = np.flatnonzero(is_marked[marks[0]])
                    at = at[is_marked[marks[1][at]]]
                    if size == GRAM and not whole and len(at):
                        inside = np.ones(len(runs), bool)
                        for back in range(1, LONG):  # runs of n-grams that begin here pass the end of their text
                            over = ends[1:] - back - (start - before)
                            inside[over[(over >= 0) & (over < len(runs))]] = False
                        at = at[_are_minima(runs, WINDOW, inside)[before : before + piece][at]]
                    row = np.searchsorted(ends, start + at, "right") - 1
                    fits = start + at + size <= ends[row + 1]
                    row, gram = row[fits], here[at[fits]]
                    order = np.lexsort((gram, row))
                    row, gram = row[order], gram[order]
                    first = np.ones(len(row), bool)
                    first[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
                    row, gram = row[first], gram[first]
                    if len(row):
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(np.full(len(row), size)), pa.array(gram.view(np.int64))], ["k", "size", "gram"])

    return texts.select(key, text).mapInArrow(grams, f"k {kind.simpleString()}, size bigint, gram bigint").withColumnRenamed("k", key)


def contains_join(golds: DataFrame, texts: DataFrame, gold_key: str, gold: str, text_key: str, text: str, most: int = LIST) -> DataFrame:
    """(gold_key, text_key) of every gold that stands in a text, any case: the pairs that ``contains_match`` scores 1.

    A gold of 15 bytes or more is looked up by the rarest of its window minima: a text that holds it has the same
    windows and lists the same minima, about two of nine n-grams.  Golds of 8 to 14 bytes need all n-grams of the
    texts, shorter ones the runs of their own length; texts list only what the golds at hand ask for.  Of that, only
    entries whose marks some gold has set leave Python; texts are listed once, into the shared folder.  Empty golds stand in every
    text that is not null; a null gold or text matches nothing.  Repeated keys give a row for each pair of rows.
    """
    spark = golds.sparkSession
    own = golds.select(F.col(gold_key).alias("_gk"), F.lower(F.col(gold).cast("string")).alias("_g")).filter(F.col("_g").isNotNull())
    all_texts = texts.select(F.col(text_key).alias("_tk"), F.lower(F.col(text).cast("string")).alias("_t")).filter(F.col("_t").isNotNull())
    # written, so that the planner knows how small they are: else all n-grams of all texts move to meet them
    folder = scratch_path(spark, "grams")
    _gold_grams(own.select("_g").distinct()).write.parquet(folder)
    gold_grams = spark.read.schema(GOLD_GRAMS).parquet(folder)
    on = ["size", "gram"]
    asked = gold_grams.filter("size > 0").select(*on).distinct()
    kinds = gold_grams.groupBy("size").agg(F.count_distinct("gram").alias("n"), F.max("whole").alias("whole")).collect()
    sizes, whole = sorted(k["size"] for k in kinds if k["size"]), any(k["whole"] for k in kinds)

    # ids only gather candidates, texts verify them
    tids = spread(all_texts.select("_t").withColumn("_id", F.xxhash64("_t")), "_id").dropDuplicates(["_id", "_t"])
    folder = scratch_path(spark, "places")
    if sizes:
        marked = _marked(asked, sum(k["n"] for k in kinds if k["size"]))
        with batches_of(spark, TEXTS):
            _text_grams(tids, "_id", "_t", sizes, whole, marked).write.parquet(folder)
    else:
        spark.createDataFrame([], PLACES).write.parquet(folder)
    places = spark.read.schema(PLACES).parquet(folder).join(asked, on, "left_semi").distinct()
    counts = places.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    rarest = gold_grams.join(counts, on, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    chosen = rarest.groupBy("_g").agg(F.min(F.struct("n", "size", "gram")).alias("b")).select("_g", "b.size", "b.gram", "b.n").filter(F.col("n") > 0)
    near = meet(chosen.drop("n"), places, on, "_id", counts, most).select("_g", "_id")
    held = near.join(tids, "_id").filter(F.contains("_t", F.col("_g"))).select("_g", F.sha2("_t", 256).alias("_h"))
    # copies of a gold or a text come back by equality; texts themselves do not move again, their digests do
    keyed = all_texts.select("_tk", F.sha2("_t", 256).alias("_h"))
    found = own.join(held, "_g").join(keyed, "_h").select("_gk", "_tk")
    if all(k["size"] for k in kinds):
        pairs = found
    else:  # an empty gold stands everywhere: its keys, numbered in blocks, repeat every text
        empty = own.filter(F.col("_g") == "").select("_gk")
        blocks = empty.withColumn("_b", F.pmod(F.xxhash64("_gk"), F.lit(64))).groupBy("_b").agg(F.collect_list("_gk").alias("_ks"))
        everywhere = all_texts.select("_tk", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("_b")).join(blocks, "_b")
        pairs = found.unionAll(everywhere.select(F.explode("_ks").alias("_gk"), "_tk"))
    return pairs.select(F.col("_gk").alias(gold_key), F.col("_tk").alias(text_key))


# --- nearest gold -------------------------------------------------------------------------------


def _reach(at_least: float) -> float:
    return (1 - at_least) / at_least


def _edits(length: Column, at_least: float) -> Column:
    """Most edits between a text of this length and any text that is similar enough."""
    return F.floor(length * F.lit(_reach(at_least)) + 1e-9).cast("int")


def _short_limit(at_least: float) -> int:
    """Longest length at which so many edits may destroy all pairs of characters."""
    r = _reach(at_least)
    top = math.ceil(2 / (1 - 2 * r)) + 1
    return max(n for n in range(top + 1) if 2 * math.floor(n * r + 1e-9) + 1 > n - 1)


def _tokens(texts: DataFrame, q: int) -> DataFrame:
    """(s, n, token): runs of ``q`` characters, numbered where one repeats within a text."""
    chars = F.split("s", "")
    starts = F.when(F.col("n") >= q, F.sequence(F.lit(1), F.col("n") - (q - 1))).otherwise(F.array().cast("array<int>"))
    grams = texts.withColumn("c", chars).select("s", "n", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("c", i, q), ""))).alias("gram"))
    counted = grams.groupBy("s", "n", "gram").count()
    return counted.select("s", "n", F.explode(F.transform(F.sequence(F.lit(1), F.col("count").cast("int")), lambda k: F.struct(F.lit(q).alias("q"), F.col("gram").alias("gram"), k.alias("k")))).alias("token"))


PAIRS = 1_000_000  # pairs of one n-gram's two lists that one task compares, where the golds' list can be split so far
MAPS = 4  # 64-bit numbers that hold the characters of a text


def _maps(text: Column) -> list[Column]:
    """Bits of a text's characters, numbered where one repeats; bits that meet cancel out, so that texts differ in no more bits than characters.

    Made once a text. A pair compares a few numbers: one count for each of many bins made the generated method of the join too
    large to be compiled."""
    held = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    times = lambda c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    bits = F.flatten(F.transform(held, lambda c: F.transform(F.sequence(F.lit(1), times(c)), lambda k: F.pmod(F.xxhash64(c, k), F.lit(64 * MAPS)).cast("int"))))
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x % 64)
    of = lambda i: F.filter(bits, lambda x: F.floor(x / 64) == i)
    return [F.aggregate(of(i), F.lit(0).cast("long"), lambda m, x: m.bitwiseXOR(bit(x))) for i in range(MAPS)]


def _most_edits(at_least: float) -> Column:
    """Most edits of a pair of lengths ``ng`` and ``np`` that is similar enough."""
    return F.floor(F.greatest("ng", "np") * (1 - at_least + 1e-9)).cast("int")


def candidates(golds: DataFrame, preds: DataFrame, at_least: float, most: int = LIST) -> DataFrame:
    """(p, g, ng, np) of distinct texts (column ``s`` of each side) and their lengths that pass the length, n-gram and character filters.

    A pair comes once for each n-gram that its texts list in common: what follows is made in the task that meets them,
    where pairs are far too many to move.

    d edits destroy at most 2d pairs of characters, so of a text's pairs, rarest first, one of the first 2k + 1 is shared
    with any text within its k edits.  Texts too short for that use single characters, of which k + 1 suffice.
    The last filter compares characters: an edit takes one away and brings one, or does one of both where lengths differ.
    No pair of similarity ``at_least`` or more is lost.
    """
    if not 2 / 3 < at_least <= 1:
        raise ValueError("at_least must be above 2/3 and at most 1")
    short = _short_limit(at_least)
    sides = {}
    for name, side in (("g", golds), ("p", preds)):
        sized = side.select("s").withColumn("n", F.length("s"))
        near_short = sized.filter(F.col("n") <= int(short / at_least + 1e-9) + 1)
        sides[name] = _tokens(sized.filter(F.col("n") > short), 2).unionAll(_tokens(near_short, 1))
    common = sides["g"].unionAll(sides["p"]).groupBy("token").agg(F.count(F.lit(1)).alias("f"))
    heads = {}
    for name, tokens in sides.items():
        rarest = tokens.join(common, "token").groupBy("s", "n").agg(F.array_sort(F.collect_list(F.struct("f", "token"))).alias("l"))
        of = lambda q: F.slice(F.filter("l", lambda x: x["token"]["q"] == q), 1, q * _edits(F.col("n"), at_least) + 1)
        texts = rarest.select("s", "n", *[m.alias(f"m{i}") for i, m in enumerate(_maps(F.col("s")))], F.concat(of(1), of(2)).alias("l"))
        head = texts.select(F.col("s").alias(name), *[F.col(c).alias(f"{c}{name}") for c in ("n", *[f"m{i}" for i in range(MAPS)])], F.explode("l").alias("h"))
        heads[name] = cut_lineage(head.withColumn("token", F.xxhash64("h.token")).drop("h"))
    lists = [heads[name].groupBy("token").agg(F.count(F.lit(1)).alias(f"in_{name}")) for name in ("g", "p")]
    # a list of golds is split by its own length, and further where very many predictions meet it
    by_pairs = F.least("in_g", F.ceil(F.col("in_g") * F.col("in_p") / PAIRS)) * most
    sizes = lists[0].join(lists[1], "token").select("token", F.greatest(F.col("in_g"), by_pairs).alias("n"))
    met = meet(heads["p"], heads["g"], ["token"], "g", sizes, most, placed=True)
    apart = F.abs(F.col("ng") - F.col("np"))
    differ = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"m{i}g").bitwiseXOR(F.col(f"m{i}p"))) for i in range(MAPS)])
    return met.filter(differ <= 2 * _most_edits(at_least) - apart).select("p", "g", "ng", "np")


def best_gold(golds: DataFrame, preds: DataFrame, gold: str, pred: str, at_least: float = 0.8, most: int = LIST) -> DataFrame:
    """(pred, gold, similarity) for each distinct prediction: its most similar gold, the smallest text among equals.

    Null where no gold reaches ``at_least`` (1 - edits / longer length, as ``levenshtein_similarity``).  Null texts take
    no part; empty texts match only each other.
    """
    g = golds.select(F.col(gold).alias("s")).filter(F.col("s").isNotNull()).distinct()
    p = preds.select(F.col(pred).alias("s")).filter(F.col("s").isNotNull()).distinct()
    blank = g.filter("s = ''").select(F.col("s").alias("p"), F.struct(F.lit(-1.0).alias("v"), F.col("s").alias("g")).alias("b"))
    best, left = [blank], p.filter("s <> ''")
    # a prediction with a very near gold needs no farther one, and very near ones share rarer n-grams
    for bound in sorted({(1 + at_least) / 2, at_least}, reverse=True):
        near = candidates(g.filter("s <> ''"), left, bound, most)
        d = F.call_function("levenshtein", "g", "p", _most_edits(bound))  # -1 if there are more
        scored = near.select("p", "g", d.alias("d"), (1 - d / F.greatest("ng", "np")).alias("v")).filter("d >= 0")
        found = cut_lineage(scored.groupBy("p").agg(F.min(F.struct((-F.col("v")).alias("v"), "g")).alias("b")))
        best.append(found)
        left = left.join(found, left["s"] == found["p"], "left_anti")
    best = reduce(DataFrame.unionAll, best)
    out = p.join(best, p["s"] == best["p"], "left")
    return out.select(F.col("s").alias(pred), F.col("b.g").alias(gold), (-F.col("b.v")).alias("similarity"))
