"""Pair scoring on text.  Columns where one row is enough, one shuffle where it is not."""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType

from querygauge.functions.extract import collapse, normalise_answer, words
from querygauge.operators.placement import spread

_NUMBER = r"^\+?\d+(e\+?\d+)?$|^\+?inf(inity)?$"


def exact_match(gold: Column, pred: Column) -> Column:
    """1 when the normalised answers agree, as numbers if both are numbers; a missing prediction is an empty one."""
    g, p = normalise_answer(gold), normalise_answer(F.coalesce(pred, F.lit("")))
    as_number = lambda t: F.replace(F.regexp_replace(t, r"^\+?inf(inity)?$", "Infinity"), F.lit("+"), F.lit("")).try_cast("double")
    numeric = g.rlike(_NUMBER) & p.rlike(_NUMBER)
    nan = r"^\+?nan$"
    return F.when(numeric, as_number(g) == as_number(p)).when(g.rlike(nan) & p.rlike(nan), F.lit(False)).otherwise(g == p).cast("int")


def contains_match(gold: Column, pred: Column) -> Column:
    return F.contains(F.lower(F.coalesce(pred, F.lit(""))), F.lower(gold)).cast("int")


# --- longest common subsequence -----------------------------------------------------------------


def _lcs_length(a: list[str], b: list[str]) -> int:
    """Bit-parallel longest common subsequence: one big-integer step per word of ``b``."""
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & where.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(DoubleType())
def _rouge_l(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for gold, pred in batches:
        out = []
        for g, p in zip(gold, pred):
            common = _lcs_length(g, p) if len(g) and len(p) else 0
            out.append(2.0 * common / (len(g) + len(p)) if common else 0.0)
        yield pd.Series(out, dtype="float64")


def rouge_l(gold: Column, pred: Column) -> Column:
    """F1 of the longest common word subsequence; whole texts, any length. Words are those of the other text scores."""
    own = lambda t: words(F.lower(F.coalesce(t, F.lit(""))))
    return _rouge_l(own(gold), own(pred))


# --- n-grams ------------------------------------------------------------------------------------


def grams(text_words: Column, n: int) -> Column:
    """All n-grams of a word array as blank-joined text."""
    last = F.size(text_words) - (n - 1)
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(text_words, i, n), " "))


def ngram_profile(texts: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(key, gram, count); texts move once, by key, and are counted where they arrive: grams, far larger, do not move."""
    w = spread(texts.select(key, text), key).select(key, words(F.lower(F.col(text))).alias("_w"))
    return w.select(key, F.explode(grams(F.col("_w"), n)).alias("gram")).groupBy(key, "gram").count()


def _clipped_hits(gold: list[list[str]], pred: list[list[str]]) -> list[int]:
    """Clipped counts of the 1- to 4-grams that two lists of texts share."""
    sides = [[list(map(sys.intern, w)) for w in side] for side in (gold, pred)]
    out = []
    for n in range(1, 5):
        g, p = (Counter(x for w in side for x in (zip(*(w[i:] for i in range(n))) if n > 1 else w)) for side in sides)
        out.append(sum(min(c, g[x]) for x, c in p.items() if x in g))
        if not out[-1]:  # without a shared gram there is no longer one
            return out + [0] * (4 - n)
    return out


@F.pandas_udf(ArrayType(LongType()))
def _hits(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for gold, pred in batches:
        yield pd.Series([_clipped_hits([g], [p]) for g, p in zip(gold, pred)], dtype=object)


def bleu4(pairs: DataFrame, key: str = "pair_id", gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Clipped 1-4-gram precision with brevity penalty, as (key, bleu).

    The pairs move once, by key, as plain text.  Grams of a pair are counted inside its row; rows that share key and
    both lengths count together, as one pair, and only their grams become rows.
    """
    placed = spread(pairs.select(key, gold, pred), key)
    w = placed.select(key, words(F.lower(F.col(gold))).alias("_g"), words(F.lower(F.col(pred))).alias("_p"))
    w = w.select(key, F.size("_g").alias("ref"), F.size("_p").alias("gen"), "_g", "_p")
    w = w.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key, "ref", "gen")))
    own = F.when((F.col("_n") == 1) & (F.col("ref") > 0) & (F.col("gen") > 0), F.lit(True)).otherwise(False)
    alone = w.filter(own).withColumn("_h", _hits("_g", "_p")).select(key, "ref", "gen", *[F.col("_h")[n - 1].alias(f"hit{n}") for n in range(1, 5)])

    def entries(n: int, side: str, is_pred: int) -> Column:
        return F.transform(grams(F.col(side), n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram"), F.lit(is_pred).alias("p")))

    of_all = F.flatten(F.array(*[entries(n, side, is_pred) for n in range(1, 5) for side, is_pred in (("_g", 0), ("_p", 1))]))
    rows = w.filter(~own).select(key, "ref", "gen", F.explode_outer(of_all).alias("x")).select(key, "ref", "gen", "x.*")
    counted = rows.groupBy(key, "ref", "gen", "n", "gram").agg(F.count_if(F.col("p") == 1).alias("cp"), F.count_if(F.col("p") == 0).alias("cg"))
    hits = [F.sum(F.when(F.col("n") == n, F.least("cp", "cg")).otherwise(0)).alias(f"hit{n}") for n in range(1, 5)]
    sums = alone.unionByName(counted.groupBy(key, "ref", "gen").agg(*hits))
    logs = [F.when(F.col(f"hit{n}") > 0, F.log(F.col(f"hit{n}") / (F.col("gen") - (n - 1)))).otherwise(F.log(F.lit(1e-7))) for n in range(1, 5)]
    penalty = F.when(F.col("gen") > 0, F.least(F.lit(1.0), F.exp(1 - F.col("ref") / F.nullif(F.col("gen"), F.lit(0))))).otherwise(0.0)
    return sums.select(key, (penalty * F.exp((logs[0] + logs[1] + logs[2] + logs[3]) / 4)).alias("bleu"))


# --- character sequences ------------------------------------------------------------------------


_GRID = 1 << 20  # cells (length times length) up to which a pair is matched as bits of one number
_POPULAR = 200  # from this length of the second text on, the matcher leaves out its frequent characters


def _longest(x: str, y: str) -> tuple[int, int, int] | None:
    """(size, start in x, start in y) of the longest common block, the first in ``x``, then in ``y``; None if it has too many places.

    A block of ``2 * step - 1`` characters holds a whole piece of ``step`` characters of ``x`` that starts at a multiple of
    ``step``, so once one that long was found from such pieces, all longer ones were."""
    n, m = len(x), len(y)
    step, places = max(1, min(n, m) // 4), n + m
    while True:
        size, at, to, seen = 0, 0, 0, {}
        for k in range(0, n - step + 1, step):
            piece = x[k : k + step]
            j = y.find(piece)
            while j >= 0:
                if seen.get(j - k, -1) <= k:
                    places -= 1
                    if places < 0:
                        return None
                    p, q, by = k + step, j + step, step
                    while by:
                        if p + by <= n and q + by <= m and x[p : p + by] == y[q : q + by]:
                            p, q = p + by, q + by
                        else:
                            by >>= 1
                    i, o, by = k, j, step
                    while by:
                        if i >= by and o >= by and x[i - by : i] == y[o - by : o]:
                            i, o = i - by, o - by
                        else:
                            by >>= 1
                    seen[j - k] = p
                    if p - i > size or p - i == size and (i, o) < (at, to):
                        size, at, to = p - i, i, o
                j = y.find(piece, j + 1)
        if size >= 2 * step - 1 or step == 1:
            return size, at, to
        step = (size + 1) // 2 or step // 3 or 1


def _matched(a: str, b: str) -> int:
    """Characters in the matching blocks of ``SequenceMatcher(None, a, b)``, for ``b`` shorter than ``_POPULAR``.

    Where a block has many places, bit (i, j) of a number says that characters i and j are equal; shifted by a row and a column and met with itself,
    it says where runs of two, of four … start.  The lowest bit of the longest runs is the block the matcher takes.
    """
    total, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        if alo >= ahi or blo >= bhi:
            continue
        if ahi - alo == 1 or bhi - blo == 1:
            total += a[alo] in b[blo:bhi] if ahi - alo == 1 else b[blo] in a[alo:ahi]
            continue
        first, second = a[alo:ahi], b[blo:bhi]
        shared = set(first).intersection(second)
        if not shared:
            continue
        if block := _longest(first, second):
            size, i, j = block
            total += size
            todo += [(alo, alo + i, blo, blo + j), (alo + i + size, ahi, blo + j + size, bhi)]
            continue
        wide = (bhi - blo) // 8 + 1  # bytes of a row: one bit at least is free, so no run goes on in the next row
        rows = dict.fromkeys(first, bytes(wide))
        for c in shared:
            row, j = 0, second.find(c)
            while j >= 0:
                row |= 1 << j
                j = second.find(c, j + 1)
            rows[c] = row.to_bytes(wide, "little")
        runs, step = int.from_bytes(b"".join([rows[c] for c in first]), "little"), wide * 8 + 1
        powers = [runs]  # where runs of 1, 2, 4 … start
        while longer := powers[-1] & (powers[-1] >> (step << (len(powers) - 1))):
            powers.append(longer)
        size = 1 << (len(powers) - 1)
        best = powers.pop()
        while powers:
            more = 1 << (len(powers) - 1)
            if longer := best & (powers.pop() >> (step * size)):
                best, size = longer, size + more
        i, j = divmod((best & -best).bit_length() - 1, step - 1)
        total += size
        todo += [(alo, alo + i, blo, blo + j), (alo + i + size, ahi, blo + j + size, bhi)]
    return total


def _ratio(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    if len(b) >= _POPULAR or len(a) * len(b) > _GRID:
        return SequenceMatcher(None, a, b).ratio()
    return 2.0 * _matched(a, b) / (len(a) + len(b))


@F.pandas_udf(DoubleType())
def _sequence_ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for first, second in batches:
        yield pd.Series([_ratio(a or "", b or "") for a, b in zip(first, second)], dtype="float64")


def sequence_ratio(gold: Column, pred: Column, pred_first: bool = False) -> Column:
    """Matching-blocks ratio 2M/T; the order of the arguments matters and is the caller's choice."""
    return _sequence_ratio(pred, gold) if pred_first else _sequence_ratio(gold, pred)


def levenshtein_similarity(gold: Column, pred: Column) -> Column:
    """1 - edit distance / longer length; a near substitute that stays in the JVM. A missing prediction is empty."""
    pred = F.coalesce(pred, F.lit(""))
    longer = F.greatest(F.length(gold), F.length(pred))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(gold, pred) / longer)


def _characters(text: str) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)


@F.pandas_udf(DoubleType())
def _similarity_bound(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for gold, pred in batches:
        out = []
        for g, p in zip(gold, pred):
            p = p or ""
            if g is None or not g and not p:
                out.append(None if g is None else 1.0)
                continue
            (own, n), (other, m) = _characters(g), _characters(p)
            _, i, j = np.intersect1d(own, other, assume_unique=True, return_indices=True)
            out.append(2.0 * int(np.minimum(n[i], m[j]).sum()) / (len(g) + len(p)))
        yield pd.Series(out, dtype="float64")


def similarity_bound(gold: Column, pred: Column) -> Column:
    """2M/T over character counts: never below the matching-blocks ratio.  Row-local, no explode. A missing prediction is empty."""
    return _similarity_bound(gold, pred)


def clause_similarity(a: Column, b: Column, native: bool = False) -> Column:
    """Similarity of two clause texts; empty on either side gives 0."""
    x, y = collapse(F.coalesce(a, F.lit(""))), collapse(F.coalesce(b, F.lit("")))
    score = levenshtein_similarity(x, y) if native else sequence_ratio(x, y)
    empty = (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")
    return F.when(empty, F.lit(0.0)).otherwise(score)


def map_similarity(pairs: DataFrame, key: str, pred_map: str, gold_map: str, native: bool = False) -> DataFrame:
    """Mean clause similarity over the union of the keys of two keyword-to-text maps.

    The maps of a pair are matched inside its row, so only (key, text, text) rows are exploded.
    """
    pairs = spread(pairs.select(key, pred_map, gold_map), key)
    p, g = F.col(pred_map), F.col(gold_map)
    keys = F.array_union(F.map_keys(p), F.map_keys(g))
    rows = pairs.select(
        key, F.explode_outer(F.transform(keys, lambda k: F.struct(F.try_element_at(p, k).alias("p"), F.try_element_at(g, k).alias("g")))).alias("x")
    )
    scored = rows.select(key, clause_similarity(F.col("x.p"), F.col("x.g"), native).alias("v"))
    return scored.groupBy(key).agg(F.avg("v").alias("map_similarity"))


# --- scorers: pairs in, long scores out ---------------------------------------------------------


def long_scores(scored: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """Wide score columns to (key, metric, value); a missing score gives no row."""
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return scored.select(key, F.explode(entries).alias("s")).select(key, "s.metric", "s.value").filter(F.col("value").isNotNull())
