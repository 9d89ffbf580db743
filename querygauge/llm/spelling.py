"""Spelling variants by composing finite-state machines: vocabulary, one edit, vocabulary.

The words of a group are made into the smallest acceptor of them. Composed with a transducer that inserts, deletes or
replaces exactly one code point, and with the acceptor again, it accepts the pairs of words one edit apart. The
transducer is unambiguous: it edits at the first place where the words differ (behind an inserted code point the next one
is another), so each pair has one path.

The composed machine is split by initial state. A state before the edit is a pair of equal states, that is, a prefix both words share:
words of c code points (and of c + 1, as the longer side) meet by their first c // 2 code points in a machine
that edits behind them, and by their last c - c // 2 in a machine over reversed words. One of the two halves is
shared whatever the edit; pairs that share the first are left to the forward machine. A group of more than ``most`` words
is split along the arcs of its initial state: into the states behind each next code point, and into the words that
agree once this code point is deleted, which are no more than the alphabet has letters. So no group outgrows a
task, and no pair is lost; only pairs one edit apart are ever listed.

Defined results: null and empty texts have no word; a null id counts as an empty one; rows that repeat count each time;
an empty table gives an empty result. Columns other than id and text are not read, whatever their names.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from querygauge.llm.byte_runs import byte_set, crc_of_runs, joined, runs, texts_at
from querygauge.llm.common import slices, text_or_empty
from querygauge.llm.resampling import LOWERED
from querygauge.session import scratch_path

LETTER = byte_set("AZaz")
LEAD = 0xC3  # first byte of U+00C0 to U+00FF in UTF-8, and of nothing else


# --- words --------------------------------------------------------------------------------------


def spelled_words(ids: list[str], column: pa.Array, least: int, every: int) -> pa.Array:
    """Lower-cased runs of letters of all texts with ``least`` code points or more, after the deletions.

    A run whose hash with its text's id is divisible by ``every`` loses one code point; a run of a single one is then empty."""
    starts, data = joined(column)
    data = LOWERED[data]
    lead = data == LEAD
    inside = LETTER[data] | lead
    inside[1:] |= lead[:-1]
    first, last = runs(inside)
    leads = np.concatenate([[0], np.cumsum(lead)])
    length = last - first - (leads[last] - leads[first])
    long_enough = length >= least
    first, last, length = first[long_enough], last[long_enough], length[long_enough]
    doc = np.searchsorted(starts, first, side="right") - 1
    before = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], dtype=np.uint32)
    h = crc_of_runs(data, first, last, before[doc]).astype(np.int64)
    cut = np.flatnonzero(h % every == 0)
    if not len(cut):
        return texts_at(data, first, last)
    opens = (data & 0xC0) != 0x80  # first bytes of code points
    places, seen = np.flatnonzero(opens), np.cumsum(opens)
    dropped = places[seen[first[cut]] - 1 + h[cut] % length[cut]]
    keep = np.ones(len(data), dtype=bool)
    keep[dropped] = False
    keep[dropped[lead[dropped]] + 1] = False
    made = length.copy()
    made[cut] -= 1
    chosen = made >= least
    return texts_at(data, first[chosen], last[chosen], keep)


def vocabulary(docs: DataFrame, doc_id: Column, text: Column, least: int, every: int, at_least: int) -> DataFrame:
    """(word, n): a task counts within its batches, equal words are added up before they are exchanged."""

    def count(batches):
        for batch in batches:
            for at, part in slices(batch.column(1)):
                ids = batch.column(0).slice(at, len(part)).to_pylist()
                counts = pc.value_counts(spelled_words(ids, part, least, every))
                yield pa.RecordBatch.from_arrays([counts.field("values").cast(pa.string()), counts.field("counts")], names=["word", "n"])

    rows = docs.select(F.coalesce(doc_id.cast("string"), F.lit("")).alias("i"), text_or_empty(text).alias("t"))
    return rows.mapInArrow(count, "word STRING, n BIGINT").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= at_least)


# --- machines -----------------------------------------------------------------------------------


class Acceptor:
    """Smallest deterministic acceptor of sorted, different words; state 0 is the initial one."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = [{}]
        self.final = [False]
        known: dict[tuple, int] = {}
        path, previous = [0], ""

        def settle(depth: int) -> None:
            """Replace the states of the last word below ``depth`` by equal known ones, deepest first."""
            while len(path) > depth + 1:
                state, symbol = path.pop(), previous[len(path) - 1]
                form = (self.final[state], *self.arcs[state].items())
                self.arcs[path[-1]][symbol] = known.setdefault(form, state)

        for word in words:
            shared = next((i for i, (a, b) in enumerate(zip(word, previous)) if a != b), min(len(word), len(previous)))
            settle(shared)
            for symbol in word[shared:]:
                self.arcs.append({})
                self.final.append(False)
                self.arcs[path[-1]][symbol] = len(self.arcs) - 1
                path.append(len(self.arcs) - 1)
            self.final[path[-1]] = True
            previous = word
        settle(0)


def _spell(path: tuple | None) -> str:
    out = []
    while path is not None:
        path, symbol = path
        out.append(symbol)
    return "".join(reversed(out))


def _common(a: Acceptor, q: int, r: int, but: str | None = None) -> Iterator[str]:
    """Words accepted from both states: the composed machine behind the edit. ``but`` may not come first."""
    stack = [(q, r, None)]
    while stack:
        q, r, path = stack.pop()
        if a.final[q] and a.final[r]:
            yield _spell(path)
        here, there = a.arcs[q], a.arcs[r]
        for symbol in here.keys() & there.keys():
            if path is not None or symbol != but:
                stack.append((here[symbol], there[symbol], (path, symbol)))


def one_edit_pairs(a: Acceptor, low: int, high: int | None) -> Iterator[tuple[str, str]]:
    """Unordered pairs of accepted words that first differ at a place from ``low`` to before ``high``, by one edit."""
    stack = [(0, 0, None)]
    while stack:
        state, depth, path = stack.pop()
        arcs = a.arcs[state]
        if depth >= low and arcs:
            shared = None
            for (x, q), (y, r) in itertools.combinations(arcs.items(), 2):
                for rest in _common(a, q, r):
                    shared = _spell(path) if shared is None else shared
                    yield shared + x + rest, shared + y + rest
            for x, q in arcs.items():
                for rest in _common(a, state, q, but=x):
                    shared = _spell(path) if shared is None else shared
                    yield shared + rest, shared + x + rest
        if high is None or depth + 1 < high:
            for symbol, q in arcs.items():
                stack.append((q, depth + 1, (path, symbol)))


def _group_pairs(words: list[str], low: int, high: int | None) -> Iterator[tuple[str, str]]:
    """Pairs of a group. What all its words share in front is read once, as one initial state."""
    first, last = words[0], words[-1]  # sorted: what these share, all share
    shared = next((i for i, (a, b) in enumerate(zip(first, last)) if a != b), min(len(first), len(last)))
    if high is not None and shared >= high:
        return
    for x, y in one_edit_pairs(Acceptor([w[shared:] for w in words]), max(0, low - shared), None if high is None else high - shared):
        yield first[:shared] + x, first[:shared] + y


# --- groups -------------------------------------------------------------------------------------


def initial_states(words: DataFrame, least: int) -> DataFrame:
    """Rows (key, c, back, low, high, m, n): each word in the groups of its length and of the length below, m reversed if ``back``."""
    length = F.length("word")
    classes = F.filter(F.array(length, length - 1), lambda c: c >= least)
    rows = words.select("word", "n", F.explode(classes).alias("c"))
    half = F.floor(F.col("c") / 2).cast("int")
    forward = F.struct(F.lit(False).alias("back"), half.alias("low"), F.col("word").alias("m"))
    backward = F.struct(F.lit(True).alias("back"), (F.col("c") - half).alias("low"), F.reverse("word").alias("m"))
    rows = rows.select("c", "n", F.explode(F.array(forward, backward)).alias("x")).select("c", "n", "x.*")
    key = F.xxhash64("c", "back", F.substring(F.col("m"), F.lit(1), F.col("low")))
    return rows.select(key.alias("key"), "c", "back", "low", F.lit(None).cast("int").alias("high"), "m", "n")


def split_large(groups: DataFrame, most: int) -> DataFrame:
    """Groups of at most ``most`` words (an alphabet's worth, where the edit's place is fixed), with the same pairs."""
    done = None
    while True:
        sizes = groups.filter(F.col("high").isNull()).groupBy("key").count().filter(F.col("count") > most).select("key")
        if sizes.isEmpty():
            return groups if done is None else done.unionByName(groups)
        spark, folder = groups.sparkSession, scratch_path(groups.sparkSession, "large-groups")
        sizes.write.parquet(folder)
        large = spark.read.parquet(folder)
        small = groups.join(large, "key", "left_anti")
        done = small if done is None else done.unionByName(small)
        low, m = F.col("low"), F.col("m")
        step, rest = F.substring(m, low + 1, F.lit(1)), F.substring(m, low + 2, F.length(m))
        shared = F.substring(m, F.lit(1), low)

        def row(kind: str, state: Column, new_low: Column, high: Column) -> Column:
            return F.struct(F.xxhash64("key", F.lit(kind), state).alias("key"), new_low.alias("low"), high.alias("high"))

        onwards = F.when(F.length(m) > low, row("next", step, low + 1, F.lit(None).cast("int")))
        deleted = F.when(F.length(m) > low, row("edit", F.concat(shared, rest), low, low + 1))
        whole = row("edit", m, low, low + 1)
        split = groups.join(large, "key", "left_semi").select("c", "back", "m", "n", F.explode(F.array_compact(F.array(onwards, deleted, whole))).alias("x"))
        groups = split.select("x.key", "c", "back", "x.low", "x.high", "m", "n")
        folder = scratch_path(spark, "split-groups")
        groups.write.parquet(folder)
        groups = spark.read.parquet(folder)


_GROUP = ["key", "c", "back", "low", "high"]


def _found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each word of a group its number of near words there, and the best of them; rows come sorted by group and word."""
    kept: list[tuple] = []

    def near_words(group: tuple, rows: list[tuple]) -> Iterator[tuple[str, int, int, str]]:
        _, c, back, low, high = group
        count = dict(rows)
        best: dict[str, tuple[int, int, str]] = {}
        for x, y in _group_pairs(sorted(count), int(low), None if high is None else int(high)):
            if min(len(x), len(y)) != c:
                continue
            nx, ny = count[x], count[y]
            if back:
                x, y = x[::-1], y[::-1]
                if x[: c // 2] == y[: c // 2]:  # the forward machine has this pair
                    continue
            for a, b, nb in ((x, y, ny), (y, x, nx)):
                n, most, form = best.get(a, (0, 0, ""))
                best[a] = (n + 1, nb, b) if (-nb, b) < (-most, form) else (n + 1, most, form)
        return ((w, *v) for w, v in best.items())

    def out(group: tuple | None) -> list[tuple]:
        return list(near_words(group, kept)) if group is not None and len(kept) > 1 else []

    current, rows = None, []
    for frame in frames:
        high = [None if h != h else h for h in frame["high"].tolist()]
        for key, c, back, low, h, m, n in zip(frame["key"].tolist(), frame["c"].tolist(), frame["back"].tolist(), frame["low"].tolist(), high, frame["m"].tolist(), frame["n"].tolist()):
            group = (key, c, back, low, h)
            if group != current:
                rows += out(current)
                current, kept = group, []
            kept.append((m, n))
        if rows:
            yield pd.DataFrame(rows, columns=["word", "n_near", "form_n", "form"])
            rows = []
    rows = out(current)
    if rows:
        yield pd.DataFrame(rows, columns=["word", "n_near", "form_n", "form"])


def near_words(words: DataFrame, least: int, most: int) -> DataFrame:
    """(word, n_near, form_n, form) of the words that have a near word; ``form`` is the one of largest count, then the smallest."""
    groups = split_large(initial_states(words, least), most)
    found = groups.repartition("key").sortWithinPartitions(*_GROUP, "m").mapInPandas(_found, "word STRING, n_near BIGINT, form_n BIGINT, form STRING")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("k"), "form")).alias("b"))
    return best.select("word", "n_near", (-F.col("b.k")).alias("form_n"), F.col("b.form").alias("form"))


def roots(formed: DataFrame, steps: int) -> DataFrame:
    """(word, root) of words with a form; ``steps`` doublings follow 2 ** steps forms."""
    spark, to = formed.sparkSession, formed.select("word", F.col("form").alias("root"))
    for _ in range(steps):
        further = to.select(F.col("word").alias("root"), F.col("root").alias("further"))
        folder = scratch_path(spark, "roots")
        to.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")).write.parquet(folder)
        to = spark.read.parquet(folder)
    return to


def variants(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = 7, every: int = 31, at_least: int = 2, times: int = 10, most: int = 20_000) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``least`` code points and ``at_least`` occurrences.

    ``form`` is the most frequent word one edit away, if ``times`` as frequent or more; ``root`` the end of the forms."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "vocabulary")
    vocabulary(docs, F.col(doc_id), F.col(text), least, every, at_least).write.parquet(folder)
    words = spark.read.parquet(folder)
    judged = words.join(near_words(words, least, most), "word", "left").withColumn("is", F.coalesce(F.col("form_n") >= times * F.col("n"), F.lit(False)))
    folder = scratch_path(spark, "judged")
    judged.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *[F.when(F.col("is"), F.col(c)).alias(c) for c in ("form", "form_n")]).write.parquet(folder)
    judged = spark.read.parquet(folder)
    largest = judged.agg(F.max("n")).first()[0] or at_least
    longest = max(1, math.floor(math.log(max(1.0, largest / at_least), times) + 1e-9))  # forms in a row: each is ``times`` as frequent
    steps = math.ceil(math.log2(longest))
    ends = roots(judged.filter(F.col("form").isNotNull()), steps)
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")



#: DuckDB SQL: pairs share a word once one code point is deleted.
SQL = r"""
WITH RECURSIVE crc_bits(b, k, v) AS (
  SELECT range, 0, range::BIGINT FROM range(256)
  UNION ALL
  SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END FROM crc_bits WHERE k < 8
),
crc_table AS (SELECT list(v ORDER BY b) AS t FROM crc_bits WHERE k = 8),
found AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS i,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS w
  FROM documents
),
counted AS (SELECT i, w, i || ':' || w AS s, count(*) AS n FROM found WHERE length(w) >= 7 GROUP BY i, w),
hashed AS (
  SELECT w, n, xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(encode(s))), lambda k: ('0x' || substr(hex(encode(s)), 2 * k + 1, 2))::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS h
  FROM counted, crc_table
),
spelled AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS w, n FROM hashed),
words AS MATERIALIZED (SELECT w, sum(n)::BIGINT AS n FROM spelled WHERE length(w) >= 7 GROUP BY w HAVING sum(n) >= 2),
deleted AS MATERIALIZED (SELECT w, n, p, substr(w, 1, p) || substr(w, p + 2) AS d FROM (SELECT w, n, unnest(range(0, length(w)::BIGINT)) AS p FROM words)),
near AS (
  SELECT a.w, b.w AS o, b.n AS m FROM deleted a JOIN deleted b ON a.p = b.p AND a.d = b.d AND a.w <> b.w
  UNION
  SELECT a.w, b.w, b.n FROM words a JOIN deleted b ON a.w = b.d
  UNION
  SELECT b.w, a.w, a.n FROM words a JOIN deleted b ON a.w = b.d
),
best AS (SELECT w, count(*)::BIGINT AS n_near, max(m) AS m, arg_min(o, (-m, o)) AS o FROM near GROUP BY w),
judged AS MATERIALIZED (SELECT words.w, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 10 * n THEN o END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM words LEFT JOIN best USING (w)),
chain AS (
  SELECT w, w AS tip FROM judged
  UNION ALL
  SELECT c.w, j.form FROM chain c JOIN judged j ON j.w = c.tip WHERE j.form IS NOT NULL
),
ends AS (SELECT c.w, c.tip FROM chain c JOIN judged j ON j.w = c.tip WHERE j.form IS NULL)
SELECT w AS word, form, tip AS root, n, n_near, form_n FROM judged JOIN ends USING (w)
"""
