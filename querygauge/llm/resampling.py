"""Target-distribution importance resampling.

Every feature (a run of words) falls into a hashed bucket. A bucket's gain is the log of its share in the target over its
share in the corpus; a document's weight is the mean gain of its features, read from one array of gains; its score is the
weight plus Gumbel noise from a hash of its id, so that the highest scores are a draw without replacement in proportion
to the weights.

Exact ranks come from parallel sorting by regular sampling: each partition of the scored table is a run, sorted
locally; rows at regular places of the runs give the splitters; rows are exchanged into the segments between splitters,
each segment is sorted locally, and the counts of the segments before it turn places into ranks. Segments
behind the last drawn rank are counted but never exchanged. The key ends in a row number, so that equal
scores and ids (repeated rows, a third of them even) still spread over segments.

What reaches the driver: ``buckets`` counts of each side, about ``segments * per_run`` sampled keys (and one for each
run at most), and ``segments`` counts.

Defined results: a null or empty text has no feature, weight 0, and is drawn only if ``least_words`` is 0; a null id is hashed as an
empty one and comes last among ties; repeated rows are ranked one after another; an empty corpus or target gives no
counts (gains then follow from smoothing alone). Columns other than id and text are not read, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from querygauge.llm.byte_runs import byte_set, crc_of_runs, joined, runs
from querygauge.llm.common import slices, text_or_empty
from querygauge.session import scratch_path

WORD = byte_set("09az")
WORD[0x80:] = True
LOWERED = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def features(column: pa.Array, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every feature its text's place and its crc32; for every text its number of words."""
    starts, data = joined(column)
    data = LOWERED[data]
    inside = WORD[data]
    first, last = runs(inside)
    doc = np.searchsorted(starts, first, side="right") - 1
    n = np.bincount(doc, minlength=len(column))
    if n_words > 1:  # words with one space behind each: a feature is then one stretch of bytes
        kept = inside.copy()
        kept[last] = True
        data = np.where(inside, data, np.uint8(32))[kept]
        first, last = runs(data != 32)
    docs, hashes = [], []
    for k in range(min(n_words, len(first))):
        one_text = doc[: len(doc) - k] == doc[k:]
        docs.append(doc[: len(doc) - k][one_text])
        hashes.append(crc_of_runs(data, first[: len(first) - k][one_text], last[k:][one_text]))
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *docs]), np.concatenate([none, *hashes]), n


def bucket_counts(texts: DataFrame, text: Column, n_words: int, buckets: int) -> np.ndarray:
    """Features of all texts in each bucket; a task sends its counts once."""

    def count(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, part in slices(batch.column(0)):
                total += np.bincount(features(part, n_words)[1] % buckets, minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(total[hit], pa.int64())], names=["bucket", "n"])

    counted = texts.select(text_or_empty(text).alias("t")).mapInArrow(count, "bucket BIGINT, n BIGINT")
    out = np.zeros(buckets, dtype=np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    n, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    ratio = ((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)) for s, t in zip(corpus.tolist(), target.tolist()))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], dtype=np.int64)


def weights(docs: DataFrame, doc_id: Column, text: Column, gain: np.ndarray, n_words: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row."""
    buckets = len(gain)

    def weigh(batches):
        for batch in batches:
            for at, part in slices(batch.column(1)):
                doc, crc, words = features(part, n_words)
                n = np.bincount(doc, minlength=len(part))
                total = np.bincount(doc, weights=gain[crc % buckets], minlength=len(part)).astype(np.int64)  # whole numbers far below 2 ** 53
                mean = np.floor_divide(total, np.maximum(n, 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), *(pa.array(x, pa.int64()) for x in (words, n, mean))], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(doc_id.cast("bigint").alias("doc_id"), text_or_empty(text).alias("t"))
    return rows.mapInArrow(weigh, "doc_id BIGINT, n_words BIGINT, n_features BIGINT, weight BIGINT")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("bigint")


# --- ranks by regular sampling ------------------------------------------------------------------

_KEY = ("k0", "k1", "k2")  # score falling, id rising with null last, row number
_LARGEST = (1 << 63) - 1


def _columns(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(name).to_numpy() for name in _KEY], axis=1)


def segment_of(keys: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """Number of splitters that are not behind each key: a binary search over all keys at once."""
    low, high = np.zeros(len(keys), dtype=np.int64), np.full(len(keys), len(splitters), dtype=np.int64)
    while True:
        open_ = low < high
        if not open_.any():
            return low
        middle = (low + high) // 2
        s = splitters[np.minimum(middle, len(splitters) - 1)]
        behind = (s[:, 0] > keys[:, 0]) | ((s[:, 0] == keys[:, 0]) & ((s[:, 1] > keys[:, 1]) | ((s[:, 1] == keys[:, 1]) & (s[:, 2] > keys[:, 2]))))
        high = np.where(open_ & behind, middle, high)
        low = np.where(open_ & ~behind, middle + 1, low)


def regular_splitters(keyed: DataFrame, n: int, segments: int, per_run: int) -> np.ndarray:
    """At most ``segments - 1`` keys that part the rows about evenly, from regular places of locally sorted runs."""
    step = max(1, n // (segments * per_run))

    def sample(batches):
        seen = 0
        for batch in batches:
            places = np.arange((-1 - seen) % step, batch.num_rows, step)  # every step-th row of the run
            seen += batch.num_rows
            yield batch.take(pa.array(places, pa.int64()))

    taken = keyed.select(*_KEY).sortWithinPartitions(*_KEY).mapInArrow(sample, "k0 BIGINT, k1 BIGINT, k2 BIGINT").collect()
    keys = np.array([tuple(r) for r in taken], dtype=np.int64).reshape(-1, 3)
    keys = keys[np.lexsort((keys[:, 2], keys[:, 1], keys[:, 0]))]
    places = np.arange(1, segments) * len(keys) // segments
    return np.unique(keys[places], axis=0) if len(keys) else keys


def ranked(scored: DataFrame, n: int, draw: int, segments: int, per_run: int) -> DataFrame:
    """The first ``draw`` of ``n`` rows in the order of the key get ``rank`` 1, 2, 3 …, the others null."""
    splitters = regular_splitters(scored, n, segments, per_run)
    names = scored.columns

    def tag(batches):
        for batch in batches:
            yield batch.append_column("segment", pa.array(segment_of(_columns(batch), splitters), pa.int64()))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in scored.schema.fields)
    tagged = scored.mapInArrow(tag, f"{fields}, segment BIGINT")
    sizes = dict(tagged.groupBy("segment").count().collect())  # at most ``segments`` rows
    spark, before, seen = scored.sparkSession, [], 0
    for segment in sorted(sizes):
        before.append((segment, seen))
        seen += sizes[segment]
    drawn = [x for x in before if x[1] < draw]
    starts = spark.createDataFrame(pa.table({"segment": pa.array([x[0] for x in drawn], pa.int64()), "before": pa.array([x[1] for x in drawn], pa.int64())}))  # at most ``segments`` rows
    last = drawn[-1][0] if drawn else -1
    place = F.row_number().over(Window.partitionBy("segment").orderBy(*_KEY)).cast("bigint")
    merged = tagged.filter(F.col("segment") <= last).withColumn("place", place).join(F.broadcast(starts), "segment")
    rank = F.col("before") + F.col("place")
    placed = merged.withColumn("rank", F.when(rank <= draw, rank)).select(*names, "rank")
    return placed.unionByName(tagged.filter(F.col("segment") > last).select(*names, F.lit(None).cast("bigint").alias("rank")))


def resampled(
    docs: DataFrame, target: DataFrame, *, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", n_words: int = 1, buckets: int = 10_000,
    percent: int = 10, least_words: int = 20, seed: int = 2024, segments: int | None = None, per_run: int = 64,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``; ``rank`` is null where a row is not drawn.

    Features are the runs of 1 to ``n_words`` words. Of the rows with ``least_words`` words or more, ``percent`` in a
    hundred are drawn. ``segments`` defaults to the session's number of shuffle partitions."""
    spark = docs.sparkSession
    segments = segments or int(spark.conf.get("spark.sql.shuffle.partitions"))
    gain = gains(bucket_counts(docs, F.col(text), n_words, buckets), bucket_counts(target, F.col(target_text), n_words, buckets))
    weighed = weights(docs, F.col(doc_id), F.col(text), gain, n_words)
    score = F.col("weight") + noise(F.col("doc_id"), seed)
    folder = scratch_path(spark, "scored")
    key = (-F.col("score"), F.coalesce("doc_id", F.lit(_LARGEST)), F.monotonically_increasing_id())
    weighed.withColumn("score", score).select("*", *[c.alias(name) for c, name in zip(key, _KEY)]).write.parquet(folder)  # scored once; the rows keep their numbers
    scored = spark.read.parquet(folder)
    fit = scored.filter(F.col("n_words") >= least_words)
    n = fit.count()
    rows = ranked(fit, n, n * percent // 100, segments, per_run)
    rest = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint"))
    return rows.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")



#: DuckDB SQL. Every word's crc32 is folded byte by byte over a table made from the polynomial.
SQL = r"""
WITH RECURSIVE crc_bits(b, k, v) AS (
  SELECT range, 0, range::BIGINT FROM range(256)
  UNION ALL
  SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END FROM crc_bits WHERE k < 8
),
crc_table AS (SELECT list(v ORDER BY b) AS t FROM crc_bits WHERE k = 8),
tokens AS (
  SELECT row_number() OVER () AS row_id, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
),
of_target AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM benchmark
),
of_corpus AS (SELECT row_id, w, count(*) AS n FROM (SELECT row_id, unnest(ws) AS w FROM tokens) GROUP BY row_id, w),
words AS (SELECT w FROM of_corpus UNION SELECT w FROM of_target),
hashed AS (
  SELECT w, xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(encode(w))), lambda k: ('0x' || substr(hex(encode(w)), 2 * k + 1, 2))::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 10000 AS bucket
  FROM words, crc_table
),
s AS (SELECT bucket, sum(n) AS s FROM of_corpus JOIN hashed USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM of_target JOIN hashed USING (w) GROUP BY bucket),
gain AS (
  SELECT s.bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE / ((s + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS g
  FROM s LEFT JOIN t USING (bucket)
),
weighed AS (
  SELECT k.row_id, any_value(k.doc_id) AS doc_id, any_value(len(k.ws))::BIGINT AS n_features, coalesce(floor(sum(c.n * g) / sum(c.n)), 0)::BIGINT AS weight
  FROM tokens k LEFT JOIN of_corpus c USING (row_id) LEFT JOIN hashed USING (w) LEFT JOIN gain USING (bucket) GROUP BY k.row_id
),
scored AS (
  SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM weighed
),
ranked AS (SELECT row_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= n * 10 // 100 THEN place END AS rank FROM scored LEFT JOIN ranked USING (row_id)
"""
