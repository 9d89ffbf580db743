"""Toxicity by weak supervision.

Voters are words of a public lexicon, text patterns, and stems: words (and, by parameter, word beginnings) that labelled
toxic rows hold far more often than other labelled rows. A generative label model (naive Bayes with a fire rate of every voter in each
class, fitted by expectation maximisation) gives every sampled row a posterior; a voter's evidence is divided by how
strongly it is correlated, within a class, with others, so that near copies of one voter do not count many times. The
given label is one more voter: it holds the classes in place while the others are fitted, then its own accuracy in each class
is estimated from the rows whose votes are sure; where many labels are wrong the votes overrule it. A logistic regression on what voters say, and on how many
strong voters speak (none, one, two, more), is trained on the posteriors and scores whole texts.

All that is learned comes from a bounded sample: the ``most_rows`` labelled ids with the smallest hash; an id counts once,
with the text of smallest hash. Ids are chosen from ids alone and broadcast, so texts are never shuffled; votes, not texts,
reach the driver. Scoring covers all rows.

Defined results: a null or empty text has no vote and gets the score of such a text; labels that are null are unknown; a row labelled
twice is toxic if one label says so; rows with a null id are scored but not learned from. Without a label of either class
the score is that of the other class (1e-13 off 0 or 1), 0 if there is no label. Other columns of the tables are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from querygauge.llm.common import letter_words, slices, text_or_empty

#: A public lexicon, and patterns (RE2) over the whole text.
LEXICON = tuple("idiot idiots moron morons stupid dumb loser losers pathetic worthless scum trash clown disgusting fool jerk creep freak filth vermin garbage hate kill idiota imbécile connard débile dummkopf arschloch trottel estúpido imbécil tonto basura".split())
PATTERNS = (r"(?i)\byou(?:'re| are) (?:an? |so |such |all )", r"[!?]{3,}", r"\b\p{Lu}{5,}\b", r"(?i)\bshut up\b", r"(?i)\bgo (?:to hell|away|die)\b", r"[*#@$%]{3,}")
SHORTEST = 4  # letters of a word that may become a voter
STEM_SIZES: tuple[int, ...] = ()  # letters of word beginnings that may vote as well; none: with 4 to 7, 13 of 870 clean held-out rows of sf0.1 were flagged
MOST_STEMS = 500
MOST_ROWS = 8_000
STRONG = 20.0  # how many times likelier a voter fires on toxic rows, by the label model, to be a strong one
START_TRUST = 0.998  # how often a given label is taken to be right while voters are fitted, and at most afterwards
SURE = 2.0  # log odds of votes that are sure enough to judge labels by
MOST_EVIDENCE = 4.0  # log odds that all votes on a row may add up to: voters are not as independent as the model has it


@dataclass(frozen=True)
class Model:
    """Words (lexicon and stems, by size; 0 is a whole word) and their voters; weights of voters (patterns last) and of
    having one, two and three strong voters; which voters are strong; bias."""

    stems: dict[tuple[int, str], int]
    weights: np.ndarray
    steps: np.ndarray
    strong: np.ndarray
    bias: float


def stem_counts(texts: DataFrame) -> DataFrame:
    """(size, stem, toxic, other): rows of each class that hold a stem; from (text, toxic). Words are those that vote."""

    def stems_of(batches):
        for b in batches:
            for at, part in slices(b.column(0)):
                first, words = letter_words(part)
                coded = words.dictionary_encode()
                names, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
                for r in range(len(part)):
                    held = [w for k in np.unique(index[first[r] : first[r + 1]]).tolist() if len(w := names[k]) >= SHORTEST]
                    found = list({(0, w) for w in held} | {(n, w[:n]) for w in held for n in STEM_SIZES if len(w) > n})
                    label = b.column(1)[at + r].as_py()
                    yield pa.RecordBatch.from_pydict({"size": pa.array([n for n, _ in found], pa.int32()), "stem": pa.array([w for _, w in found], pa.string()), "toxic": pa.array([label] * len(found), pa.int32())})

    each = texts.select(text_or_empty(F.col("text")).alias("text"), F.col("toxic").cast("int").alias("toxic")).mapInArrow(stems_of, "size int, stem string, toxic int")
    return each.groupBy("size", "stem").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("other"))


def pick_stems(counts: DataFrame, toxic: int, other: int, most: int = MOST_STEMS) -> list[tuple[int, str]]:
    """The ``most`` stems with the greatest weighted log odds, among those that are at least ten times likelier in toxic rows."""
    odds = ((F.col("toxic") + 0.5) / (toxic + 1)) / ((F.col("other") + 0.5) / (other + 1))
    strong = counts.withColumn("o", odds).filter((F.col("toxic") >= 3) & (F.col("o") >= 10))
    best = strong.withColumn("g", F.col("toxic") * F.log("o")).orderBy(F.desc("g"), "size", "stem").limit(most)
    return [(r["size"], r["stem"]) for r in best.select("size", "stem").collect()]


_SEEN: dict = {}  # of this worker: word -> its voters, for one set of stems at a time


def votes(column: pa.Array, stems: dict[tuple[int, str], int], tag: str = "") -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Parts of a text column as (first text, row, voter): which voters fire on which text, once each."""
    if _SEEN.get("tag") != tag or len(_SEEN["words"]) > 400_000:
        _SEEN.clear()
        _SEEN.update(tag=tag, words={})
    known, out = _SEEN["words"], []
    for at, part in slices(column):
        first, words = letter_words(part)
        coded = words.dictionary_encode()
        names = coded.dictionary.to_pylist()
        for w in names:
            if w not in known:
                hits = [stems.get((0, w)), *[stems.get((n, w[:n])) for n in STEM_SIZES if len(w) > n]]
                known[w] = tuple(h for h in hits if h is not None)
        rows, voters = [], []
        speaking = np.array([bool(known[w]) for w in names], bool)
        if speaking.any():
            index = coded.indices.to_numpy()
            places = np.flatnonzero(speaking[index])
            owner = np.searchsorted(first, places, side="right") - 1
            for r, k in {(r, index[p]) for r, p in zip(owner.tolist(), places.tolist())}:
                for v in known[names[k]]:
                    rows.append(r)
                    voters.append(v)
        for k, pattern in enumerate(PATTERNS):
            hit = np.flatnonzero(pc.match_substring_regex(pc.fill_null(part, ""), pattern).to_numpy(zero_copy_only=False))
            rows += hit.tolist()
            voters += [len(stems) + k] * len(hit)
        both = np.unique(np.array([rows, voters], np.int64).reshape(2, -1), axis=1)
        out.append((at, both[0], both[1]))
    return out


def label_model(said: np.ndarray, labels: np.ndarray, rounds: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of class 1 of each row, strength of each voter: its fire rates' ratio), from votes (rows x voters, 0/1) and labels (1, 0, or -1 where unknown)."""
    said = said.astype(np.float64)
    trust = np.where(labels == 1, START_TRUST, np.where(labels == 0, 1 - START_TRUST, 0.5))
    q = np.where(labels >= 0, trust, np.clip(said.mean(axis=1) * 2, 0.05, 0.95))
    of_label = np.log(trust / (1 - trust))
    for _ in range(rounds):
        # labels hold the classes in place: half of a labelled row's weight is the label's
        q = np.where(labels >= 0, (q + trust) / 2, q)
        prior = np.clip(q.mean(), 1e-3, 1 - 1e-3)
        rate = [(w @ said + 0.5) / (w.sum() + 5) for w in (1 - q, q)]
        spread = np.zeros(said.shape[1])
        for w, r in zip((1 - q, q), rate):  # correlation of voters within each class
            away = (said - r) * np.sqrt(w)[:, None]
            var = np.sqrt(np.maximum((away * away).sum(axis=0), 1e-9))
            rho = np.abs((away.T @ away) / np.outer(var, var))
            spread = np.maximum(spread, np.where(rho > 0.3, rho, 0).sum(axis=1))
        share = 1 / np.maximum(spread, 1)
        fires, silent = np.log(rate[1] / rate[0]), np.log((1 - rate[1]) / (1 - rate[0]))
        evidence = np.clip(said @ (share * fires) + (1 - said) @ (share * silent), -MOST_EVIDENCE, MOST_EVIDENCE)
        q = 1 / (1 + np.exp(-(np.log(prior / (1 - prior)) + evidence + of_label)))
    # the labels' own accuracy: how many agree with votes that are sure of a class
    right = []
    for c, sure in ((0, evidence <= -SURE), (1, evidence >= SURE)):
        of = sure & (labels >= 0)
        right.append(float(np.clip(((labels[of] == c).sum() + START_TRUST) / (of.sum() + 1), 0.5, START_TRUST)))
    of_label = np.where(labels == 1, np.log(right[1] / (1 - right[0])), np.where(labels == 0, np.log((1 - right[1]) / right[0]), 0))
    return 1 / (1 + np.exp(-(np.log(prior / (1 - prior)) + evidence + of_label))), rate[1] / rate[0]


def steps_of(said: np.ndarray, strong: np.ndarray) -> np.ndarray:
    """Whether one, two and three strong voters speak, of each row."""
    many = (said[:, strong] > 0).sum(axis=1)
    return (many[:, None] >= np.arange(1, 4)).astype(np.float64)


def linear(said: np.ndarray, target: np.ndarray, ridge: float = 0.5, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft targets, by Newton steps."""
    x = np.hstack([said.astype(np.float64), np.ones((len(said), 1))])
    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    keep[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (target - p) - keep * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def sampled(ids: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows of (i, ...), one each id, those with the smallest hash, as a local table that may be broadcast.

    Rows far above the cut are dropped before the sort, so what meets in one task is bounded as well."""
    ids = ids.filter(F.col("i").isNotNull()).dropDuplicates(["i"])
    share = min(1.0, 2 * most / max(1, ids.count()))
    low = ids.withColumn("h", F.xxhash64("i")).filter(F.pmod("h", F.lit(1_000_000_007)) <= int(share * 1_000_000_007))
    rows = low.orderBy(F.pmod("h", F.lit(1_000_000_007)), "i").limit(most).drop("h")
    return ids.sparkSession.createDataFrame(rows.collect(), rows.schema)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: int = MOST_ROWS) -> Model:
    spark = docs.sparkSession
    known = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("i")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("toxic"))
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("text"))
    held = known.join(texts.select("i"), "i", "left_semi")
    marked = sampled(held, most_rows)
    sizes = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    stems: dict[tuple[int, str], int] = {}
    for s in [*[(0, w) for w in LEXICON], *(pick_stems(stem_counts(texts.join(F.broadcast(marked), "i")), toxic, other) if toxic else [])]:
        stems.setdefault(s, len(stems))
    if not toxic or not other:
        none = np.zeros(len(stems) + len(PATTERNS))
        return Model(stems, none, np.zeros(3), none > 0, 30.0 if toxic else -30.0)
    shared = spark.sparkContext.broadcast(stems)

    def vote(batches):
        for b in batches:
            said: list[list[int]] = [[] for _ in range(b.num_rows)]
            for at, rows, voters in votes(b.column(3), shared.value):
                for r, v in zip(rows.tolist(), voters.tolist()):
                    said[at + r].append(v)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(said, pa.list_(pa.int32()))], ["i", "toxic", "h", "v"])

    chosen = texts.join(F.broadcast(marked), "i").select("i", F.col("toxic").cast("int").alias("toxic"), F.xxhash64("text").alias("h"), "text")
    kind = chosen.schema["i"].dataType.simpleString()
    spoken = chosen.mapInArrow(vote, f"i {kind}, toxic int, h bigint, v array<int>").groupBy("i", "toxic").agg(F.min(F.struct("h", "v")).alias("s"))
    rows = spoken.orderBy("i").select("toxic", "s.v").toArrow().to_pylist()
    said = np.zeros((len(rows), len(stems) + len(PATTERNS)), np.float32)
    for k, x in enumerate(rows):
        said[k, x["v"]] = 1
    posterior, strength = label_model(said, np.array([x["toxic"] for x in rows], np.int64))
    strong = strength >= STRONG
    weights, bias = linear(np.hstack([said, steps_of(said, strong)]), posterior)
    return Model(stems, weights[:-3], weights[-3:], strong, bias)


def score(docs: DataFrame, text: Column, model: Model) -> Column:
    """Score (0 to 1) of any text column."""
    import uuid

    shared, tag = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    @F.arrow_udf("double")
    def of(column: pa.Array) -> pa.Array:
        m = shared.value
        total = np.full(len(column), m.bias)
        for at, rows, voters in votes(column, m.stems, tag):
            np.add.at(total, at + rows, m.weights[voters])
            many = np.bincount(at + rows, m.strong[voters], len(column)).astype(np.int64)
            total += np.concatenate([[0], np.cumsum(m.steps)])[np.minimum(many, 3)]
        return pa.array(1 / (1 + np.exp(-np.clip(total, -30, 30))))

    return of(text.cast("string"))
