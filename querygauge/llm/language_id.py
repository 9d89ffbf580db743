"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of one fixed public vocabulary. The probability of a word
is the sum over all ways to cut it into pieces (forward algorithm); a text's is the product over its words.
Piece probabilities are learned by expectation maximisation on a bounded sample of labelled documents
(about ``per_language`` documents of each language, those whose hash is below its share); one Spark job per round.

Defined results: a text that is null, or has no letter, is ``und`` with score 0; so is every text where no
language could be learned. Repeated rows are scored alike. Ties go to the smaller language value. Every
letter of a text counts, however long the text or a word is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from querygauge.llm.common import letter_words, slices

UNKNOWN = "und"
LONGEST_PIECE = 8  # longer pieces of the vocabulary are not used
LONGEST_RUN = 24  # a longer word is scored in runs of so many letters, each of them whole
FLOOR = 1e-7  # probability of a letter that is no piece
_PRIME = np.uint64(0x100000001B3)


@dataclass(frozen=True)
class Model:
    """Piece hashes in order, their probability in each language, and log priors."""

    languages: tuple[str, ...]
    keys: np.ndarray
    prob: np.ndarray  # pieces x languages; two more rows: no piece (0) and unknown letter (FLOOR)
    prior: np.ndarray


def vocabulary(path: str) -> list[str]:
    """Lower-case pieces of letters, with the word-start mark, of a public sentencepiece model."""
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {pieces.id_to_piece(i).lower() for i in range(pieces.get_piece_size()) if not pieces.is_byte(i) and not pieces.is_control(i)}
    return sorted(p for p in found if 0 < len(p) <= LONGEST_PIECE and (p == "▁" or p.removeprefix("▁").isalpha()))


def _codes(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), length).astype(np.uint64)


def _keys(pieces: list[str]) -> np.ndarray:
    out = np.zeros(len(pieces), np.uint64)
    with np.errstate(over="ignore"):
        for i, p in enumerate(pieces):
            h = np.uint64(len(p))
            for c in p:
                h = h * _PRIME + np.uint64(ord(c))
            out[i] = h
    return out


def _found(codes: np.ndarray, keys: np.ndarray) -> list[np.ndarray]:
    """For each piece length, the row in the model of every substring of that length."""
    n, length = codes.shape
    out = []
    with np.errstate(over="ignore"):
        for size in range(1, min(LONGEST_PIECE, length) + 1):
            h = np.full((n, length - size + 1), np.uint64(size))
            for k in range(size):
                h = h * _PRIME + codes[:, k : k + length - size + 1]
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            out.append(np.where(keys[at] == h, at, len(keys) + (size == 1)))
    return out


def _forward(found: list[np.ndarray], prob: np.ndarray) -> np.ndarray:
    n, length = found[0].shape
    alpha = np.zeros((length + 1, n, prob.shape[1]))
    alpha[0] = 1
    for end in range(1, length + 1):
        for size in range(1, min(len(found), end) + 1):
            alpha[end] += alpha[end - size] * prob[found[size - 1][:, end - size]]
    return alpha


def _by_length(words: list[str]) -> dict[int, list[int]]:
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    return groups


def word_scores(words: list[str], model: Model) -> np.ndarray:
    """Log probability of each word (words x languages), over all of its segmentations."""
    runs, owner = [], []
    for i, w in enumerate(words):
        marked = "▁" + w
        for at in range(0, len(marked), LONGEST_RUN):
            runs.append(marked[at : at + LONGEST_RUN])
            owner.append(i)
    out, owner = np.zeros((len(words), len(model.languages))), np.array(owner, dtype=np.int64)
    for length, rows in _by_length(runs).items():
        for at in range(0, len(rows), 4096):
            part = rows[at : at + 4096]
            last = _forward(_found(_codes([runs[i] for i in part], length), model.keys), model.prob)[-1]
            np.add.at(out, owner[part], np.log(last))
    return out


def expected_counts(words: list[str], weight: np.ndarray, column: int, model: Model) -> np.ndarray:
    """Expected uses of each piece in the given words of one language (forward-backward)."""
    runs, owner = [], []
    for i, w in enumerate(words):
        marked = "▁" + w
        for at in range(0, len(marked), LONGEST_RUN):
            runs.append(marked[at : at + LONGEST_RUN])
            owner.append(i)
    prob, out = model.prob[:, [column]], np.zeros(len(model.prob))
    for length, rows in _by_length(runs).items():
        for at in range(0, len(rows), 4096):
            part = rows[at : at + 4096]
            found = _found(_codes([runs[i] for i in part], length), model.keys)
            alpha, beta = _forward(found, prob)[:, :, 0], np.zeros((length + 1, len(part)))
            beta[length] = 1
            for start in range(length - 1, -1, -1):
                for size in range(1, min(len(found), length - start) + 1):
                    beta[start] += beta[start + size] * prob[found[size - 1][:, start], 0]
            share = weight[[owner[i] for i in part]] / alpha[length]
            for size, at_rows in enumerate(found, 1):
                for start in range(length - size + 1):
                    rows_at = at_rows[:, start]
                    out += np.bincount(rows_at, share * alpha[start] * prob[rows_at, 0] * beta[start + size], len(out))
    return out


def sampled(rows: DataFrame, per_language: int) -> DataFrame:
    """About ``per_language`` rows of (h, l, t) for each language ``l``, by their hash ``h``."""
    shares = rows.groupBy("l").agg((F.lit(per_language) / F.count("*")).alias("share"))
    return rows.join(F.broadcast(shares), "l").filter(F.pmod("h", F.lit(1 << 40)) < F.col("share") * (1 << 40))  # broadcast: one row per language


def train(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 600, rounds: int = 3) -> Model:
    """Piece probabilities from rows of ``docs`` with a text and a language.

    The sample is about ``per_language`` rows a language, chosen by the hash of id and text, so rows of a null or repeated id
    are sampled like others (rows equal in both stand or fall together); one number for each piece and language reaches the driver."""
    spark = docs.sparkSession
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sample = sampled(known.select(F.xxhash64(id_col, F.col(text_col).cast("string")).alias("h"), F.col(lang_col).cast("string").alias("l"), F.col(text_col).cast("string").alias("t")), per_language)
    counts = sample.select("l", F.explode(F.split(F.lower("t"), r"[^\p{L}]+")).alias("w")).filter("w <> ''").groupBy("l", "w").count().coalesce(8).cache()
    langs = tuple(r["l"] for r in counts.select("l").distinct().orderBy("l").collect())
    if not langs:
        return Model((), np.zeros(0, np.uint64), np.zeros((0, 0)), np.zeros(0))
    pieces = vocabulary(path)
    keys = _keys(pieces)
    order_of = np.argsort(keys)
    start = np.zeros((len(pieces) + 2, len(langs)))
    start[: len(pieces)] = 1 / len(pieces)
    start[-1] = FLOOR
    model = Model(langs, keys[order_of], start, np.zeros(len(langs)))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def gather(batches, shared=shared):
            m = shared.value
            total = np.zeros((len(m.prob), len(m.languages)))
            for b in batches:
                lang, words, n = (b.column(i).to_pylist() for i in range(3))
                for k, name in enumerate(m.languages):
                    own = [i for i, x in enumerate(lang) if x == name]
                    if own:
                        total[:, k] += expected_counts([words[i] for i in own], np.array([n[i] for i in own], float), k, m)
            piece, k = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(k), pa.array(total[piece, k])], names=["p", "k", "n"])

        uses = counts.mapInArrow(gather, "p bigint, k bigint, n double").groupBy("p", "k").agg(F.sum(F.col("n").cast("decimal(28,9)")).cast("double").alias("n"))
        got = uses.toArrow()
        table = np.zeros_like(start)
        table[got.column("p").to_numpy(), got.column("k").to_numpy()] = got.column("n").to_numpy()
        table = table[: len(pieces)] + 0.01  # no piece is impossible
        fresh = np.zeros_like(start)
        fresh[: len(pieces)] = table / table.sum(axis=0)
        fresh[-1] = FLOOR
        model = Model(langs, model.keys, fresh, model.prior)
    counts.unpersist()
    return model


_KEPT: dict = {}  # of this worker: word -> row of its scores, for one model at a time
_MOST_KEPT = 100_000  # most words come once, and what a worker keeps stays while later stages run in it


def _scored(words: pa.Array, model: Model, tag: str) -> np.ndarray:
    names = words.to_pylist()
    new = [w for w in names if w not in _KEPT["row"]] if _KEPT.get("tag") == tag else names
    if new is names or len(_KEPT["row"]) + len(new) > _MOST_KEPT:
        _KEPT.clear()
        _KEPT.update(tag=tag, row={}, table=np.zeros((1 << 16, len(model.languages)), np.float32))
        new = names
    row = _KEPT["row"]
    if new:
        first = len(row)
        row.update(zip(new, range(first, first + len(new))))
        while len(row) > len(_KEPT["table"]):
            _KEPT["table"] = np.concatenate([_KEPT["table"], np.zeros_like(_KEPT["table"])])
        _KEPT["table"][first : len(row)] = word_scores(new, model)
    return _KEPT["table"][[row[w] for w in names]].astype(np.float64)


def identify(column: pa.Array, model: Model, tag: str = "") -> pa.StructArray:
    """``lang`` and ``score`` (posterior probability of it) of each text of an Arrow column."""
    best, scores = np.full(len(column), -1), np.zeros(len(column))
    for at, part in slices(column):
        first, words = letter_words(part)
        if not len(words) or not model.languages:
            continue
        coded = words.dictionary_encode()
        each = _scored(coded.dictionary, model, tag)
        rows = np.flatnonzero(first[1:] > first[:-1])
        total = np.add.reduceat(each[coded.indices.to_numpy()], first[rows], axis=0) + model.prior
        total -= total.max(axis=1, keepdims=True)
        best[at + rows] = total.argmax(axis=1)
        scores[at + rows] = 1 / np.exp(total).sum(axis=1)
    names = np.array([*model.languages, UNKNOWN], dtype=object)
    return pa.StructArray.from_arrays([pa.array(names[best].tolist(), pa.string()), pa.array(scores)], names=["lang", "score"])


def language(docs: DataFrame, text: Column, model: Model) -> Column:
    """A column struct(lang, score) for any text column; other columns of ``docs`` stay as they are."""
    import uuid

    shared, tag = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    @F.arrow_udf("lang string, score double")
    def of(column: pa.Array) -> pa.Array:
        return identify(column, shared.value, tag)

    return of(text.cast("string"))
