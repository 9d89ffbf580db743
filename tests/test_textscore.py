from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from querygauge.operators import textscore as M

WORDS = "a b c d e f".split()


def pairs(spark, rows):
    return spark.createDataFrame([(i, g, p) for i, (g, p) in enumerate(rows)], "pair_id BIGINT, gold STRING, pred STRING")


@pytest.mark.parametrize(
    "gold,pred,want",
    [
        ("3.14", "314", 1),  # dots go before numbers are read
        ("-5", "5", 1),
        ("007", "7", 1),
        ("1e2", "100", 1),
        ("5d", "5", 0),
        ("nan", "nan", 0),
        ("inf", "Infinity", 1),
        ("+4", "4", 1),
        ("Yes!", "yes", 1),
        ("a  b", "A b.", 1),
        ("a", "b", 0),
    ],
)
def test_exact_match(spark, gold, pred, want):
    assert pairs(spark, [(gold, pred)]).select(M.exact_match(F.col("gold"), F.col("pred")).alias("v")).first()["v"] == want


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def sample_texts(n, seed):
    rnd = random.Random(seed)
    text = lambda: " ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(0, 40)))
    return [(text(), text()) for _ in range(n)] + [("", ""), ("a", ""), ("", "a"), ("a b c", "a b c")]


def test_rouge_against_plain_table(spark):
    rows = sample_texts(60, 1)
    got = {r["pair_id"]: r["v"] for r in pairs(spark, rows).select("pair_id", M.rouge_l(F.col("gold"), F.col("pred")).alias("v")).collect()}
    for i, (g, p) in enumerate(rows):
        gw, pw = g.split(), p.split()
        common = lcs(gw, pw)
        assert got[i] == pytest.approx(2 * common / (len(gw) + len(pw)) if common else 0.0)


def test_bleu_against_counts(spark):
    rows = sample_texts(60, 2)
    got = {r["pair_id"]: r["bleu"] for r in M.bleu4(pairs(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, (g, p) in enumerate(rows):
        gw, pw = g.split(), p.split()
        if not pw:
            assert got[i] == 0
            continue
        logs = 0.0
        for n in range(1, 5):
            count = lambda w: Counter(zip(*[w[k:] for k in range(n)]))  # noqa: B023, E731
            hits, total = sum((count(pw) & count(gw)).values()), max(len(pw) - n + 1, 0)
            logs += math.log(hits / total if hits else 1e-7)
        assert got[i] == pytest.approx(min(1.0, math.exp(1 - len(gw) / len(pw))) * math.exp(logs / 4), rel=1e-9)


def test_similarity_bound_is_never_below_ratio(spark):
    rows = [(g, p) for g, p in sample_texts(80, 3)]
    df = pairs(spark, rows).select(
        "pair_id", M.sequence_ratio(F.col("gold"), F.col("pred")).alias("ratio"), M.similarity_bound(F.col("gold"), F.col("pred")).alias("bound")
    )
    for r in df.collect():
        assert r["bound"] >= r["ratio"] - 1e-12
        g, p = rows[r["pair_id"]]
        shared = sum((Counter(g) & Counter(p)).values())
        assert r["bound"] == pytest.approx(2 * shared / (len(g) + len(p)) if g or p else 1.0)


def test_self_scores(spark):
    df = pairs(spark, [("x y z w v", "x y z w v")])
    row = df.join(M.bleu4(df), "pair_id").select(
        "bleu", M.rouge_l(F.col("gold"), F.col("pred")).alias("r"), M.sequence_ratio(F.col("gold"), F.col("pred")).alias("s")
    ).first()
    assert (row["bleu"], row["r"], row["s"]) == pytest.approx((1, 1, 1))


def test_map_similarity(spark):
    df = spark.createDataFrame([(1, {"select": "a", "from": "t"}, {"select": "A ", "where": "x"})], "pair_id BIGINT, p MAP<STRING, STRING>, g MAP<STRING, STRING>")
    assert M.map_similarity(df, "pair_id", "p", "g").first()["map_similarity"] == pytest.approx(1 / 3)


def test_missing_predictions_score_zero(spark):
    df = spark.createDataFrame([("a b", None), ("a", "a")], "g string, p string")
    g, p = F.col("g"), F.col("p")
    rows = df.select(M.exact_match(g, p), M.contains_match(g, p), M.levenshtein_similarity(g, p), M.similarity_bound(g, p)).collect()
    assert [tuple(r) for r in rows] == [(0, 0, 0.0, 0.0), (1, 1, 1.0, 1.0)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()



def test_bleu_of_single_and_repeated_rows(spark):
    rows = [(1, "a b c d e", "a b c d x"), (2, "a b c d e", "a b c d x"), (2, "a b c d e", "a b c d x"), (3, None, "a"), (3, "a", None), (4, "", "")]
    df = spark.createDataFrame(rows, "pair_id BIGINT, gold STRING, pred STRING")
    got = sorted((r["pair_id"], round(r["bleu"], 6)) for r in M.bleu4(df).collect())
    once = math.exp(sum(math.log(x) for x in (4 / 5, 3 / 4, 2 / 3, 1 / 2)) / 4)
    # rows of one key and one pair of lengths count together, as one pair
    twice = math.exp(sum(math.log(2 * x) for x in (4 / 5, 3 / 4, 2 / 3, 1 / 2)) / 4)
    assert got == [(1, round(once, 6)), (2, round(twice, 6)), (3, 0.0), (3, 0.0), (4, 0.0)]
    assert "array_intersect" not in plan(M.bleu4(df))



def test_sequence_ratio_is_the_matchers(monkeypatch):
    r, want = random.Random(5), []
    for alphabet in ("ab", "abcd ", "abcdefghijklm"):
        for n in range(150):
            a, b = ("".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in "ab")
            b = a[: n % 30] + b[:9] + a[n % 40 :] if n % 2 else b
            want.append((a, b, M.SequenceMatcher(None, a, b).ratio()))
    assert M._ratio("x" * 150 + "y" * 60, "y" * 60 + "x" * 150) == M.SequenceMatcher(None, "x" * 150 + "y" * 60, "y" * 60 + "x" * 150).ratio()
    monkeypatch.setattr(M, "SequenceMatcher", None)  # short pairs do not need it
    assert all(M._ratio(a, b) == v for a, b, v in want)



def test_ngram_profile_moves_texts_not_grams(spark):
    df = spark.createDataFrame([(1, "a b a b"), (1, "a b"), (None, "c d"), (2, None), (3, "x")], "doc_id BIGINT, text STRING")
    got = M.ngram_profile(df, "doc_id", "text", 2)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "a b", 3), (1, "b a", 1), (None, "c d", 1)], key=str)
    assert plan(got).split("== Initial Plan ==")[-1].count("Exchange ") == 1 and "gram" not in plan(got).split("Exchange ")[-1].split("\n")[0]



def test_similarity_bound_counts_each_text_once(spark):
    rows = [("aabbé", "abbbé😀"), ("", ""), ("", "x"), ("x", None), (None, "x"), ("😀😀", "😀")]
    df = pairs(spark, rows).select("pair_id", M.similarity_bound(F.col("gold"), F.col("pred")).alias("v"))
    want = [2 * 4 / 11, 1.0, 0.0, 0.0, None, 2 / 3]
    assert [r["v"] for r in df.orderBy("pair_id").collect()] == [w if w is None else pytest.approx(w) for w in want]
    assert "aggregate(" not in plan(df)


def test_longest_block_is_the_first_of_the_longest():
    from difflib import SequenceMatcher

    rng = random.Random(11)
    for _ in range(400):
        letters = rng.choice(["ab", "abcd ", "SELECT o_key é"])
        a = "".join(rng.choices(letters, k=rng.randrange(1, 90)))
        b = list(a) if rng.random() < 0.5 else rng.choices(letters, k=rng.randrange(1, 90))
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(6)] = rng.choices(letters, k=rng.randrange(6))
        b = "".join(b)
        matcher = SequenceMatcher(None, a, b)
        want, found = matcher.find_longest_match(), M._longest(a, b)
        assert found is None or found[0] == want.size and (not want.size or found[1:] == (want.a, want.b))
        assert M._ratio(a, b) == matcher.ratio()
    assert M._longest("xy" * 450, "yx" * 75) in (None, (150, 1, 0))
    assert M._longest("SELECT a FROM b", "SELECT c FROM b") == (7, 0, 0)
