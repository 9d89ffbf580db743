"""Containment and nearest gold against all pairs in plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from querygauge.operators import matching as M
from querygauge.operators.aggregate import repeat_sample
from querygauge.operators.ranking import seeded_hash


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("most", [3, 10_000])
def test_contains_join_equals_all_pairs(spark, most):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 5)))
    texts = [(i, " ".join(word() for _ in range(rng.randint(0, 120)))) for i in range(60)] + [(60, None), (61, ""), (1, "repeated id"), (62, "x" * 200_000 + "the end of a long text")]
    golds = [(1000 + i, t[a : a + n].upper() if i % 2 else t[a : a + n]) for i in range(120) for _, t in [rng.choice(texts[:60])] for a in [rng.randint(0, 40)] for n in [rng.choice([1, 2, 7, 8, 9, 14, 15, 16, 40])]]
    golds += [(1, ""), (2, None), (3, "end of a long text"), (4, "x" * 30), (5, "never anywhere in these"), (1003, golds[3][1])]
    got = M.contains_join(spark.createDataFrame(golds, "g long, gold string"), spark.createDataFrame(texts, "t long, text string"), "g", "gold", "t", "text", most)
    want = sorted((g, t) for g, a in golds if a is not None for t, b in texts if b is not None and a.lower() in b.lower())
    assert sorted(tuple(r) for r in got.collect()) == want


def test_contains_join_of_empty_tables(spark):
    golds, texts = spark.createDataFrame([(1, "a")], "g long, gold string"), spark.createDataFrame([(1, "a")], "t long, text string")
    assert M.contains_join(golds.limit(0), texts, "g", "gold", "t", "text").count() == 0
    assert M.contains_join(golds, texts.limit(0), "g", "gold", "t", "text").count() == 0


def test_texts_are_listed_once_and_only_under_what_golds_ask_for(spark, monkeypatch, tmp_path):
    rng = random.Random(11)
    texts = spark.createDataFrame([(i, " ".join(str(rng.random()) for _ in range(200))) for i in range(40)] + [(40, "one old bolt, and a sentence of the benchmark")], "t long, text string")
    golds = spark.createDataFrame([("old",), ("old bolt",), ("A sentence of the benchmark",)], "gold string")
    monkeypatch.setattr(M, "scratch_path", lambda _, name: str(tmp_path / name))
    found = M.contains_join(golds, texts, "gold", "gold", "t", "text")
    # n-grams of texts were made again by each part of the plan that met them
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()
    assert 3 <= spark.read.parquet(str(tmp_path / "places")).count() <= 30  # of about 450,000
    assert sorted(map(tuple, found.collect())) == [("A sentence of the benchmark", 40), ("old", 40), ("old bolt", 40)]


@pytest.mark.parametrize("piece", [1, 5, 64, 1 << 18])
@pytest.mark.parametrize("whole", [True, False])
def test_grams_of_texts_do_not_depend_on_pieces(spark, monkeypatch, piece, whole):
    rng = random.Random(13)
    texts = [(i, "".join(rng.choice("abé ") for _ in range(rng.choice([0, 1, 7, 8, 14, 15, 16, 40, 90])))) for i in range(40)] + [(40, ""), (41, "b" * 50)]
    packed = lambda t, n: M._packed(M.np.frombuffer(t.encode(), M.np.uint8).astype(M.np.uint64), n)
    signed = lambda grams: grams.view(M.np.int64).tolist()
    long = lambda t: packed(t, 8) if whole else M._window_minima(packed(t, 8), 8) if len(t.encode()) >= M.LONG else packed("", 8)
    want = {(i, n, g) for i, t in texts for n, grams in ((8, long(t)), (3, packed(t, 3))) for g in signed(grams)}
    asked = sorted({(n, g) for _, n, g in want})[::2]
    marked = M._marked(spark.createDataFrame(asked, "size long, gram long"), len(asked))
    monkeypatch.setattr(M, "PIECE", piece)
    got = {tuple(r) for r in M._text_grams(spark.createDataFrame(texts, "k long, t string"), "k", "t", [3, 8], whole, marked).collect()}
    assert {(i, n, g) for i, n, g in want if (n, g) in set(asked)} <= got <= want
    assert len({(n, g) for _, n, g in got} - set(asked)) <= 3  # an n-gram that shares the marks of others


def test_marks_hold_many_grams(spark):
    grams = spark.range(300_000).selectExpr("8L AS size", "xxhash64(id) AS gram")
    packed, bits = M._marked(grams, 300_000)
    held = M.np.unpackbits(packed, bitorder="little").view(bool)
    ours, others = (M.np.array([r[0] for r in df.collect()], M.np.int64).view(M.np.uint64) for df in (grams.select("gram"), spark.range(300_000).selectExpr("xxhash64(-1 - id)")))
    hit = lambda g: held[M._marks(g, 8, bits)[0]] & held[M._marks(g, 8, bits)[1]]
    assert hit(ours).all() and hit(others).mean() < 0.01


@pytest.mark.parametrize("at_least,most", [(0.7, 10_000), (0.8, 4), (1.0, 10_000)])
def test_best_gold_equals_all_pairs(spark, at_least, most):
    rng = random.Random(7)
    golds = ["".join(rng.choice("ab c") for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 8, 12, 30]))) for _ in range(90)] + ["", "é" * 9, None, "aaaaaaaaaa"]
    preds = [g for g in golds if rng.random() < 0.3]
    for g in golds[:90]:
        cut = rng.randrange(len(g))
        preds += [g[:cut] + rng.choice("abx") + g[cut + 1 :], g[:cut] + g[cut + 1 :], g + "b"]
    preds += [None, "", "aaaaaaaaab", "nothing like it"]
    got = M.best_gold(spark.createDataFrame([(g,) for g in golds], "gold string"), spark.createDataFrame([(p,) for p in preds], "pred string"), "gold", "pred", at_least, most)
    want = {}
    for p in {p for p in preds if p is not None}:
        scored = [(-(1 - edits(g, p) / max(len(g), len(p)) if max(len(g), len(p)) else 1.0), g) for g in {g for g in golds if g is not None}]
        v, g = min(scored)
        want[p] = (g, pytest.approx(-v)) if -v >= at_least - 1e-9 else (None, None)
    assert {r["pred"]: (r["gold"], r["similarity"]) for r in got.collect()} == want


def test_best_gold_refuses_a_bound_that_the_lists_cannot_keep(spark):
    with pytest.raises(ValueError):
        M.candidates(spark.createDataFrame([("a",)], "s string"), spark.createDataFrame([("a",)], "s string"), 0.5)


def test_draws_with_replacement(spark):
    from hashlib import md5

    keys = [r[0] for r in spark.range(1000).select((F.col("id") * 7).alias("k")).orderBy(seeded_hash(F.col("id") * 7)).collect()]
    drawn = repeat_sample(spark.range(1000).select((F.col("id") * 7).alias("k")), "k", n=50, iterations=3, replace=True)
    want = sorted((i, keys[int(md5(f"42|{i}|{j}".encode()).hexdigest()[:15], 16) % 1000]) for i in range(3) for j in range(50))
    assert sorted(tuple(r) for r in drawn.collect()) == want


def test_few_golds_of_a_large_table_do_not_move_all_grams(spark):
    golds = spark.range(200_000).selectExpr("concat('needle number ', id % 3) AS g").repartition(4)
    texts = spark.createDataFrame([(1, "a needle number 1 here"), (2, "none"), (3, "needle number 0")], "i INT, t STRING")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100000")
    try:
        found = M.contains_join(golds.distinct().selectExpr("g", "g AS key"), texts, "key", "g", "i", "t")
        semi = [line for line in found._jdf.queryExecution().executedPlan().toString().split("\n") if "LeftSemi" in line]
        assert semi and all("BroadcastHashJoin" in line for line in semi)
        assert sorted(map(tuple, found.collect())) == [("needle number 0", 3), ("needle number 1", 1)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_candidates_keep_cases_of_letters_apart(spark):
    golds = [f"{name} {kind} Brand#{i}" for name in ("hot bolt", "old gear", "blue ring") for kind in ("ECONOMY", "STANDARD") for i in range(10, 25)]
    preds = [f"{name}  {kind}Brand#{i}" for name in ("hot bolt", "old gear", "blue ring") for kind in ("economy", "standard") for i in range(10, 25)]
    near = M.candidates(spark.createDataFrame([(g,) for g in golds], "s string"), spark.createDataFrame([(p,) for p in preds], "s string"), 0.8)
    # each lost 7 or 8 capitals of at most 27 characters, beyond 0.8: of 8,100 pairs few are left to compare
    assert near.select("p", "g").distinct().count() < 81


def test_best_gold_takes_the_smallest_of_equals_and_far_ones_without_near(spark):
    golds = [("abcdefghij",), ("abcdefghik",), ("zzzzzzzzzzzzzzzzzzzz",), ("ÀÉÎõü 漢字😀x",)]
    preds = [("abcdefghix",), ("abcdefghij",), ("zzzzzzzzzzzzzzzzyyyy",), ("zzzzzzzzzzzzzzzyyyyy",), ("ÀÉÎõü 漢字😀y",)]
    got = M.best_gold(spark.createDataFrame(golds, "gold string"), spark.createDataFrame(preds, "pred string"), "gold", "pred", 0.8, 1).collect()
    assert {r["pred"]: (r["gold"], r["similarity"]) for r in got} == {
        "abcdefghix": ("abcdefghij", pytest.approx(0.9)), "abcdefghij": ("abcdefghij", 1.0), "zzzzzzzzzzzzzzzzyyyy": ("zzzzzzzzzzzzzzzzzzzz", pytest.approx(0.8)),
        "zzzzzzzzzzzzzzzyyyyy": (None, None), "ÀÉÎõü 漢字😀y": ("ÀÉÎõü 漢字😀x", pytest.approx(0.9)),
    }
