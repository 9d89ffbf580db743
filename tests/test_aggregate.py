from __future__ import annotations

import statistics

import pytest
from pyspark.sql import functions as F

from querygauge.operators import aggregate as A


def test_grades(spark):
    df = spark.createDataFrame([("Excellent",), ("Good",), ("Above average",), ("Bad",), ("Very bad",), ("Average",), (None,)], "g STRING")
    assert [r["s"] for r in df.select(A.grade_to_score(F.col("g")).alias("s")).collect()] == [1.0, 0.8, 0.6, 0.2, 0.0, 0.0, 0.0]


def test_grade_groups(spark):
    answers = spark.createDataFrame([(p, i) for p, n in (("a", 3), ("b", 2), ("c", 1)) for i in range(n)], "prompt_key STRING, idx INT")
    verdicts = spark.createDataFrame(
        [("a", 0, "Good"), ("a", 1, "Excellent"), ("b", 0, "Good"), ("b", 1, "Average"), ("c", 0, "Good"), ("c", 1, "Good")], "prompt_key STRING, idx INT, grade STRING"
    )
    got = {(r["prompt_key"], r["idx"]): r["score"] for r in A.grade_group_score(answers, verdicts).collect()}
    assert got == {("a", 0): 0.8, ("a", 1): 1.0, ("a", 2): 0.0, ("b", 0): 0.0, ("b", 1): 0.0, ("c", 0): 0.0}


def scores(spark, rows):
    return spark.createDataFrame(rows, "pair_id BIGINT, metric STRING, value DOUBLE")


def test_means_round_before_f1(spark):
    rows = [(i, "precision_ans", float(i < 2)) for i in range(3)] + [(i, "recall_ans", float(i < 1)) for i in range(3)] + [(0, "precision_exec", 1.0)]
    got = {r["metric"]: r["value"] for r in A.score_table(scores(spark, rows)).collect()}
    assert got == {"precision_ans": 0.667, "recall_ans": 0.333, "precision_exec": 1.0, "f1_ans": round(2 * 0.667 * 0.333 / (1.0 + 1e-10), 3)}


def test_combinations(spark):
    df = scores(spark, [(1, "component_or_graph", 0.5), (1, "verdict", 1.0), (1, "sequence", 0.0), (1, "other", 9.0)])
    assert A.combine_mean(df, "pair_id", ["component_or_graph", "verdict", "sequence"]).first()["combined"] == pytest.approx(0.5)
    assert A.combine_weighted(df, "pair_id").first()["combined"] == pytest.approx(0.4 * 0.5 + 0.3)


def test_advantage(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0)], "prompt_key STRING, reward DOUBLE")
    got = sorted((r["prompt_key"], round(r["advantage"], 4)) for r in A.group_advantage(df).collect())
    s = statistics.stdev([1.0, 3.0])
    assert got == [("a", round(-1 / (s + 1e-6), 4)), ("a", round(1 / (s + 1e-6), 4)), ("b", 0.0)]


def test_group_listing_in_blocks(spark):
    df = spark.createDataFrame([("p", i, f"q{i}") for i in range(5)], "prompt_key STRING, idx INT, pred STRING")
    rows = A.group_by_prompt(df, block=2).orderBy("block").collect()
    assert [r["n"] for r in rows] == [2, 2, 1]
    assert rows[1]["listing"] == "Query 3:\nq2\n\nQuery 4:\nq3"


def test_report(spark):
    df = scores(spark, [(i, "m", float(i % 2)) for i in range(50)])
    row = A.task_report(df, df.select("pair_id"), "t", n=20, iterations=4).first()
    assert row["score"] == 0.5 and 0 <= row["ci_lower"] <= row["mean"] <= row["ci_upper"] <= 1


def test_drawn_keys_do_not_move_the_scores(spark):
    scores = spark.createDataFrame([(i, "m", float(i % 2)) for i in range(20)], "pair_id BIGINT, metric STRING, value DOUBLE")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as on a table that is too large to be broadcast itself
    try:
        rows = A.with_iterations(scores, scores.select("pair_id"), "pair_id", n=3, iterations=2)
        assert "BroadcastHashJoin" in rows._jdf.queryExecution().executedPlan().toString()
        assert rows.count() == 20 + 6
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
