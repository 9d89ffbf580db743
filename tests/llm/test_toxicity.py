"""Label model, samples and held-out scores of the toxicity operator."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("querygauge.llm.queries")

from querygauge.llm import toxicity  # noqa: E402
from querygauge.llm.queries import QUERIES  # noqa: E402


def test_accurate_voters_overrule_wrong_labels():
    rng = np.random.default_rng(0)
    true = (rng.random(4000) < 0.3).astype(int)
    said = rng.random((4000, 60)) < np.where(true[:, None] == 1, 0.5, 0.1)
    given = true.copy()
    wrong = rng.choice(4000, 771, replace=False)
    given[wrong] = 1 - given[wrong]
    posterior, _ = toxicity.label_model(said, given)
    assert ((posterior > 0.5) == true)[wrong].mean() > 0.95 and ((posterior > 0.5) == true).mean() > 0.98


def test_labels_decide_where_votes_agree_with_them():
    rng = np.random.default_rng(1)
    true = (rng.random(2000) < 0.2).astype(int)
    said = rng.random((2000, 40)) < np.where(true[:, None] == 1, 0.3, 0.02)
    posterior, _ = toxicity.label_model(said, true)
    assert ((posterior > 0.5) == true).mean() > 0.99


def test_held_out_rows_of_the_query(spark):
    folder = "/root/testdata/sf0.01"
    scored = QUERIES["op5_toxicity"](spark, folder).filter("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    flags = {r["toxic"]: (r["n"], r["f"]) for r in scored.groupBy("toxic").agg(F.count("*").alias("n"), F.sum("predicted").alias("f")).collect()}
    assert flags[1][1] >= 0.6 * flags[1][0] and flags[0][1] <= 0.1 * flags[0][0]


def test_sample_is_bounded_and_stable_with_null_and_repeated_ids(spark):
    ids = spark.createDataFrame([(None if i % 3 == 0 else i % 500,) for i in range(6000)], "i long")
    one, two = (sorted(r["i"] for r in toxicity.sampled(part, 100).collect()) for part in (ids, ids.repartition(7)))
    assert one == two and len(one) == len(set(one)) == 100
    assert toxicity.sampled(ids.limit(0), 100).count() == 0


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "you idiot scum", "a"), (1, "another text of that id", "a"), (2, "a fine day at the lake", "b"), (3, "", "c"), (None, "idiot", "d"), (4, None, "e"), (5, "word " * 200_000, "f")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, None), (None, 1), (5, 0), (77, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    rows = docs.select("doc_id", toxicity.score(docs, F.col("text"), model).alias("s")).collect()
    score = {r["doc_id"]: r["s"] for r in rows if r["doc_id"] not in (None, 1)}
    assert len(rows) == 7 and all(0 <= r["s"] <= 1 for r in rows) and score[3] == score[4]
    empty = toxicity.train(docs.limit(0), labels)
    assert [r["s"] for r in docs.limit(0).select(toxicity.score(docs, F.col("text"), empty).alias("s")).collect()] == []
    unlabelled = toxicity.train(docs, labels.limit(0))
    assert all(r["s"] < 1e-9 for r in docs.select(toxicity.score(docs, F.col("text"), unlabelled).alias("s")).collect())
    only = toxicity.train(docs, labels.filter("doc_id = 1"))
    assert all(r["s"] > 1 - 1e-9 for r in docs.select(toxicity.score(docs, F.col("text"), only).alias("s")).collect())
