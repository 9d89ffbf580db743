from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from querygauge.operators import aggregate as A, corpus as P


def order(keys, seed=42):
    return sorted(keys, key=lambda k: (hashlib.md5(f"{seed}|{k}".encode()).hexdigest(), k))


def frame(spark, n):
    return spark.range(n).select("id", (F.col("id") * 2).alias("x"))


def test_rank_and_order(spark):
    want = order(range(500))
    got = {r["id"]: r["rank"] for r in P.seeded_rank(frame(spark, 500), "id").collect()}
    assert [k for k, _ in sorted(got.items(), key=lambda kv: kv[1])] == want
    assert [r["id"] for r in P.seeded_order(frame(spark, 500), "id").collect()] == want


def test_split_partitions_the_table(spark):
    parts = [("train", 0, 0.9), ("validation", 0.9, 0.95), ("test", 0.95, 1)]
    rows = P.split(frame(spark, 333).repartition(7), parts, "id").collect()
    want = order(range(333))
    names = ["train"] * 299 + ["validation"] * 17 + ["test"] * 17
    assert {r["id"]: r["split"] for r in rows} == dict(zip(want, names))
    assert P.split(frame(spark, 0), parts, "id").count() == 0
    one = P.split(frame(spark, 1), parts, "id").collect()
    assert [r["split"] for r in one] == ["test"]


def test_sample_and_head(spark):
    want = order(range(200))[:30]
    assert sorted(r["id"] for r in P.sample_n(frame(spark, 200), 30, "id").collect()) == sorted(want)
    assert P.head(frame(spark, 20), 100, "id").count() == 20
    assert P.sample_n(frame(spark, 20), 0, "id").count() == 0


def test_balance_with_a_hot_class(spark):
    df = frame(spark, 600).withColumn("c", F.when(F.col("id") % 10 == 0, "rare").when(F.col("id") % 3 == 0, None).otherwise("hot"))
    got = P.balance(df, "c", "id").groupBy("c").count().collect()
    assert {r["c"]: r["count"] for r in got} == {"rare": 60, None: 60, "hot": 60}
    kept = {r["id"] for r in P.balance(df, "c", "id").filter("c = 'hot'").collect()}
    hot = [i for i in range(600) if i % 10 and i % 3]
    assert kept == set(order(hot)[:60])


def test_balance_within(spark):
    df = frame(spark, 400).withColumn("s", F.col("id") % 2).withColumn("c", (F.col("id") % 8 < 3).cast("int"))
    sizes = {(r["s"], r["c"]): r["count"] for r in P.balance(df, "c", "id", within=["s"]).groupBy("s", "c").count().collect()}
    assert sizes == {(0, 0): 100, (0, 1): 100, (1, 0): 50, (1, 1): 50}


def test_decontaminate_matches_missing_values(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "id INT, question STRING")
    b = spark.createDataFrame([("x",), (None,)], "question STRING")
    assert [r["id"] for r in P.decontaminate(a, b).collect()] == [3]


def test_rows_to_json_blocks_keep_every_row(spark):
    df = spark.range(25).select(F.lit("t").alias("table_id"), F.col("id").alias("row_no"), F.col("id").alias("v"))
    rows = P.rows_to_json(df, block=10).orderBy("block").collect()
    assert len(rows) == 3 and rows[2]["table_json"] == '[{"v":20},{"v":21},{"v":22},{"v":23},{"v":24}]'


def test_repeat_sample(spark):
    keys = frame(spark, 300).select(F.col("id").alias("pair_id"))
    drawn = A.repeat_sample(keys, "pair_id", n=40, iterations=3).collect()
    for it in range(3):
        ids = [r["pair_id"] for r in drawn if r["iteration"] == it]
        assert len(ids) == 40 == len(set(ids))
    assert A.repeat_sample(keys, "pair_id", n=1000, iterations=2).count() == 600
    again = A.repeat_sample(keys, "pair_id", n=400, iterations=2, replace=True).collect()
    assert len(again) == 800 and {r["pair_id"] for r in again} <= set(range(300))


def test_cuts_in_large_buckets(spark, monkeypatch):
    """Buckets above the limit are searched by longer prefixes; the cut is the same."""
    from querygauge.operators import ranking as R

    df = frame(spark, 20_000)
    at = {"a": lambda n: 1, "b": lambda n: n // 2, "c": lambda n: n, "d": lambda n: 0, "e": lambda n: n + 5}
    want = order(range(20_000))
    for limit in (2_000_000, 2):
        monkeypatch.setattr(R, "SORTED_ROWS", limit)
        cuts = R.find_cuts(df, "id", at)
        assert {k: v and v[1] for k, v in cuts.items()} == {"a": want[0], "b": want[9_999], "c": want[-1], "d": None, "e": want[-1]}
