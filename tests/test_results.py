from __future__ import annotations

import time

import pytest

from querygauge.operators import results as E


def equal(spark, gold, pred):
    row = E.compare_all(spark, [(1, gold, pred)]).first()
    return row["set_equal"], row["top_equal"], row["char_equal"]


@pytest.mark.parametrize(
    "gold,pred,want",
    [
        ("SELECT 1", "SELECT 1", (1, 1, 1)),
        ("SELECT 1", "SELECT 1.0D", (1, 0, 0)),  # equal as values, not as text
        ("SELECT 1", "SELECT '1'", (0, 0, 0)),
        ("SELECT NULL", "SELECT NULL", (1, 1, 1)),
        ("SELECT * FROM VALUES (1), (1), (2)", "SELECT * FROM VALUES (2), (1)", (1, 0, 1)),
        ("SELECT 12", "SELECT 21", (0, 0, 1)),
        ("SELECT 1, 2", "SELECT 1", (0, 0, 0)),
        ("SELECT 1 WHERE false", "SELECT 1, 2 WHERE false", (1, 1, 1)),
        ("null", "NULL", (0, 1, 1)),
        ("SELECT x", "SELECT y", (0, 0, 0)),
    ],
)
def test_pairs(spark, gold, pred, want):
    assert equal(spark, gold, pred) == want


def test_text_of_rows(spark):
    df = E.run_query(spark, "SELECT * FROM VALUES (1, 'a', CAST(NULL AS STRING)), (2, 'it''s', 'b')")
    assert E.top_text(df).first()["txt"] == str(sorted([str((1, "a", None)), str((2, "it's", "b"))]))
    assert E.top_text(E.run_query(spark, "SELECT 1")).first()["txt"] == "['(1,)']"


def test_first_rows_are_bounded_and_ordered(spark):
    df = E.run_query(spark, "SELECT id FROM range(1000)")
    assert E.first_rows(df, False).count() == E.TOP


@pytest.mark.parametrize(
    "sql,want",
    [
        ("SELECT id FROM range(9) ORDER BY id LIMIT 3", True),
        ("SELECT id FROM range(9) ORDER BY id + 1", True),
        ("WITH t AS (SELECT id FROM range(9)) SELECT id FROM t ORDER BY id", True),
        ("SELECT id % 2 FROM range(9) GROUP BY id % 2 ORDER BY count(*) DESC", True),
        ("SELECT id FROM (SELECT id FROM range(9) ORDER BY id)", False),
        ("SELECT id FROM range(9) WHERE 'x' <> 'order by hand'", False),
    ],
)
def test_order_is_read_from_the_plan(spark, sql, want):
    assert E.has_order(E.run_query(spark, sql)) == want


def test_drop_bad_gold(spark):
    report = E.compare_all(spark, [(1, "SELECT 1", "SELECT 2"), (2, "SELECT x", "SELECT 1"), (3, "SELECT 1 WHERE false", "SELECT 1")])
    assert sorted(r["pair_id"] for r in E.drop_bad_gold(report).collect()) == [1]
    assert sorted(r["pair_id"] for r in E.drop_bad_gold(report, allow_empty=True).collect()) == [1, 3]


def test_time_limit(spark):
    slow = "SELECT count(*) FROM range(0, 3000000, 1, 4) a JOIN range(0, 3000000, 1, 4) b ON a.id % 7 = b.id % 5 AND a.id + b.id < 0"
    start = time.time()
    row = E.compare_all(spark, [(1, "SELECT 1", slow)], E.Limits(seconds=3)).first()
    assert row["pred_status"] == "timeout" and row["set_equal"] == 0
    assert time.time() - start < 60


@pytest.mark.parametrize("text", ["DROP VIEW victim", "CREATE OR REPLACE TEMP VIEW victim AS SELECT 2", "INSERT OVERWRITE DIRECTORY '/tmp/never' USING csv SELECT 1", "SET x=1"])
def test_only_queries_are_run(spark, text):
    spark.sql("SELECT 1 AS a").createOrReplaceTempView("victim")
    with pytest.raises(Exception):
        E.run_query(spark, text)
    assert [tuple(r) for r in E.run_query(spark, "WITH t AS (SELECT * FROM victim) SELECT a FROM t ORDER BY a").collect()] == [(1,)]


@pytest.mark.parametrize(
    "text",
    [
        "SELECT java_method('java.lang.System', 'setProperty', 'querygauge.probe', 'x')",
        "SELECT 1 WHERE reflect('java.lang.System', 'setProperty', 'querygauge.probe', 'x') IS NULL",
        "SELECT * FROM VALUES (try_reflect('java.lang.System', 'setProperty', 'querygauge.probe', 'x'))",
        "WITH t AS (SELECT java_method('java.lang.System', 'setProperty', 'querygauge.probe', 'x') AS a) SELECT a FROM t",
        "SELECT (SELECT max(system.builtin.java_method('java.lang.System', 'setProperty', 'querygauge.probe', 'x')))",
        "SELECT IDENTIFIER('java_method')('java.lang.System', 'setProperty', 'querygauge.probe', 'x')",
        "SELECT * FROM parquet.`/root/testdata/sf0.001/region.parquet`",
        "SELECT 1 WHERE EXISTS (SELECT * FROM parquet.`/root/testdata/sf0.001/region.parquet`)",
    ],
)
def test_texts_reach_neither_the_jvm_nor_files(spark, text):
    with pytest.raises(Exception):
        E.run_query(spark, text).collect()
    assert spark._jvm.java.lang.System.getProperty("querygauge.probe") is None
    assert E.compare_all(spark, [(1, "SELECT 1", text)]).first()["pred_status"] == "error"


def test_results_that_differ_behind_the_first_rows(spark):
    row = E.compare_all(spark, [(1, "SELECT id FROM range(500)", "SELECT id + id DIV 499 FROM range(500)")]).first()
    assert (row["gold_rows"], row["set_equal"], row["bag_equal"], row["top_equal"]) == (500, 0, 0, 1)
    counts = E.bag_counts(E.run_query(spark, "SELECT * FROM VALUES (1), (1), (2), (NULL)"), E.run_query(spark, "SELECT * FROM VALUES (1), (2), (2), (NULL), (NULL)"))
    assert tuple(counts.first()) == (4, 5, 1, 2)
    assert tuple(E.bag_counts(E.run_query(spark, "SELECT 1 WHERE false"), E.run_query(spark, "SELECT 1, 2 WHERE false")).first()) == (0, 0, 0, 0)


def test_each_database_has_its_own_views(spark):
    opened = []

    def open_database(session, db_id):
        opened.append(db_id)
        session.sql("SELECT 1 AS a" if db_id == "one" else "SELECT 2 AS a").createOrReplaceTempView("own")

    spark.sql("SELECT 9 AS a").createOrReplaceTempView("outside")
    gold, data = "SELECT a FROM own", []
    for i, (db, pred) in enumerate([("one", "SELECT 1"), ("two", "SELECT 1"), ("two", "SELECT 2"), ("one", "SELECT a FROM outside"), (None, "SELECT 2"), ("one", None), ("one", "null"), ("one", "SELECT 1")]):
        data.append((i, db, gold, pred, "x"))
    pairs = spark.createDataFrame(data, "pair_id bigint, db_id string, gold string, pred string, gold_status string")
    for chunk in (500, 1):
        opened.clear()
        got = {r["pair_id"]: (r["pred_status"], r["bag_equal"]) for r in E.compare_pairs(pairs, open_database, chunk=chunk).collect()}
        assert got == {0: ("ok", 1), 1: ("ok", 0), 2: ("ok", 1), 3: ("error", 0), 4: ("ok", 1), 5: ("error", 0), 6: ("null", 0), 7: ("ok", 1)}
        assert sorted(opened) == ["", "one", "two"]
    assert E.compare_pairs(pairs.limit(0), open_database).count() == 0


def test_dialect_functions(spark):
    from querygauge.functions.dialect import open_dialect, spark_names

    session = spark.newSession()
    open_dialect(session)
    session.createDataFrame([("2024-02-29 13:05:09",), ("2023-12-31",), ("no time",), (None,)], "t string").createOrReplaceTempView("v")
    text = "SELECT STRFTIME('%d.%m.%Y %H:%M:%S|%j|%w|%s|100%%', t), JULIANDAY(t), STRFTIME('%Y-%m-%d', t, '+1 month'), DATETIME(t, 'start of year'), IIF(t LIKE '%no%', 'IIF(', '1') FROM v"
    got = [tuple(r) for r in E.run_query(session, text).collect()]
    assert got[0] == ("29.02.2024 13:05:09|060|4|1709211909|100%", pytest.approx(2460370.045243, abs=1e-6), "2024-03-29", "2024-01-01 00:00:00", "1")
    assert got[1][:4] == ("31.12.2023 00:00:00|365|0|1703980800|100%", 2460309.5, "2024-01-31", "2023-01-01 00:00:00")
    assert got[2] == (None, None, None, None, "IIF(") and got[3][:4] == (None,) * 4
    assert E.run_query(session, "SELECT STRFTIME('%Y', 'now')").first()[0].isdigit()
    assert spark_names("SELECT iif (a, 'IIF(x', \"IIF(\")") == "SELECT IF (a, 'IIF(x', \"IIF(\")"
    for refused in ("SELECT java_method('java.lang.System', 'nanoTime')", "SELECT STRFTIME(java_method('java.lang.System', 'lineSeparator'), 'now')"):
        with pytest.raises(ValueError):
            E.run_query(session, refused)
