from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from querygauge.functions.clauses import mask_variables
from querygauge.operators import clauses as C


def parts(spark, sql):
    df = spark.createDataFrame([(1, sql)], "pair_id BIGINT, q STRING")
    return [(r["keyword"], r["content"]) for r in C.sql_clauses(df, "pair_id", "q").orderBy("ordinal").collect()]


def test_sql_clauses(spark):
    got = dict(parts(spark, "SELECT a, COUNT(b) FROM t WHERE x = 1 AND y IS NOT NULL ORDER BY a DESC LIMIT 3"))
    assert got["SELECT"] == "a, COUNT(b)"  # lists run to the next keyword followed by a blank
    assert got["FROM"] == "t"
    assert got["WHERE"] == "x = 1 , y"
    assert got["COUNT"] == "(b)"
    assert got["ORDER BY"] == "a"
    assert got["LIMIT"] == "3"
    assert "NOT" not in got and "IS" not in got and "NULL" not in got and "DESC" not in got  # nothing stands after them


def test_sql_case_and_marks(spark):
    got = parts(spark, "SELECT CASE WHEN a THEN 1 ELSE 2 END FROM t WHERE(b) AND c IN (SELECT d FROM u)")
    assert ("CASE", "CASE WHEN a THEN 1 ELSE 2 END") in got
    assert ("CASE WHEN", "CASE WHEN a THEN 1 ELSE 2 END") in got
    assert ("WHERE", "(b) , c") in got
    assert ("IN", "(SELECT d") in got  # an opening bracket before SELECT hides it
    assert [c for k, c in got if k == "FROM"] == ["t", "u)"]


def score(spark, fn, gold, pred):
    df = spark.createDataFrame([(1, gold, pred)], "pair_id BIGINT, gold STRING, pred STRING")
    return fn(df).first()["component"]


def test_sql_f1(spark):
    assert score(spark, C.sql_f1, "SELECT a FROM t", "SELECT a FROM t") == 1
    assert score(spark, C.sql_f1, "SELECT a FROM t", "") == 0
    # SELECT 2/3, FROM 1, LIMIT on one side only 0
    assert score(spark, C.sql_f1, "SELECT a FROM t LIMIT 1", "SELECT a, b FROM t") == pytest.approx((2 / 3 + 1 + 0) / 3)
    # text clauses are compared as sets of characters
    assert score(spark, C.sql_f1, "FROM abc", "FROM cba") == 1


def test_cypher(spark):
    df = spark.createDataFrame([(1, "MATCH (a:X) WHERE a.b = 1 RETURN a ORDER BY a.b LIMIT 2")], "pair_id BIGINT, q STRING")
    got = {(r["keyword"], r["content"]) for r in C.cypher_clauses(df, "pair_id", "q").collect()}
    assert ("MATCH", "(a:X)") in got
    assert ("WHERE", "a.b = 1") in got
    assert ("RETURN", "a") in got  # the OR inside ORDER ends it
    assert ("LIMIT", "2") in got and ("=", "1") in got
    same = score(spark, C.cypher_f1, "MATCH (a:X) RETURN a", "MATCH (b:X) RETURN b")
    assert same == 1  # variables are masked


def test_mask(spark):
    got = spark.range(1).select(mask_variables(F.lit("MATCH (p:PART)-[:X]->(Q:Y) RETURN p")).alias("v")).first()["v"]
    assert got == "MATCH (VAR:PART)-[:X]->(VAR:Y) RETURN VAR"
    odd = spark.range(1).select(mask_variables(F.lit("(P:PART)")).alias("v")).first()["v"]
    assert odd == "(VAR:VARART)"  # every occurrence of the variable's text is replaced


def test_component_by_row_type(spark):
    df = spark.createDataFrame(
        [(1, "sql", "SELECT a", "SELECT a"), (2, "cypher", "MATCH (a:X)", "MATCH (a:Y)")], "pair_id BIGINT, query_type STRING, gold STRING, pred STRING"
    )
    assert {r["pair_id"]: r["component"] for r in C.component_score(df).collect()} == {1: 1.0, 2: 0.0}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_clause_scores_are_not_interpreted_array_expressions(spark):
    df = spark.createDataFrame([(1, "SELECT a FROM t", "SELECT b FROM t")], "pair_id BIGINT, gold STRING, pred STRING")
    for scored in (C.sql_f1(df), C.cypher_f1(df), C.sql_clauses(df, "pair_id", "gold"), C.cypher_clauses(df, "pair_id", "gold")):
        assert "ArrowEvalPython" in plan(scored) and "split(" not in plan(scored)


def test_clauses_of_odd_texts(spark):
    assert parts(spark, None) == [] and parts(spark, "") == []
    assert parts(spark, "select\x01 a from t") == [("FROM", "t")]
    assert parts(spark, "FROM a FROM b FROM(c") == [("FROM", "a"), ("FROM", "b"), ("FROM", "(c")]
    assert parts(spark, "FROM(a FROM b") == [("FROM", "b")]  # a mark counts only after the last blank
    assert parts(spark, "CASE x END, ſELECT y") == [("CASE", "CASE x END")]  # only ASCII letters have two cases
    df = spark.createDataFrame([(1, "match (a) Match (b) and and x RETURN"), (2, None)], "pair_id BIGINT, q STRING")
    assert [tuple(r)[1:] for r in C.cypher_clauses(df, "pair_id", "q").collect()] == [("MATCH", "(a) Match (b) and and x"), ("MATCH", "(b) and and x"), ("AND", "and x"), ("AND", "x")]
