from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from querygauge.functions import extract as X, prompts as B


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "text,mode,want",
    [
        ("a ```sql SELECT A ``` b ```sql SELECT B ``` c", "sql", "SELECT B"),
        ("```sql SELECT A", "sql", " "),
        ("```SQL SELECT A ```", "sql", " "),
        ("```SQL SELECT a ```", "upper", "SELECT A"),
        ("nothing", "upper", " "),
        ("```SQL SELECT A ```", "train", "select a"),
        ("nothing", "train", ""),
        ("```sql a ``` and ```sql b", "sql", " "),
    ],
)
def test_last_fence(spark, text, mode, want):
    assert one(spark, X.last_fence(F.lit(text), "sql", mode)) == want


def test_language_and_markers(spark):
    assert one(spark, X.last_fence_by_language(F.lit("```mongodb db.x ```"), F.lit("MQL"))) == "DB.X"
    assert one(spark, X.last_fence_by_language(F.lit("```mongodb db.x ```"), F.lit("XQuery"))) == " "
    assert one(spark, X.after_marker(F.lit("a M b M c"), "M")) == " c"
    assert one(spark, X.after_marker(F.lit("abc"), "M")) == "abc"
    assert one(spark, X.after_marker(F.lit("abc"), "M", required=True)) == ""
    assert one(spark, X.yes_no(F.lit(" Y e S"))) == "True"
    assert one(spark, X.yes_no(F.lit("no\n"))) == "no\n"
    assert one(spark, X.first_number(F.lit("v 12.5 of 3"))) == "12.5"
    assert one(spark, X.has_fence(F.lit("```CYPHER\nx\n```"), "cypher"))


def test_table_names(spark):
    sql = "SELECT * FROM `A` JOIN \"b\" ON x -- from c\nWHERE y IN (SELECT z FROM d)"
    assert one(spark, X.table_names(F.lit(sql))) == ["a", "b", "d"]


def test_schema_blocks(spark):
    info = 'CREATE TABLE "A" (x)\n/*\n1\n*/\nCREATE TABLE "B" (y)\nCREATE TABLE "C" (z)\n/*\n3\n*/'
    assert one(spark, X.schema_blocks(F.lit(info), F.array(F.lit("a"), F.lit("b")))) == 'CREATE TABLE "A" (x)\n/*\n1\n*/\n'


def test_canonical_sql(spark):
    sql = "SELECT x WHERE v BETWEEN SaO2_lower AND sao2_upper AND t < current_time AND s = ''A'' AND n < = 1 AND strftime('%Y', 'now')"
    want = (
        "select x where v between 95.0 and 100.0 and t < '2105-12-31 23:59:00' and s = 'a' and n <= 1 and strftime('%Y', '2105-12-31 23:59:00')"
    )
    assert one(spark, X.canonical_sql(F.lit(sql))) == want
    other = "x between sao2_lower and mean_bp_upper"
    assert one(spark, X.canonical_sql(F.lit(other))) == other


def test_normalise(spark):
    assert one(spark, X.normalise_answer(F.lit(" 3.14,  A-b\n"))) == "314 ab"
    assert one(spark, X.normalise_query(F.lit("select  1 ;"), F.lit("sql"))) == "select 1"
    assert one(spark, X.normalise_query(F.lit("match (a)"), F.lit("cypher"))) == "MATCH (A)"


def test_render_is_single_pass(spark):
    got = one(spark, B.render("a {x} b {y} {{c}}", x=F.lit("{y}"), y=F.lit("{x}")))
    assert got == "a {y} b {x} {c}"


def test_completion(spark):
    got = one(spark, B.completion(F.lit("<thinking>t</thinking>"), F.lit("Q"), F.lit("cypher"), "<e>"))
    assert got == "<think> t </think>```cypher Q ```<e>"
    rows = one(spark, B.messages(F.lit("s"), F.lit("u")))
    assert [(r["role"], r["content"]) for r in rows] == [("system", "s"), ("user", "u")]
