from __future__ import annotations

from querygauge.schemas import TABLES
from querygauge.sources import catalog, readers as R, sinks as K


def test_json_arrays(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"question": "q", "query": "s", "other": 1},\n {"question": "r", "query": null}]')
    schema = R.T.StructType([R.T.StructField(c, R.T.StringType()) for c in ("question", "query", "other")])
    assert R.read_records(spark, str(tmp_path), schema).count() == 2
    got = R.read_projected(spark, str(tmp_path), ["question", "query"], schema).orderBy("question").collect()
    assert [tuple(r) for r in got] == [("q", "s"), ("r", None)]


def test_keyed_questions_skip_missing_files(spark, tmp_path):
    (tmp_path / "q.json").write_text('{"a.csv": [{"Question name": "x", "Answer": "1", "Tittle": "t"}, {"Question name": "y", "Answer": "2", "Tittle": "t"}], "b.csv": []}')
    files = spark.createDataFrame([("a.csv",)], "file STRING")
    assert R.read_keyed_questions(spark, str(tmp_path), files).count() == 2
    assert R.read_keyed_questions(spark, str(tmp_path), files.filter("false")).count() == 0


def test_delimited_files_with_their_own_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x#y\n1#2\n3#4\n")
    (tmp_path / "b.csv").write_text("z#z\nq\n")
    rows = {(r["table_id"], r["row_no"]): r["row"] for r in R.read_delimited(spark, str(tmp_path)).collect()}
    assert rows == {("a.csv", 0): {"x": "1", "y": "2"}, ("a.csv", 1): {"x": "3", "y": "4"}, ("b.csv", 0): {"z": "q", "z.1": None}}


def test_csv_corpora(spark, tmp_path):
    (tmp_path / "c.csv").write_text('question,sql,cypher,mql\n"a ""b""\nc",S,C,M\n')
    assert [tuple(r) for r in R.read_by_language(spark, str(tmp_path), "MQL").collect()] == [('a "b"\nc', "M")]


def test_stringify(spark):
    df = spark.sql("SELECT 1 AS a, named_struct('x', 1, 'y', CAST(NULL AS INT)) AS s, array(1, 2) AS l")
    assert tuple(R.stringify_nested(df).first()) == (1, '{"x":1,"y":null}', "[1,2]")


def test_catalog(spark, smoke_dir):
    rows = {r["db_id"]: r["context"] for r in catalog.catalog_text(spark, {"d": ["region"], "none": []}).collect()}
    assert rows == {"d": 'CREATE TABLE "REGION" (r_regionkey INTEGER, r_name TEXT)', "none": None}
    block = catalog.catalog_samples(spark, smoke_dir, {"region": ["r_regionkey"]}, n=2).first()["block"]
    assert block.startswith(rows["d"]) and block.count("\n") == 4


def test_catalog_of_nested_tables(spark):
    df = spark.sql("SELECT 2 AS id, array(named_struct('x', 1.5D, 'tags', map('k', array(1L)))) AS rows, CAST(1 AS DECIMAL(9,2)) AS price, X'0AFF' AS raw UNION ALL SELECT 1, NULL, NULL, NULL")
    ddl = 'CREATE TABLE "T" (id INTEGER, rows STRUCT(x REAL, tags MAP(TEXT, BIGINT[]))[], price DECIMAL(9,2), raw BINARY)'
    assert [tuple(r) for r in catalog.catalog_of(spark, {"t": df}).collect()] == [("t", ddl)]
    block = catalog.samples_of({"t": df}, {"t": ["id"]}).first()["block"]
    assert block == ddl + '\n/*\n1 | None | None | None\n2 | [{"x":1.5,"tags":{"k":[1]}}] | 1.00 | 0AFF\n*/'
    assert catalog.samples_of({"t": df.limit(0)}, {"t": ["id"]}).first()["block"] == ddl + "\n/*\n\n*/"


def test_sinks_append(spark, tmp_path):
    means = spark.createDataFrame([("m", 0.5)], "metric STRING, value DOUBLE")
    for _ in range(2):
        K.append_result(means, {"a": 1}, "model", str(tmp_path / "r"))
    assert spark.read.schema("model STRING").json(str(tmp_path / "r")).count() == 2
    assert set(TABLES) >= {"orders", "documents"}
