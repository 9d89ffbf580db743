"""Check queries for readers (src_), catalogs (catalog_) and sinks (sink_): tables are written in a corpus format and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from querygauge.operators import aggregate as A
from querygauge.operators.corpus import attach_context
from querygauge.plans import fixtures as fx
from querygauge.plans.registry import query
from querygauge.schemas import MESSAGES, TABLES
from querygauge.session import scratch_path
from querygauge.sources import catalog, readers as R, sinks as K

ROWS_PER_FILE = 50_000


def write_arrays(df: DataFrame, key: str, path: str) -> None:
    """Files holding one JSON array each, of at most ROWS_PER_FILE records (``key`` is unique)."""
    block = F.floor(F.col(key) / ROWS_PER_FILE).alias("block")
    arrays = df.groupBy(block).agg(F.to_json(F.collect_list(F.struct(*df.columns)), {"ignoreNullFields": "false"}).alias("value"))
    arrays.write.partitionBy("block").text(path)


@query("src_json_records", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(t):
    path = scratch_path(t.spark, "records")
    write_arrays(t.customer, "c_custkey", path)
    return R.read_records(t.spark, path, TABLES["customer"]).drop("block")


@query("src_json_projected", "SELECT o_orderkey, o_orderpriority FROM orders")
def _(t):
    path = scratch_path(t.spark, "projected")
    write_arrays(t.orders.drop("o_orderdate"), "o_orderkey", path)
    return R.read_projected(t.spark, path, ["o_orderkey", "o_orderpriority"], TABLES["orders"]).drop("block")


@query("src_triple_questions", "SELECT 'part ' || p_partkey AS question, p_brand AS answer, '(' || p_name || ', type, ' || p_type || ')' AS triples FROM part")
def _(t):
    path = scratch_path(t.spark, "triples")
    rows = t.part.select(
        F.concat(F.lit("("), "p_name", F.lit(", type, "), "p_type", F.lit(")")).alias("KG Triples"),
        F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("query"), F.col("p_brand").alias("answer"),
    )
    rows.write.json(path)
    return R.read_qa(t.spark, path, lines=True)


@query("src_stringify", "SELECT conv_id, CAST(to_json({'role': role, 'turn': turn}) AS VARCHAR) AS head, CAST(to_json([role, 'x']) AS VARCHAR) AS tags, text FROM conversations")
def _(t):
    nested = t.conversations.select("conv_id", F.struct("role", "turn").alias("head"), F.array("role", F.lit("x")).alias("tags"), "text")
    return R.stringify_nested(nested)


@query("src_keyed_explode", "SELECT 'file' || o_custkey || '.csv' AS file, o_orderpriority AS question, CAST(o_orderkey AS VARCHAR) AS answer, o_orderstatus AS title FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal >= 0")
def _(t):
    path = scratch_path(t.spark, "keyed")
    one = F.struct(F.col("o_orderpriority").alias("Question name"), F.col("o_orderkey").cast("string").alias("Answer"), F.col("o_orderstatus").alias("Tittle"))
    name = F.concat(F.lit("file"), F.col("o_custkey").cast("string"), F.lit(".csv"))
    # each file holds one JSON object over at most ROWS_PER_FILE questions (order keys are unique)
    part = F.floor(F.col("o_orderkey") / ROWS_PER_FILE).alias("part")
    keyed = t.orders.groupBy(name.alias("file"), part).agg(F.collect_list(one).alias("qs"))
    keyed.groupBy("part").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("file", "qs")))).alias("value")).write.partitionBy("part").text(path)
    files = t.customer.filter("c_acctbal >= 0").select(F.concat(F.lit("file"), F.col("c_custkey").cast("string"), F.lit(".csv")).alias("file"))
    return R.read_keyed_questions(t.spark, path, files)


@query(
    "src_hash_csv",
    """SELECT CAST(floor(s_suppkey / 50) AS BIGINT) AS table_no, CAST(row_number() OVER (PARTITION BY floor(s_suppkey / 50) ORDER BY s_suppkey) - 1 AS INT) AS row_no,
        CAST(s_suppkey AS VARCHAR) AS id, replace(s_name, '#', ' ') AS name, CASE WHEN floor(s_suppkey / 50) % 2 = 0 THEN 'x' || s_suppkey END AS extra FROM supplier""",
)
def _(t):
    path = scratch_path(t.spark, "hash")
    rows = t.supplier.withColumn("no", F.floor(F.col("s_suppkey") / 50))  # prompt-sized tables of 50 rows
    even, key = F.col("no") % 2 == 0, F.col("s_suppkey").cast("string")
    line = F.concat_ws("#", key, F.replace("s_name", F.lit("#"), F.lit(" ")), F.when(even, F.concat(F.lit("x"), key)))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", line.alias("l")))), lambda r: r["l"]), "\n")
    header = F.when(even, "id#name#extra").otherwise("id#name")
    tables = rows.groupBy("no").agg(body.alias("b")).select("no", F.concat(header, F.lit("\n"), "b").alias("value"))
    tables.write.partitionBy("no").text(path)
    cell = lambda n: F.try_element_at("row", F.lit(n)).alias(n)
    read = R.read_delimited(t.spark, f"{path}/*/*.txt", "#").select("row_no", cell("id"), cell("name"), cell("extra"))
    return read.withColumn("table_no", F.floor(F.col("id").cast("bigint") / 50))


@query("src_lang_column", f"SELECT 'q' || pair_id AS question, gold AS answer FROM ({fx.CYPHER_PAIRS})")
def _(t):
    path = scratch_path(t.spark, "languages")
    rows = t.sql(fx.CYPHER_PAIRS).select(F.concat(F.lit("q"), F.col("pair_id").cast("string")).alias("question"), F.lit("SELECT 1").alias("sql"), F.col("gold").alias("cypher"), F.lit("db.a").alias("mql"))
    rows.write.options(header=True, quote='"', escape='"').csv(path)
    return R.read_by_language(t.spark, path, "Cypher")


@query("src_corpus", f"SELECT 'q' || pair_id AS question, gold AS context, pred AS answer FROM ({fx.SQL_PAIRS})")
def _(t):
    path = scratch_path(t.spark, "corpus")
    rows = t.sql(fx.SQL_PAIRS).select(F.concat(F.lit("q"), F.col("pair_id").cast("string")).alias("question"), F.col("gold").alias("context"), F.col("pred").alias("answer"))
    rows.write.options(header=True, quote='"', escape='"', quoteAll=True).csv(path)
    back = R.read_corpus(t.spark, path, "question STRING, context STRING, answer STRING")
    return back.withColumn("answer", F.coalesce("answer", F.lit("")))


_DATABASES = {"shop": ["customer", "orders", "lineitem"], "stock": ["part", "supplier"]}
_ASKED = "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'shop' WHEN 1 THEN 'stock' ELSE 'gone' END AS db_id FROM documents"
_CONTEXTS = ", ".join(f"('{db}', '{chr(10).join(catalog.table_ddl(n) for n in names)}')" for db, names in _DATABASES.items())


@query("catalog_text", f"SELECT doc_id, a.db_id, context FROM ({_ASKED}) a LEFT JOIN (VALUES {_CONTEXTS}) c(db_id, context) ON c.db_id = a.db_id")
def _(t):
    catalogs = catalog.catalog_text(t.spark, {**_DATABASES, "gone": []})
    return attach_context(t.sql(_ASKED), catalogs).select("doc_id", "db_id", "context")


def _sample_block(name: str, order: str) -> str:
    ddl = catalog.table_ddl(name).replace("'", "''")
    cells = " || ' | ' || ".join(f"coalesce(CAST({f.name} AS VARCHAR), 'None')" for f in TABLES[name].fields)
    return f"SELECT '{name}' AS table_name, '{ddl}' || chr(10) || '/*' || chr(10) || string_agg(l, chr(10) ORDER BY k) || chr(10) || '*/' AS block FROM (SELECT {order} AS k, {cells} AS l FROM {name} ORDER BY {order} LIMIT 3)"


_SAMPLED = {"nation": ["n_nationkey"], "customer": ["c_custkey"], "part": ["p_partkey"], "supplier": ["s_suppkey"]}


@query("catalog_samples", " UNION ALL ".join(_sample_block(n, k[0]) for n, k in _SAMPLED.items()))
def _(t):
    return catalog.catalog_samples(t.spark, t.folder, _SAMPLED)


_GIVEN = [*TABLES, "pages", "embeddings"]
_DDL_TYPES = "CASE WHEN data_type LIKE 'TIMESTAMP%' THEN 'TIMESTAMP' ELSE replace(replace(data_type, 'VARCHAR', 'TEXT'), 'DOUBLE', 'REAL') END"


@query(
    "catalog_of_given_tables",
    f"""SELECT table_name, 'CREATE TABLE "' || upper(table_name) || '" (' || string_agg(column_name || ' ' || {_DDL_TYPES}, ', ' ORDER BY ordinal_position) || ')' AS ddl
    FROM information_schema.columns WHERE table_name IN ({", ".join(f"'{n}'" for n in _GIVEN)}) GROUP BY table_name""",
)
def _(t):
    return catalog.catalog_of(t.spark, {name: t.spark.read.parquet(f"{t.folder}/{name}.parquet") for name in _GIVEN})


@query("catalog_samples_of_pages", """SELECT 'pages' AS table_name, 'CREATE TABLE "PAGES" (page_id BIGINT, url TEXT, html TEXT)' || chr(10) || '/*' || chr(10)
    || string_agg(page_id || ' | ' || coalesce(url, 'None') || ' | ' || coalesce(html, 'None'), chr(10) ORDER BY page_id) || chr(10) || '*/' AS block FROM (SELECT * FROM pages ORDER BY page_id LIMIT 3)""")
def _(t):
    return catalog.samples_of({"pages": t.spark.read.parquet(f"{t.folder}/pages.parquet")}, {"pages": ["page_id"]})


@query(
    "sink_roundtrip",
    "SELECT CASE WHEN conv_id % 10 = 0 THEN 'test' ELSE 'train' END AS part, role, text AS content, count(*) AS n FROM conversations GROUP BY ALL",
)
def _(t):
    path = scratch_path(t.spark, "messages")
    rows = t.conversations.select("conv_id", F.array(F.struct("role", F.col("text").alias("content"))).alias("messages"))
    K.write_messages(rows.filter("conv_id % 10 <> 0"), rows.filter("conv_id % 10 = 0"), path)
    out = None
    for part in ("train", "test"):
        one = t.spark.read.schema(MESSAGES).parquet(f"{path}/{part}_messages.parquet").select(F.lit(part).alias("part"), F.explode("messages").alias("m"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("part", "m.role", "m.content").agg(F.count("*").alias("n"))


@query("sink_result", "SELECT 'model' AS model, metric, value, '0.5' AS arg FROM (SELECT event_type AS metric, CAST(round(CAST(avg(value) AS DECIMAL(18, 9)), 3) AS DOUBLE) AS value FROM events GROUP BY 1), (SELECT unnest([1, 2]) AS run)")
def _(t):
    path = scratch_path(t.spark, "results")
    means = A.mean_scores(t.sql(fx.EVENT_SCORES))
    for _run in range(2):  # appended, not replaced
        K.append_result(means, {"temperature": 0.5}, "model", path)
    back = t.spark.read.schema("model STRING, scores MAP<STRING, DOUBLE>, args MAP<STRING, STRING>").json(path)
    return back.select("model", F.explode("scores").alias("metric", "value"), F.col("args")["temperature"].alias("arg"))


@query("sink_stats", "SELECT 'model' AS model, event_type AS metric, round(avg(value), 6) AS mean, '120' AS arg FROM events GROUP BY 2")
def _(t):
    path = scratch_path(t.spark, "stats")
    stats = A.sample_statistics(t.sql(fx.EVENT_SCORES))
    K.append_stats(stats, {"samples": 120}, "model", path)
    back = t.spark.read.schema("model STRING, metric STRING, mean DOUBLE, std DOUBLE, ci_lower DOUBLE, ci_upper DOUBLE, args MAP<STRING, STRING>").parquet(path)
    return back.select("model", "metric", F.round("mean", 6).alias("mean"), F.col("args")["samples"].alias("arg"))
