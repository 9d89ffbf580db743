"""Check queries for corpus preparation (prep_) and prompt building (build_)."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import functions as F

from querygauge.fixed_values import LANGUAGE_EXAMPLES_TEMPLATE, SQL_EVIDENCE_TEMPLATE, SQL_TEMPLATE, THINKING_SYSTEM, DOCUMENT_NOTE
from querygauge.functions import prompts as B
from querygauge.operators import corpus as P
from querygauge.plans import fixtures as fx
from querygauge.plans.registry import query
from querygauge.plans.text_queries import q, sql_table_names

CATALOG = """
SELECT 'src' || CAST(n_nationkey AS STRING) AS db_id,
  CASE WHEN n_nationkey % 5 = 1 THEN NULL ELSE 'CREATE TABLE "' || n_name || '" (n_nationkey INTEGER) {braces}' END AS context FROM nation
"""


def md5_key(key: str) -> str:
    return f"md5('42|' || CAST({key} AS VARCHAR))"


@query("prep_rename", "SELECT doc_id AS example_id, text AS question, lang AS query_type, source AS db_id FROM documents")
def _(t):
    return P.to_canonical(t.documents, {"doc_id": "example_id", "text": "question", "lang": "query_type", "source": "db_id"}, drop=["n_chars"])


@query("prep_filter", "SELECT doc_id, source FROM documents WHERE lang = 'fr'")
def _(t):
    return t.documents.filter(F.col("lang") == "fr").select("doc_id", "source")


@query("prep_valid_join", f"SELECT example_id, d.db_id, context FROM ({fx.CORPUS}) d JOIN ({CATALOG}) c ON c.db_id = d.db_id WHERE context IS NOT NULL")
def _(t):
    return P.keep_valid(t.sql(fx.CORPUS), t.sql(CATALOG)).select("example_id", "db_id", "context")


@query("prep_context_join", f"SELECT example_id, d.db_id, context FROM ({fx.CORPUS}) d LEFT JOIN ({CATALOG}) c ON c.db_id = d.db_id")
def _(t):
    return P.attach_context(t.sql(fx.CORPUS), t.sql(CATALOG)).select("example_id", "db_id", "context")


@query("prep_seeded_order", f"SELECT o_orderkey, row_number() OVER (ORDER BY {md5_key('o_orderkey')}, o_orderkey) AS rank FROM orders")
def _(t):
    return P.seeded_rank(t.orders.select("o_orderkey"), "o_orderkey")


_RANKED = f"SELECT *, row_number() OVER (ORDER BY {md5_key('example_id')}, example_id) AS r, count(*) OVER () AS n FROM ({fx.CORPUS})"


@query(
    "prep_split",
    f"""SELECT example_id, question, CASE WHEN r <= floor(0.9 * n) THEN 'train' WHEN r <= floor(0.95 * n) THEN 'validation' ELSE 'test' END AS split
      FROM ({_RANKED})""",
)
def _(t):
    parts = [("train", 0, 0.9), ("validation", 0.9, 0.95), ("test", 0.95, 1)]
    return P.split(t.sql(fx.CORPUS), parts, "example_id").select("example_id", "question", "split")


_OTHER = "SELECT d.text AS question FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality = 0 OR l.toxic = 1"


@query(
    "prep_decontaminate",
    f"SELECT example_id, question FROM ({fx.CORPUS}) c WHERE NOT EXISTS (SELECT 1 FROM ({_OTHER}) o WHERE o.question IS NOT DISTINCT FROM c.question)",
)
def _(t):
    return P.decontaminate(t.sql(fx.CORPUS), t.sql(_OTHER)).select("example_id", "question")


_BALANCED = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_type ORDER BY {md5_key('example_id')}, example_id) AS r_,
  (SELECT min(c) FROM (SELECT count(*) AS c FROM documents GROUP BY lang)) AS least_ FROM ({fx.CORPUS})) WHERE r_ <= least_"""


@query("prep_balance", f"SELECT example_id, query_type, question FROM ({_BALANCED})")
def _(t):
    return P.balance(t.sql(fx.CORPUS), "query_type", "example_id").select("example_id", "query_type", "question")


@query(
    "prep_union",
    "SELECT doc_id AS example_id, text AS question, lang AS query_type FROM documents UNION ALL SELECT -1 - item_id, text, NULL FROM benchmark",
)
def _(t):
    docs = t.documents.select(F.col("doc_id").alias("example_id"), F.col("text").alias("question"), F.col("lang").alias("query_type"))
    return P.concat([docs, t.benchmark.select((-1 - F.col("item_id")).alias("example_id"), F.col("text").alias("question"))])


@query("prep_sample_n", f"SELECT example_id, question FROM ({_RANKED}) WHERE r <= 120")
def _(t):
    return P.sample_n(t.sql(fx.CORPUS), 120, "example_id").select("example_id", "question")


@query(
    "prep_answerable_union",
    f"""SELECT pair_id, question, gold AS answer, 'orders' AS title FROM ({fx.ANSWERS}) WHERE gold <> 'Unanswerable'
      UNION ALL SELECT pair_id, question, 'Unanswerable', 'the table' FROM ({fx.ANSWERS}) WHERE gold = 'Unanswerable'""",
)
def _(t):
    rows = t.sql(fx.ANSWERS).select("pair_id", "question", F.col("gold").alias("answer"))
    known = rows.filter(F.col("answer") != "Unanswerable").withColumn("title", F.lit("orders"))
    return P.answerable_union(known, rows.filter(F.col("answer") == "Unanswerable").select("pair_id", "question"))


@query("prep_drop_overlong", "SELECT doc_id, text FROM documents WHERE len(string_split_regex(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '\\s+')) <= 1024")
def _(t):
    return P.drop_overlong(t.documents, "text", 1024).select("doc_id", "text")


@query(
    "prep_rows_to_json",
    """SELECT o_custkey, CAST(floor(o_orderkey / 10000) AS BIGINT) AS block,
        '[' || string_agg(to_json({'status': o_orderstatus, 'priority': o_orderpriority, 'number': o_orderkey}), ',' ORDER BY o_orderkey) || ']' AS table_json
      FROM orders GROUP BY ALL""",
)
def _(t):
    rows = t.orders.select(
        "o_custkey", "o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("number")
    )
    return P.rows_to_json(rows, "o_custkey", "o_orderkey", block=10_000)


# --- prompts ------------------------------------------------------------------------------------


def sql_render(template: str, **values: str) -> str:
    pieces = []
    for literal, field, _, _ in Formatter().parse(template):
        if literal:
            pieces.append(q(literal))
        if field is not None:
            pieces.append(f"coalesce(CAST({values[field]} AS VARCHAR), 'None')")
    return " || ".join(pieces)


_WITH_CONTEXT = f"SELECT d.*, c.context FROM ({fx.CORPUS}) d LEFT JOIN ({CATALOG}) c ON c.db_id = d.db_id"


@query("build_prompt", f"SELECT example_id, {sql_render(SQL_TEMPLATE, context='context', question='question')} AS prompt FROM ({_WITH_CONTEXT})")
def _(t):
    df = t.sql(_WITH_CONTEXT)
    return df.select("example_id", B.render(SQL_TEMPLATE, context=F.col("context"), question=F.col("question")).alias("prompt"))


@query(
    "build_prompt_evidence",
    f"""SELECT example_id, CASE WHEN n_chars % 2 = 0 THEN {sql_render(SQL_EVIDENCE_TEMPLATE, context='context', evidence='db_id', question='question')}
      ELSE {sql_render(SQL_TEMPLATE, context='context', question='question')} END AS prompt FROM ({_WITH_CONTEXT})""",
)
def _(t):
    values = {"context": F.col("context"), "question": F.col("question")}
    prompt = B.render_if(
        F.col("n_chars") % 2 == 0, B.render(SQL_EVIDENCE_TEMPLATE, evidence=F.col("db_id"), **values), B.render(SQL_TEMPLATE, **values)
    )
    return t.sql(_WITH_CONTEXT).select("example_id", prompt.alias("prompt"))


# few-shot blocks per language, made of the first parts of each size class
EXAMPLES = """
SELECT language, examples, CASE WHEN language = 'mongodb' THEN 'NOTE' ELSE '' END AS note FROM (
  SELECT CASE p_size % 3 WHEN 0 THEN 'sql' WHEN 1 THEN 'cypher' ELSE 'mongodb' END AS language, min('Question: which is ' || p_name || '?') AS examples
  FROM part GROUP BY CASE p_size % 3 WHEN 0 THEN 'sql' WHEN 1 THEN 'cypher' ELSE 'mongodb' END
) t
"""
ASKED = """
SELECT doc_id AS example_id, text AS question, source AS context, CASE doc_id % 3 WHEN 0 THEN 'sql' WHEN 1 THEN 'cypher' ELSE 'mongodb' END AS language FROM documents
"""


@query(
    "build_fewshot",
    f"""SELECT example_id, a.language, {sql_render(LANGUAGE_EXAMPLES_TEMPLATE, language='a.language', note=f"replace(note, 'NOTE', {q(DOCUMENT_NOTE)})", examples='examples', context='context', question='question')} AS prompt
      FROM ({ASKED}) a JOIN ({EXAMPLES}) e ON e.language = a.language""",
)
def _(t):
    shots = t.sql(EXAMPLES).withColumn("note", F.replace("note", F.lit("NOTE"), F.lit(DOCUMENT_NOTE)))
    df = t.sql(ASKED).join(shots, "language")
    fields = {c: F.col(c) for c in ("language", "note", "examples", "context", "question")}
    return df.select("example_id", "language", B.render(LANGUAGE_EXAMPLES_TEMPLATE, **fields).alias("prompt"))


_SYSTEM = q(THINKING_SYSTEM)
_COMPLETION = "'<think> ' || replace(replace(prev, '<thinking>', ''), '</thinking>', '') || ' </think>```sql ' || body || ' ```<end>'"


@query(
    "build_messages",
    f"""SELECT conv_id, turn, 3 AS n, 'system,user,assistant' AS roles, {_SYSTEM} AS m1, {sql_render(SQL_TEMPLATE, context='language', question='prev')} AS m2, {_COMPLETION} AS m3
      FROM ({fx.RESPONSES})""",
)
def _(t):
    user = B.render(SQL_TEMPLATE, context=F.col("language"), question=F.col("prev"))
    done = B.completion(F.col("prev"), F.col("body"), F.lit("sql"), "<end>")
    m = t.sql(fx.RESPONSES).select("conv_id", "turn", B.messages(F.lit(THINKING_SYSTEM), user, done).alias("m"))
    text = lambda i: F.element_at("m", i)["content"].alias(f"m{i}")
    return m.select("conv_id", "turn", F.size("m").alias("n"), F.array_join("m.role", ",").alias("roles"), text(1), text(2), text(3))


@query(
    "build_thinking",
    f"SELECT conv_id, turn, '<think> ' || replace(replace(response, '<thinking>', ''), '</thinking>', '') || ' </think>' AS thinking FROM ({fx.RESPONSES})",
)
def _(t):
    return t.sql(fx.RESPONSES).select("conv_id", "turn", B.clean_thinking(F.col("response")).alias("thinking"))


@query(
    "build_completion",
    f"SELECT conv_id, turn, {_COMPLETION} AS with_thinking, '```' || lower(language) || ' ' || body || ' ```<end>' AS bare FROM ({fx.RESPONSES})",
)
def _(t):
    return t.sql(fx.RESPONSES).select(
        "conv_id", "turn", B.completion(F.col("prev"), F.col("body"), F.lit("sql"), "<end>").alias("with_thinking"),
        B.completion(None, F.col("body"), F.lower("language"), "<end>").alias("bare"),
    )


BLOCKS = """
SELECT 'orders' AS table_name, 'CREATE TABLE "ORDERS" rows ' || CAST(count(*) AS STRING) AS block FROM orders
UNION ALL SELECT 'customer', 'CREATE TABLE "CUSTOMER" rows ' || CAST(count(*) AS STRING) FROM customer
"""


@query(
    "build_table_info",
    f"""SELECT pair_id, ' ' || coalesce(string_agg('Information for Table ' || p.name || ': ' || coalesce(b.block, '') || chr(10), '' ORDER BY p.name), '') AS table_info
      FROM (SELECT pair_id, unnest({sql_table_names('gold')}) AS name FROM ({fx.SQL_PAIRS})) p LEFT JOIN ({BLOCKS}) b ON b.table_name = p.name GROUP BY pair_id""",
)
def _(t):
    return P.table_info_for(t.sql(fx.SQL_PAIRS), t.sql(BLOCKS), "pair_id", "gold")


@query("build_triples", "SELECT l_orderkey, l_linenumber, l_partkey, '[(order ' || l_orderkey || ', holds, part ' || l_partkey || '), (part ' || l_partkey || ', from, supplier ' || l_suppkey || ')]' AS triples FROM lineitem")
def _(t):
    name = lambda kind, c: F.concat(F.lit(kind + " "), F.col(c).cast("string"))
    triple = lambda s, p, o: F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    part = name("part", "l_partkey")
    both = F.array(triple(name("order", "l_orderkey"), "holds", part), triple(part, "from", name("supplier", "l_suppkey")))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", B.triples_text(both).alias("triples"))
