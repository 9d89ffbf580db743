"""Check queries for the task jobs (t_)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from querygauge.fixed_values import CYPHER_TEMPLATE, LANGUAGE_TAGS, SQL_TEMPLATE, THINKING_SYSTEM
from querygauge.plans import exec_queries as ex, fixtures as fx, tasks as T
from querygauge.plans.corpus_queries import md5_key, sql_render
from querygauge.plans.registry import Tables, query
from querygauge.plans.score_queries import METRICS, SQL_ANSWER_SCORES, sql_f1, sql_long
from querygauge.plans.text_queries import _LCS, q, sql_block, sql_bleu, sql_exact, sql_normalise, sql_words
from querygauge.sources import sinks
from querygauge.schemas import MESSAGES
from querygauge.session import scratch_path


def _examples(t: Tables) -> DataFrame:
    """Executed pairs as examples with fenced responses."""
    rows = [(i, gold, f"<think> so </think>```sql {pred} ```") for i, gold, pred in ex.TEXTS]
    for _, gold, pred in ex.TEXTS:
        t.register(f"{gold} {pred}")
    return t.spark.createDataFrame(rows, "pair_id BIGINT, gold STRING, response STRING")


def _pair_values() -> str:
    return ", ".join(f"({i}, {q(g)}, {q(p)})" for i, g, p in ex.TEXTS)


@query(
    "t_sql_match",
    f"""WITH r AS (SELECT pair_id, set_equal FROM ({ex._REPORT}) WHERE gold_status = 'ok' AND gold_rows > 0),
      e AS (SELECT i, {sql_exact('g_', 'p_')} AS exact FROM (SELECT i, {sql_normalise('g')} AS g_, {sql_normalise('p')} AS p_ FROM (VALUES {_pair_values()}) v(i, g, p)))
      SELECT 'execution_accuracy' AS metric, CAST(round(CAST(avg(set_equal) AS DECIMAL(18, 9)), 3) AS DOUBLE) AS value FROM r UNION ALL SELECT 'exact_match', CAST(round(CAST(avg(exact) AS DECIMAL(18, 9)), 3) AS DOUBLE) FROM r JOIN e ON e.i = r.pair_id""",
)
def _(t):
    return T.sql_match(t.spark, _examples(t))


_LOWER = " UNION ALL ".join(ex._columns(i, ex.Pair(p.gold.lower(), p.pred.lower(), p.gold_kinds, p.pred_kinds, p.pred_ok, p.gold_ok)) for i, p in enumerate(ex.PAIRS))
_CLINICAL_METRICS = ["accuracy", "acc2", "precision_ans", "precision_exec", "recall_ans", "recall_exec"]
_CLINICAL = f"""SELECT pair_id, top_equal AS accuracy, char_equal AS acc2, CASE WHEN pred_status <> 'null' THEN CAST(gold_status <> 'null' AS INT) END AS precision_ans,
  CASE WHEN pred_status <> 'null' THEN char_equal END AS precision_exec, CASE WHEN gold_status <> 'null' THEN CAST(pred_status <> 'null' AS INT) END AS recall_ans,
  CASE WHEN gold_status <> 'null' THEN char_equal END AS recall_exec FROM ({_LOWER})"""


@query(
    "t_sql_answerable",
    f"""WITH w AS ({_CLINICAL}), m AS (SELECT 0 AS g, metric, CAST(round(CAST(avg(value) AS DECIMAL(18, 9)), 3) AS DOUBLE) AS value FROM ({sql_long('SELECT * FROM w', _CLINICAL_METRICS)}) GROUP BY metric)
      SELECT metric, value FROM m UNION ALL SELECT metric, value FROM ({sql_f1('m', 'g')})""",
)
def _(t):
    return T.sql_answerable(t.spark, _examples(t))


_CYPHER = f"""SELECT pair_id, 'q ' || CAST(pair_id AS STRING) AS question, gold, '<think> so </think>```cypher ' || pred || ' ```' AS response,
  CASE pair_id % 3 WHEN 0 THEN 'Correct' WHEN 1 THEN 'CORRECT' ELSE 'Wrong' END AS verdict FROM ({fx.CYPHER_PAIRS}) c"""
_SEEN = "SELECT 'q ' || CAST(c_custkey AS STRING) AS question FROM customer"
_CYPHER_TEST = f"""SELECT pair_id, lower(gold) AS gold, lower(upper({sql_block('lower(response)', 'cypher', q(' '))})) AS pred, CAST(lower(verdict) = 'correct' AS INT) AS verdict FROM (
  SELECT *, row_number() OVER (ORDER BY {md5_key('pair_id')}, pair_id) AS r, count(*) OVER () AS n FROM ({_CYPHER}) WHERE question NOT IN ({_SEEN})) WHERE r > floor(0.95 * n)"""


@query(
    "t_cypher_text",
    f"""SELECT 'bleu' AS metric, CAST(round(CAST(avg(bleu) AS DECIMAL(18, 9)), 3) AS DOUBLE) AS value FROM ({sql_bleu(_CYPHER_TEST)})
      UNION ALL SELECT 'verdict', CAST(round(CAST(avg(verdict) AS DECIMAL(18, 9)), 3) AS DOUBLE) FROM ({_CYPHER_TEST})
      UNION ALL SELECT 'exact_match', CAST(round(CAST(avg({sql_exact('g_', 'p_')}) AS DECIMAL(18, 9)), 3) AS DOUBLE) FROM (SELECT {sql_normalise('gold')} AS g_, {sql_normalise('pred')} AS p_ FROM ({_CYPHER_TEST}))""",
)
def _(t):
    return T.cypher_text(t.sql(_CYPHER), t.sql(_SEEN))


@query(
    "t_table_qa",
    f"""WITH m AS (SELECT 0 AS g, metric, CAST(round(CAST(avg(value) AS DECIMAL(18, 9)), 3) AS DOUBLE) AS value FROM ({sql_long(SQL_ANSWER_SCORES, METRICS)}) GROUP BY metric)
      SELECT metric, value FROM m UNION ALL SELECT metric, value FROM ({sql_f1('m', 'g')})""",
)
def _(t):
    rows = t.sql(fx.ANSWERS).select("pair_id", "question", "response", F.col("gold").alias("answer"))
    known = rows.filter("answer <> 'Unanswerable'").withColumn("title", F.lit("orders"))
    return T.table_qa(known, rows.filter("answer = 'Unanswerable'").drop("answer"))


_FACTS = f"SELECT pair_id, gold, response, CASE WHEN gold = 'True' THEN 'Other' ELSE 'FactChecking' END AS qtype FROM ({fx.ANSWERS}) a"
_FACT_PAIRS = f"""SELECT pair_id, coalesce(nullif(regexp_extract(gold, '\\d+\\.\\d+|\\d+'), ''), gold) AS gold,
  CASE WHEN contains(response, 'Final Answer:') THEN string_split(response, 'Final Answer:')[-1] ELSE '' END AS pred FROM ({_FACTS}) WHERE qtype = 'FactChecking'"""


@query(
    "t_fact_check",
    f"""SELECT 'exact_match' AS metric, CAST(round(CAST(avg({sql_exact('g_', 'p_')}) AS DECIMAL(18, 9)), 3) AS DOUBLE) AS value FROM (SELECT {sql_normalise('gold')} AS g_, {sql_normalise('pred')} AS p_ FROM ({_FACT_PAIRS}))
      UNION ALL SELECT 'rouge', CAST(round(CAST(avg(CASE WHEN len(pw) = 0 OR lcs = 0 THEN 0.0 ELSE 2.0 * lcs / (len(gw) + len(pw)) END) AS DECIMAL(18, 9)), 3) AS DOUBLE) FROM (
        SELECT gw, pw, CASE WHEN len(pw) = 0 OR len(gw) = 0 THEN 0 ELSE CAST({_LCS} AS INT) END AS lcs FROM (
          SELECT {sql_words('lower(gold)')} AS gw, {sql_words('lower(pred)')} AS pw FROM ({_FACT_PAIRS})))""",
)
def _(t):
    return T.fact_check(t.sql(_FACTS))


_YES = f"SELECT pair_id, CASE WHEN gold LIKE '%e%' THEN 'True' WHEN gold LIKE '%E%' THEN 'False' ELSE gold END AS gold, replace(response, 'y e s', 'Y es ') AS response FROM ({fx.ANSWERS}) a"


@query(
    "t_triple_qa",
    f"""SELECT 'exact_match' AS metric, CAST(round(CAST(avg({sql_exact('g_', 'p_')}) AS DECIMAL(18, 9)), 3) AS DOUBLE) AS value FROM (SELECT {sql_normalise('gold')} AS g_, {sql_normalise('answer')} AS p_ FROM (
      SELECT gold, CASE lower(replace(tail, ' ', '')) WHEN 'yes' THEN 'True' WHEN 'no' THEN 'False' ELSE tail END AS answer FROM (
        SELECT gold, lower(string_split(response, 'Final Answer:')[-1]) AS tail FROM ({_YES}))))""",
)
def _(t):
    return T.triple_qa(t.sql(_YES))


_LANGUAGES = f"SELECT conv_id * 100 + turn AS pair_id, language, response, CASE turn % 2 WHEN 0 THEN 'correct' ELSE 'wrong' END AS verdict FROM ({fx.RESPONSES}) r"
_FOUND = " ".join(f"WHEN lower(language) = {q(k)} THEN {sql_block('lower(response)', tag, q(' '))}" for k, tag in LANGUAGE_TAGS.items())


@query(
    "t_multi_language",
    f"""WITH w AS (SELECT language, CAST(verdict = 'correct' AS INT) AS v, CAST((CASE {_FOUND} ELSE ' ' END) <> ' ' AS INT) AS f FROM ({_LANGUAGES}))
      SELECT language, 'verdict' AS metric, CAST(round(CAST(avg(v) AS DECIMAL(18, 9)), 3) AS DOUBLE) AS value FROM w GROUP BY 1 UNION ALL SELECT language, 'found', CAST(round(CAST(avg(f) AS DECIMAL(18, 9)), 3) AS DOUBLE) FROM w GROUP BY 1""",
)
def _(t):
    return T.multi_language(t.sql(_LANGUAGES))


# --- training sets ------------------------------------------------------------------------------


def _corpus(pairs: str, kind: str) -> str:
    """Corpus of every pair; the answer is the predicted text, and Cypher has one row more for every third pair."""
    more = f" UNION ALL SELECT pair_id + 1000000000, gold, pred FROM ({pairs}) p WHERE pair_id % 3 = 0" if kind == "cypher" else ""
    return f"""SELECT '{kind}:' || CAST(pair_id AS STRING) AS example_id, 'q ' || CAST(pair_id AS STRING) AS question, 'tables of ' || CAST(pair_id AS STRING) AS context,
      pred AS answer, '<thinking>' || gold || '</thinking>' AS thinking FROM (SELECT pair_id, gold, pred FROM ({pairs}) p{more}) u"""


_SQL_CORPUS, _CYPHER_CORPUS = _corpus(fx.SQL_PAIRS, "sql"), _corpus(fx.CYPHER_PAIRS, "cypher")
_ORDER = f"ORDER BY {md5_key('example_id')}, example_id"
_BOTH = f"SELECT *, 'sql' AS query_type FROM ({_SQL_CORPUS}) UNION ALL SELECT *, 'cypher' FROM ({_CYPHER_CORPUS})"
_PROMPT = f"CASE query_type WHEN 'sql' THEN {sql_render(SQL_TEMPLATE, context='context', question='question')} ELSE {sql_render(CYPHER_TEMPLATE, context='context', question='question')} END"
_DONE = "'<think> ' || replace(replace(thinking, '<thinking>', ''), '</thinking>', '') || ' </think>```' || query_type || ' ' || answer || ' ```<end>'"


def _even(parts: str) -> str:
    """Rows of (…, query_type, split) cut, per split, to the size of the smallest class."""
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY split, query_type {_ORDER}) AS r_ FROM ({parts})) JOIN (
      SELECT split, min(c) AS least_ FROM (SELECT split, query_type, count(*) AS c FROM ({parts}) GROUP BY ALL) GROUP BY split) USING (split) WHERE r_ <= least_"""


_RANKED = f"SELECT *, row_number() OVER (PARTITION BY query_type {_ORDER}) AS r, count(*) OVER (PARTITION BY query_type) AS n FROM ({_BOTH})"


@query(
    "t_training_mix",
    f"""SELECT split, md5({q(THINKING_SYSTEM)} || {_PROMPT} || {_DONE}) AS digest, {_DONE} AS done FROM (
      {_even(f"SELECT *, CASE WHEN r <= floor(0.99 * n) THEN 'train' ELSE 'test' END AS split FROM ({_RANKED})")})""",
)
def _(t):
    mix = T.training_mix({"sql": t.sql(_SQL_CORPUS), "cypher": t.sql(_CYPHER_CORPUS)}, "<end>")
    path = scratch_path(t.spark, "mix")
    sinks.write_messages(mix.filter("split = 'train'"), mix.filter("split = 'test'"), path)
    out = None
    for part in ("train", "test"):
        m = t.spark.read.schema(MESSAGES).parquet(f"{path}/{part}_messages.parquet")
        digest = F.md5(F.array_join("messages.content", ""))
        one = m.select(F.lit(part).alias("split"), digest.alias("digest"), F.element_at("messages", 3)["content"].alias("done"))
        out = one if out is None else out.unionByName(one)
    return out


_RL = f"""SELECT *, CASE WHEN query_type = 'sql' AND r <= floor(0.95 * n) THEN 'train' WHEN query_type = 'sql' THEN 'validation'
    WHEN r <= floor(0.9 * n) THEN 'train' WHEN r <= floor(0.95 * n) THEN 'validation' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY query_type {_ORDER}) AS r, count(*) OVER (PARTITION BY query_type) AS n
    FROM ({_BOTH}) WHERE query_type = 'sql' OR question NOT IN ({_SEEN}))"""
_RL_PARTS = f"SELECT * FROM ({_RL}) WHERE split IS NOT NULL"


@query("t_rl_mix", f"SELECT example_id, query_type, split, question, answer, context, {_PROMPT} AS asked FROM ({_even(_RL_PARTS)})")
def _(t):
    mix = T.rl_mix(t.sql(_SQL_CORPUS), t.sql(_CYPHER_CORPUS), t.sql(_SEEN))
    return mix.withColumn("asked", F.element_at("prompt", 2)["content"]).drop("prompt")


@query(
    "t_sft_mix",
    f"""SELECT example_id, query_type, CASE WHEN r2 <= floor(0.99 * n2) THEN 'train' ELSE 'validation' END AS split, {_PROMPT} || chr(10) || {_DONE} AS text
      FROM (SELECT *, row_number() OVER ({_ORDER}) AS r2, count(*) OVER () AS n2 FROM (SELECT * FROM ({_RANKED}) WHERE r <= (SELECT min(n) FROM ({_RANKED}))))""",
)
def _(t):
    return T.sft_mix({"sql": t.sql(_SQL_CORPUS), "cypher": t.sql(_CYPHER_CORPUS)}, "<end>")


_REWARDED = f"""
SELECT pair_id, query_type, gold, '<think> so </think>```' || query_type || ' ' || pred || ' ```' AS response,
  CASE pair_id % 6 WHEN 0 THEN 'Excellent' WHEN 1 THEN 'Good' WHEN 2 THEN 'Above average' WHEN 3 THEN 'Average' WHEN 4 THEN 'Bad' ELSE 'Very bad' END AS grade
FROM (SELECT pair_id, query_type, gold, pred FROM ({fx.SQL_PAIRS}) s UNION ALL SELECT -1 - pair_id, query_type, gold, pred FROM ({fx.CYPHER_PAIRS}) c) p
"""


@query("t_reward_table")
def _(t):
    table = T.reward_table(t.sql(_REWARDED))
    return table.select("pair_id", *[F.round(c, 6).alias(c) for c in table.columns[1:]])
