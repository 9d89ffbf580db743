"""Check queries for verdicts, aggregation (a_) and running tables (z_)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from querygauge.fixed_values import GRADE_SCORES
from querygauge.functions import extract as X
from querygauge.operators import aggregate as A, textscore as M
from querygauge.plans import fixtures as fx
from querygauge.plans.registry import Tables, query
from querygauge.plans.text_queries import BLANKS, q, sql_bleu, sql_exact, sql_normalise
from querygauge.schemas import TABLES
from querygauge.session import scratch_path
from querygauge.streaming.running import iteration_progress, running_scores

_GRADE = "CASE grade " + " ".join(f"WHEN {q(g)} THEN CAST({v} AS DOUBLE)" for g, v in GRADE_SCORES.items()) + " END"


@query("a_grade_score", f"SELECT prompt_key, idx, grade, coalesce({_GRADE}, 0) AS score FROM ({fx.VERDICTS})")
def _(t):
    return t.sql(fx.VERDICTS).withColumn("score", A.grade_to_score(F.col("grade")))


@query(
    "a_grade_group",
    f"""WITH v AS (SELECT *, {_GRADE} AS s FROM ({fx.VERDICTS})), a AS (SELECT * FROM ({fx.PROMPT_ANSWERS})),
      bad AS (SELECT prompt_key FROM v GROUP BY 1 HAVING bool_or(s IS NULL) OR count(*) > (SELECT count(*) FROM a WHERE a.prompt_key = v.prompt_key))
      SELECT a.prompt_key, a.idx, CASE WHEN a.prompt_key IN (SELECT prompt_key FROM bad) THEN CAST(0 AS DOUBLE) ELSE coalesce(v.s, 0) END AS score
      FROM a LEFT JOIN v ON v.prompt_key = a.prompt_key AND v.idx = a.idx""",
)
def _(t):
    return A.grade_group_score(t.sql(fx.PROMPT_ANSWERS), t.sql(fx.VERDICTS))


@query("a_binary_verdict", f"SELECT pair_id, CASE WHEN lower(gold) = 'true' THEN 1 ELSE 0 END AS verdict FROM ({fx.ANSWERS})")
def _(t):
    verdict = F.regexp_replace("gold", "^True$", "CoRRect")
    return t.sql(fx.ANSWERS).select("pair_id", A.binary_verdict(verdict).alias("verdict"))


# three scores per order line text: discount, tax and a missing one for some
_THREE = """
SELECT p_partkey AS pair_id, 'component_or_graph' AS metric, CAST(p_size AS DOUBLE) / 50 AS value FROM part
UNION ALL SELECT p_partkey, 'verdict', CAST(p_partkey % 5 AS DOUBLE) / 4 FROM part WHERE p_partkey % 3 <> 0
UNION ALL SELECT p_partkey, 'sequence', p_retailprice / 10000 FROM part
"""


@query("a_combine_mean", f"SELECT pair_id, round(sum(value) / 3, 6) AS combined FROM ({_THREE}) GROUP BY pair_id")
def _(t):
    scores = A.combine_mean(t.sql(_THREE), "pair_id", ["component_or_graph", "verdict", "sequence"])
    return scores.select("pair_id", F.round("combined", 6).alias("combined"))


@query(
    "a_combine_weighted",
    f"SELECT pair_id, round(sum(CASE metric WHEN 'component_or_graph' THEN 0.4 ELSE 0.3 END * value), 6) AS combined FROM ({_THREE}) GROUP BY pair_id",
)
def _(t):
    return A.combine_weighted(t.sql(_THREE), "pair_id").select("pair_id", F.round("combined", 6).alias("combined"))


METRICS = ["exact_match", "contains", "precision_ans", "precision_exec", "recall_ans", "recall_exec"]


def answer_scores(answers: DataFrame) -> DataFrame:
    """Wide scores of (pair_id, gold, response) rows: the answer follows the reasoning."""
    final, gold = X.after_marker(F.col("response"), "</think>"), F.col("gold")
    exact = M.exact_match(gold, final)
    answered = F.lower(X.strip(final)) != "unanswerable"
    parts = A.answer_precision_recall(gold != "Unanswerable", answered, exact)
    return answers.select(
        "pair_id", "gold", final.alias("final"), exact.alias("exact_match"), M.contains_match(gold, final).alias("contains"),
        *[c.alias(n) for n, c in parts.items()],
    )


SQL_ANSWER_SCORES = f"""
SELECT pair_id, gold, final, exact_match, CAST(contains(lower(final), lower(gold)) AS INT) AS contains,
  CASE WHEN pa THEN CAST(ga AS INT) END AS precision_ans, CASE WHEN pa THEN exact_match END AS precision_exec,
  CASE WHEN ga THEN CAST(pa AS INT) END AS recall_ans, CASE WHEN ga THEN exact_match END AS recall_exec
FROM (SELECT *, {sql_exact('g_', 'p_')} AS exact_match, gold <> 'Unanswerable' AS ga, lower(trim(final, {BLANKS})) <> 'unanswerable' AS pa
  FROM (SELECT *, {sql_normalise('gold')} AS g_, {sql_normalise('final')} AS p_ FROM (SELECT *, string_split(response, '</think>')[-1] AS final FROM ({fx.ANSWERS}))))
"""


@query("a_answer_pr", f"SELECT pair_id, precision_ans, precision_exec, recall_ans, recall_exec FROM ({SQL_ANSWER_SCORES})")
def _(t):
    return answer_scores(t.sql(fx.ANSWERS)).select("pair_id", *METRICS[2:])


@query("a_mean_scores", f"SELECT metric, CAST(round(CAST(avg(value) AS DECIMAL(18, 9)), 3) AS DOUBLE) AS value FROM ({fx.EVENT_SCORES}) GROUP BY metric")
def _(t):
    return A.mean_scores(t.sql(fx.EVENT_SCORES))


def sql_long(wide: str, metrics: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT pair_id, {q(m)} AS metric, CAST({m} AS DOUBLE) AS value FROM ({wide}) WHERE {m} IS NOT NULL" for m in metrics)


def sql_f1(means: str, by: str) -> str:
    """F1 rows (by, metric, value) from a CTE of means."""
    one = lambda s: f"""SELECT {by}, 'f1_{s}' AS metric, round(2 * p * r / (p + r + 1e-10), 3) AS value FROM (
      SELECT {by}, max(value) FILTER (metric = 'precision_{s}') AS p, max(value) FILTER (metric = 'recall_{s}') AS r FROM {means} GROUP BY {by}) WHERE p IS NOT NULL AND r IS NOT NULL"""  # noqa: E731
    return f"{one('ans')} UNION ALL {one('exec')}"


@query(
    "a_f1",
    f"""WITH m AS (SELECT 0 AS g, metric, CAST(round(CAST(avg(value) AS DECIMAL(18, 9)), 3) AS DOUBLE) AS value FROM ({sql_long(SQL_ANSWER_SCORES, METRICS)}) GROUP BY metric)
      SELECT metric, value FROM ({sql_f1('m', 'g')})""",
)
def _(t):
    return A.f1_from_means(A.mean_scores(M.long_scores(answer_scores(t.sql(fx.ANSWERS)), "pair_id", METRICS)))


def sql_draws(keys: str, n: int = 120, iterations: int = 5) -> str:
    return f"""SELECT iteration, pair_id FROM (SELECT iteration, pair_id, row_number() OVER (PARTITION BY iteration
      ORDER BY md5('42|' || iteration || '|' || pair_id), pair_id) AS r FROM ({keys}) k, (SELECT unnest(range(0, {iterations})) AS iteration) i) WHERE r <= {n}"""


@query("a_repeat_sample", sql_draws("SELECT event_id AS pair_id FROM events"))
def _(t):
    return A.repeat_sample(t.events.select(F.col("event_id").alias("pair_id")), "pair_id").select(F.col("iteration").cast("bigint").alias("iteration"), "pair_id")


@query(
    "a_repeat_sample_replace",
    """WITH k AS (SELECT event_id AS pair_id, row_number() OVER (ORDER BY md5('42|' || event_id), event_id) - 1 AS ahead, count(*) OVER () AS n FROM events),
        d AS (SELECT i AS iteration, CAST('0x' || substr(md5('42|' || i || '|' || j), 1, 15) AS BIGINT) AS draw FROM range(5) a(i), range(120) b(j))
      SELECT iteration, pair_id FROM d JOIN k ON d.draw % k.n = k.ahead""",
)
def _(t):
    drawn = A.repeat_sample(t.events.select(F.col("event_id").alias("pair_id")), "pair_id", replace=True)
    return drawn.select(F.col("iteration").cast("bigint").alias("iteration"), "pair_id")


@query(
    "a_sample_stats",
    f"""WITH m AS (SELECT iteration, metric, CAST(round(CAST(avg(value) AS DECIMAL(18, 9)), 3) AS DOUBLE) AS value FROM ({fx.EVENT_SCORES}) s JOIN ({sql_draws('SELECT event_id AS pair_id FROM events')}) d
        ON d.pair_id = s.pair_id GROUP BY ALL)
      SELECT metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(quantile_cont(value, 0.025), 6) AS ci_lower, round(quantile_cont(value, 0.975), 6) AS ci_upper
      FROM m GROUP BY metric""",
)
def _(t):
    scores = t.sql(fx.EVENT_SCORES)
    drawn = A.repeat_sample(scores, "pair_id")
    stats = A.sample_statistics(A.mean_scores(scores.join(drawn, "pair_id"), ["iteration"]))
    return stats.select("metric", *[F.round(c, 6).alias(c) for c in ("mean", "std", "ci_lower", "ci_upper")])


@query(
    "a_group_prompt",
    f"""SELECT prompt_key, CAST(floor(idx / 1000) AS BIGINT) AS block, count(*) AS n, string_agg('Query ' || (idx + 1) || ':' || chr(10) || pred, chr(10) || chr(10) ORDER BY idx) AS listing
      FROM ({fx.PROMPT_ANSWERS}) GROUP BY ALL""",
)
def _(t):
    return A.group_by_prompt(t.sql(fx.PROMPT_ANSWERS))


_REWARDS = "SELECT l_orderkey AS prompt_key, l_partkey, l_suppkey, l_linenumber, l_discount + l_tax AS reward FROM lineitem"


@query(
    "a_group_advantage",
    f"""SELECT prompt_key, l_partkey, l_suppkey, l_linenumber, round((reward - avg(reward) OVER w) / (coalesce(stddev_samp(reward) OVER w, 0) + 1e-6), 4) AS advantage
      FROM ({_REWARDS}) WINDOW w AS (PARTITION BY prompt_key)""",
)
def _(t):
    return A.group_advantage(t.sql(_REWARDS)).select("prompt_key", "l_partkey", "l_suppkey", "l_linenumber", F.round("advantage", 4).alias("advantage"))


def answer_report(t: Tables) -> DataFrame:
    """Answers of every order scored, and the report over them."""
    answers = t.sql(fx.ANSWERS)
    wide = answer_scores(answers)
    bleu = M.bleu4(wide.select("pair_id", "gold", F.col("final").alias("pred")))
    scores = M.long_scores(wide, "pair_id", METRICS).unionByName(M.long_scores(bleu, "pair_id", ["bleu"]))
    return A.task_report(scores, t.orders.select(F.col("o_orderkey").alias("pair_id")), "answers")


_REPORT = f"""WITH wide AS ({SQL_ANSWER_SCORES}),
  s AS ({sql_long('SELECT * FROM wide', METRICS)} UNION ALL SELECT pair_id, 'bleu', CAST(bleu AS DOUBLE) FROM ({sql_bleu("SELECT pair_id, gold, final AS pred FROM (" + SQL_ANSWER_SCORES + ")")})),
  d AS ({sql_draws('SELECT o_orderkey AS pair_id FROM orders')} UNION ALL SELECT -1, o_orderkey FROM orders),
  m AS (SELECT iteration, metric, CAST(round(CAST(avg(value) AS DECIMAL(18, 9)), 3) AS DOUBLE) AS value FROM s JOIN d ON d.pair_id = s.pair_id GROUP BY ALL),
  a AS (SELECT * FROM m UNION ALL {sql_f1('m', 'iteration')})
  SELECT 'answers' AS task, metric, max(value) FILTER (iteration < 0) AS score, round(avg(value) FILTER (iteration >= 0), 6) AS mean,
    round(stddev_pop(value) FILTER (iteration >= 0), 6) AS std, round(quantile_cont(value, 0.025) FILTER (iteration >= 0), 6) AS ci_lower,
    round(quantile_cont(value, 0.975) FILTER (iteration >= 0), 6) AS ci_upper FROM a GROUP BY metric"""


@query("a_task_report", _REPORT)
def _(t):
    return answer_report(t).select("task", "metric", "score", *[F.round(c, 6).alias(c) for c in ("mean", "std", "ci_lower", "ci_upper")])


# --- streams ------------------------------------------------------------------------------------


def event_stream(t: Tables) -> DataFrame:
    """Events read as a stream of files; two event kinds stand for precision and recall."""
    raw = t.spark.readStream.schema(TABLES["events"]).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    return raw.select(
        F.col("event_id").alias("pair_id"),
        F.when(F.col("event_type") == "click", "precision_ans").when(F.col("event_type") == "view", "recall_ans").otherwise(F.col("event_type")).alias("metric"),
        "value", (F.col("event_id") % 5).alias("iteration"),
    )


_EVENT_MEANS = """SELECT 0 AS g, CASE event_type WHEN 'click' THEN 'precision_ans' WHEN 'view' THEN 'recall_ans' ELSE event_type END AS metric,
  CAST(round(CAST(avg(value) AS DECIMAL(18, 9)), 3) AS DOUBLE) AS value, count(value) AS n FROM events GROUP BY event_type"""


@query("z_running_scores", f"WITH m AS ({_EVENT_MEANS}) SELECT metric, value, n FROM m UNION ALL SELECT metric, value, NULL FROM ({sql_f1('m', 'g')})")
def _(t):
    out = scratch_path(t.spark, "running")
    running_scores(event_stream(t), out, scratch_path(t.spark, "state")).awaitTermination()
    return t.spark.read.schema("metric STRING, value DOUBLE, n BIGINT").parquet(out)


@query(
    "z_iteration_progress",
    """SELECT metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM (
      SELECT event_id % 5 AS i, CASE event_type WHEN 'click' THEN 'precision_ans' WHEN 'view' THEN 'recall_ans' ELSE event_type END AS metric, CAST(round(CAST(avg(value) AS DECIMAL(18, 9)), 3) AS DOUBLE) AS value
      FROM events GROUP BY ALL) GROUP BY metric""",
)
def _(t):
    out = scratch_path(t.spark, "progress")
    iteration_progress(event_stream(t), out, scratch_path(t.spark, "state")).awaitTermination()
    return t.spark.read.schema("metric STRING, mean DOUBLE, std DOUBLE").parquet(out).select("metric", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))
