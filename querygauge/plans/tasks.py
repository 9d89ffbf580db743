"""Task jobs: end-to-end plans over example, response and verdict tables.

A task takes tables and gives a score table or a training set.  ``TASKS`` maps names to tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from querygauge.fixed_values import CYPHER_TEMPLATE, LANGUAGE_EXAMPLES_TEMPLATE, LANGUAGE_TEMPLATE, SQL_TEMPLATE, THINKING_SYSTEM
from querygauge.functions import extract as X, prompts as B
from querygauge.operators import aggregate as A, corpus as P, results as E, textscore as M
from querygauge.operators.graphs import component_or_graph
from querygauge.operators.placement import spread

TASKS: dict[str, Callable[..., DataFrame]] = {}


def task(name: str):
    def wrap(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        TASKS[name] = fn
        return fn

    return wrap


def _texts(pairs: DataFrame) -> list[tuple[int, str, str]]:
    """Query texts to run: as many as the benchmark has questions, not as many as the data has rows."""
    return [(r["pair_id"], r["gold"], r["pred"]) for r in pairs.select("pair_id", "gold", "pred").toLocalIterator()]


@task("sql_match")
def sql_match(spark: SparkSession, examples: DataFrame, allow_empty: bool = False, with_text: bool = True) -> DataFrame:
    """(pair_id, gold, response) to means of execution accuracy and, on wish, exact match.

    Pairs whose gold query fails are dropped, and those with an empty gold result unless allowed.
    """
    pairs = examples.withColumn("pred", X.last_fence(F.col("response"), "sql", "sql"))
    report = E.drop_bad_gold(E.compare_all(spark, _texts(pairs)), allow_empty)
    scored = pairs.join(report, "pair_id").withColumn("exact_match", M.exact_match(F.col("gold"), F.col("pred")))
    metrics = ["execution_accuracy", *(["exact_match"] if with_text else [])]
    return A.mean_scores(M.long_scores(scored.withColumnRenamed("set_equal", "execution_accuracy"), "pair_id", metrics))


@task("sql_answerable")
def sql_answerable(spark: SparkSession, examples: DataFrame, bare_null: bool = False) -> DataFrame:
    """Clinical questions that may have no answer: accuracy on the first rows, precision, recall and F1."""
    extracted = X.last_fence(F.col("response"), "sql", "sql")
    if bare_null:
        extracted = F.when(F.lower(X.strip(F.col("response"))).startswith("null"), "null").otherwise(extracted)
    pairs = examples.select("pair_id", X.canonical_sql(F.col("gold")).alias("gold"), X.canonical_sql(extracted).alias("pred"))
    report = E.compare_all(spark, _texts(pairs))
    gold, pred = F.col("gold_status") != "null", F.col("pred_status") != "null"
    parts = A.answer_precision_recall(gold, pred, F.col("char_equal"))
    wide = report.select("pair_id", F.col("top_equal").alias("accuracy"), F.col("char_equal").alias("acc2"), *[c.alias(n) for n, c in parts.items()])
    return A.score_table(M.long_scores(wide, "pair_id", ["accuracy", "acc2", *parts]))


@task("cypher_text")
def cypher_text(examples: DataFrame, seen: DataFrame) -> DataFrame:
    """Last twentieth of the questions not in ``seen``: BLEU, exact match and verdict means.

    ``examples``: (pair_id, question, gold, response, verdict).
    """
    fresh = P.decontaminate(examples, seen, "question")
    test = P.split(fresh, [("test", 0.95, 1)], "pair_id")
    pairs = test.select(
        "pair_id", F.lower("gold").alias("gold"), F.lower(X.last_fence(F.col("response"), "cypher", "upper")).alias("pred"),
        A.binary_verdict(F.col("verdict")).alias("verdict"),
    )
    scored = pairs.join(M.bleu4(pairs), "pair_id").withColumn("exact_match", M.exact_match(F.col("gold"), F.col("pred")))
    return A.mean_scores(M.long_scores(scored, "pair_id", ["bleu", "exact_match", "verdict"]))


@task("table_qa")
def table_qa(answerable: DataFrame, unanswerable: DataFrame) -> DataFrame:
    """Answers after the reasoning: exact match, containment, precision, recall, F1.

    Both tables: (pair_id, question, response), the first also (answer, title).
    """
    rows = P.answerable_union(answerable, unanswerable)
    final, gold = X.after_marker(F.col("response"), "</think>"), F.col("answer")
    exact = M.exact_match(gold, final)
    parts = A.answer_precision_recall(gold != "Unanswerable", F.lower(X.strip(final)) != "unanswerable", exact)
    wide = rows.select("pair_id", exact.alias("exact_match"), M.contains_match(gold, final).alias("contains"), *[c.alias(n) for n, c in parts.items()])
    return A.score_table(M.long_scores(wide, "pair_id", ["exact_match", "contains", *parts]))


@task("fact_check")
def fact_check(examples: DataFrame, kind: str = "FactChecking") -> DataFrame:
    """(pair_id, qtype, gold, response): exact match and ROUGE-L against the first number of the gold answer."""
    final = X.after_marker(F.col("response"), "Final Answer:", required=True)
    pairs = examples.filter(F.col("qtype") == kind).select("pair_id", X.first_number(F.col("gold")).alias("gold"), final.alias("pred"))
    scored = pairs.select("pair_id", M.exact_match(F.col("gold"), F.col("pred")).alias("exact_match"), M.rouge_l(F.col("gold"), F.col("pred")).alias("rouge"))
    return A.mean_scores(M.long_scores(scored, "pair_id", ["exact_match", "rouge"]))


@task("triple_qa")
def triple_qa(examples: DataFrame) -> DataFrame:
    """(pair_id, gold, response): yes / no answers after the last marker."""
    final = X.yes_no(F.lower(X.after_marker(F.col("response"), "Final Answer:")))
    scored = examples.select("pair_id", M.exact_match(F.lower("gold"), final).alias("exact_match"))
    return A.mean_scores(M.long_scores(scored, "pair_id", ["exact_match"]))


@task("multi_language")
def multi_language(examples: DataFrame) -> DataFrame:
    """(pair_id, language, response, verdict): verdict means per language, and the share with a query found."""
    found = X.last_fence_by_language(F.col("response"), F.col("language"))
    wide = examples.select("pair_id", "language", A.binary_verdict(F.col("verdict")).alias("verdict"), (found != " ").cast("int").alias("found"))
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in ("verdict", "found")])
    return A.mean_scores(wide.select("language", F.explode(entries).alias("s")).select("language", "s.*"), ["language"])


def language_prompts(examples: DataFrame, shots: DataFrame | None = None) -> DataFrame:
    """Zero- or few-shot prompts in each row's language; ``shots`` = (language, examples, note)."""
    fields = {c: F.col(c) for c in ("language", "note", "context", "question")}
    if shots is None:
        return examples.withColumn("prompt", B.render(LANGUAGE_TEMPLATE, **fields))
    joined = examples.drop("note").join(shots, "language")
    return joined.withColumn("prompt", B.render(LANGUAGE_EXAMPLES_TEMPLATE, examples=F.col("examples"), **fields))


# --- training sets ------------------------------------------------------------------------------
# A corpus is (example_id, question, context, answer, thinking); ids are unique over all corpora.


def _prompt(query_type: str):
    template = SQL_TEMPLATE if query_type == "sql" else CYPHER_TEMPLATE
    return B.render(template, context=F.col("context"), question=F.col("question"))


def _tagged(corpora: dict[str, DataFrame]) -> list[DataFrame]:
    return [P.tag(df, kind) for kind, df in corpora.items()]


@task("training_mix")
def training_mix(corpora: dict[str, DataFrame], end_mark: str = "", seed: int = 42) -> DataFrame:
    """(example_id, query_type, split, messages): 99 / 1 split per corpus, cut to equal sizes, mixed.

    Write the two parts with ``sinks.write_messages``.
    """
    parts = [("train", 0, 0.99), ("test", 0.99, 1)]
    mixed = P.concat([P.split(df, parts, "example_id", seed) for df in _tagged(corpora)])
    even = P.balance(mixed, "query_type", "example_id", seed, within=["split"])
    prompt = F.when(F.col("query_type") == "sql", _prompt("sql")).otherwise(_prompt("cypher"))
    done = B.completion(F.col("thinking"), F.col("answer"), F.col("query_type"), end_mark)
    return even.select("example_id", "query_type", "split", B.messages(F.lit(THINKING_SYSTEM), prompt, done).alias("messages"))


@task("rl_mix")
def rl_mix(sql: DataFrame, cypher: DataFrame, seen: DataFrame, validation_cap: int | None = None, seed: int = 42) -> DataFrame:
    """(example_id, query_type, split, question, answer, context, prompt): train and validation sets.

    A cap, where asked for, takes that many validation rows of each kind in hash order.
    """
    ranges = {"sql": [("train", 0, 0.95), ("validation", 0.95, 1)], "cypher": [("train", 0, 0.90), ("validation", 0.90, 0.95)]}
    tagged = {"sql": P.tag(sql, "sql"), "cypher": P.tag(P.decontaminate(cypher, seen, "question"), "cypher")}
    train, validation = [], []
    for kind, df in tagged.items():
        parts = P.split(df, ranges[kind], "example_id", seed)
        train.append(parts.filter(F.col("split") == "train"))
        held = parts.filter(F.col("split") == "validation")
        validation.append(held if validation_cap is None else P.head(held, validation_cap, "example_id", seed))
    even = P.balance(P.concat([*train, *validation]), "query_type", "example_id", seed, within=["split"])
    prompt = F.when(F.col("query_type") == "sql", _prompt("sql")).otherwise(_prompt("cypher"))
    return even.select("example_id", "query_type", "split", "question", "answer", "context", B.messages(F.lit(THINKING_SYSTEM), prompt).alias("prompt"))


@task("sft_mix")
def sft_mix(corpora: dict[str, DataFrame], end_mark: str = "", with_thinking: bool = True, seed: int = 42) -> DataFrame:
    """(example_id, query_type, split, text): corpora sampled to the smallest, mixed, split 99 / 1."""
    even = P.balance(P.concat(_tagged(corpora)), "query_type", "example_id", seed)
    mixed = P.split(even, [("train", 0, 0.99), ("validation", 0.99, 1)], "example_id", seed)
    prompt = F.when(F.col("query_type") == "sql", _prompt("sql")).otherwise(_prompt("cypher"))
    done = B.completion(F.col("thinking") if with_thinking else None, F.col("answer"), F.col("query_type"), end_mark)
    return mixed.select("example_id", "query_type", "split", F.concat(prompt, F.lit("\n"), done).alias("text"))


@task("reward_table")
def reward_table(completions: DataFrame) -> DataFrame:
    """(pair_id, metric, value) rewards with their mean and weighted sum.

    ``completions``: (pair_id, query_type, gold, response, grade).
    """
    kind = F.col("query_type")
    pairs = spread(completions.select("pair_id", "query_type", "grade", "gold", "response"), "pair_id").select(
        "pair_id", "query_type", "grade", X.normalise_query(F.col("gold"), kind).alias("gold"), X.training_query(F.col("response"), kind).alias("pred")
    )
    sides = pairs.select("pair_id", M.sequence_ratio(F.col("gold"), F.col("pred")).alias("sequence"), A.grade_to_score(F.col("grade")).alias("verdict"))
    scores = M.long_scores(component_or_graph(pairs), "pair_id", ["component_or_graph"]).unionByName(M.long_scores(sides, "pair_id", ["sequence", "verdict"]))
    names = ["component_or_graph", "verdict", "sequence"]
    wide = scores.groupBy("pair_id").agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in names])
    weights = A.SCORER_WEIGHTS
    mean = sum((F.coalesce(m, F.lit(0.0)) for m in names), F.lit(0.0)) / len(names)
    weighted = sum((F.coalesce(m, F.lit(0.0)) * weights[m] for m in names), F.lit(0.0))
    return wide.select("pair_id", *names, mean.alias("mean"), weighted.alias("weighted"))
