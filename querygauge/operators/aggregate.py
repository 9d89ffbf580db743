"""Verdicts, combined scores, means, F1 and repeated-sample statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from querygauge.fixed_values import GRADE_SCORES, SCORER_WEIGHTS
from querygauge.operators.ranking import keys_at


def grade_value(grade: Column) -> Column:
    """Score of a grade; null for a grade without one."""
    table = F.create_map(*[F.lit(x) for kv in GRADE_SCORES.items() for x in kv])
    return F.try_element_at(table, grade)


def grade_to_score(grade: Column) -> Column:
    return F.coalesce(grade_value(grade), F.lit(0.0))


def grade_group_score(answers: DataFrame, verdicts: DataFrame, prompt: str = "prompt_key", idx: str = "idx", grade: str = "grade") -> DataFrame:
    """(prompt, idx, score): one verdict list per prompt.

    A grade without a score, or more grades than answers, zeroes the whole prompt; an answer without a
    grade scores 0.  Prompts are judged by two counts (combined before the shuffle) that are joined
    back, so a prompt with very many answers is never gathered.
    """
    a = answers.select(prompt, idx)
    v = verdicts.select(prompt, idx, grade_value(F.col(grade)).alias("_score"))
    judged = v.groupBy(prompt).agg(F.count(F.lit(1)).alias("_given"), F.count_if(F.col("_score").isNull()).alias("_unmapped"))
    asked = a.groupBy(prompt).agg(F.count(F.lit(1)).alias("_asked"))
    bad = asked.join(judged, prompt).filter((F.col("_unmapped") > 0) | (F.col("_given") > F.col("_asked"))).select(prompt, F.lit(True).alias("_bad"))
    scored = a.join(v, [prompt, idx], "left").join(bad, prompt, "left")
    return scored.select(prompt, idx, F.when(F.col("_bad"), F.lit(0.0)).otherwise(F.coalesce("_score", F.lit(0.0))).alias("score"))


def binary_verdict(text: Column) -> Column:
    return F.when(F.lower(text) == "correct", 1).otherwise(0)


def combine_mean(scores: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """(key, combined): sum of the named metrics over their number; a missing one counts as 0."""
    kept = scores.filter(F.col("metric").isin(*metrics))
    return kept.groupBy(key).agg((F.sum("value") / len(metrics)).alias("combined"))


def combine_weighted(scores: DataFrame, key: str, weights: dict[str, float] | None = None) -> DataFrame:
    weights = weights or SCORER_WEIGHTS
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    weighted = scores.withColumn("_w", F.try_element_at(table, F.col("metric"))).filter(F.col("_w").isNotNull())
    return weighted.groupBy(key).agg(F.sum(F.col("_w") * F.col("value")).alias("combined"))


def answer_precision_recall(gold_answered: Column, pred_answered: Column, correct: Column) -> dict[str, Column]:
    """Four metrics that are null where not defined, so that means skip them."""
    return {
        "precision_ans": F.when(pred_answered, gold_answered.cast("int")),
        "precision_exec": F.when(pred_answered, correct.cast("int")),
        "recall_ans": F.when(gold_answered, pred_answered.cast("int")),
        "recall_exec": F.when(gold_answered, correct.cast("int")),
    }


def rounded_mean(value: str) -> Column:
    """Mean to 3 places.  Rounded to 9 first: sums of doubles differ in the last bits with the order of
    tasks, and that must not decide a tie."""
    return F.round(F.round(F.avg(value), 9), 3)


def mean_scores(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """([by…], metric, value): mean over the rows that have the metric, rounded to 3 places."""
    return scores.groupBy(*(by or []), "metric").agg(rounded_mean("value").alias("value"))


def _f1(s: str) -> Column:
    p, r = F.col(f"_precision_{s}"), F.col(f"_recall_{s}")
    value = F.round(2 * p * r / (p + r + F.lit(1e-10)), 3)
    return F.struct(F.lit(f"f1_{s}").alias("metric"), value.alias("value"))


def f1_from_means(means: DataFrame, by: list[str] | None = None, keep_means: bool = False) -> DataFrame:
    """F1 rows from rounded precision and recall means, where both exist; on wish with the means.

    The means are read once: a group gathers one entry per metric name, never per row.
    """
    by = by or []
    pick = lambda m: F.max(F.when(F.col("metric") == m, F.col("value")))
    picks = [pick(f"{k}_{s}").alias(f"_{k}_{s}") for k in ("precision", "recall") for s in ("ans", "exec")]
    entries = F.array(_f1("ans"), _f1("exec"))
    if keep_means:
        wide = means.groupBy(*by).agg(*picks, F.collect_list(F.struct("metric", "value")).alias("_all"))
        entries = F.concat(F.col("_all"), entries)
    else:
        wide = means.groupBy(*by).agg(*picks)
    return wide.select(*by, F.explode(entries).alias("x")).select(*by, "x.metric", "x.value").filter(F.col("value").isNotNull())


def score_table(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means and the F1 rows that follow from them."""
    return f1_from_means(mean_scores(scores, by), by, keep_means=True)


def repeat_sample(df: DataFrame, key: str, n: int = 120, iterations: int = 5, seed: int = 42, replace: bool = False) -> DataFrame:
    """(iteration, key): n keys per iteration; all keys if there are fewer.

    Without replacement each iteration takes the first n keys in its own hash order; the constant limit
    keeps at most n keys per task and iteration before the shuffle.  With replacement draw j of an iteration takes
    the row ahead of which stand md5(seed|iteration|j), its first 15 hex digits modulo the row count, rows of the hash order.
    """
    keys = df.select(key)
    if replace:
        name = F.concat_ws("|", F.lit(str(seed)), F.col("iteration").cast("string"), F.expr(f"CAST(id DIV {iterations} AS STRING)"))
        numbers = keys.sparkSession.range(n * iterations).withColumn("iteration", (F.col("id") % iterations).cast("int"))
        numbers = numbers.select("iteration", F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("bigint").alias("draw"))
        return keys_at(keys, key, numbers, seed).select("iteration", key)
    spread = keys.select(key, F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("iteration"))
    hashed = spread.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}|"), F.col("iteration").cast("string"), F.lit("|"), F.col(key).cast("string"))))
    rank = F.row_number().over(Window.partitionBy("iteration").orderBy("_h", key))
    return hashed.withColumn("_r", rank).filter(F.col("_r") <= n).select("iteration", key)


def with_iterations(scores: DataFrame, keys: DataFrame, key: str, n: int = 120, iterations: int = 5, seed: int = 42) -> DataFrame:
    """(iteration, key, metric, value): every row once as iteration -1, and once per iteration that drew it.

    Draws are made on the bare keys, so scoring runs once; the drawn keys are at most n x iterations rows.
    """
    drawn = repeat_sample(keys, key, n, iterations, seed).groupBy(key).agg(F.collect_list("iteration").alias("_its"))
    spread = F.concat(F.array(F.lit(-1)), F.coalesce("_its", F.array().cast("array<int>")))
    # at most n x iterations keys: without the hint a planner that goes by the size of the table moves all scores
    return scores.join(F.broadcast(drawn), key, "left").select(F.explode(spread).alias("iteration"), key, "metric", "value")


def sample_statistics(iteration_means: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean, population deviation and 2.5 / 97.5 percentile over iterations, for every metric seen."""
    return iteration_means.groupBy(*(by or []), "metric").agg(
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.percentile("value", F.lit(0.025)).alias("ci_lower"),
        F.percentile("value", F.lit(0.975)).alias("ci_upper"),
    )


def group_by_prompt(completions: DataFrame, prompt: str = "prompt_key", idx: str = "idx", pred: str = "pred", block: int = 1_000) -> DataFrame:
    """(prompt, block, n, listing): numbered completions of a prompt in blocks of ``block``.

    A usual prompt is one block.  A prompt with very many completions becomes many blocks, each of
    bounded size, and no completion is left out.
    """
    entry = F.struct(F.col(idx).alias("i"), F.col(pred).alias("t"))
    grouped = completions.groupBy(prompt, F.floor(F.col(idx) / block).alias("block")).agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(entry)).alias("_e")
    )
    line = lambda e: F.concat(F.lit("Query "), (e["i"] + 1).cast("string"), F.lit(":\n"), F.coalesce(e["t"], F.lit("")))
    return grouped.select(prompt, "block", "n", F.array_join(F.transform("_e", line), "\n\n").alias("listing"))


def group_advantage(rewards: DataFrame, prompt: str = "prompt_key", reward: str = "reward", eps: float = 1e-6) -> DataFrame:
    """Append ``advantage``: reward relative to the mean and deviation of its prompt.

    Statistics are aggregated first and joined back: a hot prompt is one statistics row, and the skewed
    side of the join can be split, which a window over the prompt could not.
    """
    stats = rewards.groupBy(prompt).agg(F.avg(reward).alias("_mean"), F.coalesce(F.stddev_samp(reward), F.lit(0.0)).alias("_std"))
    value = (F.col(reward) - F.col("_mean")) / (F.col("_std") + F.lit(eps))
    return rewards.join(stats, prompt).withColumn("advantage", value).drop("_mean", "_std")


def task_report(scores: DataFrame, keys: DataFrame, task: str, key: str = "pair_id", n: int = 120, iterations: int = 5, seed: int = 42) -> DataFrame:
    """One row per metric: full-table mean (and F1) beside the repeated-sample statistics.

    One line of steps from scores to report, so nothing is scored twice.
    """
    per_iteration = score_table(with_iterations(scores, keys, key, n, iterations, seed), ["iteration"])
    drawn = F.when(F.col("iteration") >= 0, F.col("value"))
    return per_iteration.groupBy("metric").agg(
        F.lit(task).alias("task"),
        F.max(F.when(F.col("iteration") < 0, F.col("value"))).alias("score"),
        F.avg(drawn).alias("mean"), F.stddev_pop(drawn).alias("std"),
        F.percentile(drawn, F.lit(0.025)).alias("ci_lower"), F.percentile(drawn, F.lit(0.975)).alias("ci_upper"),
    ).select("task", "metric", "score", "mean", "std", "ci_lower", "ci_upper")
