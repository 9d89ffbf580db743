"""Sinks: training sets, run results and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_messages(train: DataFrame, test: DataFrame, folder: str) -> None:
    """Two parquet sets of chat messages."""
    for name, df in (("train", train), ("test", test)):
        df.select("messages").write.mode("overwrite").parquet(f"{folder}/{name}_messages.parquet")


def _args(run_args: dict[str, object]):
    return F.create_map(*[F.lit(str(x)) for kv in run_args.items() for x in kv])


def append_result(means: DataFrame, run_args: dict[str, object], model: str, path: str) -> None:
    """One JSON line per run: model, scores, arguments.  ``means`` has one row per metric."""
    scores = F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value"))))
    means.agg(scores.alias("scores")).select(F.lit(model).alias("model"), "scores", _args(run_args).alias("args")).write.mode("append").json(path)


def append_stats(stats: DataFrame, run_args: dict[str, object], model: str, path: str) -> None:
    """One row per metric: mean, deviation and interval, with the arguments of the run."""
    kept = stats.select(F.lit(model).alias("model"), "metric", "mean", "std", "ci_lower", "ci_upper", _args(run_args).alias("args"))
    kept.write.mode("append").parquet(path)
