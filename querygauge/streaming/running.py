"""Running score tables: the means so far, kept by Structured Streaming state."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from querygauge.operators.aggregate import f1_from_means, rounded_mean, sample_statistics


def _start(aggregated: DataFrame, write, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = aggregated.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def running_scores(stream: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keep ``out`` at (metric, value, n): rounded means and F1 over every score seen so far.

    State is one running mean per metric, whatever the length of the stream; partial means are formed
    before the shuffle, so a metric that holds most rows is no hot spot.
    """
    means = stream.groupBy("metric").agg(rounded_mean("value").alias("value"), F.count("value").alias("n"))

    def write(batch: DataFrame, _: int) -> None:
        f1 = f1_from_means(batch).withColumn("n", F.lit(None).cast("bigint"))
        batch.unionByName(f1).write.mode("overwrite").parquet(out)

    return _start(means, write, checkpoint, available_now)


def iteration_progress(stream: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keep ``out`` at mean and deviation over the iterations seen so far, per metric.

    State is one mean per (iteration, metric); the statistics are made from those few rows per batch.
    """
    means = stream.groupBy("iteration", "metric").agg(rounded_mean("value").alias("value"))

    def write(batch: DataFrame, _: int) -> None:
        sample_statistics(batch).select("metric", "mean", "std").write.mode("overwrite").parquet(out)

    return _start(means, write, checkpoint, available_now)
