"""Placing rows for work that costs far more than moving its input."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *key: str) -> DataFrame:
    """Rows placed by a unique key (or one of which few rows share a value) over all shuffle partitions.

    The number is given so that the small input of a large computation is not coalesced into few tasks;
    on large input it evens out tasks whose texts differ in length.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)
