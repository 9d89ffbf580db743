"""Registries: check queries, tasks and scorers by name."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from querygauge.operators.placement import spread
from querygauge.schemas import TABLES
from querygauge.sources.readers import read_table


class Tables:
    """The tables of one folder, as attributes; ``sql`` runs text over them as views."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return read_table(self.spark, self.folder, name)
        raise AttributeError(name)

    def register(self, text: str) -> None:
        for name in TABLES:
            if re.search(rf"\b{name}\b", text):
                getattr(self, name).createOrReplaceTempView(name)

    def sql(self, text: str) -> DataFrame:
        self.register(text)
        return self.spark.sql(text)


@dataclass(frozen=True)
class Query:
    build: Callable[[Tables], DataFrame]
    oracle: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, oracle: str | None = None):
    """Register a check query and the SQL that must give the same rows."""

    def wrap(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(build, oracle)
        return build

    return wrap


# --- scorers ------------------------------------------------------------------------------------

# A scorer takes pairs (pair_id, query_type, gold, pred) and returns (pair_id, metric, value).
Scorer = Callable[[DataFrame], DataFrame]
SCORERS: dict[str, Scorer] = {}


def scorer(name: str):
    def wrap(fn: Scorer) -> Scorer:
        SCORERS[name] = fn
        return fn

    return wrap


def run_scorers(pairs: DataFrame, names: list[str]) -> DataFrame:
    """Long scores of several scorers."""
    out = None
    for name in names:
        scores = SCORERS[name](pairs)
        out = scores if out is None else out.unionByName(scores)
    return out


def _named(scored: DataFrame, column: str, metric: str) -> DataFrame:
    return scored.select("pair_id", F.lit(metric).alias("metric"), F.col(column).cast("double").alias("value"))


@scorer("exact_match")
def _exact(pairs: DataFrame) -> DataFrame:
    from querygauge.operators.textscore import exact_match

    return _named(pairs.select("pair_id", exact_match(F.col("gold"), F.col("pred")).alias("v")), "v", "exact_match")


@scorer("contains")
def _contains(pairs: DataFrame) -> DataFrame:
    from querygauge.operators.textscore import contains_match

    return _named(pairs.select("pair_id", contains_match(F.col("gold"), F.col("pred")).alias("v")), "v", "contains")


@scorer("rouge_l")
def _rouge(pairs: DataFrame) -> DataFrame:
    from querygauge.operators.textscore import rouge_l

    return _named(spread(pairs, "pair_id").select("pair_id", rouge_l(F.col("gold"), F.col("pred")).alias("v")), "v", "rouge_l")


@scorer("bleu4")
def _bleu(pairs: DataFrame) -> DataFrame:
    from querygauge.operators.textscore import bleu4

    return _named(bleu4(pairs), "bleu", "bleu4")


@scorer("sequence")
def _sequence(pairs: DataFrame) -> DataFrame:
    from querygauge.operators.textscore import sequence_ratio

    return _named(spread(pairs, "pair_id").select("pair_id", sequence_ratio(F.col("gold"), F.col("pred")).alias("v")), "v", "sequence")


@scorer("component")
def _component(pairs: DataFrame) -> DataFrame:
    from querygauge.operators.clauses import component_score

    return _named(component_score(pairs), "component", "component")


@scorer("component_or_graph")
def _component_or_graph(pairs: DataFrame) -> DataFrame:
    from querygauge.operators.graphs import component_or_graph

    return _named(component_or_graph(pairs), "component_or_graph", "component_or_graph")
