"""Clause tables, component scores and keyword counts over pair tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from querygauge.functions import clauses as X
from querygauge.operators.placement import spread


def sql_clauses(df: DataFrame, key: str, sql: str) -> DataFrame:
    """(key, keyword, ordinal, content): every clause hit of a query, in the order hits count."""
    # outer explode: a plain one infers a filter that would repeat the whole scan of the text
    rows = spread(df.select(key, sql), key).select(key, F.posexplode_outer(X.sql_components(F.col(sql))).alias("ordinal", "c")).filter(F.col("c").isNotNull())
    return rows.select(key, "c.keyword", "ordinal", "c.content")


def cypher_clauses(df: DataFrame, key: str, query: str) -> DataFrame:
    rows = spread(df.select(key, query), key).select(key, F.explode_outer(X.cypher_components(F.col(query))).alias("c")).filter(F.col("c").isNotNull())
    return rows.select(key, "c.keyword", "c.content")


def component_score(pairs: DataFrame, key: str = "pair_id", gold: str = "gold", pred: str = "pred", query_type: str = "query_type") -> DataFrame:
    """(key, component): scored by each row's own query type."""
    sql = sql_f1(pairs.filter(F.col(query_type) == "sql"), key, gold, pred)
    cypher = cypher_f1(pairs.filter(F.col(query_type) != "sql"), key, gold, pred)
    return sql.unionByName(cypher)


def sql_f1(pairs: DataFrame, key: str = "pair_id", gold: str = "gold", pred: str = "pred") -> DataFrame:
    """(key, component): mean F1 of the first clauses of two SQL texts."""
    return spread(pairs.select(key, gold, pred), key).select(key, X.sql_f1(F.col(gold), F.col(pred)).alias("component"))


def cypher_f1(pairs: DataFrame, key: str = "pair_id", gold: str = "gold", pred: str = "pred") -> DataFrame:
    """(key, component): mean F1 of the clause sets of two Cypher texts."""
    return spread(pairs.select(key, gold, pred), key).select(key, X.cypher_f1(F.col(gold), F.col(pred)).alias("component"))


def keyword_profile(clauses: DataFrame) -> DataFrame:
    return clauses.groupBy("keyword").count()
