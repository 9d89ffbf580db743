"""Graph and document query shapes as DataFrame operators.

A property graph is two tables: nodes (id, label, props) and edges (src, dst, type), ``props`` being a
string map.  A document collection is a table with nested arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _has(props: str, wanted: dict[str, str]) -> Column:
    test = F.lit(True)
    for name, value in wanted.items():
        test = test & (F.try_element_at(F.col(props), F.lit(name)) == value)
    return test


def node_lookup(nodes: DataFrame, label: str, wanted: dict[str, str] | None = None) -> DataFrame:
    """Nodes of a label with the given properties."""
    return nodes.filter((F.col("label") == label) & _has("props", wanted or {}))


def one_hop(
    nodes: DataFrame, edges: DataFrame, src_label: str, edge_type: str, dst_label: str,
    src_props: dict[str, str] | None = None, dst_props: dict[str, str] | None = None,
) -> DataFrame:
    """(src, src_props, dst, dst_props) of ``(a:src)-[:type]->(b:dst)``; filters apply before the joins."""
    a = node_lookup(nodes, src_label, src_props).select(F.col("id").alias("src"), F.col("props").alias("src_props"))
    b = node_lookup(nodes, dst_label, dst_props).select(F.col("id").alias("dst"), F.col("props").alias("dst_props"))
    hops = edges.filter(F.col("type") == edge_type).select("src", "dst")
    return hops.join(b, "dst").join(a, "src").select("src", "src_props", "dst", "dst_props")


def page(df: DataFrame, order: list[Column], skip: int, limit: int) -> DataFrame:
    """ORDER BY … SKIP … LIMIT."""
    return df.orderBy(*order).offset(skip).limit(limit)


def doc_match(docs: DataFrame, array: str, test) -> DataFrame:
    """Documents with an array element that passes the test."""
    return docs.filter(F.exists(F.col(array), test))


def doc_unwind(docs: DataFrame, path: str, alias: str) -> DataFrame:
    """One row per element of a nested array; the element under ``alias``."""
    return docs.withColumn(alias, F.explode(F.col(path)))


def doc_lookup(docs: DataFrame, other: DataFrame, local: str, foreign: str, alias: str, block_rows: int = 10_000) -> DataFrame:
    """Left join that nests the matching rows as an array, with a ``block`` number.

    Most documents get one block.  A document matched by very many rows gets further blocks of about
    ``block_rows`` instead of one array without bound; together they hold every match.
    """
    fields = [c for c in other.columns if c != foreign]
    blocks = other.groupBy(foreign).agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("_blocks"))
    placed = other.join(blocks, foreign).withColumn("block", F.pmod(F.xxhash64(*fields), F.col("_blocks")))
    gathered = placed.groupBy(foreign, "block").agg(F.collect_list(F.struct(*fields)).alias(alias)).withColumnRenamed(foreign, "_k")
    joined = docs.join(gathered, F.col(local) == F.col("_k"), "left").drop("_k")
    empty = F.array().cast(gathered.schema[alias].dataType)
    return joined.withColumn("block", F.coalesce("block", F.lit(0))).withColumn(alias, F.coalesce(F.col(alias), empty))
