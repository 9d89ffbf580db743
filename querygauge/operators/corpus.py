"""Corpus preparation: renames, joins with catalogs, repeatable order, splits, balancing, sampling."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce
from math import floor

from pyspark.sql import DataFrame, functions as F

from querygauge.operators.ranking import bucket_rank, find_cuts, seeded_hash, smallest_class_cuts, take_hashed, upto


def to_canonical(df: DataFrame, mapping: dict[str, str], drop: list[str] | None = None) -> DataFrame:
    return df.drop(*(drop or [])).withColumnsRenamed(mapping)


def keep_valid(df: DataFrame, catalog: DataFrame, key: str = "db_id") -> DataFrame:
    """Rows whose database has a readable schema, with that schema.

    No broadcast hint: the planner broadcasts by measured size and falls back to a shuffle join.
    """
    return df.join(catalog.filter(F.col("context").isNotNull()), key, "inner")


def attach_context(df: DataFrame, catalog: DataFrame, key: str = "db_id") -> DataFrame:
    return df.join(catalog, key, "left")


def tag(df: DataFrame, query_type: str) -> DataFrame:
    return df.withColumn("query_type", F.lit(query_type))


def seeded_order(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Rows in repeatable hash order (a range-partitioned sort)."""
    return df.orderBy(seeded_hash(F.col(key), seed), F.col(key))


def seeded_rank(df: DataFrame, key: str, seed: int = 42, by: list[str] | None = None) -> DataFrame:
    return bucket_rank(df, key, seed, by)


def split(df: DataFrame, parts: list[tuple[str, float, float]], key: str, seed: int = 42) -> DataFrame:
    """Append ``split``: named position ranges of the hash-ordered table; rows in no range are dropped.

    Bounds are ``floor(f * n)``, worked out in decimals.
    """
    edges = sorted({float(b) for _, lo, hi in parts for b in (lo, hi)} - {0.0, 1.0})
    at = {str(f): (lambda n, f=f: floor(Decimal(str(f)) * n)) for f in edges}
    cuts = find_cuts(df, key, at, seed) if edges else {}
    before = {0.0: F.lit(False), 1.0: F.lit(True), **{f: upto(key, cuts[str(f)], seed) for f in edges}}
    label = F.lit(None).cast("string")
    for name, lo, hi in reversed(parts):
        label = F.when(before[float(hi)] & ~before[float(lo)], F.lit(name)).otherwise(label)
    return df.withColumn("split", label).filter(F.col("split").isNotNull())


def decontaminate(df: DataFrame, other: DataFrame, key: str = "question") -> DataFrame:
    """Drop rows whose key occurs in another corpus; a missing key matches a missing key."""
    seen = other.select(F.col(key).alias("_seen")).distinct()
    return df.join(seen, F.col(key).eqNullSafe(F.col("_seen")), "left_anti")


def balance(df: DataFrame, cls: str, key: str, seed: int = 42, within: list[str] | None = None) -> DataFrame:
    """Cut every class to the size of the smallest, by hash order; with ``within``, in each of its groups.

    Only counts per class and bucket and one cut per class move; a hot class is filtered in place.
    """
    by = [*(within or []), cls]
    ends = smallest_class_cuts(df, cls, key, within or [], seed)
    joined = df.join(ends, [F.col(c).eqNullSafe(F.col(f"_c{i}")) for i, c in enumerate(by)])
    h, k = seeded_hash(F.col(key), seed), F.col(key)
    inside = (h < F.col("_ch")) | ((h == F.col("_ch")) & (k <= F.col("_ck")))
    return joined.filter(inside).drop("_ch", "_ck", *[f"_c{i}" for i, _ in enumerate(by)])


def concat(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def sample_n(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    return take_hashed(df, key, n, seed)


def head(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """First n rows in hash order; fewer rows is not an error."""
    return take_hashed(df, key, n, seed)


def answerable_union(questions: DataFrame, unanswerable: DataFrame) -> DataFrame:
    """Add questions without an answer under a fixed title and label."""
    extra = unanswerable.withColumn("title", F.lit("the table")).withColumn("answer", F.lit("Unanswerable"))
    return questions.unionByName(extra.select(*questions.columns))


def drop_overlong(df: DataFrame, prompt: str, max_words: int = 1024) -> DataFrame:
    """Drop prompts over a word limit (the tokenizer is not part of this engine)."""
    text = F.btrim(F.col(prompt), F.lit(" \t\n\r"))
    return df.filter(F.size(F.split(text, r"\s+")) <= max_words)


def rows_to_json(rows: DataFrame, table_key: str = "table_id", order: str = "row_no", block: int = 10_000) -> DataFrame:
    """Each small source table as JSON text, in row order, cut into blocks of ``block`` rows.

    A prompt-sized table is one block holding a JSON array.  A larger table keeps all its rows as
    further blocks instead of growing one group without bound.
    """
    fields = [c for c in rows.columns if c not in (table_key, order)]
    record = F.struct(F.col(order).alias("_o"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("_j"))
    grouped = rows.groupBy(table_key, F.floor(F.col(order) / block).alias("block")).agg(F.array_sort(F.collect_list(record)).alias("_rows"))
    text = F.concat(F.lit("["), F.array_join(F.transform("_rows", lambda r: r["_j"]), ","), F.lit("]"))
    return grouped.select(table_key, "block", text.alias("table_json"))


def table_info_for(examples: DataFrame, blocks: DataFrame, key: str, sql: str) -> DataFrame:
    """(key, table_info): labelled schema block of each table a query names, in name order.

    A query without tables keeps a single blank.  Gathered per query: as many rows as it names tables.
    """
    from querygauge.functions.extract import table_names

    named = examples.select(key, F.explode_outer(table_names(F.col(sql))).alias("table_name"))
    joined = named.join(blocks.select("table_name", "block"), "table_name", "left")
    line = F.concat(F.lit("Information for Table "), F.col("table_name"), F.lit(": "), F.coalesce("block", F.lit("")), F.lit("\n"))
    grouped = joined.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("table_name").isNotNull(), line))).alias("_l"))
    return grouped.select(key, F.concat(F.lit(" "), F.array_join("_l", "")).alias("table_info"))
