"""Schema texts: one row per database, worked out once and joined where needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from querygauge.schemas import TABLES
from querygauge.sources.readers import read_table

_NAMES = {"bigint": "BIGINT", "int": "INTEGER", "string": "TEXT", "double": "REAL", "timestamp_ntz": "TIMESTAMP"}


def type_text(kind: T.DataType) -> str:
    """Type of a column as DDL; arrays, maps and structs are folded from the inside out."""
    if isinstance(kind, T.ArrayType):
        return f"{type_text(kind.elementType)}[]"
    if isinstance(kind, T.MapType):
        return f"MAP({type_text(kind.keyType)}, {type_text(kind.valueType)})"
    if isinstance(kind, T.StructType):
        return f"STRUCT({columns_text(kind)})"
    return _NAMES.get(kind.simpleString(), kind.simpleString().upper())


def columns_text(schema: T.StructType) -> str:
    return ", ".join(f"{f.name} {type_text(f.dataType)}" for f in schema.fields)


def table_ddl(name: str, schema: T.StructType | None = None) -> str:
    """DDL of a table with the given schema, or of one of the known tables."""
    return f'CREATE TABLE "{name.upper()}" ({columns_text(schema or TABLES[name])})'


def catalog_of(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, ddl) of any tables; read from their schemas, not from data."""
    return spark.createDataFrame([(name, table_ddl(name, df.schema)) for name, df in tables.items()], "table_name STRING, ddl STRING")


def catalog_text(spark: SparkSession, databases: dict[str, list[str]]) -> DataFrame:
    """(db_id, context): as many rows as databases; read from schemas, not from data."""
    rows = [(db, "\n".join(table_ddl(t) for t in tables) if tables else None) for db, tables in databases.items()]
    return spark.createDataFrame(rows, "db_id STRING, context STRING")


def _cell(f: T.StructField) -> Column:
    value = F.col(f"`{f.name}`")
    nested = isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
    return F.coalesce(F.to_json(value) if nested else F.hex(value) if isinstance(f.dataType, T.BinaryType) else value.cast("string"), F.lit("None"))


def samples_of(tables: dict[str, DataFrame], keys: dict[str, list[str]], n: int = 3) -> DataFrame:
    """(table_name, block) of any tables: DDL and the first n rows by key in a comment, nested values as JSON.

    The rows are taken by an ordered limit, so each task hands on at most n of them.
    """
    out = None
    for name, order in keys.items():
        top = tables[name].orderBy(*order).limit(n)
        row = F.struct(*order, F.concat_ws(" | ", *[_cell(f) for f in top.schema.fields]).alias("_line"))
        text = F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["_line"]), "\n")  # n rows
        block = top.agg(F.concat(F.lit(f"{table_ddl(name, top.schema)}\n/*\n"), text, F.lit("\n*/")).alias("block")).select(F.lit(name).alias("table_name"), "block")
        out = block if out is None else out.unionByName(block)
    return out


def catalog_samples(spark: SparkSession, folder: str, keys: dict[str, list[str]], n: int = 3) -> DataFrame:
    """(table_name, block) of known tables in a folder."""
    return samples_of({name: read_table(spark, folder, name) for name in keys}, keys, n)
