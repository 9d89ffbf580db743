"""Readers for the corpus formats.  Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from querygauge.schemas import KEYED_QUESTIONS, TABLES


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet")


def read_records(spark: SparkSession, path: str, schema: T.StructType | str, lines: bool = False) -> DataFrame:
    """JSON records: files holding one array of objects each, or (``lines``) one object per line.

    An array file cannot be split, so a large corpus should be kept as lines or as many array files.
    """
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def read_projected(spark: SparkSession, path: str, columns: list[str], schema: T.StructType, lines: bool = False) -> DataFrame:
    """Only the named fields are parsed."""
    kept = T.StructType([schema[c] for c in columns])
    return read_records(spark, path, kept, lines)


def read_qa(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Triple questions: (triples, question, answer)."""
    raw = read_records(spark, path, "`KG Triples` STRING, query STRING, answer STRING", lines)
    return raw.select(F.col("KG Triples").alias("triples"), F.col("query").alias("question"), "answer")


def stringify_nested(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text; flat columns unchanged."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    options = {"ignoreNullFields": "false"}
    return df.select(*[(F.to_json(f.name, options).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)) for f in df.schema.fields])


def read_keyed_questions(spark: SparkSession, path: str, files: DataFrame | None = None) -> DataFrame:
    """(file, question, answer, title) from objects ``{file: [question…]}``; files not in ``files`` are skipped."""
    raw = spark.read.text(path, wholetext=True)
    keyed = raw.select(F.explode(F.from_json("value", KEYED_QUESTIONS)).alias("file", "qs"))
    rows = keyed.select("file", F.explode("qs").alias("q")).select(
        "file", F.col("q.`Question name`").alias("question"), F.col("q.Answer").alias("answer"), F.col("q.Tittle").alias("title")
    )
    return rows if files is None else rows.join(files.select("file").distinct(), "file", "left_semi")


def read_delimited(spark: SparkSession, path: str, sep: str = "#") -> DataFrame:
    """(table_id, row_no, row MAP) of many delimited files whose columns differ.

    Each file starts with its own header and is small enough to go whole into a prompt, which is what
    these tables are for; files spread over tasks.  A short line leaves its last columns null.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("table_id"), "value")
    lines = files.select("table_id", F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n").alias("lines"))
    quote = f"\\Q{sep}\\E"
    header = lines.select("table_id", F.split(F.element_at("lines", 1), quote).alias("header"), F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0))).alias("rest"))
    rows = header.select("table_id", "header", F.posexplode("rest").alias("row_no", "line"))
    rows = rows.withColumn("cells", F.split("line", quote))
    name = lambda h, i: F.when(F.array_position("header", h) == i + 1, h).otherwise(F.concat(h, F.lit("."), i.cast("string")))
    entries = F.transform("header", lambda h, i: F.struct(name(h, i), F.get("cells", i)))
    return rows.select("table_id", "row_no", F.map_from_entries(entries).alias("row"))


def read_by_language(spark: SparkSession, path: str, language: str, languages: tuple[str, ...] = ("sql", "cypher", "mql")) -> DataFrame:
    """(question, answer): the answer column of the chosen language."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("question", *languages)])
    return read_corpus(spark, path, schema).select("question", F.col(language.lower()).alias("answer"))


def read_corpus(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV corpus with quoted multi-line fields."""
    return spark.read.schema(schema).options(header=True, multiLine=True, quote='"', escape='"').csv(path)
