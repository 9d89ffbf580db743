"""Functions of the embedded-database SQL dialect that gold and predicted texts use, for sessions that run them.

They are temporary SQL functions: Catalyst inlines their bodies, so they stay in generated code.  ``INSTR``, ``DATE`` and the
like are Spark's own.  Times have no zone; 'now' is the current time; a text that is no time gives NULL.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

_NOW = "CAST(current_timestamp() AS TIMESTAMP_NTZ)"
# the time of (t, change): 'start of day|month|year', or a number of units to add
_NUMBER = r"CAST(regexp_extract(change, '^([+-]?\\d+) *(second|minute|hour|day|month|year)s?$', 1) AS INT)"
_UNIT = r"regexp_extract(lower(change), '^[+-]?\\d+ *(second|minute|hour|day|month|year)s?$', 1)"


def _moment(t: str = "t") -> str:
    plain = f"CASE WHEN lower({t}) = 'now' THEN {_NOW} ELSE TRY_CAST({t} AS TIMESTAMP_NTZ) END"
    starts = " ".join(f"WHEN lower(change) = 'start of {u}' THEN CAST(date_trunc('{u}', {plain}) AS TIMESTAMP_NTZ)" for u in ("day", "month", "year"))
    units = " ".join(f"WHEN '{u}' THEN {plain} + {_NUMBER} * INTERVAL '1' {u.upper()}" for u in ("second", "minute", "hour", "day", "month", "year"))
    return f"CASE WHEN change IS NULL THEN {plain} {starts} ELSE CASE {_UNIT} {units} END END"


#: What stands for each mark of a format, given the time ``m``.
MARKS = {
    "%Y": "date_format(m, 'yyyy')", "%m": "date_format(m, 'MM')", "%d": "date_format(m, 'dd')", "%H": "date_format(m, 'HH')", "%M": "date_format(m, 'mm')",
    "%S": "date_format(m, 'ss')", "%f": "date_format(m, 'ss.SSS')", "%j": "date_format(m, 'DDD')", "%w": "CAST(dayofweek(m) - 1 AS STRING)",
    "%s": "CAST(timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', m) AS STRING)", "%J": "CAST(julian_of(m) AS STRING)", "%%": "'%'",
}


def _filled() -> str:
    """The format cut at its marks; every piece is a mark with the plain text behind it, so filled-in text is never read as a mark."""
    cases = " ".join(f"WHEN '{mark}' THEN {value}" for mark, value in MARKS.items())
    pieces = r"regexp_extract_all(fmt, '(%.|[^%]+|%)', 1)"
    whole = f"array_join(transform({pieces}, x -> CASE x {cases} ELSE x END), '')"
    return f"CASE WHEN m IS NULL THEN NULL ELSE {whole} END"


FUNCTIONS = (
    "julian_of(m TIMESTAMP_NTZ) RETURNS DOUBLE RETURN timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', m) / 86400000000D + 2440587.5D",
    f"filled_in(fmt STRING, m TIMESTAMP_NTZ) RETURNS STRING RETURN {_filled()}",
    f"moment_of(t STRING, change STRING) RETURNS TIMESTAMP_NTZ RETURN {_moment()}",
    "strftime(fmt STRING, t STRING, change STRING DEFAULT NULL) RETURNS STRING RETURN filled_in(fmt, moment_of(t, change))",
    "julianday(t STRING, change STRING DEFAULT NULL) RETURNS DOUBLE RETURN julian_of(moment_of(t, change))",
    "datetime(t STRING, change STRING DEFAULT NULL) RETURNS STRING RETURN date_format(moment_of(t, change), 'yyyy-MM-dd HH:mm:ss')",
)

_LITERAL_OR_IIF = re.compile(r"('(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`)|\bIIF(?=\s*\()", re.IGNORECASE)


def open_dialect(spark: SparkSession) -> None:
    """Register the functions in this session (a session of ``compare_pairs``, from ``open_database``)."""
    for body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {body}")


def spark_names(sql: str) -> str:
    """``sql`` with the functions that need any argument type under Spark's name for them (IIF is IF)."""
    return _LITERAL_OR_IIF.sub(lambda m: m.group(1) or "IF", sql)
