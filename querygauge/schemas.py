"""Explicit schemas: nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "INT": T.IntegerType(), "BIGINT": T.LongType(), "STRING": T.StringType(), "DOUBLE": T.DoubleType(), "TIMESTAMP_NTZ": T.TimestampNTZType(),
}


def _s(columns: str) -> T.StructType:
    """Flat schema from ``name TYPE, …``; needs no session."""
    pairs = [c.split() for c in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


EXAMPLES = _s("example_id STRING, task STRING, db_id STRING, question STRING, context STRING, evidence STRING, answer STRING, query_type STRING")
RESPONSES = _s("example_id STRING, generation INT, response STRING")
PAIRS = _s("pair_id BIGINT, query_type STRING, gold STRING, pred STRING, response STRING")
SCORES = _s("pair_id BIGINT, iteration INT, metric STRING, value DOUBLE")
STATS = _s("task STRING, metric STRING, mean DOUBLE, std DOUBLE, ci_lower DOUBLE, ci_upper DOUBLE")
MESSAGES = "messages ARRAY<STRUCT<role: STRING, content: STRING>>"
KEYED_QUESTIONS = "MAP<STRING, ARRAY<STRUCT<`Question name`: STRING, Answer: STRING, Tittle: STRING>>>"

TABLES = {
    "region": _s("r_regionkey INT, r_name STRING"),
    "nation": _s("n_nationkey INT, n_name STRING, n_regionkey INT"),
    "customer": _s("c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"),
    "supplier": _s("s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE"),
    "part": _s("p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE"),
    "orders": _s("o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"),
    "lineitem": _s(
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_extendedprice DOUBLE, "
        "l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ"
    ),
    "events": _s("event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"),
    "documents": _s("doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"),
    "benchmark": _s("item_id BIGINT, text STRING"),
    "labels": _s("doc_id BIGINT, quality INT, toxic INT"),
    "conversations": _s("conv_id BIGINT, turn BIGINT, role STRING, text STRING"),
}
