"""Check queries for comparing the results of executed query pairs (exec_)."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from querygauge.functions.dialect import open_dialect
from querygauge.operators import results as E
from querygauge.plans.registry import Tables, query


@dataclass(frozen=True)
class Pair:
    """Gold and predicted text; column kinds (n number, s text) are for the checking SQL only."""

    gold: str
    pred: str
    gold_kinds: str = "n"
    pred_kinds: str = "n"
    pred_ok: bool = True
    gold_ok: bool = True


PAIRS = [
    # same rows, other order and names
    Pair("SELECT n_name, n_regionkey FROM nation", "SELECT n_name AS x, n_regionkey AS y FROM nation ORDER BY n_name DESC", "sn", "sn"),
    # duplicates
    Pair("SELECT DISTINCT o_orderstatus FROM orders", "SELECT o_orderstatus FROM orders", "s", "s"),
    # integer against double
    Pair("SELECT count(*) FROM lineitem", "SELECT CAST(count(*) AS DOUBLE) FROM lineitem"),
    # another filter
    Pair("SELECT c_custkey FROM customer WHERE c_acctbal > 0", "SELECT c_custkey FROM customer WHERE c_acctbal > 10"),
    # join against IN
    Pair(
        "SELECT DISTINCT c_name FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'P'",
        "SELECT c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')", "s", "s",
    ),
    # column missing
    Pair("SELECT r_regionkey, r_name FROM region", "SELECT r_name FROM region", "ns", "s"),
    # fails to resolve
    Pair("SELECT s_name FROM supplier", "SELECT s_nme FROM supplier", "s", "s", pred_ok=False),
    # fails while running
    Pair("SELECT max(p_size) FROM part", "SELECT max(CAST(p_name AS INT)) FROM part", pred_ok=False),
    # gold fails
    Pair("SELECT nothing FROM nowhere", "SELECT 1", gold_ok=False),
    # both fail
    Pair("SELECT nothing FROM nowhere", "SELECT nothing FROM nowhere", gold_ok=False, pred_ok=False),
    # empty gold result, empty prediction
    Pair("SELECT o_orderkey FROM orders WHERE o_totalprice < 0", "SELECT c_name FROM customer WHERE c_acctbal > 1000000", "n", "s"),
    # grouped, HAVING, rounding
    Pair(
        "SELECT o_orderpriority, count(*) FROM orders GROUP BY o_orderpriority HAVING count(*) > 10",
        "SELECT o_orderpriority, sum(1) FROM orders GROUP BY o_orderpriority", "sn", "sn",
    ),
    # top rows in their own order
    Pair(
        "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
        "SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10",
    ),
    # CASE and NULL
    Pair(
        "SELECT CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END FROM customer",
        "SELECT DISTINCT CASE WHEN c_acctbal >= 0 THEN c_mktsegment END FROM customer", "s", "s",
    ),
    # set operations
    Pair(
        "SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier",
        "SELECT DISTINCT c_nationkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey)",
    ),
    # LIKE and BETWEEN
    Pair("SELECT p_partkey FROM part WHERE p_name LIKE 'small%' AND p_size BETWEEN 1 AND 5", "SELECT p_partkey FROM part WHERE p_name LIKE 'small%' AND p_size <= 5"),
    # window against aggregate
    Pair(
        "SELECT max(o_orderkey) FROM orders GROUP BY o_custkey",
        "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) t WHERE r = 1",
    ),
    # not answerable on both sides, on one side
    Pair("null", "null"),
    Pair("null", "SELECT 1"),
    Pair("SELECT count(*) FROM nation", "NULL"),
    # digits of one number in another order
    Pair("SELECT r_regionkey * 100 + 12 FROM region WHERE r_regionkey = 1", "SELECT r_regionkey * 200 + 11 FROM region WHERE r_regionkey = 1"),
]

TEXTS = [(i, p.gold, p.pred) for i, p in enumerate(PAIRS)]


def report(t: Tables) -> DataFrame:
    for _, gold, pred in TEXTS:
        t.register(f"{gold} {pred}")
    return E.compare_all(t.spark, TEXTS)


def _null(sql: str) -> bool:
    return sql.lower() == "null"


def _set_equal(p: Pair) -> str:
    if not (p.gold_ok and p.pred_ok) or _null(p.gold) or _null(p.pred):
        return "0"
    if len(p.gold_kinds) != len(p.pred_kinds) or p.gold_kinds != p.pred_kinds:
        return f"CAST((SELECT count(*) FROM ({p.gold})) = 0 AND (SELECT count(*) FROM ({p.pred})) = 0 AS INT)"
    diff = f"(SELECT * FROM ({p.gold}) EXCEPT SELECT * FROM ({p.pred})) UNION ALL (SELECT * FROM ({p.pred}) EXCEPT SELECT * FROM ({p.gold}))"
    return f"CAST((SELECT count(*) FROM ({diff})) = 0 AS INT)"


def _text(sql: str, kinds: str, ok: bool, side: str, limit: str = " LIMIT 100") -> str:
    """Text of one side, built by the checking engine."""
    if _null(sql):
        return "'null'"
    if not ok:
        return f"'[\"(''error_{side}'',)\"]'"
    names = [f"c{i}" for i in range(len(kinds))]
    cells = [f"coalesce(CAST({n} AS VARCHAR), 'None')" if k == "n" else f"coalesce('''' || {n} || '''', 'None')" for n, k in zip(names, kinds)]
    row = "'(' || " + " || ', ' || ".join(cells) + (" || ',)'" if len(names) == 1 else " || ')'")
    order = "" if re.search(r"(?is)\border by\b[^()]*$", sql) else " ORDER BY ALL NULLS FIRST"
    quoted = "CASE WHEN contains(r, '''') THEN '\"' || r || '\"' ELSE '''' || r || '''' END"
    return f"(SELECT '[' || coalesce(string_agg({quoted}, ', ' ORDER BY r), '') || ']' FROM (SELECT {row} AS r FROM (SELECT * FROM ({sql}) AS q({', '.join(names)}){order}{limit})))"


def _texts(p: Pair, limit: str = " LIMIT 100") -> tuple[str, str]:
    return _text(p.gold, p.gold_kinds, p.gold_ok, "real", limit), _text(p.pred, p.pred_kinds, p.pred_ok, "pred", limit)


def _status(sql: str, ok: bool) -> str:
    return "null" if _null(sql) else "ok" if ok else "error"


def _rows(p: Pair) -> str:
    return "NULL" if _null(p.gold) or not p.gold_ok else f"(SELECT count(*) FROM ({p.gold}))"


def _columns(i: int, p: Pair) -> str:
    gold, pred = _texts(p)
    whole_gold, whole_pred = _texts(p, "")
    chars = lambda x: f"list_sort(list_distinct(string_split({x}, '')))"
    return (
        f"SELECT CAST({i} AS BIGINT) AS pair_id, '{_status(p.gold, p.gold_ok)}' AS gold_status, '{_status(p.pred, p.pred_ok)}' AS pred_status, "
        f"CAST({_rows(p)} AS BIGINT) AS gold_rows, {_set_equal(p)} AS set_equal, CAST({whole_gold} = {whole_pred} AS INT) AS bag_equal, CAST({gold} = {pred} AS INT) AS top_equal, CAST({chars(gold)} = {chars(pred)} AS INT) AS char_equal"
    )


_REPORT = " UNION ALL ".join(_columns(i, p) for i, p in enumerate(PAIRS))


@query("exec_match_report", _REPORT)
def _(t):
    return report(t)


@query("exec_status", f"SELECT pair_id, gold_status, pred_status FROM ({_REPORT})")
def _(t):
    return report(t).select("pair_id", "gold_status", "pred_status")


@query("exec_drop_bad_gold", f"SELECT pair_id, gold_rows FROM ({_REPORT}) WHERE gold_status = 'ok' AND gold_rows > 0")
def _(t):
    return E.drop_bad_gold(report(t)).select("pair_id", "gold_rows")


@query(
    "exec_null_sentinel",
    " UNION ALL ".join(
        f"SELECT CAST({i} AS BIGINT) AS pair_id, {str(not _null(p.gold)).lower()} AS gold_answered, {str(not _null(p.pred)).lower()} AS pred_answered, {'1' if _null(p.gold) and _null(p.pred) else '0'} AS both_null"
        for i, p in enumerate(PAIRS)
    ),
)
def _(t):
    r = report(t)
    gold, pred = F.col("gold_status") != "null", F.col("pred_status") != "null"
    return r.select("pair_id", gold.alias("gold_answered"), pred.alias("pred_answered"), (~gold & ~pred & (F.col("top_equal") == 1)).cast("int").alias("both_null"))


# --- the comparisons by themselves, on results that grow with the tables -------------------------

_SETS = {
    "priorities": ("SELECT o_orderpriority, o_orderstatus FROM orders", "SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders"),
    "customers": ("SELECT o_custkey FROM orders", "SELECT c_custkey FROM customer"),
    "parts": ("SELECT l_partkey, l_suppkey FROM lineitem", "SELECT l_partkey, CAST(l_suppkey AS DOUBLE) FROM lineitem WHERE l_quantity >= 1"),
}


@query(
    "exec_set_match",
    " UNION ALL ".join(
        f"SELECT '{k}' AS name, (SELECT count(*) FROM ({g})) AS gold_rows, CAST((SELECT count(*) FROM ((SELECT * FROM ({g}) EXCEPT SELECT * FROM ({p})) UNION ALL (SELECT * FROM ({p}) EXCEPT SELECT * FROM ({g})))) = 0 AS INT) AS set_equal"
        for k, (g, p) in _SETS.items()
    ),
)
def _(t):
    out = None
    for name, (gold, pred) in _SETS.items():
        t.register(f"{gold} {pred}")
        one = E.results_equal_set(E.run_query(t.spark, gold), E.run_query(t.spark, pred)).select(F.lit(name).alias("name"), "gold_rows", "set_equal")
        out = one if out is None else out.unionByName(one)
    return out


_TOPS = {
    "same": ("SELECT l_orderkey, l_partkey FROM lineitem", "SELECT l_orderkey AS a, l_partkey AS b FROM lineitem WHERE l_orderkey >= 0"),
    "duplicates": ("SELECT l_orderkey FROM lineitem", "SELECT DISTINCT l_orderkey FROM lineitem"),
    "ordered": ("SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey", "SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey"),
    "digits": ("SELECT c_custkey FROM customer", "SELECT c_custkey FROM customer WHERE c_custkey > 0"),
}


def _tops(column: str) -> str:
    rows = []
    for name, (g, p) in _TOPS.items():
        kinds = "nn" if name == "same" else "n"
        a, b = _text(g, kinds, True, "real"), _text(p, kinds, True, "pred")
        value = f"{a} = {b}" if column == "top_equal" else f"list_sort(list_distinct(string_split({a}, ''))) = list_sort(list_distinct(string_split({b}, '')))"
        rows.append(f"SELECT '{name}' AS name, CAST({value} AS INT) AS {column}")
    return " UNION ALL ".join(rows)


def _compare_tops(t: Tables, column: str) -> DataFrame:
    out = None
    for name, (gold, pred) in _TOPS.items():
        t.register(f"{gold} {pred}")
        g, p = E.run_query(t.spark, gold), E.run_query(t.spark, pred)
        a = E.top_text(g, E.has_order(g)).select(F.lit(name).alias("name"), F.col("txt").alias("a"))
        b = E.top_text(p, E.has_order(p)).select(F.lit(name).alias("name"), F.col("txt").alias("b"))
        one = a.join(b, "name").select("name", E.texts_equal(F.col("a"), F.col("b"))[column].alias(column))
        out = one if out is None else out.unionByName(one)
    return out


@query("exec_bag_match", _tops("top_equal"))
def _(t):
    return _compare_tops(t, "top_equal")


@query("exec_charset_match", _tops("char_equal"))
def _(t):
    return _compare_tops(t, "char_equal")


# --- whole results as multisets; pairs in databases of their own ----------------------------------

_BAGS = {
    "same": _TOPS["same"],
    "duplicates": _TOPS["duplicates"],
    "behind row 100": ("SELECT l_orderkey, l_linenumber FROM lineitem", "SELECT l_orderkey, CASE WHEN l_orderkey = (SELECT max(l_orderkey) FROM lineitem) THEN -1 ELSE l_linenumber END FROM lineitem"),
    "one count": ("SELECT o_orderstatus FROM orders", "SELECT CASE WHEN o_orderkey = (SELECT min(o_orderkey) FROM orders) THEN 'F' ELSE o_orderstatus END FROM orders UNION ALL SELECT 'F' WHERE false"),
}


def _surplus(a: str, b: str) -> str:
    return f"(SELECT count(*) FROM (({a}) EXCEPT ALL ({b})))"


@query(
    "exec_whole_bag",
    " UNION ALL ".join(
        f"SELECT '{k}' AS name, (SELECT count(*) FROM ({g})) AS gold_rows, (SELECT count(*) FROM ({p})) AS pred_rows, {_surplus(g, p)} AS only_gold, {_surplus(p, g)} AS only_pred"
        for k, (g, p) in _BAGS.items()
    ),
)
def _(t):
    out = None
    for name, (gold, pred) in _BAGS.items():
        t.register(f"{gold} {pred}")
        one = E.bag_counts(E.run_query(t.spark, gold), E.run_query(t.spark, pred)).select(F.lit(name).alias("name"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "exec_by_database",
    """
    WITH dbs AS (SELECT unnest(['credit', 'debit']) AS db_id), kinds AS (SELECT unnest([0, 1]) AS k),
    sizes AS (
      SELECT r_regionkey, db_id, count(c_custkey) AS gold_rows
      FROM region CROSS JOIN dbs LEFT JOIN nation ON n_regionkey = r_regionkey
      LEFT JOIN customer ON c_nationkey = n_nationkey AND (c_acctbal >= 0) = (db_id = 'credit')
      GROUP BY r_regionkey, db_id
    )
    SELECT db_id, CAST(r_regionkey * 2 + k AS BIGINT) AS pair_id, 'ok' AS gold_status, 'ok' AS pred_status, gold_rows,
      CAST(k = 0 OR db_id = 'credit' OR gold_rows = 0 AS INT) AS set_equal, CAST(k = 0 OR db_id = 'credit' OR gold_rows = 0 AS INT) AS bag_equal
    FROM sizes CROSS JOIN kinds
    """,
)
def _(t):
    """Two databases with a table ``customer`` each; one pair per region and prediction, made from the region table."""

    def open_database(session, db_id):
        customers, nations = (session.read.parquet(f"{t.folder}/{name}.parquet") for name in ("customer", "nation"))
        customers.filter(F.col("c_acctbal") >= 0 if db_id == "credit" else F.col("c_acctbal") < 0).createOrReplaceTempView("customer")
        nations.createOrReplaceTempView("nation")

    gold = "SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = %d"
    same = "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = %d)"
    region = t.region.select("r_regionkey", F.explode(F.array(F.lit("credit"), F.lit("debit"))).alias("db_id"))
    forms = region.select("*", F.posexplode(F.array(F.lit(same), F.lit(f"{same} AND c_acctbal >= 0"))).alias("k", "form"))
    pairs = forms.select((F.col("r_regionkey") * 2 + F.col("k")).cast("bigint").alias("pair_id"), "db_id", F.format_string(gold, "r_regionkey").alias("gold"), F.expr("format_string(form, r_regionkey)").alias("pred"))
    return E.compare_pairs(pairs, open_database).select("db_id", "pair_id", "gold_status", "pred_status", "gold_rows", "set_equal", "bag_equal")


# --- texts in the embedded-database dialect --------------------------------------------------------

_MONTHS = """SELECT STRFTIME('%Y-%m', o_orderdate) AS month, COUNT(*) AS n, SUM(IIF(o_orderstatus = 'F', 1, 0)) AS done, MAX(INSTR(o_orderpriority, '-')) AS dash,
  ROUND(MAX(JULIANDAY(o_orderdate)) - MIN(JULIANDAY(o_orderdate, 'start of month')), 4) AS days, MIN(DATETIME(o_orderdate, '+1 day')) AS next_day
  FROM orders WHERE STRFTIME('%Y', 'now') >= STRFTIME('%Y', o_orderdate) GROUP BY STRFTIME('%Y-%m', o_orderdate)"""


@query(
    "exec_dialect",
    """SELECT strftime(o_orderdate, '%Y-%m') AS c0, count(*) AS c1, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS c2, max(instr(o_orderpriority, '-')) AS c3,
      round(max(julian(o_orderdate)) - min(julian(date_trunc('month', o_orderdate))), 4) AS c4, strftime(min(o_orderdate) + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS c5
      FROM orders GROUP BY strftime(o_orderdate, '%Y-%m')""",
)
def _(t):
    """A time question as such texts ask it, run in a session of its own."""
    session = t.spark.newSession()
    open_dialect(session)
    Tables(session, t.folder).register("orders")
    return E.run_query(session, _MONTHS)
