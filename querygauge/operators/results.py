"""Comparing the results of gold and predicted queries.

Both queries run as Spark SQL over registered views.  Result rows stay distributed; what reaches the
driver per pair is one row of counts.
"""

from __future__ import annotations

import itertools
import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from querygauge.functions.dialect import spark_names
from querygauge.session import scratch_path

TOP = 100  # rows compared as text

REPORT = "pair_id BIGINT, gold_status STRING, pred_status STRING, gold_rows BIGINT, set_equal INT, bag_equal INT, top_equal INT, char_equal INT"
_OUTCOME = ("gold_status", "pred_status", "gold_rows", "set_equal", "bag_equal", "top_equal", "char_equal")


_REFLECTION = ("java_method", "reflect", "try_reflect")  # functions that call any static method of the JVM
_OWN_LEAVES = ("OneRowRelation", "LocalRelation", "Range", "CTERelationRef", "UnionLoopRef")  # rows that the text itself makes


def _listed(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _functions(plan):
    """Nodes of the expressions of one plan node; plans of subqueries are walked by the caller."""
    pending = _listed(plan.expressions())
    while pending:
        node = pending.pop()
        yield node
        pending += _listed(node.children())


def require_query(spark: SparkSession, sql: str) -> None:
    """Raise unless the text is a query over plain names.

    Commands (DDL, writes, settings) run as soon as they are given to the session, calls of JVM methods may run during
    analysis, and a qualified name may be a file: all are refused from the parsed text alone, before anything is looked up."""
    pending = [spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)]
    while pending:
        node = pending.pop()
        kinds = node.getClass()
        while kinds is not None:
            names = [kinds.getName(), *[i.getName() for i in kinds.getInterfaces()]]
            if any(n.endswith(("Command", "ParsedStatement", "InsertIntoDir", "CompoundBody", "PlanWithUnresolvedIdentifier")) for n in names):
                raise ValueError("only queries are run")
            kinds = kinds.getSuperclass()
        if node.nodeName() == "UnresolvedRelation" and node.multipartIdentifier().size() > 1:
            raise ValueError("only registered views are read")
        for f in _functions(node):
            kind = f.getClass().getSimpleName()
            if kind == "ExpressionWithUnresolvedIdentifier" or kind == "UnresolvedFunction" and f.nameParts().last().lower() in _REFLECTION:
                raise ValueError("JVM methods are not called")
        pending += _listed(node.children()) + _listed(node.innerChildren())


def require_views(df: DataFrame) -> None:
    """Raise unless every row comes from a temporary view or from the text itself (VALUES, range)."""
    pending = [df._jdf.queryExecution().analyzed()]
    while pending:
        node = pending.pop()
        if node.nodeName() == "View":
            continue
        children = _listed(node.children())
        if not children and node.nodeName() not in _OWN_LEAVES:
            raise ValueError("only registered views are read")
        pending += children + _listed(node.innerChildren())


def run_query(spark: SparkSession, sql: str) -> DataFrame:
    """Result of a query with columns by position.

    Any other statement, calls of JVM methods and relations other than temporary views are refused before they take effect."""
    sql = spark_names(sql)
    require_query(spark, sql)
    df = spark.sql(sql)
    require_views(df)
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


# --- equality as sets ---------------------------------------------------------------------------

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)


def _aligned(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Same comparable columns on both sides: integers as bigint, other numbers as double, the rest as text.

    A number never equals a text, so a position with both kinds keeps them in separate fields.
    """
    left, right = [], []
    for fa, fb in zip(a.schema.fields, b.schema.fields):
        ints = isinstance(fa.dataType, _INTEGRAL) and isinstance(fb.dataType, _INTEGRAL)
        for df, f, out in ((a, fa, left), (b, fb, right)):
            numeric = isinstance(f.dataType, (T.NumericType, T.BooleanType))
            number = (F.col(f.name).cast("int") if isinstance(f.dataType, T.BooleanType) else F.col(f.name)).cast("bigint" if ints else "double")
            if not ints:  # NaN and -0.0 compare like plain values
                number = number + F.lit(0.0)
            text = F.lit(None).cast("string") if numeric else F.col(f.name).cast("string")
            out.append(F.struct((number if numeric else F.lit(None).cast("bigint" if ints else "double")).alias("n"), text.alias("t")).alias(f.name))
    return a.select(*left), b.select(*right)


def side_counts(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """One row (gold_rows, only_gold, only_pred) over distinct rows; NULL equals NULL."""
    a, b = _aligned(gold, pred)
    tagged = a.withColumn("_s", F.lit(1)).unionAll(b.withColumn("_s", F.lit(2)))
    masks = tagged.groupBy(*a.columns).agg(F.bit_or("_s").alias("_m"), F.count_if(F.col("_s") == 1).alias("_g"))
    return masks.agg(
        F.coalesce(F.sum("_g"), F.lit(0)).alias("gold_rows"),
        F.count_if(F.col("_m") == 1).alias("only_gold"),
        F.count_if(F.col("_m") == 2).alias("only_pred"),
    )


def results_equal_set(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """One row (gold_rows, set_equal): order, duplicates and names ignored.

    With different column counts only two empty results are equal.
    """
    if len(gold.columns) != len(pred.columns):
        n = gold.agg(F.count(F.lit(1)).alias("gold_rows"))
        m = pred.limit(1).agg(F.count(F.lit(1)).alias("m")).scalar()
        return n.select("gold_rows", ((F.col("gold_rows") == 0) & (m == 0)).cast("int").alias("set_equal"))
    c = side_counts(gold, pred)
    return c.select("gold_rows", ((F.col("only_gold") == 0) & (F.col("only_pred") == 0)).cast("int").alias("set_equal"))


# --- equality of the first rows as text ---------------------------------------------------------


def quoted(text: Column) -> Column:
    """Text as a quoted literal: single quotes unless it holds only single ones."""
    body = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark, name in (("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        body = F.replace(body, F.lit(mark), F.lit(name))
    double = text.contains("'") & ~text.contains('"')
    single = F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(double, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(single)


def row_text(df: DataFrame) -> Column:
    """Row as a tuple literal: ``(1, 'a', None)``."""
    cells = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        if isinstance(f.dataType, T.BooleanType):
            c = c.cast("int")
        is_number = isinstance(f.dataType, (T.NumericType, T.BooleanType))
        cells.append(F.coalesce(c.cast("string") if is_number else quoted(c.cast("string")), F.lit("None")))
    tail = ",)" if len(cells) == 1 else ")"
    return F.concat(F.lit("("), F.concat_ws(", ", *cells), F.lit(tail))


def bag_counts(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """One row (gold_rows, pred_rows, only_gold, only_pred) over whole results as multisets of row texts.

    ``only_gold`` counts the rows that gold has more often, with their surplus; equal rows are counted before the shuffle."""
    sides = [df.select(row_text(df).alias("r"), F.lit(g).alias("g"), F.lit(1 - g).alias("p")) for df, g in ((gold, 1), (pred, 0))]
    per = sides[0].unionAll(sides[1]).groupBy("r").agg(F.sum("g").alias("g"), F.sum("p").alias("p"))
    surplus = F.col("g") - F.col("p")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return per.agg(total(F.col("g")).alias("gold_rows"), total(F.col("p")).alias("pred_rows"), total(F.greatest(surplus, F.lit(0))).alias("only_gold"), total(F.greatest(-surplus, F.lit(0))).alias("only_pred"))


def results_equal_bag(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """One row (gold_rows, bag_equal): all rows as text with their numbers of occurrences, whatever their order."""
    return bag_counts(gold, pred).select("gold_rows", ((F.col("only_gold") == 0) & (F.col("only_pred") == 0)).cast("int").alias("bag_equal"))


def first_rows(df: DataFrame, ordered: bool) -> DataFrame:
    """The first rows: of the query's own order, else in the order of all columns, so the choice is repeatable."""
    return (df if ordered else df.orderBy(*df.columns)).limit(TOP)


def top_text(df: DataFrame, ordered: bool = False) -> DataFrame:
    """One row ``txt``: the first 100 rows as sorted tuple texts in one list text."""
    rows = first_rows(df, ordered).select(row_text(df).alias("r"))
    listed = F.transform(F.array_sort(F.collect_list("r")), quoted)  # at most 100 rows by the limit above
    return rows.agg(F.concat(F.lit("["), F.array_join(listed, ", "), F.lit("]")).alias("txt"))


def char_set(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.split(text, "")))


def has_order(df: DataFrame) -> bool:
    """Does the outermost query end in its own ORDER BY (optionally with LIMIT)?  Read from the analysed plan."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "GlobalLimit", "LocalLimit", "Offset", "WithCTE"):
        children = node.children()
        node = children.apply(0) if node.nodeName() != "WithCTE" else node.plan()
    return node.nodeName() == "Sort"


def texts_equal(gold_text: Column, pred_text: Column) -> dict[str, Column]:
    return {
        "top_equal": (gold_text == pred_text).cast("int"),
        "char_equal": (char_set(gold_text) == char_set(pred_text)).cast("int"),
    }


# --- running pairs ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Limits:
    """Seconds for one side of a pair; number of pairs in flight."""

    seconds: float = 600.0
    parallel: int = 8


def is_null_answer(sql: str) -> bool:
    return sql.strip().lower() == "null"


def _bounded(spark: SparkSession, seconds: float, work):
    """(status, value) of work that submits Spark jobs; past the limit its jobs are cancelled."""
    group, late = f"pair-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobGroup(group)

    spark.sparkContext.setJobGroup(group, "query pair", interruptOnCancel=True)
    timer = threading.Timer(seconds, stop)
    timer.start()
    try:
        return "ok", work()
    except Exception:  # a failing predicted query is a result, not an error of the job
        return ("timeout" if late.is_set() else "error"), None
    finally:
        timer.cancel()


@dataclass(frozen=True)
class Side:
    """What running one text gave; the null answer and failures have texts of their own per side."""

    status: str
    text: str
    rows: int | None = None
    result: DataFrame | None = None

    def release(self) -> None:
        if self.result is not None:
            self.result.unpersist()


def _side(spark: SparkSession, sql: str, side: str, seconds: float) -> Side:
    if is_null_answer(sql):
        return Side("null", "null")

    def work() -> tuple[DataFrame, int, str]:
        df = run_query(spark, sql)
        ordered, df = has_order(df), df.persist(StorageLevel.MEMORY_AND_DISK)  # scanned once for all comparisons
        try:
            return df, df.count(), top_text(df, ordered).first()["txt"]
        except Exception:
            df.unpersist()
            raise

    status, value = _bounded(spark, seconds, work)
    if value is None:
        return Side(status, f"[\"('{status}_{side}',)\"]")
    return Side(status, value[2], value[1], value[0])


def _compare(spark: SparkSession, gold: Side, sql: str, limits: Limits) -> tuple:
    pred = _side(spark, sql, "pred", limits.seconds)
    out = dict.fromkeys(_OUTCOME, 0) | {"gold_status": gold.status, "pred_status": pred.status, "gold_rows": gold.rows}
    out["top_equal"], out["char_equal"] = int(gold.text == pred.text), int(set(gold.text) == set(pred.text))
    try:
        if gold.result is None or pred.result is None:
            out["bag_equal"] = out["top_equal"]
        else:
            both = lambda: (results_equal_set(gold.result, pred.result).first(), results_equal_bag(gold.result, pred.result).first())
            status, rows = _bounded(spark, limits.seconds, both)
            if status == "ok":
                out["set_equal"], out["bag_equal"] = rows[0]["set_equal"], rows[1]["bag_equal"]
            else:
                out["pred_status"] = status
    finally:
        pred.release()
    return tuple(out[name] for name in _OUTCOME)


def _compare_gold(spark: SparkSession, gold: str, preds: list[str], limits: Limits) -> list[tuple]:
    """Outcome of each prediction; the gold text is run once for all of them."""
    side = _side(spark, gold, "real", limits.seconds)
    try:
        return [_compare(spark, side, pred, limits) for pred in preds]
    finally:
        side.release()


def _run_groups(groups: dict[tuple[str, str], list[str]], sessions: dict[str, SparkSession], limits: Limits) -> list[tuple]:
    """(db_id, gold, pred, outcome …) of every pair; groups are (db_id, gold) with their predictions."""
    with ThreadPoolExecutor(max_workers=limits.parallel) as pool:
        found = list(pool.map(lambda g: _compare_gold(sessions[g[0]], g[1], groups[g], limits), groups))
    return [(db, gold, pred, *outcome) for ((db, gold), preds), outcomes in zip(groups.items(), found) for pred, outcome in zip(preds, outcomes)]


def compare_all(spark: SparkSession, pairs: list[tuple[int, str, str]], limits: Limits = Limits()) -> DataFrame:
    """Report row per (pair_id, gold, pred) over the session's views, for a list small enough to be written by hand.

    Each distinct pair of texts is compared once, each gold text run once. Jobs are submitted from a small pool so that short
    queries overlap; what they work on is distributed.  A side past its time limit has its jobs cancelled and
    counts as a timeout."""
    groups: dict[tuple[str, str], list[str]] = {}
    for gold, pred in sorted({(g, p) for _, g, p in pairs}):
        groups.setdefault(("", gold), []).append(pred)
    outcome = {row[1:3]: row[3:] for row in _run_groups(groups, {"": spark}, limits)}
    return spark.createDataFrame([(i, *outcome[g, p]) for i, g, p in pairs], REPORT)


def compare_pairs(pairs: DataFrame, open_database: Callable[[SparkSession, str], None], limits: Limits = Limits(), chunk: int = 500) -> DataFrame:
    """Report row (db_id and ``REPORT``) per row of ``pairs`` (pair_id, db_id, gold, pred), each run in its own database.

    Every db_id has an isolated session, whose views ``open_database(session, db_id)`` registers: equal names in two
    databases do not meet, and the caller's views are not seen. The driver holds ``chunk`` distinct pairs and their outcomes
    at a time; outcomes are appended to the shared folder and joined back. Pairs come sorted by database and gold
    text, so that a gold text runs once in a chunk. Defined results: a null id or text counts as empty (an empty text fails),
    repeated rows share one run, an empty table gives an empty report; further columns are not read."""
    spark = pairs.sparkSession
    named = pairs.select("pair_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("db_id", "gold", "pred")])
    folder = scratch_path(spark, "outcomes")
    schema = f"db_id STRING, gold STRING, pred STRING, {REPORT.split(', ', 1)[1]}"
    spark.createDataFrame([], schema).write.parquet(folder)
    rows = named.select("db_id", "gold", "pred").distinct().orderBy("db_id", "gold", "pred").toLocalIterator()
    sessions: dict[str, SparkSession] = {}
    while part := list(itertools.islice(rows, chunk)):
        groups: dict[tuple[str, str], list[str]] = {}
        for db, gold, pred in part:
            groups.setdefault((db, gold), []).append(pred)
        sessions = {db: sessions.get(db) for db, _ in groups}  # databases behind this chunk do not come back
        for db in sessions:
            if sessions[db] is None:
                sessions[db] = spark.newSession()
                open_database(sessions[db], db)
        spark.createDataFrame(_run_groups(groups, sessions, limits), schema).write.mode("append").parquet(folder)
    outcomes = spark.read.schema(schema).parquet(folder)
    return named.join(outcomes, ["db_id", "gold", "pred"]).select("db_id", "pair_id", *_OUTCOME)


def drop_bad_gold(report: DataFrame, allow_empty: bool = False) -> DataFrame:
    """Drop pairs whose gold query fails and, unless allowed, those whose gold result is empty."""
    ok = report.filter(F.col("gold_status") == "ok")
    return ok if allow_empty else ok.filter(F.col("gold_rows") > 0)
