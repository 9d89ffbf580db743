"""Site-relative line frequency: lines that stand on too large a share of a host's pages are dropped.

A line is compared without the blanks around it, by its 64-bit hash; blank lines are not counted and stay.
A line goes if it is on more than ``ratio`` of the host's rows, and on ``min_pages`` rows at least (a host
of few pages has no boilerplate that can be told from its content).

Defined results: a null text is empty; a null host is a host of its own; a repeated row counts as one more
page; a line that repeats within a page counts once there; a page of boilerplate only becomes empty lines
or an empty text and stays as a row. All other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from querygauge.llm.common import text_or_empty, unused

RATIO = 0.1
MIN_PAGES = 5


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate(docs: DataFrame, text: Column, host: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, keys): the hashes of each host's boilerplate lines; fewer than lines per page / ratio of them."""
    lines = docs.select(host.alias("host"), F.split(text_or_empty(text), "\n", -1).alias("lines"))
    keys = F.array_distinct(F.transform(F.filter("lines", lambda x: F.trim(x) != ""), _key))
    counts = lines.select("host", F.explode(keys).alias("key")).groupBy("host", "key").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    totals = docs.select(host.alias("host")).groupBy("host").agg(F.count("*").alias("total"))
    joined = counts.alias("c").join(totals.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host")))
    often = joined.filter(F.col("n") > F.col("total") * ratio).select("c.host", "key")
    return often.groupBy("host").agg(F.collect_list("key").alias("keys"))


def line_dedup(docs: DataFrame, text_col: str, host: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES, counts: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text_col``; ``counts`` names columns for lines and dropped lines."""
    row, own, keys = unused(docs, "row", "host_of_row", "keys_of_host")
    bad = boilerplate(docs, F.col(text_col), host, ratio, min_pages).select(F.col("host").alias(f"{own}_b"), F.col("keys").alias(keys))
    joined = docs.withColumn(own, host).join(bad, F.col(own).eqNullSafe(F.col(f"{own}_b")), "left")
    lines = F.split(text_or_empty(F.col(text_col)), "\n", -1)
    stays = lambda x: (F.trim(x) == "") | ~F.coalesce(F.array_contains(F.col(keys), _key(x)), F.lit(False))
    real = F.size(F.filter(lines, lambda x: F.trim(x) != ""))
    gone = F.size(lines) - F.size(F.filter(lines, stays))
    new = {text_col: F.array_join(F.filter(lines, stays), "\n")} | (dict(zip(counts, (real.cast("bigint"), gone.cast("bigint")))) if counts else {})
    return joined.withColumns(new).drop(own, f"{own}_b", keys)


def page_text(html: Column) -> Column:
    """Lines of a raw page: scripts, styles and comments go, each tag ends a line."""
    bare = F.regexp_replace(text_or_empty(html), r"(?is)<(?:script|style)\b.*?</(?:script|style)>|<!--.*?-->", "")
    return F.regexp_replace(bare, "<[^>]*>", "\n")


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


PAGES_SQL = r"""
WITH p AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
    string_split(regexp_replace(regexp_replace(coalesce(html, ''), '<(?:script|style)\b.*?</(?:script|style)>|<!--.*?-->', '', 'gis'), '<[^>]*>', chr(10), 'g'), chr(10)) AS lines
  FROM pages),
counts AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(list_transform(list_filter(lines, lambda x: trim(x) <> ''), lambda x: trim(x)))) AS line FROM p) GROUP BY ALL),
totals AS (SELECT host, count(*) AS total FROM p GROUP BY host),
bad AS (SELECT host, list(line) AS keys FROM counts JOIN totals USING (host) WHERE n >= 5 AND n > total * CAST(0.1 AS DOUBLE) GROUP BY host),
kept AS (SELECT page_id, host, lines, list_filter(lines, lambda x: trim(x) = '' OR NOT coalesce(list_contains(keys, trim(x)), false)) AS stay FROM p LEFT JOIN bad USING (host))
SELECT page_id, host, CAST(len(list_filter(lines, lambda x: trim(x) <> '')) AS BIGINT) AS n_lines, CAST(len(lines) - len(stay) AS BIGINT) AS n_dropped,
  array_to_string(stay, chr(10)) AS text
FROM kept
"""
