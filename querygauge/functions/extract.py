"""Pulling queries and answers out of response text, and normalising them.

Every function takes and returns a Column, so all of this stays inside one narrow stage.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from querygauge.fixed_values import (
    ANSWER_PUNCTUATION,
    FIXED_NOW,
    LANGUAGE_TAGS,
    VITAL_RANGES,
)

BLANKS = " \t\n\r\x0b\x0c"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def words(text: Column) -> Column:
    """Words of a text; no empty entries."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def collapse(text: Column) -> Column:
    """Lower case, single blanks."""
    return F.array_join(words(F.lower(text)), " ")


def _last_block(text: Column, fence: str) -> Column:
    tail = F.element_at(F.split(text, f"\\Q{fence}\\E"), -1)
    body = F.element_at(F.split(tail, "```"), 1)
    return F.when(text.contains(fence) & tail.contains("```"), strip(body))


def last_fence(text: Column, tag: str, mode: str = "sql") -> Column:
    """Text of the last closed fenced block.

    ``sql``: case kept, one blank when absent.  ``upper``: any-case tag, upper-cased, one blank when
    absent.  ``train``: any-case tag, lower-cased, empty when absent.
    """
    if mode == "sql":
        return F.coalesce(_last_block(text, f"```{tag}"), F.lit(" "))
    block = _last_block(F.lower(text), f"```{tag.lower()}")
    if mode == "upper":
        return F.coalesce(F.upper(block), F.lit(" "))
    if mode == "train":
        return F.coalesce(block, F.lit(""))
    raise ValueError(f"unknown mode {mode}")


def last_fence_by_language(text: Column, language: Column) -> Column:
    """Upper-cased block of the language named in each row; one blank for unknown languages."""
    out = F.lit(" ")
    for name, tag in LANGUAGE_TAGS.items():
        out = F.when(F.lower(language) == name, last_fence(text, tag, "upper")).otherwise(out)
    return out


def training_query(text: Column, query_type: Column) -> Column:
    """Block of the row's own query type, normalised for scoring."""
    block = F.when(query_type == "cypher", last_fence(text, "cypher", "train")).otherwise(last_fence(text, "sql", "train"))
    return normalise_query(block, query_type)


def has_fence(text: Column, tag: str) -> Column:
    return text.rlike(f"(?is)```{tag}.*?```")


def after_marker(text: Column, marker: str, required: bool = False) -> Column:
    """Text after the last marker; without one the whole text, or nothing if it is required."""
    tail = F.substring_index(text, marker, -1)
    return F.when(text.contains(marker), tail).otherwise(F.lit("")) if required else tail


def yes_no(text: Column) -> Column:
    bare = F.lower(F.replace(text, F.lit(" "), F.lit("")))
    return F.when(bare == "yes", "True").when(bare == "no", "False").otherwise(text)


def first_number(text: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(text, r"\d+\.\d+|\d+", 0), F.lit("")), text)


def table_names(sql: Column) -> Column:
    """Sorted distinct names after FROM and JOIN; comments removed, quotes stripped."""
    clean = F.regexp_replace(F.lower(sql), r"(?m)--.*$", "")
    found = F.regexp_extract_all(clean, F.lit(r"\b(?:from|join)\s+([^\s,();]+)"), F.lit(1))
    bare = F.transform(found, lambda n: F.btrim(n, F.lit("`\"'()[]\n\t ")))
    return F.array_sort(F.array_distinct(F.filter(bare, lambda n: n != "")))


def schema_blocks(info: Column, names: Column) -> Column:
    """CREATE TABLE blocks naming one of the tables in their first line and holding a sample block."""
    blocks = F.split(info, "CREATE TABLE")
    rest = F.slice(blocks, F.lit(2), F.greatest(F.size(blocks) - 1, F.lit(0)))
    kept = F.filter(
        rest,
        lambda b: b.contains("/*")
        & F.exists(names, lambda n: F.element_at(F.split(b, "\n"), 1).contains(F.concat(F.lit('"'), F.upper(n), F.lit('"')))),
    )

    def restore(block: Column) -> Column:
        parts = F.split(block, r"/\*")
        return F.concat(F.lit("CREATE TABLE"), F.element_at(parts, 1), F.lit("/*"), F.element_at(parts, 2))

    return F.array_join(F.transform(kept, restore), "\n")


def _vital(sql: Column, end: str) -> Column:
    return F.regexp_extract(sql, rf"[ \n]+([a-zA-Z0-9_]+_{end})", 1)


def fill_ranges(sql: Column) -> Column:
    """Replace ``<vital>_lower`` / ``<vital>_upper`` by their bounds when both name one known vital."""
    low, high = _vital(sql, "lower"), _vital(sql, "upper")
    low_name = F.regexp_extract(low, "([a-zA-Z0-9_]+)_lower", 1)
    high_name = F.regexp_extract(high, "([a-zA-Z0-9_]+)_upper", 1)
    vital = F.replace(low_name, F.lit("_"), F.lit(" "))
    bounds = F.create_map(*[F.lit(x) for k, (a, b) in VITAL_RANGES.items() for x in (k, f"{a}|{b}")])
    pair = F.try_element_at(bounds, vital)
    filled = F.replace(F.replace(sql, low, F.substring_index(pair, "|", 1)), high, F.substring_index(pair, "|", -1))
    usable = (low != "") & (high != "") & (low_name == high_name) & pair.isNotNull()
    return F.when(usable, filled).otherwise(sql)


def canonical_sql(sql: Column) -> Column:
    """Clinical query text in the form it is executed in: fixed clock, ranges filled, operators joined."""
    quoted_now = f"'{FIXED_NOW}'"
    text = fill_ranges(F.replace(F.lower(sql), F.lit("current_time"), F.lit(quoted_now)))
    for old, new in (("''", "'"), ("< =", "<="), ("%y", "%Y"), ("%j", "%J"), ("'now'", quoted_now)):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def normalise_answer(text: Column) -> Column:
    """Lower case, listed punctuation deleted (dots and minus signs too), single blanks."""
    return collapse(F.translate(F.lower(text), ANSWER_PUNCTUATION, ""))


def normalise_query(text: Column, query_type: Column) -> Column:
    """Cypher: upper case.  SQL: single blanks, no closing semicolon (lexical; no parser)."""
    flat = F.array_join(words(text), " ")
    return F.when(query_type == "cypher", F.upper(text)).otherwise(F.regexp_replace(flat, r"\s*;$", ""))
