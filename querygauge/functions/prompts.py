"""Prompt, message and completion building as string projections."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, functions as F



def render(template: str, **values: Column) -> Column:
    """Fill a template in one pass: values holding braces are never read as placeholders."""
    pieces: list[Column] = []
    for literal, field, _, _ in Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if field is not None:
            pieces.append(F.coalesce(values[field].cast("string"), F.lit("None")))
    return F.concat(*pieces)


def render_if(flag: Column, with_flag: Column, without: Column) -> Column:
    return F.when(flag, with_flag).otherwise(without)


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def messages(system: Column, user: Column, assistant: Column | None = None) -> Column:
    turns = [message("system", system), message("user", user)]
    if assistant is not None:
        turns.append(message("assistant", assistant))
    return F.array(*turns)


def clean_thinking(text: Column) -> Column:
    """``<thinking>`` tags out, one ``<think>`` pair around."""
    bare = F.replace(F.replace(text, F.lit("<thinking>"), F.lit("")), F.lit("</thinking>"), F.lit(""))
    return F.concat(F.lit("<think> "), bare, F.lit(" </think>"))


def fenced(answer: Column, query_type: Column) -> Column:
    """Answer fenced by its own query type."""
    return F.concat(F.lit("```"), query_type, F.lit(" "), answer, F.lit(" ```"))


def completion(thinking: Column | None, answer: Column, query_type: Column, end_mark: str) -> Column:
    parts = [fenced(answer, query_type), F.lit(end_mark)]
    return F.concat(*([clean_thinking(thinking)] if thinking is not None else []), *parts)


def triples_text(triples: Column) -> Column:
    """Array of (s, p, o) structs as text."""
    one = lambda t: F.concat(F.lit("("), t["s"], F.lit(", "), t["p"], F.lit(", "), t["o"], F.lit(")"))
    return F.concat(F.lit("["), F.array_join(F.transform(triples, one), ", "), F.lit("]"))
