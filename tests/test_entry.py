"""Registered queries against their SQL on the smoke tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from check import canonical
from querygauge.schemas import TABLES

QUICK = [
    "x_last_fence_lang", "x_canonical_sql", "x_normalise", "prep_split", "prep_balance", "prep_decontaminate", "build_prompt", "build_messages", "m_exact_match",
    "m_bleu4", "m_rouge_l", "m_similarity_bound", "c_sql_f1", "c_cypher_f1", "g_edges", "g_edit_distance", "a_grade_group", "a_sample_stats", "a_task_report",
    "exec_set_match", "w_left_join", "w_one_hop", "w_doc_unwind", "src_hash_csv", "z_running_scores", "t_table_qa", "t_training_mix",
]


@pytest.fixture(scope="module")
def con(smoke_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{smoke_dir}/{name}.parquet'")
    return c


def test_contract(spark):
    known, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(known) and len(known) > 100
    assert entry.entry(spark).columns == ["task", "metric", "score", "mean", "std", "ci_lower", "ci_upper"]


@pytest.mark.parametrize("name", QUICK)
def test_equal_to_sql(spark, con, smoke_dir, name):
    df = entry.queries()[name](spark, smoke_dir)
    result = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(result.fetchall(), names)


def test_documents_ratio_equals_brute_force_on_names(spark, smoke_dir):
    """The rows-only ROUGE query uses the same operator as the one checked by SQL."""
    from querygauge.plans.registry import Tables

    rows = entry.queries()["m_rouge_l_documents"](spark, smoke_dir).collect()
    docs = {r["doc_id"]: r["text"].lower().split() for r in Tables(spark, smoke_dir).documents.collect()}
    from test_textscore import lcs

    for r in sorted(rows)[:15]:
        a, b = docs[r["pair_id"]], docs[r["pair_id"] + 1]
        if len(a) * len(b) < 400_000:
            assert r["rouge"] == pytest.approx(2 * lcs(a, b) / (len(a) + len(b)), abs=1e-6)
