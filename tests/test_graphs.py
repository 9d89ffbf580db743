from __future__ import annotations

import random
from itertools import permutations

from querygauge.operators import graphs as G


def pairs(spark, rows):
    return spark.createDataFrame([(i, g, p) for i, (g, p) in enumerate(rows)], "pair_id BIGINT, gold STRING, pred STRING")


def test_nodes_and_edges(spark):
    q = "MATCH (a:A {x: 1})-[:R]->(b)<-[e:S]-(:C), (b:B)-[:T]-(a) RETURN COUNT(a)"
    df = spark.createDataFrame([(1, q)], "pair_id BIGINT, q STRING")
    assert {(r["var"], r["label"]) for r in G.pattern_nodes(df, "pair_id", "q").collect()} == {("a", "A"), ("b", "B"), ("_4", "C")}
    edges = {(r["src"], r["dst"], r["type"]) for r in G.pattern_edges(df, "pair_id", "q").collect()}
    # the edge without a direction is read last and replaces a -> b
    assert edges == {("a", "b", "T"), ("b", "a", "T"), ("_4", "b", "S")}


def random_graph(rnd, most):
    n = rnd.randrange(0, most + 1)
    labels = [rnd.choice(["A", "B", None]) for _ in range(n)]
    edges = {}
    for i in range(n):
        for j in range(n):
            if i != j and rnd.random() < 0.35:
                edges[(i, j)] = rnd.choice(["R", "S"])
    return labels, edges


def as_text(graph):
    labels, edges = graph
    node = lambda i: f"(v{i}:{labels[i]})" if labels[i] else f"(v{i})"
    return " ".join([*(f"{node(i)}" for i in range(len(labels))), *(f"{node(i)}-[:{t}]->{node(j)}" for (i, j), t in edges.items())])


def brute(g, p):
    (gl, ge), (pl, pe) = g, p
    best = len(gl) + len(ge) + len(pl) + len(pe)
    targets = list(range(len(pl))) + [None] * len(gl)
    for image in set(permutations(targets, len(gl))):
        cost = sum(1 if m is None else int(gl[i] != pl[m]) for i, m in enumerate(image)) + len(pl) - sum(m is not None for m in image)
        hit = set()
        for (i, j), t in ge.items():
            e = (image[i], image[j])
            if e in pe:
                hit.add(e)
                cost += int(pe[e] != t)
            else:
                cost += 1
        best = min(best, cost + len(pe) - len(hit))
    return best


def test_distance_against_all_placements(spark):
    rnd = random.Random(5)
    graphs = [(random_graph(rnd, 4), random_graph(rnd, 4)) for _ in range(40)]
    df = pairs(spark, [(as_text(g), as_text(p)) for g, p in graphs])
    got = {r["pair_id"]: r["ged"] for r in G.graph_edit_distance(df).collect()}
    assert got == {i: brute(g, p) for i, (g, p) in enumerate(graphs)}
    back = {r["pair_id"]: r["ged"] for r in G.graph_edit_distance(df, gold="pred", pred="gold").collect()}
    assert back == got
    bound = {r["pair_id"]: r["ged_bound"] for r in G.graph_multiset_overlap(df).collect()}
    assert all(bound[i] <= got[i] for i in got)


def test_large_chains_are_exact(spark):
    chain = lambda n, t: "".join(f"(n{i}:L{i % 3})-[:{t}]->" for i in range(n)) + "(z:Z)"
    rows = [(chain(9, "R"), chain(9, "R")), (chain(9, "R"), chain(9, "S")), (chain(9, "R"), chain(7, "R"))]
    got = {r["pair_id"]: r["ged"] for r in G.graph_edit_distance(pairs(spark, rows)).collect()}
    assert got[0] == 0 and got[1] == 9
    assert got[2] == 5  # two nodes and two edges go, and one label differs: L1 under z against Z


def test_pruned_search_equals_all_placements(spark, monkeypatch):
    monkeypatch.setattr(G, "_PRUNE_FROM", 0)
    rnd = random.Random(9)
    graphs = [(random_graph(rnd, 4), random_graph(rnd, 5)) for _ in range(30)]
    got = {r["pair_id"]: r["ged"] for r in G.graph_edit_distance(pairs(spark, [(as_text(g), as_text(p)) for g, p in graphs])).collect()}
    assert got == {i: brute(g, p) for i, (g, p) in enumerate(graphs)}


def test_overlap_of_empty_graphs(spark):
    got = {r["pair_id"]: r["overlap"] for r in G.graph_overlap(pairs(spark, [("", ""), ("(a:A)", ""), ("(a:A)", "(b:A)")])).collect()}
    assert got == {0: 0.0, 1: 0.0, 2: 1.0}


def test_pattern_is_read_by_the_rules_of_its_graph():
    """Missing and empty texts, labels that come later, unnamed nodes, both directions, names and blanks that are not ASCII."""
    read = lambda q: G.pattern_graph(q, {})
    assert read(None) == read("") == ({}, {})
    assert read("(a)-[:T]->(b:B)<-[:U]-(a:A)") == ({"a": "A", "b": "B"}, {("a", "b"): "U"})
    assert read("(a:A)-[]-(:N) (:M) ()") == ({"a": "A", "_2": "N", "_3": "M"}, {("_2", "a"): None, ("a", "_2"): None})
    assert read("(a)-[:T]-(b)-[:U]->(a)") == ({"a": None, "b": None}, {("b", "a"): "T", ("a", "b"): "T"})
    assert read("(\u00e9)-[:T]->(b) (c\u00a0) ( d\n:D {x: 1})") == ({"b": None, "d": "D"}, {})


def test_graphs_are_read_in_batches_not_by_interpreted_lambdas(spark):
    df = spark.createDataFrame([(1, "(a:A)-[:T]->(b)", None)], "pair_id bigint, gold string, pred string")
    plan = G.shape_pairs(G.graph_pairs(df))._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "regexp" not in plan
    assert [tuple(r) for r in G.graph_pairs(df).select("pair_id", "g1", "g2").collect()] == [(1, ([("a", "A"), ("b", None)], [("a", "b", "T")]), ([], []))]
