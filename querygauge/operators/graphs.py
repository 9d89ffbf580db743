"""Pattern graphs read from Cypher texts, and their exact edit distance as a Spark job."""

from __future__ import annotations

import re
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from querygauge.operators.clauses import sql_f1
from querygauge.operators.placement import spread
from querygauge.session import cut_lineage

_TOKEN = re.compile(r"\([^()]*\)|<?-\[[^\]]*\]->?")
_NODE = re.compile(r"^\(\s*(\w*)\s*(?::\s*(\w+))?\s*(?:\{[^}]*\})?\s*\)$", re.ASCII)
_EDGE = re.compile(r"\[\s*\w*\s*(?::\s*(\w+))?", re.ASCII)
_PRUNE_FROM = 6  # levels; below it a search is too small to be worth the extra step
_SHAPE = ", ".join(f"{g} STRUCT<labels: ARRAY<STRING>, edges: ARRAY<STRUCT<i: INT, j: INT, type: STRING>>>" for g in "ab")
_LISTS = {"nodes": ("var", "label"), "edges": ("src", "dst", "type")}
_GRAPH = StructType([StructField(name, ArrayType(StructType([StructField(c, StringType()) for c in columns]))) for name, columns in _LISTS.items()])


def _read(token: str) -> tuple[bool, bool, str, str | None, str | None, int]:
    """(edge, well-formed node, name, label, type, direction) of a token."""
    node, edge = _NODE.search(token), _EDGE.search(token)
    left, right = token.startswith("<"), token.endswith(">")
    return not token.startswith("("), bool(node), node[1] if node else "", node[2] if node else None, edge[1] if edge else None, right - left


def pattern_graph(query: str | None, read: dict[str, tuple]) -> tuple[dict[str, str | None], dict[tuple[str, str], str | None]]:
    """Labels by variable and types by (source, destination), each in order; ``read`` holds what tokens say."""
    tokens = _TOKEN.findall(query or "")
    for t in tokens:
        if t not in read:
            read[t] = _read(t)
    names: list[str | None] = []  # variable of each token that is a node
    labels: dict[str, str | None] = {}
    for i, t in enumerate(tokens):
        edge, formed, name, label, _, _ = read[t]
        known = not edge and formed and (name or label or "-[" in "".join(tokens[max(i - 1, 0) : i]) or "-[" in "".join(tokens[i + 1 : i + 2]))
        names.append((name or f"_{i}") if known else None)
        if known and (label or names[i] not in labels):
            labels[names[i]] = label
    ends = []
    for i, t in enumerate(tokens[1:-1], 1):
        edge, _, _, _, kind, direction = read[t]
        a, b = names[i - 1], names[i + 1]
        if edge and a is not None and b is not None:
            if direction:
                ends.append((0, i, a, b, kind) if direction > 0 else (0, i, b, a, kind))
            else:
                ends += [(1, i, a, b, kind), (1, i, b, a, kind)]
    types: dict[tuple[str, str], str | None] = {}
    for _, _, a, b, kind in sorted(ends, key=lambda e: e[:4]):
        types[a, b] = kind
    return labels, types


@F.arrow_udf(_GRAPH)
def _pattern_graphs(queries: pa.Array) -> pa.Array:
    read: dict[str, tuple] = {}
    graphs = [pattern_graph(q, read) for q in queries.to_pylist()]

    def lists(name: str, rows: list[list[tuple]]) -> pa.ListArray:
        ends = pa.array(list(accumulate(map(len, rows), initial=0)), pa.int32())
        columns = [pa.array([x[i] for row in rows for x in row], pa.string()) for i in range(len(_LISTS[name]))]
        return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(columns, names=list(_LISTS[name])))

    nodes = lists("nodes", [list(labels.items()) for labels, _ in graphs])
    edges = lists("edges", [[(*ends, kind) for ends, kind in types.items()] for _, types in graphs])
    return pa.StructArray.from_arrays([nodes, edges], names=list(_LISTS))


def with_pattern_graph(df: DataFrame, query: str, out: str) -> DataFrame:
    """Append ``out`` = struct(nodes (var, label), edges (src, dst, type)), built inside the row.

    The last label of a variable wins; the last edge between two nodes wins, edges without a direction
    (read both ways) being read after the others.  Unnamed nodes of a hop are named by their position.
    """
    return df.withColumn(out, _pattern_graphs(F.col(query)))


def pattern_nodes(df: DataFrame, key: str, query: str) -> DataFrame:
    graph = with_pattern_graph(spread(df.select(key, query), key), query, "_g")
    rows = graph.select(key, F.explode_outer("_g.nodes").alias("n")).filter(F.col("n").isNotNull())
    return rows.select(key, "n.var", "n.label")


def pattern_edges(df: DataFrame, key: str, query: str) -> DataFrame:
    graph = with_pattern_graph(spread(df.select(key, query), key), query, "_g")
    rows = graph.select(key, F.explode_outer("_g.edges").alias("e")).filter(F.col("e").isNotNull())
    return rows.select(key, "e.src", "e.dst", "e.type")


def _indexed(graph: Column) -> Column:
    """Graph without variable names: labels in order, edges by node index, so equal shapes are equal."""
    place = lambda v: F.array_position(F.transform(graph["nodes"], lambda n: n["var"]), v).cast("int") - 1
    return F.struct(
        F.transform(graph["nodes"], lambda n: n["label"]).alias("labels"),
        F.array_sort(F.transform(graph["edges"], lambda e: F.struct(place(e["src"]).alias("i"), place(e["dst"]).alias("j"), e["type"].alias("type")))).alias("edges"),
    )


def graph_pairs(pairs: DataFrame, key: str = "pair_id", gold: str = "gold", pred: str = "pred") -> DataFrame:
    """(key, g1, g2): both graphs of a pair."""
    df = with_pattern_graph(with_pattern_graph(spread(pairs.select(key, gold, pred), key), gold, "g1"), pred, "g2")
    return df.select(key, "g1", "g2")


def shape_pairs(graphs: DataFrame, key: str = "pair_id") -> DataFrame:
    """(key, shape): the two graphs without variable names, as one JSON text.

    Pairs with equal shapes have equal distances, and a corpus has far fewer shapes than pairs.
    """
    pair = F.struct(_indexed(F.col("g1")).alias("a"), _indexed(F.col("g2")).alias("b"))
    return graphs.select(key, F.to_json(pair).alias("shape"))


def shape_distances(shapes: DataFrame, cut_every: int = 4) -> DataFrame:
    """(shape, size1, size2, ged): exact edit distance of every distinct pair of shapes.

    Deleting one graph and inserting the other costs its total size; each matched node or edge saves 2
    (1 if the label or type differs).  The most that can be saved is found by placing one node per
    level.  After a level, two partial placements with the same used nodes and the same images of the
    nodes that still have open edges have the same future, so a group-by keeps the better one; long
    searches also drop placements that provably cannot win.  The result is exact at any size.
    """
    parsed = shapes.select("shape").distinct().withColumn("x", F.from_json("shape", _SHAPE))
    # the smaller graph is placed node by node: fewer levels; costs are the same both ways
    swap = F.size("x.a.labels") > F.size("x.b.labels")
    state = parsed.select(
        "shape",
        F.when(swap, F.col("x.b")).otherwise(F.col("x.a")).alias("a"),
        F.when(swap, F.col("x.a")).otherwise(F.col("x.b")).alias("b"),
        F.array().cast("array<int>").alias("used"), F.array().cast("array<int>").alias("img"), F.lit(0).alias("saved"),
    )
    state = cut_lineage(state)
    levels = state.agg(F.max(F.size("a.labels"))).first()[0] or 0  # one number
    for k in range(levels):
        state = _place(state, k)
        if levels > _PRUNE_FROM:
            state = _promising(state, k)
        if (k + 1) % cut_every == 0 and k + 1 < levels:
            state = cut_lineage(state)
    size = lambda g: F.size(f"{g}.labels") + F.size(f"{g}.edges")
    best = state.groupBy("shape").agg(F.max("saved").alias("saved"))
    sized = best.withColumn("x", F.from_json("shape", _SHAPE)).select("shape", size("x.a").alias("size1"), size("x.b").alias("size2"), "saved")
    return sized.select("shape", "size1", "size2", (F.col("size1") + F.col("size2") - F.col("saved")).alias("ged"))


def _promising(state: DataFrame, k: int) -> DataFrame:
    """Drop placements that cannot reach what another already saves; the best one always stays.

    Any placement can be finished by matching nothing more, so the most saved so far is reachable; what a
    placement may still gain is at most 2 per node and per edge left.
    """
    nodes = F.least(F.greatest(F.size("a.labels") - (k + 1), F.lit(0)), F.size("b.labels") - F.size("used"))
    edges = F.size(F.filter("a.edges", lambda e: F.greatest(e["i"], e["j"]) > k))
    reach = F.col("saved") + 2 * (nodes + F.least(edges, F.size("b.edges")))
    best = state.groupBy("shape").agg(F.max("saved").alias("best"))
    return state.join(best, "shape").filter(reach >= F.col("best")).drop("best")


def _place(state: DataFrame, k: int) -> DataFrame:
    """Place node ``k`` of graph a on every free node of b, or on none (-1)."""
    size = F.size("a.labels")
    free = F.array_except(F.sequence(F.lit(-1), F.size("b.labels") - 1), F.col("used"))
    options = F.when(size > k, free).otherwise(F.array(F.lit(-1)))
    rows = state.withColumn("p", F.explode_outer(options))
    p = F.col("p")
    node_gain = F.when(F.get(F.col("a.labels"), F.lit(k)).eqNullSafe(F.get(F.col("b.labels"), p)), 2).otherwise(1)
    image = lambda n: F.when(n == k, p).otherwise(F.get(F.col("img"), n))
    closing = F.filter("a.edges", lambda e: F.greatest(e["i"], e["j"]) == k)
    same_place = lambda e, f: (f["i"] == image(e["i"])) & (f["j"] == image(e["j"]))
    # an edge that has a counterpart saves 1, and 1 more if the types agree
    edge_gain = F.aggregate(
        closing, F.lit(0),
        lambda acc, e: acc
        + F.size(F.filter("b.edges", lambda f: same_place(e, f)))
        + F.size(F.filter("b.edges", lambda f: same_place(e, f) & f["type"].eqNullSafe(e["type"]))),
    )
    gain = F.when(p < 0, 0).otherwise(node_gain + edge_gain)
    open_edge = lambda n: F.exists("a.edges", lambda e: (F.least(e["i"], e["j"]) == n) & (F.greatest(e["i"], e["j"]) > k))
    images = F.transform(F.concat("img", F.array(p)), lambda m, n: F.when(open_edge(n), m).otherwise(-1))
    # new names: inside a lambda a name would be taken from the same select before the input
    moved = rows.select(
        "shape", "a", "b",
        F.when(p < 0, F.col("used")).otherwise(F.array_sort(F.concat("used", F.array(p)))).alias("_used"),
        images.alias("_img"), (F.col("saved") + gain).alias("_saved"),
    )
    best = moved.groupBy("shape", "_used", "_img").agg(F.max("_saved").alias("saved"), F.any_value(F.struct("a", "b")).alias("x"))
    return best.select("shape", "x.a", "x.b", F.col("_used").alias("used"), F.col("_img").alias("img"), "saved")


def graph_edit_distance(pairs: DataFrame, key: str = "pair_id", gold: str = "gold", pred: str = "pred") -> DataFrame:
    """(key, size1, size2, ged); each distinct pair of shapes is solved once and joined back."""
    shapes = cut_lineage(shape_pairs(graph_pairs(pairs, key, gold, pred), key))  # read twice below
    return shapes.join(shape_distances(shapes), "shape").select(key, "size1", "size2", "ged")


def graph_overlap(pairs: DataFrame, key: str = "pair_id", gold: str = "gold", pred: str = "pred") -> DataFrame:
    """(key, overlap) = 1 - distance / larger size; 0 when both graphs are empty."""
    largest = F.greatest("size1", "size2")
    value = F.when(largest == 0, F.lit(0.0)).otherwise(1 - F.col("ged") / F.nullif(largest, F.lit(0)))
    return graph_edit_distance(pairs, key, gold, pred).select(key, value.alias("overlap"))


def _shared(a: Column, b: Column) -> Column:
    """Size of a multiset intersection of two arrays; a missing value matches a missing value."""
    count = lambda arr, v: F.size(F.filter(arr, lambda x: x.eqNullSafe(v)))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda acc, v: acc + F.least(count(a, v), count(b, v)))


def graph_multiset_overlap(pairs: DataFrame, key: str = "pair_id", gold: str = "gold", pred: str = "pred") -> DataFrame:
    """(key, label_overlap, type_overlap, ged_bound): shared labels and types, and the lower bound they give."""
    g = graph_pairs(pairs, key, gold, pred)
    labels = [F.transform(f"{x}.nodes", lambda n: n["label"]) for x in ("g1", "g2")]
    types = [F.transform(f"{x}.edges", lambda e: e["type"]) for x in ("g1", "g2")]
    sized = g.select(
        key, _shared(*labels).alias("label_overlap"), _shared(*types).alias("type_overlap"),
        F.greatest(F.size("g1.nodes"), F.size("g2.nodes")).alias("_n"), F.greatest(F.size("g1.edges"), F.size("g2.edges")).alias("_e"),
    )
    bound = F.col("_n") - F.col("label_overlap") + F.col("_e") - F.col("type_overlap")
    return sized.select(key, "label_overlap", "type_overlap", bound.alias("ged_bound"))


def component_or_graph(pairs: DataFrame, key: str = "pair_id", gold: str = "gold", pred: str = "pred", query_type: str = "query_type") -> DataFrame:
    """(key, component_or_graph): clause F1 for SQL rows, graph overlap for Cypher rows."""
    sql = sql_f1(pairs.filter(F.col(query_type) == "sql"), key, gold, pred).withColumnRenamed("component", "component_or_graph")
    graph = graph_overlap(pairs.filter(F.col(query_type) != "sql"), key, gold, pred).withColumnRenamed("overlap", "component_or_graph")
    return sql.unionByName(graph)
