"""Approximate nearest neighbours by robust-pruned directed graphs (one for each shard).

Equal vectors form a class, of which the ``k + 1`` smallest ids are kept with it; classes are dealt to shards of about ``SHARD``
vectors by hash. A shard's graph is built by inserting vectors in growing batches: a greedy beam search from the
medoid proposes neighbours, relaxed pruning keeps a diverse set (a candidate goes if a kept neighbour is ``ALPHA``
times nearer to it than the vector itself), and reverse edges are added and pruned again. Graphs are written to
the shared folder; queries come in blocks, and each block is searched in each shard by beam search. Cosines of what
is found are computed in double precision on the original vectors.

Defined results: rows without an id or vector, and vectors that are zero or hold a null or non-finite component, take no part. Vectors only
meet those of the same length. A repeated row (same id and vector) counts once. An empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from querygauge.session import cut_lineage

SHARD = 2048
DEGREE, BEAM, ALPHA = 24, 64, 1.2
BATCH = 128
QUERY_BLOCK = 2048


def prune(x: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Neighbours (rows of ids, -1 where there are fewer) kept for each node out of its candidates."""
    c = np.sort(candidates, axis=1)
    c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
    c[c == nodes[:, None]] = -1
    v = x[c]
    far = 2 - 2 * np.einsum("bcd,bd->bc", v, x[nodes])
    far[c < 0] = np.inf
    between = 2 - 2 * np.matmul(v, v.transpose(0, 2, 1))
    out, rows = np.full((len(nodes), degree), -1), np.arange(len(nodes))
    left = far.copy()
    for k in range(degree):
        best = left.argmin(axis=1)
        some = np.isfinite(left[rows, best])
        if not some.any():
            break
        out[some, k] = c[rows, best][some]
        left[(alpha * alpha) * between[rows, best] <= far] = np.inf
        left[rows, best] = np.inf
    return out


def beam_search(x: np.ndarray, edges: np.ndarray, start: int, queries: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(beam, visited): ids nearest to each query, nearest first, and all ids whose edges were followed (-1 pads)."""
    n, rows = len(queries), np.arange(len(queries))
    ids, far, done = np.full((n, beam), -1), np.full((n, beam), np.inf), np.ones((n, beam), bool)
    ids[:, 0], far[:, 0], done[:, 0] = start, 2 - 2 * queries @ x[start], False
    visited = []
    while not done.all():
        open_far = np.where(done, np.inf, far)
        at = open_far.argmin(axis=1)
        going = np.isfinite(open_far[rows, at])
        node = np.where(going, ids[rows, at], -1)
        done[rows[going], at[going]] = True
        visited.append(node)
        new = np.where(node[:, None] >= 0, edges[node], -1)
        seen = (new[:, :, None] == ids[:, None, :]).any(axis=2)
        d = 2 - 2 * np.einsum("brd,bd->br", x[new], queries)
        d[(new < 0) | seen] = np.inf
        ids, far, done = np.concatenate([ids, new], 1), np.concatenate([far, d], 1), np.concatenate([done, ~np.isfinite(d)], 1)
        order = np.argpartition(far, beam - 1, axis=1)[:, :beam]
        ids, far, done = (np.take_along_axis(m, order, 1) for m in (ids, far, done))
        done |= ~np.isfinite(far)
    order = np.argsort(far, axis=1, kind="stable")
    ids = np.where(np.isfinite(far), ids, -1)
    return np.take_along_axis(ids, order, 1), np.stack(visited, 1)


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """(edges, medoid) of unit vectors; the same for the same rows."""
    n = len(x)
    medoid = int((x @ x.mean(axis=0)).argmax())
    edges, count = np.full((n, degree), -1), np.zeros(n, np.int64)
    order = np.random.default_rng(0).permutation(n)
    order = np.concatenate([[medoid], order[order != medoid]])
    at = 1
    while at < n:
        batch = order[at : at + min(BATCH, at)]
        found, visited = beam_search(x, edges, medoid, x[batch], beam)
        kept = prune(x, batch, np.concatenate([found, visited], 1), degree, alpha)
        edges[batch], count[batch] = kept, (kept >= 0).sum(axis=1)
        back: dict[int, list[int]] = {}
        for node, row in zip(batch.tolist(), kept.tolist()):
            for other in row:
                if other >= 0:
                    back.setdefault(other, []).append(node)
        full = []
        for other, more in back.items():
            own = set(edges[other, : count[other]].tolist())
            more = [m for m in more if m not in own]
            if count[other] + len(more) <= degree:
                edges[other, count[other] : count[other] + len(more)] = more
                count[other] += len(more)
            elif more:
                full.append((other, [*own, *more]))
        for k in range(0, len(full), BATCH):
            some = full[k : k + BATCH]
            width = max(len(m) for _, m in some)
            wanted = np.full((len(some), width), -1)
            for r, (_, m) in enumerate(some):
                wanted[r, : len(m)] = m
            nodes = np.array([o for o, _ in some])
            kept = prune(x, nodes, wanted, degree, alpha)
            edges[nodes], count[nodes] = kept, (kept >= 0).sum(axis=1)
        at += len(batch)
    return edges, medoid


def _unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # no overflow in the squares
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def _graph(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("c", ignore_index=True)
    edges, medoid = build(_unit(np.stack(pdf["v"].to_numpy())))
    return pdf.assign(edges=list(edges.astype(np.int32)), start=np.arange(len(pdf)) == medoid)


def valid(vector: Column) -> Column:
    big = F.lit(float("inf"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)
    return vector.isNotNull() & F.forall(vector, fine) & F.exists(vector, lambda x: x != 0)


def index(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, shard_rows: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(graph, members): (shard, c, v, edges, start) and (c, id) with the ``k + 1`` smallest ids of each class."""
    vector = F.col(vec_col)
    own = rows.filter(F.col(id_col).isNotNull() & F.coalesce(valid(vector), F.lit(False))).select(F.col(id_col).cast("bigint").alias("id"), vector.cast("array<double>").alias("v")).distinct()
    ranked = own.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("r") <= k + 1)
    known = ranked.withColumn("c", F.min("id").over(Window.partitionBy("v")))  # at most k + 1 rows a window
    known = cut_lineage(known.withColumn("c", F.xxhash64("v", "c")))  # ids may repeat with other vectors
    firsts = known.filter("r = 1")
    shards = max(1, -(-firsts.count() // shard_rows))
    dealt = firsts.select(F.concat_ws("-", F.size("v"), F.pmod(F.xxhash64("c"), F.lit(shards))).alias("shard"), "c", "v")
    graph = dealt.groupBy("shard").applyInPandas(_graph, "shard string, c bigint, v array<double>, edges array<int>, start boolean")
    return cut_lineage(graph), known.select("c", "id")


def search(graph: DataFrame, members: DataFrame, queries: DataFrame, k: int = 5, beam: int = BEAM, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query (query_id, v) but its own id."""
    asked = queries.filter(F.coalesce(valid(F.col("v")), F.lit(False))).withColumn("q", F.xxhash64("v")).distinct()
    vectors = cut_lineage(asked.select("q", "v").distinct())
    blocks = max(1, -(-vectors.count() // block))
    shards = graph.select("shard").distinct()
    sized = shards.select("shard", F.substring_index("shard", "-", 1).cast("int").alias("dim"))
    # the stated query set meets every shard, in blocks
    of_dim = vectors.select("q", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("q"), F.lit(blocks)).alias("block"))
    left = of_dim.join(sized, "dim").select("shard", "block", "q", "v")
    right = graph.select(F.col("shard").alias("of_shard"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("of_block"), "c", "v", "edges", "start")
    want = k + 1

    def run(asking: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(asking) or not len(own):
            return pd.DataFrame({"q": [], "c": [], "score": []}).astype({"q": "int64", "c": "int64"})
        own = own.sort_values("c", ignore_index=True)
        raw, asked_raw = np.stack(own["v"].to_numpy()), np.stack(asking["v"].to_numpy())
        x, edges, start = _unit(raw), np.stack(own["edges"].to_numpy()).astype(np.int64), int(np.flatnonzero(own["start"].to_numpy())[0])
        norms, out = np.sqrt((raw * raw).sum(axis=1)), []
        names = own["c"].to_numpy()
        for at in range(0, len(asking), 256):
            q = asked_raw[at : at + 256]
            found, _ = beam_search(x, edges, start, _unit(q), beam)
            cos = np.einsum("bkd,bd->bk", raw[found], q) / (norms[found] * np.sqrt((q * q).sum(axis=1))[:, None])
            cos[found < 0] = -np.inf
            best = np.argsort(-cos, axis=1, kind="stable")[:, : 2 * want]
            for r, row in enumerate(best):
                row = row[np.isfinite(cos[r, row])]
                out.append(pd.DataFrame({"q": asking["q"].iloc[at + r], "c": names[found[r, row]], "score": cos[r, row]}))
        return pd.concat(out, ignore_index=True)

    found = left.groupBy("shard", "block").cogroup(right.groupBy("of_shard", "of_block")).applyInPandas(run, "q bigint, c bigint, score double")
    near = found.join(members, "c")
    top = near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).filter(F.col("r") <= k + 1).drop("r")
    pairs = asked.select("query_id", "q").distinct().join(top, "q").filter("id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
