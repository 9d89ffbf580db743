"""Repeatable hash order without a global window.

Rows are ordered by ``md5(seed|key), key``; keys are unique.  Only counts per hash bucket (at most
16**digits rows) are gathered; a cut at a global position is found by ranking the one bucket the
position falls in, and is then applied as a comparison with two literals, so the full rows are never
shuffled for a split or a sample.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from querygauge.session import cut_lineage

DIGITS = 3  # 4,096 buckets
SORTED_ROWS = 2_000_000  # rows of one bucket that a single task sorts


def seeded_hash(key: Column, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def _bucket(h: Column, digits: int) -> Column:
    return F.substring(h, 1, digits)


def _offsets(hashed: DataFrame, by: list[str]) -> DataFrame:
    """Rows ahead of each bucket; the window runs over bucket counts, never over rows."""
    counts = hashed.groupBy(*by, "_b").count()
    w = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.select(*by, "_b", F.col("count").alias("_n"), (F.sum("count").over(w) - F.col("count")).alias("_ahead"))


def bucket_rank(df: DataFrame, key: str, seed: int = 42, by: list[str] | None = None, digits: int = DIGITS) -> DataFrame:
    """Append ``rank``: the 1-based position of each row in hash order, per ``by`` group if given."""
    by = by or []
    hashed = df.withColumn("_h", seeded_hash(F.col(key), seed)).withColumn("_b", _bucket(F.col("_h"), digits))
    offsets = _offsets(hashed, by).select(*by, "_b", "_ahead")
    if not by:
        offsets = F.broadcast(offsets)  # at most 16**digits rows
    within = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", key))
    ranked = hashed.withColumn("_r", within)
    return ranked.join(offsets, [*by, "_b"]).withColumn("rank", F.col("_ahead") + F.col("_r")).drop("_h", "_b", "_r", "_ahead")


def _hashed(df: DataFrame, key: str, by: list[str], seed: int, digits: int) -> DataFrame:
    """Only the group, the key and its hash: what a search for cuts has to read."""
    h = df.select(*by, F.col(key).alias("_k"), seeded_hash(F.col(key), seed).alias("_h"))
    return h.withColumn("_b", _bucket(F.col("_h"), digits))


def _bucket_sizes(hashed: DataFrame) -> list[tuple[str, int, int]]:
    """(bucket, rows ahead, rows) in order; at most 16**digits entries."""
    out, ahead = [], 0
    for row in sorted(hashed.groupBy("_b").count().collect()):
        out.append((row["_b"], ahead, row["count"]))
        ahead += row["count"]
    return out


def upto(key: str, cut: tuple[str, object] | None, seed: int = 42) -> Column:
    """Rows standing at or before a cut; before everything (no cut) there are none."""
    if cut is None:
        return F.lit(False)
    h, k = seeded_hash(F.col(key), seed), F.col(key)
    return (h < cut[0]) | ((h == cut[0]) & (k <= F.lit(cut[1])))


def find_cuts(df: DataFrame, key: str, positions: dict[str, object], seed: int = 42, digits: int = DIGITS) -> dict[str, tuple[str, object] | None]:
    """(hash, key) standing at each named 1-based position; None for positions before the first row.

    ``positions`` maps names to functions of the row count; a position past the end means the last row.
    Small jobs: counts per bucket (again by longer prefixes where a bucket is large), then one sort inside
    the buckets that hold a cut.
    """
    hashed = _hashed(df, key, [], seed, digits)
    sizes = _bucket_sizes(hashed)
    n = sum(size for _, _, size in sizes)
    wanted = {name: min(int(position(n)), n) for name, position in positions.items()}
    places = {name: spot for name, at in wanted.items() if (spot := _spot(sizes, at))}
    while any(size > SORTED_ROWS for _, _, size in places.values()) and digits < 30:
        # a bucket too large for one sort is counted again by longer prefixes, inside the wanted buckets only
        inside, digits = hashed.filter(F.col("_b").isin(sorted({b for b, _, _ in places.values()}))), digits + DIGITS
        hashed = inside.withColumn("_b", _bucket(F.col("_h"), digits))
        finer = _bucket_sizes(hashed)
        places = {name: _spot([x for x in finer if x[0].startswith(b)], at) for name, (b, at, _) in places.items()}
    if not places:
        return {name: None for name in positions}
    inside = hashed.filter(F.col("_b").isin(sorted({b for b, _, _ in places.values()})))
    ranked = inside.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_h", "_k")))
    tests = [(F.col("_b") == b) & (F.col("_r") == r) for b, r in {(b, r) for b, r, _ in places.values()}]
    rows = ranked.filter(reduce(or_, tests)).collect()  # one row per cut
    found = {(row["_b"], row["_r"]): (row["_h"], row["_k"]) for row in rows}
    return {name: found[places[name][:2]] if name in places else None for name in positions}


def _spot(sizes: list[tuple[str, int, int]], at: int) -> tuple[str, int, int] | None:
    """(bucket, position inside it, its size) of a position counted from the first of the given buckets."""
    start = sizes[0][1] if sizes else 0
    for bucket, ahead, size in sizes:
        if ahead - start < at <= ahead - start + size:
            return bucket, at - (ahead - start), size
    return None


def take_hashed(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The first ``n`` rows in hash order as a filter: no sort and no shuffle of the rows themselves."""
    return df.filter(upto(key, find_cuts(df, key, {"end": lambda _: n}, seed)["end"], seed))


def keys_at(df: DataFrame, key: str, draws: DataFrame, seed: int = 42, digits: int = DIGITS) -> DataFrame:
    """``draws`` with the key standing at each row's ``draw`` (any number, taken modulo the row count)."""
    hashed = _hashed(df, key, [], seed, digits)
    sizes = _bucket_sizes(hashed)
    if not sizes:
        return draws.limit(0).withColumn(key, F.lit(None))
    n = sum(size for _, _, size in sizes)
    # one folded literal each, however many buckets
    ahead = F.split(F.lit(",".join(str(a) for _, a, _ in sizes)), ",").cast("array<bigint>")
    names = F.split(F.lit(",".join(b for b, _, _ in sizes)), ",")
    position = F.pmod(F.col("draw"), F.lit(n))  # rows ahead of the wanted one
    spots = draws.withColumn("_p", position).withColumn("_i", F.size(F.filter(ahead, lambda x: x <= F.col("_p"))))
    spots = spots.select("*", F.element_at(names, F.col("_i")).alias("_b"), (F.col("_p") - F.element_at(ahead, F.col("_i")) + 1).alias("_r")).drop("_p", "_i")
    # rows of drawn buckets only, counted again by longer prefixes: what is sorted stays small in a bucket of any size
    wanted = F.broadcast(spots.select("_b").distinct())  # at most 16**digits names
    inside = hashed.join(wanted, "_b", "left_semi").withColumn("_f", _bucket(F.col("_h"), digits + DIGITS))
    counts = inside.groupBy("_b", "_f").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("_b").orderBy("_f").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    finer = counts.withColumn("_upto", F.sum("_n").over(w)).withColumn("_before", F.col("_upto") - F.col("_n"))
    holds = spots.join(finer, "_b").filter((F.col("_before") < F.col("_r")) & (F.col("_r") <= F.col("_upto")))
    placed = holds.withColumn("_r", F.col("_r") - F.col("_before")).drop("_b", "_n", "_upto", "_before")
    rows = inside.select("_f", "_h", "_k").join(placed.select("_f").distinct(), "_f", "left_semi")
    rank = F.row_number().over(Window.partitionBy("_f").orderBy("_h", "_k")).cast("bigint")
    ranked = rows.select("_f", "_k", rank.alias("_r"))
    return placed.join(ranked, ["_f", "_r"]).drop("_f", "_r").withColumnRenamed("_k", key)


def smallest_class_cuts(df: DataFrame, cls: str, key: str, within: list[str], seed: int = 42, digits: int = DIGITS) -> DataFrame:
    """(_c0…, _c, _ch, _ck): where each class reaches the size of the smallest one, inside each ``within`` group.

    Kept as a written table of one row per class, so later steps do not repeat the search.
    """
    by = [*within, cls]
    hashed = _hashed(df, key, by, seed, digits)
    counts = cut_lineage(hashed.groupBy(*by, "_b").count())
    sizes = counts.groupBy(*by).agg(F.sum("count").alias("_n"))
    least = sizes.groupBy(*within).agg(F.min("_n").alias("_least"))
    w = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = counts.withColumn("_upto", F.sum("count").over(w)).withColumn("_ahead", F.col("_upto") - F.col("count"))
    same = lambda names, left, right: [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in names]
    sized = ahead.alias("a").join(least.alias("l"), same(within, "a", "l")) if within else ahead.alias("a").withColumn("_least", least.scalar())
    holds = sized.filter((F.col("_ahead") < F.col("_least")) & (F.col("_least") <= F.col("_upto")))
    spots = holds.select(*[F.col(f"a.{c}") for c in by], F.col("a._b").alias("_b"), (F.col("_least") - F.col("_ahead")).alias("_at"))
    inside = hashed.alias("h").join(spots.alias("s"), same([*by, "_b"], "h", "s"))
    rows = inside.select(*[F.col(f"h.{c}").alias(f"_c{i}") for i, c in enumerate(by)], F.col("h._h").alias("_ch"), F.col("h._k").alias("_ck"), F.col("s._at").alias("_at"))
    rank = F.row_number().over(Window.partitionBy(*[f"_c{i}" for i, _ in enumerate(by)]).orderBy("_ch", "_ck"))
    return cut_lineage(rows.withColumn("_r", rank).filter(F.col("_r") == F.col("_at")).drop("_r", "_at"))
