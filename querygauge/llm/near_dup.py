"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's set holds the 64-bit hashes of its distinct word shingles. Documents with equal sets form a
class (64-bit digest of the set); from there on classes are compared, so copies never pair up.

1. A class keeps the ``K`` smallest hashes of its set: the sketch. Inverted lists of the retained values
   generate candidates: all pairs inside a list of at most ``SHORT`` classes.
2. Longer lists (a passage or word pair many texts share, a large group of near copies) are dealt again by
   runs of three neighbouring retained values and, for small sets, by pairs of values of the prefix that two
   linked sets must share; classes whose values in longer lists are too few for the estimate are left out. What is
   still long then is compared with a few pivots a list. The classes that these did not join to their list's main
   component are told apart by what differs from one set of that component: two of them, or one and any other class,
   that reach the threshold share some of their rarest differences (exact; see ``_by_differences``). So nothing is cut off.
3. The union-sketch estimate filters pairs; the exact Jaccard of the full sets decides every link.
4. Links become connected components. A first round of links (each class with its likeliest partner) joins
   most of them; later rounds only look at pairs whose ends are not yet connected.

Sketches are random in the shingles: two sets at the threshold (0.8) share no candidate list with a
probability of about 1e-5 if all their lists are long, and of 0.2**K otherwise; small sets are found for sure.

Defined results: a null or empty text, or one without words, has an empty set and is linked with nothing.
Rows that repeat (same id and text) get the same result each, and ``without_near_duplicates`` leaves one of them; rows of one id with different texts are
compared by their texts. A null id is reachable like any other but never the smallest, unless all are null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from querygauge.llm.common import LOWER, mixed, slices, text_or_empty, words_of
from querygauge.llm.components import components
from querygauge.session import batches_of, cut_lineage

K = 32
SHORT = 16  # classes of a list that are compared pair by pair
PIVOTS = 6  # classes of a longer list that all others are compared with first
SMALL = 40  # shingles: below, prefix pairs find every link for sure
BATCH = 1000  # texts that Python gets at once
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(column: pa.Array, words: int):
    """Sorted distinct shingle hashes of each text (uint64 arrays), in order."""
    for _, part in slices(column):
        ends, flat = words_of(part, LOWER)
        coded = flat.dictionary_encode()
        each = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
        h = each[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            acc = np.full(max(0, len(h) - words + 1), np.uint64(words))
            for j in range(words):
                acc = acc * _PRIME + h[j : j + len(acc)]
            acc = mixed(acc)
            for a, b in zip(ends[:-1], ends[1:]):
                if b - a >= words:
                    yield np.unique(acc[a : b - words + 1])
                elif b > a:  # the whole sequence as one shingle
                    one = np.array([b - a], np.uint64)
                    for x in h[a:b]:
                        one = one * _PRIME + x
                    yield mixed(one)
                else:
                    yield np.zeros(0, np.uint64)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _sketcher(words: int):
    @F.arrow_udf("n bigint, c bigint, b1 bigint, b2 bigint, s array<bigint>")
    def sketch(column: pa.Array) -> pa.Array:
        n, c, bits, s = [], [], [], []
        for x in shingle_sets(column, words):
            n.append(len(x))
            c.append(xxhash.xxh3_64_intdigest(x.tobytes()))
            s.append(x[:K].copy())
            at = (x[:K] & np.uint64(127)).astype(np.int64)
            one = np.zeros(128, np.uint8)
            one[at] = 1
            bits.append(np.packbits(one).view(np.int64))
        both = np.array(bits, np.int64).reshape(-1, 2)
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(np.array(c, np.uint64).view(np.int64)), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), _lists(s)], names=["n", "c", "b1", "b2", "s"])

    return sketch


def _full(words: int):
    @F.arrow_udf("array<bigint>")
    def full(column: pa.Array) -> pa.Array:
        return _lists(list(shingle_sets(column, words)))

    return full


def _near(percent: int) -> Column:
    """Sizes allow the threshold, and the sketches' 128-bit maps overlap in half of the smaller one at least."""
    bits = lambda r: F.bit_count(f"{r}.b1") + F.bit_count(f"{r}.b2")
    both = F.bit_count(F.col("x.b1").bitwiseAND(F.col("y.b1"))) + F.bit_count(F.col("x.b2").bitwiseAND(F.col("y.b2")))
    sizes = F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent
    return sizes & (both * 2 >= F.least(bits("x"), bits("y")))


def _pairs(x: DataFrame, y: DataFrame, key: str, percent: int, more: Column | None = None) -> DataFrame:
    on = (F.col(f"x.{key}") == F.col(f"y.{key}")) & _near(percent)
    on = on & (F.col("x.c") < F.col("y.c") if more is None else more)
    return x.alias("x").join(y.alias("y"), on).select(F.least("x.c", "y.c").alias("a"), F.greatest("x.c", "y.c").alias("b")).distinct()


def _least_estimate(percent: int) -> float:
    """Four deviations under the threshold."""
    t = percent / 100
    return t - 4 * (t * (1 - t) / K) ** 0.5


def estimated(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, est) whose union-sketch estimate is within four deviations of the threshold."""
    one = sketches.select(F.col("c").alias("a"), F.col("s").alias("sa"))
    two = sketches.select(F.col("c").alias("b"), F.col("s").alias("sb"))
    both = pairs.join(one, "a").join(two, "b")
    # hashes order as unsigned numbers: with the sign bit turned they order as signed ones
    turned = lambda c: F.transform(c, lambda v: v.bitwiseXOR(F.lit(-(2**63))))
    union = F.slice(F.array_sort(F.array_union(turned("sa"), turned("sb"))), 1, K)
    shared = F.array_intersect(union, F.array_intersect(turned("sa"), turned("sb")))
    return both.select("a", "b", (F.size(shared) / F.size(union)).alias("est")).filter(F.col("est") >= _least_estimate(percent))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold."""
    one = sets.select(F.col("c").alias("a"), F.col("full").alias("fa"))
    two = sets.select(F.col("c").alias("b"), F.col("full").alias("fb"))
    shared = F.size(F.array_intersect("fa", "fb"))
    joined = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", shared.alias("i"), (F.size("fa") + F.size("fb") - shared).alias("u"))
    return joined.filter(F.col("i") * 100 >= F.col("u") * percent).select("a", "b").distinct()


def _by_differences(members: DataFrame, pivots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ``members`` (c, g, n, label) that may reach the threshold, one of them outside the main component ``g`` of its list.

    ``pivots`` (g, pivot) has a class of each main component; a list without one has null, and an empty pivot set. With D the
    difference of a set x from the pivot set P, and q = (100 - percent) / (100 + percent), x and y reach the threshold if they
    share ``(|Dx| - q|x| + |Dy| - q|y|) / 2`` elements of Dx and Dy at least. Of a set that does not reach it with P,
    ``|Dx| - q|x|`` is over q|P|, so this number is above 0; if Dx and Dy are sorted alike, rare elements first, one that both
    share stands so far ahead in each of them."""
    of_pivot = pivots.join(sets.select(F.col("c").alias("pivot"), F.col("full").alias("base")), "pivot")
    base = F.coalesce("base", F.array().cast("array<bigint>"))
    apart = F.concat(F.array_except("full", base), F.array_except(base, "full"))
    rows = members.join(sets, "c").join(of_pivot, "g", "left").select("c", "g", "n", "label", "pivot", F.size(base).alias("p"), apart.alias("d"))
    joins = F.size("d") * (100 + percent) <= (F.col("n") + F.col("p")) * (100 - percent)
    outside = F.coalesce(F.col("label") != F.col("g"), F.lit(True))
    # elements of different components are different ones
    rows = cut_lineage(rows.withColumn("d", F.transform("d", lambda v: F.xxhash64("g", v))).withColumn("joins", outside & joins).withColumn("out", outside & ~joins))
    counts = rows.select(F.explode("d").alias("v")).groupBy("v").agg(F.count("*").alias("many")).filter("many > 1")
    held = rows.filter(F.size("d") > 0).select("c", "g", "n", "label", "p", "out", F.size("d").alias("size"), F.explode("d").alias("v")).join(counts, "v", "left")

    q, t = (100 - percent) / (100 + percent), percent / 100
    own = F.col("size") - q * F.col("n")
    others = lambda least: F.greatest(least, t * (1 - q) * F.col("n") - F.col("p"), F.col("p") - (1 + q) / t * F.col("n"))
    ahead = lambda least: F.col("size") + 1 - F.greatest(F.ceil((own + others(least)) / 2 - 1e-6), F.lit(1))
    held = held.groupBy("c", "g", "n", "label", "p", "out", "size").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("many", F.lit(1)).alias("many"), "v"))).alias("l"))
    held = held.select("c", "n", "label", "out", "size", own.alias("own"), ahead(q * F.col("p")).alias("short"), ahead(-q * F.col("p")).alias("long"), F.posexplode("l").alias("pos", "e"))
    held = cut_lineage(held.filter((F.col("e.many") > 1) & (F.col("pos") < F.greatest("short", F.when(F.col("out"), F.col("long"))))).withColumn("v", F.col("e.v")).drop("e"))

    x, y = held.filter(F.col("out") & (F.col("pos") < F.col("long"))), held.filter(F.col("pos") < F.col("short"))
    left = F.least(F.col("x.size") - F.col("x.pos"), F.col("y.size") - F.col("y.pos"))  # this element and those after it
    sizes = F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent
    on = (F.col("x.v") == F.col("y.v")) & (F.col("x.label") != F.col("y.label")) & (~F.col("y.out") | (F.col("x.c") < F.col("y.c")))
    on = on & sizes & (left * 2 >= F.col("x.own") + F.col("y.own") - 1e-6)
    met = x.alias("x").join(y.alias("y"), on).select(F.least("x.c", "y.c").alias("a"), F.greatest("x.c", "y.c").alias("b"))
    return met.union(rows.filter("joins").select(F.least("c", "pivot").alias("a"), F.greatest("c", "pivot").alias("b"))).distinct()


def _long_keys(long: DataFrame, percent: int) -> DataFrame:
    """Postings (key, c, n, b1, b2) of classes by runs of three retained values, and by pairs of a small set's prefix.

    Two sets that reach the threshold share at least two of the first ``n - ceil(percent * n) + 2`` values."""
    own = long.groupBy("c", "n", "b1", "b2").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("l"))
    n = F.size("l")
    # two classes that share no shorter list share no more of their sketches than either has here
    own = own.filter(n / F.least(F.col("n"), F.lit(K)) >= _least_estimate(percent))
    runs = F.filter(
        F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.slice("l", i + 1, 3)),
        lambda r: (F.size(r) == 3) & (F.element_at(r, 3)["pos"] == F.element_at(r, 1)["pos"] + 2),
    )
    run_keys = F.transform(runs, lambda r: F.xxhash64(F.lit(3), F.element_at(r, 1)["v"], F.element_at(r, 2)["v"], F.element_at(r, 3)["v"]))
    prefix = F.filter("l", lambda e: (F.col("n") < SMALL) & (e["pos"] <= F.floor(F.col("n") * (100 - percent) / 100) + 1))
    pair_keys = F.flatten(F.transform(prefix, lambda e: F.transform(F.filter(prefix, lambda f: f["pos"] > e["pos"]), lambda f: F.xxhash64(F.lit(2), e["v"], f["v"]))))
    return own.select(F.explode(F.array_distinct(F.concat(run_keys, pair_keys))).alias("key"), "c", "n", "b1", "b2", F.size("l").alias("rich"))


def _grouped(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """One row for each row of ``docs``: ``id``, ``t`` (hash of the text), ``n`` (shingles), ``label`` of its group (null without words)
    and ``component`` (smallest id in it)."""
    text = text_or_empty(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("t"), _sketcher(words)(text).alias("k"))
    with batches_of(docs.sparkSession, BATCH):
        rows = cut_lineage(rows.select("id", "t", "k.*"))
    classes = cut_lineage(rows.filter("n > 0").groupBy("c").agg(F.min("id").alias("least"), F.min(F.struct(F.col("id").isNull(), "id", "t")).alias("rep"), F.first(F.struct("n", "b1", "b2", "s")).alias("k")).select("c", "least", "rep", "k.*"))

    postings = classes.select(F.posexplode("s").alias("pos", "v"), "c", "n", "b1", "b2")
    sizes = postings.groupBy("v").agg(F.count("*").alias("many")).filter("many > 1")
    postings = cut_lineage(postings.join(sizes, "v"))
    short = postings.filter(F.col("many") <= SHORT)
    keyed = _long_keys(postings.filter(F.col("many") > SHORT), percent)
    keyed = cut_lineage(keyed.join(keyed.groupBy("key").agg(F.count("*").alias("many")).filter("many > 1"), "key"))
    few, crowd = keyed.filter(F.col("many") <= SHORT), keyed.filter(F.col("many") > SHORT)
    order = Window.partitionBy("key").orderBy(F.desc("rich"), "c")
    pivots = crowd.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= PIVOTS)
    found = _pairs(short, short, "v", percent).union(_pairs(few, few, "key", percent)).union(_pairs(crowd, pivots, "key", percent, F.col("x.c") != F.col("y.c")))
    pairs = cut_lineage(estimated(found.distinct(), classes.select("c", "s"), percent))

    def sets_of(ids: DataFrame) -> DataFrame:
        """(c, full): written, as texts are read for them."""
        reps = classes.join(ids, "c", "left_semi").select("c", F.col("rep.id").alias("id"), F.col("rep.t").alias("t"))
        texts = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("t"))
        same = (F.col("d.t") == F.col("r.t")) & F.col("d.id").eqNullSafe(F.col("r.id"))
        with batches_of(docs.sparkSession, BATCH):
            return cut_lineage(texts.alias("d").join(reps.alias("r"), same).select("c", _full(words)(F.col("text")).alias("full")))

    ends = lambda p: p.select(F.col("a").alias("c")).union(p.select(F.col("b").alias("c"))).distinct()
    sets = sets_of(ends(pairs))
    both = pairs.select(F.col("a").alias("c"), "a", "b", "est").union(pairs.select(F.col("b").alias("c"), "a", "b", "est"))
    likeliest = both.groupBy("c").agg(F.max(F.struct("est", "a", "b")).alias("p")).select("p.a", "p.b").distinct()
    labels = components(verified(likeliest, sets, percent))

    def labelled(table: DataFrame, column: str, out: str) -> DataFrame:
        own = labels.select(F.col("node").alias(column), F.col("label").alias(out))
        return table.join(own, column, "left").withColumn(out, F.coalesce(out, column))

    def extended(links: DataFrame) -> DataFrame:
        """Labels once more links are known; the stars found so far stand for all earlier ones."""
        return components(links.union(labels.select("label", "node")))

    apart = labelled(labelled(pairs, "a", "la"), "b", "lb").filter("la <> lb").join(likeliest, ["a", "b"], "left_anti")
    labels = extended(verified(apart, sets, percent))

    # classes of long lists outside their list's main component, if it has more than a few classes there
    own = cut_lineage(labelled(crowd.select("key", "c", "n", "rich"), "c", "label"))
    main = own.groupBy("key", "label").count().groupBy("key").agg(F.max(F.struct("count", "label")).alias("m"), F.count("*").alias("labels"))
    main = main.filter("labels > 1").select("key", F.when(F.col("m.count") > SHORT, F.col("m.label")).alias("g"))
    members = cut_lineage(own.join(main, "key").groupBy("c", "n", "label", "g").agg(F.max("rich").alias("rich")))
    if not members.isEmpty():
        pivots = members.filter("label = g").groupBy("g").agg(F.max(F.struct("rich", "c"))["c"].alias("pivot"))
        sets = sets_of(members.select("c").distinct())
        labels = extended(verified(_by_differences(members.drop("rich"), pivots, sets, percent), sets, percent))

    grouped = labelled(classes.select("c", "least"), "c", "label")
    least = grouped.groupBy("label").agg(F.min("least").alias("component"))
    reached = grouped.join(least, "label").select("c", "label", "component")
    joined = rows.select("id", "t", "n", "c").join(reached, "c", "left")
    return joined.select("id", "t", "n", "label", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of ``docs``: the id, ``n_shingles``, ``component_id`` (smallest id reachable) and ``kept``.

    ``kept`` is by id: rows that share the smallest id of a group all have it. ``without_near_duplicates`` keeps one row."""
    rows = _grouped(docs, id_col, text_col, words, percent)
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs`` for each group: that with the smallest id (null last), then the smallest text hash.

    Texts without words are linked with nothing; of rows equal in id and text one stays, whether they have words or not."""
    name = lambda i, t: F.xxhash64(i.isNull(), i, t)  # noqa: E731  of an id with a text
    rows = _grouped(docs, id_col, text_col, words, percent)
    group = F.coalesce("label", name(F.col("id"), F.col("t")))
    first = rows.groupBy((F.col("n") > 0).alias("some"), group.alias("group")).agg(F.min(F.struct(F.col("id").isNull(), "id", "t")).alias("f"))
    first = first.select(name(F.col("f.id"), F.col("f.t")).alias("k"), F.col("f.t").alias("t"))
    t = F.xxhash64(text_or_empty(F.col(text_col)))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    others = F.xxhash64(F.struct(F.lit(0), *[F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)]).cast("string"))
    # equal rows are reduced ahead of the shuffle, so that one that repeats often is no hot key
    one = docs.select(row.alias("row"), name(F.col(id_col), t).alias("k"), t.alias("t"), others.alias("o")).groupBy("k", "t").agg(F.min_by("row", "o").alias("row"))
    return one.join(first, ["k", "t"], "left_semi").select("row.*")
