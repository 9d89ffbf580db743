"""Mixing sources to target weights, with DataFrame operations only.

Each source is a stream of its documents' words, in an order given by hashes of the ids. The stream is packed
into blocks of ``block`` words (the last one may be shorter). A source gets as many block slots as its
target needs: whole passes over all of its blocks, then a part of a pass whose last block is cut to fit. The
slots are dealt to output shards by multinomial draws (hashes of seed, source and draw), so every shard has
a random count of each source; slot ``i`` of a pass is mapped to a block by a pseudorandom permutation of the
source's block numbers (multiplication by a prime, plus an offset, modulo the number of blocks), and blocks
are joined to their documents by number.

Defined results: a null text has no words; a document without words is taken 0 times; a null source is a source of its own and
the last; a repeated row is one more document with words of its own; an empty table gives an empty result. Everything is
a function of the rows and the seed, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from querygauge.llm.common import text_or_empty
from querygauge.session import cut_lineage

WEIGHTS = (5, 2, 1)
BLOCK = 512
SHARD_SLOTS = 256  # mean number of blocks in an output shard
#: Fixed primes, all larger than any number of blocks: a multiplier is coprime to every block count.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549, 2147483543, 2147483497)
BUCKETS = 1024  # parts of a source that are numbered side by side


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``."""
    return F.regexp_count(text_or_empty(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, at_most: float = 3.0) -> DataFrame:
    """(source, source_size, target, place) from (source, size): shares by weight, none above ``at_most`` times its size.

    The excess goes to the others by weight until none is above: with sources in order of size per weight, those
    below the common level are full. One row per source; only these rows are ordered in one place."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").cast("binary").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    known = sizes.withColumn("place", place).withColumn("w", weight).withColumn("cap", F.col("source_size") * at_most)
    order = Window.orderBy((F.col("cap") / F.col("w")), "place")
    upto, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = F.coalesce(F.sum("cap").over(upto), F.lit(0.0))
    left = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(upto), F.lit(0.0))
    level = (F.sum("source_size").over(whole) - full) / left  # level if all before this row are full
    leveled = known.withColumn("level", level)
    first_below = F.min(F.when(F.col("cap") >= F.col("level") * F.col("w"), F.struct(F.col("cap") / F.col("w"), F.col("place"), F.col("level")))).over(Window.partitionBy())
    final = leveled.withColumn("common", first_below["level"])
    return final.select("source", "source_size", F.when(F.col("common").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("common") * F.col("w"))).alias("target"), "place")


def _placed(sized: DataFrame) -> DataFrame:
    """Append ``start``: the words of its source ahead of each row. No window holds more than a bucket of a source."""
    hashed = sized.withColumn("b", F.pmod(F.xxhash64(F.col("id"), F.lit(7)), F.lit(BUCKETS)))
    inside = Window.partitionBy("place", "b").orderBy("id", "size", "h").rowsBetween(Window.unboundedPreceding, -1)
    buckets = hashed.groupBy("place", "b").agg(F.sum("size").alias("n"))
    ahead = buckets.select("place", "b", F.coalesce(F.sum("n").over(Window.partitionBy("place").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    own = hashed.withColumn("own", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return own.join(ahead, ["place", "b"]).withColumn("start", F.col("own") + F.col("ahead")).drop("b", "own", "ahead")


def slots(shares: DataFrame, block: int = BLOCK, seed: int = 42) -> DataFrame:
    """One row per slot of the mix: (place, shard, slot, block, words); ``words`` of the block are taken from its start."""
    nb, total = F.ceil(F.col("source_size") / block).cast("bigint"), F.round("target").cast("bigint")
    passes = F.floor(F.col("total") / F.col("source_size")).cast("bigint")
    last = F.col("source_size") - (F.col("nb") - 1) * block
    sized = shares.filter("source_size > 0").withColumn("nb", nb).withColumn("total", total).withColumn("passes", passes).withColumn("last", last)
    # of the part pass: the permuted place of the short block decides how many blocks fit
    sized = sized.withColumn("rest", F.col("total") - F.col("passes") * F.col("source_size"))
    all_slots = F.sum(F.col("passes") * F.col("nb") + F.ceil(F.col("rest") / block) + 1).over(Window.partitionBy())
    sized = sized.withColumn("shards", F.greatest(F.lit(1), F.ceil(all_slots / SHARD_SLOTS)).cast("bigint"))
    # numbers 0 .. slots-1 in two levels, so that no row holds a sequence of a whole source
    most = F.col("passes") * F.col("nb") + F.ceil(F.col("rest") / block) + 1
    thousands = sized.withColumn("most", most.cast("bigint")).withColumn("k", F.explode(F.expr("sequence(0L, div(most - 1, 1000L))")))
    each = thousands.withColumn("slot", F.explode(F.expr("sequence(k * 1000L, least(most, k * 1000L + 1000L) - 1)"))).drop("k", "most")
    each = each.withColumn("pass", F.expr("div(slot, nb)")).withColumn("i", F.expr("slot % nb"))
    prime = F.element_at(F.array(*[F.lit(p) for p in PRIMES]), (F.pmod(F.xxhash64("place", "pass", F.lit(seed)), F.lit(len(PRIMES))) + 1).cast("int"))
    move = F.pmod(F.xxhash64("place", "pass", F.lit(seed + 1)), F.col("nb"))
    at = lambda i: F.pmod(F.pmod(prime, F.col("nb")) * i + move, F.col("nb"))
    each = each.withColumn("block", at(F.col("i")))
    each = each.withColumn("size", F.when(F.col("block") == F.col("nb") - 1, F.col("last")).otherwise(F.lit(block)))
    whole = each.filter(F.col("pass") < F.col("passes")).withColumn("words", F.col("size"))
    part = each.filter(F.col("pass") == F.col("passes"))
    short = part.filter(F.col("block") == F.col("nb") - 1).select(F.col("place").alias("sp"), F.col("i").alias("short_i"), F.col("last").alias("short_size"))
    part = part.join(short, F.col("place") == F.col("sp"), "left")
    before = F.col("i") * block - F.when(F.col("short_i") < F.col("i"), block - F.col("short_size")).otherwise(0)
    part = part.withColumn("words", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - before)).cast("bigint")).drop("sp", "short_i", "short_size")
    out = whole.unionByName(part).filter("words > 0")
    shard = F.pmod(F.xxhash64("place", "slot", F.lit(seed + 2)), F.col("shards"))  # a multinomial draw for each slot
    return out.select("place", shard.alias("shard"), "slot", "pass", "block", F.col("words").cast("bigint").alias("words"))


def _plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], at_most: float, block: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(rows with source_size, target, place and start; slots)."""
    text = text_or_empty(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("h"))
    rows = cut_lineage(rows)
    shares = cut_lineage(targets(rows.select("source", "size"), weights, at_most))
    sized = rows.alias("r").join(shares.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source"))).select("r.*", "source_size", "target", "place")
    return _placed(sized), slots(shares, block, seed)


def _overlaps(placed: DataFrame, used: DataFrame, block: int) -> DataFrame:
    """Blocks joined to documents by number: (place, start, begin, end) of the words taken, as numbers within the document."""
    first, final = F.expr(f"div(start, {block}L)"), F.expr(f"div(start + size - 1, {block}L)")
    # a very long text lies in many blocks; its list holds block numbers only
    spread = placed.filter("size > 0").select("place", "start", "size", F.explode(F.sequence(first, final)).alias("block"))
    begin = F.greatest(F.col("start"), F.col("block") * block) - F.col("start")
    end = F.least(F.col("start") + F.col("size"), F.col("block") * block + F.col("words")) - F.col("start")
    return spread.join(used, ["place", "block"]).withColumn("begin", begin).withColumn("end", end).filter("begin < end")


def mixed_words(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, at_most: float = 3.0, block: int = BLOCK, seed: int = 42
) -> DataFrame:
    """One row per row of ``docs``: id, source, ``size``, ``source_size``, ``target``, ``taken`` (words in the mix, repeats counted)."""
    placed, dealt = _plan(docs, id_col, text_col, source_col, weights, at_most, block, seed)
    used = dealt.groupBy("place", "block", "words").agg(F.count("*").alias("times"))
    taken = _overlaps(placed, used, block).groupBy("place", "start").agg(F.sum((F.col("end") - F.col("begin")) * F.col("times")).alias("taken"))
    # a row with words is named by its source and start
    joined = placed.alias("p").join(taken.alias("t"), (F.col("p.place") == F.col("t.place")) & (F.col("p.start") == F.col("t.start")) & (F.col("p.size") > 0), "left")
    return joined.select(F.col("p.id").alias(id_col), F.col("p.source").alias("source"), F.col("p.size"), F.col("p.source_size"), "p.target", F.coalesce(F.col("t.taken"), F.lit(0)).cast("bigint").alias("taken"))


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, at_most: float = 3.0, block: int = BLOCK, seed: int = 42
) -> DataFrame:
    """The mix as rows with the columns of ``docs``: a row for each pass over its source that takes words of the document.

    A document that a pass takes whole keeps its text; of one taken in part the text holds the words taken, each with
    the blanks behind it. Documents without words are not in the mix."""
    placed, dealt = _plan(docs, id_col, text_col, source_col, weights, at_most, block, seed)
    parts = _overlaps(placed, dealt, block).groupBy("place", "start", "pass").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("ranges"))
    plans = placed.filter("size > 0").join(parts, ["place", "start"])  # lists are of one document and pass: at most its blocks
    plans = plans.groupBy("id", "source", "h", "start", "size").agg(F.collect_list("ranges").alias("passes"))  # at most ceil(at_most) passes
    row, nth, text = "row", "nth", text_or_empty(F.col(text_col))
    keyed = docs.select(F.struct("*").alias(row), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text).alias("h"), text.alias("whole"))
    same = lambda order: F.row_number().over(Window.partitionBy("id", "source", "h").orderBy(order))
    keyed, plans = keyed.withColumn(nth, same("h")), plans.withColumn(nth, same("start"))
    on = F.col("k.id").eqNullSafe(F.col("p.id")) & F.col("k.source").eqNullSafe(F.col("p.source")) & (F.col("k.h") == F.col("p.h")) & (F.col("k.nth") == F.col("p.nth"))
    joined = keyed.alias("k").join(plans.alias("p"), on).select(row, "whole", "size", F.explode("passes").alias("ranges"))
    words = F.regexp_extract_all("whole", F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    cut = F.transform(F.array(F.struct(words.alias("w"))), lambda s: F.array_join(F.flatten(F.transform("ranges", lambda r: F.slice(s["w"], (r["begin"] + 1).cast("int"), (r["end"] - r["begin"]).cast("int")))), ""))[0]
    taken = F.aggregate("ranges", F.lit(0).cast("bigint"), lambda a, r: a + r["end"] - r["begin"])
    out = joined.withColumn("cut", F.when(taken == F.col("size"), F.col("whole")).otherwise(cut))
    return out.select(*[(F.col("cut") if c == text_col else F.col(f"{row}.`{c}`")).alias(c) for c in docs.columns])
