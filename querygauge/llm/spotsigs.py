"""SpotSigs document fingerprints, with DataFrame functions only.

A signature is a chain: a common word (the anchor) and the next two content words behind it, other common words
being skipped. The fingerprint of a text is its set of signature hashes, in order. Common words are a fixed list
for several languages. A text with fewer than ``FEW`` chains also uses every word as an anchor, so that short texts and
texts without common words have a telling fingerprint as well.

Fingerprints are compared by Jaccard similarity, bounded by set lengths: sets of which the smaller has less than
``t`` times the length of the larger cannot reach ``t``. `similar` joins a table with itself: sets are partitioned
by length (a partition spans lengths whose ratio is ``t``, so partners lie in the same or the next one) and meet on the
rarest-by-hash signatures that two similar sets must share.

Defined results: a null or empty text has no words, an empty set and the fingerprint ''. Two empty sets are alike (1) as
their fingerprints are equal; an empty and another set are not (0). Repeated rows have equal fingerprints.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from querygauge.llm.common import text_or_empty

#: Common words of English, French, German and Spanish, in that order.
ANCHORS = (
    "a an and are as at be but by for from had has have he her his if in into is it its not of on or she that the their there they this to was were which will with you "
    "au aux avec ce ces dans des du elle en est et eux il je la le les leur lui mais ne nous par pas pour que qui sa se son sur un une vous "
    "auf aus bei das dem den der des die ein eine einen einer es für hat ich im ist mit nach nicht sich sie sind so und von war wie zu zum zur über "
    "al como con de del el ella ellos esta este lo los las más muy no nos para pero por se si sin sobre su sus todo una y ya"
).split()
CHAIN = 2
FEW = 8


def signatures(text: Column) -> Column:
    """Sorted distinct signature hashes (array of int) of a text."""
    words = F.filter(F.split(F.lower(text_or_empty(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    common = lambda w: w.isin(*ANCHORS)
    bind = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)  # noqa: E731  evaluated once

    def chains(s: Column) -> Column:
        w, c, at = s["w"], s["c"], s["at"]
        # the k-th anchor, at word p, has p - k content words ahead of it
        made = F.transform(at, lambda p, k: F.when(p - k < F.size(c), F.hash(F.get(w, p), *[F.get(c, p - k + i) for i in range(CHAIN)])))
        return F.filter(made, lambda x: x.isNotNull())

    def sets(s: Column) -> Column:
        every = F.transform(s["w"], lambda x, i: F.hash(x, *[F.get(s["w"], i + 1 + j) for j in range(CHAIN)]))
        return bind(chains(s), lambda found: F.array_sort(F.array_distinct(F.when(F.size(found) >= FEW, found).otherwise(F.concat(found, every)))))

    anchors = lambda w: F.filter(F.transform(w, lambda x, i: F.when(common(x), i)), lambda i: i.isNotNull())
    content = lambda w: F.filter(w, lambda x: ~common(x))
    return bind(words, lambda w: bind(F.struct(w.alias("w"), content(w).alias("c"), anchors(w).alias("at")), sets))


def fingerprint(sigs: Column) -> Column:
    """The set as text: 8 hex digits for each signature."""
    return F.array_join(F.transform(sigs, lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def likeness(a: Column, b: Column, at_least: float = 0.0) -> Column:
    """Jaccard similarity of two sets; 0 without a look at the elements where lengths keep it below ``at_least``."""
    na, nb = F.size(a), F.size(b)
    shared = F.size(F.array_intersect(a, b))
    exact = F.when((na == 0) & (nb == 0), F.lit(1.0)).otherwise(shared / (na + nb - shared))
    return F.when((F.greatest(na, nb) * at_least > F.least(na, nb)), F.lit(0.0)).otherwise(exact)


def similar(sets: DataFrame, at_least: float = 0.8) -> DataFrame:
    """(a, b, likeness) of classes of equal sets that reach ``at_least``, from (id, sigs); ``members`` of a class stay with
    `classes`. Empty sets pair with nothing. A class is named by its smallest id."""
    own = classes(sets).groupBy("class").agg(F.first("sigs").alias("sigs"))
    n = F.size("sigs")
    level = F.floor(F.log(n.cast("double")) / F.lit(-math.log(at_least))).cast("int")
    prefix = F.slice("sigs", 1, n - F.ceil(n * at_least - 1e-9).cast("int") + 1)
    posted = own.filter(n > 0).select("class", n.alias("n"), level.alias("level"), F.explode(prefix).alias("sig"))
    near = posted.select("class", "n", "sig", F.explode(F.array("level", F.col("level") + 1)).alias("level"))
    on = (F.col("x.sig") == F.col("y.sig")) & (F.col("x.level") == F.col("y.level")) & (F.col("x.class") != F.col("y.class")) & (F.col("x.n") * at_least <= F.col("y.n")) & (F.col("y.n") * at_least <= F.col("x.n"))
    pairs = near.alias("x").join(posted.alias("y"), on).select(F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b")).distinct()
    one, two = own.select(F.col("class").alias("a"), F.col("sigs").alias("sa")), own.select(F.col("class").alias("b"), F.col("sigs").alias("sb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", likeness(F.col("sa"), F.col("sb"), at_least).alias("likeness")).filter(F.col("likeness") >= at_least)


def classes(sets: DataFrame) -> DataFrame:
    """(id, sigs, class): ``class`` is the smallest id with an equal set."""
    keyed = sets.select("id", "sigs", F.sha2(fingerprint(F.col("sigs")), 256).alias("k"))
    return keyed.join(keyed.groupBy("k").agg(F.min("id").alias("class")), "k").drop("k")


RANGES = 1000  # most ranges that ids are ordered in


def with_next(rows: DataFrame, ranges: int) -> DataFrame:
    """(id, h, of_id, of_h, need): each document's successor, named with the document and a quarter of its length.

    ``rows`` (id, h, text) are in order of id (null first), then of the digest ``h``; rows that repeat are one document;
    after the last comes the first. Only ids and lengths are ordered: in ranges of ids, each with a window of its
    own, and by one row per range."""
    meta = rows.select("id", "h", F.length("text").alias("n")).distinct()
    shares = [i / ranges for i in range(1, ranges)] or [0.5]
    low = sorted(set(rows.agg(F.percentile_approx(F.col("id").cast("double"), shares, 10_000).alias("b")).first()["b"] or []))  # one number per range
    number = F.size(F.filter(F.array(*[F.lit(x) for x in low]), lambda x: x <= F.col("id").cast("double"))) if low else F.lit(0)
    order = Window.partitionBy("part").orderBy(F.col("id").asc_nulls_first(), "h")
    ordered = meta.withColumn("part", F.when(F.col("id").isNull(), -1).otherwise(number)).select("*", F.lead(F.struct("id", "h")).over(order).alias("next"))
    firsts = ordered.groupBy("part").agg(F.min(F.struct(F.col("id").isNotNull(), "id", "h")).alias("f"))
    along = Window.orderBy("part")  # one row per range
    firsts = firsts.select("part", F.coalesce(F.lead("f").over(along), F.first("f").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("f"))
    linked = ordered.join(firsts.select("part", F.struct("f.id", "f.h").alias("other")), "part").select("id", "h", "n", F.coalesce("next", "other").alias("next"))
    return linked.select("next.id", "next.h", F.col("id").alias("of_id"), F.col("h").alias("of_h"), F.floor(F.col("n") / 4).cast("int").alias("need"))


def edited_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, sigs, edited, edited_sigs, next_sigs) for each row; see `with_next` for the order."""
    text = text_or_empty(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), F.md5(text.cast("binary")).alias("h"), text.alias("text"))
    wanted = with_next(rows, min(RANGES, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    # texts move once, by id and digest; signatures are made behind that shuffle, from the texts at hand
    one = rows.alias("r").join(wanted.alias("w"), (F.col("r.h") == F.col("w.h")) & F.col("r.id").eqNullSafe(F.col("w.id")))
    given = one.select("of_id", "of_h", F.substring("text", F.lit(1), F.col("need")).alias("head"), signatures(F.col("text")).alias("next_sigs"))
    given = given.groupBy("of_id", "of_h").agg(F.first(F.struct("head", "next_sigs")).alias("g"))  # rows that repeat give the same
    joined = rows.alias("r").join(given.alias("g"), (F.col("r.h") == F.col("g.of_h")) & F.col("r.id").eqNullSafe(F.col("g.of_id")))
    n = F.length("r.text")
    edited = F.concat(F.substring("r.text", F.lit(1), (n - F.floor(n / 4)).cast("int")), F.col("g.g.head"))
    made = joined.select(F.col("r.id").alias("id"), F.col("r.text").alias("text"), edited.alias("edited"), F.col("g.g.next_sigs").alias("next_sigs"))
    return made.withColumns({"sigs": signatures(F.col("text")), "edited_sigs": signatures(F.col("edited"))})
