"""Mixing sources to target weights with hash-threshold histograms.

A source that is to give more words than it has gives every document the same
number of whole times; the rest of its target is met by the documents with the
smallest hashes.  Which hash is the last one is found without sorting: words
are summed by source and hash bucket, a running sum over the (few) buckets
finds the bucket where the target falls, and only that bucket is split into
finer ones, until the hash has no more digits.  Larger targets take the same
documents and more (thresholds are nested).  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colsense.llm.common import written

#: The hash has 60 bits, read in digits of 10.
DIGIT, DIGITS = 1 << 10, 6


def word_count(text: Column | str) -> Column:
    """Number of runs of other characters than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def document_hash() -> Column:
    """60 bits of the MD5 of id and text: equal rows share it, and reruns agree."""
    own = F.concat_ws("\n", F.col("doc_id").cast("string"), F.md5(F.col("text").cast("binary")))
    return F.conv(F.substring(F.md5(own.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources by code point, null last, weigh ``weights`` in turn.  They divide
    ``share`` times all words by weight; where that is over ``most`` times a
    source's size, the target stops there and the rest is shared again.  That
    ends with one level: target = least(cap, level * weight).  Sources reach
    their caps in the order of cap / weight, so running sums in that order find
    the level.  The windows hold one row for each source, not for documents.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int"))
    everything = Window.partitionBy()
    ordered = Window.orderBy(F.col("cap") / F.col("weight"), F.col("place"))
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    table = (sizes.withColumn("place", place).withColumn("weight", weight)
             .withColumn("cap", most * F.col("source_size"))
             .withColumn("capped_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
             .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
             .withColumn("level", (share * F.sum("source_size").over(everything) - F.col("capped_before"))
                         / (F.sum("weight").over(everything) - F.col("weight_before")))
             .withColumn("full", F.col("cap") <= F.col("level") * F.col("weight")))
    final = F.min(F.when(~F.col("full"), F.struct("capped_before", "level"))).over(everything)["level"]
    return table.select("source", "source_size",
                        F.when(F.col("full"), F.col("cap")).otherwise(final * F.col("weight")).alias("target"))


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, whole, last): how many whole times every document is taken, and
    the largest hash that is taken once more (null: none).

    The documents of the last hash are taken if that brings the sum nearer to
    the target.  ``sized`` has (source, size, hash).
    """
    plan = goals.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                            .otherwise(0).cast("long"))
    open_ = written(plan.select("source", "whole", F.lit(0).cast("long").alias("head"), F.lit(0).cast("long").alias("below"),
                                (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest")), "mix-0")
    for level in range(1, DIGITS + 1):
        width = DIGIT ** (DIGITS - level)
        digit = F.expr(f"hash div {width}")
        mine = sized.alias("d").join(open_.alias("o"), F.expr(f"d.source <=> o.source and d.hash div {width * DIGIT} = o.head"))
        sums = (mine.select("d.source", "d.size", digit.alias("digit"), "o.whole", "o.below", "o.rest")
                .groupBy("source", "digit").agg(F.sum("size").alias("size"), F.first("whole").alias("whole"),
                                                F.first("below").alias("below"), F.first("rest").alias("rest")))
        run = Window.partitionBy("source").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
        upto = F.col("below") + F.sum("size").over(run)
        # the first bucket that ends above the rest holds the boundary; the last one, if none does
        found = (sums.withColumn("upto", upto).withColumn("over", F.col("upto") > F.col("rest"))
                 .groupBy("source").agg(
                     F.first("whole").alias("whole"), F.first("rest").alias("rest"),
                     F.min(F.when(F.col("over"), F.struct("digit", "upto", "size"))).alias("hit"),
                     F.max(F.struct("digit", "upto", "size")).alias("end")))
        at = F.coalesce("hit", "end")
        open_ = written(found.select("source", "whole", at["digit"].alias("head"),
                                     (at["upto"] - at["size"]).alias("below"), "rest",
                                     at["upto"].alias("upto")), f"mix-{level}")
    # a bucket is one hash now: with it, or up to the hash before
    near = F.col("below") + F.col("upto") <= 2 * F.col("rest")
    return open_.select("source", "whole", F.when(near, F.col("head")).otherwise(F.col("head") - 1).alias("last"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0,
        keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``size``, ``source_size``, ``target``, ``copies`` (how
    often the mix has the document) and ``taken`` (its words there).

    Null texts have size 0; a null source is a source, the last one.  A null
    doc_id is hashed by its text.  Rows that repeat id and text share a hash and
    are taken together.  Sources without a word have target 0.  No document is
    taken more than ``most`` times, documents without a word included.  An empty table
    gives an empty one.  Only (source, size, hash) is shuffled or written, in
    sums by source and bucket after the first pass.
    """
    sized = docs.select(F.struct(*keep).alias("__keep"), "source", word_count("text").alias("size"), document_hash().alias("hash"))
    small = written(sized.select("source", "size", "hash"), "mix-sizes")
    goals = written(targets(small.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most),
                    "mix-targets")
    plan = goals.alias("g").join(thresholds(small, goals).alias("t"), F.expr("g.source <=> t.source")).select(
        F.col("g.source").alias("__source"), "source_size", "target", "whole", "last")
    once_more = F.when(F.col("hash") <= F.col("last"), 1).otherwise(0)
    copies = F.least(F.col("whole") + once_more, F.floor(F.lit(most))).cast("long")
    rows = sized.join(plan, F.col("source").eqNullSafe(F.col("__source")))
    return rows.select("__keep.*", "size", "source_size", "target", copies.alias("copies"),
                       (copies * F.col("size")).alias("taken"))
