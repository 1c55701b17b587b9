"""Mixing sources to target weights by systematic sampling.

Every source gets a target number of words.  Its documents stand in order of size; each expects target / source size
copies, the prefix sum of these starts at one random offset, and a document is taken once for each whole number
that its stretch of the sum crosses.  Neighbours in the order have like sizes, so what a source takes differs
from its target by less than its longest document.

The prefix sum needs places, not partial sums, as all documents of a source expect the same: rows are range-partitioned
by source, size and id, so a hot source spreads over many tasks.

Null text has size 0; null is a source of its own, the last.  Rows with equal source, size and id are
interchangeable.  An empty table gives no rows.  The offset is a hash of seed and source: reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import land, numbered, word_array


def word_count(text: Column) -> Column:
    return F.size(word_array(text)).cast("long")


def offset(source: Column, seed: int) -> Column:
    """From 0 to below 1, out of a hash of seed and source; the null source hashes as the empty name."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit(""))).cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, first, target) from rows of (source, size, position).

    Sources share the sum of all sizes by weight; one that would get over ``most`` times its size stops there and
    the rest is shared anew until none is above.  A round is one aggregate of a single row.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("position").alias("first"))
    placed = numbered(totals, [F.col("source").asc_nulls_last()], "place", "sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    table = land(placed.select("source", "source_size", "first", weight.alias("weight"), (F.col("source_size") * most).alias("ceiling")), "targets")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, free = 0.0, -1
    while True:
        inside = F.lit(True) if free < 0 else F.lit(level) * F.col("weight") <= F.col("ceiling")
        n, shared, stopped = table.agg(F.count(F.when(inside, 1)), F.sum(F.when(inside, F.col("weight"))),
                                       F.sum(F.when(~inside, F.col("ceiling")))).first()
        if n == free or not n:
            break
        free, level = n, (total - (stopped or 0)) / shared
    return table.select("source", "source_size", "first", F.least(F.col("ceiling").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, *, id_column: str = "doc_id", source_column: str = "source", size: Column | None = None,
        seed: int = 7) -> DataFrame:
    """Each row of ``docs`` as the struct ``row``, with its id, source, size, source_size, target and copies.

    ``size`` defaults to the words of ``text``.  As a struct the row may have columns of any names.
    """
    sized = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), F.col(f"`{id_column}`").alias("id"),
                        F.col(f"`{source_column}`").alias("source"), (word_count(F.col("text")) if size is None else size).alias("size"))
    placed = numbered(sized, [F.col("source").asc_nulls_last(), F.col("size"), F.col("id")], "position", "mixed")
    shares = targets(placed.select("source", "size", "position")).withColumnRenamed("source", "of_source")
    joined = placed.join(shares, F.col("source").eqNullSafe(F.col("of_source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    place, start = F.col("position") - F.col("first"), offset(F.col("source"), seed)
    copies = F.floor((place + 1) * rate + start) - F.floor(place * rate + start)
    return joined.select("row", "id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) of every document."""
    narrow = docs.select("doc_id", "source", word_count(F.col("text")).alias("words"))
    return mix(narrow, size=F.col("words"), **options).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    chosen = mix(docs, **options).filter("copies > 0")
    return chosen.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
