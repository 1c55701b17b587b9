"""Matching of item texts against collection titles by contained words."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfmark import vocab
from shelfmark.functions import text as tx
from shelfmark.operators.search import containing_words


# Characters at which texts may be cut; NUL has a meaning of its own in ``translate``.
CUTS = "".join(chr(code) for code in range(1, 128) if not chr(code).isalpha() and code != 32)


def contained_tokens(texts: DataFrame, tokens: DataFrame) -> DataFrame:
    """The columns of ``texts(…, low)`` but the text, and ``token``, where it contains a token of ``tokens(token)`` without blanks, of three letters or more.

    Texts are cut at blanks and at those ASCII characters that no token has, so that numbers and words beside a line break or a mark
    make short pieces.  Only pieces with the beginning of a token are shuffled, and no text ever meets a title directly.
    """
    wanted = tokens.select("token").distinct()
    used = wanted.select(F.explode(F.split("token", "")).alias("char")).filter(F.contains(F.lit(CUTS), F.col("char"))).agg(
        F.array_join(F.collect_set("char"), "").alias("used"))
    cuts = used.select(F.call_function("translate", F.lit(CUTS), F.col("used"), F.lit("")).alias("cuts"))  # one row
    keys = [c for c in texts.columns if c != "low"]
    plain = F.call_function("translate", F.col("low"), F.col("cuts"), F.repeat(F.lit(" "), F.length("cuts")))
    pieces = texts.crossJoin(F.broadcast(cuts)).select(*keys, F.explode(F.array_distinct(F.split(plain, " "))).alias("word")).filter(F.length("word") >= 3)
    return containing_words(pieces, wanted, shortest=3).select(*keys, "token").distinct()


def profile_share(texts: DataFrame, collections: DataFrame) -> DataFrame:
    """``(item_id, share)``: the best share of a title's words (three letters or more) found in the text."""
    titles = collections.select("collection_id", F.filter(
        tx.words(F.lower("title")), lambda t: F.length(t) >= 3).alias("all")).filter(F.size("all") > 0)
    flat = titles.select("collection_id", F.size("all").alias("size"), F.explode("all").alias("token"))
    counted = flat.groupBy("collection_id", "size", "token").agg(F.count(F.lit(1)).alias("times"))
    hits = contained_tokens(texts, counted).join(counted, "token").groupBy("item_id", "collection_id", "size").agg(
        F.sum("times").alias("hits"))
    return hits.groupBy("item_id").agg(F.max(F.round(F.col("hits") / F.col("size"), 6)).alias("share"))


def matching_titles(texts: DataFrame, collections: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``(item_id, title)`` where a title word of three letters or more occurs in the text.

    With ``labels(item_id, identifier)``, travel labels support titles about Japan, and home labels titles
    about apartments.
    """
    titles = collections.select("title", F.lower("title").alias("low")).distinct()
    tokens = titles.select("title", F.explode(F.array_distinct(F.split("low", " "))).alias("token")).filter(F.length("token") >= 3)
    found = contained_tokens(texts, tokens).join(tokens, "token").select("item_id", "title")
    if labels is None:
        return found.distinct()
    kinds = labels.select("item_id", F.when(F.col("identifier").isin(*vocab.TRAVEL_LABELS), "japan")
                          .when(F.col("identifier").isin(*vocab.HOME_LABELS), "apartment").alias("kind")).filter(F.col("kind").isNotNull()).distinct()
    about = titles.select("title", F.explode(F.array_compact(F.array(
        F.when(F.contains("low", F.lit("japan")), F.lit("japan")), F.when(F.contains("low", F.lit("apartment")), F.lit("apartment"))))).alias("kind"))
    return found.unionByName(kinds.join(about, "kind").select("item_id", "title")).distinct()


def profile_columns(texts: DataFrame, collections: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``(item_id, profile_titles, profile_score)`` for pair scoring; items without a title are left out."""
    return matching_titles(texts, collections, labels).groupBy("item_id").agg(
        F.array_sort(F.collect_set("title")).alias("profile_titles")).withColumn("profile_score", F.lit(0.7))
