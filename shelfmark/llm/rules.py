"""Quality rules with distribution divergence, in built-in functions only.

Each document's histogram of character classes and of its language's common words is compared with the reference
of that language, which is the sum over all documents of the language.  Documents whose Jensen-Shannon distance is
above the limit are not kept; texts too short for a histogram to mean anything are not judged by it.

Words, lines and windows are worked out inside the row, so no text is shuffled: what is landed is a row of counts
per document, and what is aggregated is one row per listed language.  Null text has no words.  A language that
isn't listed, or null, is compared by character classes with all such documents together, and by no words.
Repeated rows are separate documents; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import land, word_array

# Frequent function words of each language.
COMMON = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "are", "this", "from", "or"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "sur", "au", "avec", "pas"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "del", "se", "las", "por", "un", "para", "con", "no", "una", "su", "al", "lo", "como"),
}
OTHER = "other"
WORDS = 20
CLASSES = ("upper", "digit", "space", "symbol", "point", "wide", "lower")
SYMBOLS = "#*$%&|<>"
LIMITS = {"chars": 400, "words": 80, "class_distance": 0.25, "word_distance": 0.30}


def _left(text: str, pattern: str) -> str:
    """Number of characters that ``pattern`` takes out of ``text``."""
    return f"cast(length({text}) - length(regexp_replace({text}, '{pattern}', '')) as long)"


def counts(docs: DataFrame) -> DataFrame:
    """One row of counts per document: the base columns, classes k_*, and w: uses of each common word."""
    language = F.when(F.col("lang").isin(*COMMON), F.col("lang")).otherwise(F.lit(OTHER))
    common = reduce(lambda rest, name: F.when(F.col("_lang") == name, F.array(*map(F.lit, COMMON[name]))).otherwise(rest),
                    COMMON, F.array().cast("array<string>"))
    texts = docs.select(F.col("doc_id"), language.alias("_lang"), F.coalesce(F.col("text"), F.lit("")).alias("t"))
    words = texts.withColumn("words", word_array(F.col("t")))
    windows = words.withColumn("hashes", F.when(F.size("words") >= 5, F.expr(
        "transform(sequence(0, size(words) - 5), i -> xxhash64(words[i], words[i + 1], words[i + 2], words[i + 3], words[i + 4]))")))
    # Only texts with a window that comes again pay for the search of its places.
    marked = windows.withColumn("again", F.expr("size(hashes) > size(array_distinct(hashes))"))
    sorted_windows = marked.withColumn("pairs", F.when(F.col("again"), F.expr("array_sort(transform(hashes, (h, i) -> struct(h as h, i as i)))")))
    places = sorted_windows.withColumn("places", F.when(F.col("again"), F.expr(
        "array_sort(transform(filter(pairs, (p, k) -> p.h = get(pairs, k - 1).h or p.h = get(pairs, k + 1).h), p -> p.i))")))
    repeated = F.expr("aggregate(zip_with(slice(places, 2, size(places)), slice(places, 1, size(places) - 1), (b, a) -> least(5, b - a)), "
                      "5, (x, y) -> x + y)")
    listed = places.withColumn("lines", F.expr(r"filter(split(t, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')")).withColumn(
        "common", common).withColumn("used", F.expr("filter(words, w -> array_contains(common, w))"))
    columns = {
        "n_words": "cast(size(words) as long)",
        "word_chars": "cast(length(array_join(words, '')) as long)",
        "n_symbols": _left("t", f"[{SYMBOLS}]+"),
        "n_dup_lines": "cast(size(lines) - size(array_distinct(lines)) as long)",
        "n_chars": "cast(length(t) as long)",
        "k_upper": _left("t", "[A-Z]+"),
        "k_digit": _left("t", "[0-9]+"),
        "k_point": _left("t", "[!-/:-@\\\\[-`{-~]+"),
        "k_wide": _left("t", r"[^\\x00-\\x7F]+"),
    }
    return listed.select("doc_id", "_lang", *[F.expr(e).alias(name) for name, e in columns.items()],
                         F.when(F.coalesce(F.col("again"), F.lit(False)), repeated).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
                         F.expr("transform(common, c -> cast(size(used) - size(array_remove(used, c)) as long))").alias("w"))


def _histograms(table: DataFrame) -> DataFrame:
    """``classes`` and ``uses``: counts that add up to the characters and the words."""
    c = F.col
    parts = [c("k_upper"), c("k_digit"), c("n_chars") - c("word_chars"), c("n_symbols"), c("k_point") - c("n_symbols"), c("k_wide")]
    return (table.withColumn("classes", F.array(*parts, c("n_chars") - reduce(add, parts)))
            .withColumn("uses", F.concat("w", F.array(F.expr("n_words - aggregate(w, 0L, (x, y) -> x + y)")))))


def distance(own: str, other: str) -> Column:
    """Jensen-Shannon distance of two arrays of counts, 0 to 1."""
    share = "transform({0}, x -> x / greatest(aggregate({0}, 0L, (a, b) -> a + b), 1L))"
    term = "if({0} > 0, 0.5D * {0} * log2(2 * {0} / (p + q)), 0D)"
    terms = f"zip_with({share.format(own)}, {share.format(other)}, (p, q) -> {term.format('p')} + {term.format('q')})"
    return F.expr(f"sqrt(greatest(0D, aggregate({terms}, 0D, (x, y) -> x + y)))")


def verdicts(docs: DataFrame, limits: dict[str, float] = LIMITS) -> DataFrame:
    """Base columns, distances and verdict of every document."""
    table = land(_histograms(counts(docs)), "counts")
    total = lambda name, n: F.array(*[F.sum(F.get(name, F.lit(i))) for i in range(n)])
    per_language = table.groupBy(F.col("_lang").alias("r_lang")).agg(
        total("classes", len(CLASSES)).alias("r_classes"), F.when(F.col("r_lang") != OTHER, total("uses", WORDS + 1)).alias("r_uses"))
    # A row for each listed language and one for the others.
    joined = table.join(F.broadcast(per_language), F.col("_lang") == F.col("r_lang"))
    judged = joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words").alias("base_failed"),
        F.when(F.col("n_chars") >= limits["chars"], distance("classes", "r_classes")).alias("class_distance"),
        F.when((F.col("n_words") >= limits["words"]) & (F.col("_lang") != OTHER), distance("uses", "r_uses")).alias("word_distance"))
    fits = lambda name: F.coalesce(F.col(name) <= limits[name], F.lit(True))
    return judged.withColumn("kept", ~F.col("base_failed") & fits("class_distance") & fits("word_distance"))
