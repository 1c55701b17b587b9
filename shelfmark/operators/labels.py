"""Filtering of image labels, with the reason for every label that is dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark import vocab
from shelfmark.functions import text as tx
from shelfmark.functions.binding import let

_SEEN = "struct<kept:array<string>,rows:array<struct<identifier:string,confidence:float,reason:string>>>"


def label_outcome(
    candidates: Column, low_information=vocab.LOW_INFORMATION_LABELS, floor: float = vocab.LABEL_FLOOR,
    bypass: float = vocab.LABEL_BYPASS, limit: int = vocab.LABEL_LIMIT, raw_limit: int = vocab.RAW_LABEL_LIMIT,
) -> Column:
    """A struct of ``raw``, ``filtered`` and ``dropped`` from an array of ``(identifier, confidence, precision_ok)``.

    Labels are taken by confidence, best first; they are put in order once and judged once.  One fold over the array decides each label, because
    duplicates and the cap depend on the labels kept before it.
    """
    ordered = F.array_sort(
        F.transform(candidates, lambda c: F.struct(
            F.lower(tx.strip(c["identifier"])).alias("identifier"), c["confidence"].cast("float").alias("confidence"),
            c["precision_ok"].alias("precision_ok"))),
        lambda a, b: F.when(a["confidence"] > b["confidence"], -1).when(a["confidence"] < b["confidence"], 1)
        .when(a["identifier"] < b["identifier"], -1).when(a["identifier"] > b["identifier"], 1).otherwise(0))
    floor_c, gate = F.lit(floor).cast("float"), F.lit(floor).cast("float") + F.lit(bypass).cast("float")

    def decide(state: Column, c: Column) -> Column:
        name, score = c["identifier"], c["confidence"]
        reason = (
            F.when(name == "", "empty").when(name.isin(*low_information), "low_information")
            .when(~(c["precision_ok"] | (score >= gate)), "precision_gate").when(score < floor_c, "below_confidence_floor")
            .when(F.array_contains(state["kept"], name), "duplicate").when(F.size(state["kept"]) >= limit, "over_cap")
            .otherwise("kept"))
        row = F.struct(F.when(name == "", "(empty)").otherwise(name).alias("identifier"), score.alias("confidence"), reason.alias("reason"))
        kept = F.when(reason == "kept", F.concat(state["kept"], F.array(name))).otherwise(state["kept"])
        return F.struct(kept.alias("kept"), F.concat(state["rows"], F.array(row)).alias("rows")).cast(_SEEN)

    start = F.struct(F.array().cast("array<string>").alias("kept"), F.array().alias("rows")).cast(_SEEN)
    pair = lambda r: F.struct(r["identifier"].alias("identifier"), r["confidence"].alias("confidence"))

    def raw(labels: Column) -> Column:
        named = F.filter(F.transform(labels, lambda c: c["identifier"]), lambda n: n != "")
        best = lambda n: F.element_at(F.filter(labels, lambda c: c["identifier"] == n), 1)["confidence"]
        return F.transform(F.slice(F.array_distinct(named), 1, raw_limit), lambda n: F.struct(n.alias("identifier"), best(n).alias("confidence")))

    def outcome(labels: Column) -> Column:
        return let(F.aggregate(labels, start, decide, lambda s: s["rows"]), lambda rows: F.struct(
            raw(labels).alias("raw"), F.transform(F.filter(rows, lambda r: r["reason"] == "kept"), pair).alias("filtered"),
            F.filter(rows, lambda r: r["reason"] != "kept").alias("dropped")))

    return let(ordered, outcome)


def filter_labels(items: DataFrame, candidates: str = "candidates", **settings) -> DataFrame:
    """Add the three outcome columns to rows that carry a candidate array."""
    judged = items.withColumn("_outcome", label_outcome(F.col(candidates), **settings))
    return judged.select(*items.columns, "_outcome.raw", "_outcome.filtered", "_outcome.dropped")
