"""Queue and quality metrics, each in one pass over its table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark import vocab


def _count(test: Column, name: str) -> Column:
    return F.count_if(test).alias(name)


def stage_counts(items: DataFrame, stage: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """One row: how many photo rows have each status of a stage, plus any further tests."""
    status, photos = F.col(f"{stage}_status"), F.col("source") == "photos"
    columns = [_count(photos & (status == s), s) for s in vocab.STAGE_STATUSES]
    columns += [_count(photos & test, name) for name, test in (extra or {}).items()]
    return items.agg(*columns)


def organize_counts(items: DataFrame) -> DataFrame:
    status, live = F.col("organize_status"), ~F.col("is_removed")
    return items.agg(*[_count(live & (status == s), s) for s in vocab.ORGANIZE_STATUSES])


def claimability(items: DataFrame, stage: str) -> DataFrame:
    """Where pending rows stand.  Buckets follow their own tests and may overlap."""
    pending = (F.col("source") == "photos") & (F.col(f"{stage}_status") == "pending")
    removed, open_ = F.col("is_removed"), F.col("access_state") == "available"
    named = F.coalesce(F.length("external_id") > 0, F.lit(False))
    return items.agg(
        _count(pending, "pending_total"), _count(pending & open_ & ~removed & named, "claimable"),
        _count(pending & ~removed & ~named, "missing_id"), _count(pending & removed, "removed"),
        _count(pending & ~open_ & ~removed, "inaccessible"))


def failure_summary(items: DataFrame, status: str, error: str, attempts: str) -> DataFrame:
    """Total, per error code and per attempt count, as ``(section, label, failures)``; one grouping-sets pass."""
    failed = items.filter((F.col("source") == "photos") & (F.col(status) == "failed")).select(
        F.coalesce(F.col(error), F.lit("(nil)")).alias("code"),
        F.concat(F.lit("attempts="), F.col(attempts).cast("string")).alias("bucket"))
    sets = failed.groupingSets([[F.col("code")], [F.col("bucket")], []], "code", "bucket").agg(
        F.count(F.lit(1)).alias("failures"), F.grouping_id().alias("level"))
    section = F.when(F.col("level") == 1, "code").when(F.col("level") == 2, "attempts").otherwise("total")
    return sets.select(section.alias("section"), F.coalesce("code", "bucket", F.lit("total")).alias("label"), "failures")


def evaluation_stats(labelled: DataFrame) -> DataFrame:
    """Totals per label and decision, and rates that are 0 when nothing is labelled."""
    label, decision = F.col("label"), F.col("decision")
    auto = decision.isin("reuse", "create")
    totals = labelled.agg(
        F.count(F.lit(1)).alias("total"), _count(F.coalesce(auto, F.lit(False)), "auto_filed"),
        _count(label == "correct", "correct"), _count(label == "wrongCollection", "wrong_file"),
        _count(label == "shouldBeNeedsReview", "should_be_review"), _count(label == "wrongCollectionName", "wrong_name"),
        _count(F.coalesce(decision == "needsReview", F.lit(False)), "review_decisions"),
        _count(F.coalesce((label == "correct") & (decision == "reuse"), F.lit(False)), "reuse_correct"),
        _count(F.coalesce((label == "correct") & (decision == "create"), F.lit(False)), "create_correct"))
    rate = lambda c: F.when(F.col("total") > 0, F.round(F.col(c) / F.col("total"), 6)).otherwise(0.0)
    return totals.withColumns({
        "coverage": rate("auto_filed"), "correct_rate": rate("correct"), "wrong_rate": rate("wrong_file"),
        "review_rate": rate("review_decisions")})


def cleanup_overview(dup_members: DataFrame, old: DataFrame) -> DataFrame:
    """Items in duplicate groups of two or more, number of such groups, and old items."""
    groups = dup_members.groupBy("group_id").agg(F.count(F.lit(1)).alias("size")).filter("size >= 2")
    sums = groups.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("duplicate_items"), F.count(F.lit(1)).alias("duplicate_groups"))
    return sums.crossJoin(old.agg(F.count(F.lit(1)).alias("old_items")))  # one row each


def duplicate_groups(dup_members: DataFrame) -> DataFrame:
    """Stored groups with at least two items, as member rows (a group may be too large for one array)."""
    sizes = dup_members.groupBy("group_id").agg(F.count(F.lit(1)).alias("size")).filter("size >= 2")
    return dup_members.join(sizes, "group_id")


def cloud_calls(runs: DataFrame) -> DataFrame:
    return runs.agg(_count(~F.startswith("provider", F.lit("ondevice")), "cloud_calls"))


def next_positions(memberships: DataFrame) -> DataFrame:
    """The first free position of each collection."""
    return memberships.groupBy("collection_id").agg((F.max("position") + 1).alias("next_position"))


def counts_by(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
