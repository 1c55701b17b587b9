"""Stage bookkeeping as table updates: stale claims, retries, outcomes, barriers and resets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark import vocab
from shelfmark.functions import values as vx
from shelfmark.operators.listing import is_visible
from shelfmark.operators.ranking import group_row_number

CLAIM_SECONDS = {"ocr": vocab.TEXT_CLAIM_SECONDS, "visual": vocab.VISUAL_CLAIM_SECONDS}
TERMINAL = ("completed", "failed", "inaccessible")


def _change(items: DataFrame, test: Column, values: dict[str, Column]) -> DataFrame:
    """Set columns where ``test`` holds; an unknown test counts as false."""
    types = dict(items.dtypes)
    changes = {c: F.when(F.col("_hit"), v.cast(types[c])).otherwise(F.col(c)) for c, v in values.items() if c in types}
    return items.withColumn("_hit", F.coalesce(test, F.lit(False))).withColumns(changes).drop("_hit")


def _clear(stage: str, *names: str) -> dict[str, Column]:
    return {f"{stage}_{n}": F.lit(None) for n in names}


def recover_stale_claims(items: DataFrame, stage: str, now: Column) -> DataFrame:
    """A claim older than the stage allows goes back to pending."""
    claimed = F.col(f"{stage}_claimed_at")
    limit = now - F.make_interval(secs=F.lit(CLAIM_SECONDS[stage]))
    stale = is_visible() & (F.col(f"{stage}_status") == "processing") & (claimed.isNull() | (claimed < limit))
    return _change(items, stale, {f"{stage}_status": F.lit("pending"), **_clear(stage, "claimed_at"), "updated_at": now})


def requeue_stale_or_due(items: DataFrame, stage: str, version: int, now: Column) -> DataFrame:
    """Completed by an older version, or failed with a retry time that has come."""
    status = F.col(f"{stage}_status")
    due = (status == "completed") & (F.col(f"{stage}_version") < version)
    if f"{stage}_next_retry_at" in items.columns:
        retry = F.col(f"{stage}_next_retry_at")
        due = due | ((status == "failed") & retry.isNotNull() & (retry <= now))
    return _change(items, is_visible() & (F.col("source") == "photos") & due,
                   {f"{stage}_status": F.lit("pending"), **_clear(stage, "claimed_at", "next_retry_at"), "updated_at": now})


def apply_outcomes(items: DataFrame, outcomes: DataFrame, stage: str) -> DataFrame:
    """Fold ``outcomes(item_id, seq, at, result, version, error)`` into the item rows.

    ``result`` is success, failure or missing.  The newest outcome decides the status.  Each failure adds
    an attempt, success does not reset the count, and a missing asset is terminal.
    """
    newest = F.max(F.struct("at", "seq", "result", "version", "error")).alias("_last")
    folded = outcomes.groupBy("item_id").agg(newest, F.count_if(F.col("result") == "failure").alias("_failures"))
    joined = items.join(folded, "item_id", "left")
    result, at = F.col("_last.result"), F.col("_last.at")
    attempts = F.col(f"{stage}_attempts") + F.coalesce("_failures", F.lit(0))
    delay = vx.retry_delay_seconds(attempts)
    hit = result.isNotNull()
    columns = {
        f"{stage}_status": F.when(result == "success", "completed").when(result == "failure", "failed")
        .when(result == "missing", "inaccessible").otherwise(F.col(f"{stage}_status")),
        f"{stage}_version": F.when(result == "success", F.col("_last.version")).otherwise(F.col(f"{stage}_version")).cast("int"),
        f"{stage}_attempts": attempts.cast("int"),
        f"{stage}_claimed_at": F.when(~hit, F.col(f"{stage}_claimed_at")),
        "access_state": F.when(result == "missing", "inaccessible").otherwise(F.col("access_state")),
        "updated_at": F.coalesce(at, F.col("updated_at")),
    }
    if f"{stage}_next_retry_at" in items.columns:
        retry = F.timestamp_micros(F.unix_micros(at) + delay * 1_000_000)
        columns[f"{stage}_next_retry_at"] = F.when(result == "failure", retry).when(~hit, F.col(f"{stage}_next_retry_at"))
    if f"{stage}_error" in items.columns:
        columns[f"{stage}_error"] = F.when(result.isin("failure", "missing"), F.left(F.col("_last.error"), F.lit(64))).when(
            ~hit, F.col(f"{stage}_error"))
    kept = [F.col(c) for c in items.columns if c not in columns]
    return joined.select(*kept, *[v.alias(k) for k, v in columns.items() if k in items.columns]).select(*items.columns)


def failure_attempts(failures: DataFrame, order: list[str]) -> DataFrame:
    """Number each failure of an item and give the delay before its retry (none from the eighth on).

    One item may own a large share of all failures, so the numbering does not gather an item in one task.
    """
    numbered = group_row_number(failures, ["item_id"], [F.asc(c) for c in order], "attempt")
    return numbered.withColumn("retry_seconds", vx.retry_delay_seconds(F.col("attempt")))


def readiness_barrier(items: DataFrame, now: Column) -> DataFrame:
    """Both stages are terminal, the row is unlocked and resumable: organise becomes pending."""
    ready = (
        F.col("ocr_status").isin(*TERMINAL) & F.col("visual_status").isin(*TERMINAL) & ~F.col("organize_locked")
        & F.col("organize_status").isin("idle", "pendingNetwork", "failed", "skippedNoConsent"))
    return _change(items, ready, {"organize_status": F.lit("pending"), "updated_at": now})


def reprocess(items: DataFrame, stage: str, now: Column, chosen: DataFrame | None = None) -> DataFrame:
    """Clear a stage's outputs and counters, for ``chosen`` rows or for all photo rows."""
    values = {f"{stage}_status": F.lit("pending"), f"{stage}_version": F.lit(0), f"{stage}_attempts": F.lit(0),
              **_clear(stage, "claimed_at", "next_retry_at", "error"), "updated_at": now}
    if chosen is None:
        return _change(items, is_visible() & (F.col("source") == "photos"), values)
    marks = chosen.select("item_id").distinct().withColumn("_chosen", F.lit(True))
    return _change(items.join(marks, "item_id", "left"), is_visible() & F.col("_chosen"), values).drop("_chosen")


def requeue_skipped(items: DataFrame, now: Column) -> DataFrame:
    """Rows skipped for missing consent become pending."""
    skipped = (F.col("organize_status") == "skippedNoConsent") & ~F.col("organize_locked") & ~F.col("is_removed")
    return _change(items, skipped, {"organize_status": F.lit("pending"), "updated_at": now})


def requeue_chosen(items: DataFrame, chosen: DataFrame, now: Column) -> DataFrame:
    """Chosen unlocked rows become pending without a fingerprint, dated one minute back."""
    marks = chosen.select("item_id").distinct().withColumn("_chosen", F.lit(True))
    test = F.col("_chosen") & ~F.col("is_removed") & ~F.col("organize_locked")
    back = now - F.make_interval(mins=F.lit(1))
    return _change(items.join(marks, "item_id", "left"), test, {
        "organize_status": F.lit("pending"), "fingerprint": F.lit(None), "updated_at": back}).drop("_chosen")


def needs_work(items: DataFrame, version: int = vocab.RESOLVER_VERSION) -> DataFrame:
    """Leave out rows that this resolver version has already settled."""
    fresh = (F.col("resolver_version") == version) & (F.col("organize_status") == "ready")
    return items.filter(~F.coalesce(fresh, F.lit(False)))
