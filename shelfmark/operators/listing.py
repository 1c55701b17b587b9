"""Read-side listings: visible items, pages, claimable work, collection cards and pickers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark import vocab
from shelfmark.functions import values as vx
from shelfmark.operators.ranking import latest_by, top_k



def newest_first(prefix: str = "", columns: Sequence[str] = ("created_at", "imported_at", "item_id")) -> list[Column]:
    return [F.col(prefix + c).desc_nulls_last() for c in columns]


def is_visible(prefix: str = "") -> Column:
    return ~F.col(prefix + "is_removed") & (F.col(prefix + "access_state") == "available")


def visible_items(items: DataFrame) -> DataFrame:
    return items.filter(is_visible())


def recent_items(items: DataFrame, limit: int) -> DataFrame:
    return visible_items(items).orderBy(*newest_first(columns=("created_at", "item_id"))).limit(limit)


def item_page(items: DataFrame, offset: int, limit: int) -> DataFrame:
    """One page in a total order; a negative offset or a limit below one gives no rows."""
    if offset < 0 or limit <= 0:
        return items.limit(0)
    return visible_items(items).orderBy(*newest_first()).offset(offset).limit(limit)


def item_page_after(items: DataFrame, created_at, imported_at, item_id, limit: int) -> DataFrame:
    """The page after a known row.  Skipped rows are filtered in the scan instead of sorted and dropped."""
    c, i, k = F.col("created_at"), F.col("imported_at"), F.col("item_id")
    tie = (i < F.lit(imported_at)) | ((i == F.lit(imported_at)) & (k < F.lit(item_id)))
    if created_at is None:
        later = c.isNull() & tie
    else:
        later = c.isNull() | (c < F.lit(created_at)) | ((c == F.lit(created_at)) & tie)
    return visible_items(items).filter(later).orderBy(*newest_first()).limit(limit)


def old_items(items: DataFrame, as_of: Column, months: int = 6) -> DataFrame:
    return visible_items(items).filter(F.col("created_at") < vx.months_before(as_of, months))


# ---- claimable work --------------------------------------------------------------------------------


def claimable_organize(items: DataFrame, now: Column, limit: int | None = None) -> DataFrame:
    """Rows the organise stage may take next, pending first, newest first."""
    status = F.col("organize_status")
    waited = F.col("updated_at") <= now - F.make_interval(secs=F.lit(vocab.ORGANIZE_BACKOFF_SECONDS))
    settled = F.col("ocr_status").isin("completed", "failed") & F.col("visual_status").isin(
        "completed", "failed", "inaccessible")
    eligible = (status.isin("pending", "failed") | ((status == "pendingNetwork") & waited)
                | ((status == "idle") & settled))
    rank = F.when(status == "pending", 0).when(status == "pendingNetwork", 1).when(status == "failed", 2).otherwise(3)
    rows = items.filter(is_visible() & ~F.col("organize_locked") & eligible).withColumn("claim_rank", rank)
    if limit is None:
        return rows
    return rows.orderBy("claim_rank", *newest_first(columns=("created_at", "item_id"))).limit(limit)


def claimable_stage(items: DataFrame, stage: str, limit: int | None = None) -> DataFrame:
    """Pending rows of the text or visual stage that name an asset, newest first."""
    rows = items.filter(
        is_visible() & (F.col("source") == "photos") & (F.col(f"{stage}_status") == "pending")
        & F.col("external_id").isNotNull() & (F.length("external_id") > 0))
    if limit is None:
        return rows
    return rows.orderBy(*newest_first(columns=("created_at", "item_id"))).limit(limit)


def pending_peers(items: DataFrame, keys: Sequence[str], limit: int = vocab.POOL_SIZE) -> DataFrame:
    """The newest unlocked rows still to be organised, ``limit`` per library key."""
    rows = items.filter(~F.col("is_removed") & ~F.col("organize_locked") & F.col("organize_status").isin(
        "pending", "pendingNetwork", "failed", "idle"))
    return top_k(rows, keys, newest_first(columns=("created_at", "item_id")), limit, "peer_rank")


def status_page(items: DataFrame, stage: str, status: str, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    if limit <= 0:
        return items.limit(0)
    rows = items.filter((F.col("source") == "photos") & ~F.col("is_removed") & (F.col(f"{stage}_status") == status))
    return rows.orderBy(*order).offset(max(0, offset)).limit(limit)


# ---- collections -----------------------------------------------------------------------------------


def collection_members(items: DataFrame, memberships: DataFrame) -> DataFrame:
    return memberships.select("collection_id", "item_id").join(items, "item_id")


def eligible_collections(collections: DataFrame, aliases: DataFrame, profiles: DataFrame) -> DataFrame:
    """Live collections with their alias list and profile arrays."""
    names = aliases.groupBy("collection_id").agg(F.array_sort(F.collect_set("normalized_alias")).alias("aliases"))
    empty = F.array().cast("array<string>")
    return (
        collections.filter(~F.col("is_archived"))
        .join(names, "collection_id", "left").join(profiles, "collection_id", "left")
        .withColumns({c: F.coalesce(c, empty) for c in ("aliases", "key_entities", "key_terms")}))


def contains_all(memberships: DataFrame, selected: DataFrame) -> DataFrame:
    """Collections holding every selected item; the selection is counted once, on its own."""
    wanted = selected.select("item_id").distinct()
    size = wanted.agg(F.count(F.lit(1)).alias("wanted"))
    held = memberships.join(wanted, "item_id").groupBy("collection_id").agg(F.countDistinct("item_id").alias("held"))
    return held.crossJoin(F.broadcast(size)).filter("held = wanted").select("collection_id")  # one row


def picker_without(collections: DataFrame, collection_id) -> DataFrame:
    return collections.filter((F.col("collection_id") != F.lit(collection_id)) & (F.col("kind") != "unassigned"))


def picker_without_full(collections: DataFrame, memberships: DataFrame, selected: DataFrame) -> DataFrame:
    """Collections still worth offering: those that hold all selected items are left out."""
    return collections.filter(F.col("kind") != "unassigned").join(
        contains_all(memberships, selected), "collection_id", "left_anti")


def newest_per_collection(items: DataFrame, memberships: DataFrame, limit: int = 3, columns=("item_id",)) -> DataFrame:
    shown = collection_members(visible_items(items), memberships)
    return top_k(shown, ["collection_id"], newest_first(), limit).select("collection_id", "rank", *columns)


def _in_rank_order(value: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("rank", value))), lambda x: x[value])


def collection_cards(collections: DataFrame, items: DataFrame, memberships: DataFrame, previews: int = 3) -> DataFrame:
    """Visible count, newest visible items, and newest external ids (which do not look at the removed flag)."""
    joined = memberships.select("collection_id", "item_id").join(
        items.select("item_id", "external_id", "created_at", "imported_at", "is_removed", "access_state")
        .filter(F.col("access_state") == "available"), "item_id")
    counts = joined.filter(~F.col("is_removed")).groupBy("collection_id").agg(F.count(F.lit(1)).alias("member_count"))
    shown = top_k(joined.filter(~F.col("is_removed")), ["collection_id"], newest_first(), previews)
    named = top_k(joined.filter(F.col("external_id").isNotNull()), ["collection_id"], newest_first(), previews)
    heads = shown.groupBy("collection_id").agg(_in_rank_order("item_id").alias("preview_items"))
    assets = named.groupBy("collection_id").agg(_in_rank_order("external_id").alias("preview_assets"))
    cards = collections
    for part in (counts, heads, assets):
        cards = cards.join(part, "collection_id", "left")
    return cards.withColumn("member_count", F.coalesce("member_count", F.lit(0)))


def promoted_collections(cards: DataFrame) -> DataFrame:
    """Pinned, user-made or well-filled collections, in list order (``promoted_order``)."""
    return cards.filter(
        (F.col("kind") != "unassigned") & ~F.col("is_archived")
        & (F.col("is_pinned") | (F.col("kind") == "userContext") | (F.col("member_count") >= 3)))


def promoted_order() -> list[Column]:
    return [F.asc("sort_order"), F.lower("title").asc(), F.asc("collection_id")]


def suggestions(cards: DataFrame, limit: int = 8, fallback: Sequence[str] = vocab.SUGGESTION_FALLBACK) -> DataFrame:
    """Titles of the first promoted collections; the fixed list only when there are none."""
    spark = cards.sparkSession
    first = promoted_collections(cards).orderBy(*promoted_order()).limit(limit).select(
        F.lit(0).alias("origin"), F.col("title"))
    fixed = spark.createDataFrame([(1, t) for t in fallback], "origin int, title string")
    both = first.unionByName(fixed)
    origin = both.agg(F.min("origin").alias("origin"))
    return both.join(F.broadcast(origin), "origin").select("title")  # one row


def review_queue(items: DataFrame, collections: DataFrame, memberships: DataFrame) -> DataFrame:
    """Visible items in the review inbox."""
    inbox = collections.filter(F.col("kind") == "unassigned").select("collection_id")
    return visible_items(items).join(memberships.join(inbox, "collection_id", "left_semi").select("item_id").distinct(), "item_id")


def review_summary(items: DataFrame, collections: DataFrame, memberships: DataFrame, previews: int = 3) -> DataFrame:
    """How many items wait in review, and the newest of them."""
    queue = review_queue(items, collections, memberships).withColumn("inbox", F.lit(0))
    newest = top_k(queue, ["inbox"], newest_first(), previews).agg(_in_rank_order("item_id").alias("newest"))
    return queue.agg(F.count(F.lit(1)).alias("waiting")).crossJoin(newest)  # one row each


def home_summary(cards: DataFrame, review: DataFrame) -> DataFrame:
    """Promoted collections plus the review teaser, tagged by section."""
    rows = promoted_collections(cards).select(
        F.lit("collection").alias("section"), F.col("title"), F.col("member_count"),
        F.array_join(F.transform("preview_items", lambda x: x.cast("string")), ",").alias("items"))
    teaser = review.filter("waiting > 0").select(
        F.lit("review").alias("section"), F.lit("Review").alias("title"), F.col("waiting").alias("member_count"),
        F.array_join(F.transform("newest", lambda x: x.cast("string")), ",").alias("items"))
    return rows.unionByName(teaser)


# ---- runs ------------------------------------------------------------------------------------------


def latest_runs(runs: DataFrame) -> DataFrame:
    """The newest run of each item; equal times go to the higher run id."""
    return latest_by(runs, ["item_id"], ["started_at", "run_id"])


def labelled_decisions(evals: DataFrame, runs: DataFrame) -> DataFrame:
    """Each human label with the item's latest decision; one row per label even when runs tie."""
    return evals.join(latest_runs(runs).select("item_id", "decision"), "item_id", "left")


def item_debug_view(items: DataFrame, runs: DataFrame, memberships: DataFrame, collections: DataFrame) -> DataFrame:
    """Rows not removed, with the latest decision and the titles and sources of their collections."""
    places = memberships.join(collections.select("collection_id", "title"), "collection_id").groupBy("item_id").agg(
        F.array_sort(F.collect_list(F.concat_ws("/", "title", "source"))).alias("places"))
    last = latest_runs(runs).select("item_id", "run_id", "decision", "error_code")
    return (items.filter(~F.col("is_removed")).join(last, "item_id", "left").join(places, "item_id", "left"))
