"""Upkeep of the item-to-collection table: every change takes tables and returns tables.

Membership rows are ``(item_id, collection_id, source, confidence, created_at, position)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark import vocab
from shelfmark.functions import text as tx
from shelfmark.operators.ranking import group_row_number, top_k

COLUMNS = ("item_id", "collection_id", "source", "confidence", "created_at", "position")


def _inbox(collections: DataFrame) -> DataFrame:
    """The id of the one review collection, as a frame of exactly one row."""
    return collections.filter(F.col("kind") == "unassigned").agg(F.min("collection_id").alias("collection_id"))


def _into_inbox(items: DataFrame, collections: DataFrame) -> DataFrame:
    return items.crossJoin(F.broadcast(_inbox(collections)))  # one row


def _new_rows(memberships: DataFrame, pairs: DataFrame, now: Column, source: str = "user") -> DataFrame:
    """Rows for new ``pairs(item_id, collection_id)``, placed after the last position of their collection.

    Only pairs are numbered.  The numbering copes with one collection that receives most of the pairs.
    """
    last = memberships.groupBy("collection_id").agg(F.max("position").alias("last"))
    numbered = group_row_number(pairs.select("item_id", "collection_id"), ["collection_id"], [F.asc("item_id")], "n")
    types = dict(memberships.dtypes)
    return numbered.join(last, "collection_id", "left").select(
        F.col("item_id").cast(types["item_id"]), F.col("collection_id").cast(types["collection_id"]),
        F.lit(source).alias("source"), F.lit(None).cast("double").alias("confidence"), now.alias("created_at"),
        (F.coalesce("last", F.lit(-1)) + F.col("n")).cast(types["position"]).alias("position"))


def enter_review(memberships: DataFrame, collections: DataFrame, items: DataFrame, now: Column) -> DataFrame:
    """``memberships`` with ``items(item_id)`` at the end of the review collection."""
    pairs = _into_inbox(items.select("item_id").distinct(), collections)
    return memberships.select(*COLUMNS).unionByName(_new_rows(memberships, pairs, now).select(*COLUMNS))


def review_invariant(memberships: DataFrame, collections: DataFrame, scope: DataFrame, now: Column) -> DataFrame:
    """For the items of ``scope``: in review exactly when they belong to no normal collection.

    Review rows kept or added count as set by the user.  Other items are left alone.
    """
    inbox = _inbox(collections).withColumn("_review", F.lit(True))
    marked = memberships.join(inbox, "collection_id", "left").withColumn("_review", F.coalesce("_review", F.lit(False)))
    wanted = scope.select("item_id").distinct()
    state = (
        wanted.join(marked.groupBy("item_id").agg(F.max(~F.col("_review")).alias("_normal"), F.max("_review").alias("_held")),
                    "item_id", "left")
        .select("item_id", F.coalesce("_normal", F.lit(False)).alias("_normal"), F.coalesce("_held", F.lit(False)).alias("_held")))
    kept = marked.join(state, "item_id", "left").filter(~(F.col("_review") & F.coalesce("_normal", F.lit(False))))
    kept = kept.withColumn("source", F.when(F.col("_review") & ~F.coalesce("_normal", F.lit(True)), "user").otherwise(F.col("source")))
    waiting = state.filter(~F.col("_normal") & ~F.col("_held")).select("item_id")
    waiting = _into_inbox(waiting, collections)
    return kept.select(*COLUMNS).unionByName(_new_rows(memberships, waiting, now).select(*COLUMNS))


def move_items(memberships, collections, items: DataFrame, destination, now: Column) -> DataFrame:
    """Exclusive: the items leave every collection and enter ``destination``."""
    moved = items.select("item_id").distinct()
    rest = memberships.join(moved, "item_id", "left_anti").select(*COLUMNS)
    pairs = moved.withColumn("collection_id", F.lit(destination))
    return review_invariant(rest.unionByName(_new_rows(rest, pairs, now).select(*COLUMNS)), collections, moved, now)


def add_items(memberships, collections, items: DataFrame, destination, now: Column) -> DataFrame:
    """Additive: missing pairs are added, present ones become the user's.  Not for the review inbox."""
    added = items.select("item_id").distinct()
    here = F.col("collection_id") == F.lit(destination)
    touched = memberships.join(added.withColumn("_add", F.lit(True)), "item_id", "left")
    kept = touched.withColumn("source", F.when(here & F.col("_add"), "user").otherwise(F.col("source"))).select(*COLUMNS)
    missing = added.join(memberships.filter(here).select("item_id"), "item_id", "left_anti").withColumn(
        "collection_id", F.lit(destination))
    return review_invariant(kept.unionByName(_new_rows(memberships, missing, now).select(*COLUMNS)), collections, added, now)


def remove_items_from(memberships, collections, items: DataFrame, collection_id, now: Column) -> DataFrame:
    """Drop the pairs of one collection; items left without any normal collection return to review."""
    gone = items.select("item_id").distinct().withColumn("collection_id", F.lit(collection_id))
    return review_invariant(memberships.join(gone, ["item_id", "collection_id"], "left_anti"), collections, gone, now)


def delete_collection(memberships, collections, collection_id, now: Column) -> tuple[DataFrame, DataFrame]:
    """``(collections, memberships)`` without the collection; its items elsewhere stay, the others go to review.

    The review collection itself can't be deleted: then both tables come back as they are.
    """
    doomed = _deletable(collections, collection_id)
    orphans = memberships.join(doomed, "collection_id", "left_semi").select("item_id").distinct()
    rest = memberships.join(doomed, "collection_id", "left_anti").select(*COLUMNS)
    alone = orphans.join(rest.select("item_id"), "item_id", "left_anti")
    pairs = _into_inbox(alone, collections)
    return collections.join(doomed, "collection_id", "left_anti").select(*collections.columns), rest.unionByName(_new_rows(rest, pairs, now).select(*COLUMNS))


def delete_collection_and_items(items, memberships, dup_members, postings, collections, collection_id) -> dict[str, DataFrame]:
    """Delete a collection with all its items, also where they are members elsewhere; the review collection stays."""
    doomed = _deletable(collections, collection_id)
    gone = memberships.join(doomed, "collection_id", "left_semi").select("item_id")
    return remove_items(items, memberships, dup_members, postings, gone) | {
        "collections": collections.join(doomed, "collection_id", "left_anti").select(*collections.columns)}


def _deletable(collections: DataFrame, collection_id) -> DataFrame:
    """One row or none."""
    return collections.filter((F.col("collection_id") == F.lit(collection_id)) & (F.col("kind") != "unassigned")).select("collection_id").distinct()


def remove_items(items, memberships, dup_members, postings, gone: DataFrame) -> dict[str, DataFrame]:
    """Delete items everywhere: rows, memberships, index rows and duplicate groups.

    ``dup_members(group_id, item_id, position, keep_id)``; groups left with fewer than two members go, and
    a recommended item that was deleted is replaced by the group's first remaining member.
    """
    drop = gone.select("item_id").distinct()
    left = dup_members.join(drop, "item_id", "left_anti")
    first = left.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("_size"), F.min_by("item_id", "position").alias("_first"),
        F.max(F.col("item_id") == F.col("keep_id")).alias("_kept"))
    groups = left.join(first.filter("_size >= 2"), "group_id").withColumn(
        "keep_id", F.when(F.col("keep_id").isNull() | F.col("_kept"), F.col("keep_id")).otherwise(F.col("_first")))
    return {
        "items": items.join(drop, "item_id", "left_anti"),
        "memberships": memberships.join(drop, "item_id", "left_anti").select(*memberships.columns),
        "postings": postings.join(drop, "item_id", "left_anti").select(*postings.columns),
        "dup_members": groups.select("group_id", "item_id", "position", "keep_id"),
    }


def lock_items(items: DataFrame, chosen: DataFrame) -> DataFrame:
    """A user correction locks the item against automatic filing."""
    marks = chosen.select("item_id").distinct().withColumn("_lock", F.lit(True))
    hit = F.col("_lock").isNotNull()
    return items.join(marks, "item_id", "left").withColumns({
        "organize_locked": F.when(hit, True).otherwise(F.col("organize_locked")),
        "organize_status": F.when(hit, "locked").otherwise(F.col("organize_status"))}).drop("_lock")


def attach_decisions(
    items: DataFrame, memberships: DataFrame, collections: DataFrame, decisions: DataFrame, now: Column,
    version: int = vocab.RESOLVER_VERSION,
) -> tuple[DataFrame, DataFrame]:
    """Apply resolver decisions ``(item_id, decision, collection_id, confidence)``; returns items, memberships.

    Locked items only get their status.  An item with any user membership is locked and its memberships
    stay.  A filed item leaves review and has its pair inserted or refreshed as an automatic one.
    """
    by_user = memberships.groupBy("item_id").agg(F.max(F.col("source") == "user").alias("_user"))
    known = decisions.join(items.select("item_id", "organize_locked"), "item_id").join(by_user, "item_id", "left")
    outcome = (F.when(F.col("organize_locked"), "locked").when(F.coalesce("_user", F.lit(False)), "keep")
               .when(F.col("decision").isin("reuse", "create") & F.col("collection_id").isNotNull(), "file")
               .when(F.col("decision").isin("needsReview", "skipped"), "review").otherwise("none"))
    applied = known.select("item_id", "collection_id", "confidence", outcome.alias("_outcome"))
    filed = applied.filter("_outcome = 'file'")
    inbox = _inbox(collections).withColumn("_review", F.lit(True))
    kept = (
        memberships.join(inbox, "collection_id", "left")
        .join(filed.select("item_id", F.col("collection_id").alias("_to"), F.col("confidence").alias("_score")), "item_id", "left")
        .filter(~(F.col("_to").isNotNull() & F.coalesce("_review", F.lit(False)))))
    same = F.coalesce(F.col("_to") == F.col("collection_id"), F.lit(False))
    kept = kept.withColumns({
        "source": F.when(same, "ai").otherwise(F.col("source")),
        "confidence": F.when(same, F.col("_score")).otherwise(F.col("confidence"))}).select(*COLUMNS)
    types = dict(memberships.dtypes)
    fresh = filed.join(memberships.select("item_id", "collection_id"), ["item_id", "collection_id"], "left_anti").select(
        F.col("item_id"), F.col("collection_id").cast(types["collection_id"]), F.lit("ai").alias("source"),
        F.col("confidence"), now.alias("created_at"), F.lit(0).cast(types["position"]).alias("position"))
    table = review_invariant(kept.unionByName(fresh), collections, applied.filter("_outcome = 'review'"), now)
    done = F.col("_outcome").isin("file", "review")
    updated = items.join(applied.select("item_id", "_outcome"), "item_id", "left").withColumns({
        "organize_status": F.when(F.col("_outcome").isin("locked", "keep"), "locked").when(done, "ready")
        .otherwise(F.col("organize_status")),
        "organize_locked": F.when(F.col("_outcome") == "keep", True).otherwise(F.col("organize_locked")),
        "resolver_version": F.when(done | (F.col("_outcome") == "keep"), F.lit(version)).otherwise(F.col("resolver_version")),
    }).drop("_outcome")
    return updated, table


# ---- equal titles ----------------------------------------------------------------------------------


def title_survivors(collections: DataFrame, memberships: DataFrame) -> DataFrame:
    """``(collection_id, winner_id, normalized_title)``: most members, then oldest, then lowest id survives.

    The survivor comes from an aggregate with map-side combine, so one very common title is no problem.
    """
    counts = memberships.groupBy("collection_id").agg(F.count(F.lit(1)).alias("_members"))
    named = (
        collections.filter(F.col("kind") != "unassigned").join(counts, "collection_id", "left")
        .withColumn("normalized_title", tx.normalize_title(F.col("title"))))
    best = F.min(F.struct((-F.coalesce("_members", F.lit(0))).alias("n"), F.col("created_at").alias("c"),
                          F.col("collection_id").alias("winner_id"))).alias("_best")
    winners = named.groupBy("normalized_title").agg(best).select("normalized_title", "_best.winner_id")
    return named.select("collection_id", "normalized_title").join(winners, "normalized_title").select(
        "collection_id", "winner_id", "normalized_title")


def merge_equal_titles(collections, memberships, aliases, runs, now: Column) -> dict[str, DataFrame]:
    """One collection per normalised title; memberships, aliases and run decisions follow the survivor."""
    mapping = title_survivors(collections, memberships)
    losers = mapping.filter("collection_id <> winner_id").select("collection_id", "winner_id")
    counts = memberships.groupBy("collection_id").agg(F.count(F.lit(1)).alias("_members"))
    order = losers.join(counts, "collection_id", "left").join(
        collections.select("collection_id", F.col("created_at").alias("_made")), "collection_id").select(
        "collection_id", "winner_id", F.struct((-F.coalesce("_members", F.lit(0))).alias("n"), "_made", "collection_id").alias("_loser"))
    moved = memberships.join(order, "collection_id", "left").withColumn("_to", F.coalesce("winner_id", "collection_id"))
    # The survivor's own row is first (its _loser is null, and nulls are the lowest); a user source always wins.
    first = F.min(F.struct(F.col("_loser"), "source", "confidence", "created_at", "position")).alias("_row")
    merged = moved.groupBy("item_id", F.col("_to").alias("collection_id")).agg(
        first, F.max(F.col("source") == "user").alias("_user"))
    rows = merged.select(
        "item_id", "collection_id", F.when(F.col("_user"), "user").otherwise(F.col("_row.source")).alias("source"),
        "_row.confidence", "_row.created_at", "_row.position", F.col("_row._loser").isNotNull().alias("_moved"))
    arrivals = _new_rows(memberships, rows.filter("_moved").select("item_id", "collection_id"), now).select(
        "item_id", "collection_id", F.col("position").alias("_position"))
    rows = rows.join(arrivals, ["item_id", "collection_id"], "left").withColumn(
        "position", F.coalesce("_position", "position")).select(*COLUMNS)
    survivors = collections.join(losers.select("collection_id"), "collection_id", "left_anti")
    affected = memberships.join(losers.select("collection_id"), "collection_id", "left_semi").select("item_id").distinct()
    titles = mapping.filter("collection_id = winner_id").select("collection_id", "normalized_title")
    carried = aliases.join(losers, "collection_id", "left").withColumn("_came", F.col("winner_id").isNotNull()).withColumn(
        "collection_id", F.coalesce("winner_id", "collection_id"))
    own = F.min(F.struct("_came", "created_at", "alias_title")).alias("_row")
    names = carried.groupBy("collection_id", "normalized_alias").agg(own).join(titles, "collection_id", "left").filter(
        ~(F.col("_row._came") & F.coalesce(F.col("normalized_alias") == F.col("normalized_title"), F.lit(False)))).select(
        "collection_id", "_row.alias_title", "normalized_alias", "_row.created_at")
    repointed = runs.join(losers.select(F.col("collection_id").alias("decision_collection_id"), "winner_id"),
                          "decision_collection_id", "left").withColumn(
        "decision_collection_id", F.coalesce("winner_id", "decision_collection_id")).drop("winner_id")
    return {"collections": survivors, "memberships": review_invariant(rows, survivors, affected, now),
            "aliases": names, "runs": repointed}


# ---- titles and ids --------------------------------------------------------------------------------


def find_or_create(
    collections: DataFrame, requests: DataFrame, now: Column, new_id=None, kind: str = "userContext", created_by: str = "user",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Create collections for ``requests(request_id, title)`` unless the normalised title exists.

    Returns the answers ``(request_id, collection_id, created)``, the new rows, and the rejected requests.
    Equal new titles give one collection (the lowest request id names it).  Ids derive from the title, so
    a retry gives the same id.
    """
    new_id = new_id or (lambda normalized: F.sha2(normalized, 256))
    trimmed = requests.select("request_id", tx.strip(F.col("title")).alias("title")).withColumn(
        "normalized_title", tx.normalize_title(F.col("title")))
    valid = trimmed.filter(F.col("title") != "")
    rejects = trimmed.filter(F.coalesce(F.col("title") == "", F.lit(True))).select(
        "request_id", F.lit("Name is required").alias("error"))
    key = F.min(F.struct("created_at", "collection_id")).alias("_old")
    existing = collections.filter(F.col("kind") != "unassigned").groupBy(
        tx.normalize_title(F.col("title")).alias("normalized_title")).agg(key).select(
        "normalized_title", F.col("_old.collection_id").alias("existing_id"))
    fresh = valid.join(existing, "normalized_title", "left_anti").groupBy("normalized_title").agg(
        F.min(F.struct("request_id", "title")).alias("_r")).select(
        new_id(F.col("normalized_title")).alias("collection_id"), "normalized_title", F.col("_r.title").alias("title"),
        F.col("_r.request_id").alias("_named_by"))
    last = collections.agg(F.coalesce(F.max("sort_order"), F.lit(-1)).alias("_last"))
    numbered = group_row_number(fresh, [], [F.asc("_named_by"), F.asc("normalized_title")], "_n")
    created = numbered.crossJoin(F.broadcast(last)).select(  # one row
        "collection_id", F.lit(kind).alias("kind"), "title", "normalized_title", F.lit(False).alias("is_archived"),
        F.lit(False).alias("is_pinned"), F.lit(created_by).alias("created_by"), now.alias("created_at"),
        (F.col("_last") + F.col("_n")).cast("bigint").alias("sort_order"))
    answers = valid.join(existing, "normalized_title", "left").join(
        fresh.select("normalized_title", F.col("collection_id").alias("_new")), "normalized_title", "left").select(
        "request_id", F.coalesce(F.col("existing_id").cast("string"), F.col("_new").cast("string")).alias("collection_id"),
        F.col("existing_id").isNull().alias("created"))
    return answers, created, rejects


def rename_collections(collections: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply ``requests(collection_id, new_title)``; returns collections and rejects with the reason.

    A title held by another collection is refused.  Of equal new titles the lowest collection id gets it.
    """
    named = collections.withColumn("normalized_title", tx.normalize_title(F.col("title")))
    asked = requests.select("collection_id", tx.strip(F.col("new_title")).alias("new_title")).withColumn(
        "wanted", tx.normalize_title(F.col("new_title")))
    asked = asked.join(named.select("collection_id", "kind", F.col("normalized_title").alias("held")), "collection_id", "left")
    holders = named.filter(F.col("kind") != "unassigned").groupBy(F.col("normalized_title").alias("wanted")).agg(
        F.count(F.lit(1)).alias("holders"), F.max("collection_id").alias("holder"))
    first = asked.groupBy("wanted").agg(F.min("collection_id").alias("first"))
    judged = asked.join(holders, "wanted", "left").join(first, "wanted", "left")
    others = (F.col("holders") > 1) | (F.col("holder") != F.col("collection_id"))
    error = (
        F.when(F.col("kind").isNull(), "not found").when(F.col("kind") == "unassigned", "review cannot be renamed")
        .when(F.col("new_title") == "", "name is required")
        .when(F.coalesce(others, F.lit(False)), "title exists")
        .when(F.col("first") != F.col("collection_id"), "title exists"))
    judged = judged.withColumn("error", error)
    good = judged.filter(F.col("error").isNull()).select("collection_id", "new_title")
    renamed = collections.join(good, "collection_id", "left").withColumn(
        "title", F.coalesce("new_title", "title")).drop("new_title")
    return renamed, judged.filter(F.col("error").isNotNull()).select("collection_id", "new_title", "error")


def remap_external_ids(items: DataFrame, mapping: DataFrame) -> DataFrame:
    """Replace external ids by ``mapping(previous, next)``; empty or unchanged pairs are ignored."""
    pairs = mapping.filter((F.col("previous") != F.col("next")) & (F.col("previous") != "") & (F.col("next") != ""))
    return items.join(pairs, F.col("external_id") == F.col("previous"), "left").withColumn(
        "external_id", F.coalesce("next", "external_id")).drop("previous", "next")


def dense_sort_order(collections: DataFrame) -> DataFrame:
    """Number normal collections from 0 by title (ignoring case), then id; review keeps its place."""
    normal = collections.filter(F.col("kind") != "unassigned").select("collection_id", F.lower("title").alias("_t"))
    numbered = group_row_number(normal, [], [F.asc("_t"), F.asc("collection_id")], "_n").select("collection_id", "_n")
    return collections.join(numbered, "collection_id", "left").withColumn(
        "sort_order", F.coalesce(F.col("_n") - 1, F.col("sort_order")).cast("bigint")).drop("_n")


def reorder_collections(collections: DataFrame, ordered_ids: list) -> DataFrame:
    """Give the listed collections the positions 0, 1, …"""
    wanted = collections.sparkSession.createDataFrame(
        [(i, n) for n, i in enumerate(ordered_ids)], f"collection_id {dict(collections.dtypes)['collection_id']}, _n bigint")
    place = F.when(F.col("kind") != "unassigned", F.col("_n"))
    return collections.join(wanted, "collection_id", "left").withColumn(
        "sort_order", F.coalesce(place, F.col("sort_order")).cast("bigint")).drop("_n")


# ---- profiles, aliases, requeue --------------------------------------------------------------------


def collection_profiles(items: DataFrame, memberships: DataFrame, texts: int = 12, terms: int = 12, entities: int = 8) -> DataFrame:
    """Frequent words of the newest member texts and the date range over all members.

    Both cuts are part of the profile.  The newest texts are found on narrow rows before any text moves.
    """
    pairs = memberships.select("item_id", "collection_id").join(items.select("item_id", "created_at", (F.col("ocr_text").isNotNull()).alias("_has")), "item_id")
    newest = top_k(pairs.filter("_has"), ["collection_id"],
                   [F.col("created_at").desc_nulls_last(), F.desc("item_id")], texts).select("collection_id", "item_id")
    words = newest.join(items.select("item_id", "ocr_text"), "item_id").select(
        "collection_id", F.explode(tx.words(F.lower(tx.clean_text(F.col("ocr_text"))))).alias("term"))
    counted = words.filter(F.length("term") >= 4).groupBy("collection_id", "term").agg(F.count(F.lit(1)).alias("n"))
    best = top_k(counted, ["collection_id"], [F.desc("n"), F.asc("term")], terms)
    lists = best.groupBy("collection_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("key_terms"))
    dates = pairs.groupBy("collection_id").agg(
        F.min("created_at").alias("date_range_start"), F.max("created_at").alias("date_range_end"))
    empty = F.array().cast("array<string>")
    return dates.join(lists, "collection_id", "left").withColumn("key_terms", F.coalesce("key_terms", empty)).withColumn(
        "key_entities", F.slice("key_terms", 1, entities))


def refresh_profiles(stored: DataFrame, computed: DataFrame) -> DataFrame:
    """Replace changed profiles and raise their version; new ones start at 1."""
    old = stored.select("collection_id", F.col("profile_version").alias("_old"))
    fresh = computed.join(old, "collection_id", "left").withColumn(
        "profile_version", (F.coalesce("_old", F.lit(0)) + 1).cast("int")).drop("_old")
    kept = stored.join(computed.select("collection_id"), "collection_id", "left_anti")
    return fresh.unionByName(kept.select(*fresh.columns))


def learn_aliases(collections: DataFrame, aliases: DataFrame, proposals: DataFrame, now: Column) -> DataFrame:
    """New aliases from ``proposals(collection_id, proposed_title)``: near the title, different, not yet known."""
    named = collections.select("collection_id", tx.normalize_title(F.col("title")).alias("_title"))
    asked = proposals.select("collection_id", F.col("proposed_title").alias("alias_title"),
                             tx.normalize_title(F.col("proposed_title")).alias("normalized_alias"))
    near = asked.join(named, "collection_id").filter(
        (F.col("normalized_alias") != "") & (F.col("normalized_alias") != F.col("_title"))
        & (tx.similarity(F.col("normalized_alias"), F.col("_title")) >= 0.90))
    fresh = near.join(aliases.select("collection_id", "normalized_alias"), ["collection_id", "normalized_alias"], "left_anti")
    return fresh.groupBy("collection_id", "normalized_alias").agg(F.min("alias_title").alias("alias_title")).withColumn(
        "created_at", now)


def requeue_for_version(items, memberships, collections, version: int = vocab.RESOLVER_VERSION) -> DataFrame:
    """Send review, failed and stale rows back to pending, unless a user filed the item elsewhere."""
    inbox = _inbox(collections).withColumn("_review", F.lit(True))
    held = memberships.join(inbox, "collection_id", "left").groupBy("item_id").agg(
        F.max(F.coalesce("_review", F.lit(False))).alias("_in_review"),
        F.max((F.col("source") == "user") & F.col("_review").isNull()).alias("_user_elsewhere"))
    due = (
        ~F.col("is_removed") & ~F.col("organize_locked") & (F.col("access_state") == "available")
        & F.col("_in_review").isNotNull() & ~F.coalesce("_user_elsewhere", F.lit(False))
        & (F.col("_in_review") | F.col("organize_status").isin("failed", "pendingNetwork", "skippedNoConsent")
           | F.col("resolver_version").isNull() | (F.col("resolver_version") < version)))
    due = F.coalesce(due, F.lit(False))
    joined = items.join(held, "item_id", "left").withColumn("_due", due)
    return joined.withColumns({
        "organize_status": F.when(F.col("_due"), "pending").otherwise(F.col("organize_status")),
        "resolver_version": F.when(~F.col("_due"), F.col("resolver_version")),
        "fingerprint": F.when(~F.col("_due"), F.col("fingerprint"))}).drop("_due", "_in_review", "_user_elsewhere")
