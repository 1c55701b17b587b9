"""Listing queries over items, collections, memberships and runs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from shelfmark import vocab
from shelfmark.operators import listing as op
from shelfmark.operators.ranking import top_k
from shelfmark.plans.bind import AS_OF, cell
from shelfmark.plans.registry import query

VISIBLE = "not is_removed and access_state = 'available'"
NEWEST = "created_at desc nulls last, imported_at desc, item_id desc"
VIEWS = {
    "v_shown": f"select * from v_prose where {VISIBLE}",
    "v_selected": "select doc_id as item_id from documents where lang = 'en' and source = 'src5' and n_chars between 2000 and 2400",
    "v_full": """select collection_id from v_membership where item_id in (select item_id from v_selected)
group by collection_id having count(distinct item_id) = (select count(distinct item_id) from v_selected)""",
    "v_count": "select collection_id, count(*) as member_count from v_membership join v_shown using (item_id) group by 1",
    "v_head": f"""select collection_id, string_agg(item_id::varchar, ',' order by rank) as preview_items from (
  select m.collection_id, i.item_id, row_number() over (partition by m.collection_id order by i.created_at desc nulls last,
    i.imported_at desc, i.item_id desc) as rank from v_membership m join v_shown i using (item_id)) where rank <= 3 group by 1""",
    "v_asset": f"""select collection_id, string_agg(external_id, ',' order by rank) as preview_assets from (
  select m.collection_id, i.external_id, row_number() over (partition by m.collection_id order by i.created_at desc nulls last,
    i.imported_at desc, i.item_id desc) as rank from v_membership m join v_prose i using (item_id)
  where access_state = 'available' and external_id is not null) where rank <= 3 group by 1""",
    "v_card": """select c.*, coalesce(member_count, 0) as member_count, preview_items, preview_assets from v_cell c
  left join v_count using (collection_id) left join v_head using (collection_id) left join v_asset using (collection_id)""",
    "v_promoted": """select * from v_card where kind <> 'unassigned' and not is_archived
  and (is_pinned or kind = 'userContext' or member_count >= 3)""",
    "v_waiting": """select * from v_shown where item_id in (
  select item_id from v_membership where collection_id in (select collection_id from v_collection where kind = 'unassigned'))""",
    "v_last_run": """select * exclude (r) from (select *, row_number() over (
  partition by item_id order by started_at desc, run_id desc) as r from v_run) where r = 1""",
}


def _cards(lib):
    return op.collection_cards(lib.cells, lib.prose, lib.memberships)


@query("pf1_visible_items", f"select item_id, created_at from v_prose where {VISIBLE}")
def visible(lib):
    return op.visible_items(lib.prose).select("item_id", "created_at")


@query("pf2_recent_items", f"select item_id from v_prose where {VISIBLE} order by created_at desc nulls last, item_id desc limit 50")
def recent(lib):
    return op.recent_items(lib.prose, 50).select("item_id")


@query("pf3_item_page", f"select item_id, created_at from v_prose where {VISIBLE} order by {NEWEST} limit 25 offset 50")
def page(lib):
    return op.item_page(lib.prose, 50, 25).select("item_id", "created_at")


_AFTER = dt.datetime(2023, 7, 1)


@query("pf3_keyset_page", f"""select item_id, created_at from v_prose where {VISIBLE}
  and (created_at is null or created_at < timestamp '2023-07-01'
    or (created_at = timestamp '2023-07-01' and imported_at < timestamp '2023-07-01')) order by {NEWEST} limit 25""")
def keyset(lib):
    return op.item_page_after(lib.prose, _AFTER, _AFTER, 0, 25).select("item_id", "created_at")


@query("pf4_old_items", f"select item_id, created_at from v_prose where {VISIBLE} and created_at < timestamp '{AS_OF}' - interval 6 month")
def old(lib):
    return op.old_items(lib.prose, lib.as_of).select("item_id", "created_at")


_ELIGIBLE = f"""{VISIBLE} and not organize_locked and (organize_status in ('pending', 'failed')
  or (organize_status = 'pendingNetwork' and updated_at <= timestamp '{AS_OF}' - interval 15 second)
  or (organize_status = 'idle' and ocr_status in ('completed', 'failed') and visual_status in ('completed', 'failed', 'inaccessible')))"""
_RANK = "case organize_status when 'pending' then 0 when 'pendingNetwork' then 1 when 'failed' then 2 else 3 end"


@query("pf5_claimable_organize", f"select item_id, {_RANK} as claim_rank from v_stage where {_ELIGIBLE}")
def claimable(lib):
    return op.claimable_organize(lib.stages, lib.as_of).select("item_id", "claim_rank")


@query("pf5_next_organize_batch", f"""select item_id from v_stage where {_ELIGIBLE}
  order by {_RANK}, created_at desc nulls last, item_id desc limit 100""")
def next_batch(lib):
    return op.claimable_organize(lib.stages, lib.as_of, 100).select("item_id")


@query("pf5_claimable_text", f"""select item_id from v_stage where {VISIBLE} and source = 'photos' and ocr_status = 'pending'
  and length(external_id) > 0""")
def claimable_text(lib):
    return op.claimable_stage(lib.stages, "ocr").select("item_id")


@query("pf6_pending_peers", f"""select item_id, source, r as peer_rank from (select *, row_number() over (
  partition by source order by created_at desc nulls last, item_id desc) as r from v_stage where not is_removed
  and not organize_locked and organize_status in ('pending', 'pendingNetwork', 'failed', 'idle')) where r <= {vocab.POOL_SIZE}""")
def peers(lib):
    return op.pending_peers(lib.stages, ["source"]).select("item_id", "source", F.col("peer_rank").cast("bigint").alias("peer_rank"))


@query("pf8_picker_without_one", f"select collection_id, title from v_collection where kind <> 'unassigned' and collection_id <> {cell('en', 5)}")
def picker_one(lib):
    return op.picker_without(lib.collections, cell("en", 5)).select("collection_id", "title")


def _selected(lib):
    d = lib.table("documents")
    return d.filter((F.col("lang") == "en") & (F.col("source") == "src5") & F.col("n_chars").between(2000, 2400)).select(
        F.col("doc_id").alias("item_id"))


@query("ag3_contains_all", "select collection_id from v_full", VIEWS)
def contains_all(lib):
    return op.contains_all(lib.memberships, _selected(lib))


@query("pf8_picker_without_full", """select collection_id, title from v_collection where kind <> 'unassigned'
  and collection_id not in (select collection_id from v_full)""", VIEWS)
def picker_full(lib):
    return op.picker_without_full(lib.collections, lib.memberships, _selected(lib)).select("collection_id", "title")


@query("pf9_completed_page", """select item_id from v_stage where source = 'photos' and not is_removed
  and visual_status = 'completed' order by created_at desc, item_id desc limit 50 offset 100""")
def completed_page(lib):
    return op.status_page(lib.stages, "visual", "completed", op.newest_first(columns=("created_at", "item_id")), 100, 50).select("item_id")


@query("pf9_failed_page", """select item_id, ocr_error from v_stage where source = 'photos' and not is_removed
  and ocr_status = 'failed' order by updated_at desc, item_id desc limit 50""")
def failed_page(lib):
    return op.status_page(lib.stages, "ocr", "failed", op.newest_first(columns=("updated_at", "item_id")), 0, 50).select("item_id", "ocr_error")


@query("j1_collection_members", "select m.collection_id, m.item_id, i.created_at from v_membership m join v_prose i using (item_id)")
def members(lib):
    return op.collection_members(lib.prose, lib.memberships).select("collection_id", "item_id", "created_at")


@query("j2_review_summary", f"""select (select count(*) from v_waiting) as waiting,
  (select string_agg(item_id::varchar, ',' order by {NEWEST}) from (select * from v_waiting order by {NEWEST} limit 3)) as newest""", VIEWS)
def review(lib):
    return op.review_summary(lib.prose, lib.collections, lib.memberships).select(
        "waiting", F.array_join(F.transform("newest", lambda x: x.cast("string")), ",").alias("newest"))


@query("j3_collection_cards", "select collection_id, member_count, preview_items, preview_assets from v_card", VIEWS)
def cards(lib):
    return _cards(lib).select(
        "collection_id", "member_count", F.array_join(F.transform("preview_items", lambda x: x.cast("string")), ",").alias("preview_items"),
        F.array_join("preview_assets", ",").alias("preview_assets"))


@query("w2_newest_three", """select collection_id, rank, item_id from (select m.collection_id, i.item_id, row_number() over (
  partition by m.collection_id order by i.created_at desc nulls last, i.imported_at desc, i.item_id desc) as rank
  from v_membership m join v_shown i using (item_id)) where rank <= 3""", VIEWS)
def newest_three(lib):
    return op.newest_per_collection(lib.prose, lib.memberships).select("collection_id", F.col("rank").cast("bigint").alias("rank"), "item_id")


@query("w1_latest_run", "select item_id, run_id, started_at, decision from v_last_run", VIEWS)
def latest(lib):
    return op.latest_runs(lib.runs).select("item_id", "run_id", "started_at", "decision")


@query("j4_labelled_decisions", "select e.item_id, label, decision from v_eval e left join v_last_run using (item_id)", VIEWS)
def labelled(lib):
    return op.labelled_decisions(lib.evals, lib.runs).select("item_id", "label", "decision")


@query("j5_item_debug", """select i.item_id, run_id, decision, error_code, places from v_prose i left join v_last_run using (item_id)
  left join (select item_id, string_agg(title || '/' || source, ',' order by title || '/' || source) as places
             from v_membership join v_collection using (collection_id) group by item_id) using (item_id)
  where not is_removed""", VIEWS)
def debug_view(lib):
    return op.item_debug_view(lib.prose, lib.runs, lib.memberships, lib.collections).select(
        "item_id", "run_id", "decision", "error_code", F.array_join("places", ",").alias("places"))


@query("tk1_promoted", "select collection_id, title, member_count from v_promoted", VIEWS)
def promoted(lib):
    return op.promoted_collections(_cards(lib)).select("collection_id", "title", "member_count")


@query("tk2_suggestions", "select title from v_promoted order by sort_order, lower(title), collection_id limit 8", VIEWS)
def suggestions(lib):
    return op.suggestions(_cards(lib))


@query("tk3_home", f"""select 'collection' as section, title, member_count, preview_items as items from v_promoted
union all select 'review', 'Review', count(*), (select string_agg(item_id::varchar, ',' order by {NEWEST})
  from (select * from v_waiting order by {NEWEST} limit 3)) from v_waiting""", VIEWS)
def home(lib):
    return op.home_summary(_cards(lib), op.review_summary(lib.prose, lib.collections, lib.memberships))
