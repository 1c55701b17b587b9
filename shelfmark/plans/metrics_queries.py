"""Status counts, failure summaries, evaluation and clean-up figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark import vocab
from shelfmark.operators import listing, metrics as op
from shelfmark.plans.bind import AS_OF
from shelfmark.plans.listing_queries import VIEWS, VISIBLE
from shelfmark.plans.registry import query


def _counts(column, values, where):
    return ", ".join(f"count(*) filter ({where} and {column} = '{v}') as {v}" for v in values)


@query("ag1_text_status_counts", f"select {_counts('ocr_status', vocab.STAGE_STATUSES, 'source = ' + repr('photos'))} from v_stage")
def text_counts(lib):
    return op.stage_counts(lib.stages, "ocr")


@query("ag1_visual_status_counts", f"""select {_counts('visual_status', vocab.STAGE_STATUSES, "source = 'photos'")},
  count(*) filter (source = 'photos' and visual_status = 'completed' and external_id is null) as completed_without_asset from v_stage""")
def visual_counts(lib):
    return op.stage_counts(lib.stages, "visual", {
        "completed_without_asset": (F.col("visual_status") == "completed") & F.col("external_id").isNull()})


@query("ag1_organize_status_counts", f"select {_counts('organize_status', vocab.ORGANIZE_STATUSES, 'not is_removed')} from v_stage")
def organize_counts(lib):
    return op.organize_counts(lib.stages)


@query("ag2_failure_summary", """with f as (select coalesce(ocr_error, '(nil)') as code, 'attempts=' || ocr_attempts as bucket
  from v_stage where source = 'photos' and ocr_status = 'failed')
select 'code' as section, code as label, count(*) as failures from f group by code union all
select 'attempts', bucket, count(*) from f group by bucket union all select 'total', 'total', count(*) from f""".replace(
    "with f as (", "select section, label, failures from (with f as (", 1) + ")")
def failures(lib):
    return op.failure_summary(lib.stages, "ocr_status", "ocr_error", "ocr_attempts")


@query("ag4_claimability", """select count(*) filter (p) as pending_total,
  count(*) filter (p and access_state = 'available' and not is_removed and length(external_id) > 0) as claimable,
  count(*) filter (p and not is_removed and coalesce(length(external_id), 0) = 0) as missing_id,
  count(*) filter (p and is_removed) as removed,
  count(*) filter (p and not is_removed and access_state = 'inaccessible') as inaccessible
from (select *, source = 'photos' and visual_status = 'pending' as p from v_stage)""")
def claimability(lib):
    return op.claimability(lib.stages, "visual")


@query("ag5_evaluation", """select *, round(auto_filed / total, 6) as coverage, round(correct / total, 6) as correct_rate,
  round(wrong_file / total, 6) as wrong_rate, round(review_decisions / total, 6) as review_rate from (
  select count(*) as total, count(*) filter (decision in ('reuse', 'create')) as auto_filed,
    count(*) filter (label = 'correct') as correct, count(*) filter (label = 'wrongCollection') as wrong_file,
    count(*) filter (label = 'shouldBeNeedsReview') as should_be_review,
    count(*) filter (label = 'wrongCollectionName') as wrong_name,
    count(*) filter (decision = 'needsReview') as review_decisions,
    count(*) filter (label = 'correct' and decision = 'reuse') as reuse_correct,
    count(*) filter (label = 'correct' and decision = 'create') as create_correct
  from v_eval left join v_last_run using (item_id))""", VIEWS)
def evaluation(lib):
    return op.evaluation_stats(listing.labelled_decisions(lib.evals, lib.runs))


@query("ag6_cleanup_overview", f"""select (select coalesce(sum(n), 0)::bigint from (select count(*) as n from v_dup group by group_id) where n >= 2) as duplicate_items,
  (select count(*) from (select count(*) as n from v_dup group by group_id) where n >= 2) as duplicate_groups,
  (select count(*) from v_prose where {VISIBLE} and created_at < timestamp '{AS_OF}' - interval 6 month) as old_items""")
def overview(lib):
    return op.cleanup_overview(lib.dup_members, listing.old_items(lib.prose, lib.as_of))


@query("mb13_duplicate_groups", """select group_id, item_id, size from v_dup join (select group_id, count(*) as size from v_dup
  group by group_id having count(*) >= 2) using (group_id)""")
def groups(lib):
    return op.duplicate_groups(lib.dup_members).select("group_id", "item_id", "size")


@query("ag8_next_position", "select collection_id, max(position) + 1 as next_position from v_membership group by 1")
def positions(lib):
    return op.next_positions(lib.memberships)


@query("ag9_cloud_calls", "select count(*) filter (provider not like 'ondevice%') as cloud_calls from v_run")
def cloud(lib):
    return op.cloud_calls(lib.runs)
