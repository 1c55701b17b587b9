"""Listing scans, incremental sync, stage status changes and retries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.operators import search, status as st, sync as op
from shelfmark.plans.bind import AS_OF
from shelfmark.plans.registry import query
from shelfmark.sources import sinks, tables

NOW = f"timestamp '{AS_OF}'"
OPEN = "not is_removed and access_state = 'available'"
VIEWS = {
    "v_missing": """select external_id from v_stage where source = 'photos' and external_id is not null
      and external_id not in (select external_id from v_listing)""",
    "v_marked": """select * replace (
        case when g then 'inaccessible' else access_state end as access_state,
        case when g and ocr_status in ('pending', 'processing') then 'inaccessible' else ocr_status end as ocr_status,
        case when not (g and ocr_status in ('pending', 'processing')) then ocr_claimed_at end as ocr_claimed_at,
        case when g and visual_status in ('pending', 'processing') then 'inaccessible' else visual_status end as visual_status)
      from (select *, coalesce(source = 'photos' and external_id in (select external_id from v_missing), false) as g from v_stage)""",
}


def upserted(base: str) -> str:
    return f"""select s.external_id, coalesce(l.created_at, s.created_at) as created_at,
    case when l.external_id is not null then 'photos' else source end as source,
    case when l.external_id is not null then 'available' else access_state end as access_state,
    case when s.item_id is null or (a and ocr_status = 'inaccessible') or (a and ocr_status = 'completed' and ocr_version < 2) then 'pending' else ocr_status end as ocr_status,
    case when s.item_id is null or (a and visual_status = 'inaccessible') or (a and visual_status = 'completed' and visual_version < 1) then 'pending' else visual_status end as visual_status,
    coalesce(organize_status, 'idle') as organize_status
  from (select b.*, access_state = 'inaccessible' and external_id in (select external_id from v_listing) as a from {base} b) s
  full outer join v_listing l on s.external_id = l.external_id"""


def _fix_ids(sql: str) -> str:
    return sql.replace("select s.external_id,", "select coalesce(s.external_id, l.external_id) as external_id,")


FIELDS = ("external_id", "created_at", "source", "access_state", "ocr_status", "visual_status", "organize_status")


@query("io1_listing_scan", "select external_id, created_at, width, height from v_listing")
def listing(lib):
    return tables.scan_listing(lib.asset_list).select("external_id", "created_at", F.col("width").cast("bigint").alias("width"), "height")


@query("j6_snapshot_difference", """select external_id, 'missing' as side from v_missing union all
  select distinct external_id, 'new' from v_listing where external_id not in (
    select external_id from v_stage where external_id is not null)""", VIEWS)
def difference(lib):
    missing, new = op.snapshot_difference(lib.stages, tables.scan_listing(lib.asset_list))
    return missing.withColumn("side", F.lit("missing")).unionByName(new.withColumn("side", F.lit("new")))


@query("st1_id_subtract", """select external_id from v_stage where external_id is not null
  except select external_id from v_listing""", VIEWS)
def subtract(lib):
    stored = lib.stages.filter(F.col("external_id").isNotNull()).select("external_id")
    return stored.exceptAll(tables.scan_listing(lib.asset_list).select("external_id"))


@query("sy3_mark_inaccessible", "select item_id, access_state, ocr_status, ocr_claimed_at, visual_status from v_marked", VIEWS)
def mark(lib):
    missing, _ = op.snapshot_difference(lib.stages, tables.scan_listing(lib.asset_list))
    return op.mark_inaccessible(lib.stages, missing, lib.as_of).select(
        "item_id", "access_state", "ocr_status", "ocr_claimed_at", "visual_status")


@query("sy2_upsert_listing", _fix_ids(upserted("v_stage")), VIEWS)
def upsert_listing(lib):
    return op.upsert_listing(lib.stages, tables.scan_listing(lib.asset_list), lib.as_of).select(*FIELDS)


@query("sy1_reconcile_full", _fix_ids(upserted("""(select * from v_stage where not (source = 'photos'
  and coalesce(external_id in (select external_id from v_missing), false)))""")), VIEWS)
def reconcile_full(lib):
    return op.reconcile(lib.stages, tables.scan_listing(lib.asset_list), lib.as_of, True)[0].select(*FIELDS)


@query("sy1_reconcile_limited", _fix_ids(upserted("v_marked")), VIEWS)
def reconcile_limited(lib):
    return op.reconcile(lib.stages, tables.scan_listing(lib.asset_list), lib.as_of, False)[0].select(*FIELDS)


@query("sy1_result", """select *, case when inserted > 0 then 'organized' when missing > 0 then 'synced' else 'upToDate' end as result from (
  select (select count(distinct external_id) from v_listing where external_id not in (
    select external_id from v_stage where external_id is not null)) as inserted, (select count(*) from v_missing) as missing)""", VIEWS)
def result(lib):
    return op.reconcile(lib.stages, tables.scan_listing(lib.asset_list), lib.as_of, True)[1]


SYNC_VIEWS = {
    **VIEWS,
    "v_gone": """select item_id from v_stage where source = 'photos' and coalesce(external_id in (select external_id from v_missing), false)""",
    "v_fresh": """select (select max(item_id) from v_stage where item_id not in (select item_id from v_gone)) + row_number() over (order by external_id) as item_id
      from (select distinct external_id from v_listing where external_id not in (select external_id from v_stage where external_id is not null))""",
    "v_stay": "select * from v_membership where item_id not in (select item_id from v_gone)",
}


@query("sy1_reconcile_memberships", """select item_id, collection_id, source, position from v_stay union all
  select item_id, 0, 'user', coalesce((select max(position) from v_stay where collection_id = 0), -1) + row_number() over (order by item_id) from v_fresh""", SYNC_VIEWS)
def reconcile_memberships(lib):
    groups = lib.dup_members.withColumn("keep_id", F.lit(None).cast("bigint"))
    postings = lib.shared("postings", lambda: search.build_postings(lib.prose))
    tables_after = op.reconcile_tables(lib.stages, lib.memberships, groups, postings, lib.collections, tables.scan_listing(lib.asset_list), lib.as_of, True)
    return tables_after["memberships"].select("item_id", "collection_id", "source", "position")


def _stale(stage, seconds):
    return f"""{OPEN} and {stage}_status = 'processing' and ({stage}_claimed_at is null or {stage}_claimed_at < {NOW} - interval {seconds} second)"""


@query("sy4_stale_claims", f"""select item_id, case when {_stale('ocr', 300)} then 'pending' else ocr_status end as ocr_status,
  case when {_stale('visual', 90)} then 'pending' else visual_status end as visual_status,
  case when not ({_stale('ocr', 300)}) then ocr_claimed_at end as ocr_claimed_at from v_stage""")
def stale(lib):
    rows = st.recover_stale_claims(st.recover_stale_claims(lib.stages, "ocr", lib.as_of), "visual", lib.as_of)
    return rows.select("item_id", "ocr_status", "visual_status", "ocr_claimed_at")


_DUE = f"""{OPEN} and source = 'photos' and ((ocr_status = 'completed' and ocr_version < 2)
  or (ocr_status = 'failed' and ocr_next_retry_at is not null and ocr_next_retry_at <= timestamp '2024-01-15'))"""


@query("sy5_due_retries", f"""select item_id, case when {_DUE} then 'pending' else ocr_status end as ocr_status,
  case when not ({_DUE}) then ocr_next_retry_at end as ocr_next_retry_at from v_stage""")
def due(lib):
    return st.requeue_stale_or_due(lib.stages, "ocr", 2, F.lit("2024-01-15").cast("timestamp")).select(
        "item_id", "ocr_status", "ocr_next_retry_at")


_OUTCOMES = {
    "v_outcome": """select user_id as item_id, event_id as seq, ts as seen,
      case event_type when 'error' then 'failure' when 'signup' then 'missing' else 'success' end as result, 3 as version,
      case when event_type = 'error' then 'code_' || cast(floor(value) as bigint) end as error from events""",
    "v_base": "select * replace (0 as ocr_attempts) from v_stage where item_id in (select user_id from events)",
    "v_folded": """select item_id, count(*) filter (result = 'failure') as failures, arg_max(result, (seen, seq)) as result, max(seen) as seen,
      arg_max(coalesce(error, '-'), (seen, seq)) as error from v_outcome group by 1""",
}


@query("sy6_outcomes", """select item_id, case result when 'success' then 'completed' when 'failure' then 'failed' else 'inaccessible' end as ocr_status,
  case when result = 'success' then 3 else ocr_version end as ocr_version, failures as ocr_attempts,
  case when result = 'failure' and failures < 8 then seen + to_seconds(cast(least(30 * pow(2, failures - 1), 3600) as bigint)) end as ocr_next_retry_at,
  case when result = 'missing' then 'inaccessible' else access_state end as access_state,
  case when result = 'failure' then error end as ocr_error
  from v_base join v_folded using (item_id)""", _OUTCOMES)
def outcomes(lib):
    events = lib.table("events")
    kind = F.col("event_type")
    log = events.select(
        F.col("user_id").alias("item_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"),
        F.when(kind == "error", "failure").when(kind == "signup", "missing").otherwise("success").alias("result"),
        F.lit(3).alias("version"), F.when(kind == "error", F.concat(F.lit("code_"), F.floor("value").cast("string"))).alias("error"))
    rows = lib.stages.withColumn("ocr_attempts", F.lit(0)).join(log.select("item_id"), "item_id", "left_semi")
    return st.apply_outcomes(rows, log, "ocr").select(
        "item_id", "ocr_status", "ocr_version", F.col("ocr_attempts").cast("bigint").alias("ocr_attempts"), "ocr_next_retry_at",
        "access_state", "ocr_error")


@query("w7_failure_attempts", """select run_id, item_id, attempt, case when attempt < 8 then cast(least(30 * pow(2, attempt - 1), 3600) as bigint) end as retry_seconds
  from (select run_id, item_id, row_number() over (partition by item_id order by started_at, run_id) as attempt from v_run where error_code is not null)""")
def attempts(lib):
    failures = lib.runs.filter(F.col("error_code").isNotNull()).select("run_id", "item_id", "started_at")
    return st.failure_attempts(failures, ["started_at", "run_id"]).select("run_id", "item_id", "attempt", "retry_seconds")


_READY = """ocr_status in ('completed', 'failed', 'inaccessible') and visual_status in ('completed', 'failed', 'inaccessible')
  and not organize_locked and organize_status in ('idle', 'pendingNetwork', 'failed', 'skippedNoConsent')"""


@query("sy7_readiness", f"select item_id, case when {_READY} then 'pending' else organize_status end as organize_status from v_stage")
def ready(lib):
    return st.readiness_barrier(lib.stages, lib.as_of).select("item_id", "organize_status")


@query("sy8_reprocess", f"""select item_id, case when {OPEN} and source = 'photos' then 'pending' else ocr_status end as ocr_status,
  case when {OPEN} and source = 'photos' then 0 else ocr_attempts end as ocr_attempts,
  case when not ({OPEN} and source = 'photos') then ocr_error end as ocr_error from v_stage""")
def reprocess(lib):
    return st.reprocess(lib.stages, "ocr", lib.as_of).select("item_id", "ocr_status", "ocr_attempts", "ocr_error")


@query("sy8_reprocess_chosen", f"""select item_id, case when {OPEN} and c then 'pending' else visual_status end as visual_status,
  case when {OPEN} and c then 0 else visual_version end as visual_version from (select *, item_id in (select o_orderkey from orders where o_orderstatus = 'F') as c from v_stage)""")
def reprocess_chosen(lib):
    chosen = lib.table("orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("item_id"))
    return st.reprocess(lib.stages, "visual", lib.as_of, chosen).select("item_id", "visual_status", "visual_version")


@query("sy9_requeue_skipped", """select item_id, case when organize_status = 'skippedNoConsent' and not organize_locked and not is_removed
  then 'pending' else organize_status end as organize_status from v_stage""")
def skipped(lib):
    return st.requeue_skipped(lib.stages, lib.as_of).select("item_id", "organize_status")


@query("sy9_requeue_chosen", f"""select item_id, case when c then 'pending' else organize_status end as organize_status,
  case when not c then fingerprint end as fingerprint, case when c then {NOW} - interval 1 minute else updated_at end as updated_at
  from (select *, not is_removed and not organize_locked and item_id in (select o_orderkey from orders where o_orderstatus = 'F') as c from v_stage)""")
def requeue_chosen(lib):
    chosen = lib.table("orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("item_id"))
    return st.requeue_chosen(lib.stages, chosen, lib.as_of).select("item_id", "organize_status", "fingerprint", "updated_at")


@query("rs11_needs_work", "select item_id from v_stage where not coalesce(resolver_version = 2 and organize_status = 'ready', false)")
def needs_work(lib):
    return st.needs_work(lib.stages).select("item_id")


@query("io3_upsert", """select item_id, arg_max(run_id, (started_at, run_id)) as run_id, max(started_at) as started_at from v_run group by 1""")
def upsert(lib):
    rows = lib.runs.select("item_id", "run_id", "started_at")
    stored = lib.runs.filter("decision = 'reuse'").select(*rows.columns)
    return sinks.upsert(stored, rows, ["item_id"], ["started_at", "run_id"])


@query("io4_decision_log", """select run_id, item_id, cast(started_at as date) as run_date, decision, error_code from v_run""")
def decision_log(lib):
    log = sinks.decision_log(lib.runs.withColumn("why", F.coalesce("error_code", F.lit("-"))), ["decision", "error_code", "provider"])
    back = F.from_json("payload_json", "decision string, error_code string, provider string")
    return log.select("run_id", "item_id", "run_date", back["decision"].alias("decision"), back["error_code"].alias("error_code"))


@query("j8_cache_split", """select item_id, exists (select 1 from v_run r where r.item_id = s.item_id and r.decision = 'create') as cached from v_stage s""")
def cache_split(lib):
    known = lib.runs.filter("decision = 'create'").select("item_id").distinct()
    hits = lib.stages.join(known, "item_id", "left_semi").select("item_id", F.lit(True).alias("cached"))
    return hits.unionByName(lib.stages.join(known, "item_id", "left_anti").select("item_id", F.lit(False).alias("cached")))
