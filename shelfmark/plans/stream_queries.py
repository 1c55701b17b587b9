"""Batch twins of the streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.plans.registry import query
from shelfmark.streaming import streams as op


@query("sm4_rate_limit", """with recursive e as (select user_id as client, event_id as request_id, epoch_us(ts) as micros,
    row_number() over (partition by user_id order by ts, event_id) as n from events),
  walk(client, n, recent, request_id, allowed) as (
    select client, n, [micros], request_id, true from e where n = 1 union all
    select client, n, case when len(kept) < 3 then list_append(kept, micros) else kept end, request_id, len(kept) < 3
    from (select e.*, list_filter(w.recent, lambda t: t >= e.micros - 86400000000) as kept from walk w join e on e.client = w.client and e.n = w.n + 1))
  select client, request_id, allowed from walk""")
def rate_limit(lib):
    """Requests of a client are its events; six a day keeps clients busy at this density."""
    requests = lib.table("events").select(F.col("user_id").alias("client"), F.col("event_id").alias("request_id"),
                                          F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))
    return op.limit_requests(requests, limit=3, window_seconds=86400).select("client", "request_id", "allowed")


@query("sm2_ready_items", """select * from (select user_id as item_id, arg_max(status, event_id) filter (event_id % 2 = 0) as ocr_status,
    arg_max(status, event_id) filter (event_id % 2 = 1) as visual_status
    from (select *, case event_type when 'click' then 'completed' when 'error' then 'failed' else 'processing' end as status from events) group by 1)
  where ocr_status in ('completed', 'failed') and visual_status in ('completed', 'failed')""")
def ready_items(lib):
    """Events as stage changes: even ones of the text stage, odd ones of the visual stage."""
    kind = F.col("event_type")
    return op.barrier_batch(lib.table("events").select(
        F.col("user_id").alias("item_id"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 2 == 0, "ocr").otherwise("visual").alias("stage"),
        F.when(kind == "click", "completed").when(kind == "error", "failed").otherwise("processing").alias("status")))


@query("sm5_latest_status_counts", """select last as status, count(*) as items from (select user_id, arg_max(event_type, event_id) as last from events group by 1) group by 1""")
def latest_counts(lib):
    from shelfmark.operators.metrics import counts_by
    from shelfmark.operators.ranking import latest_by

    rows = lib.table("events").select(F.col("user_id").alias("item_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"))
    return counts_by(latest_by(rows, ["item_id"], ["seq"]), ["status"]).select("status", F.col("rows").alias("items"))
