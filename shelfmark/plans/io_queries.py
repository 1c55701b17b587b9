"""Typed loading of stored rows, table snapshots and request packs."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import functions as F

from shelfmark.operators import search
from shelfmark.plans import duck
from shelfmark.plans.registry import query
from shelfmark.session import shared_folder
from shelfmark.sources import sinks, tables


@query("io2_typed_load", """select event_id as item_id, event_type as first_label, case when event_type = 'click' then 1.0 else round(value / 100, 4) end as confidence,
    case when event_type in ('view', 'error') then 0 else 1 end as facets, case when event_type = 'click' then 'completed' else 'pending' end as ocr_status from events""")
def typed_load(lib):
    kind = F.col("event_type")
    labels = F.when(kind == "click", F.to_json(F.array("event_type"))).otherwise(
        F.to_json(F.array(F.struct(kind.alias("identifier"), (F.col("value") / 100).alias("confidence")))))
    facets = F.when(kind == "view", F.lit("not json")).when(kind == "error", F.lit(None)).otherwise(F.to_json(F.array("event_type")))
    stored = lib.table("events").select(
        F.col("event_id").alias("item_id"), labels.alias("labels_json"), facets.alias("facets_json"),
        F.when(kind == "click", "completed").otherwise("strange").alias("ocr_status"))
    rows = tables.decode_items(stored)
    first = F.col("labels")[0]
    return rows.select("item_id", first["identifier"].alias("first_label"), F.round(first["confidence"].cast("double"), 4).alias("confidence"),
                       F.size("facets").alias("facets"), "ocr_status")


@query("tx18_legacy_labels", "select event_id as item_id, event_type as identifier, 1.0 as confidence from events")
def legacy(lib):
    rows = lib.table("events").select(F.col("event_id").alias("item_id"), tables.label_array(F.to_json(F.array("event_type"))).alias("labels"))
    return rows.select("item_id", F.col("labels")[0]["identifier"].alias("identifier"), F.col("labels")[0]["confidence"].cast("double").alias("confidence"))


def _saved_and_restored(lib, frames):
    """Through a snapshot in the shared folder, under a name of its own."""
    folder, name = f"{shared_folder(lib.spark)}/shelfmark-snapshots", uuid.uuid4().hex
    tables.save_snapshot(frames, folder, name)
    return tables.restore_snapshot(lib.spark, folder, list(frames), name)


@query("io5_snapshot_restore", "select item_id, collection_id, source, confidence, position from v_membership")
def snapshot(lib):
    return _saved_and_restored(lib, {"memberships": lib.memberships})["memberships"].select(
        "item_id", "collection_id", "source", "confidence", "position")


@query("io5_snapshot_tables", """select 'items' as name, count(*) as rows, sum(item_id)::bigint as ids from v_prose union all
  select 'collections', count(*), sum(collection_id)::bigint from v_collection union all select 'memberships', count(*), sum(item_id)::bigint from v_membership union all
  select 'groups', count(*), sum(doc_id)::bigint from (select doc_id from documents join (select text from documents group by 1 having count(*) > 1) using (text)) union all
  select 'postings', count(*), sum(item_id)::bigint from (select distinct item_id, unnest({words}) as term from v_prose)""".replace(
    "{words}", duck.words(duck.search_text("ocr_text"))))
def snapshot_tables(lib):
    """The whole table set: items, collections, memberships, duplicate groups and the index."""
    texts = lib.table("documents")
    copies = texts.groupBy("text").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    frames = {"items": lib.prose, "collections": lib.collections, "memberships": lib.memberships,
              "groups": texts.join(copies, "text").select(F.col("doc_id").alias("item_id"), F.md5("text").alias("group_id")), "postings": search.build_postings(lib.prose)}
    counts = [frame.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"), F.sum("collection_id" if name == "collections" else "item_id").alias("ids"))
              for name, frame in _saved_and_restored(lib, frames).items()]
    return functools.reduce(lambda a, b: a.unionByName(b), counts)


@query("io6_request_packs", f"""select group_id, count(*) as members, sum(length(c))::bigint as characters, sum(greatest(1, ceil(length(c) / 4000.0)))::bigint as parts from (
    select *, {duck.clean('ocr_text')} as c from (select m.collection_id as group_id, i.item_id, i.ocr_text, row_number() over (
      partition by m.collection_id order by m.position, i.item_id) as r from v_membership m join v_prose i using (item_id))) group by 1""")
def packs(lib):
    none = F.array().cast("array<string>")
    rows = lib.memberships.select(F.col("collection_id").alias("group_id"), "item_id", "position").join(
        lib.prose.select("item_id", "ocr_text", "created_at"), "item_id").withColumns({
            "facets": none, "platform": F.lit("unknown"), "content_type": F.lit("unknown"), "family": F.lit("unknown")})
    out = sinks.request_packs(rows)
    body = F.from_json("request_json", "members array<struct<localId:string,part:int,ocrText:string>>")["members"]
    total = F.aggregate(body, F.lit(0).cast("bigint"), lambda s, m: s + F.coalesce(F.length(m["ocrText"]), F.lit(0)))
    sizes = out.select("group_id", F.size(F.array_distinct(F.transform(F.filter(body, lambda m: m["part"].isNull()), lambda m: m["localId"]))).alias("n"), F.size(body).alias("p"), total.alias("c"))
    return sizes.groupBy("group_id").agg(F.sum("n").alias("members"), F.sum("c").alias("characters"), F.sum("p").alias("parts"))
