"""Writing: keyed upserts, the append-only decision log and bounded request packs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from shelfmark import vocab
from shelfmark.functions import text as tx
from shelfmark.operators.ranking import group_row_number, latest_by

PAYLOAD_CHARACTERS = 4000


def upsert(stored: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the newest by ``order``; running it again changes nothing."""
    return latest_by(stored.unionByName(changes.select(*stored.columns)), list(keys), list(order))


def write_upsert(stored_path: str, changes: DataFrame, keys: Sequence[str], order: Sequence[str], target_path: str) -> None:
    """Read a stored table, apply changes and write the result beside it; the caller switches over."""
    spark = changes.sparkSession
    upsert(spark.read.parquet(stored_path), changes, keys, order).write.mode("overwrite").parquet(target_path)


def decision_log(decisions: DataFrame, payload: Sequence[str]) -> DataFrame:
    """One log row per attempt: the payload columns become JSON and the day becomes the partition."""
    rest = [c for c in decisions.columns if c not in payload]
    return decisions.select(
        *rest, F.to_json(F.struct(*payload)).alias("payload_json"), F.to_date("started_at").alias("run_date"))


def append_decisions(decisions: DataFrame, payload: Sequence[str], path: str) -> None:
    decision_log(decisions, payload).write.mode("append").partitionBy("run_date").parquet(path)


def request_packs(
    members: DataFrame, eligible: DataFrame | None = None, size: int = vocab.GROUP_SIZE, characters: int = PAYLOAD_CHARACTERS,
) -> DataFrame:
    """JSON documents ``(group_id, pack_no, member_count, request_json)`` for an external reader of groups.

    ``members(group_id, position, item_id, ocr_text, created_at, facets, platform, content_type, family)``.
    The receiver bounds a request's members and their text.  A longer text becomes several members that follow each
    other, numbered by ``part``, and a larger group becomes several packs, numbered from 0: nothing is left out.
    Empty text, lists and unknown values are left out of the JSON.
    """
    cleaned = members.withColumn("_text", tx.clean_text(F.col("ocr_text")))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length("_text") - 1) / characters)).cast("int"))
    parts = cleaned.withColumn("_part", F.explode(starts)).withColumn(
        "_text", F.substring(F.col("_text"), F.col("_part") * characters + 1, F.lit(characters)))
    keyed = parts.select("group_id", "position", "item_id", "_part")
    placed = group_row_number(keyed, ["group_id"], [F.asc("position"), F.asc("item_id"), F.asc("_part")], "_n")
    bounded = parts.join(placed.drop("position"), ["group_id", "item_id", "_part"]).withColumn(
        "pack_no", F.floor((F.col("_n") - 1) / size).cast("bigint"))
    clean = F.col("_text")
    known = lambda c: F.when(F.col(c) != vocab.UNKNOWN, F.col(c))
    body = F.struct(
        F.col("item_id").cast("string").alias("localId"), F.when(F.col("_part") > 0, F.col("_part")).alias("part"), F.when(clean != "", clean).alias("ocrText"),
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("createdAt"),
        F.when(F.size("facets") > 0, F.col("facets")).alias("facets"), known("platform").alias("platform"),
        known("content_type").alias("contentType"), known("family").alias("contentFamily"))
    packs = bounded.groupBy("group_id", "pack_no").agg(
        F.count(F.lit(1)).alias("member_count"), F.array_sort(F.collect_list(F.struct("_n", body.alias("body")))).alias("_all"))
    packs = packs.withColumn("members", F.transform("_all", lambda x: x["body"])).drop("_all")
    if eligible is not None:
        packs = packs.join(eligible, "group_id", "left")
        return packs.select("group_id", "pack_no", "member_count", F.to_json(F.struct("members", "eligibleCollections")).alias("request_json"))
    return packs.select("group_id", "pack_no", "member_count", F.to_json(F.struct("members")).alias("request_json"))
