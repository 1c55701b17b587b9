"""Streams driven to completion from files, compared with their batch twins or a plain loop."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from shelfmark.streaming import streams as op


def folder(tmp_path, name):
    return str(tmp_path / name)


def allowed(requests, limit, window):
    """A plain limiter over one client's sorted requests."""
    recent, out = [], {}
    for micros, request in sorted(requests):
        recent = [t for t in recent if t >= micros - window]
        out[request] = len(recent) < limit
        if out[request]:
            recent.append(micros)
    return out


@pytest.mark.parametrize("density", [5, 40, 400])
def test_rate_limit_twin(spark, density):
    rng = random.Random(density)
    rows = [(c, i, rng.randrange(0, 3_600_000_000)) for i, c in enumerate([1] * density * 8 + [2] * density + [3] * 20)]
    rows += [(2, 100_000 + i, 1_000_000) for i in range(6)]
    frame = spark.createDataFrame(rows, "client bigint, request_id bigint, micros bigint")
    got = {(r["client"], r["request_id"]): r["allowed"] for r in op.limit_requests(frame, 4, 60).collect()}
    want = {}
    for client in (1, 2, 3):
        mine = [(m, i) for c, i, m in rows if c == client]
        want.update({(client, i): ok for i, ok in allowed(mine, 4, 60_000_000).items()})
    assert got == want and (density == 5 or not all(want.values()))


def test_rate_limit_stream(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.randint(1, 3), i, i * 900_000 + rng.randrange(900_000)) for i in range(600)]
    schema = "client bigint, request_id bigint, micros bigint"
    for part in range(3):
        spark.createDataFrame(rows[part * 200:(part + 1) * 200], schema).coalesce(1).write.mode("append").parquet(folder(tmp_path, "in"))
    stream = spark.readStream.schema(schema).parquet(folder(tmp_path, "in"))
    query = op.limiter_stream(stream, 10, 60).writeStream.format("memory").queryName("limits").option(
        "checkpointLocation", folder(tmp_path, "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r["request_id"]: r["allowed"] for r in spark.table("limits").collect()}
    twin = op.limit_requests(spark.createDataFrame(rows, schema), 10, 60)
    assert got == {r["request_id"]: r["allowed"] for r in twin.collect()} and not all(got.values())


def test_barrier(spark, tmp_path):
    schema = "item_id bigint, seq bigint, stage string, status string"
    rows = [(1, 9, "ocr", "completed"), (2, 2, "ocr", "processing"), (1, 3, "visual", "failed"), (2, 4, "visual", "completed"), (3, 5, "ocr", "completed"),
            (1, 1, "ocr", "processing"), (2, 1, "ocr", "failed")]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(folder(tmp_path, "in"))
    stream = spark.readStream.schema(schema).parquet(folder(tmp_path, "in"))
    query = op.barrier_stream(stream).writeStream.format("memory").queryName("ready").option(
        "checkpointLocation", folder(tmp_path, "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [tuple(r) for r in spark.table("ready").collect()] == [(1, "completed", "failed")]
    assert [tuple(r) for r in op.barrier_batch(spark.createDataFrame(rows, schema)).collect()] == [(1, "completed", "failed")]


def test_retry_actions(spark, tmp_path):
    rows = [(1,)] * 3 + [(2,)] * 8
    spark.createDataFrame(rows, "item_id bigint").coalesce(1).write.parquet(folder(tmp_path, "in"))
    stream = spark.readStream.schema("item_id bigint").parquet(folder(tmp_path, "in"))
    query = op.retry_stream(stream).writeStream.format("memory").queryName("retries").option(
        "checkpointLocation", folder(tmp_path, "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {tuple(r) for r in spark.table("retries").collect()} >= {(1, 3, "retry_in_120"), (2, 8, "give_up")}


def stage_rows(spark, ids):
    from shelfmark.plans.bind import Library

    return Library(spark, "/root/testdata/sf0.001").stages.filter(F.col("item_id").isin(ids)).withColumn("source", F.lit("photos")).withColumn(
        "external_id", F.concat(F.lit("asset-"), F.col("item_id").cast("string")))


def test_ingest(spark, tmp_path):
    base = folder(tmp_path, "items")
    stage_rows(spark, [1, 2, 3]).write.parquet(f"{base}/version=0")
    day = dt.datetime(2024, 1, 5)

    def arrive(listing, names, complete):
        rows = [(n, day, 10, 10, True, listing, False) for n in names] + [(None, None, None, None, None, listing, True)] * complete
        spark.createDataFrame(rows, op.PART_SCHEMA).coalesce(1).write.mode("append").parquet(folder(tmp_path, "in"))
        op.ingest(spark, op.listing_stream(spark, folder(tmp_path, "in")), base, folder(tmp_path, "cp")).start().awaitTermination(180)

    def table(version):
        return sorted(r["external_id"] for r in spark.read.parquet(f"{base}/version={version}").collect())

    arrive(1, ["asset-1"], False)   # one of several files of a listing: nothing may go yet
    assert table(1) == ["asset-1", "asset-2", "asset-3"]
    arrive(1, ["asset-2", "new-1"], True)
    assert table(2) == ["asset-1", "asset-2", "new-1"]
    arrive(2, ["asset-1", "new-1", "new-2"], True)
    assert table(3) == ["asset-1", "new-1", "new-2"]
    arrive(1, ["asset-9"], True)    # late rows of a listing already passed
    assert table(4) == table(3)
    assert len({r["item_id"] for r in spark.read.parquet(f"{base}/version=4").collect()}) == 3


def test_live_counts(spark, tmp_path):
    schema = "item_id bigint, seq bigint, source string, visual_status string"
    rows = [(1, 1, "photos", "pending"), (2, 2, "photos", "pending"), (1, 3, "photos", "completed")]
    for row in rows:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(folder(tmp_path, "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder(tmp_path, "in"))
    seen = []
    op.live_status_counts(stream, folder(tmp_path, "t"), lambda df, n: seen.append(df.first().asDict()), folder(tmp_path, "cp")).start().awaitTermination(180)
    assert (seen[-1]["pending"], seen[-1]["completed"]) == (1, 1) and len(seen) == 3
