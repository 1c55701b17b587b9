"""Structured Streaming forms of sync, barrier, retries, rate limit and status counts, with batch twins."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shelfmark import vocab
from shelfmark.operators import metrics
from shelfmark.operators.ranking import latest_by
from shelfmark.operators.sync import reconcile
from shelfmark.sources.tables import LISTING_SCHEMA, scan_listing

# ---- incremental ingest ----------------------------------------------------------------------------


PART_SCHEMA = f"{LISTING_SCHEMA}, listing_id bigint, complete boolean"


def listing_stream(spark: SparkSession, folder: str, fmt: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    """Parts of listings as they arrive in a folder: any number of files, each row naming its listing.

    A row with ``complete`` set and no asset says that all of its listing has been written.
    """
    return spark.readStream.schema(PART_SCHEMA).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(folder)


def ingest(spark: SparkSession, listings: DataFrame, folder: str, checkpoint: str, full_access: bool = True):
    """Reconcile the item table below ``folder`` with the newest listing that is complete.

    Parts wait below ``folder`` until their listing's completion row has come, so a listing in many files never
    looks like a short one.  A listing states the whole collection; when several become complete in one batch, the
    largest id counts, and one older than a listing already taken is passed over.  Each batch writes a new table
    version named by its batch id, and a repeated batch starts again from the version before it, so a restart gives
    the same result.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{folder}/parts/batch={batch_id}")
        parts = session.read.schema(PART_SCHEMA).parquet(*[f"{folder}/parts/batch={n}" for n in range(batch_id + 1)])
        items = session.read.parquet(f"{folder}/version={batch_id}")
        latest = parts.filter("complete").agg(F.max("listing_id")).first()[0]
        before = session.read.schema(PART_SCHEMA).parquet(*[f"{folder}/parts/batch={n}" for n in range(batch_id)]).filter("complete").agg(
            F.max("listing_id")).first()[0] if batch_id else None
        if latest is None or latest == before:
            changed = items
        else:
            listing = parts.filter(F.col("listing_id") == latest).filter("external_id is not null")
            changed, _ = reconcile(items, scan_listing(listing), F.current_timestamp(), full_access)
        changed.write.mode("overwrite").parquet(f"{folder}/version={batch_id + 1}")

    return listings.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True)


# ---- two-stage barrier -----------------------------------------------------------------------------


TERMINAL = ("completed", "failed", "inaccessible")
TTL_MS = 30 * 86_400_000


class BarrierProcessor(StatefulProcessor):
    """Per item: remember the newest result of both stages, emit once when both are terminal.

    After that only a mark is kept, and it expires ``TTL_MS`` after its last use.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("stages", "ocr string, ocr_seq bigint, visual string, visual_seq bigint", TTL_MS)
        self.emitted = handle.getValueState("emitted", "done boolean", TTL_MS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        if self.emitted.exists():
            self.emitted.update((True,))
            return
        ocr, ocr_seq, visual, visual_seq = self.state.get() if self.state.exists() else (None, -1, None, -1)
        for frame in rows:
            newest = frame.loc[frame.groupby("stage")["seq"].idxmax()]
            for stage, seq, status in zip(newest["stage"], newest["seq"], newest["status"]):
                if stage == "ocr" and seq > ocr_seq:
                    ocr, ocr_seq = status, seq
                elif stage != "ocr" and seq > visual_seq:
                    visual, visual_seq = status, seq
        if ocr in TERMINAL and visual in TERMINAL:
            self.state.clear()
            self.emitted.update((True,))
            yield pd.DataFrame({"item_id": [key[0]], "ocr_status": [ocr], "visual_status": [visual]})
        else:
            self.state.update((ocr, int(ocr_seq), visual, int(visual_seq)))

    def close(self) -> None:
        pass


def barrier_stream(changes: DataFrame) -> DataFrame:
    """``changes(item_id, seq, stage, status)`` to one row per item, when both of its stages are terminal.

    ``seq`` orders the changes of an item; within one batch they may come in any order.
    """
    return changes.groupBy("item_id").transformWithStateInPandas(
        BarrierProcessor(), "item_id bigint, ocr_status string, visual_status string", "Append", "ProcessingTime")


def barrier_batch(changes: DataFrame, terminal: tuple[str, ...] = TERMINAL) -> DataFrame:
    """What the stream emits when all changes come in one batch: an aggregate with map-side combine."""
    ocr = F.col("stage") == "ocr"
    newest = lambda of: F.max_by(F.when(of, F.col("status")), F.when(of, F.col("seq")))
    latest = changes.groupBy("item_id").agg(newest(ocr).alias("ocr_status"), newest(~ocr).alias("visual_status"))
    return latest.filter(F.col("ocr_status").isin(*terminal) & F.col("visual_status").isin(*terminal))


# ---- retry timers ----------------------------------------------------------------------------------


class RetryProcessor(StatefulProcessor):
    """Per item: count failures and wake up at the back-off; from the eighth on give up."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.attempts = handle.getValueState("attempts", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        attempt = self.attempts.get()[0] if self.attempts.exists() else 0
        for frame in rows:
            attempt += len(frame)
        self.attempts.update((attempt,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if attempt >= vocab.MAX_ATTEMPTS:
            self.attempts.clear()
            yield pd.DataFrame({"item_id": [key[0]], "attempt": [attempt], "action": ["give_up"]})
            return
        delay = min(vocab.RETRY_BASE_SECONDS * 2 ** (attempt - 1), vocab.RETRY_CAP_SECONDS)
        self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + delay * 1000)
        yield pd.DataFrame({"item_id": [key[0]], "attempt": [attempt], "action": [f"retry_in_{delay}"]})

    def handleExpiredTimer(self, key, timer_values, expired) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"item_id": [key[0]], "attempt": [self.attempts.get()[0]], "action": ["due"]})

    def close(self) -> None:
        pass


def retry_stream(failures: DataFrame) -> DataFrame:
    """``failures(item_id)`` to retry actions, with processing-time timers."""
    return failures.groupBy("item_id").transformWithStateInPandas(
        RetryProcessor(), "item_id bigint, attempt int, action string", "Append", "ProcessingTime")


# ---- rolling rate limit ----------------------------------------------------------------------------


def _accept(times, recent: deque, limit: int, window: int) -> list[bool]:
    """Which of the sorted times (microseconds) are allowed; ``recent`` holds accepted times and is updated."""
    out = []
    for now in times:
        while recent and recent[0] < now - window:
            recent.popleft()
        out.append(len(recent) < limit)
        if out[-1]:
            recent.append(now)
    return out


class LimiterProcessor(StatefulProcessor):
    """Per key: the accepted times of the last window, at most ``limit`` of them."""

    def __init__(self, limit: int, window_seconds: int):
        self.limit, self.window = limit, window_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", "t bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        recent = deque(r[0] for r in self.recent.get()) if self.recent.exists() else deque()
        frames = pd.concat(list(rows)).sort_values(["micros", "request_id"])
        frames["allowed"] = _accept(frames["micros"], recent, self.limit, self.window)
        if recent:
            self.recent.put([(int(t),) for t in recent])
        yield frames[["client", "request_id", "allowed"]]

    def close(self) -> None:
        pass


def limiter_stream(requests: DataFrame, limit: int = vocab.RATE_LIMIT, window_seconds: int = vocab.RATE_WINDOW_SECONDS) -> DataFrame:
    """``requests(client, request_id, micros)`` to allowed or refused; refused requests do not count."""
    return requests.groupBy("client").transformWithStateInPandas(
        LimiterProcessor(limit, window_seconds), "client bigint, request_id bigint, allowed boolean", "Append", "None")


def limit_requests(requests: DataFrame, limit: int = vocab.RATE_LIMIT, window_seconds: int = vocab.RATE_WINDOW_SECONDS) -> DataFrame:
    """Batch twin of the limiter: ``requests(client, request_id, micros)`` plus ``allowed``.

    A request with fewer than ``limit`` requests of its client in the window before it is always allowed.
    Only busy stretches need the running rule.  A stretch starts at a busy request whose window before it
    holds none, so its context is fully known, and stretches are independent units of work.  Counting works
    on time buckets of one window, so a client with a large share of the rows is spread out.
    """
    span = window_seconds * 1_000_000
    rows = requests.select("client", "request_id", "micros").withColumn("bucket", F.floor(F.col("micros") / span))
    buckets = F.explode(F.array(F.struct(F.col("bucket").alias("b"), F.lit(True).alias("own")), F.struct((F.col("bucket") + 1).alias("b"), F.lit(False).alias("own"))))
    spread = rows.select("client", "request_id", "micros", buckets.alias("x")).select("client", "request_id", "micros", "x.b", "x.own")
    before = Window.partitionBy("client", "b").orderBy("micros").rangeBetween(-span, 0)
    # Requests at the same microsecond count only when their id is lower.
    same = Window.partitionBy("client", "b", "micros").orderBy(F.desc("request_id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = spread.withColumn("seen", F.count(F.lit(1)).over(before) - F.count(F.lit(1)).over(same)).filter("own").select(
        "client", "request_id", "micros", (F.col("seen") >= limit).alias("busy"))
    calm = counted.filter("not busy")
    busy = counted.filter("busy")
    # Consecutive busy requests at most one window apart form a stretch.
    gaps = _stretches(busy, span)
    starts = gaps.groupBy("client", "stretch").agg(F.min("micros").alias("first"), F.max("micros").alias("last"))
    slots = starts.select("client", "stretch", "first", "last", F.explode(F.sequence(
        F.floor((F.col("first") - span) / span), F.floor(F.col("last") / span))).alias("slot"))
    around = counted.withColumn("slot", F.floor(F.col("micros") / span)).join(slots, ["client", "slot"]).filter(
        (F.col("micros") >= F.col("first") - span) & (F.col("micros") <= F.col("last"))).select("client", "stretch", "request_id", "micros", "busy")

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Whole partitions, sorted: of a stretch only the accepted times of one window are held, however long it is."""
        current, recent = None, deque()
        for frame in frames:
            allowed = []
            for client, stretch, now in zip(frame["client"].tolist(), frame["stretch"].tolist(), frame["micros"].tolist()):
                if (client, stretch) != current:
                    current, recent = (client, stretch), deque()
                allowed += _accept((now,), recent, limit, span)
            frame["allowed"] = allowed
            yield frame[frame["busy"]][["client", "request_id", "micros", "allowed"]]

    sorted_rows = around.repartition("client", "stretch").sortWithinPartitions("client", "stretch", "micros", "request_id")
    judged = sorted_rows.mapInPandas(kernel, "client bigint, request_id bigint, micros bigint, allowed boolean")
    return calm.select("client", "request_id", "micros", F.lit(True).alias("allowed")).unionByName(judged)


def _stretches(busy: DataFrame, span: int) -> DataFrame:
    """Busy requests with the start of their stretch, found over occupied windows instead of single requests."""
    slots = busy.withColumn("slot", F.floor(F.col("micros") / span)).groupBy("client", "slot").agg(
        F.min("micros").alias("low"), F.max("micros").alias("high"))
    order = Window.partitionBy("client").orderBy("slot")
    linked = slots.withColumn("new", F.coalesce(F.col("low") - F.lag("high").over(order) > span, F.lit(True)).cast("int"))
    named = linked.withColumn("stretch", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).select("client", "slot", "stretch")
    return busy.withColumn("slot", F.floor(F.col("micros") / span)).join(named, ["client", "slot"])


# ---- live status counts ----------------------------------------------------------------------------


def live_status_counts(changes: DataFrame, table: str, publish: Callable[[DataFrame, int], None], checkpoint: str):
    """Merge ``changes(item_id, seq, source, visual_status)`` into the latest-status table and count its rows.

    Counting the stream itself would count changes.  Versions by batch id keep a repeated batch harmless.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        rows = batch.select("item_id", "seq", "source", "visual_status")
        if batch_id > 0:
            rows = rows.unionByName(session.read.parquet(f"{table}/version={batch_id - 1}"))
        latest_by(rows, ["item_id"], ["seq"]).write.mode("overwrite").parquet(f"{table}/version={batch_id}")
        publish(metrics.stage_counts(session.read.parquet(f"{table}/version={batch_id}"), "visual"), batch_id)

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True)
