"""Exact duplicates by stateful streaming: keyed state on disk, without expiry, and full bytes compared on hits.

A stream reads digest rows as they arrive and keeps, for every digest ever seen, the best row (largest id, then
largest locator) and the number of rows.  The state is RocksDB's, checkpointed in the state folder, so a later
call with the same folder goes on from it.  A digest that was seen more than once is a hit; the texts of
hits are compared byte for byte with the text at the kept row's locator (its file and its row there), and a digest under which texts
differ is settled by the texts themselves, those of earlier calls read by their locators.  Files named by locators must stay.

Everything is DataFrame operations.  A hot digest is counted before the shuffle, and its rows are dealt out over
several tasks, each with a copy of the one kept row (``joined_to_one``).

Null text counts as empty.  A null id is the smallest.  Rows with equal text and id are told apart by their
locator; exactly one of them stays.  An empty table gives no rows.  Other columns may have any names: the rows are carried as one struct.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import ascii_lower, joined_to_one, land, located, shared_folder

# RocksDB on disk; its log files aren't allocated ahead, as many partitions hold little state each: with 211 of them
# the files allocated ahead took more than the state itself.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
LOCATOR = ("_file", "_row")


def sha256(text: Column) -> Column:
    """32 bytes."""
    return F.unhex(F.sha2(text, 256))


class Seen:
    """What has arrived so far.  ``folder`` holds the state; leave it out for a state of one use."""

    def __init__(self, spark: SparkSession, folder: str | None = None, *, id_column: str = "doc_id", text_column: str = "text",
                 digest=sha256, files_per_batch: int | None = None):
        self.spark, self.folder = spark, folder or shared_folder(spark, "seen")
        self.id, self.text, self.digest, self.files = id_column, text_column, digest, files_per_batch

    def _body(self) -> Column:
        return ascii_lower(F.coalesce(F.col(f"`{self.text}`"), F.lit("")))

    def located(self, docs: DataFrame) -> DataFrame:
        """The columns of id and text, the whole row as a struct ``_all``, and the locator."""
        names = [f"`{c}`" for c in docs.columns]
        return located(docs.select(f"`{self.id}`", f"`{self.text}`", F.struct(*names).alias("_all")), *LOCATOR)

    def _texts(self, rows: DataFrame) -> DataFrame:
        return rows.select(F.col(f"`{self.id}`").cast("long").alias("id"), self._body().alias("body"), *LOCATOR).withColumn("digest", self.digest(F.col("body")))

    def arrive(self, rows: DataFrame, batch: str | None = None) -> str:
        """Take in more rows (of ``located``) and run the stream until it has read them; the folder of what arrived.

        A ``batch`` name makes the call repeatable: what arrived whole under it is not written again.
        """
        spark = self.spark
        arrived = f"{self.folder}/arrivals/{batch or uuid.uuid4().hex}"
        if not _written(spark, arrived):
            self._texts(rows).drop("body").write.mode("overwrite").parquet(arrived)
        kept = {key: spark.conf.get(key, None) for key in STATE}
        for key, value in STATE.items():
            spark.conf.set(key, value)
        try:
            source = spark.readStream.schema(spark.read.parquet(arrived).schema)
            if self.files:
                source = source.option("maxFilesPerTrigger", self.files)
            state = (source.parquet(f"{self.folder}/arrivals/*").groupBy("digest")
                     .agg(F.max(F.struct("id", *LOCATOR)).alias("best"), F.count("*").alias("n")))
            updates = f"{self.folder}/updates"
            stream = (state.writeStream.outputMode("update").option("checkpointLocation", f"{self.folder}/state")
                      .foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{updates}/batch={number}"))
                      .trigger(availableNow=True).start())
            stream.awaitTermination()
        finally:
            for key, value in kept.items():
                spark.conf.unset(key) if value is None else spark.conf.set(key, value)
        return arrived

    def state(self) -> DataFrame:
        """(digest, best, n): the last update of each digest; ids and counts only grow, so it is the largest."""
        updates = self.spark.read.parquet(f"{self.folder}/updates")
        return updates.groupBy("digest").agg(F.max("best").alias("best"), F.max("n").alias("n"))

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/arrivals/*")

    def bodies(self, places: DataFrame) -> DataFrame:
        """``places(_file, _row, …)`` with the texts that stand there; only the files named are read."""
        files = [r[0] for r in places.select("_file").distinct().collect()]  # names of files, not rows
        if not files:
            return places.withColumn("body", F.lit(""))
        read = self.spark.read.schema(f"`{self.text}` string").parquet(*files)
        held = read.select(self._body().alias("body"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
        return held.join(places, list(LOCATOR))


def _written(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def decide(rows: DataFrame, seen: Seen, batch: str | None = None) -> DataFrame:
    """A row for each of ``rows`` (of ``seen.located``): id, locator, digest, whether it stays, the id that stays, group size."""
    spark, arrived = seen.spark, seen.arrive(rows, batch)
    state = land(seen.state(), "state")
    place, best_place, spread = F.struct(*LOCATOR), F.struct("best._file", "best._row"), F.xxhash64(*LOCATOR)
    repeated = state.filter("n > 1")
    hits = land(joined_to_one(seen._texts(rows), repeated, "digest", "n", spread), "hits")
    first = hits.filter(place == best_place).select("digest", "n", F.col("body").alias("kept_body"))
    # Where the kept row came in an earlier call, its bytes are read at its locator.
    earlier = land(hits.select("digest", "best", "n").distinct().join(first, "digest", "left_anti").select("digest", "n", "best._file", "best._row"), "earlier")
    first = first.unionByName(seen.bodies(earlier).select("digest", "n", F.col("body").alias("kept_body")))
    compared = joined_to_one(hits.select("digest", "body", *LOCATOR), first, "digest", "n", spread)
    differing = land(compared.filter(F.col("body") != F.col("kept_body")).select("digest").distinct(), "differing")
    own = joined_to_one(spark.read.parquet(arrived), state, "digest", "n", spread)
    decided = own.select("id", *LOCATOR, "digest", F.col("best.id").alias("keep_id"), (place == best_place).alias("kept"), F.col("n").alias("group_size"))
    if differing.isEmpty():
        return decided
    texts = land(seen.bodies(seen.rows().join(differing, "digest", "left_semi")), "texts")
    groups = texts.groupBy("digest", "body").agg(F.max(F.struct("id", *LOCATOR)).alias("own"), F.count("*").alias("size"))
    exact = texts.join(groups, ["digest", "body"]).join(spark.read.parquet(arrived).select(*LOCATOR), list(LOCATOR), "left_semi").select(
        "id", *LOCATOR, "digest", F.col("own.id").alias("keep_id"), (place == F.struct("own._file", "own._row")).alias("kept"),
        F.col("size").alias("group_size"))
    return decided.join(differing, "digest", "left_anti").unionByName(exact)


def exact_groups(docs: DataFrame, batch: str | None = None, **options) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document.  ``options``: see ``Seen``."""
    seen = Seen(docs.sparkSession, **options)
    decided = decide(seen.located(docs), seen, batch)
    return decided.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def distinct_texts(docs: DataFrame, batch: str | None = None, **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    seen = Seen(docs.sparkSession, **options)
    rows = seen.located(docs)
    gone = decide(rows, seen, batch).filter("not kept").select(*LOCATOR)
    return rows.join(gone, list(LOCATOR), "left_anti").select("_all.*")
