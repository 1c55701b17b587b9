"""Helpers that the corpus operators share: registry, shared folders, plain words, numbering and grouping of linked nodes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# The six characters that end a word, for Spark's regular expressions and for trim().
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"


def query(name: str, sql: str | None = None):
    """Register ``build(spark, folder)`` under ``name``; ``sql`` states the same rows for DuckDB."""

    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLE[name] = sql
        return build

    return register


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that ``spark.checkpoint.dir`` names; a local session without it gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        base = tempfile.mkdtemp(prefix="shelfmark-llm-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def land(frame: DataFrame, name: str) -> DataFrame:
    """Write ``frame`` to the shared folder and read it back: later steps start from files that outlive executors."""
    spark = frame.sparkSession
    folder = shared_folder(spark, name)
    frame.write.parquet(folder)
    return spark.read.schema(frame.schema).parquet(folder)


def located(frame: DataFrame, file: str = "_file", row: str = "_row") -> DataFrame:
    """Add the place of each row: its file and its number there.  A frame that isn't read from Parquet is landed first."""
    place = [F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row)]
    try:
        return frame.select("*", *place)
    except AnalysisException:
        return land(frame, "rows").select("*", *place)


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, made longer until none of ``frames`` has a column of that name."""
    taken = {c.lower() for frame in frames for c in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def joined_to_one(rows: DataFrame, ones: DataFrame, key: str, count: str, spread: Column) -> DataFrame:
    """``rows`` joined to ``ones``, which has one row for each ``key`` and the ``count`` of rows that share it.

    Keys with more rows than an even share are fewer than the partitions, so they are broadcast as keys; their rows are dealt out by ``spread``
    and their one row is copied to each part.  All other keys are joined as they are.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    even = ones.agg(F.greatest(F.sum(count) / parts, F.lit(1000)).alias("_even"))
    hot = ones.crossJoin(F.broadcast(even)).filter(F.col(count) > F.col("_even")).select(key, F.lit(True).alias("_hot"))
    salt = lambda part: F.when(F.col("_hot"), part)
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", F.coalesce(salt(F.pmod(spread, F.lit(parts))), F.lit(0))).drop("_hot")
    copied = ones.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.explode(F.coalesce(salt(F.sequence(F.lit(0), F.lit(parts - 1))), F.array(F.lit(0))))).drop("_hot")
    return dealt.join(copied, [key, "_salt"]).drop("_salt")


def each_batch(frame: DataFrame, work: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` over ``frame``: ``work(batches)`` yields tuples of columns in the order of ``schema``."""
    ship_package(frame.sparkSession)
    empty = frame.sparkSession.createDataFrame([], schema)
    names = empty.columns
    types = [_arrow_type(kind) for _, kind in empty.dtypes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in work(batches):
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, kind) for c, kind in zip(columns, types)], names=names)

    return frame.mapInArrow(run, schema)


def _arrow_type(kind: str) -> pa.DataType:
    if kind.startswith("array<"):
        return pa.list_(_arrow_type(kind[6:-1]))
    return {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}[kind]


def raw_texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [text or b"" for text in column.cast(pa.binary()).to_pylist()]


def word_array(text: Column) -> Column:
    """Words between runs of the six spaces, as an array; none gives the empty array."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is.  Texts of one byte a character take Spark's quick path."""
    upper = "".join(map(chr, range(65, 91)))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower()))


def numbered(frame: DataFrame, order: list[Column], column: str = "position", name: str = "numbered") -> DataFrame:
    """Add each row's place (from 0) in the order given, without gathering rows in one task.

    Rows are dealt out by ranges of the order, sorted there and landed with their place in the range; what
    earlier ranges hold is then added.  The table of ranges has a row for each partition, so it is broadcast.
    """
    spark = frame.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (frame.repartitionByRange(parts, *order).sortWithinPartitions(*order)
              .withColumn("_at", F.monotonically_increasing_id()))
    landed = land(ranged, name)
    part = F.shiftright("_at", 33)
    counts = {row[0]: row[1] for row in landed.groupBy(part.alias("p")).count().collect()}  # a row for each partition
    before, total = [], 0
    for key in sorted(counts):
        before.append((key, total))
        total += counts[key]
    starts = spark.createDataFrame(before, "_part long, _before long")
    return (landed.withColumn("_part", part).join(F.broadcast(starts), "_part")
            .withColumn(column, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_before"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges(a, b)``: root is the smallest node that can be reached.

    Alternates large-star and small-star steps, which keep the edges few and halve the paths.  Each round is
    landed in the shared folder; only its row count and checksum reach the driver.
    """
    edges = land(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(low.select("a", F.col("m").alias("b"))).distinct())
        edges = land(small, "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
