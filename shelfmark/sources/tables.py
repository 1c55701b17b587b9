"""Reading listings and stored tables, and keeping whole-table snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

LISTING_SCHEMA = "external_id string, created_at timestamp, width int, height int, is_screenshot boolean"
LABELS = T.ArrayType(T.StructType([T.StructField("identifier", T.StringType()), T.StructField("confidence", T.FloatType())]))
STRINGS = T.ArrayType(T.StringType())
EVIDENCE = T.ArrayType(T.StructType([
    T.StructField("id", T.StringType()), T.StructField("confidence", T.DoubleType()),
    T.StructField("strength", T.StringType()), T.StructField("sources", STRINGS)]))


def scan_listing(assets: DataFrame) -> DataFrame:
    """The listed screenshots: ``(external_id, created_at, width, height)``."""
    return assets.filter("is_screenshot").select("external_id", "created_at", "width", "height")


def read_listing(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A listing written as parquet, json, csv or orc, with its schema given and not inferred."""
    reader = spark.read.schema(LISTING_SCHEMA)
    if fmt == "csv":
        reader = reader.option("header", True)
    return scan_listing(reader.format(fmt).load(path))


def string_array(json: Column) -> Column:
    """A JSON list of strings; missing or broken text gives an empty list."""
    return F.coalesce(F.from_json(json, STRINGS), F.array().cast(STRINGS))


def label_array(json: Column) -> Column:
    """Labels stored as objects, or as plain strings by older versions (confidence 1)."""
    objects = F.from_json(json, LABELS)
    plain = F.transform(F.from_json(json, STRINGS), lambda x: F.struct(x.alias("identifier"), F.lit(1.0).cast("float").alias("confidence")))
    is_object_list = json.rlike(r"^\s*\[\s*(\{|\])")
    return F.coalesce(F.when(is_object_list, objects), plain, F.array().cast(LABELS))


def evidence_array(json: Column) -> Column:
    return F.coalesce(F.from_json(json, EVIDENCE), F.array().cast(EVIDENCE))


def known_value(value: Column, allowed: tuple[str, ...], default: str) -> Column:
    """An enum stored as text; anything unknown becomes the default."""
    return F.when(value.isin(*allowed), value).otherwise(F.lit(default))


def decode_items(rows: DataFrame) -> DataFrame:
    """Stored item rows to typed ones; JSON text columns become arrays and enums are checked."""
    from shelfmark import vocab

    known = {
        "labels_json": ("labels", label_array), "raw_labels_json": ("raw_labels", label_array),
        "facets_json": ("facets", string_array), "evidence_json": ("facet_evidence", evidence_array)}
    out = rows
    for name, (target, decode) in known.items():
        if name in rows.columns:
            out = out.withColumn(target, decode(F.col(name))).drop(name)
    enums = {"ocr_status": (vocab.STAGE_STATUSES, "pending"), "visual_status": (vocab.STAGE_STATUSES, "pending"),
             "organize_status": (vocab.ORGANIZE_STATUSES, "idle"), "access_state": (("available", "inaccessible"), "available")}
    for name, (allowed, default) in enums.items():
        if name in rows.columns:
            out = out.withColumn(name, known_value(F.col(name), allowed, default))
    return out


def load_tables(spark: SparkSession, folder: str, names: list[str], fmt: str = "parquet") -> dict[str, DataFrame]:
    """Stored tables by name; an ``items`` table is decoded."""
    tables = {n: spark.read.format(fmt).load(f"{folder}/{n}") for n in names}
    if "items" in tables:
        tables["items"] = decode_items(tables["items"])
    return tables


def save_snapshot(tables: dict[str, DataFrame], folder: str, snapshot_id: str) -> None:
    """Write every table below ``snapshot_id=…``; an existing snapshot of that name is an error."""
    for name, df in tables.items():
        df.write.mode("error").parquet(f"{folder}/{name}/snapshot_id={snapshot_id}")


def restore_snapshot(spark: SparkSession, folder: str, names: list[str], snapshot_id: str) -> dict[str, DataFrame]:
    """The tables as they were saved.  Only the wanted snapshot's folder is read."""
    return {n: spark.read.parquet(f"{folder}/{n}/snapshot_id={snapshot_id}") for n in names}
