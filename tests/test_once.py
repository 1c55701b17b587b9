"""Costly values are worked out once for each row, however often the result names them."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import text as tx
from shelfmark.operators import labels as lb, search


def _count(frame, word: str) -> int:
    return frame._jdf.queryExecution().optimizedPlan().toString().count(word)


def _texts(spark, *texts):
    return spark.range(len(texts)).select("id", F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("id") + 1).cast("int")).alias("text"))


def test_labels_are_ordered_once(spark):
    row = "array<struct<identifier:string,confidence:float,precision_ok:boolean>>"
    items = spark.createDataFrame([(1, [("Sofa ", 0.9, True), ("sofa", 0.5, True), ("", 0.8, True), ("lamp", 0.1, True)]), (2, []), (3, None)], f"item_id long, candidates {row}")
    out = lb.filter_labels(items)
    assert _count(out, "array_sort(") == 1
    got = {r["item_id"]: r for r in out.collect()}
    assert [x["identifier"] for x in got[1]["filtered"]] == ["sofa"] and [x["identifier"] for x in got[1]["raw"]] == ["sofa", "lamp"]
    assert [x["reason"] for x in got[1]["dropped"]] == ["empty", "duplicate", "below_confidence_floor"]
    assert got[2]["filtered"] == [] and got[3]["filtered"] is None


def test_phrases_and_redaction_read_the_text_once(spark):
    texts = _texts(spark, "Great houses stand, great houses on hill side", "abc", "", None)
    out = texts.select(tx.phrases(F.col("text")).alias("p"))
    assert _count(out, "split(") == 1
    assert [r["p"] for r in out.collect()] == [["great houses", "houses stand", "stand great", "houses hill", "hill side"], [], [], None]
    hidden = _texts(spark, "  a\n b ", " ", "x" * 300, None).select(tx.redact(F.col("text")).alias("r"))
    assert _count(hidden, "\\s+,") <= 2     # the blanks inside, and those at the ends
    assert [r["r"] for r in hidden.collect()] == ["a b", None, "x" * 277 + "…", None]


def test_postings_cut_a_text_once(spark):
    items = _texts(spark, "red lamp, red", "…", "", None).select(F.col("id").alias("item_id"), F.col("text").alias("ocr_text"))
    out = search.build_postings(items)
    assert _count(out, "split(") == 1
    assert sorted(map(tuple, out.select("term", "item_id", "tf", "doc_length").collect())) == [("lamp", 0, 1, 3), ("red", 0, 2, 3)]
