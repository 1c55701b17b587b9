"""Literal cases for text, label, facet and source rules."""

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import text as tx, values as vx
from shelfmark.functions.stem import porter
from shelfmark.operators import facets as fc, labels as lb, source as so
from shelfmark.sources import tables

CHAT = "\n".join(f"04:0{i}\n{line}" for i, line in enumerate(
    ["Are you coming tonight?", "Yes, after work today", "Great, see you at eight", "Bring the blue jacket", "I will not forget"]))
STACK = "Weather\nRain expected this afternoon\nMessages\nAnna sent you a photo\nMail\nYour weekly summary is ready\nCalendar\nMeeting with the team soon\nPhotos\nA new memory is waiting"


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def facets(spark, text, labels=()):
    frame = spark.createDataFrame([(1, text, list(labels))], "item_id int, ocr_text string, labels array<string>")
    return {e["id"]: e for e in fc.facet_evidence(frame).first()["facet_evidence"]}


def test_query_tokens(spark):
    assert one(spark, tx.query_tokens(F.col("t")), t="  Hello, WORLD!! ") == ["hello", "world"]
    assert one(spark, tx.query_tokens(F.col("t")), t="   !!!  ") == []
    assert len(one(spark, tx.query_tokens(F.col("t")), t=" ".join("abcdefghijklmnopq"))) == 17
    assert len(one(spark, tx.query_tokens(F.col("t"), 12), t=" ".join("abcdefghijklmnopq"))) == 12


def test_clean_text(spark):
    assert one(spark, tx.clean_text(F.col("t")), t="18:29\n85%\nPark Hyatt Tokyo confirmation") == "Park Hyatt Tokyo confirmation"
    assert one(spark, tx.clean_text(F.col("t")), t="a  b \t c\r\n\r\nLTE\nok then") == "a b c\nok then"


def test_titles(spark):
    assert one(spark, tx.normalize_title(F.col("t")), t="Café—Trip!  2024") == "cafe trip  2024"
    assert one(spark, tx.normalize_title(F.col("t")), t="a   b") == "a  b"
    for title, good in (("Japan Trip", True), ("Travel", False), ("ab", False), ("v1.2 notes", False), ("Screenshot one", False)):
        assert one(spark, tx.is_acceptable_title(F.col("t")), t=title) is good
    assert one(spark, tx.first_emoji(F.col("t")), t="✈️ go") == "✈️"
    assert one(spark, tx.first_emoji(F.col("t")), t="go") is None


@pytest.mark.parametrize("a, b, score", [("trip to japan", "trip to japn", 0.5), ("japan trip", "japan trip", 1.0), ("", "x", 0.0), ("abcd", "abcx", 0.75)])
def test_similarity(spark, a, b, score):
    assert one(spark, tx.similarity(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(score)


def test_redact(spark):
    assert one(spark, tx.redact(F.col("t")), t="key sk-abcdefgh123  Bearer abc") == "key [redacted] [redacted]"
    assert len(one(spark, tx.redact(F.col("t")), t="x" * 400)) == 278


def test_vector_bands(spark):
    rows = spark.createDataFrame([(0.40,), (0.80,), (1.20,)], "d double").select(vx.distance_band(F.col("d")).alias("b"))
    assert [r["b"] for r in rows.collect()] == ["strong", "weak", "far"]


def test_labels(spark):
    rows = [("sofa", 0.92, True), ("indoor", 0.99, True), ("text", 0.88, True), ("furniture", 0.81, True), ("noise", 0.10, False)]
    frame = spark.createDataFrame([(1, rows)], "item_id int, candidates array<struct<identifier:string,confidence:float,precision_ok:boolean>>")
    out = lb.filter_labels(frame).first()
    assert [x["identifier"] for x in out["filtered"]] == ["sofa", "furniture"]
    assert "indoor" in [x["identifier"] for x in out["raw"]]
    reasons = {x["identifier"]: x["reason"] for x in out["dropped"]}
    assert reasons == {"indoor": "low_information", "text": "low_information", "noise": "precision_gate"}


def test_label_cap_and_duplicates(spark):
    rows = [(f"l{i}", 0.9 - i / 100, True) for i in range(10)] + [("l0", 0.5, True), ("weak", 0.2, True), (" ", 0.4, True)]
    frame = spark.createDataFrame([(1, rows)], "item_id int, candidates array<struct<identifier:string,confidence:float,precision_ok:boolean>>")
    out = lb.filter_labels(frame).first()
    reasons = sorted((x["identifier"], x["reason"]) for x in out["dropped"])
    assert len(out["filtered"]) == 8
    assert reasons == [("(empty)", "empty"), ("l0", "duplicate"), ("l8", "over_cap"), ("l9", "over_cap"), ("weak", "below_confidence_floor")]


def test_legacy_labels(spark):
    rows = spark.createDataFrame([('["a"]',), ('[{"identifier": "b", "confidence": 0.5}]',), ("broken",), ("[]",)], "j string")
    out = [[(x["identifier"], x["confidence"]) for x in r["l"]] for r in rows.select(tables.label_array(F.col("j")).alias("l")).collect()]
    assert out == [[("a", 1.0)], [("b", 0.5)], [], []]


STRONG = [
    ("Boarding Pass DOH → NRT Seat 12A", "boarding_pass"),
    ("Park Hyatt Tokyo\nCheck-in 15:00\nCheck-out 11:00\nGuest room 1204\n2 nights accommodation", "hotel_booking"),
    (CHAT, "chat"),
    ("Subtotal $12.00 Tax $1.20 Total $13.20 Receipt #441", "receipt"),
    ("Instagram liked by anna and 40 others followers comments", "social_post"),
]


@pytest.mark.parametrize("text, name", STRONG)
def test_strong_facets(spark, text, name):
    assert facets(spark, text)[name]["strength"] == "strong"


def test_facet_conflicts(spark):
    flight = facets(spark, "Flight details\nAUH CGK\nTerminal 3\nCheck-in opens in 1 day\nPassenger Mr Example\nManage trip")
    assert any(flight.get(n, {"strength": ""})["strength"] == "strong" for n in ("boarding_pass", "flight_booking"))
    assert "hotel_booking" not in flight
    assert "hotel_booking" not in facets(spark, "Check-in reminder")
    assert "receipt" not in facets(spark, "Total sales strategy overview")
    assert facets(spark, CHAT)["chat"]["sources"] == ["ocr_structure"]
    stack = facets(spark, STACK)
    assert "chat" not in stack
    mixed = facets(spark, "Boarding Pass DOH → NRT Seat 12A Gate 4\n" + CHAT)
    assert mixed["boarding_pass"]["strength"] == "strong" and "chat" not in mixed


def test_facets_from_labels(spark):
    assert facets(spark, "Google Maps Directions 12 min walk to destination", ["map"])["map"]["strength"] == "strong"
    assert list(facets(spark, "", ["furniture"])) == ["interior_reference"]
    assert facets(spark, "", ["person"]) == {}


def source(spark, text, strong=()):
    frame = spark.createDataFrame([(1, text, list(strong))], "item_id int, ocr_text string, facets array<string>")
    return so.source_evidence(frame).first()


def test_source(spark):
    chat = source(spark, CHAT, ["chat"])
    assert (chat["platform"]["value"], chat["content_type"]["value"], chat["family"]["value"], chat["surface"]["value"]) == (
        "unknown", "chat", "messaging", "app_screen")
    lock = source(spark, "9:41\nGmail\nYour order has shipped\nSwipe up to unlock")
    assert (lock["surface"]["value"], lock["platform"]["value"], lock["content_type"]["value"]) == ("lock_screen", "unknown", "unknown")
    assert ("gmail", "notification") in [(h["value"], h["kind"]) for h in lock["embedded"]]
    gram = source(spark, "Instagram Liked by alex and others Comments", ["social_post"])
    assert (gram["platform"]["value"], gram["surface"]["value"], gram["embedded"]) == ("instagram", "app_screen", [])
    assert source(spark, "")["surface"]["value"] == "unknown"


@pytest.mark.parametrize("word, stem", [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"),
                                        ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("adjustable", "adjust"),
                                        ("adoption", "adopt"), ("controll", "control"), ("sky", "sky"), ("sized", "size")])
def test_stemmer(word, stem):
    assert porter(word) == stem


def test_needles_are_counted_in_whole_batches(spark):
    """Finds that run over from one text into the next, empty and null texts, needles in two groups, repeats, letters of several bytes."""
    texts = ["check", "in check-in", None, "", "é£", "£", "ss", "sss", "to", " to ", "a" * 9, "日本"]
    groups = {"one": ["check-in", "checkin", "kin", "to t", "£", "ss"], "two": [" to ", "£", "本", "aaa", "日本é"], "none": []}
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").repartition(1)
    found = {r["id"]: r["n"] for r in frame.select("id", tx.count_groups(F.col("t"), groups).alias("n")).collect()}
    for i, text in enumerate(texts):
        assert found[i].asDict() == {name: sum(n in (text or "") for n in group) for name, group in groups.items()}
    assert frame.filter("id < 0").select(tx.count_groups(F.col("t"), groups)).collect() == []


def test_line_facts_alone_equal_those_of_the_rules(spark):
    texts = [(None,), ("",), ("Today\n10:41\nAnna: see you at the gate\n10:42\nok then, bye bye\nDelivered",), ("Tax $1.00\nTotal 12,50\n" + "x" * 120,)]
    frame = spark.createDataFrame(texts, "t string")
    none = F.array().cast("array<string>")
    whole = fc.text_cues(F.col("t"), none, lambda get: F.struct(*[get(n).alias(n) for n in fc.LINE_FACTS]))
    for row in frame.select(whole.alias("whole"), fc.line_cues(F.col("t")).alias("alone")).collect():
        assert row["whole"].asDict() == row["alone"].asDict()


def test_common_needles_are_looked_for_text_by_text(spark):
    """More hits than ``FEW_HITS`` in a batch: nulls, empty texts, needles that run over into the next text, and letters of several bytes."""
    texts = [(i, [None, "", "tot", "al x", "total total", "Größe total", "größe"][i % 7]) for i in range(1400)]
    groups = {"a": ["total", "größe"], "b": ["missing"], "c": ["al"]}
    frame = spark.createDataFrame(texts, "id int, t string").coalesce(1)
    got = {r["id"]: r["n"].asDict() for r in frame.select("id", tx.count_groups(F.col("t"), groups).alias("n")).collect()}
    assert got == {i: {name: sum(n in (t or "") for n in needles) for name, needles in groups.items()} for i, t in texts}
    assert sum("total" in (t or "") for _, t in texts) > tx.FEW_HITS
