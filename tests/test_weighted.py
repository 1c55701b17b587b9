"""Weighted search against a plain loop, age words and the limit included."""

import datetime as dt
import random

from pyspark.sql import functions as F

from shelfmark.operators import search

NOW = dt.datetime(2026, 1, 1)
FIELDS = ("ocr", "summary", "entity", "collection", "label", "keyword")
JOINED = ("ocr", "summary", "entity", "keyword", "label", "collection")


def _plain(docs, query, limit):
    tokens, found = query.lower().split(), []
    for d in docs:
        fields = {f: d[f] if isinstance(d[f], str) else " ".join(d[f]) for f in FIELDS}
        points = matched = 0
        for t in tokens:
            hits = [f for f in FIELDS if t in fields[f] or (f == "label" and any(x in t for x in d[f]))]
            mine = sum(round(100 * search.FIELD_WEIGHTS[f]) for f in hits)
            if t in ("old", "older") and d["created_at"] and d["created_at"] < NOW - dt.timedelta(days=150):
                mine += 40
            points, matched = points + mine, matched + (mine > 0)
        if matched:
            cover = 0.55 + 0.45 * matched / len(tokens) if len(tokens) > 1 else 1.0
            whole = len(" ".join(tokens)) > 2 and " ".join(tokens) in " ".join(fields[f] for f in JOINED)
            found.append((points / 100 * cover + 0.55 * whole, d["created_at"] or dt.datetime.min, -d["item_id"], matched))
    return [(-i, m, round(s, 9)) for s, _, i, m in sorted(found, reverse=True)[:limit]]


def test_weighted_search_matches_plain_loop(spark):
    rng = random.Random(3)
    words = ["red", "oldtown", "lamp", "desk", "sofa", "bold", "rug"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [{"item_id": i, "created_at": rng.choice([None, *[NOW - dt.timedelta(days=50 * k) for k in range(12)]]), "ocr": text(rng.randrange(3)),
             "summary": text(1), "entity": [text(1)], "collection": [text(2)] * rng.randrange(2), "label": ["a", "lamp"][: rng.randrange(3)], "keyword": []}
            for i in range(120)]
    schema = "item_id bigint, created_at timestamp, ocr string, summary string, " + ", ".join(f"{f} array<string>" for f in FIELDS[2:])
    frame = spark.createDataFrame([tuple(d[c] for c in ("item_id", "created_at", *FIELDS)) for d in docs], schema)
    asked = {1: "old", 2: "old lamp", 3: "older old desk", 4: "zebra old", 5: "red sofa", 6: "zebra", 7: ""}
    queries = spark.createDataFrame(list(asked.items()), "query_id bigint, query string")
    for limit in (5, 40, 500):
        got = {}
        for r in search.weighted_search(frame, queries, F.lit(NOW), limit=limit).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["item_id"], r["matched"], round(r["score"], 9)))
        assert got == {q: want for q, text_ in asked.items() if (want := _plain(docs, text_, limit))}


def test_weighted_search_without_limit_returns_every_match(spark):
    """More older items than the usual limit, most without a hit: all of them match the age word."""
    docs = [(i, NOW - dt.timedelta(days=200 + i), "red lamp" if i % 7 == 0 else "desk", "s", [], [], ["x"], []) for i in range(260)]
    schema = "item_id bigint, created_at timestamp, ocr string, summary string, " + ", ".join(f"{f} array<string>" for f in FIELDS[2:])
    frame = spark.createDataFrame(docs, schema)
    queries = spark.createDataFrame([(1, "red lamp old"), (2, "lamp red"), (3, "zebra old")], "query_id bigint, query string")
    rows = [dict(zip(("item_id", "created_at", *FIELDS), d)) for d in docs]
    got = {}
    for r in search.weighted_search(frame, queries, F.lit(NOW), limit=None).collect():
        got.setdefault(r["query_id"], set()).add((r["item_id"], r["matched"], round(r["score"], 9)))
    assert got == {q: set(_plain(rows, t, None)) for q, t in ((1, "red lamp old"), (2, "lamp red"), (3, "zebra old"))}
    assert len(got[1]) == len(got[3]) == 260


def test_containing_words_match_plain_loop(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randrange(1, 8)))
    words, tokens = {word() for _ in range(60)}, {word() for _ in range(60)}
    frame = lambda values, name: spark.createDataFrame([(v,) for v in values], f"{name} string")
    for shortest in (1, 2, 3):
        got = {tuple(r) for r in search.containing_words(frame(words, "word"), frame(tokens, "token"), shortest).collect()}
        assert got == {(w, t) for w in words for t in tokens if len(t) >= shortest and t in w}


def test_hits_are_added_up_over_blocks(spark):
    """Repeated tokens, items and queries, an item without hits, queries with the same id, and none of the pairs of a token as a row."""
    rng = random.Random(9)
    tokens = [f"t{i}" for i in range(12)]
    queries = [(q % 25 if q else None, q, q % 3, [(t, rng.randrange(1, 4), rng.randrange(2)) for t in rng.sample(tokens, rng.randrange(1, 6))]) for q in range(40)]
    items = [(i % 30, [(t, rng.randrange(1, 500)) for t in rng.sample(tokens[:9], rng.randrange(5))] if i < 30 else [], i >= 30 or i % 4 == 0) for i in range(45)] + [(None, [("t1", 7)], False)]
    frames = (spark.createDataFrame(queries, "query_id bigint, ask bigint, age_words int, words array<struct<token:string,times:bigint,aged:bigint>>"),
              spark.createDataFrame(items, "item_id bigint, words array<struct<token:string,points:bigint>>, old boolean"))
    wanted = set()
    for query, ask, age, words in queries:
        for item in {i[0] for i in items}:
            points = {t: p for i, w, _ in items if i == item for t, p in w}
            sums = [sum(f(t, n, a) for t, n, a in words if t in points) for f in (lambda t, n, a: n * points[t], lambda t, n, a: n, lambda t, n, a: a)]
            if sums[1] or (age and any(o for i, _, o in items if i == item)):
                wanted.add((query, ask, item, *sums))
    for blocks in ((1, 1), (3, 4)):
        rows = [tuple(r[c] for c in ("query_id", "ask", "item_id", "points", "hit", "age_hit")) for r in search._summed_hits(*frames, *blocks).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == wanted
