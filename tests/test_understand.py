"""Candidate titles of the rule-based understanding, against plain loops."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from shelfmark import vocab
from shelfmark.functions import text as tx
from shelfmark.operators import profiles as pf, resolve as op, understand as un

SEEDS = (("city", "Bonn am", ("bonn",)), ("topic", "Haus", ("haus", "dach")), ("topic", "Home", ("haus",)))
RULES = (("Haus", "xyz", "Bau Haus", "🏠", 0.9),)
LABELS = "array<struct<identifier:string,confidence:float>>"


def _plan(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_contained_tokens_match_plain_loop(spark):
    rng = random.Random(3)
    word = lambda low, high: "".join(rng.choice("ab1.-\n") for _ in range(rng.randrange(low, high)))
    texts = [" ".join(word(0, 9) for _ in range(6)) for _ in range(40)] + ["", None]
    for marks in ("ab1.-", "ab", "a\nb"):       # with and without the characters at which texts could be cut
        tokens = {t for t in ("".join(rng.choice(marks) for _ in range(rng.randrange(3, 5))) for _ in range(30))}
        frame = spark.createDataFrame(list(enumerate(texts)), "item_id long, low string")
        found = pf.contained_tokens(frame, spark.createDataFrame([(t,) for t in tokens], "token string"))
        assert sorted(map(tuple, found.collect())) == sorted((i, t) for i, text in enumerate(texts) if text for t in tokens if t in text)
    # Texts are cut once, not once for the dictionary and again for the finds.
    assert _plan(found).count("array_distinct(split(") == 1
    none = pf.contained_tokens(frame, spark.createDataFrame([], "token string"))
    assert none.count() == 0


def _score(title, text, named, names, seen, known):
    low = title.lower()
    tokens = [t for t in re.split(r"[\W_]+", low) if len(t) >= 3]
    hits = float(sum(t in text for t in tokens))
    hits += sum(v.lower() in low or any(w in low for w in v.lower().split(" ") if w) for v in named)
    hits += 0.5 * len({d.lower() for d in seen} & set(names)) + 0.75 * sum(v.lower() in {k.lower() for k in known} for v in named)
    hits += 0.6 * (("japan" in low or "trip" in low) and bool(set(names) & set(vocab.TRAVEL_LABELS))) + 0.6 * ("apartment" in low and "sofa" in names)
    return round(min(0.96, hits / len(tokens) * 0.85 + 0.15 * (hits >= len(tokens))), 6) if tokens else 0.0


def test_candidates_match_plain_loop_with_repeated_rows(spark):
    rng = random.Random(5)
    vocabulary = ["bonn", "haus", "dach", "trip", "japan", "apartment", "home", "amt", "zug", "rot", "über"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, n)))
    items = [(i, text(5), [(x, 0.5) for x in rng.sample(["sofa", "airplane", "lamp"], rng.randrange(0, 3))], []) for i in range(25)]
    items += [items[3], items[3], (4, "haus zug rot", [], [])]     # one row three times, one id with two texts
    titles = [text(4).title() + rng.choice(["", " Haus", " Trip"]) for _ in range(20)]
    contexts = [(k, t, rng.sample(["haus", "Home", "rot"], 2), rng.sample(["Sofa", "lamp", "LAMP"], 2)) for k, t in enumerate(titles)]
    contexts += [contexts[1], (2, "Haus Zug", ["Home"], [])]       # a collection that comes twice, one id with two titles
    frame = spark.createDataFrame(items, f"item_id long, ocr_text string, labels {LABELS}, facets array<string>")
    known = spark.createDataFrame(contexts, "collection_id long, title string, key_entities array<string>, visual_descriptors array<string>")
    result = un.understand(frame, known, SEEDS, RULES)
    got = {}
    for row in result.collect():
        got.setdefault(row["item_id"], []).append([(c["title"], c["confidence"], c["signals"][0]) for c in row["candidates"]])
    want = {}
    for i, words, labels, _ in items:
        names = [x for x, _ in labels]
        named = [v for _, v, needles in SEEDS if any(n in words for n in needles)] + (["Apartment"] if "sofa" in names else [])
        for key, title, entities, seen in contexts:
            score = _score(title, words, named, names, seen, entities)
            if score >= 0.4:
                want.setdefault(i, []).append((-score, key, title, "ocr_title_overlap" if words else "vision_profile_overlap"))
    for i, rows in got.items():
        assert len(rows) == sum(row[0] == i for row in items)
        listed = [(t, -s, signal) for s, _, t, signal in sorted(want.get(i, []))]
        for row in rows:
            assert row == listed, i


def test_settling_proposals_does_not_score_twice(spark):
    frame = spark.createDataFrame([(1, "haus", [], [])], f"item_id long, ocr_text string, labels {LABELS}, facets array<string>")
    known = spark.createDataFrame([(7, "bau haus", [], [])], "collection_id long, title string, key_entities array<string>, visual_descriptors array<string>")
    result = un.understand(frame, known, SEEDS, RULES)
    assert _plan(result).count("ocr_title_overlap") == 1
    row = result.first()
    assert [c["title"] for c in row["candidates"]] == ["bau haus"] and row["proposed"] is None
    assert result.select(F.size("entities")).first()[0] == 2


def test_titles_are_worked_out_once_each(spark):
    frame = spark.createDataFrame([("Bau Haus",), ("Bau Haus",), (None,), ("?",)], "title string")
    keys = op.once_each(frame).select("title", tx.normalize_title(F.col("one")).alias("key")).filter("key <> ''")
    assert [tuple(r) for r in keys.collect()] == [("Bau Haus", "bau haus")]
    # A filter on the key stays above the grouping; below it would be worked out for every row.
    plan = _plan(keys)
    assert plan.index("key") < plan.index("Aggregate") and "translate" not in plan[plan.index("Aggregate"):]
