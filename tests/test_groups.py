"""Grouping: literal cases, and the block kernel against a plain loop over whole pools."""

import datetime as dt
import random

from pyspark.sql import functions as F

from shelfmark import vocab
from shelfmark.operators import cluster as cl, facets as fc, pairs as op, source as so
from shelfmark.operators.ranking import group_row_number

START = dt.datetime(2024, 1, 1)


def features(spark, rows):
    """``rows`` are (id, pool, minutes, text, labels)."""
    frame = spark.createDataFrame(
        [(i, p, START + dt.timedelta(minutes=m), t, ls) for i, p, m, t, ls in rows],
        "item_id bigint, pool_key string, created_at timestamp, ocr_text string, labels array<string>")
    typed = frame.withColumn("facets", fc.strong_facets(fc.facets_of(F.col("ocr_text"), F.col("labels"))))
    sourced = typed.select("*", so.source_of(F.col("ocr_text"), F.col("facets")).alias("s")).select(
        *typed.columns, F.col("s.platform.value").alias("platform"), F.col("s.content_type.value").alias("content_type"), F.col("s.family.value").alias("family"))
    return op.member_features(sourced)


def group_of(spark, rows, seed):
    found = features(spark, rows)
    groups = cl.cluster_items(found, op.score_pairs(found))
    return groups.filter(F.col("seed_id") == seed).first()


TRIP = [
    (1, 20, "boarding pass DOH NRT seat 12a", ["airplane"], ["boarding_pass"], 0.8),
    (2, 10, "park hyatt tokyo confirmation number HX99122", [], ["hotel_booking"], 0.8),
    (3, 5, "google maps directions to park hyatt", ["map"], ["map"], 0.7),
    (4, 1, "", ["landmark", "skyscraper"], ["travel_imagery"], 0.6),
    (5, 15, "lol meme funny chat", ["person"], ["chat"], 0.0),
]


def test_trip_group(spark):
    rows = [(i, "a", START + dt.timedelta(minutes=m), t, ls, fs, s, ["Weekend Context"] if s else []) for i, m, t, ls, fs, s in TRIP]
    frame = spark.createDataFrame(rows, "item_id bigint, pool_key string, created_at timestamp, ocr_text string, labels array<string>, "
                                        "facets array<string>, profile_score double, profile_titles array<string>")
    found = op.member_features(frame)
    row = cl.cluster_items(found, op.score_pairs(found)).filter("seed_id = 1").first()
    assert set(row["member_ids"]) >= {1, 2, 3} and 5 not in row["member_ids"]
    assert row["supported_edges"] > 0 and row["singleton_reason"] is None


def test_shared_reference(spark):
    row = group_of(spark, [(1, "a", 4320, "confirmation number ZX44K91 window desk", []), (2, "a", 0, "confirmation number ZX44K91 corridor lamp", [])], 1)
    assert set(row["member_ids"]) == {1, 2} and row["cluster_id"] == "c_1_2"


def test_no_peers(spark):
    row = group_of(spark, [(1, "a", 0, "alone here", [])], 1)
    assert row["singleton_reason"] == "no_peers_in_pool" and row["member_ids"] == [1] and row["input_peers"] == 0


def test_platform_alone_is_not_enough(spark):
    rows = [(1, "a", 60000, "whatsapp first words", []), (2, "a", 0, "whatsapp other thing", [])]
    found = features(spark, rows)
    pair = op.score_pairs(found).first()
    parts = dict(zip(op.PARTS, pair["parts"]))
    assert (parts["source_platform"], parts["content_type"], parts["content_family"]) == (0.04, 0.05, 0.04)
    assert not pair["contextual"]
    row = group_of(spark, rows, 1)
    assert row["singleton_reason"] == "peers_scored_none_admitted"
    assert row["rejected"][0]["reason"] == "type_alone_insufficient"


def plain_group(ranks, edge, sparse, seed):
    """The same rules, written straight over a whole pool."""
    peers = [r for r in ranks if seed < r < seed + vocab.POOL_SIZE]
    order = sorted(peers, key=lambda p: (-edge(seed, p)[0], p))[:vocab.RETRIEVAL_SIZE]
    members = [seed]
    for p in order:
        total, contextual, _ = edge(seed, p)
        if len(members) < 8 and contextual and total >= 0.32:
            members.append(p)
    for p in order:
        if p in members or len(members) >= 8 or len(members) < 2:
            continue
        if edge(seed, p)[0] >= 0.26 and any(edge(p, m)[1] and edge(p, m)[0] >= 0.38 for m in members[1:]):
            members.append(p)
    for p in order:
        if p in members or len(members) >= 8 or len(members) < 2 or not sparse[p] or edge(seed, p)[2][op.PARTS.index("feature_print")] < 0.12:
            continue
        near = edge(seed, p)[1] or any(edge(p, m)[1] and edge(p, m)[0] >= 0.38 for m in members)
        if near and edge(seed, p)[0] >= 0.26:
            members.append(p)
    if len(members) > 1:
        mean = {m: sum(edge(m, o)[0] for o in members if o != m) / (len(members) - 1) for m in members}
        members = [seed] + [m for m in members[1:] if mean[m] >= 0.20]
    if not any(edge(a, b)[1] for i, a in enumerate(members) for b in members[i + 1:]):
        members = [seed]
    return members


def test_kernel_matches_plain_loop_on_a_hot_pool(spark):
    rng = random.Random(5)
    words = ["lantern", "harbour", "meadow", "granite", "whisper", "copper", "velvet", "orchard", "thunder", "saffron"]
    rows = []
    for i in range(260):
        pool = "hot" if i % 4 else f"p{i % 3}"
        text = " ".join(rng.sample(words, 3)) + f" ticket {rng.randint(1, 40)}" + (" whatsapp" if rng.random() < 0.3 else "")
        rows.append((i, pool, rng.randint(0, 6000), text, ["plant", "stone"][: rng.randint(0, 2)]))
    found = features(spark, rows).checkpoint()
    pairs = op.score_pairs(found).checkpoint()
    table = {}
    for r in pairs.collect():
        table[r["pool_key"], r["seed_rank"], r["peer_rank"]] = (r["total"], r["contextual"], r["parts"])
    names = {(r["pool_key"], r["pool_rank"]): r["item_id"] for r in op.pool_ranks(found).collect()}
    sparse_ids = {r["item_id"]: r["sparse"] for r in found.collect()}
    got = {r["seed_id"]: r["member_ids"] for r in cl.cluster_items(found, pairs).collect()}
    assert len(got) == 260 and any(len(v) > 2 for v in got.values())
    for (pool, rank), item in names.items():
        ranks = sorted(r for p, r in names if p == pool)
        edge = lambda a, b, pool=pool: table[pool, min(a, b), max(a, b)]
        sparse = {r: sparse_ids[names[pool, r]] for r in ranks}
        assert got[item] == [names[pool, m] for m in plain_group(ranks, edge, sparse, rank)]


def test_groups_read_the_pair_table_once(spark):
    """Every step after the first works on the arrays made from it."""
    rows = [(i, "a", i, f"confirmation number ZX44K{i % 3} window desk", []) for i in range(60)]
    found = features(spark, rows).checkpoint()
    pairs = op.score_pairs(found).checkpoint()
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    assert cl.cluster_items(found, pairs.mapInArrow(count, pairs.schema)).count() == 60
    assert read.value == pairs.count()


def test_pairs_inside_groups_match_plain_loop(spark):
    """Repeated members meet as often as they stand in the group."""
    rng = random.Random(4)
    members = [(g, rng.randrange(12)) for g in range(9) for _ in range(6)]
    table = [(rng.randrange(12), rng.randrange(12), rng.random()) for _ in range(60)]
    got = sorted(tuple(r) for r in op._inside(spark.createDataFrame(members, "group_id bigint, item_id bigint"),
                                              spark.createDataFrame(table, "seed_id bigint, peer_id bigint, total double"), "total").select("group_id", "seed_id", "peer_id", "total").collect())
    assert got == sorted((g, s, p, t) for s, p, t in table for g, a in members if a == s for h, b in members if h == g and b == p)


def test_row_numbers_of_a_hot_group(spark):
    frame = spark.range(5000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 50).alias("k"), ((F.col("id") * 7919) % 5000).alias("v"))
    got = {(r["k"], r["v"]): r["n"] for r in group_row_number(frame, ["k"], [F.asc("v")], "n").collect()}
    groups = {}
    for k, v in got:
        groups.setdefault(k, []).append(v)
    for k, values in groups.items():
        assert [got[k, v] for v in sorted(values)] == list(range(1, len(values) + 1))


def test_pair_facts_match_a_plain_loop(spark):
    """The matrix form of a block against sets: nulls, repeats of values, vectors of other lengths, items over two blocks."""
    rng = random.Random(5)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "deltas", "Zürich", "日本語日本語", "ab12cd", None])
    names = [name for name in op.SETS]
    rows = []
    for i in range(100):
        sets = [list(dict.fromkeys(word() for _ in range(rng.randrange(4)))) for _ in names]
        sets = [[v for v in s if v is not None] if n not in ("labels", "facets", "weak_facets") else s for n, s in zip(names, sets)]
        vector = rng.choice([None, [0.5, rng.random()], [rng.random(), 0.25], [1.0], []])
        rows.append((i, rng.choice(["a", "a", "a", None]), None if i % 9 == 0 else START + dt.timedelta(minutes=i * 7), i % 2 == 0, rng.choice(["unknown", "", None, "maps"]),
                     "unknown", "travel", rng.random(), vector, *sets))
    frame = spark.createDataFrame(rows, "item_id bigint, pool_key string, created_at timestamp, sparse boolean, platform string, content_type string, family string, "
                                        "profile_score double, vector array<float>, " + ", ".join(f"{n} array<string>" for n in names)).select("*")
    found = {(r["seed_id"], r["peer_id"]): r for r in op.pair_facts(frame, 8).collect()}
    items = {r["item_id"]: r for r in frame.collect()}
    order = sorted((r for r in items.values() if r["pool_key"] == "a"), key=lambda r: (r["created_at"] is not None, r["created_at"] or START, r["item_id"]), reverse=True)
    expected = [(a, b) for at, a in enumerate(order) for b in order[at + 1:at + 8]]
    assert set(found) == {(a["item_id"], b["item_id"]) for a, b in expected}
    for a, b in expected:
        row, both = found[a["item_id"], b["item_id"]], lambda n: set(a[n]) & set(b[n])
        assert (row["n"], row["rare"]) == (len(both("tokens")), any(len(t) >= 6 for t in both("tokens")))
        assert (row["codes"], row["labels"], row["same_facets"], row["weak"]) == tuple(len(both(n)) for n in ("codes", "labels", "facets", "weak_facets"))
        assert row["high_refs"] == sum(bool(both(n)) for n in op.HIGH_REFS) and row["low_refs"] == len(both("alnum")) + bool(both("long_words"))
        assert row["all_tokens"] == (len(a["tokens"]) + len(b["tokens"]) if a["tokens"] and b["tokens"] else None)
        assert row["same_platform"] == (a["platform"] == b["platform"] == "maps") and not row["same_type"] and row["same_family"]
        timed = a["created_at"] is not None and b["created_at"] is not None
        assert row["hours"] == (abs((a["created_at"] - b["created_at"]).total_seconds()) / 3600 if timed else None)
        near = a["vector"] is not None and b["vector"] is not None and len(a["vector"]) == len(b["vector"])
        assert row["distance"] == (sum((x - y) ** 2 for x, y in zip(a["vector"], b["vector"])) ** 0.5 if near else None)
        assert row["mutual"] == min(a["profile_score"], b["profile_score"])
