"""Multi-signal scores for pairs of items that are near each other in their pool."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from shelfmark import vocab
from shelfmark.functions import text as tx, values as vx
from shelfmark.operators import windows as wn
from shelfmark.operators.ranking import group_row_number, top_k
from shelfmark.operators.source import channel_names, correlated_channels
from shelfmark.operators.windows import HIGH_REFS, PARTS, RARE_LENGTH, SETS
from shelfmark.session import ship_package


def member_features(items: DataFrame, strict_entities: bool = False) -> DataFrame:
    """Everything a pair score needs, worked out once per item.

    ``items(item_id, pool_key, created_at, ocr_text)`` may also carry labels, facets, weak_facets, vector,
    profile_titles, profile_score, platform, content_type and family.  ``strict_entities`` keeps amounts
    from counting as domains and lower-case words from counting as codes.  Items may bring their cleaned text as ``clean``, and their
    ``pool_rank`` among themselves, which then needs no further join.
    """
    cleaned = items if "clean" in items.columns else items.withColumn("clean", tx.clean_text(F.col("ocr_text")))
    none = F.array().cast("array<string>")
    given = lambda c, default: F.coalesce(F.col(c), default) if c in items.columns else default
    labels = F.array_except(F.array_distinct(F.transform(given("labels", none), lambda x: F.lower(x))), tx.literals(vocab.CLUSTER_LABEL_DENYLIST))
    text = F.col("clean")
    return cleaned.select(
        "item_id", "pool_key", "created_at", tx.distinctive_tokens(text).alias("tokens"),
        *[c.alias(n) for n, c in tx.entity_columns(text, strict_entities).items()], labels.alias("labels"),
        F.array_except(F.array_distinct(given("facets", none)), F.array(F.lit("image_only"))).alias("facets"),
        F.array_distinct(given("weak_facets", none)).alias("weak_facets"),
        (F.col("vector") if "vector" in items.columns else F.lit(None).cast("array<float>")).alias("vector"),
        given("profile_titles", none).alias("profile_titles"), given("profile_score", F.lit(0.0)).alias("profile_score"),
        *[given(c, F.lit(vocab.UNKNOWN)).alias(c) for c in ("platform", "content_type", "family")],
        tx.is_sparse(text).alias("sparse"), *[c for c in ("pool_rank",) if c in items.columns])


def pool_ranks(items: DataFrame, size: int = vocab.POOL_SIZE) -> DataFrame:
    """Rank items newest first in their pool; ``block`` groups ``size`` neighbours.

    As the newest pending item is organised it leaves the pool, so an item's peers are the ``size - 1``
    rows after it in this order.  One pool may hold any share of the rows: blocks stay small.
    """
    order = [F.col("created_at").desc_nulls_last(), F.desc("item_id")]
    ranked = group_row_number(items.select("item_id", "pool_key", "created_at"), ["pool_key"], order, "pool_rank")
    return ranked.select("item_id", "pool_key", "pool_rank", F.floor((F.col("pool_rank") - 1) / size).cast("bigint").alias("block"))


def peer_pairs(features: DataFrame, size: int = vocab.POOL_SIZE) -> DataFrame:
    """Every (seed, peer) pair within reach of the pool, each once: ``size - 1`` rows per item.

    An item's peers lie in its own block or the next, so this is an equi-join on small, even blocks.
    """
    ranked = features.join(pool_ranks(features, size).drop("pool_key"), "item_id")
    seeds = ranked.select("pool_key", "block", F.col("pool_rank").alias("seed_rank"), F.struct(*features.columns).alias("a"))
    peers = ranked.select("pool_key", F.explode(F.array(F.col("block"), F.col("block") - 1)).alias("block"),
                          F.col("pool_rank").alias("peer_rank"), F.struct(*features.columns).alias("b"))
    # Scoring costs far more than the join, so it keeps the full number of shuffle partitions.
    parts = int(features.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seeds, peers = (side.repartition(parts, "pool_key", "block") for side in (seeds, peers))
    near = (F.col("peer_rank") > F.col("seed_rank")) & (F.col("peer_rank") < F.col("seed_rank") + size)
    return seeds.join(peers, ["pool_key", "block"]).filter(near)


# What a pair has in common, as one row says it; ``n`` counts common tokens, ``rare`` tells whether one of them is long.
FACTS = ("hours double, high_refs int, codes int, low_refs int, n int, rare boolean, all_tokens int, labels int, all_labels int, same_facets int, travel boolean, "
         "home boolean, weak int, distance double, same_platform boolean, same_type boolean, same_family boolean, titles boolean, mutual double")
WIDTH = 1 << 15      # values compared at a time


def _ranked(features: DataFrame, size: int, parts: int | None = None) -> DataFrame:
    """Features with their rank and block in the pool."""
    ranks = pool_ranks(features, size).drop("pool_key")
    if parts is None:
        return features.join(ranks, "item_id")
    return features.repartition(parts, "item_id").join(ranks.repartition(parts, "item_id"), "item_id")


def _windows(features: DataFrame, size: int, bands) -> wn.Windows | None:
    """Windows of the features, where each has an id of its own: repeated ones have several ranks and meet themselves."""
    plain, rows = wn.plain_ids(features)
    if not plain:
        return None
    if "pool_rank" in features.columns:
        return wn.deal(features, rows, size, bands)
    parts = max(int(features.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // wn.TASK_ROWS))
    return wn.deal(_ranked(features, size, parts), rows, size, bands)


def _blocks(features: DataFrame, size: int) -> DataFrame:
    """Features dealt out to the blocks that need them: an item's own and the one before, whose seeds have it as a peer."""
    travel, home = tx.literals(vocab.TRAVEL_FACETS), tx.literals(vocab.HOME_FACETS)
    overlap = lambda wanted: F.coalesce(F.arrays_overlap("facets", wanted), F.lit(False))
    rows = features.join(pool_ranks(features, size).drop("pool_key"), "item_id").filter(F.col("pool_key").isNotNull()).select(
        "pool_key", F.explode(F.array(F.col("block"), F.col("block") - 1)).alias("at"), "block", "pool_rank", "item_id", F.unix_micros("created_at").alias("created"),
        "sparse", "platform", "content_type", "family", F.col("profile_score").cast("double").alias("profile_score"), "vector", overlap(travel).alias("travels"), overlap(home).alias("homely"),
        *[F.coalesce(F.col(name), F.array().cast("array<string>")).alias(name) for name in SETS])
    # Comparing costs far more than the shuffle, so it keeps the full number of partitions.
    parts = int(features.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.filter("at >= 0").repartition(parts, "pool_key", "at")


def _common(sets: pa.ListArray, own: np.ndarray, nulls: bool, long: int | None = None) -> list[np.ndarray]:
    """How many values each ``own`` row shares with every row; with ``long``, also how many of at least so many characters.

    Values are numbered within the block, so they are compared in full; those of one row only are left out.
    """
    coded = sets.flatten().dictionary_encode(null_encoding="encode")
    place, rows = coded.indices.to_numpy(), np.repeat(np.arange(len(sets)), sets.value_lengths().to_numpy())
    wanted = np.bincount(place, minlength=len(coded.dictionary)) > 1
    if not nulls:
        wanted &= coded.dictionary.is_valid().to_numpy(zero_copy_only=False)
    lengths = pc.utf8_length(coded.dictionary).fill_null(0).to_numpy(zero_copy_only=False)[wanted] if long else None
    kept = wanted[place]
    place, rows, width = (np.cumsum(wanted) - 1)[place[kept]], rows[kept], int(wanted.sum())
    out = [np.zeros((len(own), len(sets)), dtype=np.int32) for _ in range(2 if long else 1)]
    for low in range(0, width, WIDTH):
        inside = (place >= low) & (place < low + WIDTH)
        held = np.zeros((len(sets), min(WIDTH, width - low)), dtype=np.float32)
        held[rows[inside], place[inside] - low] = 1
        out[0] += (held[own] @ held.T).astype(np.int32)
        if long:
            held = held[:, lengths[low:low + WIDTH] >= long]
            out[1] += (held[own] @ held.T).astype(np.int32)
    return out


def _equal(column: pa.Array, own: np.ndarray) -> np.ndarray:
    """Both say the same, and something."""
    coded = column.dictionary_encode(null_encoding="encode")
    said = np.array([v not in (None, "", vocab.UNKNOWN) for v in coded.dictionary.to_pylist()], dtype=bool)
    place = coded.indices.to_numpy()
    return (place[own][:, None] == place[None, :]) & said[place][None, :]


def _distances(vectors: pa.ListArray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """L2 distances, added up dimension by dimension, and where there is one."""
    out, known = (np.zeros((len(own), len(vectors)), dtype=t) for t in (np.float64, bool))
    plain = {}
    for row, vector in enumerate(vectors.to_pylist()) if vectors.null_count < len(vectors) else ():
        if vector is not None and None not in vector:
            plain.setdefault(len(vector), {})[row] = vector
    for width, rows in plain.items():
        at = np.array(list(rows))
        mine = np.flatnonzero(np.isin(own, at))
        held = np.array(list(rows.values()), dtype=np.float64).reshape(len(at), width)
        place = np.searchsorted(at, own[mine])
        total = np.zeros((len(mine), len(at)))
        for d in range(width):
            total += (held[place, d][:, None] - held[:, d][None, :]) ** 2
        out[np.ix_(mine, at)], known[np.ix_(mine, at)] = np.sqrt(total), True
    return out, known


def _block_facts(size: int, schema: list[str]):
    """The work of one block of seeds with the peers in their reach: at most twice ``size`` rows, where items stand once."""

    def work(table: pa.Table) -> pa.Table:
        block = {name: table.column(name).combine_chunks() for name in table.column_names}
        number = lambda name: block[name].to_numpy(zero_copy_only=False)
        ranks = number("pool_rank")
        own = np.flatnonzero(number("block") == number("at"))
        a, b = np.nonzero((ranks[None, :] > ranks[own][:, None]) & (ranks[None, :] < ranks[own][:, None] + size))
        shared = lambda name, nulls=False, **long: [m[a, b] for m in _common(block[name], own, nulls, **long)]
        seed = own[a]
        sizes = {name: block[name].value_lengths().to_numpy() for name in ("tokens", "labels")}
        both = lambda name: sizes[name][seed] + sizes[name][b]
        n, rare = shared("tokens", long=RARE_LENGTH)
        created = block["created"].fill_null(0).to_numpy()
        timed = block["created"].is_valid().to_numpy(zero_copy_only=False)
        distance, known = _distances(block["vector"], own)
        flag = lambda name: number(name).astype(bool)
        scores = number("profile_score")
        found = {
            "pool_key": block["pool_key"].take(pa.array(seed)), "block": block["at"].take(pa.array(seed)), "seed_rank": ranks[seed], "peer_rank": ranks[b],
            "seed_id": block["item_id"].take(pa.array(seed)), "peer_id": block["item_id"].take(pa.array(b)), "peer_sparse": block["sparse"].take(pa.array(b)),
            "hours": pa.array(np.abs(created[seed] - created[b]) / 3_600_000_000.0, mask=~(timed[seed] & timed[b])),
            "high_refs": sum((shared(name)[0] > 0).astype(np.int32) for name in HIGH_REFS), "codes": shared("codes", True)[0],
            "low_refs": shared("alnum", True)[0] + (shared("long_words")[0] > 0), "n": n, "rare": rare > 0,
            "all_tokens": pa.array(both("tokens"), mask=(sizes["tokens"][seed] == 0) | (sizes["tokens"][b] == 0)),
            "labels": shared("labels", True)[0], "all_labels": both("labels"), "same_facets": shared("facets", True)[0],
            "travel": flag("travels")[seed] & flag("travels")[b], "home": flag("homely")[seed] & flag("homely")[b], "weak": shared("weak_facets", True)[0],
            "distance": pa.array(distance[a, b], mask=~known[a, b]),
            **{f"same_{name}": _equal(block[field], own)[a, b] for name, field in (("platform", "platform"), ("type", "content_type"), ("family", "family"))},
            "titles": shared("profile_titles")[0] > 0, "mutual": np.fmin(scores[seed], scores[b])}
        return pa.table({name: found[name] for name in schema})

    return work


def pair_facts(features: DataFrame, size: int = vocab.POOL_SIZE) -> DataFrame:
    """The pairs of ``peer_pairs`` with what the two have in common, block by block.

    Values are numbered once for a block and sets become rows of a matrix, so that all pairs of a block are counted by one product.
    """
    kinds = {f.name: f.dataType.simpleString() for f in features.schema.fields}
    schema = (f"pool_key {kinds['pool_key']}, block bigint, seed_rank bigint, peer_rank bigint, seed_id {kinds['item_id']}, peer_id {kinds['item_id']}, peer_sparse boolean, " + FACTS)
    names = [field.split()[0] for field in schema.split(", ")]
    ship_package(features.sparkSession)
    return _blocks(features, size).groupBy("pool_key", "at").applyInArrow(_block_facts(size, names), schema)


def _tiers() -> dict[str, Column]:
    return {"high": F.col("high_refs") + (F.col("codes") >= 2).cast("int"), "medium": F.col("low_refs") + (F.col("codes") == 1).cast("int")}


def entity_tiers(features: DataFrame, size: int = vocab.POOL_SIZE) -> DataFrame:
    """The numbers of ``high`` and ``medium`` entity matches of every (seed_id, peer_id)."""
    windows = _windows(features, size, ())
    if windows:
        return wn.pair_rows(windows, ("seed_id", "peer_id", "high", "medium"))
    return pair_facts(features, size).withColumns(_tiers()).select("seed_id", "peer_id", "high", "medium")


def score_pairs(features: DataFrame, size: int = vocab.POOL_SIZE, bands=(vocab.VECTOR_STRONG, vocab.VECTOR_WEAK, vocab.VECTOR_FAR)) -> DataFrame:
    """The pair table: one scored row per (seed, peer).

    ``parts`` holds the signal values in the order of ``PARTS``.  What two items share is worked out first, by ``pair_facts``.
    Where each item has an id of its own the table also carries its windows, from which the steps below work out what they need
    of it without writing any pair.  A table without them is reused by every grouping step: land it before filtering it.
    """
    windows = _windows(features, size, bands)
    if windows:
        # The rows themselves, for who asks for them; they stay unused where a step takes the windows.
        return wn.mark(wn.pair_rows(windows, PAIR_COLUMNS), windows)
    return _scored_rows(features, size, bands)


PAIR_COLUMNS = ("pool_key", "block", "seed_rank", "peer_rank", "seed_id", "peer_id", "peer_sparse", "total", "contextual", "families", "parts")


def _scored_rows(features: DataFrame, size: int, bands) -> DataFrame:
    """The pair table by joined blocks, which items with the same id may stand in more than once."""
    c = F.col
    keys = ["pool_key", "block", "seed_rank", "peer_rank", "seed_id", "peer_id", "peer_sparse"]
    counted = pair_facts(features, size).withColumns(_tiers())
    counted = counted.withColumn("jaccard", F.coalesce(c("n") / (c("all_tokens") - c("n")), F.lit(0.0)))
    strong, weak, far = bands
    bridge = F.when(c("travel"), 0.14).when(c("home"), 0.12).otherwise(0.0)
    parts = {
        "time": F.coalesce(vx.time_band(c("hours")), F.lit(0.0)), "ocr_tokens": 0.24 * c("jaccard"),
        "ocr_entities": F.when(c("high") > 0, F.least(F.lit(0.28), 0.16 * c("high") + 0.08 * c("medium")))
        .when(c("medium") > 0, F.least(F.lit(0.14), 0.08 * c("medium"))).otherwise(0.0),
        "vision": F.least(F.lit(0.10), 0.08 * (c("labels") / F.greatest(F.lit(1), c("all_labels") - c("labels")))),
        "feature_print": F.when(c("distance") <= strong, 0.14).when(c("distance") <= weak, 0.08).when(c("distance") <= far, 0.03).otherwise(0.0),
        "facets": F.when(c("same_facets") > 0, F.least(F.lit(0.14), 0.08 * c("same_facets"))).otherwise(bridge),
        "weak_facets": F.least(F.lit(0.04), 0.02 * c("weak")),
        "source_platform": F.when(c("same_platform"), 0.04).otherwise(0.0),
        "content_type": F.when(c("same_type"), 0.05).otherwise(0.0),
        "content_family": F.when(c("same_family"), 0.04).otherwise(0.0),
        "profile": F.when(c("titles"), 0.10).when(c("mutual") >= 0.4, F.least(F.lit(0.08), c("mutual") * 0.08)).otherwise(0.0),
    }
    by_tokens = ((c("jaccard") >= 0.12) & (c("n") >= 2)) | ((c("n") >= 1) & c("rare") & (c("jaccard") >= 0.08))
    scored = counted.withColumns({f"p_{name}": value for name, value in parts.items()}).withColumns({
        "by_tokens": by_tokens, "by_high": c("high") > 0, "bridged": (c("same_facets") == 0) & (c("travel") | c("home"))})
    scored = scored.withColumn("contextual", c("by_tokens") | c("by_high") | c("bridged"))
    base = c("contextual")
    named = {
        "ocr_tokens": c("by_tokens"), "ocr_entities_h": c("by_high"), "facet_bridge_travel": c("bridged") & c("travel"), "facet_bridge_home": c("bridged") & ~c("travel"),
        "profile_with_context": base & (c("p_profile") > 0), "ocr_entities_m": base & ~c("by_high") & (c("medium") > 0),
        "source_with_context": base & c("same_platform"), "type_with_context": base & c("same_type"), "family_with_context": base & c("same_family")}
    total = F.lit(0.0)
    for name in PARTS:
        total = total + c(f"p_{name}")
    # Joined arrays rather than a filtered one: they are compiled.
    said = lambda name, test: F.when(test, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    return scored.select(
        *keys, F.round(F.least(F.lit(1.0), total), 6).alias("total"), base.alias("contextual"),
        F.concat(*[said(name, test) for name, test in named.items()]).alias("families"),
        F.array(*[F.round(c(f"p_{name}"), 6) for name in PARTS]).alias("parts"))


def parts_map(parts: Column) -> Column:
    """Signal values by name, zero ones left out."""
    named = F.map_from_arrays(tx.literals(PARTS), parts)
    return F.map_filter(named, lambda k, v: v > 0)


def sparse_where(pairs: DataFrame, test: Callable[[Column], Column]) -> DataFrame:
    """The pair table with ``test`` of a peer's id telling whether it is sparse."""
    windows = wn.of(pairs)
    told = windows and replace(windows, rows=windows.rows.withColumn("sparse", test(F.col("item_id"))))
    return wn.mark(pairs.withColumn("peer_sparse", test(F.col("peer_id"))), told)


def seed_sums(pairs: DataFrame) -> DataFrame:
    """For each seed the number of its pairs, of those with context, the best total, and sums of totals and signals in millionths."""
    windows = wn.of(pairs)
    if windows:
        return wn.seed_sums(windows)
    micros = lambda c: F.sum(F.round(c * 1_000_000).cast("bigint"))   # whole numbers add up the same in any order
    return pairs.groupBy("seed_id").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if("contextual").alias("contextual"), F.max("total").alias("best"), micros(F.col("total")).alias("total"),
        *[micros(F.col("parts")[i]).alias(name) for i, name in enumerate(PARTS)])


def top_peers(pairs: DataFrame, limit: int = vocab.RETRIEVAL_SIZE, columns: Sequence[str] | None = None) -> DataFrame:
    """The best peers of each seed; equal totals go to the newer peer.  ``columns`` are those asked for (None: all)."""
    windows = wn.of(pairs)
    if windows:
        return wn.pair_rows(windows, columns or (*PAIR_COLUMNS, "peer_order"), lambda w: w.best(limit))
    best = _top_rows(pairs, limit)
    return best.select(*columns) if columns else best


def _top_rows(pairs: DataFrame, limit: int) -> DataFrame:
    return top_k(pairs, ["seed_id"], [F.desc("total"), F.asc("peer_rank")], limit, "peer_order")


def seed_expansion(
    pairs: DataFrame, retrieval: int = vocab.RETRIEVAL_SIZE, size: int = vocab.GROUP_SIZE, columns: Sequence[str] | None = None) -> DataFrame:
    """First step of grouping as windows: the best contextual peers above the admit floor, up to the group size."""
    windows = wn.of(pairs)
    if windows:
        return wn.pair_rows(windows, columns or (*PAIR_COLUMNS, "peer_order", "admit_order"), lambda w: w.founders(retrieval, size))
    good = _top_rows(pairs, retrieval).filter("contextual").filter(F.col("total") >= vocab.ADMIT_FLOOR)
    grown = top_k(good, ["seed_id"], [F.asc("peer_order")], size - 1, "admit_order")
    return grown.select(*columns) if columns else grown


def expanded_groups(pairs: DataFrame, retrieval: int = vocab.RETRIEVAL_SIZE, size: int = vocab.GROUP_SIZE) -> DataFrame:
    """(group_id, item_id) of each seed with the peers that ``seed_expansion`` gives it."""
    grown = seed_expansion(pairs, retrieval, size, ("seed_id", "peer_id"))
    members = grown.select(F.col("seed_id").alias("group_id"), F.col("peer_id").alias("item_id")).unionByName(
        grown.select(F.col("seed_id").alias("group_id"), F.col("seed_id").alias("item_id")).distinct())
    members._expanded = (wn.of(pairs), retrieval, size)
    return members


def _expansion(members: DataFrame, pairs: DataFrame) -> tuple | None:
    """Windows and sizes, where ``members`` are what ``expanded_groups`` makes of the same ``pairs``."""
    made = getattr(members, "_expanded", None)
    return made if made and made[0] and made[0] is wn.of(pairs) else None


def pair_channels(features: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs whose facet, type and family signals state one fact, with the channels named."""
    windows = wn.of(pairs)
    if windows:
        return wn.channel_rows(windows, channel_names)
    at = {n: i for i, n in enumerate(PARTS)}
    part = lambda n: F.col("parts")[at[n]] > 0
    stacked = sum((part(n).cast("int") for n in ("facets", "content_type", "content_family")), F.lit(0))
    side = features.select("item_id", "facets", "content_type", "family")
    rows = pairs.filter(stacked >= 2).join(side.select(F.struct(*side.columns).alias("a"), F.col("item_id").alias("seed_id")), "seed_id").join(
        side.select(F.struct(*side.columns).alias("b"), F.col("item_id").alias("peer_id")), "peer_id")
    same = lambda f: F.when(F.col("a")[f] == F.col("b")[f], F.col("a")[f]).otherwise(F.lit(vocab.UNKNOWN))
    # The channels ask for these many times, so each is a column of its own.
    hits = {name: part(name).alias(f"_{name}") for name in ("facets", "content_type", "content_family")}
    common = rows.select("seed_id", "peer_id", F.array_intersect("a.facets", "b.facets").alias("_common"), same("content_type").alias("_type"),
                         same("family").alias("_family"), *hits.values())
    channels = correlated_channels(F.col("_common"), F.col("_type"), F.col("_family"), *[F.col(f"_{name}") for name in hits])
    return common.select("seed_id", "peer_id", channels.alias("channels"))


def _inside(members: DataFrame, pairs: DataFrame, *columns: str) -> DataFrame:
    """(group_id, seed_id, peer_id, columns): the rows of the pair table with both ends in a group of ``members(group_id, item_id)``.

    The pairs of each bounded group meet the table once, by both ends: a join by one end only makes a row for every group of an item
    and every peer it has.
    """
    ends = members.select("group_id", F.col("item_id").alias("_low")).join(members.select("group_id", F.col("item_id").alias("_high")), "group_id").filter("_low <= _high")
    known = pairs.select(F.least("seed_id", "peer_id").alias("_low"), F.greatest("seed_id", "peer_id").alias("_high"), "seed_id", "peer_id", *columns)
    return ends.join(known, ["_low", "_high"]).drop("_low", "_high")


def group_stats(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Cohesion of groups ``members(group_id, item_id)`` of bounded size over a pair table.

    Pairs outside the table count as zero.
    """
    grown = _expansion(members, pairs)
    if grown:
        return wn.stats(*grown)
    inside = _inside(members, pairs, "total", "contextual")
    sizes = members.groupBy("group_id").agg(F.countDistinct("item_id").alias("size"))
    edges = inside.groupBy("group_id").agg(
        F.sum("total").alias("sum_total"), F.min("total").alias("min_total"), F.count(F.lit(1)).alias("edges"), F.count_if("contextual").alias("supported_edges"))
    ends = inside.select("group_id", F.explode(F.array("seed_id", "peer_id")).alias("item_id"), "total").groupBy("group_id", "item_id").agg(F.sum("total").alias("held"))
    weakest = members.join(ends, ["group_id", "item_id"], "left").groupBy("group_id").agg(F.min(F.coalesce("held", F.lit(0.0))).alias("weakest_sum"))
    n = F.col("size")
    possible = n * (n - 1) / 2
    complete = F.coalesce("edges", F.lit(0)) == possible
    return sizes.join(edges, "group_id", "left").join(weakest, "group_id").select(
        "group_id", "size", F.round(F.coalesce("sum_total", F.lit(0.0)), 6).alias("total"),
        F.when(n < 2, 1.0).otherwise(F.round(F.coalesce("sum_total", F.lit(0.0)) / possible, 6)).alias("mean_cohesion"),
        F.when(n < 2, 1.0).when(complete, F.col("min_total")).otherwise(0.0).alias("weakest_pair"),
        F.when(n < 2, 1.0).otherwise(F.round(F.col("weakest_sum") / (n - 1), 6)).alias("weakest_member"),
        F.coalesce("supported_edges", F.lit(0)).alias("supported_edges"))


def signal_breakdown(members: DataFrame, pairs: DataFrame, limit: int = 5) -> DataFrame:
    """The strongest summed signals of each member over its pairs inside the group."""
    grown = _expansion(members, pairs)
    if grown:
        return wn.signals(*grown, limit)
    inside = _inside(members, pairs, "parts")
    ends = inside.select("group_id", F.explode(F.array("seed_id", "peer_id")).alias("item_id"), "parts")
    sums = ends.groupBy("group_id", "item_id").agg(*[F.round(F.sum(F.col("parts")[i]), 6).alias(p) for i, p in enumerate(PARTS)])
    entries = F.filter(F.array(*[F.struct((-F.col(p)).alias("v"), F.lit(p).alias("k")) for p in PARTS]), lambda e: e["v"] < 0)
    best = F.slice(F.array_sort(entries), 1, limit)
    return sums.select("group_id", "item_id", F.map_from_entries(F.transform(best, lambda e: F.struct(e["k"].alias("k"), (-e["v"]).alias("v")))).alias("signals"))
