"""Ranked full-text search, collection title hits and weighted multi-field search, many queries at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from shelfmark import vocab
from shelfmark.functions import text as tx, values as vx
from shelfmark.operators.ranking import top_k


# ---- index ----------------------------------------------------------------------------------------


def build_postings(items: DataFrame, stem=None) -> DataFrame:
    """``(term, item_id, tf, doc_length)`` over whole texts.

    Terms are counted inside the task that reads the text, so the shuffle carries one row per distinct
    term of an item.  ``stem`` maps a distinct-term frame ``(term)`` to ``(term, stemmed)``.
    """
    terms = items.select("item_id", tx.words(F.lower("ocr_text")).alias("terms"))
    # The outer form keeps Catalyst from adding a size test that would cut each text into words twice.
    flat = terms.select("item_id", F.size("terms").alias("doc_length"), F.explode_outer("terms").alias("term")).filter("term is not null")
    postings = flat.groupBy("term", "item_id", "doc_length").agg(F.count(F.lit(1)).alias("tf"))
    if stem is not None:
        known = stem(postings.select("term").distinct())
        postings = (postings.join(known, "term").groupBy(F.col("stemmed").alias("term"), "item_id", "doc_length")
                    .agg(F.sum("tf").alias("tf")))
    return postings


def refresh_postings(postings: DataFrame, changed: DataFrame, removed: DataFrame | None = None, stem=None) -> DataFrame:
    """Replace the rows of ``changed(item_id, ocr_text)`` and drop those of ``removed(item_id)``; ``stem`` as when built."""
    gone = changed.select("item_id")
    if removed is not None:
        gone = gone.unionByName(removed.select("item_id"))
    return postings.join(gone.distinct(), "item_id", "left_anti").select(*postings.columns).unionByName(
        build_postings(changed, stem).select(*postings.columns))


def query_terms(queries: DataFrame, stem=None) -> DataFrame:
    """``queries(query_id, query)`` to ``(query_id, position, token, tokens)``."""
    split = queries.select("query_id", tx.query_tokens(F.col("query")).alias("all"))
    out = split.select("query_id", F.size("all").alias("tokens"), F.posexplode("all").alias("position", "token"))
    if stem is not None:
        known = stem(out.select(F.col("token").alias("term")).distinct())
        out = (out.join(known, out["token"] == known["term"])
               .select("query_id", "tokens", "position", F.col("stemmed").alias("token")))
    return out


def match_terms(dictionary: DataFrame, tokens: DataFrame) -> DataFrame:
    """``(term, token)`` where the term starts with the token (tokens of one character match exactly).

    Each term lists its prefixes up to the longest token, so the prefix test becomes an equi-join
    against the distinct tokens and never a product of dictionary and query.
    """
    distinct = tokens.select("token").distinct()
    longest = distinct.agg(F.coalesce(F.max(F.length("token")), F.lit(0)).alias("longest"))
    sized = dictionary.crossJoin(F.broadcast(longest))  # one row
    lengths = F.sequence(F.lit(1), F.greatest(F.least(F.length("term"), F.col("longest")), F.lit(1)))
    prefixes = sized.select("term", F.explode(lengths).alias("n")).select(
        "term", F.left("term", F.col("n")).alias("token"))
    single = (F.length("token") >= 2) | (F.col("term") == F.col("token"))
    return prefixes.filter(single).join(distinct, "token")


def search(
    postings: DataFrame, items: DataFrame, queries: DataFrame, as_of: Column, limit: int = vocab.SEARCH_LIMIT, stem=None,
) -> DataFrame:
    """All tokens must match; visible rows; best BM25 first, then favourites, newest, id; ``limit`` per query.

    A prefix token counts as one phrase: its frequency in an item sums over all matching terms.
    """
    wanted = query_terms(queries, stem)
    found = match_terms(postings.select("term").distinct(), wanted)
    token_hits = (
        postings.join(found, "term").groupBy("token", "item_id", "doc_length").agg(F.sum("tf").alias("tf")))
    frequency = token_hits.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    item_count = items.agg(F.count("ocr_text").alias("item_count"))
    totals = postings.agg(F.sum("tf").alias("all_terms")).crossJoin(item_count).select(  # one row each
        "item_count", (F.col("all_terms") / F.col("item_count")).alias("mean_length"))
    idf = F.log((F.col("item_count") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = frequency.crossJoin(F.broadcast(totals)).select(  # one row
        "token", "mean_length", F.when(idf > 0, idf).otherwise(F.lit(vocab.BM25_IDF_FLOOR)).alias("idf"))
    # Every token must match, so the items of a query's rarest token are its only candidates.
    rarest = wanted.join(frequency, "token").groupBy("query_id", "tokens").agg(
        F.min(F.struct("df", "token"))["token"].alias("token"), F.countDistinct("position").alias("known")).filter(F.col("known") == F.col("tokens"))
    candidates = rarest.join(token_hits.select("token", "item_id"), "token").select("query_id", "item_id")
    asked = candidates.join(wanted, "query_id")
    k1, b = vocab.BM25_K1, vocab.BM25_B
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (
        F.col("tf") + k1 * (1 - b + b * F.col("doc_length") / F.col("mean_length")))
    scored = (
        token_hits.join(asked, ["token", "item_id"]).join(weights, "token").select("query_id", "item_id", "tokens", part.alias("part"))
        .groupBy("query_id", "item_id", "tokens")
        .agg(F.count(F.lit(1)).alias("matched"), F.sum("part").alias("bm25"))
        .filter(F.col("matched") == F.col("tokens"))
        .select("query_id", "item_id", F.round("bm25", 6).alias("bm25"))
    )
    visible = items.filter(~F.col("is_removed") & (F.col("access_state") == "available")).select(
        "item_id", "is_favorite", "created_at")
    hits = scored.join(visible, "item_id")
    order = [F.desc("bm25"), F.desc("is_favorite"), F.col("created_at").desc_nulls_last(), F.desc("item_id")]
    ranked = top_k(hits, ["query_id"], order, limit)
    # An undated item gets no recency bonus.
    score = (F.col("bm25") + F.when(F.col("is_favorite"), 2.0).otherwise(0.0)
             + 0.25 * vx.recency(F.col("created_at"), as_of))
    return ranked.select("query_id", "item_id", "rank", "bm25", F.round(score, 6).alias("score"))


# ---- collection titles ----------------------------------------------------------------------------


def _title_fragments(titles: DataFrame, tokens: DataFrame) -> DataFrame:
    """``(title_key, token)`` where the folded title contains the folded token.

    Tokens contain letters and digits only, so a hit lies inside one title word.
    """
    pieces = titles.select("title_key", F.explode(tx.words(F.col("folded"))).alias("word")).distinct()
    inside = containing_words(pieces.select("word").distinct(), tokens.select("token").distinct())
    return inside.join(pieces, "word").select("title_key", "token").distinct()


def folded(text: Column) -> Column:
    return tx.fold(F.lower(text))


def match_collections(
    collections: DataFrame, queries: DataFrame, limit: int = vocab.COLLECTION_MATCH_LIMIT
) -> DataFrame:
    """Collections whose title contains query tokens; best share first, at most ``limit`` per query."""
    live = collections.filter((F.col("kind") != "unassigned") & ~F.col("is_archived"))
    titles = live.select(F.col("collection_id").alias("title_key"), folded(F.col("title")).alias("folded"))
    wanted = query_terms(queries).withColumn("token", folded(F.col("token")))
    hits = _title_fragments(titles, wanted).join(wanted, "token")
    share = hits.groupBy("query_id", F.col("title_key").alias("collection_id"), "tokens").agg(
        F.count(F.lit(1)).alias("matched")).select(
        "query_id", "collection_id", F.round(F.col("matched") / F.col("tokens"), 6).alias("share"))
    return top_k(share, ["query_id"], [F.desc("share"), F.asc("collection_id")], limit)


def flag_collection_hits(hits: DataFrame, matched: DataFrame, memberships: DataFrame) -> DataFrame:
    """Add ``in_collection``: the item belongs to a collection that the query's title match found."""
    members = (
        matched.select("query_id", "collection_id").join(memberships.select("item_id", "collection_id"), "collection_id")
        .select("query_id", "item_id").distinct().withColumn("in_collection", F.lit(True)))
    return hits.join(members, ["query_id", "item_id"], "left").withColumn(
        "in_collection", F.coalesce("in_collection", F.lit(False)))


def annotate_signals(flagged: DataFrame) -> DataFrame:
    """``signals``: text always, collection when flagged."""
    return flagged.withColumn("signals", F.array_compact(F.array(
        F.lit("ocr"), F.when(F.col("in_collection"), F.lit("collection")))))


# ---- weighted multi-field search ------------------------------------------------------------------

FIELD_WEIGHTS = {"ocr": 1.0, "entity": 0.95, "collection": 0.9, "label": 0.85, "keyword": 0.75, "summary": 0.7}


def weighted_search(
    docs: DataFrame, queries: DataFrame, as_of: Column, old_days: int = 150, limit: int | None = vocab.SEARCH_LIMIT,
) -> DataFrame:
    """The ``limit`` best items of each query (None: every item that matches), scored over several text fields.

    ``docs(item_id, created_at, ocr, summary, entity, collection, label, keyword)``: the last four are
    arrays.  Every field word lists its substrings up to the longest token, so containment of a token is
    an equi-join.  Labels match in either direction.  Coverage and the phrase bonus come afterwards, for
    items with a hit only.

    An age word also matches every older item.  Items with a further hit get its points as they are scored.  Those
    without one all score alike and below older items with a hit, so the newest ``limit`` older items are the only
    ones that can be listed: queries with an age word meet these, never all older items.  Without a ``limit`` they
    meet all older items, as all of them match.  Equal scores go to the newer item, then to the lower id.
    """
    split = queries.select("query_id", F.filter(
        F.split(F.lower(F.col("query")), tx.WORD_BREAK), lambda t: t != "").alias("all"))
    aged = F.col("raw").isin("old", "older")
    split = split.select("query_id", "all", F.size("all").alias("tokens"), folded(F.array_join("all", " ")).alias("phrase"),
                         F.size(F.filter("all", lambda t: t.isin("old", "older"))).alias("age_words"),
                         F.size(F.filter("all", lambda t: folded(t) != "")).alias("solid"))
    # Queries with the same id are told apart by what they ask; phrases stay here until the hits are added up.
    asks = ["tokens", "phrase", "age_words", "solid"]
    split = split.withColumn("ask", F.xxhash64(*asks))
    tokens = split.select("query_id", "ask", "age_words", F.explode("all").alias("raw"))
    tokens = tokens.withColumn("token", folded(F.col("raw")))
    fields = F.array(*[
        F.struct(F.lit(name).alias("field"), (F.col(name) if name in ("ocr", "summary")
                 else F.array_join(F.col(name), " ")).alias("content")) for name in FIELD_WEIGHTS])
    words = docs.select("item_id", F.explode(fields).alias("f")).select(
        "item_id", "f.field", F.explode(F.array_distinct(tx.words(folded(F.coalesce("f.content", F.lit("")))))).alias("word"))
    distinct = tokens.select("token").distinct()
    vocabulary = words.select("word").distinct()
    inside = containing_words(vocabulary, distinct)
    hits = words.join(inside, "word").select("item_id", "field", "token")
    # The other direction for labels: the token contains the whole label.
    labels = docs.select("item_id", F.explode("label").alias("l")).select(
        "item_id", F.lit("label").alias("field"), folded(F.col("l")).alias("word")).filter(F.col("word") != "")
    around = containing_words(distinct.select(F.col("token").alias("word")), labels.select(F.col("word").alias("token")).distinct())
    reverse = labels.join(around.select(F.col("word").alias("token"), F.col("token").alias("word")), "word").select(
        "item_id", "field", "token")
    weight = F.lit(0)
    for name, value in FIELD_WEIGHTS.items():
        weight = F.when(F.col("field") == name, round(100 * value)).otherwise(weight)  # hundredths add up the same in any order
    per_token = hits.unionByName(reverse).distinct().groupBy("item_id", "token").agg(F.sum(weight).alias("points"))
    is_old = F.coalesce(F.col("created_at") < as_of - F.make_interval(days=F.lit(old_days)), F.lit(False))
    older = docs.filter(is_old).select("item_id", "created_at")
    if limit is not None:
        older = older.orderBy(F.desc("created_at"), F.asc("item_id")).limit(limit)  # at most `limit` ids
    wanted = tokens.groupBy("query_id", "ask", "age_words", "token").agg(F.count(F.lit(1)).alias("times"), F.count_if(aged).alias("aged"))
    by_query = wanted.groupBy("query_id", "ask", "age_words").agg(F.collect_list(F.struct("token", "times", "aged")).alias("words"))
    none = F.array().cast("array<struct<token:string,points:bigint>>")
    listed = per_token.groupBy("item_id").agg(F.collect_list(F.struct("token", "points")).alias("words")).select("item_id", "words", F.lit(False).alias("old"))
    by_item = listed.unionByName(older.select("item_id", none.alias("words"), F.lit(True).alias("old")))
    asked = split.select("query_id", "ask", *asks).distinct()
    asked = asked.withColumnsRenamed({"query_id": "_query", "ask": "_ask"})
    # Counted before the hits are found, which counting them would do twice.
    blocks = [max(1, -(-rows.agg(F.approx_count_distinct(key)).first()[0] // size)) for rows, key, size in ((queries, "query_id", QUERY_BLOCK), (docs, "item_id", ITEM_BLOCK))]
    total = _summed_hits(by_query, by_item, *blocks).join(asked, (F.col("ask") == F.col("_ask")) & F.col("query_id").eqNullSafe(F.col("_query"))).drop("ask", "_ask", "_query")
    haystack = folded(F.concat_ws(" ", "ocr", "summary", F.array_join("entity", " "), F.array_join("keyword", " "),
                                  F.array_join("label", " "), F.array_join("collection", " ")))
    # A text has the whole phrase only where it has every token of it, so few texts are joined; the others need their dates only.
    dated = docs.select("item_id", "created_at", is_old.alias("old"), haystack.alias("haystack"))
    whole = F.col("hit") >= F.col("solid")
    scored = total.filter(whole).join(dated, "item_id").withColumn("has_phrase", F.contains("haystack", F.col("phrase"))).drop("haystack").unionByName(
        total.filter(~whole).join(dated.drop("haystack"), "item_id").withColumn("has_phrase", F.lit(False))).select(
        "*", (F.col("points") + F.when(F.col("old"), 40 * F.col("age_words")).otherwise(0)).alias("sum_points"),
        (F.col("hit") + F.when(F.col("old"), F.col("age_words") - F.col("age_hit")).otherwise(0)).alias("matched"))
    coverage = F.when(F.col("tokens") > 1, 0.55 + 0.45 * F.col("matched") / F.col("tokens")).otherwise(1.0)
    bonus = F.when((F.length("phrase") > 2) & F.col("has_phrase"), 0.55).otherwise(0.0)
    out = scored.select("query_id", "item_id", "created_at", "matched", (F.col("sum_points") / 100.0 * coverage + bonus).alias("score"))
    return out if limit is None else top_k(out, ["query_id"], [F.desc("score"), F.col("created_at").desc_nulls_last(), F.asc("item_id")], limit)


QUERY_BLOCK, ITEM_BLOCK = 512, 1024    # queries and items that meet at once


def _summed_hits(queries: DataFrame, items: DataFrame, query_blocks: int, item_blocks: int) -> DataFrame:
    """``(query_id, ask, item_id, points, hit, age_hit)`` of the items that share a token with a query, and of old ones where it has an age word.

    ``queries(query_id, ask, age_words, words<token, times, aged>)`` and ``items(item_id, words<token, points>, old)``: blocks of both meet, and a
    product of matrices over their common tokens adds up all hits, so that no row stands for a token of a pair.  An item may have several rows.
    """
    kinds = [queries.schema["query_id"], queries.schema["ask"], items.schema["item_id"]]
    names = [f.name for f in kinds]

    def summed(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for at in range(batch.num_rows):
                asked, held = (batch.column(c)[at].values for c in (0, 1))
                yield _block_hits(asked, held, names)

    pairs = _dealt(queries, "query_id", "asked", query_blocks).crossJoin(_dealt(items, "item_id", "held", item_blocks))
    return pairs.mapInArrow(summed, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds) + ", points bigint, hit bigint, age_hit bigint")


def _dealt(rows: DataFrame, key: str, name: str, count: int) -> DataFrame:
    """``rows`` in ``count`` about equal blocks, one array of structs each; all rows of a key are in one block."""
    return rows.groupBy(F.pmod(F.xxhash64(key), F.lit(count)).alias("_block")).agg(F.collect_list(F.struct(*rows.columns)).alias(name)).select(name)


def _block_hits(asked: pa.StructArray, held: pa.StructArray, names: list[str]) -> pa.RecordBatch:
    field = lambda rows, name: rows.field(name)
    # An item's rows become one.
    coded = field(held, "item_id").dictionary_encode(null_encoding="encode")
    ids, place = coded.dictionary, coded.indices.to_numpy()
    old = np.zeros(len(ids), dtype=bool)
    np.logical_or.at(old, place, field(held, "old").to_numpy(zero_copy_only=False))
    sides = []
    for words, rows in ((field(asked, "words"), np.arange(len(asked))), (field(held, "words"), place)):
        sides.append((words.flatten(), np.repeat(rows, words.value_lengths().fill_null(0).to_numpy())))
    (mine, query), (theirs, item) = sides
    tokens = field(mine, "token").dictionary_encode()
    known = pc.index_in(field(theirs, "token"), tokens.dictionary)
    there = known.is_valid().to_numpy(zero_copy_only=False)
    column, item = known.fill_null(0).to_numpy()[there], item[there]
    numbers = lambda rows, name: field(rows, name).to_numpy(zero_copy_only=False)
    # Only tokens of both; whole numbers are added up exactly.
    used, column = np.unique(column, return_inverse=True)
    points, hits = (np.zeros((len(ids), len(used))) for _ in range(2))
    np.add.at(points, (item, column), numbers(theirs, "points")[there])
    hits[item, column] = 1
    narrow = np.full(len(tokens.dictionary), -1)
    narrow[used] = np.arange(len(used))
    at = narrow[tokens.indices.to_numpy()]
    times, aged = (np.zeros((len(asked), len(used))) for _ in range(2))
    for matrix, name in ((times, "times"), (aged, "aged")):
        np.add.at(matrix, (query[at >= 0], at[at >= 0]), numbers(mine, name)[at >= 0])
    hit = times @ hits.T
    row, one = np.nonzero((hit > 0) | (numbers(asked, "age_words") > 0)[:, None] & old[None, :])
    whole = lambda matrix: pa.array(matrix[row, one].astype(np.int64))
    told = aged.any(axis=0)
    columns = {"query_id": field(asked, "query_id").take(pa.array(row)), "ask": field(asked, "ask").take(pa.array(row)), "item_id": ids.take(pa.array(one)),
               "points": whole(times @ points.T), "hit": whole(hit), "age_hit": whole(aged[:, told] @ hits[:, told].T)}
    return pa.RecordBatch.from_arrays([columns[name] for name in (*names, "points", "hit", "age_hit")], names=[*names, "points", "hit", "age_hit"])


def containing_words(words: DataFrame, tokens: DataFrame, shortest: int = 1) -> DataFrame:
    """``(word, token)`` where the word contains the token, from distinct words and distinct tokens; ``words`` may have further columns, which stay.

    Candidates share the token's first three characters (all of it when shorter) as a gram of the word;
    the test itself then decides.  ``shortest`` is the least length of a token; from 3 on a word has only grams of three.
    Grams are shuffled only where some token's gram falls into the same of ``SLOTS`` slots, kept as bits of one row.
    """
    tokens = tokens.filter((F.col("token") != "") & (F.length("token") >= shortest))
    keyed = tokens.select("token", F.left("token", F.lit(3)).alias("gram"))
    kept = words.columns
    sizes = F.array(*[F.lit(n) for n in range(min(3, shortest), 4)])
    at = words.filter(F.length("word") >= 1).crossJoin(F.broadcast(_gram_bits(keyed))).select(  # one row
        *kept, "bits", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at"))
    cut = at.select(*kept, "bits", "at", F.explode(sizes).alias("size")).filter(F.col("at") + F.col("size") - 1 <= F.length("word"))
    grams = cut.select(*kept, "bits", F.substring(F.col("word"), F.col("at"), F.col("size")).alias("gram"))
    slot = _slot(F.col("gram"))
    marked = F.getbit(F.get("bits", F.shiftright(slot, 6)), F.pmod(slot, F.lit(64))) == 1
    return grams.filter(marked).select(*kept, "gram").join(keyed, "gram").filter(F.contains("word", F.col("token"))).select(*kept, "token").distinct()


SLOTS = 1 << 15


def _slot(gram: Column) -> Column:
    return F.pmod(F.hash(gram), F.lit(SLOTS))


def _gram_bits(keyed: DataFrame) -> DataFrame:
    """One row: ``bits``, whole numbers of 64 bits each, set at the slots of the grams in ``keyed(gram)``."""
    slots = keyed.select(_slot(F.col("gram")).alias("slot")).distinct()
    held = slots.groupBy(F.shiftright("slot", 6).cast("bigint").alias("id")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("slot", F.lit(64)))).alias("held"))
    every = keyed.sparkSession.range(SLOTS // 64).join(held, "id", "left")
    rows = F.array_sort(F.collect_list(F.struct("id", F.coalesce("held", F.lit(0).cast("bigint")).alias("held"))))
    return every.agg(rows.alias("rows")).select(F.col("rows.held").alias("bits"))
