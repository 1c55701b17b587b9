"""Text, title, vector and time rules over whole columns of the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark import vocab
from shelfmark.functions import text as tx, values as vx
from shelfmark.plans import duck
from shelfmark.plans.bind import AS_OF
from shelfmark.plans.registry import query


def _digest(column):
    """Order-free fingerprint of a string array."""
    return F.md5(F.array_join(F.array_sort(column), "\n"))


def _digest_sql(x: str) -> str:
    return f"md5(coalesce(array_to_string(list_sort({x}), chr(10)), ''))"


@query("tx4_clean_text", f"select item_id, length(c) as size, md5(c) as digest from (select item_id, {duck.clean('ocr_text')} as c from v_items)")
def clean(lib):
    return lib.items.select("item_id", tx.clean_text(F.col("ocr_text")).alias("c")).select(
        "item_id", F.length("c").cast("bigint").alias("size"), F.md5("c").alias("digest"))


@query("tx5_preview", f"""select item_id, case when length(c) = 0 then null when length(c) > 160 then c[1:160] || '…' else c end as preview
  from (select item_id, {duck.clean('ocr_text')} as c from v_items)""")
def preview(lib):
    rows = lib.items.select("item_id", tx.clean_text(F.col("ocr_text")).alias("c"))
    return rows.select("item_id", tx.preview(F.col("c")).alias("preview"))


@query("en8_sparse_text", f"select item_id, length({duck.strip('ocr_text')}) < 12 as sparse from v_items")
def sparse(lib):
    return lib.items.select("item_id", tx.is_sparse(F.col("ocr_text")).alias("sparse"))


_TITLES = {
    "v_raw_title": """select collection_id::varchar as key, title from v_collection union all
      select 'd' || doc_id, text from documents union all select 'p' || p_partkey, p_name || '  -- ' || p_type || '/' || p_brand from part
      union all select 'u' || page_id, url from pages""",
    "v_norm": f"select key, title, {duck.normalize_title('title')} as norm from v_raw_title",
}


def _titles(lib):
    text = lambda c: F.col(c).cast("string")
    out = lib.collections.select(text("collection_id").alias("key"), "title")
    out = out.unionByName(lib.table("documents").select(F.concat(F.lit("d"), text("doc_id")).alias("key"), F.col("text").alias("title")))
    out = out.unionByName(lib.table("part").select(F.concat(F.lit("p"), text("p_partkey")).alias("key"),
                                                   F.concat("p_name", F.lit("  -- "), "p_type", F.lit("/"), "p_brand").alias("title")))
    return out.unionByName(lib.table("pages").select(F.concat(F.lit("u"), text("page_id")).alias("key"), F.col("url").alias("title")))


@query("tx6_normalize_title", "select key, md5(norm) as digest from v_norm", _TITLES)
def normalize(lib):
    return _titles(lib).select("key", F.md5(tx.normalize_title(F.col("title"))).alias("digest"))


@query("tx7_acceptable_title", f"""select key, clean, length(clean) between 3 and 40 and not contains(clean, '.')
    and len(regexp_split_to_array(clean, '\\s+')) between 1 and 4 and {duck.normalize_title('clean')} not in {duck.inside(duck.GENERIC)}
    and not starts_with({duck.normalize_title('clean')}, 'screenshot') as accepted
  from (select key, array_to_string(regexp_split_to_array({duck.strip('title')}, '\\s+')[1:4], ' ') as clean from v_raw_title)""", _TITLES)
def acceptable(lib):
    rows = _titles(lib).select("key", tx.sanitize_title(F.col("title")).alias("clean"))
    return rows.select("key", "clean", tx.is_acceptable_title(F.col("clean")).alias("accepted"))


@query("tx8_first_emoji", f"""select item_id, case when g = '' or regexp_full_match(g, '[\\x00-\\x7F]+') then null else g end as emoji
  from (select item_id, left_grapheme({duck.strip('ocr_text')}, 1) as g from v_items)""")
def emoji(lib):
    return lib.items.select("item_id", tx.first_emoji(F.col("ocr_text")).alias("emoji"))


@query("tx9_similarity", f"""select a.p_partkey, round({duck.similarity('a.p_name', 'b.name')}, 6) as score
  from part a join (select p_partkey as k, p_type || ' ' || p_name as name from part) b on b.k = a.p_partkey
  union all select 1000000000 + a.p_partkey, round({duck.similarity('a.p_name', 'b.p_name')}, 6)
  from part a join part b on b.p_partkey = a.p_partkey + 1""")
def similarity(lib):
    part = lib.table("part").select("p_partkey", "p_name", F.concat_ws(" ", "p_type", "p_name").alias("name"))
    own = part.select("p_partkey", F.round(tx.similarity(F.col("p_name"), F.col("name")), 6).alias("score"))
    nxt = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return own.unionByName(part.join(nxt, "p_partkey").select(
        (F.lit(1_000_000_000) + F.col("p_partkey")).alias("p_partkey"), F.round(tx.similarity(F.col("p_name"), F.col("other")), 6).alias("score")))


@query("tx10_distinctive_tokens", f"select item_id, len(t) as n, {_digest_sql('t')} as digest from (select item_id, {duck.distinctive('ocr_text')} as t from v_items)")
def tokens(lib):
    rows = lib.items.select("item_id", tx.distinctive_tokens(F.col("ocr_text")).alias("t"))
    return rows.select("item_id", F.size("t").cast("bigint").alias("n"), _digest(F.col("t")).alias("digest"))


@query("tx11_phrases", f"""select item_id, len(t) as n, {_digest_sql('t')} as digest
  from (select item_id, {duck.phrases_of('k')} as t from (select item_id, {duck.kept_words('ocr_text')} as k from v_items))""")
def phrases(lib):
    rows = lib.items.select("item_id", tx.phrases(F.col("ocr_text")).alias("t"))
    return rows.select("item_id", F.size("t").cast("bigint").alias("n"), _digest(F.col("t")).alias("digest"))


_ENTITY = duck.entities("ocr_text")


@query("tx12_entities", "select item_id, " + ", ".join(f"{_digest_sql(e)} as {n}" for n, e in _ENTITY.items()) + " from v_items")
def entities(lib):
    columns = tx.entity_columns(F.col("ocr_text"))
    return lib.items.select("item_id", *[_digest(columns[n]).alias(n) for n in _ENTITY])


_NEEDLES = sorted({w for ws in vocab.FACET_CUES.values() for w in ws})


@query("tx13_needles", f"""select item_id, {duck.any_of('low', _NEEDLES)} as any_needle, {duck.count_of('low', _NEEDLES)} as needles,
  {duck.count_words('g', vocab.FACET_CUES['lodging_words'])} as words
  from (select item_id, lower(ocr_text) as low, {duck.guarded('lower(ocr_text)', 'Z')} as g from v_items)""")
def needles(lib):
    words = vocab.FACET_CUES["lodging_words"]
    rows = lib.items.select("item_id", F.lower("ocr_text").alias("low")).withColumn("n", tx.count_groups(F.col("low"), {"all": _NEEDLES, "words": words}))
    known = F.col("low").isNotNull()
    # A word that stands alone occurs, so only texts with one are cut into words.
    return rows.select("item_id", F.when(known, F.col("n.all") > 0).alias("any_needle"), F.col("n.all").alias("needles"),
                       F.when(known & (F.col("n.words") == 0), 0).otherwise(tx.count_words(F.col("low"), words)).alias("words"))


@query("tx15_redact", f"""select item_id, case when c = '' then null when length(c) > 280 then c[1:277] || '…' else c end as message,
    {duck.strip('note')}[1:96] as note
  from (select item_id, note, {duck.strip("regexp_replace(regexp_replace(raw, '" + vocab.SECRET_PATTERN + "', '[redacted]', 'g'), '[[:space:]]+', ' ', 'g')")} as c
        from (select item_id, ocr_text || ' api_key=' || item_id || ' Bearer ' || item_id as raw, ocr_text as note from v_items))""")
def redact(lib):
    key = F.col("item_id").cast("string")
    raw = F.concat("ocr_text", F.lit(" api_key="), key, F.lit(" Bearer "), key)
    return lib.items.select("item_id", tx.redact(raw).alias("message"), tx.bounded_note(F.col("ocr_text")).alias("note"))


@query("tx17_fingerprint", """select item_id, 'v2:' || length(ocr_text) || ':' || sha256(ocr_text) || ':' || coalesce(cast(epoch(created_at) as bigint)::varchar, '') as fingerprint from v_items""")
def fingerprint(lib):
    from shelfmark.operators.understand import fingerprint as build

    return lib.items.select("item_id", build(F.col("ocr_text"), F.col("created_at")).alias("fingerprint"))


_HOURS = f"abs(epoch(timestamp '{AS_OF}') - epoch(created_at)) / 3600.0"


@query("dt1_time_rules", f"""select item_id, round({_HOURS}, 4) as hours, case when {_HOURS} <= 2 then 0.10 when {_HOURS} <= 12 then 0.06 when {_HOURS} <= 48 then 0.03
    when {_HOURS} <= 168 then 0.01 else 0.0 end as band,
  round(coalesce(1 - least(greatest(0, (epoch(timestamp '{AS_OF}') - epoch(created_at)) / 86400.0), 365) / 365.0, 0), 6) as recency,
  created_at < timestamp '{AS_OF}' - interval 6 month as is_old from v_items""")
def time_rules(lib):
    hours = vx.hours_between(lib.as_of, F.col("created_at"))
    return lib.items.select("item_id", F.round(hours, 4).alias("hours"), vx.time_band(hours).alias("band"),
                            F.round(vx.recency(F.col("created_at"), lib.as_of), 6).alias("recency"),
                            (F.col("created_at") < vx.months_before(lib.as_of)).alias("is_old"))


@query("vc1_vector_distance", """select a.vec_id, round(list_distance(a.embedding::double[], b.embedding::double[]), 6) as distance,
  round(1 / (1 + list_distance(a.embedding::double[], b.embedding::double[])), 6) as similarity,
  case when list_distance(a.embedding::double[], b.embedding::double[]) <= 1.1 then 'strong'
       when list_distance(a.embedding::double[], b.embedding::double[]) <= 1.3 then 'weak' else 'far' end as band
  from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def distance(lib):
    a = lib.table("embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    rows = a.join(b, "vec_id").withColumn("d", vx.l2_distance(F.col("embedding"), F.col("other")))
    return rows.select("vec_id", F.round("d", 6).alias("distance"), F.round(vx.vector_similarity(F.col("d")), 6).alias("similarity"),
                       vx.distance_band(F.col("d"), 1.1, 1.3).alias("band"))


@query("st2_token_sets", f"""select part_a, shared, together, round(shared::double / nullif(together, 0), 6) as jaccard, shared = 0 as disjoint from (
  select a.doc_id as part_a, len(list_intersect(ta, tb)) as shared, len(list_distinct(list_concat(ta, tb))) as together
  from (select doc_id, {duck.distinctive('text')} as ta from documents) a
  join (select doc_id, {duck.distinctive('text')} as tb from documents) b on b.doc_id = a.doc_id + 1)""")
def token_sets(lib):
    docs = lib.table("documents").select("doc_id", tx.distinctive_tokens(F.col("text")).alias("ta"))
    nxt = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("ta").alias("tb"))
    rows = docs.join(nxt, "doc_id")
    together = F.size(F.array_union("ta", "tb"))
    return rows.select(
        F.col("doc_id").alias("part_a"), F.size(F.array_intersect("ta", "tb")).cast("bigint").alias("shared"), together.cast("bigint").alias("together"),
        F.when(together > 0, F.round(tx.jaccard(F.col("ta"), F.col("tb")), 6)).alias("jaccard"), (~F.arrays_overlap("ta", "tb")).alias("disjoint"))
