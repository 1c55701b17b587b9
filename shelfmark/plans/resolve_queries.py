"""Title matching, confidence and decisions over documents read as understood items."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark import vocab
from shelfmark.functions import text as tx
from shelfmark.operators import listing, membership, resolve as op, titles as tt, understand as un, validate as va
from shelfmark.plans import duck
from shelfmark.plans.bind import RECEIPT_ID
from shelfmark.plans.enrich_queries import LABEL_VIEWS, SOURCE_VIEWS, facet_rows
from shelfmark.plans.group_queries import TITLE_VIEWS, cleaned, label_rows
from shelfmark.plans.membership_queries import _PROFILE
from shelfmark.plans.registry import query
from shelfmark.session import landed

N = duck.normalize_title
DENIED = duck.inside(duck.GENERIC)
# Entity needles and proposal rules in the words of the bound texts, as the default lists hardly meet them.
SEEDS = (
    ("city", "Erble", ("erble", "heon")), ("airline", "Tion Ciónes", ("ciónes", "étion")), ("hotel", "Achlich", ("achlich",)),
    ("topic", "Nicht", ("nicht",)), ("topic", "Apartment", ("booking reference",)), ("merchant", "That", ("that",)))
RULES = (
    ("Erble", "erble", "Heon That", "✈️", 0.88), ("Nicht", "nicht", "Nicht Sich Haus", "🏠", 0.87),
    ("Apartment", "subtotal", "Order Receipts", "🧾", 0.86), ("That", None, "en src2", "🍜", 0.86))

_SEED_LIST = "list_concat(" + ", ".join(f"case when {duck.any_of('low', n)} then [{{'t': '{k}', 'v': '{v}', 'c': 0.82::double}}] else [] end" for k, v, n in SEEDS) + ")"
_RULE = "case " + " ".join(f"when list_contains(list_transform(ents, lambda e: e.v), '{v}')" + (f" or contains(low, '{n}')" if n else "") + f" then '{t}|{c}'"
                           for v, n, t, _, c in RULES) + " end"
_TRAVEL, _HOME = duck.listing(vocab.TRAVEL_LABELS), duck.listing(vocab.HOME_LABELS)

# Understanding of every item: entities, candidate titles of at least 0.4, a proposal, settled against existing titles.
UNDERSTAND_VIEWS = {
    **_PROFILE, **SOURCE_VIEWS, **LABEL_VIEWS, "v_clean": TITLE_VIEWS["v_clean"],
    "v_tagged": f"""select {RECEIPT_ID} + item_id as item_id, list({{'t': 'visual', 'v': identifier, 'c': cast(confidence as double)}} order by pos) as tags
        from v_kept where reason = 'kept' group by 1""",
    "v_base0": """select item_id, created_at, clean, lower(clean) as low, facets, coalesce(tags, []) as tags, list_transform(coalesce(tags, []), lambda t: t.v) as names
        from v_clean join v_strong using (item_id) left join v_tagged using (item_id)""",
    "v_base1": f"select *, list_concat(tags[1:5], {_SEED_LIST}) as ents0 from v_base0",
    "v_base": f"""select *, list_filter(ents, lambda e: e.t <> 'visual') as named from (select *, case when list_has_any(names, {_HOME}) and not list_contains(list_transform(ents0, lambda e: e.v), 'Apartment')
        then list_append(ents0, {{'t': 'topic', 'v': 'Apartment', 'c': 0.55::double}}) else ents0 end as ents from v_base1)""",
    "v_context": f"""select collection_id, title, lower(title) as lt, list_filter({duck.words('lower(title)')}, lambda t: length(t) >= 3) as toks,
        string_split(lower(coalesce(key_entities, '')), ',') as known from v_cell left join v_profile using (collection_id) where not is_archived and kind <> 'unassigned'""",
    "v_fit": f"""select item_id, collection_id, title, round(least(0.96, hits / len(toks) * 0.85 + case when hits >= len(toks) then 0.15 else 0 end)::double, 6) as score from (
        select item_id, collection_id, title, toks, len(list_filter(toks, lambda t: contains(low, t)))
            + len(list_filter(named, lambda e: contains(lt, lower(e.v)) or len(list_filter(string_split(lower(e.v), ' '), lambda w: w <> '' and contains(lt, w))) > 0))
            + 0.75 * len(list_filter(named, lambda e: list_contains(known, lower(e.v))))
            + case when (contains(lt, 'japan') or contains(lt, 'trip')) and list_has_any(names, {_TRAVEL}) then 0.6 else 0 end
            + case when contains(lt, 'apartment') and list_has_any(names, {_HOME}) then 0.6 else 0 end as hits
        from v_base cross join v_context where len(toks) > 0)""",
    "v_found": """select item_id, list({'title': title, 'score': score} order by score desc, collection_id) as cands from v_fit where score >= 0.4 group by 1""",
    "v_asked": f"""select *, case when clean <> '' and coalesce(cands[1].score, 0) < 0.7 then {_RULE} end as rule from v_base left join v_found using (item_id)""",
    "v_existing": f"""select r.t as rtitle, arg_min(c.title, collection_id) as existing from (select unnest({duck.listing([r[2] for r in RULES])}) as t) r
        join v_context c on {duck.similarity(N('r.t'), N('c.title'))} >= 0.9 where {N('r.t')} not in {DENIED} group by 1""",
    "v_settled": """select * from (select *, string_split(rule, '|')[1] as rtitle, cast(string_split(rule, '|')[2] as double) as rscore from v_asked) left join v_existing using (rtitle)""",
    "v_known": f"""select item_id, created_at, clean, facets, names, named, ents, list_transform(list_filter(ents, lambda e: e.t = 'city'), lambda e: e.v) as locations,
        case when clean = '' then 'Image · ' || coalesce(names[1], facets[1], 'sparse OCR') when len(named) > 0 then named[1].v || ' screenshot' else left(clean, 80) end as summary,
        case when existing is null then coalesce(cands, []) else list_concat(list_filter(coalesce(cands, []), lambda c: c.score >= greatest(rscore, 0.86)),
          [{{'title': existing, 'score': greatest(rscore, 0.86)}}], list_filter(coalesce(cands, []), lambda c: c.score < greatest(rscore, 0.86))) end as cands,
        case when existing is null and {N('rtitle')} not in {DENIED} then rtitle end as pt, rscore as ps from v_settled""",
}

VIEWS = {
    **UNDERSTAND_VIEWS,
    "v_under": """select item_id, created_at, names as vis, ents, named, facets, locations, summary, cands, pt, case when pt is not null then ps end as ps, clean,
        case when length(clean) > 2500 then 3 else 1 end as batch_size, case when length(clean) between 900 and 1200 then 0.8 end as shared,
        list_transform(ents, lambda e: e.v) as vals from v_known""",
    "v_elig": f"""select c.*, {N('title')} as norm, coalesce(key_terms, '') as terms, coalesce(key_entities, '') as ents, date_range_start, date_range_end,
        kind <> 'unassigned' and kind <> 'userContext' and created_by <> 'user' as auto
      from v_cell c left join v_profile using (collection_id) where not is_archived""",
    "v_coll": f"""select e.*, list_filter(list_distinct(string_split(norm, ' ')), lambda t: length(t) >= 3) as own,
        list_filter(list_distinct(string_split(lower(concat_ws(' ', replace(ents, ',', ' '), replace(terms, ',', ' '),
          (select string_agg(normalized_alias, ' ') from v_alias a where a.collection_id = e.collection_id))), ' ')), lambda t: length(t) >= 3) as prof
      from v_elig e where auto""",
    "v_item": f"""select *, {N("coalesce(pt, cands[1].title)")} as leadkey,
        list_filter(list_distinct({duck.words("lower(concat_ws(' ', array_to_string(vals, ' '), array_to_string(locations, ' '), array_to_string(vis, ' '), summary))")}), lambda t: length(t) >= 3) as ttok,
        list_filter(list_distinct(string_split(lower(concat_ws(' ', array_to_string(vals, ' '), array_to_string(locations, ' '), array_to_string(vis, ' '))), ' ')), lambda t: length(t) >= 3) as vtok,
        case when len(vis) = 0 then 0 when clean <> '' or len(named) > 0 then 0.08 when len(ents) > 0 then 0.05 else 0 end as tv,
        greatest(case when batch_size > 1 then least(0.12, 0.04 * (batch_size - 1)) else 0 end, case when shared >= 0.7 then 0.10 else 0 end) as batch from v_under""",
    "v_ask": f"""select item_id, 0 as src, c.title as title, c.score as provider, {N('c.title')} as tkey from (select item_id, unnest(cands) as c from v_item) union all
      select item_id, 1, pt, ps, {N('pt')} from v_item where pt is not null""",
    "v_clean_title": f"""select item_id, array_to_string(regexp_split_to_array({duck.strip('pt')}, '\\s+')[1:4], ' ') as ct from v_item where pt is not null""",
    "v_key": f"select distinct tkey from v_ask union select distinct {N('ct')} from v_clean_title",
    "v_best_match": f"""select tkey, arg_min(collection_id, o) as collection_id, min(o)[1]::int as match_rank from (
        select tkey, collection_id, [1.0, -1.0, collection_id] as o from v_key join v_coll on norm = tkey union all
        select tkey, a.collection_id, [2.0, -1.0, a.collection_id] from v_key join v_alias a on normalized_alias = tkey join v_coll c on c.collection_id = a.collection_id union all
        select tkey, collection_id, [3.0, -s, collection_id] from (
          select tkey, collection_id, {duck.similarity('tkey', 'mkey')} as s from v_key join (
            select collection_id, norm as mkey from v_coll union all
            select a.collection_id, normalized_alias from v_alias a join v_coll using (collection_id)) on abs(length(tkey) - length(mkey)) <= 60) where s >= 0.9)
      where tkey <> '' group by 1""",
    "v_scored": """select item_id, src, title, provider, collection_id from v_ask left join v_best_match using (tkey) union all
      select item_id, 2, c.title, least(0.95, ov), collection_id from (select item_id, collection_id, c.title as title, round(len(list_intersect(ttok, own))::double / len(own), 6) as ov
        from v_item join v_coll c on len(own) > 0 and list_has_any(ttok, own)) c where ov >= 0.55 union all
      select item_id, 3, c.title, ov, collection_id from (select item_id, collection_id, c.title as title, round(least(1.0, len(list_intersect(vtok, prof))::double / least(6, len(prof))), 6) as ov
        from v_item join v_coll c on len(prof) > 0 and list_has_any(vtok, prof)) c where ov >= 0.45""",
    "v_parts": f"""select s.*, i.batch, i.tv, i.leadkey, i.created_at,
        case when c.collection_id is null or len(vtok) = 0 or len(prof) = 0 then 0 else round(least(1.0, len(list_intersect(vtok, prof))::double / least(6, len(prof))), 6) end as ent,
        c.collection_id is not null and exists (select 1 from v_alias a where a.collection_id = c.collection_id and a.normalized_alias = leadkey) as al,
        coalesce({duck.similarity('leadkey', 'norm')} >= 0.9, false) and c.collection_id is not null as titled,
        coalesce(i.created_at >= date_range_start - interval 3 day and i.created_at <= date_range_end + interval 3 day, false) as timely
      from (select item_id, src, title, provider, collection_id from v_scored union all
            select t.item_id, 9, ct, ps, m.collection_id from v_clean_title t join v_item using (item_id) left join v_best_match m on m.tkey = {N('ct')}) s
      join v_item i using (item_id) left join v_coll c on c.collection_id = s.collection_id""",
    "v_final": """select *, round(least(1.0, greatest(0.0, least(1.0, provider) + greatest(case when titled then 0.10 else 0 end, least(0.15, ent * 0.2)) + case when al then 0.12 else 0 end
        + least(0.12, ent * 0.15) + case when timely then 0.08 else 0 end + tv + batch))::double, 6) as final from v_parts""",
    "v_top": """select item_id, collection_id as best_id, final as best_final from (select *, row_number() over (partition by item_id
        order by final desc, src, coalesce(collection_id, 0)) as k from v_final where src < 9) where k = 1""",
    "v_case": f"""select *, case when best_final is null then 'empty' when best_final < 0.7 then 'low' when best_id is not null then 'match'
        when valid and existing is not null and reuse_final >= 0.7 then 'proposed'
        when valid and existing is null and create_final >= 0.85 and corr and not clash then 'create' when valid and create_final >= 0.85 and not corr then 'alone'
        when valid and create_final >= 0.7 and create_final < 0.85 then 'middle' else 'none' end as kase
      from (select i.item_id, pt, ct, best_id, best_final, x.collection_id as existing, x.final as reuse_final,
          round(least(1.0, ps + i.tv + i.batch)::double, 6) as create_final,
          coalesce(ct is not null and length(ct) between 3 and 40 and not contains(ct, '.') and {N('ct')} not in {DENIED} and not starts_with({N('ct')}, 'screenshot'), false) as valid,
          ps >= 0.85 and {N('pt')} not in {DENIED} and not list_contains(list_transform(facets, lambda f: replace(f, '_', ' ')), {N('pt')}) and (batch_size >= 2 or coalesce(shared >= 0.75, false)
            or (len(list_filter(ents, lambda e: e.c >= 0.75 and e.t in {duck.inside(vocab.STRONG_ENTITY_TYPES)})) > 0 and (len(locations) > 0 or i.tv >= 0.08 or len(string_split({N('pt')}, ' ')) >= 2))) as corr,
          exists (select 1 from v_elig u where (kind = 'userContext' or created_by = 'user') and (u.norm = {N('ct')} or exists (
            select 1 from v_alias a where a.collection_id = u.collection_id and a.normalized_alias = {N('ct')}))) as clash
        from v_item i left join v_top using (item_id) left join v_clean_title using (item_id) left join v_final x on x.item_id = i.item_id and x.src = 9)""",
}


def _known(lib):
    """EN6 over the whole texts of all items, with their labels and strong facets, written once."""
    def build():
        labels = label_rows(lib)
        texts = cleaned(lib)
        items = texts.select("item_id", "clean").join(facet_rows(lib).select("item_id", "facets"), "item_id").join(labels, "item_id", "left")
        none = F.array().cast("array<struct<identifier:string,confidence:float>>")
        items = items.withColumn("labels", F.coalesce("labels", none))
        contexts = eligible(lib).filter("kind <> 'unassigned'").select("collection_id", "title", "key_entities", "visual_descriptors")
        sized = texts.select("item_id", "created_at", F.length("clean").alias("n"))
        return un.understand(items, contexts, SEEDS, RULES, lambda base: landed(base, "spoken")).join(sized, "item_id")
    return lib.shared("understood", build)


def understood(lib):
    """Understood items with what a batch adds: how many items it had, and how sure its shared context is."""
    n = F.col("n")
    return _known(lib).select("*", F.when(n.between(900, 1200), F.lit(0.8)).alias("shared_confidence"), F.when(n > 2500, 3).otherwise(1).alias("batch_size"))


def prepared(lib):
    """The item side of all resolver steps, written once."""
    return lib.shared("prepared", lambda: op.prepare_items(understood(lib)))


def eligible(lib):
    """The eligible view, written once: profiles read member texts."""

    def build():
        rows = listing.eligible_collections(lib.cells, lib.aliases, membership.collection_profiles(lib.prose, lib.memberships))
        none = F.array().cast("array<string>")
        return rows.withColumn("normalized_title", tx.normalize_title(F.col("title"))).withColumn("visual_descriptors", none)

    return lib.shared("eligible", build)


@query("rs1_auto_eligible", "select collection_id from v_cell where kind not in ('unassigned', 'userContext') and created_by <> 'user'")
def auto(lib):
    return op.auto_eligible(lib.cells).select("collection_id")


_SIMILAR = {**VIEWS, "v_all_key": f"select distinct {N('title')} as k from v_collection union select normalized_alias from v_alias union select {N('title')} || 's' from v_collection"}


@query("tx9_similar_titles", f"""select a.k as title_key, b.k as match_key, round({duck.similarity('a.k', 'b.k')}, 6) as score from v_all_key a join v_all_key b
  on a.k <> '' and b.k <> '' and {duck.similarity('a.k', 'b.k')} >= 0.9""", _SIMILAR)
def similar(lib):
    named = lib.collections.select(tx.normalize_title(F.col("title")).alias("k"))
    turned = lib.aliases.select(F.col("normalized_alias").alias("k"))
    keys = turned.unionByName(named).unionByName(named.select(F.concat("k", F.lit("s")).alias("k"))).distinct()
    return tt.similar_titles(keys.select(F.col("k").alias("title_key")), keys.select(F.col("k").alias("match_key")))


@query("j10_best_title_match", "select tkey as title_key, collection_id, match_rank from v_best_match where tkey in (select tkey from v_ask)", VIEWS)
def best_match(lib):
    rows = understood(lib)
    titles = rows.select(F.explode("candidates.title").alias("t")).unionByName(rows.select(F.col("proposed.title").alias("t")).filter("t is not null"))
    keys = op.once_each(titles.select(F.col("t").alias("title"))).select(tx.normalize_title(F.col("one")).alias("title_key"))
    return op.best_title_match(keys, op.auto_eligible(eligible(lib)), lib.aliases)


@query("rs3_match_per_item", "select item_id, src, collection_id from v_ask left join v_best_match using (tkey)", VIEWS)
def match_per_item(lib):
    items = prepared(lib)
    return op.score_candidates(items, eligible(lib), lib.aliases).filter("src_rank < 2").select("item_id", F.col("src_rank").alias("src"), "collection_id")


@query("rs2_candidates", "select item_id, src, title, collection_id, final from v_final where src < 9", VIEWS)
def candidates(lib):
    items = prepared(lib)
    return op.score_candidates(items, eligible(lib), lib.aliases).select("item_id", F.col("src_rank").alias("src"), "title", "collection_id", "final")


@query("rs4_entity_overlap", """select item_id, collection_id, round(least(1.0, len(list_intersect(vtok, prof))::double / least(6, len(prof))), 6) as overlap
  from v_item join v_coll on len(prof) > 0 and list_has_any(vtok, prof) where len(list_intersect(vtok, prof)) >= 0.45 * least(6, len(prof)) - 1e-9""", VIEWS)
def entity_overlap(lib):
    items = prepared(lib)
    return op.overlapping(items, "value_tokens", op.collection_tokens(op.auto_eligible(eligible(lib))), "profile_tokens", 0.45, 6)


@query("rs5_text_visual", "select item_id, round(tv::double, 6) as agreement, round(batch::double, 6) as batch from v_item", VIEWS)
def text_visual(lib):
    return prepared(lib).select("item_id", F.round("text_visual", 6).alias("agreement"), F.round("batch", 6).alias("batch"))


@query("rs6_confidence", "select item_id, max(final) as best, count(*) as candidates from v_final where src < 9 group by 1", VIEWS)
def confidence(lib):
    items = prepared(lib)
    return op.score_candidates(items, eligible(lib), lib.aliases).groupBy("item_id").agg(
        F.max("final").alias("best"), F.count(F.lit(1)).alias("candidates"))


@query("rs7_corroboration", "select item_id, corr from v_case where pt is not null", VIEWS)
def corroboration(lib):
    rows = prepared(lib).filter("proposed is not null")
    c = F.col
    return rows.select("item_id", op.create_corroborated(c("batch_size"), c("shared_confidence"), c("entities"), c("locations"), c("type_facets"),
                                                         c("proposed.title"), c("proposed.confidence"), c("text_visual")).alias("corr"))


@query("rs8_decisions", """select item_id, case when kase in ('match', 'proposed') then 'reuse' when kase = 'create' then 'create' else 'needsReview' end as decision,
  case kase when 'match' then best_id when 'proposed' then existing end as collection_id,
  case when kase = 'proposed' then reuse_final when kase in ('create', 'alone', 'middle') then create_final else best_final end as confidence, kase as kind from v_case""", VIEWS)
def decisions(lib):
    rows = op.decide(prepared(lib), eligible(lib), lib.aliases)
    reason = F.col("reason")
    kind = (F.when(reason.startswith("No candidates"), "empty").when(reason.startswith("Best"), "low").when(reason.contains("for proposed title"), "proposed")
            .when(reason.startswith("Reuse"), "match").when(reason.startswith("Create confidence"), "alone").when(reason.startswith("Create"), "create")
            .when(reason.startswith("Mid-band"), "middle").otherwise("none"))
    return rows.select("item_id", "decision", "collection_id", "confidence", kind.alias("kind"))


@query("en6_understanding", """select item_id, summary, len(ents)::bigint as entities, array_to_string(list_transform(cands, lambda c: c.title), '|') as candidates,
    round(coalesce(list_sum(list_transform(cands, lambda c: c.score)), 0)::double, 4) as score, pt as proposed, concat_ws(',', 'ondevice_heuristic',
      case when len(facets) > 0 then 'visual_facets' end, case when len(names) > 0 then 'vision_labels' end,
      case when list_has_any(names, """ + _TRAVEL + """) and len(locations) = 0 then 'travel_imagery' end, case when clean = '' then 'sparse_ocr' end) as signals
  from v_known""", UNDERSTAND_VIEWS)
def understanding(lib):
    total = F.aggregate(F.transform("candidates", lambda c: c["confidence"]), F.lit(0.0), lambda a, b: a + b)
    return _known(lib).select("item_id", "summary", F.size("entities").cast("bigint").alias("entities"),
                              F.array_join(F.transform("candidates", lambda c: c["title"]), "|").alias("candidates"), F.round(total, 4).alias("score"),
                              F.col("proposed.title").alias("proposed"), F.array_join("signals", ",").alias("signals"))


@query("rs9_shared_context", """select doc_id as item_id, case when mine and not open then 'Trip ' || source end as shared_title,
    case when open then 'batch,unresolved_in_batch' else 'batch' end || case when mine then ',seen_' || lang else '' end as signals
  from (select *, coalesce(quality, 1) = 1 as mine, coalesce(toxic, 0) = 1 as open from documents left join labels using (doc_id))""")
def shared_context(lib):
    labels = lib.table("labels")
    docs = lib.table("documents").join(labels, "doc_id", "left")
    key, mine, open_ = F.col("doc_id").cast("string"), F.coalesce("quality", F.lit(1)) == 1, F.coalesce("toxic", F.lit(0)) == 1
    rows = docs.select(
        F.col("doc_id").alias("item_id"), F.array(F.lit("batch")).alias("signals"),
        F.struct(F.concat_ws(" ", F.lit("Trip"), "source").alias("title"), F.lit(0.8).alias("confidence"),
                 F.when(mine, F.array(key)).otherwise(F.array(F.lit("-"))).alias("member_ids"), F.array(F.concat(F.lit("seen_"), "lang")).alias("evidence")).alias("shared"),
        F.when(open_, F.array(key)).otherwise(F.array().cast("array<string>")).alias("unresolved_ids"))
    return un.assign_shared_context(rows).select("item_id", F.col("shared.title").alias("shared_title"), F.array_join("signals", ",").alias("signals"))


@query("rs10_failed_results", """select event_id as item_id, 'needsReview' as decision, 'Cloud intelligence failed (code_' || cast(floor(value) as bigint) || ') — Needs Review' as reason
  from events where event_type = 'error' and value >= 10""")
def failed(lib):
    rows = lib.table("events").filter("event_type = 'error'").select(
        F.col("event_id").alias("item_id"), F.concat(F.lit("code_"), F.floor("value").cast("string")).alias("error_code"), (F.col("value") < 10).alias("retryable"))
    return un.failed_results(rows).select("item_id", "decision", "reason")


# ---- checks of results -----------------------------------------------------------------------------


def _group_json(lib):
    """A group result per conversation, shaped from its turns: good ones and several kinds of bad ones."""
    turns = lib.table("conversations").groupBy("conv_id").agg(
        F.array_sort(F.collect_set(F.col("turn").cast("string"))).alias("ids"), F.max(F.length("text")).alias("longest"), F.count(F.lit(1)).alias("n"))
    member = lambda x: F.struct(x.alias("localId"), F.lit("core").alias("role"), F.array().cast("array<string>").alias("notes"))
    none = F.array().cast("array<string>")
    body = F.struct(
        F.when(F.col("n") > 6, "yes").otherwise("no").alias("belongsTogether"), F.lit(0.5).alias("confidence"),
        F.when(F.col("longest") > 300, "Please create collection").otherwise("fine").alias("sharedContextSummary"), none.alias("supportingEvidence"), none.alias("conflictingEvidence"),
        F.transform(F.when(F.col("longest") < 100, F.slice(F.col("ids"), F.lit(2), F.size("ids"))).otherwise(F.col("ids")), member).alias("memberAssessments"),
        F.when(F.col("n") == 4, F.array(F.lit("x"))).otherwise(none).alias("outlierLocalIds"), (F.col("n") == 7).alias("insufficientEvidence"), none.alias("outerInnerNotes"))
    return turns.select("conv_id", "ids", "n", "longest", F.to_json(body).alias("json"))


_EXPECTED = """select conv_id, case when m not between 1 and 8 then 'MODEL_OUTPUT_INVALID' when n = 7 then 'INCONSISTENT_YES_INSUFFICIENT'
    when longest < 100 then 'MISSING_MEMBER_ASSESSMENT' when n = 4 then 'UNKNOWN_MEMBER_ID' when longest > 300 then 'FORBIDDEN_COLLECTION_FIELDS' end as code
  from (select *, case when longest < 100 then least(8, n - 1) else n end as m from (
    select conv_id, count(*) as n, max(length(text)) as longest from conversations group by 1))"""


@query("dq3_group_results", _EXPECTED)
def group_results(lib):
    rows = _group_json(lib)
    return rows.select("conv_id", va.group_issue(F.col("json"), F.col("ids")).alias("code"))


@query("dq4_forbidden", """select doc_id as item_id, case when toxic = 1 then 'collectionName,imageBase64' else '' end as keys, quality = 0 as banned from labels""")
def forbidden(lib):
    rows = lib.table("labels").select("doc_id", "quality", F.when(F.col("toxic") == 1, F.lit('{"collectionName": 1, "imageBase64": "x", "ok": 2}')).otherwise(F.lit('{"ok": 1}')).alias("json"))
    text = F.when(F.col("quality") == 0, "we should Create Collection here").otherwise("all fine")
    return rows.select(F.col("doc_id").alias("item_id"), F.array_join(va.forbidden_keys(F.col("json")), ",").alias("keys"), va.banned_text(text).alias("banned"))


@query("dq1_field_rules", """select event_id as item_id, concat_ws(',', case when value > 100 then 'entity_invalid' end, case when event_type = '' then 'candidate_invalid' end,
    case when event_type = 'view' and value > 100 then 'proposal_invalid' end) as issues from events""")
def field_rules(lib):
    none = F.array().cast("array<string>")
    score = F.col("value") / 100.0
    rows = lib.table("events").select(
        F.col("event_id").alias("item_id"), F.lit("s").alias("summary"), F.array(F.struct(F.lit("t").alias("type"), F.col("event_type").alias("value"), score.alias("confidence"))).alias("entities"),
        F.array(F.struct(F.col("event_type").alias("title"), F.lit(0.5).alias("confidence"))).alias("candidates"),
        F.when(F.col("event_type") == "view", F.lit("p")).alias("proposed_title"), score.alias("proposed_confidence"), none.alias("descriptors"), none.alias("notes"))
    return va.field_issues(rows).select("item_id", F.array_join("issues", ",").alias("issues"))


@query("dq2_batch_consistency", """select conv_id, case when n > 5 then 'missing members' when n = 5 then 'member count mismatch' when n = 4 then 'shared context names an unknown id'
    when n = 3 then 'id is shared and unresolved' end as problem from (select conv_id, count(*) as n from conversations group by 1)""")
def batch(lib):
    rows = lib.table("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_set(F.col("turn").cast("string"))).alias("ids"), F.count(F.lit(1)).alias("n"))
    n, ids = F.col("n"), F.col("ids")
    returned = F.when(n > 5, F.slice(ids, F.lit(2), F.size(ids))).when(n == 5, F.concat(ids, F.array(ids[0]))).otherwise(ids)
    shared = F.when(n == 4, F.array(F.lit("x"))).otherwise(F.array(ids[0]))
    return rows.select("conv_id", va.batch_issue(ids, returned, shared, F.when(n == 3, F.array(ids[0]))).alias("problem"))


@query("st3_member_sets", """with w as (select distinct conv_id, role, unnest(string_split(text, ' ')) as word from conversations),
    s as (select conv_id, word, bool_or(role = 'user') as asked, bool_or(role = 'assistant') as told from w group by 1, 2)
  select conv_id, count(*) filter (asked and not told) as missing, count(*) filter (told and not asked) as unknown, bool_or(asked and told) as overlap,
    count(*) filter (not asked and told) = 0 and count(*) filter (asked and not told) = 0 as same from s group by 1""")
def member_sets(lib):
    """The words a user used against those of the answers, as expected against returned members."""
    words = lambda role: F.array_distinct(F.flatten(F.collect_set(F.when(F.col("role") == role, F.split("text", " ", -1)))))
    rows = lib.table("conversations").filter(F.col("text").isNotNull()).groupBy("conv_id").agg(words("user").alias("asked"), words("assistant").alias("told"))
    missing, unknown = F.size(F.array_except("asked", "told")), F.size(F.array_except("told", "asked"))
    return rows.select("conv_id", missing.cast("bigint").alias("missing"), unknown.cast("bigint").alias("unknown"),
                       F.arrays_overlap("asked", "told").alias("overlap"), ((missing == 0) & (unknown == 0)).alias("same"))


@query("dq5_request_gates", """select conv_id, case when r = 'system' then 'SCHEMA_VERSION_MISMATCH' when n > 8 then 'BATCH_TOO_LARGE' when n in (3, 6) then 'REQUEST_INVALID'
    when n = 2 then 'VISUAL_REQUIRED' end as code from (select conv_id, count(*) as n, min(role) as r from conversations group by 1)""")
def gates(lib):
    rows = lib.table("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_set(F.col("turn").cast("string"))).alias("ids"), F.count(F.lit(1)).alias("n"), F.min("role").alias("r"))
    n, ids = F.col("n"), F.col("ids")
    members = F.when(n == 6, F.concat(F.slice(ids, 1, 5), F.array(ids[0]))).when(n == 3, F.slice(ids, 1, 1)).otherwise(ids)
    return rows.select("conv_id", va.request_issue(F.when(F.col("r") == "system", F.lit("old")), members, n == 2, F.lit(False), F.lit(" "), "8.3", min_batch=2).alias("code"))


@query("tx16_failure_categories", """select event_id as item_id, case when event_type = 'view' then case when floor(value) between 200 and 299 then null when floor(value) between 500 and 599 then 'providerError' else 'gatewayHTTP' end
    when event_type = 'click' then 'localNetworkPermission' when event_type = 'signup' then 'timeout' when event_type = 'purchase' then 'connectionRefused' else 'unknownNetwork' end as category from events""")
def categories(lib):
    kind = F.col("event_type")
    code = F.when(kind == "signup", "timedOut").when(kind == "purchase", "cannotFindHost").otherwise("other")
    path = F.when(kind == "click", F.lit("Local network prohibited"))
    status = F.when(kind == "view", F.floor("value").cast("int"))
    return lib.table("events").select(F.col("event_id").alias("item_id"), va.failure_category(code, path, status).alias("category"))
