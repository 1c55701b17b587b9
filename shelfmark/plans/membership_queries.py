"""Membership upkeep over the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import text as tx
from shelfmark.operators import listing, membership as op, search
from shelfmark.plans import duck
from shelfmark.plans.bind import AS_OF, cell
from shelfmark.plans.registry import query

COLUMNS = ("item_id", "collection_id", "source", "confidence", "position")
TARGET, EXTRA = cell("en", 5), cell("en", 2)


def settled(table: str, scope: str) -> str:
    """The review rule for ``scope(item_id)`` over a membership view."""
    return f"""with s as (select x.item_id, coalesce(bool_or(m.collection_id <> 0), false) as normal,
    coalesce(bool_or(m.collection_id = 0), false) as held
  from (select distinct item_id from {scope}) x left join {table} m using (item_id) group by 1)
select m.item_id, m.collection_id, case when m.collection_id = 0 and not s.normal then 'user' else m.source end as source,
  m.confidence, m.position from {table} m left join s using (item_id) where not (m.collection_id = 0 and coalesce(s.normal, false))
union all select item_id, 0, 'user', null, (select coalesce(max(position), -1) from {table} where collection_id = 0)
  + row_number() over (order by item_id) from s where not normal and not held"""


def appended(base: str, pairs: str) -> str:
    """Membership rows with ``pairs(item_id, collection_id)`` placed after the last position."""
    return f"""select item_id, collection_id, source, confidence, position from {base} union all
select p.item_id, p.collection_id, 'user', null, coalesce(last, -1) + row_number() over (partition by p.collection_id order by p.item_id)
from {pairs} p left join (select collection_id, max(position) as last from {base} group by 1) using (collection_id)"""


VIEWS = {
    "v_broken": "select * from v_membership where source = 'user' or confidence <= 0.73",
    "v_moved": "select doc_id as item_id from documents where lang = 'fr' and source = 'src7'",
    "v_m1_rest": "select * from v_membership where item_id not in (select item_id from v_moved)",
    "v_m1_pair": f"select item_id, {TARGET} as collection_id from v_moved",
    "v_m1": appended("v_m1_rest", "v_m1_pair"),
    "v_added": "select doc_id as item_id from documents where source = 'src9'",
    "v_m2_pair": f"""select item_id, {TARGET} as collection_id from v_added where item_id not in (
      select item_id from v_membership where collection_id = {TARGET})""",
    "v_m2_base": f"""select item_id, collection_id, case when collection_id = {TARGET} and item_id in (select item_id from v_added)
      then 'user' else source end as source, confidence, position from v_membership""",
    "v_m2": appended("v_m2_base", "v_m2_pair"),
    "v_dropped": "select doc_id as item_id from documents where n_chars > 2100",
    "v_m3": f"select * from v_membership where not (collection_id = {EXTRA} and item_id in (select item_id from v_dropped))",
    "v_m4_rest": f"select * from v_membership where collection_id <> {EXTRA}",
    "v_m4_pair": f"""select distinct item_id, 0 as collection_id from v_membership where collection_id = {EXTRA}
      and item_id not in (select item_id from v_m4_rest)""",
    "v_toxic": "select doc_id as item_id from labels where toxic = 1",
    "v_keep": "select *, first_value(item_id) over (partition by group_id order by position) as keep_id from v_dup",
    "v_decision": f"""select doc_id as item_id, case when n_chars < 600 then 'needsReview' when lang in ('en', 'de') then 'reuse'
      else 'create' end as decision, case when n_chars < 600 then null else {TARGET} end as collection_id,
      round(n_chars / 40000.0::double, 6) as confidence from documents""",
    "v_organize": """select *, collection_key like '% src4' as organize_locked, 'pending' as organize_status,
      cast(null as int) as resolver_version from v_prose""",
    "v_applied": """select d.*, case when organize_locked then 'locked' when coalesce(u, false) then 'keep'
      when decision in ('reuse', 'create') and collection_id is not null then 'file' else 'review' end as outcome
    from v_decision d join v_organize using (item_id)
    left join (select item_id, bool_or(source = 'user') as u from v_membership group by 1) using (item_id)""",
    "v_m8": """select m.item_id, m.collection_id, case when a.collection_id = m.collection_id then 'ai' else m.source end as source,
      case when a.collection_id = m.collection_id then a.confidence else m.confidence end as confidence, m.position
    from v_membership m left join (select * from v_applied where outcome = 'file') a using (item_id)
    where not (a.item_id is not null and m.collection_id = 0)
    union all select item_id, collection_id, 'ai', confidence, 0 from v_applied a where outcome = 'file'
      and not exists (select 1 from v_membership m where m.item_id = a.item_id and m.collection_id = a.collection_id)""",
    "v_reviewed": "select item_id from v_applied where outcome = 'review'",
    "v_plain": """select * replace (case when collection_id < 1000000000 then regexp_replace(title, '^[a-z]+ ', '') else title end as title)
      from v_cell""",
    "v_survivor": f"""select collection_id, normalized_title, first_value(collection_id) over (
        partition by normalized_title order by members desc, created_at, collection_id) as winner_id, members, created_at
      from (select c.*, {duck.normalize_title('title')} as normalized_title, coalesce(members, 0) as members from v_plain c
        left join (select collection_id, count(*) as members from v_membership group by 1) using (collection_id)
        where kind <> 'unassigned')""",
    "v_moving": """select m.*, s.winner_id, coalesce(s.winner_id, m.collection_id) as target, s.collection_id <> s.winner_id as is_loser,
        s.members, s.created_at as made from v_membership m left join v_survivor s using (collection_id)""",
    "v_merged": """select item_id, target as collection_id, bool_or(source = 'user') as u,
        first(source order by coalesce(is_loser, false), members desc, made, collection_id) as source,
        first(confidence order by coalesce(is_loser, false), members desc, made, collection_id) as confidence,
        first(position order by coalesce(is_loser, false), members desc, made, collection_id) as position,
        bool_and(coalesce(is_loser, false)) as arrived from v_moving group by 1, 2""",
    "v_m9": """select item_id, collection_id, case when u then 'user' else source end as source, confidence,
        case when arrived then coalesce(last, -1) + row_number() over (partition by collection_id, arrived order by item_id)
             else position end as position
      from v_merged left join (select collection_id, max(position) as last from v_membership group by 1) using (collection_id)""",
    "v_affected": """select item_id from v_membership where collection_id in (
      select collection_id from v_survivor where collection_id <> winner_id)""",
    "v_title": "select event_id as request_id, event_type || ' ' || user_id as title from events union all select 1000000000000 + doc_id, lang || '  ' || source from documents",
}


def _rows(df):
    return df.select(*COLUMNS)


def _chosen(lib, condition):
    return lib.table("documents").filter(condition).select(F.col("doc_id").alias("item_id"))


@query("mb5_review_invariant", settled("v_broken", "v_prose"), VIEWS)
def review_invariant(lib):
    broken = lib.memberships.filter("source = 'user' or confidence <= 0.73")
    return _rows(op.review_invariant(broken, lib.collections, lib.prose, lib.as_of))


@query("mb1_move", settled("v_m1", "v_moved"), VIEWS)
def move(lib):
    return _rows(op.move_items(lib.memberships, lib.collections, _chosen(lib, "lang = 'fr' and source = 'src7'"), TARGET, lib.as_of))


@query("mb2_add", settled("v_m2", "v_added"), VIEWS)
def add(lib):
    return _rows(op.add_items(lib.memberships, lib.collections, _chosen(lib, "source = 'src9'"), TARGET, lib.as_of))


@query("mb3_remove_from", settled("v_m3", "v_dropped"), VIEWS)
def remove_from(lib):
    return _rows(op.remove_items_from(lib.memberships, lib.collections, _chosen(lib, "n_chars > 2100"), EXTRA, lib.as_of))


@query("mb4_delete_collection", appended("v_m4_rest", "v_m4_pair"), VIEWS)
def delete(lib):
    return _rows(op.delete_collection(lib.memberships, lib.collections, EXTRA, lib.as_of)[1])


@query("mb4_delete_with_items", f"""select item_id, collection_id, source, confidence, position from v_membership
  where item_id not in (select item_id from v_membership where collection_id = {EXTRA})""", VIEWS)
def delete_with_items(lib):
    groups = lib.dup_members.withColumn("keep_id", F.lit(None).cast("bigint"))
    return _rows(op.delete_collection_and_items(lib.prose, lib.memberships, groups, search.build_postings(lib.prose), lib.collections, EXTRA)["memberships"])


@query("mb4_delete_review", "select item_id, collection_id, source, confidence, position from v_membership", VIEWS)
def delete_review(lib):
    return _rows(op.delete_collection(lib.memberships, lib.collections, 0, lib.as_of)[1])


@query("mb6_remove_items", """select group_id, item_id, case when keep_id in (select item_id from v_toxic)
    then first_value(item_id) over (partition by group_id order by position) else keep_id end as keep_id
  from (select *, count(*) over (partition by group_id) as n from v_keep where item_id not in (select item_id from v_toxic)) where n >= 2""", VIEWS)
def remove(lib):
    first = lib.dup_members.groupBy("group_id").agg(F.min_by("item_id", "position").alias("keep_id"))
    groups = lib.dup_members.join(first, "group_id")
    gone = lib.table("labels").filter("toxic = 1").select(F.col("doc_id").alias("item_id"))
    parts = op.remove_items(lib.prose, lib.memberships, groups, search.build_postings(lib.prose), gone)
    return parts["dup_members"].select("group_id", "item_id", "keep_id")


@query("mb6_remove_memberships", "select item_id, collection_id, source, confidence, position from v_membership where item_id not in (select item_id from v_toxic)", VIEWS)
def remove_memberships(lib):
    gone = lib.table("labels").filter("toxic = 1").select(F.col("doc_id").alias("item_id"))
    groups = lib.dup_members.withColumn("keep_id", F.lit(None).cast("bigint"))
    return _rows(op.remove_items(lib.prose, lib.memberships, groups, search.build_postings(lib.prose), gone)["memberships"])


@query("mb7_lock", """select item_id, organize_locked or event_type = 'purchase' as organize_locked,
  case when event_type = 'purchase' then 'locked' else organize_status end as organize_status
  from v_stage join events on event_id = item_id""")
def lock(lib):
    chosen = lib.table("events").filter("event_type = 'purchase'").select(F.col("event_id").alias("item_id"))
    return op.lock_items(lib.stages, chosen).select("item_id", "organize_locked", "organize_status")


def _organize(lib):
    return lib.prose.withColumns({
        "organize_locked": F.endswith("collection_key", F.lit(" src4")), "organize_status": F.lit("pending"),
        "resolver_version": F.lit(None).cast("int")})


def _decisions(lib):
    n = F.col("n_chars")
    return lib.table("documents").select(
        F.col("doc_id").alias("item_id"),
        F.when(n < 600, "needsReview").when(F.col("lang").isin("en", "de"), "reuse").otherwise("create").alias("decision"),
        F.when(n >= 600, F.lit(TARGET).cast("bigint")).alias("collection_id"), F.round(n / F.lit(40000.0), 6).alias("confidence"))


@query("mb8_attach_decisions", settled("v_m8", "v_reviewed"), VIEWS)
def attach(lib):
    return _rows(op.attach_decisions(_organize(lib), lib.memberships, lib.collections, _decisions(lib), lib.as_of)[1])


@query("mb8_item_status", """select item_id, case when outcome in ('locked', 'keep') then 'locked' else 'ready' end as organize_status,
  organize_locked or outcome = 'keep' as organize_locked, case when outcome <> 'locked' then 2 end as resolver_version
  from v_organize join v_applied using (item_id)""", VIEWS)
def attach_status(lib):
    return op.attach_decisions(_organize(lib), lib.memberships, lib.collections, _decisions(lib), lib.as_of)[0].select(
        "item_id", "organize_status", "organize_locked", "resolver_version")


def _plain(lib):
    short = F.regexp_replace("title", "^[a-z]+ ", "")
    return lib.cells.withColumn("title", F.when(F.col("collection_id") < 1_000_000_000, short).otherwise(F.col("title")))


def _merge(lib):
    runs = lib.runs.withColumn("decision_collection_id", 1 + (F.col("item_id") % 20) * 1000 + 117)
    return op.merge_equal_titles(_plain(lib), lib.memberships, lib.aliases, runs, lib.as_of)


@query("w5_title_survivors", "select collection_id, winner_id, normalized_title from v_survivor", VIEWS)
def survivors(lib):
    return op.title_survivors(_plain(lib), lib.memberships)


@query("mb9_merge_memberships", settled("v_m9", "v_affected"), VIEWS)
def merge(lib):
    return _rows(_merge(lib)["memberships"])


@query("mb9_merge_runs", """select run_id, coalesce(winner_id, wanted) as decision_collection_id
  from (select run_id, 1 + (item_id % 20) * 1000 + 117 as wanted from v_run) left join v_survivor on collection_id = wanted""", VIEWS)
def merge_runs(lib):
    return _merge(lib)["runs"].select("run_id", "decision_collection_id")


@query("mb9_merge_aliases", """select collection_id, normalized_alias from (
    select coalesce(winner_id, a.collection_id) as collection_id, a.normalized_alias, bool_and(coalesce(a.collection_id <> winner_id, false)) as came,
      any_value(normalized_title) as own from v_alias a left join v_survivor s using (collection_id) group by 1, 2)
  where not (came and normalized_alias = own)""", VIEWS)
def merge_aliases(lib):
    return _merge(lib)["aliases"].select("collection_id", "normalized_alias")


def _titles(lib):
    asked = lib.table("events").select(F.col("event_id").alias("request_id"), F.concat_ws(" ", "event_type", "user_id").alias("title"))
    return asked.unionByName(lib.table("documents").select(
        (F.lit(1_000_000_000_000) + F.col("doc_id")).alias("request_id"), F.concat_ws("  ", "lang", "source").alias("title")))


_NORMAL = {**VIEWS, "v_wanted": f"select request_id, trim(title) as title, {duck.normalize_title('title')} as norm from v_title",
           "v_have": f"""select {duck.normalize_title('title')} as norm, first(collection_id order by created_at, collection_id) as id
             from v_cell where kind <> 'unassigned' group by 1"""}


@query("mb10_find_or_create", """select request_id, coalesce(id::varchar, sha256(norm)) as collection_id, id is null as created
  from v_wanted left join v_have using (norm)""", _NORMAL)
def create(lib):
    return op.find_or_create(lib.cells, _titles(lib), lib.as_of)[0]


@query("rs12_new_collections", """select sha256(norm) as collection_id, norm as normalized_title, title, 'aiContext' as kind,
    (select max(sort_order) from v_cell) + row_number() over (order by request_id, norm) as sort_order
  from (select norm, min(request_id) as request_id, first(title order by request_id) as title from v_wanted
        where norm not in (select norm from v_have) group by norm)""", _NORMAL)
def new_collections(lib):
    made = op.find_or_create(lib.cells, _titles(lib), lib.as_of, kind="aiContext", created_by="ai")[1]
    return made.select("collection_id", "normalized_title", "title", "kind", "sort_order")


_RENAME = {**VIEWS, "v_new": f"select collection_id, case when is_archived then trim(regexp_replace(title, '^[a-z]+ ', '')) else title || ' kept' end as new_title, kind from v_cell where collection_id < 1000000000"}


@query("mb10_rename", f"""select collection_id, new_title, case when kind = 'unassigned' then 'review cannot be renamed' else 'title exists' end as error
  from (select *, min(collection_id) over (partition by {duck.normalize_title('new_title')}) as first from v_new)
  where kind = 'unassigned' or first <> collection_id""", _RENAME)
def rename(lib):
    short = F.trim(F.regexp_replace("title", "^[a-z]+ ", ""))
    asked = lib.cells.filter("collection_id < 1000000000").select(
        "collection_id", F.when(F.col("is_archived"), short).otherwise(F.concat("title", F.lit(" kept"))).alias("new_title"))
    return op.rename_collections(lib.cells, asked)[1]


@query("mb12_remap_ids", """select item_id, case when item_id in (select doc_id from labels) then 'new-' || item_id else external_id end as external_id
  from v_prose""")
def remap(lib):
    mapping = lib.table("labels").select(
        F.concat(F.lit("asset-"), F.col("doc_id").cast("string")).alias("previous"), F.concat(F.lit("new-"), F.col("doc_id").cast("string")).alias("next"))
    return op.remap_external_ids(lib.prose, mapping).select("item_id", "external_id")


@query("w6_dense_order", """select collection_id, row_number() over (order by lower(title), collection_id) - 1 as sort_order
  from v_cell where kind <> 'unassigned' union all select collection_id, sort_order from v_cell where kind = 'unassigned'""")
def dense(lib):
    return op.dense_sort_order(lib.cells).select("collection_id", "sort_order")


@query("w6_reorder", f"""select collection_id, case collection_id when {TARGET} then 0 when {EXTRA} then 1 else sort_order end as sort_order from v_cell""")
def reorder(lib):
    return op.reorder_collections(lib.cells, [TARGET, EXTRA]).select("collection_id", "sort_order")


_PROFILE = {
    "v_newest": """select * from (select m.collection_id, i.item_id, i.ocr_text, row_number() over (partition by m.collection_id
        order by i.created_at desc nulls last, i.item_id desc) as r from v_membership m join v_prose i using (item_id)) where r <= 12""",
    "v_term": f"""select collection_id, term, count(*) as n from (select collection_id, unnest({duck.words(f"lower({duck.clean('ocr_text')})")}) as term
        from v_newest) where length(term) >= 4 group by 1, 2""",
    "v_profile": """select d.*, coalesce(key_terms, '') as key_terms, coalesce(key_entities, '') as key_entities from (
        select collection_id, min(i.created_at) as date_range_start, max(i.created_at) as date_range_end
        from v_membership m join v_prose i using (item_id) group by 1) d
      left join (select collection_id, string_agg(term, ',' order by r) as key_terms, string_agg(term, ',' order by r) filter (r <= 8) as key_entities
        from (select *, row_number() over (partition by collection_id order by n desc, term) as r from v_term) where r <= 12 group by 1) using (collection_id)""",
}


@query("ag7_profile_terms", "select * from v_profile", _PROFILE)
def profiles(lib):
    return op.collection_profiles(lib.prose, lib.memberships).select(
        "collection_id", "date_range_start", "date_range_end", F.array_join("key_terms", ",").alias("key_terms"),
        F.array_join("key_entities", ",").alias("key_entities"))


@query("mb11_refresh_profiles", """select collection_id, key_terms, case when collection_id < 5000 then 4 else 1 end as profile_version from v_profile""", _PROFILE)
def refresh(lib):
    computed = op.collection_profiles(lib.prose, lib.memberships)
    stored = computed.filter("collection_id < 5000").withColumn("profile_version", F.lit(3))
    return op.refresh_profiles(stored, computed).select(
        "collection_id", F.array_join("key_terms", ",").alias("key_terms"), "profile_version")


@query("pf7_eligible_collections", """select c.collection_id, title, (select string_agg(normalized_alias, ',' order by normalized_alias)
    from v_alias a where a.collection_id = c.collection_id) as aliases, coalesce(key_terms, '') as key_terms
  from v_cell c left join v_profile using (collection_id) where not is_archived and kind <> 'unassigned'""", _PROFILE)
def eligible(lib):
    rows = listing.eligible_collections(lib.cells, lib.aliases, op.collection_profiles(lib.prose, lib.memberships))
    return rows.filter("kind <> 'unassigned'").select(
        "collection_id", "title", F.array_join("aliases", ",").alias("aliases"), F.array_join("key_terms", ",").alias("key_terms"))


@query("rs13_learn_aliases", f"""select distinct collection_id, norm as normalized_alias from (
    select collection_id, title, proposed, {duck.normalize_title('proposed')} as norm, {duck.normalize_title('title')} as own from (
      select collection_id, title, title || 's' as proposed from v_collection union all
      select collection_id, title, upper(title) from v_collection union all
      select c.collection_id, title, alias_title from v_collection c join v_alias using (collection_id)))
  where norm <> '' and norm <> own and {duck.similarity('norm', 'own')} >= 0.9
    and (collection_id, norm) not in (select (collection_id, normalized_alias) from v_alias)""")
def learn(lib):
    c = lib.collections
    proposals = (
        c.select("collection_id", F.concat("title", F.lit("s")).alias("proposed_title"))
        .unionByName(c.select("collection_id", F.upper("title").alias("proposed_title")))
        .unionByName(lib.aliases.select("collection_id", F.col("alias_title").alias("proposed_title"))))
    return op.learn_aliases(c, lib.aliases, proposals, lib.as_of).select("collection_id", "normalized_alias")


_REQUEUE = {
    "v_org": """select *, collection_key like '% src4' as organize_locked, case when n_chars > 1200 then 'ready' else 'failed' end as organize_status,
        case when n_chars > 1600 then 2 when n_chars > 900 then 1 end as resolver_version, 'fp' as fingerprint
      from v_prose join (select doc_id as item_id, n_chars from documents) using (item_id)""",
    "v_due": """select item_id from v_org o where not is_removed and not organize_locked and access_state = 'available'
        and exists (select 1 from v_membership m where m.item_id = o.item_id)
        and (item_id in (select item_id from v_membership where collection_id = 0) or organize_status = 'failed'
             or resolver_version is null or resolver_version < 2)
        and not exists (select 1 from v_membership m where m.item_id = o.item_id and source = 'user' and collection_id <> 0)""",
}


@query("mb14_requeue_version", """select item_id, case when d then 'pending' else organize_status end as organize_status,
  case when not d then resolver_version end as resolver_version, case when not d then fingerprint end as fingerprint
  from (select *, item_id in (select item_id from v_due) as d from v_org)""", _REQUEUE)
def requeue(lib):
    n = F.col("n_chars")
    items = lib.prose.join(lib.table("documents").select(F.col("doc_id").alias("item_id"), "n_chars"), "item_id").withColumns({
        "organize_locked": F.endswith("collection_key", F.lit(" src4")), "organize_status": F.when(n > 1200, "ready").otherwise("failed"),
        "resolver_version": F.when(n > 1600, 2).when(n > 900, 1), "fingerprint": F.lit("fp")})
    return op.requeue_for_version(items, lib.memberships, lib.collections).select(
        "item_id", "organize_status", "resolver_version", "fingerprint")


@query("j7_no_user_membership", """select item_id from v_prose where item_id not in (
  select item_id from v_membership where source = 'user' and collection_id <> 0)""")
def no_user(lib):
    filed = lib.memberships.filter("source = 'user' and collection_id <> 0")
    return lib.prose.join(filed, "item_id", "left_anti").select("item_id")
