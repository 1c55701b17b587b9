"""Pair scores and groups over all bound items."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark import vocab
from shelfmark.operators import cluster as cl, labels as lb, pairs as op, profiles as pf, windows as wn
from shelfmark.functions import text as tx
from shelfmark.plans import duck
from shelfmark.plans.bind import RECEIPT_ID
from shelfmark.plans.enrich_queries import LABEL_VIEWS, SOURCE_VIEWS, label_candidates, source_rows
from shelfmark.plans.registry import query

BANDS = (1.3, 1.35, 1.4)   # the bound vectors lie further apart than feature prints


def cleaned(lib):
    """(item_id, pool_key, created_at, clean) of all items, written once: cleaning costs far more than reading."""
    return lib.shared("cleaned", lambda: lib.items.repartition("item_id").select(
        "item_id", "pool_key", "created_at", tx.clean_text(F.col("ocr_text")).alias("clean")))


def _texts(lib):
    return cleaned(lib).select("item_id", F.lower("clean").alias("low"))


def _live(lib):
    return lib.collections.filter("kind <> 'unassigned' and not is_archived")


def label_rows(lib):
    """(item_id, labels<identifier, confidence>) of the receipts."""
    return lb.filter_labels(label_candidates(lib)).select((F.lit(RECEIPT_ID) + F.col("item_id")).alias("item_id"), F.col("filtered").alias("labels"))


def _label_rows(lib):
    return label_rows(lib).select("item_id", F.col("labels.identifier").alias("labels"))


def members(lib):
    """Cleaned items with labels, facets, source, vector and profile titles, written once for all later steps."""
    labels, vectors = _label_rows(lib), lib.table("embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    # The joins below all use item_id; a fixed partition count also spreads the costly rules.
    parts = int(lib.spark.conf.get("spark.sql.shuffle.partitions"))
    texts = cleaned(lib)
    if wn.plain_ids(texts)[0]:   # ranks join here, where rows are dealt out by id already and before they grow
        texts = texts.join(op.pool_ranks(texts).select("item_id", "pool_rank"), "item_id")
    rows = texts.repartition(parts, "item_id").join(labels, "item_id", "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))
    sources = source_rows(lib).select("item_id", "facets", *[F.col(f"{c}.value").alias(c) for c in ("platform", "content_type", "family")])
    sourced = rows.join(sources, "item_id")
    flat = labels.select("item_id", F.explode("labels").alias("identifier"))
    profile = pf.profile_columns(_texts(lib), _live(lib), flat)
    return sourced.join(profile, "item_id", "left").join(vectors, "item_id", "left")


def features(lib):
    return lib.shared("features", lambda: op.member_features(lib.shared("members", lambda: members(lib))))


def pair_table(lib):
    """Never written where its windows are known, as each step works out what it needs; only a table without them is read again and again."""
    pairs = lib.lazy("scored", lambda: op.score_pairs(features(lib), bands=BANDS))
    return pairs if wn.of(pairs) else lib.shared("pairs", lambda: pairs)


def _grouped(lib, name, pairs, columns, **rules):
    if wn.of(pairs):
        return cl.cluster_items(features(lib), pairs, columns=columns, **rules)
    return lib.lazy(name, lambda: cl.cluster_items(features(lib), pairs, **rules)).select(*columns)


def groups(lib, *columns):
    return _grouped(lib, "groups", pair_table(lib), columns)


def _overlap(name):
    return f"list_has_any(a.{name}, b.{name})"


_ENTITY_NAMES = ("refs_0", "refs_1", "refs_2", "flights", "codes", "hosts", "alnum", "long_words")
_TRAVEL, _HOME = duck.listing(vocab.TRAVEL_FACETS), duck.listing(vocab.HOME_FACETS)

TITLE_VIEWS = {
    "v_clean": f"select item_id, pool_key, created_at, {duck.clean('ocr_text')} as clean from v_items",
    "v_live": "select * from v_collection where kind <> 'unassigned' and not is_archived",
    "v_piece": "select distinct item_id, unnest(string_split(lower(clean), ' ')) as piece from v_clean",
    "v_title_token": """select distinct title, tok as token from (select title, unnest(string_split(lower(title), ' ')) as tok from v_live) where length(tok) >= 3""",
    "v_share_token": f"""select collection_id, len(toks) as size, unnest(toks) as token from (
        select collection_id, list_filter({duck.words('lower(title)')}, lambda t: length(t) >= 3) as toks from v_live)""",
    "v_wanted_token": "select token from v_title_token union select token from v_share_token",
    "v_has_token": """select distinct item_id, token from v_piece join (select w.piece, t.token from (select distinct piece from v_piece) w
        join v_wanted_token t on contains(w.piece, t.token)) using (piece)""",
}

PAIR_VIEWS = {
    **SOURCE_VIEWS, **LABEL_VIEWS, **TITLE_VIEWS,
    "v_item_title": "select item_id, list_sort(list(distinct title)) as titles from v_has_token join v_title_token using (token) group by 1",
    "v_item_label": f"""select {RECEIPT_ID} + item_id as item_id, list(identifier) as labels from v_kept where reason = 'kept'
        and identifier not in {duck.inside(vocab.CLUSTER_LABEL_DENYLIST)} group by 1""",
    "v_feat0": "select item_id, pool_key, created_at, clean, " + ", ".join(f"{e} as {n}" for n, e in duck.entities("clean").items())
        + f", {duck.distinctive('clean')} as tokens, {duck.kept_words('clean')} as kw from v_clean",
    "v_feat": f"""select f.*, {duck.phrases_of('kw')} as phrases, coalesce(labels, []) as labels, s.facets, platform, content_type, family,
        coalesce(titles, []) as titles, embedding::double[] as vector,
        row_number() over (partition by pool_key order by created_at desc nulls last, f.item_id desc) as r
      from v_feat0 f join v_strong s using (item_id) join v_source using (item_id) left join v_item_label using (item_id)
      left join v_item_title using (item_id) left join embeddings on vec_id = f.item_id""",
    "v_near": """select a.item_id as seed_id, b.item_id as peer_id from (select *, (r - 1) // 40 as blk from v_feat) a
      join (select *, (r - 1) // 40 - unnest([0, 1]) as blk from v_feat) b on a.pool_key = b.pool_key and a.blk = b.blk
      where b.r > a.r and b.r < a.r + 40""",
    "v_fact": f"""select n.*, b.r as peer_rank, abs(epoch(a.created_at) - epoch(b.created_at)) / 3600.0 as hours,
        list_intersect(a.tokens, b.tokens) as shared, len(a.tokens) as ta, len(b.tokens) as tb,
        {_overlap('refs_0')}::int + {_overlap('refs_1')}::int + {_overlap('refs_2')}::int + {_overlap('flights')}::int + {_overlap('hosts')}::int
          + {_overlap('phrases')}::int + (len(list_intersect(a.codes, b.codes)) >= 2)::int as high,
        (len(list_intersect(a.codes, b.codes)) = 1)::int + len(list_intersect(a.alnum, b.alnum)) + {_overlap('long_words')}::int as medium,
        len(list_intersect(a.labels, b.labels)) as sl, len(list_distinct(list_concat(a.labels, b.labels))) as ul,
        len(list_intersect(a.facets, b.facets)) as sf, list_has_any(a.facets, {_TRAVEL}) and list_has_any(b.facets, {_TRAVEL}) as travel,
        list_has_any(a.facets, {_HOME}) and list_has_any(b.facets, {_HOME}) as home, list_distance(a.vector, b.vector) as d,
        a.platform = b.platform and a.platform <> 'unknown' as sp, a.content_type = b.content_type and a.content_type <> 'unknown' as st,
        a.family = b.family and a.family <> 'unknown' as sm, {_overlap('titles')} as titled,
        len(a.titles) > 0 and len(b.titles) > 0 as both_titled
      from v_near n join v_feat a on a.item_id = n.seed_id join v_feat b on b.item_id = n.peer_id""",
    "v_part": f"""select *, case when hours <= 2 then 0.10 when hours <= 12 then 0.06 when hours <= 48 then 0.03 when hours <= 168 then 0.01 else 0 end as p_time,
        0.24 * j as p_tokens, case when high > 0 then least(0.28, 0.16 * high + 0.08 * medium) when medium > 0 then least(0.14, 0.08 * medium) else 0 end as p_entities,
        least(0.10, 0.08 * sl / greatest(1, ul)) as p_vision, case when d <= {BANDS[0]} then 0.14 when d <= {BANDS[1]} then 0.08 when d <= {BANDS[2]} then 0.03 else 0 end as p_print,
        case when sf > 0 then least(0.14, 0.08 * sf) when travel then 0.14 when home then 0.12 else 0 end as p_facets,
        case when sp then 0.04 else 0 end as p_platform, case when st then 0.05 else 0 end as p_type, case when sm then 0.04 else 0 end as p_family,
        case when titled then 0.10 when both_titled then least(0.08, 0.7 * 0.08) else 0 end as p_profile,
        ((j >= 0.12 and n >= 2) or (n >= 1 and j >= 0.08 and len(list_filter(shared, lambda t: length(t) >= 6)) > 0)) or high > 0
          or (sf = 0 and (travel or home)) as contextual
      from (select *, len(shared) as n, case when ta > 0 and tb > 0 then len(shared)::double / (ta + tb - len(shared)) else 0 end as j from v_fact)""",
    "v_pair": """select *, round(least(1.0, p_time + p_tokens + p_entities + p_vision + p_print + p_facets + p_platform + p_type + p_family + p_profile)::double, 6) as total from v_part""",
    "v_admit": f"""select *, row_number() over (partition by seed_id order by total desc, peer_rank) as admit_order from (
        select *, row_number() over (partition by seed_id order by total desc, peer_rank) as o from v_pair) where o <= {vocab.RETRIEVAL_SIZE}
        and contextual and total >= {vocab.ADMIT_FLOOR}""",
    "v_grp": f"""select seed_id as group_id, peer_id as item_id from v_admit where admit_order < {vocab.GROUP_SIZE}
        union all select distinct seed_id, seed_id from v_admit""",
    "v_inside": """select x.group_id, p.* from v_pair p join v_grp x on x.item_id = p.seed_id join v_grp y on y.group_id = x.group_id and y.item_id = p.peer_id""",
}


@query("en7_profile_share", """select item_id, max(round(hits / size, 6)) as share from (
  select item_id, collection_id, size, count(*)::double as hits from v_has_token join v_share_token using (token) group by all) group by 1""", TITLE_VIEWS)
def profile_share(lib):
    return pf.profile_share(_texts(lib), _live(lib))


@query("en7_matching_titles", "select distinct item_id, title from v_has_token join v_title_token using (token)", TITLE_VIEWS)
def matching_titles(lib):
    return pf.matching_titles(_texts(lib), _live(lib))


_SUMS = {"time": "p_time", "ocr_tokens": "p_tokens", "ocr_entities": "p_entities", "vision": "p_vision", "feature_print": "p_print",
         "facets": "p_facets", "source_platform": "p_platform", "content_type": "p_type", "content_family": "p_family", "profile": "p_profile"}


@query("cp1_pair_scores", f"""select seed_id, count(*) as pairs, count(*) filter (contextual) as contextual, max(total) as best,
  sum(round(total * 1000000)::bigint)::bigint as total, {", ".join(f"sum(round(round({v}::double, 6) * 1000000)::bigint)::bigint as {k}" for k, v in _SUMS.items())} from v_pair group by 1""", PAIR_VIEWS)
def pair_scores(lib):
    return op.seed_sums(pair_table(lib)).select("seed_id", "pairs", "contextual", "best", "total", *_SUMS)


@query("j9_peer_pairs", "select seed_id, count(*) as peers, min(peer_id) as lowest, max(peer_id) as highest from v_near group by 1", PAIR_VIEWS)
def peer_pairs(lib):
    near = op.peer_pairs(lib.items.select("item_id", "pool_key", "created_at"))
    return near.groupBy(F.col("a.item_id").alias("seed_id")).agg(
        F.count(F.lit(1)).alias("peers"), F.min("b.item_id").alias("lowest"), F.max("b.item_id").alias("highest"))


@query("cp2_entity_tiers", "select seed_id, sum(high)::bigint as high, sum(medium)::bigint as medium from v_fact group by 1", PAIR_VIEWS)
def tiers(lib):
    return op.entity_tiers(features(lib)).groupBy("seed_id").agg(
        F.sum("high").alias("high"), F.sum("medium").alias("medium"))


@query("cp3_pair_channels", """select seed_id, count(*) as pairs, count(*) filter (st and sm) as typed from v_pair
  where (p_facets > 0)::int + st::int + sm::int >= 2 group by 1""", PAIR_VIEWS)
def channels(lib):
    found = op.pair_channels(features(lib), pair_table(lib))
    return found.groupBy("seed_id").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.size("channels") >= 2).alias("typed"))


@query("w3_top_peers", f"""select seed_id, peer_id, o as peer_order from (select *, row_number() over (partition by seed_id order by total desc, peer_rank) as o
  from v_pair) where o <= {vocab.RETRIEVAL_SIZE}""", PAIR_VIEWS)
def top_peers(lib):
    return op.top_peers(pair_table(lib), columns=("seed_id", "peer_id", "peer_order")).select("seed_id", "peer_id", F.col("peer_order").cast("bigint").alias("peer_order"))


@query("cg1_seed_expansion", f"select seed_id, peer_id, total, admit_order from v_admit where admit_order < {vocab.GROUP_SIZE}", PAIR_VIEWS)
def expansion(lib):
    return op.seed_expansion(pair_table(lib), columns=("seed_id", "peer_id", "total", "admit_order")).select("seed_id", "peer_id", "total", F.col("admit_order").cast("bigint").alias("admit_order"))


def _expanded(lib):
    """(group_id, item_id) of each seed and the peers that join it first; written only where pairs are joined with them."""
    members = lib.lazy("grown", lambda: op.expanded_groups(pair_table(lib)))
    return members if wn.of(pair_table(lib)) else lib.shared("expanded", lambda: members)


@query("ag10_group_cohesion", """select g.group_id, size, round(coalesce(s, 0), 6) as total,
    case when n = size * (size - 1) / 2 then low else 0 end as weakest_pair, coalesce(ctx, 0) as supported_edges
  from (select group_id, count(*) as size from v_grp group by 1) g
  left join (select group_id, sum(total) as s, min(total) as low, count(*) as n, count(*) filter (contextual) as ctx from v_inside group by 1) i using (group_id)""", PAIR_VIEWS)
def cohesion(lib):
    pairs = pair_table(lib)
    return op.group_stats(_expanded(lib), pairs).select(
        "group_id", "size", "total", "weakest_pair", "supported_edges")


@query("ag11_signal_breakdown", """select group_id, item_id, round(sum(p_time), 3) as time, round(sum(p_entities), 3) as ocr_entities from (
    select group_id, seed_id as item_id, * from v_inside union all select group_id, peer_id, * from v_inside) group by 1, 2""", PAIR_VIEWS)
def breakdown(lib):
    pairs = pair_table(lib)
    rows = op.signal_breakdown(_expanded(lib), pairs, limit=len(op.PARTS))
    value = lambda k: F.round(F.coalesce(F.col("signals")[k], F.lit(0.0)), 3).alias(k)
    return rows.select("group_id", "item_id", value("time"), value("ocr_entities"))


def _walk(start: str, eligible: str, hit: str, size: int) -> str:
    """Visit the near peers of each seed in order; ``got`` are those inside, ``vain`` those tried for nothing."""
    tried = f"len(got) between 1 and {size - 2} and not list_contains(got, c.o) and {eligible}"
    return f"""with recursive step(seed_id, turn, got, vain) as (
        select seed_id, 0::bigint, {start}, []::bigint[] from v_base union all
        select s.seed_id, s.turn + 1, case when {tried} and {hit} then list_append(got, c.o) else got end,
          case when {tried} and not ({hit}) then list_append(vain, c.o) else vain end
        from step s join v_cand c on c.seed_id = s.seed_id and c.o = s.turn + 1)
      select seed_id, arg_max(got, turn) as got, arg_max(vain, turn) as vain from step group by 1"""


def _mean_of(column: str) -> str:
    total = f"sum(round({column} * 1e6)::bigint)::bigint"
    return f"(((2 * {total} + count(*)) // (2 * count(*))) / 1e6)::double"


def group_views(sparse: str = "length(trim(f.clean)) < 12", floor: float = vocab.OUTLIER_FLOOR, size: int = vocab.GROUP_SIZE) -> dict[str, str]:
    """The grouping rules in SQL; ``sparse`` and ``floor`` as bound by the query."""
    link = "list_has_any(c.others, got)"
    return {
        **PAIR_VIEWS,
        "v_seen": f"""select p.*, {sparse} as sparse, row_number() over (partition by p.seed_id order by p.total desc, p.peer_rank) as o
          from v_pair p join v_feat f on f.item_id = p.peer_id""",
        "v_both": "select seed_id as x, peer_id as y, total, contextual from v_pair union all select peer_id, seed_id, total, contextual from v_pair",
        "v_link": f"""select a.seed_id, a.o, list(b.o order by t.total desc, b.o) as others from v_seen a
          join v_both t on t.x = a.peer_id and t.contextual and t.total >= {vocab.BRIDGE_PEER_FLOOR}
          join v_seen b on b.seed_id = a.seed_id and b.peer_id = t.y group by 1, 2""",
        "v_cand": f"select s.*, coalesce(others, []::bigint[]) as others from v_seen s left join v_link using (seed_id, o) where o <= {vocab.RETRIEVAL_SIZE}",
        "v_found": f"""select seed_id, list(o order by o)[1:{size - 1}] as got from v_cand
          where contextual and total >= {vocab.ADMIT_FLOOR} group by 1""",
        "v_base": "select f.item_id as seed_id, coalesce(got, []::bigint[]) as founders from v_feat f left join v_found on seed_id = f.item_id",
        "v_bridge": _walk("founders", f"c.total >= {vocab.BRIDGE_SEED_FLOOR}", link, size),
        "v_attach": _walk("(select b.got from v_bridge b where b.seed_id = v_base.seed_id)", "c.sparse and round(c.p_print::double, 6) >= 0.12",
                          f"(c.total >= {vocab.BRIDGE_SEED_FLOOR} and (c.contextual or {link}))", size),
        "v_member": """select seed_id, pos, o, case when pos <= len(founders) then 'seed_expand' when pos <= len(b.got) then 'bridge_admit' else 'fp_attach' end as reason
          from (select seed_id, unnest(got) as o, generate_subscripts(got, 1) as pos from v_attach) join v_base using (seed_id) join v_bridge b using (seed_id)""",
        "v_admitted": "select m.seed_id, m.pos, m.o, m.reason, s.peer_id as item_id, s.total from v_member m join v_seen s using (seed_id, o)",
        "v_side": "select seed_id, 0 as pos, seed_id as item_id from v_base union all select seed_id, pos, item_id from v_admitted",
        "v_inner": """select a.seed_id, a.item_id as a, b.item_id as b, a.pos as pa, b.pos as pb, t.total, t.contextual from v_side a
          join v_side b on b.seed_id = a.seed_id and a.pos < b.pos join v_both t on t.x = a.item_id and t.y = b.item_id""",
        "v_ends": "select seed_id, a as item_id, total, a as one, b as two from v_inner union all select seed_id, b, total, a, b from v_inner",
        "v_mean": f"select seed_id, item_id, {_mean_of('total')} as support, sum(round(total * 1e6)::bigint) as micros, count(*) as n from v_ends group by 1, 2",
        "v_pruned": f"select * from v_mean where item_id <> seed_id and micros < {round(floor * 1e6)} * n",
        "v_left": "select s.* from v_side s anti join v_pruned p on p.seed_id = s.seed_id and p.item_id = s.item_id",
        "v_edge": "select e.* from v_inner e semi join v_left x on x.seed_id = e.seed_id and x.item_id = e.a semi join v_left y on y.seed_id = e.seed_id and y.item_id = e.b",
        "v_state": """select seed_id, coalesce(peers, 0) as peers, coalesce(out, 0) as out, size, coalesce(ctx, 0) as ctx,
            case when peers is null then 'no_peers_in_pool' when size = 1 and out > 0 then 'collapsed_after_prune' when size = 1 then 'peers_scored_none_admitted'
              when coalesce(ctx, 0) = 0 then 'no_contextual_edge_collapsed' end as single
          from (select seed_id, count(*) as size from v_left group by 1)
          left join (select seed_id, count(*) as peers from v_seen group by 1) using (seed_id)
          left join (select seed_id, count(*) as out from v_pruned group by 1) using (seed_id)
          left join (select seed_id, count(*) filter (contextual) as ctx from v_edge group by 1) using (seed_id)""",
        "v_final": "select l.* from v_left l join v_state using (seed_id) where single is null or pos = 0",
        "v_fedge": "select e.* from v_edge e join v_state using (seed_id) where single is null",
        "v_support": f"""select f.seed_id, f.item_id, coalesce(s, 1.0)::double as support from v_final f left join (select seed_id, item_id, {_mean_of('total')} as s from (
            select seed_id, a as item_id, total from v_fedge union all select seed_id, b, total from v_fedge) group by 1, 2) using (seed_id, item_id)""",
        "v_record": f"""select st.seed_id, array_to_string(ids, ',') as members,
            case when single is null then 'c_' || array_to_string(list_sort(ids)[1:3], '_') else 'singleton_' || st.seed_id end as cluster_id, single as singleton_reason,
            array_to_string(list_sort(list_filter([case when bridges > 0 then 'bridge_admit' end, case when prints > 0 then 'fp_attach' end,
              case when out > 0 then 'pruned_outlier' end, case when single = 'no_contextual_edge_collapsed' then single end,
              case when single is not null then 'singleton' end, 'precision_first', 'strategy_d_seed_expand_bridge_validate'], lambda x: x is not null)), ',') as flags,
            peers::int as input_peers, coalesce(mean, 1)::double as mean_cohesion, weak as weakest_member, round(coalesce(low, 1), 6) as weakest_pair,
            coalesce(edges, 0)::int as supported_edges
          from v_state st join (select seed_id, list(item_id::varchar order by pos) as ids from v_final group by 1) using (seed_id)
          join (select seed_id, min(support) as weak from v_support group by 1) using (seed_id)
          left join (select seed_id, {_mean_of('total')} as mean, min(total) as low, count(*) filter (contextual) as edges from v_fedge group by 1) using (seed_id)
          left join (select seed_id, count(*) filter (reason = 'bridge_admit') as bridges, count(*) filter (reason = 'fp_attach') as prints from v_admitted group by 1) using (seed_id)""",
        "v_out": """select s.seed_id, s.peer_id as item_id, s.total, s.contextual, s.o, row_number() over (partition by s.seed_id order by s.o) as n,
            case when p.item_id is not null then 'pruned_outlier' when s.o > 24 then 'outside_retrieval_pool' when s.contextual and s.total < 0.32 then 'below_admit_threshold'
              when list_contains(a.vain, s.o) then 'fp_attach_failed' when list_contains(b.vain, s.o) then 'bridge_failed' when s.contextual then 'below_admit_threshold'
              when s.st then 'type_alone_insufficient' when s.sp then 'source_alone_insufficient' when s.sm then 'family_alone_insufficient'
              else 'no_contextual_support' end as reason
          from v_seen s join v_attach a using (seed_id) join v_bridge b using (seed_id)
          left join v_pruned p on p.seed_id = s.seed_id and p.item_id = s.peer_id
          anti join v_left l on l.seed_id = s.seed_id and l.item_id = s.peer_id""",
    }


GROUP_VIEWS = group_views()
# Every third item counts as sparse, groups are larger and the floor is high, so that all branches of the rules are met.
TRIED = {"sparse": "p.peer_id % 3 = 0", "floor": 0.36, "size": 16}
TRIED_VIEWS = group_views(**TRIED)


def tried_groups(lib, *columns):
    return _grouped(lib, "tried_groups", op.sparse_where(pair_table(lib), lambda i: i % 3 == 0), columns, size=TRIED["size"], outlier_floor=TRIED["floor"])


GROUP_COLUMNS = ("seed_id", "member_ids", "cluster_id", "singleton_reason", "flags", "input_peers", "mean_cohesion", "weakest_member", "weakest_pair", "supported_edges")


def _group_columns(rows):
    return rows.select(
        "seed_id", F.array_join(F.transform("member_ids", lambda m: m.cast("string")), ",").alias("members"), "cluster_id", "singleton_reason",
        F.array_join("flags", ",").alias("flags"), "input_peers", "mean_cohesion", "weakest_member", "weakest_pair", "supported_edges")


@query("cg2_groups", "select * from v_record", GROUP_VIEWS)
def cluster_groups(lib):
    return _group_columns(groups(lib, *GROUP_COLUMNS))


@query("cg2_groups_strict", "select * from v_record", TRIED_VIEWS)
def strict_groups(lib):
    return _group_columns(tried_groups(lib, *GROUP_COLUMNS))


@query("cg4_member_support", """select seed_id, item_id, support, false as pruned from v_support union all
  select seed_id, item_id, support, true from v_pruned""", TRIED_VIEWS)
def support(lib):
    # There is always a member.  The outer form keeps Catalyst from adding a size test that would evaluate the rules twice.
    return tried_groups(lib, "seed_id", "support").select("seed_id", F.explode_outer("support").alias("s")).select("seed_id", "s.item_id", "s.support", "s.pruned")


@query("cg7_admission_audit", """select seed_id, seed_id as item_id, 'admitted' as side, 'seed' as reason, 1.0::double as total, true as ok from v_base union all
  select a.seed_id, a.item_id, 'admitted', reason, total, p.item_id is null from v_admitted a left join v_pruned p on p.seed_id = a.seed_id and p.item_id = a.item_id union all
  select seed_id, item_id, 'rejected', reason, total, contextual from v_out where n <= 5""", TRIED_VIEWS)
def audit(lib):
    # One list of both, so that the groups are worked out once and not written.  There is always the seed.
    kind = "array<struct<item_id: bigint, side: string, reason: string, total: double, ok: boolean>>"
    one = lambda name, side, ok: F.transform(name, lambda x: F.struct(x["item_id"].alias("item_id"), F.lit(side).alias("side"), x["reason"].alias("reason"), x["total"].alias("total"), x[ok].alias("ok"))).cast(kind)
    rows = tried_groups(lib, "seed_id", "audits", "rejected")
    both = F.concat(one("audits", "admitted", "passed"), one("rejected", "rejected", "contextual"))
    return rows.select("seed_id", F.explode_outer(both).alias("x")).select("seed_id", "x.item_id", "x.side", "x.reason", "x.total", "x.ok")


@query("cg8_batch_plan", """select seed_id, len(string_split(members, ','))::int as size, array_to_string(list_sort(string_split(members, ',')), ',') as signature
  from v_record""", GROUP_VIEWS)
def batches(lib):
    return cl.batch_plan(groups(lib, "seed_id", "member_ids")).select("seed_id", F.size("batch_ids").alias("size"), "signature")


@query("cg3_sparse_attach", "select seed_id, item_id, total from v_admitted where reason = 'fp_attach'", TRIED_VIEWS)
def sparse_attach(lib):
    rows = tried_groups(lib, "seed_id", "audits").select("seed_id", F.explode_outer("audits").alias("x")).filter("x.reason = 'fp_attach'")
    return rows.select("seed_id", "x.item_id", "x.total")


@query("cg5_singleton_reasons", "select coalesce(single, 'group') as reason, count(*) as seeds from v_state group by 1", TRIED_VIEWS)
def singles(lib):
    return tried_groups(lib, "singleton_reason").groupBy(F.coalesce("singleton_reason", F.lit("group")).alias("reason")).agg(F.count(F.lit(1)).alias("seeds"))


_SIGNALS = {"ocr_entities": "p_entities", "ocr_tokens": "p_tokens", "time": "p_time", "facets": "p_facets", "profile": "p_profile"}


@query("cg6_result_record", f"""select r.seed_id, cluster_id, mean_cohesion, weakest_member, weakest_pair, supported_edges, {", ".join(f"coalesce({k}, false) as {k}" for k in _SIGNALS)}
  from v_record r left join (select m.seed_id, {", ".join(f"sum({v}) > 0 as {k}" for k, v in _SIGNALS.items())} from v_admitted m join v_seen s using (seed_id, o)
    join v_state st on st.seed_id = m.seed_id where single is null and m.reason = 'seed_expand' group by 1) x using (seed_id)
  where flags not like '%bridge_admit%' and flags not like '%fp_attach%'""", GROUP_VIEWS)
def record(lib):
    signals = op.parts_map(F.col("breakdown"))
    columns = ("seed_id", "cluster_id", "mean_cohesion", "weakest_member", "weakest_pair", "supported_edges", "breakdown", "flags")
    # Rules in expressions are written before they are filtered, as the filter would work them out again.
    rows = groups(lib, *columns) if wn.of(pair_table(lib)) else lib.shared("records", lambda: groups(lib, *columns))
    plain = rows.filter(~F.array_contains("flags", "bridge_admit") & ~F.array_contains("flags", "fp_attach"))
    return plain.select("seed_id", "cluster_id", "mean_cohesion", "weakest_member", "weakest_pair", "supported_edges",
                        *[F.array_contains(F.map_keys(signals), k).alias(k) for k in _SIGNALS])
