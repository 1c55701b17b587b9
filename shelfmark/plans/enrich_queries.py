"""Labels, facets and source evidence over all bound items."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark import vocab
from shelfmark.operators import facets as fc, labels as lb, source as so
from shelfmark.functions import text as tx
from shelfmark.plans import duck
from shelfmark.plans.registry import query

C = vocab.FACET_CUES

# ---- labels ----------------------------------------------------------------------------------------

LABEL_WORDS = {"ring": "sofa", "widget": "furniture", "gear": "indoor", "bolt": "text"}

LABEL_VIEWS = {
    "v_candidate": """select l_orderkey as item_id, l_linenumber as line,
        case string_split(p_name, ' ')[2] when 'ring' then 'Sofa ' when 'widget' then ' furniture' when 'gear' then 'indoor' when 'bolt' then 'text'
             else string_split(p_name, ' ')[2] end as identifier,
        cast(l_quantity / 50.0 as float) as confidence, l_returnflag = 'N' as precision_ok
      from lineitem join part on l_partkey = p_partkey""",
    "v_ordered": """select item_id, lower(trim(identifier)) as identifier, confidence, precision_ok,
        row_number() over (partition by item_id order by confidence desc, lower(trim(identifier)), line) as pos from v_candidate""",
    "v_judged": f"""select *, case when identifier = '' then 'empty' when identifier in {duck.inside(vocab.LOW_INFORMATION_LABELS)} then 'low_information'
        when not (precision_ok or confidence >= cast(0.28 as float) + cast(0.12 as float)) then 'precision_gate'
        when confidence < cast(0.28 as float) then 'below_confidence_floor' else 'pass' end as gate from v_ordered""",
    "v_kept": """select *, case when gate <> 'pass' then gate when pos > first_pos then 'duplicate' else 'kept' end as reason from (
        select *, min(pos) filter (gate = 'pass') over (partition by item_id, identifier) as first_pos from v_judged)""",
}


def label_candidates(lib):
    """Per order, the named kinds of its parts as labels, the share of quantity as confidence."""
    word = F.element_at(F.split("p_name", " "), 2)
    named = (F.when(word == "ring", "Sofa ").when(word == "widget", " furniture").when(word == "gear", "indoor")
             .when(word == "bolt", "text").otherwise(word))
    rows = lib.table("lineitem").join(lib.table("part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("item_id"), "l_linenumber", named.alias("identifier"),
        (F.col("l_quantity") / 50.0).cast("float").alias("confidence"), (F.col("l_returnflag") == "N").alias("precision_ok"))
    return rows.groupBy("item_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "identifier", "confidence", "precision_ok"))),
                    lambda x: F.struct(x["identifier"].alias("identifier"), x["confidence"].alias("confidence"), x["precision_ok"].alias("precision_ok"))).alias("candidates"))


@query("en1_label_filter", """select item_id,
    coalesce(string_agg(identifier, ',' order by pos) filter (reason = 'kept'), '') as filtered,
    coalesce(string_agg(identifier || ':' || reason, ',' order by identifier || ':' || reason) filter (reason <> 'kept'), '') as dropped,
    (select count(distinct identifier) from v_ordered o where o.item_id = k.item_id and identifier <> '') as raw_count
  from v_kept k group by item_id""", LABEL_VIEWS)
def label_filter(lib):
    out = lb.filter_labels(label_candidates(lib))
    return out.select("item_id", F.array_join("filtered.identifier", ",").alias("filtered"),
                      F.array_join(F.array_sort(F.transform("dropped", lambda d: F.concat_ws(":", d["identifier"], d["reason"]))), ",").alias("dropped"),
                      F.size("raw").cast("bigint").alias("raw_count"))


# ---- facets ----------------------------------------------------------------------------------------


def _any(name):
    return duck.any_of("low", C[name])


def _count(name):
    return duck.count_of("low", C[name])


def _word(word):
    return rf"regexp_matches(g, '\b{word}\b')"


_SHAPE = rf"""{{'low': lower(l),
  'clock': length(l) <= 16 and regexp_matches(l, '\b\d{{1,2}}[:.]\d{{2}}\b'), 'date': lower(l) in {duck.inside(vocab.DATE_HEADERS)},
  'size': length(l), 'letters': length(regexp_replace(l, '[^\p{{L}}\p{{M}}]', '', 'g')), 'spaced': regexp_matches(l, '\s'),
  'status': lower(l) in {duck.inside(vocab.CHAT_STATUS)}}}"""
_HEADER = "not s.clock and not s.date and not s.spaced and s.size between 3 and 22 and s.letters >= 3 and not s.status and s.letters / s.size >= 0.8"

FACET_VIEWS = {
    "v_text": f"""select item_id, ocr_text, lower(ocr_text) as low, {duck.guarded('lower(ocr_text)', 'Z')} as g, {duck.lines('ocr_text')} as ls,
        list_transform({duck.lines('ocr_text')}, lambda l: {duck.guarded('l', 'z')}) as gl from v_items""",
    "v_shaped": f"""select *, list_transform(ls, lambda l: {_SHAPE}) as sh from v_text""",
    "v_typed": f"""select *, list_transform(sh, lambda s: {{'low': s.low, 'clock': s.clock, 'date': s.date, 'size': s.size, 'header': {_HEADER},
        'message': s.size between 8 and 140 and not s.clock and not s.date and not ({_HEADER}) and not s.status,
        'body': s.size between 6 and 140 and not s.clock and not ({_HEADER})}}) as t from v_shaped""",
    "v_cue": rf"""select item_id, regexp_replace(low, '^\s+|\s+$', '', 'g') = '' as blank,
        len(list_filter(list_distinct(flatten(list_transform(gl, lambda x: regexp_extract_all(x, '\b[A-Z]{{3}}\b')))),
            lambda c: c not in {duck.inside(vocab.FACET_CODE_DENYLIST)})) as codes,
        {_any('route_marks')} as route,
        len(regexp_extract_all(g, '{vocab.FLIGHT_WORD_PATTERN}')) + len(list_filter(regexp_extract_all(g, '{vocab.DESIGNATOR_PATTERN}'),
            lambda x: x[1:2] not in {duck.inside(vocab.FACET_DESIGNATOR_BLOCK)})) as flights,
        {_count('flight_phrases')} as hardp, {duck.count_words('g', C['flight_words'])} as hardw, {_word('flight')} as flightw,
        {_word('gate')} or {_any('boarding_marks')} as boardm, {_any('booking_marks')} as bookm,
        {duck.count_words('g', C['lodging_words'])} as lodging, {_any('check_in')} as cin, {_any('check_out')} as cout,
        {_word('arrival')} or {_any('arrives')} as arr, {_word('departure')} or {_any('departs')} as dep,
        {_count('stay_confirmations')} as conf, {_count('stay_brands')} as brands, {_count('chat_apps')} as apps,
        {_count('finance')} as fin, {_count('currency')} as cur, {_word('total')} as tot, {_count('navigation')} as nav,
        {_any('distance')} as dist, {_count('commerce')} as com, contains(low, 'ikea') as ikea,
        {_count('design')} + cast({_word('frame')} as int) as design, {_count('dining')} as dining, {_any('booking_soft')} as soft,
        {_count('social_platforms')} as plat, {_count('engagement')} as eng, {_any('byline')} as byline, {_any('article_urls')} as urls,
        len(list_filter(t, lambda s: s.header)) as headers, len(list_distinct(list_transform(list_filter(t, lambda s: s.header), lambda s: s.low))) as dheaders,
        len(list_filter(t, lambda s: s.date)) as dates, len(list_filter(t, lambda s: s.size <= 24)) as tiny,
        len(list_filter(t, lambda s: s.size > 100)) as longl, len(list_filter(t, lambda s: s.message)) as msgs,
        len(list_filter(range(1, len(t)), lambda i: (t[i].clock and t[i+1].message) or (t[i].message and t[i+1].clock))) as pairs,
        len(list_filter(range(1, len(t)), lambda i: t[i].header and t[i+1].body)) as cards,
        len(list_filter(t, lambda s: s.low in {duck.inside(vocab.CHAT_STATUS)} or starts_with(s.low, 'delivered') or starts_with(s.low, 'read by')
            or contains(s.low, 'typing…') or contains(s.low, 'typing...'))) > 0 as delivered,
        len(list_filter(ls, lambda x: regexp_matches(x, '{vocab.SENDER_PATTERN}'))) as senders,
        len(list_filter(ls, lambda x: regexp_matches(x, '{vocab.AMOUNT_PATTERN}'))) as amounts from v_typed""",
    "v_flight": """select *, (a::int + b::int + (flights > 0)::int) as ffam, a or codes = 1 or flights > 0 as fs_e, b as fs_p,
        (not b and hard = 1) or (flightw and not a and not b and flights = 0) as fs_k,
        case when codes >= 2 then 0.30 when a then 0.18 when codes = 1 then 0.08 else 0 end
        + case when b then least(0.40, 0.12 * hard + 0.10 * hardp) when hard = 1 then 0.10 else 0 end
        + case when flights > 0 then least(0.22, 0.14 * flights) else 0 end
        + case when flightw and not a and not b and flights = 0 then 0.06 else 0 end as trip
      from (select *, codes >= 2 or (route and codes >= 1) as a, hardp + hardw >= 2 or hardp >= 1 as b, hardp + hardw as hard from v_cue)""",
    "v_scored1": """select *, round(case when ffam < 2 then least(x1, 0.67) else x1 end, 6) as s_board, round(case when ffam < 2 then least(x2, 0.67) else x2 end, 6) as s_book
      from (select *, case when boardm then least(0.98, trip + 0.05) else trip end as x1, case when bookm then least(0.98, trip + 0.05) else trip end as x2,
        (cin and cout) or (arr and dep) as stay from v_flight)""",
    "v_scored2": """select *, (ffam >= 2 and (s_board >= 0.72 or s_book >= 0.72)) as fstrong, (s_board >= 0.72 or s_book >= 0.72) as fhigh,
        conf > 0 and (lodging > 0 or stay) as confd, (fin > 0)::int + (cur > 0)::int + (amounts >= 2)::int as rfam,
        (cards >= 3 and cards >= pairs) or (headers >= 4 and dheaders >= 3 and pairs < 3) or (headers >= 3 and dates >= 1 and pairs < 3)
          or (tiny >= 8 and msgs < 3 and headers >= 3) as feed,
        (apps > 0)::int + delivered::int + (pairs >= 3)::int + (msgs >= 3 and pairs >= 2)::int + (senders >= 2)::int as cfam from v_scored1""",
    "v_scored3": """select *, case when fhigh or (cin and lodging = 0 and brands = 0 and not cout and not arr and not dep) then 0 else hfam0 end as hfam,
        case when fhigh or (cin and lodging = 0 and brands = 0 and not cout and not arr and not dep) then 0 when hfam0 < 2 then least(h, 0.67) else h end as s_hotel
      from (select *, (lodging > 0)::int + stay::int + confd::int + (brands > 0)::int as hfam0,
        case when lodging > 0 then least(0.42, 0.12 * lodging) else 0 end + case when stay then 0.34 when cin and lodging > 0 then 0.08 else 0 end
        + case when confd then least(0.30, 0.18 * conf) else 0 end + case when brands > 0 then least(0.28, 0.16 * brands) else 0 end as h from v_scored2)""",
    "v_scored4": """select *, case when plat = 0 then 0 when plat > 0 and eng > 0 then greatest(soc, 0.77) else least(soc, 0.67) end as s_social,
        (plat > 0 and eng > 0)::int + (plat > 0)::int as sfam, (longl >= 2)::int + byline::int + urls::int as afam
      from (select *, case when plat > 0 then least(0.48, 0.28 * plat) else 0 end + case when eng > 0 then least(0.36, 0.16 * eng) else 0 end as soc from v_scored3)""",
    "v_facet": """select item_id, 'boarding_pass' as id, s_board as s, ffam as f, concat_ws('+', case when fs_e then 'entity_pattern' end, case when fs_k then 'ocr_keyword' end, case when fs_p then 'ocr_phrase' end) as src from v_scored4
      union all select item_id, 'flight_booking', s_book, ffam, concat_ws('+', case when fs_e then 'entity_pattern' end, case when fs_k then 'ocr_keyword' end, case when fs_p then 'ocr_phrase' end) from v_scored4
      union all select item_id, 'hotel_booking', s_hotel, hfam, concat_ws('+', case when (not stay and cin and lodging > 0) or brands > 0 then 'ocr_keyword' end, case when lodging > 0 or confd then 'ocr_phrase' end, case when stay then 'ocr_structure' end) from v_scored4
      union all select item_id, 'chat', case when feed then 0 when cfam < 2 then least(x, 0.67) else x end, case when feed then 0 else cfam end,
        concat_ws('+', case when apps > 0 then 'ocr_keyword' end, case when delivered then 'ocr_phrase' end, case when pairs >= 2 or senders >= 2 then 'ocr_structure' end)
        from (select *, case when apps > 0 then least(0.22, 0.18 * apps) else 0 end + case when delivered then 0.34 else 0 end + case when pairs >= 3 then 0.40 when pairs = 2 then 0.18 else 0 end
          + case when msgs >= 3 and pairs >= 2 then 0.36 else 0 end + case when senders >= 2 then 0.22 else 0 end as x from v_scored4)
      union all select item_id, 'receipt', case when tot and fin = 0 and cur = 0 then 0 when rfam < 2 then least(x, 0.67) else x end, case when tot and fin = 0 and cur = 0 then 0 else rfam end,
        concat_ws('+', case when cur > 0 then 'entity_pattern' end, case when tot and (fin > 0 or cur > 0) then 'ocr_keyword' end, case when fin > 0 then 'ocr_phrase' end, case when amounts >= 2 then 'ocr_structure' end)
        from (select *, case when fin > 0 then least(0.45, 0.16 * fin) else 0 end + case when cur > 0 then least(0.25, 0.12 * cur) else 0 end
          + case when tot and (fin > 0 or cur > 0) then 0.18 else 0 end + case when amounts >= 2 then 0.18 else 0 end as x from v_scored4)
      union all select item_id, 'map', case when nav > 0 then least(0.50, 0.18 * nav) + case when dist then 0.12 else 0 end else 0 end, (nav > 0)::int,
        concat_ws('+', case when nav > 0 and dist then 'ocr_keyword' end, case when nav > 0 then 'ocr_phrase' end) from v_scored4
      union all select item_id, 'product_page', case when com > 0 then least(0.55, 0.22 * com) else 0 end + case when ikea then 0.18 else 0 end, (com > 0)::int + ikea::int,
        concat_ws('+', case when ikea then 'ocr_keyword' end, case when com > 0 then 'ocr_phrase' end) from v_scored4
      union all select item_id, 'design_reference', least(0.70, 0.28 * design), (design > 0)::int, case when design > 0 then 'ocr_keyword' else '' end from v_scored4
      union all select item_id, 'reservation', case when fstrong or (soft and dining = 0 and s_hotel >= 0.42) then 0 when dining > 0 then least(0.70, 0.30 * dining) when soft then 0.20 else 0 end,
        case when fstrong then 0 else (dining > 0 or soft)::int end, concat_ws('+', case when soft and dining = 0 then 'ocr_keyword' end, case when dining > 0 then 'ocr_phrase' end) from v_scored4
      union all select item_id, 'social_post', s_social, sfam, concat_ws('+', case when plat > 0 then 'ocr_keyword' end, case when eng > 0 then 'ocr_phrase' end) from v_scored4
      union all select item_id, 'article', case when s_social >= 0.72 then 0 when afam < 2 then least(y, 0.67) else y end, case when s_social >= 0.72 then 0 else afam end,
        concat_ws('+', case when urls then 'entity_pattern' end, case when byline then 'ocr_phrase' end, case when longl >= 2 then 'ocr_structure' end)
        from (select *, case when longl >= 2 then x else least(x, 0.47) end as y from (select *, case when longl >= 2 then 0.28 else 0 end + case when byline then 0.25 else 0 end
          + case when urls then 0.18 else 0 end as x from v_scored4))""",
    "v_evidence": """select e.* from (select item_id, id, src, round(case when s >= 0.72 and f < 2 then 0.71 else least(0.98, s) end, 6) as confidence,
          case when s >= 0.72 and f >= 2 then 'strong' else 'weak' end as strength
        from (select item_id, id, round(s::double, 6) as s, f, src from v_facet) where s >= 0.42) e
      join v_scored4 c using (item_id) where not blank and not (id = 'chat' and fstrong and not contains(src, 'ocr_phrase') and not contains(src, 'ocr_keyword'))""",
    "v_strong": """select item_id, coalesce(list_sort(list(id) filter (strength = 'strong')), []) as facets from v_items left join v_evidence using (item_id) group by 1""",
}


def facet_rows(lib):
    """(item_id, facet_evidence, facets) of all items, written once for the queries that start from them."""
    def build():
        # Dealt out evenly, as the rules cost far more than the shuffle; it also keeps Catalyst from planning them once for each kind of item.
        items = lib.items.select("item_id", "ocr_text").repartition("item_id")
        typed = fc.facet_evidence(items).select("item_id", "facet_evidence")
        return typed.withColumn("facets", fc.strong_facets(F.col("facet_evidence")))
    return lib.shared("facets", build)


@query("en2_facet_evidence", "select item_id, id, confidence, strength, src as sources from v_evidence", FACET_VIEWS)
def evidence(lib):
    # The outer form keeps Catalyst from adding a size test that would evaluate the rules twice.
    return facet_rows(lib).select("item_id", F.explode_outer("facet_evidence").alias("e")).filter("e.id is not null").select(
        "item_id", "e.id", "e.confidence", "e.strength", F.array_join("e.sources", "+").alias("sources"))


@query("en3_strong_facets", "select item_id, array_to_string(facets, ',') as facets from v_strong", FACET_VIEWS)
def strong(lib):
    return facet_rows(lib).select("item_id", F.array_join("facets", ",").alias("facets"))


@query("tx14_line_shapes", """select item_id, headers, dheaders, dates, tiny, longl, msgs, pairs, cards, delivered, senders, amounts from v_cue""", FACET_VIEWS)
def shapes(lib):
    names = {"headers": "headers", "dheaders": "distinct_headers", "dates": "dates", "tiny": "tiny", "longl": "long", "msgs": "messages",
             "pairs": "pairs", "cards": "cards", "senders": "senders", "amounts": "amounts"}
    typed = lib.items.select("item_id", "ocr_text").repartition("item_id").select("item_id", fc.line_cues(F.col("ocr_text")).alias("f"))
    return typed.select("item_id", *[F.col(f"f.{v}").cast("bigint").alias(k) for k, v in names.items()], "f.delivered").select(
        "item_id", "headers", "dheaders", "dates", "tiny", "longl", "msgs", "pairs", "cards", "senders", "amounts", "delivered")


# ---- source ----------------------------------------------------------------------------------------

_PLATFORM = "case " + " ".join(f"when {duck.any_of('low', n)} then '{p}'" for p, n in vocab.PLATFORM_CUES) + " else 'unknown' end"
_FACET_TYPE = " ".join(f"when list_contains(facets, '{f}') then '{f}|{g}|0.8'" for f, g in vocab.FACET_FAMILY)

SOURCE_VIEWS = {
    **FACET_VIEWS,
    "v_src": rf"""select item_id, low, ls, facets, {_PLATFORM} as plat, {duck.count_of('low', vocab.EMAIL_CUES)} >= 2
        or ({duck.count_of('low', vocab.EMAIL_CUES)} >= 1 and len(ls) >= 5) as email,
        {duck.count_of('low', vocab.IDENTITY_CUES)} >= 2 as ident, {duck.any_of('low', vocab.COMMERCE_CUES)} as com,
        {duck.any_of('low', vocab.UNLOCK_CUES)} as unlock, {duck.any_of('low', vocab.CENTER_CUES)} as center,
        contains(low, 'flashlight') and contains(low, 'camera') as torch,
        {duck.any_of('low', vocab.STACK_APPS)} and (len(list_filter(ls, lambda x: regexp_matches(x, '^\d{{1,2}}:\d{{2}}')
            or regexp_matches(x, '(?i)\d{{1,2}}:\d{{2}}\s?(am|pm)'))) >= 1
          or len(list_filter(ls, lambda x: length(x) between 4 and 48)) >= 4) as stack
      from v_text join v_strong using (item_id)""",
    "v_typ": f"""select *, string_split(case {_FACET_TYPE}
        when plat in ('instagram', 'linkedin', 'facebook') then 'social_post|social_media|0.7'
        when plat in ('whatsapp', 'imessage', 'messenger') then 'chat|messaging|0.75'
        when plat = 'gmail' or (plat = 'mail' and email) then 'email|email|0.7' when plat = 'maps' then 'map|navigation|0.75'
        when email then 'email|email|0.65' when ident then 'identity_document|identity_document|0.7'
        when com then 'product_page|commerce|0.6' else 'unknown|unknown|0.0' end, '|') as tf from v_src""",
    "v_surf": """select *, case when unlock then 'lock_screen|0.9' when center then 'notification_center|0.88'
        when torch and not list_contains(facets, 'chat') then 'lock_screen|0.72'
        when stack and not email and not list_has_any(facets, ['chat', 'social_post', 'map']) then 'lock_screen|0.62'
        when plat <> 'unknown' then 'app_screen|0.75' when tf[1] <> 'unknown' or len(facets) > 0 then 'app_screen|0.6'
        when len(ls) > 0 then 'app_screen|0.4' else 'unknown|0.0' end as sf from v_typ""",
    "v_source": f"""select item_id, case when locked and plat in {duck.inside(vocab.NOTIFIABLE)} then 'unknown' else plat end as platform,
        case when locked and tf[1] in {duck.inside(vocab.DEMOTED_TYPES)} then 'unknown' else tf[1] end as content_type,
        case when locked and tf[1] in {duck.inside(vocab.DEMOTED_TYPES)} then 'unknown' else tf[2] end as family,
        case when locked and tf[1] in {duck.inside(vocab.DEMOTED_TYPES)} then 0.0 else cast(tf[3] as double) end as type_confidence,
        string_split(sf, '|')[1] as surface, cast(string_split(sf, '|')[2] as double) as surface_confidence
      from (select *, sf like 'lock%' or sf like 'notif%' as locked from v_surf)""",
}


def source_rows(lib):
    return lib.shared("sources", lambda: so.source_evidence(
        lib.items.select("item_id", "ocr_text").repartition("item_id").join(facet_rows(lib).select("item_id", "facets"), "item_id")).select(
        "item_id", "facets", "platform", "content_type", "family", "surface"))


@query("en4_source_evidence", "select * from v_source", SOURCE_VIEWS)
def source(lib):
    return source_rows(lib).select(
        "item_id", F.col("platform.value").alias("platform"), F.col("content_type.value").alias("content_type"), F.col("family.value").alias("family"),
        F.col("content_type.confidence").alias("type_confidence"), F.col("surface.value").alias("surface"), F.col("surface.confidence").alias("surface_confidence"))


@query("en5_blended_confidence", """select item_id, round(coalesce(list_avg(list_filter([case when platform <> 'unknown' then 0.85 end,
    case when content_type <> 'unknown' then type_confidence end, case when family <> 'unknown' then type_confidence end,
    case when surface <> 'unknown' then surface_confidence end], lambda c: c is not null)), 0), 6) as confidence,
    case when content_type = family and content_type = 'email' then 'type(email),family(email)'
         when list_contains(facets, content_type) then 'facet(' || content_type || '),type(' || content_type || '),family(' || family || ')' else '' end as channels
  from v_source join v_strong using (item_id)""", SOURCE_VIEWS)
def blended(lib):
    rows = source_rows(lib)
    return rows.select(
        "item_id", so.blended_confidence(*[F.col(c) for c in ("platform", "content_type", "family", "surface")]).alias("confidence"),
        F.array_join(so.correlated_channels(F.col("facets"), F.col("content_type.value"), F.col("family.value")), ",").alias("channels"))
