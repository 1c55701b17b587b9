"""Rule-based content typing of texts and labels: scored facets with strength and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark import vocab
from shelfmark.functions import text as tx
from shelfmark.functions.binding import let, let_all

FACETS = ("article", "boarding_pass", "chat", "design_reference", "flight_booking", "hotel_booking", "map",
          "product_page", "receipt", "reservation", "social_post")
EVIDENCE = "array<struct<id:string,confidence:double,strength:string,sources:array<string>>>"
WEAK_CAP = 0.67      # a single family stays this far below the strong floor
SOFT_CAP = 0.47      # the emit floor and a little
LONE_WORDS = ("flight", "gate", "arrival", "departure", "total", "frame")
LINE_FACTS = ("headers", "distinct_headers", "dates", "tiny", "long", "messages", "pairs", "cards", "delivered", "senders",
              "amounts")


HAS = ("route_marks", "boarding_marks", "booking_marks", "check_in", "check_out", "arrives", "departs", "distance", "shop_marks", "booking_soft", "byline",
       "article_urls")
COUNTED = ("flight_phrases", "stay_confirmations", "stay_brands", "chat_apps", "finance", "currency", "navigation", "commerce", "design", "dining",
           "social_platforms", "engagement")


def _line_facts(get) -> Column:
    """The facts that follow from lines and their shapes."""
    shapes, lines = get("shapes"), get("lines")
    flag = lambda name: tx.count_where(shapes, lambda s: s[name])
    headers = F.array_distinct(F.transform(F.filter(shapes, lambda s: s["header"]), lambda s: s["low"]))
    delivered = F.exists(shapes, lambda s: s["low"].isin(*vocab.CHAT_STATUS) | F.startswith(s["low"], F.lit("delivered"))
                         | F.startswith(s["low"], F.lit("read by")) | F.contains(s["low"], F.lit("typing…"))
                         | F.contains(s["low"], F.lit("typing...")))
    return F.struct(
        flag("header").alias("headers"), F.size(headers).alias("distinct_headers"), flag("date").alias("dates"),
        flag("tiny").alias("tiny"), flag("long").alias("long"), flag("message").alias("messages"),
        tx.count_adjacent(shapes, lambda a, b: (a["clock"] & b["message"]) | (a["message"] & b["clock"])).alias("pairs"),
        tx.count_adjacent(shapes, lambda a, b: a["header"] & b["body"]).alias("cards"), delivered.alias("delivered"),
        tx.count_where(lines, lambda x: x.rlike(vocab.SENDER_PATTERN)).alias("senders"),
        tx.count_where(lines, lambda x: x.rlike(vocab.AMOUNT_PATTERN)).alias("amounts"))


def line_cues(text: Column) -> Column:
    """The struct of ``LINE_FACTS`` alone."""
    return let(tx.text_lines(F.coalesce(text, F.lit(""))), lambda lines: let_all({"shapes": tx.line_shapes(lines), "lines": lines}, _line_facts))


def text_cues(text: Column, labels: Column, body, cues: dict | None = None) -> Column:
    """``body(get)`` over the facts the rules use; the text is lowered, searched for cues and split into lines once."""
    cues = cues or vocab.FACET_CUES
    wanted = sorted({w for name in ("flight_words", "lodging_words") for w in cues[name]} | set(LONE_WORDS))

    def facts(get):
        low, lines, tags = get("low"), get("lines"), get("labels")
        count = lambda name: get("counts")[name]
        has = lambda name: count(name) > 0
        runs = get("words")
        words = lambda name: F.size(F.array_intersect(runs, tx.literals(cues[name])))
        word = lambda w: F.array_contains(runs, w)
        tagged = lambda name: F.arrays_overlap(tags, tx.literals(cues[name]))
        codes = F.array_except(tx.all_matches(get("text"), vocab.CODE_PATTERN), tx.literals(vocab.FACET_CODE_DENYLIST))
        coded = F.filter(F.regexp_extract_all(low, F.lit("(?U)" + vocab.DESIGNATOR_PATTERN), F.lit(0)),
                         lambda t: ~F.left(t, F.lit(2)).isin(*vocab.FACET_DESIGNATOR_BLOCK))
        named = F.regexp_extract_all(low, F.lit("(?U)" + vocab.FLIGHT_WORD_PATTERN), F.lit(0))
        flights = F.when(has("flight_marks"), F.size(named)).otherwise(0) + F.size(coded)
        return let_all({
            "codes": F.size(codes), "route": has("route_marks"),
            "flights": F.when(low.rlike("[0-9]"), flights).otherwise(0),
            "hard_phrases": count("flight_phrases"), "hard_words": words("flight_words"),
            "flight_word": word("flight"), "gate": word("gate"),
            "boarding": has("boarding_marks"), "booking": has("booking_marks"),
            "lodging": words("lodging_words"), "in": has("check_in"), "out": has("check_out"),
            "arrive": word("arrival") | has("arrives"), "depart": word("departure") | has("departs"),
            "confirm": count("stay_confirmations"), "brands": count("stay_brands"), "chat_apps": count("chat_apps"),
            "finance": count("finance"), "currency": count("currency"), "total": word("total"),
            "nav": count("navigation"), "distance": has("distance"), "commerce": count("commerce"),
            "ikea": has("ikea"), "shop": has("shop_marks"), "design": count("design"),
            "frame": word("frame"), "dining": count("dining"), "soft_booking": has("booking_soft"),
            "platforms": count("social_platforms"), "engagement": count("engagement"), "byline": has("byline"),
            "urls": has("article_urls"), "empty": F.size(lines) == 0, "map_label": F.array_contains(tags, "map"),
            "furniture": tagged("furniture_labels"), "interior": tagged("interior_labels"), "imagery": tagged("imagery_labels"),
            "line": let_all({"shapes": tx.line_shapes(lines), "lines": lines}, _line_facts),
        }, lambda fact: body(lambda name: fact("line")[name] if name in LINE_FACTS else fact(name)))

    def with_words(get):
        # A word that stands alone occurs, so texts without any of them need no look at word boundaries.
        runs = F.when(get("counts")["words"] > 0, tx.found_words(get("low"), wanted)).otherwise(F.array().cast("array<string>"))
        return let_all({**{n: get(n) for n in ("text", "low", "lines", "labels", "counts")}, "words": runs}, facts)

    groups = {**{name: cues[name] for name in HAS + COUNTED}, "ikea": ["ikea"], "flight_marks": ["flight", "flt"], "words": wanted}
    whole = F.coalesce(text, F.lit(""))
    low = F.lower(whole)
    return let_all({"text": whole, "low": low, "lines": tx.text_lines(whole), "labels": F.transform(labels, lambda x: F.lower(x)),
                    "counts": tx.count_groups(low, groups)}, with_words)


def _points(*terms: tuple[Column, object]) -> Column:
    """Sum of the values whose test holds."""
    total = F.lit(0.0)
    for test, value in terms:
        total = total + F.when(test, value).otherwise(0.0)
    return total


def _families(*tests: Column) -> Column:
    total = F.lit(0)
    for test in tests:
        total = total + test.cast("int")
    return total


def _sources(**named: Column) -> Column:
    """Sorted source tags; tags are named by keyword."""
    return F.array_compact(F.array(*[F.when(test, F.lit(tag)) for tag, test in sorted(named.items())]))


def _steps(count: Column, step: float, cap: float) -> Column:
    return F.least(F.lit(cap), step * count)


def _capped(score: Column, families: Column, cap: float = WEAK_CAP) -> Column:
    return F.when(families < vocab.FACET_FAMILIES, F.least(score, F.lit(cap))).otherwise(score)


def _score(score: Column, families: Column, sources: Column, on: Column, off: Column | None = None) -> Column:
    """A scored facet, worked out only where ``on`` holds and ``off`` does not; elsewhere zero."""
    nothing = F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("families"), F.array().cast("array<string>").alias("sources"))
    active = on if off is None else on & ~off
    return F.when(active, F.struct(
        F.round(score, 6).alias("score"), families.alias("families"), sources.alias("sources"))).otherwise(nothing)


def _is_strong(scored: Column) -> Column:
    return (scored["score"] >= vocab.FACET_STRONG) & (scored["families"] >= vocab.FACET_FAMILIES)


def score_facets(_c, body) -> Column:
    """``body(get)`` over one struct (score, families, sources) per facet, from the facts ``_c``."""
    route_family = (_c("codes") >= 2) | (_c("route") & (_c("codes") >= 1))
    hard = _c("hard_phrases") + _c("hard_words")
    hard_family = (hard >= 2) | (_c("hard_phrases") >= 1)
    flight_family = _c("flights") > 0
    families = _families(route_family, hard_family, flight_family)
    lone_word = _c("flight_word") & (families == 0)
    trip = _points(
        (_c("codes") >= 2, 0.30), (route_family & (_c("codes") < 2), 0.18), (~route_family & (_c("codes") == 1), 0.08),
        (hard_family, F.least(F.lit(0.40), 0.12 * hard + 0.10 * _c("hard_phrases"))), (~hard_family & (hard == 1), 0.10),
        (flight_family, _steps(_c("flights"), 0.14, 0.22)), (lone_word, 0.06))
    trip_sources = _sources(
        entity_pattern=route_family | (_c("codes") == 1) | flight_family, ocr_phrase=hard_family,
        ocr_keyword=(~hard_family & (hard == 1)) | lone_word)
    any_trip = (_c("codes") > 0) | (hard > 0) | flight_family | _c("flight_word")
    raised = lambda test: F.when(test, F.least(F.lit(0.98), trip + 0.05)).otherwise(trip)
    flights = {
        "boarding_pass": _score(_capped(raised(_c("boarding") | _c("gate")), families), families, trip_sources, any_trip),
        "flight_booking": _score(_capped(raised(_c("booking")), families), families, trip_sources, any_trip)}
    return let_all(flights, lambda first: _score_places(_c, first, body))


def _score_places(_c, first, body) -> Column:
    """Facets that look at the flight scores or stand alone."""
    boarding, booking = first("boarding_pass"), first("flight_booking")
    flight_strong = _is_strong(boarding) | _is_strong(booking)
    flight_high = flight_strong | (boarding["score"] >= vocab.FACET_STRONG) | (booking["score"] >= vocab.FACET_STRONG)
    lodging = _c("lodging") > 0
    stay = (_c("in") & _c("out")) | (_c("arrive") & _c("depart"))
    confirmed = (_c("confirm") > 0) & (lodging | stay)
    branded = _c("brands") > 0
    lone_check_in = _c("in") & ~lodging & ~branded & ~_c("out") & ~_c("arrive") & ~_c("depart")
    hotel_families = _families(lodging, stay, confirmed, branded)
    hotel = _points(
        (lodging, _steps(_c("lodging"), 0.12, 0.42)), (stay, 0.34), (~stay & _c("in") & lodging, 0.08),
        (confirmed, _steps(_c("confirm"), 0.18, 0.30)), (branded, _steps(_c("brands"), 0.16, 0.28)))
    hotel_sources = _sources(ocr_phrase=lodging | confirmed, ocr_structure=stay, ocr_keyword=(~stay & _c("in") & lodging) | branded)

    feed = (
        ((_c("cards") >= 3) & (_c("cards") >= _c("pairs")))
        | ((_c("headers") >= 4) & (_c("distinct_headers") >= 3) & (_c("pairs") < 3))
        | ((_c("headers") >= 3) & (_c("dates") >= 1) & (_c("pairs") < 3))
        | ((_c("tiny") >= 8) & (_c("messages") < 3) & (_c("headers") >= 3)))
    app, adjacent = _c("chat_apps") > 0, _c("pairs") >= 3
    turns, senders = (_c("messages") >= 3) & (_c("pairs") >= 2), _c("senders") >= 2
    chat_families = _families(app, _c("delivered"), adjacent, turns, senders)
    chat = _points((app, _steps(_c("chat_apps"), 0.18, 0.22)), (_c("delivered"), 0.34), (adjacent, 0.40),
                   (_c("pairs") == 2, 0.18), (turns, 0.36), (senders, 0.22))
    chat_sources = _sources(ocr_keyword=app, ocr_phrase=_c("delivered"), ocr_structure=(_c("pairs") >= 2) | turns | senders)

    finance, currency, amounts = _c("finance") > 0, _c("currency") > 0, _c("amounts") >= 2
    summed = _c("total") & (finance | currency)
    receipt_families = _families(finance, currency, amounts)
    receipt = _points((finance, _steps(_c("finance"), 0.16, 0.45)), (currency, _steps(_c("currency"), 0.12, 0.25)),
                      (summed, 0.18), (amounts, 0.18))
    receipt_sources = _sources(ocr_phrase=finance, entity_pattern=currency, ocr_keyword=summed, ocr_structure=amounts)

    nav, labelled = _c("nav") > 0, _c("map_label")
    map_families = _families(nav, labelled)
    routed = _points((nav, _steps(_c("nav"), 0.18, 0.50)), (nav & _c("distance"), 0.12), (labelled, 0.22))
    map_sources = _sources(ocr_phrase=nav, ocr_keyword=nav & _c("distance"), vision_assist=labelled)

    shop, home = _c("commerce") > 0, _c("furniture") & _c("shop")
    product = _points((shop, _steps(_c("commerce"), 0.22, 0.55)), (_c("ikea"), 0.18), (home, 0.28))
    product_sources = _sources(ocr_phrase=shop, ocr_keyword=_c("ikea") | home, vision_assist=home)

    drawn = _c("design") + _c("frame").cast("int")
    places = {
        "hotel_booking": _score(_capped(hotel, hotel_families), hotel_families, hotel_sources, lodging | stay | branded, flight_high | lone_check_in),
        "chat": _score(_capped(chat, chat_families), chat_families, chat_sources, app | _c("delivered") | (_c("pairs") >= 2) | senders, feed),
        "receipt": _score(_capped(receipt, receipt_families), receipt_families, receipt_sources, finance | currency | amounts, _c("total") & ~finance & ~currency),
        "map": _score(F.when(labelled & ~nav, F.least(routed, F.lit(vocab.FACET_EMIT + 0.12))).otherwise(routed), map_families, map_sources, nav | labelled),
        "product_page": _score(product, _families(shop, _c("ikea"), home), product_sources, shop | _c("ikea") | home),
        "design_reference": _score(_points((drawn > 0, _steps(drawn, 0.28, 0.70))), _families(drawn > 0), _sources(ocr_keyword=drawn > 0), drawn > 0),
    }
    return let_all(places, lambda second: _score_rest(_c, first, second, flight_strong, body))


def _score_rest(_c, first, second, flight_strong, body) -> Column:
    """Facets that depend on hotel and social scores."""
    dining, soft = _c("dining") > 0, _c("soft_booking") & (_c("dining") == 0)
    no_table = flight_strong | (soft & (second("hotel_booking")["score"] >= vocab.FACET_EMIT))
    reserve = _points((dining, _steps(_c("dining"), 0.30, 0.70)), (soft, 0.20))
    platform, engaged = _c("platforms") > 0, _c("engagement") > 0
    social = _points((platform, _steps(_c("platforms"), 0.28, 0.48)), (engaged, _steps(_c("engagement"), 0.16, 0.36)))
    social = F.when(platform & engaged, F.greatest(social, F.lit(vocab.FACET_STRONG + 0.05))).otherwise(social)
    social_families = _families(platform, engaged)
    third = {
        "reservation": _score(reserve, _families(dining | soft), _sources(ocr_phrase=dining, ocr_keyword=soft), dining | soft, no_table),
        "social_post": _score(_capped(social, social_families), social_families,
                                    _sources(ocr_keyword=platform, ocr_phrase=engaged), platform),
    }

    long = _c("long") >= 2
    article_families = _families(long, _c("byline"), _c("urls"))
    article = _points((long, 0.28), (_c("byline"), 0.25), (_c("urls"), 0.18))
    article = F.when(long, article).otherwise(F.least(article, F.lit(SOFT_CAP)))
    third["article"] = _score(
        _capped(article, article_families), article_families,
        _sources(ocr_structure=long, ocr_phrase=_c("byline"), entity_pattern=_c("urls")), long | _c("byline") | _c("urls"),
        third["social_post"]["score"] >= vocab.FACET_STRONG)

    def pick(last):
        groups = {**{n: first for n in ("boarding_pass", "flight_booking")}, **{n: last for n in third}}
        return body(lambda name: groups.get(name, second)(name))

    return let_all(third, pick)


def _evidence(name: str, scored: Column) -> Column:
    strong = _is_strong(scored)
    confidence = F.when((scored["score"] >= vocab.FACET_STRONG) & ~strong, vocab.FACET_STRONG - 0.01).otherwise(
        F.least(F.lit(0.98), scored["score"]))
    return F.when(scored["score"] >= vocab.FACET_EMIT, F.struct(
        F.lit(name).alias("id"), F.round(confidence, 6).alias("confidence"),
        F.when(strong, "strong").otherwise("weak").alias("strength"), scored["sources"].alias("sources")))


def _label_evidence(name: str, test: Column, confidence: float) -> Column:
    return F.when(test, F.struct(F.lit(name).alias("id"), F.lit(confidence).alias("confidence"), F.lit("strong").alias("strength"),
                                 F.array(F.lit("vision_assist")).alias("sources")))


def facets_of(text: Column, labels: Column | None = None, cues: dict | None = None) -> Column:
    """Every facet above the emit floor, by name, as one expression.

    Text decides when there is any; without text only ``labels`` (array of identifiers) can speak.
    Strong flight facets silence a chat found by structure only.
    """
    labels = F.array().cast("array<string>") if labels is None else labels

    def settle(fact):
        silent = F.array_compact(F.array(
            _label_evidence("interior_reference", fact("interior"), 0.78),
            _label_evidence("travel_imagery", fact("imagery"), 0.75))).cast(EVIDENCE)
        spoken = lambda e: F.arrays_overlap(e["sources"], F.array(F.lit("ocr_phrase"), F.lit("ocr_keyword")))

        def resolve(found):
            flight = F.exists(found, lambda e: (e["strength"] == "strong") & e["id"].isin("boarding_pass", "flight_booking"))
            return let(flight, lambda f: F.filter(found, lambda e: ~(f & (e["id"] == "chat") & ~spoken(e))))

        scored = score_facets(fact, lambda get: let(
            F.array_compact(F.array(*[_evidence(n, get(n)) for n in FACETS])).cast(EVIDENCE), resolve))
        return F.when(fact("empty"), silent).otherwise(scored)

    return text_cues(text, labels, settle, cues)


def facet_evidence(items: DataFrame, cues: dict | None = None) -> DataFrame:
    """Add ``facet_evidence`` to items with ``ocr_text`` and, optionally, ``labels``."""
    labels = F.col("labels") if "labels" in items.columns else None
    return items.withColumn("facet_evidence", facets_of(F.col("ocr_text"), labels, cues))


def strong_facets(evidence: Column) -> Column:
    """Sorted ids of strong facets."""
    strong = F.filter(evidence, lambda e: (e["strength"] == "strong") & (e["id"] != "image_only"))
    return F.array_sort(F.transform(strong, lambda e: e["id"]))
