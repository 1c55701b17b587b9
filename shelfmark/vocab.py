"""Fixed values the rules depend on: word lists, patterns and thresholds.

Everything here is data, not logic.  Callers may pass their own lists to the operators; these are the
defaults.  Lists of single words are written as text blocks, lists of phrases with ``|`` between entries.
"""

from __future__ import annotations


def _words(text: str) -> tuple[str, ...]:
    return tuple(text.split())


def _phrases(text: str) -> tuple[str, ...]:
    return tuple(part for part in text.replace("\n", "").split("|") if part)


UNKNOWN = "unknown"

# ---- Fixed values: status vocabularies -------------------------------------------------------------
STAGE_STATUSES = _words("pending processing completed failed inaccessible")
ORGANIZE_STATUSES = _words("idle pending pendingNetwork ready failed skippedNoConsent locked")
DECISIONS = _words("reuse create needsReview skipped")
EVAL_LABELS = _words("correct wrongCollection shouldBeNeedsReview wrongCollectionName")
COLLECTION_KINDS = _words("aiContext userContext unassigned")

# ---- Fixed values: limits and thresholds -----------------------------------------------------------
MAX_QUERY_TOKENS = 12
SEARCH_LIMIT = 100
COLLECTION_MATCH_LIMIT = 4
BM25_K1 = 1.2
BM25_B = 0.75
BM25_IDF_FLOOR = 1e-6
RETRY_BASE_SECONDS = 30
RETRY_CAP_SECONDS = 3600
MAX_ATTEMPTS = 8
TEXT_CLAIM_SECONDS = 300
VISUAL_CLAIM_SECONDS = 90
ORGANIZE_BACKOFF_SECONDS = 15
POOL_SIZE = 40
RETRIEVAL_SIZE = 24
GROUP_SIZE = 8
ADMIT_FLOOR = 0.32
BRIDGE_SEED_FLOOR = 0.26
BRIDGE_PEER_FLOOR = 0.38
OUTLIER_FLOOR = 0.20
VECTOR_STRONG = 0.65
VECTOR_WEAK = 0.90
VECTOR_FAR = 1.2
NEIGHBOR_LIMIT = 8
ASSIGN_THRESHOLD = 0.70
CREATE_THRESHOLD = 0.85
RESOLVER_VERSION = 2
LABEL_FLOOR = 0.28
LABEL_BYPASS = 0.12
LABEL_LIMIT = 8
RAW_LABEL_LIMIT = 20
FACET_EMIT = 0.42
FACET_STRONG = 0.72
FACET_FAMILIES = 2
RATE_LIMIT = 30
RATE_WINDOW_SECONDS = 60

# ---- Fixed values: titles --------------------------------------------------------------------------
NOUN_DENYLIST = _words("""
indoor outdoor person people human man woman screenshot text font electronics computer laptop
monitor screen display smartphone mobile_phone phone pattern abstract design art drawing illustration
room floor wall ceiling window door sky cloud clouds nature plant tree grass animal mammal object thing
scene landscape photo photograph image picture airplane aeroplane aircraft airport vehicle car truck bus
train boat ship bicycle motorcycle building skyscraper bridge tower landmark city town street
furniture sofa couch chair table bed desk cabinet food meal dish fruit vegetable drink beverage
document paper book magazine newspaper cat dog bird pet flower beach mountain ocean sea
hotel restaurant shop store market office kitchen bathroom travel vacation trip holiday
""")
GENERIC_TITLES = _phrases("""
travel|shopping|work|receipts|receipt|chats|chat|social|misc|other|screenshots|screenshot|photos|general|
image|website|miscellaneous|hotels|hotel|maps|map|restaurants|restaurant|boarding pass|furniture|chair|sofa|
information|document|documents|airplanes|airplane|airports|airport|cars|car|food|cats|cat|dogs|dog|vehicles|
vehicle|buildings|building|landmarks|landmark|city|cities
""")
LOW_INFORMATION_LABELS = _words("""
indoor outdoor person people human man woman screenshot text font electronics computer laptop
monitor screen display smartphone mobile_phone phone pattern abstract design art drawing illustration
room floor wall ceiling window door sky cloud clouds nature plant tree grass animal mammal object thing
scene landscape photo photograph image picture
""")
SUGGESTION_FALLBACK = _phrases("Boarding pass|Blue sofa|Tokyo|Receipt|Qatar Airways|Restaurant|IKEA|Visa")

# ---- Fixed values: text clean-up and tokens --------------------------------------------------------
STATUS_CHROME = _phrases("lte|5g|4g|wifi|wi-fi|vpn|ssd|sos|carrier|no service|searching…")
TEXT_STOPWORDS = _words("""
settings done back share continue cancel search today home ok open close edit delete more next skip save
send yes no the and for you are but not all can had her was one our out get has him his how man new now old
see way who did let put say she too use from with this that your have will just like what when where which
while about after before into over only also than then them they been were said each make most some time
very message messages notification notifications photo photos camera gallery instagram linkedin facebook
whatsapp imessage messenger gmail twitter tiktok inbox subject safari
""")
GEO_WORDS = _words("hotel airport city country travel trip flight room guest")
CLUSTER_LABEL_DENYLIST = _words("""
document adult person people human text screenshot screen display clothing structure man woman child face
body indoor outdoors
""")
DOMAIN_DENYLIST = _words("apple.com google.com icloud.com microsoft.com facebook.com instagram.com")
PAIR_CODE_DENYLIST = _words("""
THE AND FOR YOU ARE BUT NOT ALL CAN HAD HER WAS ONE OUR OUT DAY GET HAS HIM HIS HOW MAN NEW NOW OLD SEE
MON TUE WED THU FRI SAT SUN JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC PDF SMS OTP APP IOS USD EUR
""")
PAIR_DESIGNATOR_BLOCK = _words("to at on in by of or if is it be as an am pm no ok")
FACET_CODE_DENYLIST = _words("""
THE AND FOR YOU ARE BUT NOT ALL CAN HAD HER WAS ONE OUR OUT DAY GET HAS HIM HIS HOW MAN NEW NOW OLD SEE
WAY WHO BOY DID ITS LET PUT SAY SHE TOO USE APP IOS USD EUR GBP PDF SMS OTP FAQ VIP ETA CEO CTO CFO
MON TUE WED THU FRI SAT SUN JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC AM PM GMT UTC EST PST CST
YES NO OK OFF ON TOP END MAX MIN AVG SUM SET AIR CAR BUS TAX TIP BOX BAG KEY PIN ID SSID LTE GPS
CPU GPU RAM ROM USB HDMI WIFI HOT COLD
""")
FACET_DESIGNATOR_BLOCK = _words("to at on in by of or if is it be as an am pm no ok up do go so we me my id")

# ---- Fixed values: patterns over lower-cased text --------------------------------------------------
REFERENCE_PATTERNS = (
    r"\b(?:confirmation|booking)\s*(?:#|no\.?|number|ref(?:erence)?\.?)?\s*[a-z0-9-]{5,}\b",
    r"\b(?:ref|pnr)\s*[:#]?\s*[a-z0-9]{5,}\b",
    r"#[a-z0-9]{5,}\b",
)
FLIGHT_WORD_PATTERN = r"\b(?:flight|flt)\s*#?\s*\d{1,4}\b"
DESIGNATOR_PATTERN = r"\b[a-z]{2}\s?\d{3,4}\b"
CODE_PATTERN = r"\b[A-Z]{3}\b"
DOMAIN_PATTERN = r"\b(?:https?://)?([a-z0-9-]+(?:\.[a-z0-9-]+)+)\b"
ALNUM_PATTERN = r"\b[a-z0-9]{6,}\b"
SECRET_PATTERN = r"(?i)(sk-[a-zA-Z0-9_-]{8,}|Bearer\s+\S+|api[_-]?key)"
SENDER_PATTERN = r"^[A-Za-z][A-Za-z0-9 _.]{1,20}:"
AMOUNT_PATTERN = r"\d+[.,]\d{2}"

# ---- Fixed values: facet cues ----------------------------------------------------------------------
FACET_CUES = {
    "flight_phrases": _phrases("boarding pass|flight details|manage trip|check-in opens|select your seat|e-ticket|eticket"),
    "flight_words": _words("boarding terminal departure arrival passenger airline cabin pnr gate seat"),
    "route_marks": ("→", "->", " to "),
    "boarding_marks": _phrases("boarding pass|boarding"),
    "booking_marks": _phrases("manage trip|flight details|check-in opens"),
    "lodging_words": _words("hotel guest guests room rooms nights night accommodation property suite resort lodging stay"),
    "check_in": _phrases("check-in|check in"),
    "check_out": _phrases("check-out|check out|checkout"),
    "arrives": _phrases("arrives|arriving"),
    "departs": _phrases("departs|departing"),
    "stay_confirmations": _phrases(
        "reservation confirmed|booking confirmation|booking confirmed|confirmation number|booking reference|"
        "confirmation #|confirmation no|reservation number|booking number"),
    "stay_brands": _phrases(
        "marriott|hilton|hyatt|park hyatt|ihg|holiday inn|airbnb|ritz|sheraton|westin|novotel|mercure|accor|booking.com"),
    "chat_apps": _phrases("whatsapp|imessage|i message|telegram|signal"),
    "finance": _phrases("subtotal|tax|invoice|receipt|amount due|payment|change due"),
    "currency": ("$", "€", "£", "usd", "eur", "gbp", "idr", "rp "),
    "navigation": _phrases(
        "directions|google maps|apple maps|min walk|min drive|navigation|route|destination|eta |traffic"),
    "distance": ("km", "mi ", "miles"),
    "commerce": _phrases("add to cart|add to bag|in stock|sku|buy now|checkout"),
    "shop_marks": ("buy", "cart", "price", "shop", "$", "¥", "€"),
    "furniture_labels": _words("furniture sofa chair table"),
    "design": _words("figma sketch artboard prototype dribbble behance"),
    "dining": _phrases("opentable|resy|table for|reservation confirmed|dining reservation"),
    "booking_soft": _words("reservation booking"),
    "social_platforms": _words("instagram tiktok twitter x.com linkedin facebook"),
    "engagement": _phrases("liked by|followers|retweet|comments|shares|replies"),
    "byline": _phrases("byline|min read|published|newsletter|opinion"),
    "article_urls": _words("http:// https:// medium.com nytimes bbc."),
    "interior_labels": _words("sofa furniture chair table bed interior"),
    "imagery_labels": _words("airplane airport building city landmark skyscraper"),
}
CHAT_STATUS = _words("delivered read typing online sent")
DATE_HEADERS = _words("""
today yesterday monday tuesday wednesday thursday friday saturday sunday mon tue wed thu fri sat sun
""")
TRAVEL_FACETS = _words("boarding_pass flight_booking hotel_booking map reservation travel_imagery")
HOME_FACETS = _words("product_page interior_reference")

# ---- Fixed values: source cues ---------------------------------------------------------------------
PLATFORM_CUES = (
    ("instagram", _phrases("instagram|liked by|reels")),
    ("linkedin", _phrases("linkedin|connection request|people also viewed")),
    ("facebook", _phrases("facebook|news feed")),
    ("whatsapp", _phrases("whatsapp|voice message|tap to call")),
    ("imessage", ("imessage",)),
    ("messenger", _phrases("messenger|facebook messenger")),
    ("gmail", _phrases("gmail|google mail")),
    ("mail", _phrases("mailboxes|all inboxes")),
    ("maps", _phrases("google maps|apple maps")),
    ("browser", ("safari",)),
)
FACET_FAMILY = (
    ("boarding_pass", "travel"), ("flight_booking", "travel"), ("hotel_booking", "travel"),
    ("reservation", "travel"), ("map", "navigation"), ("product_page", "commerce"),
    ("receipt", "commerce"), ("chat", "messaging"), ("social_post", "social_media"),
)
EMAIL_CUES = _phrases("subject:|from:|to:|inbox|unsubscribe|sent items")
IDENTITY_CUES = _phrases(
    "passport|national id|resident id|identity card|date of birth|nationality|document no|id number|emirates id|qid ")
COMMERCE_CUES = _phrases("add to cart|add to bag|buy now|checkout|in stock|sku")
UNLOCK_CUES = _phrases(
    "swipe up to unlock|press home to unlock|touch id to unlock|face id|unlock to open|slide to unlock|swipe up for")
CENTER_CUES = _phrases("notification center|no older notifications")
STACK_APPS = _phrases("gmail|google mail|whatsapp|instagram|messages|mail")
EMBEDDED_CUES = (
    ("gmail", _phrases("gmail|google mail")),
    ("whatsapp", ("whatsapp",)),
    ("instagram", ("instagram",)),
    ("mail", ("mail",)),
    ("messages", _phrases("messages|imessage")),
    ("maps", ("maps",)),
)
NOTIFIABLE = _words("gmail mail whatsapp instagram imessage messenger maps messages")
DEMOTED_TYPES = _words("email chat social_post map")

# ---- Fixed values: rule-based understanding --------------------------------------------------------
ENTITY_SEEDS = (
    ("city", "Tokyo", _phrases("tokyo|nrt|shinjuku|shibuya")),
    ("city", "Doha", _phrases("doha|doh|qatar")),
    ("airline", "Qatar Airways", _phrases("qatar airways|qatar")),
    ("hotel", "Park Hyatt", ("park hyatt",)),
    ("topic", "Visa", _phrases("visa|embassy|passport")),
    ("topic", "Apartment", _phrases("ikea|apartment|lease|furniture")),
    ("topic", "Restaurant", _phrases("restaurant|menu|reservation|ramen|sushi")),
)
PROPOSAL_RULES = (
    ("Visa", "visa", "Visa Application", "🛂", 0.88),
    ("Tokyo", "tokyo", "Japan Trip", "✈️", 0.87),
    ("Qatar Airways", "qatar", "Qatar Airways", "✈️", 0.88),
    ("Apartment", "ikea", "Apartment Setup", "🏠", 0.86),
    ("Restaurant", None, "Weekend Restaurants", "🍜", 0.86),
)
TRAVEL_LABELS = _words("airplane airport landmark city building")
HOME_LABELS = _words("sofa furniture chair table")
STRONG_ENTITY_TYPES = _words("city place project event airline hotel merchant topic")
TRIP_ENTITIES = _words("tokyo japan osaka")

# ---- Fixed values: result checks -------------------------------------------------------------------
FORBIDDEN_KEYS = _words("""
proposedNewCollection collectionName collectionTitle createCollection reuseCollection candidateCollections
eligibleCollections collectionID collectionId imageBase64 imageMimeType
""")
BANNED_TEXT = (
    r"(?i)\b(create collection|reuse collection|collection title|proposedNewCollection|"
    r"collectionname|collection_title)\b"
)
