"""Word lists, patterns, labels, limits. Results depend on them being exactly these.

Patterns use ASCII word rules: ``\\b``, ``\\w`` and ``\\s`` are expanded by ``functions.regex`` so that
Spark (java.util.regex) and any RE2 engine agree on text that is not ASCII.
"""

# --- fixed values: stop words ------------------------------------------------------------------
STOP_WORDS = (
    "the a an and or but if of at by for with about "
    "to from in on is are was were be been being am "
    "it its this that these those as so than too very "
    "i me my we our you your he she they them his "
    "her their what which who whom how when where why "
    "all any both each more most other some such no nor "
    "not only own same just now will can do does did "
    "have has had up out down over then there here get "
    "got rt via amp http https co like one would us"
).split()

# --- fixed values: vocabularies ----------------------------------------------------------------
HAZARDS = ("flood", "fire", "quake", "storm")  # tie order
ALL_HAZARDS = HAZARDS + ("other",)
HAZARD_PATTERNS = {
    "flood": r"(?i)(?:flood|inundat|submerg|overflow|sandbag|levee|dike|dyke|washout|highwater)\w*"
             r"|under\s?water|washed\s?out|water\s+(?:level|rise|rising|everywhere)|river\s+(?:rise|rising|crest)",
    "fire": r"(?i)(?:wildfire|firefight|smoke|blaze|scorch)\w*|\bember\w*|fire\s+(?:ban|season|crew|evacuation)",
    "quake": r"(?i)(?:earthquake|quake|tremor|aftershock|seismic)\w*",
    "storm": r"(?i)(?:tornado|hurricane|blizzard|hailstorm|windstorm|thunderstorm|cyclone|typhoon)\w*|storm\s+surge",
}
EMERGENCY_PATTERN = (
    r"(?i)\b(?:evacuat|displac|rescue|emergenc|shelter|damag|destro|stranded|trapped|closure|closed|impassable"
    r"|detour|advisory|warning|relief|donat|volunteer|sandbag)\w*"
    r"|\b(?:bridge|road|roads|highway|overpass|underpass|causeway)\b"
    r"|state of emergency|red cross|do not (?:cross|drive|try)|is\s+\w+\s+open"
)
SPAM_PATTERNS = (
    r"(?i)#(?:job|jobs|hiring|careers|tweetmyjobs)\b",
    r"(?i)\b(?:we are hiring|apply now|click here|promo code|discount code|follow back)\b",
    r"(?i)\bi(?:'m| am) at\b.*\bhttp",
)

# --- fixed values: keyword classifier rules, first match wins (pattern, category, severity) ----
CATEGORY_RULES = (
    (r"(?i)\b(?:trapped|stranded|rescue|missing)\w*", "rescue_request", 2),
    (r"(?i)\b(?:evacuat|displac|shelter|reception centre)\w*", "evacuation", 2),
    (r"(?i)\b(?:bridge|road|highway|closed|closure|impassable|detour)\w*|washed out", "access_blocked", 2),
    (r"(?i)\b(?:damag|destro|ruin|collaps|submerg)\w*|under water", "damage", 1),
    (r"(?i)\b(?:donat|volunteer|fundrais|sandbag)\w*|red cross|yychelps", "aid", 1),
    (r"(?i)\b(?:warning|advisory|mandatory)\w*|do not|please avoid|state of emergency|boil water", "advisory", 2),
)
RULE_SPAM_PATTERN = r"(?i)#job|#hiring|we are hiring|apply now|taco|tequila|check in|i'm at "
RULE_FLOOD_PATTERN = r"(?i)flood|yycflood|abflood|water|river|evacuat|rain|submerg|sandbag"
RULE_REQUEST_PATTERN = r"(?i)\b(help|need|anyone know|please)\b"
RULE_RESHARE_PATTERN = r"(?i)^RT |http"
# stated confidences of the keyword classifier
RULE_CONFIDENCE = {
    "relevant_spam": 0.91, "relevant_hit": 0.88, "relevant_miss": 0.34,
    "hazard_hit": 0.93, "hazard_miss": 0.55, "category_hit": 0.76, "category_sentiment": 0.48,
    "severity": 0.61, "has_place_hit": 0.86, "has_place_miss": 0.72, "is_request": 0.58,
    "has_pii": 0.95, "is_spam_hit": 0.89, "is_spam_miss": 0.93, "firsthand": 0.64,
}

# --- fixed values: redaction patterns, applied in this order -----------------------------------
REDACTIONS = (
    (r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b", "[phone redacted]"),
    (r"\b[\w.+-]+@[\w-]+\.[\w.]+\b", "[email redacted]"),
    (r"\b\d{1,5}\s+[A-Z][a-z]+\s+(?:St|Street|Ave|Avenue|Rd|Road|Dr|Drive|Blvd|Cres|Way)\b", "[address redacted]"),
)

# --- fixed values: claims that a generated sentence may not make -------------------------------
KILL_PATTERN = r"(?i)\b(verified|confirmed)\b"
PEOPLE_PATTERN = (
    r"(?i)\b\d[\d,]*\s*(?:people|residents|persons|individuals|families)\b"
    r"|\bpeople\b[^.]{0,40}\b(?:affected|impacted|displaced)\b"
    r"|\b(?:affected|impacted|displaced)\b[^.]{0,40}\bpeople\b"
)
KILL_REASON = "kill phrase (verified/confirmed)"
PEOPLE_REASON = "claims a number of people affected"
COUNT_QUESTION_PATTERN = (
    r"(?i)^\s*how many\b.*\b(mention|mentions|mentioning|about|contain|contains|reference|references|talk|talking)\b"
)
QUESTION_STOP_WORDS = (
    "how what which where when why who are is do does did "
    "the there many much most please tell show list give can "
    "i we flood floods flooding twitter rt"
).split()
REDACTION_WORDS = ("redacted", "redact", "phone", "email", "address")

# --- fixed values: categories, in triage order, with their two kinds of label ------------------
CATEGORY_TRIAGE_ORDER = (
    "rescue_request", "access_blocked", "evacuation", "damage", "advisory", "aid", "sentiment",
)
CATEGORY_LABELS = {
    "rescue_request": "Needs help", "access_blocked": "Route blocked", "evacuation": "Evacuation",
    "damage": "Damage", "advisory": "Advisory", "aid": "Aid and relief", "sentiment": "Comment",
}
# model questions list categories in this order
CATEGORIES = ("access_blocked", "evacuation", "rescue_request", "damage", "aid", "advisory", "sentiment")
THEME_LABELS = {
    "access_blocked": "roads and bridges blocked", "evacuation": "evacuation and shelter",
    "rescue_request": "requests for help", "damage": "property and infrastructure damage",
    "aid": "donations and volunteers", "advisory": "official advisories",
    "sentiment": "solidarity and commentary",
}
SEVERITY_LABELS = ("Background", "Notable", "Urgent")
GEO_METHOD_LABELS = {"exif": "Exact", "provided": "Given", "gazetteer": "Inferred"}
CONFIDENCE_GATES = {"relevant": 0.6, "category": 0.5, "hazard": 0.5, "has_pii": 0.3, "is_spam": 0.7}
QUESTIONS = (  # (question, answer type)
    ("hazard_topic", "noul"), ("response_topic", "noul"), ("hazard", "choice"), ("category", "choice"),
    ("severity", "score"), ("has_place", "noul"), ("is_request", "noul"), ("has_pii", "noul"),
    ("is_spam", "noul"), ("firsthand", "noul"),
)
BOOLEAN_QUESTIONS = ("has_place", "is_request", "has_pii", "is_spam", "firsthand")

# --- fixed values: image description enums -----------------------------------------------------
SUBMERGED = ("road", "bridge", "house", "vehicle", "farmland", "business", "railway", "sidewalk", "none")
WATER_DEPTHS = ("none", "ankle", "knee", "waist", "above-waist", "unclear")

# --- fixed values: thresholds ------------------------------------------------------------------
SAMPLE_SIZE = 2000
TERM_LIMIT, TERM_MIN_DF, TERM_MAX_SHARE = 40, 3, 0.6
PLACE_LIMIT = 8
PREFILTER_THRESHOLD = 0.15
COST_PER_CALL = 0.00004
SESSION_BUDGET, DAILY_CEILING = 2.0, 20.0
BREAKER_FAILURES = 30
COMMUNITY_RADIUS_KM, EARTH_KM, KM_PER_DEGREE = 25.0, 6371.0, 111.32
STACK_LIST_MAX = 100
PAGE_ROWS = 200
ASK_PLACES, ASK_EVIDENCE = 8, 60
SMS_MAX_CHARS, SMS_SNIPPET = 480, 80
CLUSTER_RADIUS_PX, CLUSTER_MAX_ZOOM = 45, 11
URL_TTL = "10 minutes"
SPECIFICITY = {
    "road": 0, "landmark": 0, "neighbourhood": 1, "river": 1,
    "hamlet": 2, "town": 2, "township": 2, "reserve": 2, "city": 3, "region": 5,
}
SPECIFICITY_DEFAULT = 4
UNCERTAINTY_M = {
    "landmark": 250, "road": 600, "neighbourhood": 1500, "hamlet": 1500, "river": 2000,
    "town": 3000, "reserve": 4000, "township": 5000, "city": 8000, "region": 25000,
}
UNCERTAINTY_DEFAULT_M = 3000
# points of a namesake for sharing an admin region or a country with a sure place, population worth one point, and
# (lead over the next namesake, confidence) of a choice
ADMIN_VOTE, COUNTRY_VOTE, FULL_POPULATION = 3.0, 1.0, 2_000_000
SURE_ALONE, SURE_BY_LEAD, SURE_OTHERWISE, SURE_REGION = 0.85, ((3, 0.8), (1, 0.55)), 0.35, 0.4
# parts of the relevance score
SCORE_OWN, SCORE_OTHER, SCORE_EMERGENCY, SCORE_NEAR, SCORE_TERM, SCORE_TERMS_MAX = 0.5, 0.3, 0.25, 0.15, 0.04, 0.2

# --- fixed values: column name candidates of delimited uploads, best first ---------------------
COLUMN_CANDIDATES = {
    "text": "text tweet tweet_text content body message post full_text description comment status caption".split(),
    "lat": "lat latitude y lat_dd".split(),
    "lon": "lon lng long longitude x lon_dd".split(),
    "ts": "created_at timestamp date time datetime posted_at".split(),
    "author": "author user username screen_name handle user_name".split(),
    "place": "place location place_name city region geo".split(),
}
DELIMITERS = (",", "\t", "|", ";")

# --- fixed values: link triage -----------------------------------------------------------------
BLOCKED_DOMAINS = (
    ("reddit.com", "reddit_blocked"), ("redd.it", "reddit_blocked"),
    ("facebook.com", "facebook_blocked"), ("fb.com", "facebook_blocked"),
    ("instagram.com", "instagram_blocked"), ("threads.net", "threads_blocked"),
)
IMAGE_PATH_PATTERN = r"(?i)\.(jpe?g|png|webp|gif|heic)$"
STRIPPED_TAGS = ("script", "style", "nav", "header", "footer", "aside", "svg")
NAMED_ENTITIES = (
    ("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"),
    ("mdash", "—"), ("ndash", "–"), ("nbsp", " "), ("hellip", "…"),
)

# --- fixed values: export layout ---------------------------------------------------------------
CSV_COLUMNS = (
    "id text cat cat_lbl sev sev_lbl rel_conf lat lon pl_conf geo_m geo_lbl firsthand clsfr "
    "model_ver community src_url ts"
).split()

MODEL_CLASSIFIER, RULE_CLASSIFIER = "model", "heuristic"
CACHE_VERSION = "model-1"
