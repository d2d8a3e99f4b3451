"""Views that Spark derives from the given tables, each with the same view as SQL text.

``posts`` and its companions come from ``events``, so every query grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from postsieve import values as V

TEMPLATES = [
    "Glenmore bridge is under water near {p}, do not try it",
    "we are evacuating now from {p}, water is in the basement",
    "Anyone know if Highway 22 is open? {p} #yycflood",
    "{p} has declared a state of emergency",
    "my mom is stranded in {p}, please help",
    "Red Cross donations and volunteers needed in {p}",
    "We are hiring in {p}! apply now #job",
    "great dinner tonight in {p}",
    "flood waters rising fast in {p}, roads closed #abflood",
    "tornado warning for {p}, take shelter",
    "earthquake felt in {p} this morning",
    "wildfire smoke over {p} all day",
    "call 403-555-0199 or help@example.org about the flooding in {p}",
    "sandbag crews at {p}; levee overflow",
    "thanks to everyone in {p}, stay strong",
    "power out at 123 Main Street in {p} after the flood",
]
OTHER_HAZARD_TEMPLATES = (9, 10, 11)
PLACES = ["Calgary", "High River", "Medicine Hat", "Siksika Nation", "London", "millennium park", "Canmore",
          "Boulder", "Manila", "nowhere special", "Peguis", "Sardinia"]

_POSTS_COLUMNS = """
  event_id AS seq,
  'e' || CAST(event_id AS {string}) AS id,
  'csv' AS source,
  (CASE WHEN event_id % 10 = 5 THEN 'RT @someone: ' ELSE '' END)
    || replace({template}, '{{p}}', {place}) || ' ' || CAST(k AS {string}) AS text,
  CASE WHEN event_id % 91 = 0 THEN CAST(200 AS DOUBLE) WHEN event_id % 90 = 0 THEN CAST(0 AS DOUBLE)
       WHEN event_id % 9 = 0 THEN 49 + CAST(event_id % 500 AS DOUBLE) / 100 END AS lat,
  CASE WHEN event_id % 91 = 0 THEN -115 + CAST(event_id % 700 AS DOUBLE) / 100
       WHEN event_id % 90 = 0 THEN CAST(0 AS DOUBLE)
       WHEN event_id % 9 = 0 THEN -115 + CAST(event_id % 700 AS DOUBLE) / 100 END AS lon,
  {stamp} AS ts,
  'user_' || CAST(user_id AS {string}) AS author,
  k
"""
_K = "CASE WHEN event_id % 5 = 0 AND event_id > 0 THEN event_id - 1 ELSE event_id END AS k"


def _pick(items: list[str], index: str) -> str:
    return "CASE " + index + " " + " ".join(
        "WHEN %d THEN '%s'" % (i, t.replace("'", "''")) for i, t in enumerate(items)) + " END"


def _columns(string: str, stamp: str) -> str:
    return _POSTS_COLUMNS.format(string=string, stamp=stamp, template=_pick(TEMPLATES, "(k * 7) % 16"),
                                 place=_pick(PLACES, "(k * 5) % 12"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a narrow input that one task reads. What is derived from them is up to a hundred times as wide, so tasks go by rows, not by bytes.
ROWS_PER_TASK = 100_000


def widen(df: DataFrame) -> DataFrame:
    """Spreads an input over as many partitions as its rows ask for, and as there are cores at least; one that has them stays as it is.

    Files are split by bytes, and never inside a row group: a narrow table of many rows is few tasks.
    """
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_PER_TASK))
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def posts(spark: SparkSession, sf_dir: str, single_hazard: bool = False) -> DataFrame:
    events = widen(table(spark, sf_dir, "events").select("event_id", "user_id", "ts")).selectExpr("*", _K)
    if single_hazard:
        events = events.where(f"(k * 7) % 16 NOT IN {OTHER_HAZARD_TEMPLATES}")
    return events.selectExpr(*_split(_columns("STRING", "date_format(ts, 'yyyy-MM-dd HH:mm:ss')")))


def _split(columns: str) -> list[str]:
    parts, depth, quoted, current = [], 0, False, ""
    for c in columns:
        quoted ^= c == "'"
        depth += (c == "(") - (c == ")") if not quoted else 0
        if c == "," and depth == 0 and not quoted:
            parts.append(current.strip())
            current = ""
        else:
            current += c
    return parts + [current.strip()]


def posts_sql(single_hazard: bool = False) -> str:
    keep = f"WHERE (k * 7) % 16 NOT IN {OTHER_HAZARD_TEMPLATES}" if single_hazard else ""
    return f"""SELECT {_columns("VARCHAR", "strftime(ts, '%Y-%m-%d %H:%M:%S')")}
FROM (SELECT *, {_K} FROM events) {keep}"""


# --- answers of the decision model, one row per post and question ---------------------------------

def _answers_select(k: str, i: int, question: str, kind: str, string: str) -> str:
    enum = {"hazard": V.ALL_HAZARDS, "category": V.CATEGORIES}.get(question, ())
    choice = f"CAST(NULL AS {string})"
    if enum:
        choice = _pick(list(enum), f"({k} + {i}) % {len(enum)}")
    noul = f"CAST(({k} * 37 + {i} * 11) % 101 AS DOUBLE) / 100" if kind == "noul" else "CAST(NULL AS DOUBLE)"
    score = f"CAST({k} % 201 AS DOUBLE) / 100" if kind == "score" else "CAST(NULL AS DOUBLE)"
    conf = f"CAST(({k} * 17 + {i}) % 101 AS DOUBLE) / 100" if kind != "noul" else "CAST(NULL AS DOUBLE)"
    return f"'{question}' AS question, '{kind}' AS type, {noul} AS noul, {choice} AS choice, {score} AS score, {conf} AS confidence"


def answers(posts_df: DataFrame) -> DataFrame:
    """Long answers table; ``has_place`` is left out for every thirteenth post."""
    rows = []
    for i, (question, kind) in enumerate(V.QUESTIONS):
        fields = ", ".join(_answers_select("k", i, question, kind, "STRING").split("\n"))
        rows.append(f"named_struct({_named(fields)})")
    long = posts_df.select("id", "k").selectExpr("id AS post_id", "k", f"explode(array({', '.join(rows)})) AS a")
    return (long.select("post_id", "k", "a.*").where("NOT (question = 'has_place' AND k % 13 = 0)").drop("k"))


def _named(fields: str) -> str:
    out = []
    for f in _split(fields):
        expr, name = f.rsplit(" AS ", 1)
        out.append(f"'{name}', {expr}")
    return ", ".join(out)


def answers_sql(source: str = "posts") -> str:
    selects = []
    for i, (question, kind) in enumerate(V.QUESTIONS):
        where = " WHERE k % 13 <> 0" if question == "has_place" else ""
        selects.append(f"SELECT id AS post_id, {_answers_select('k', i, question, kind, 'VARCHAR')} FROM {source}{where}")
    return "\nUNION ALL ".join(selects)


def with_sql(body: str, **ctes: str) -> str:
    """WITH clause from named parts in order."""
    if not ctes:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in ctes.items()) + "\n" + body


# --- other companions --------------------------------------------------------------------------

def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review log: one row per labelled document, a second later one for some."""
    labels = table(spark, sf_dir, "labels")
    first = labels.selectExpr("concat('e', doc_id) AS id",
                              "CASE WHEN quality = 1 THEN 'confirmed' ELSE 'rejected' END AS action", "doc_id AS at")
    second = labels.where("doc_id % 4 = 0").selectExpr(
        "concat('e', doc_id) AS id", "CASE WHEN toxic = 1 THEN 'confirmed' ELSE 'rejected' END AS action",
        "doc_id + 1000000000 AS at")
    return first.unionByName(second)


REVIEWS_SQL = """SELECT 'e' || doc_id AS id, CASE WHEN quality = 1 THEN 'confirmed' ELSE 'rejected' END AS action, doc_id AS "at"
FROM labels UNION ALL SELECT 'e' || doc_id, CASE WHEN toxic = 1 THEN 'confirmed' ELSE 'rejected' END, doc_id + 1000000000
FROM labels WHERE doc_id % 4 = 0"""

_URLS = [
    "https://x.com/user{u}/status/{k}", "https://bsky.app/profile/user{u}.bsky.social/post/{k}",
    "https://mastodon.example/@user{u}/{k}", "https://social.example/users/user{u}/statuses/{k}/",
    "https://img.example.com/pics/{k}.JPG?size=2", "https://www.reddit.com/r/flood/{k}",
    "https://m.facebook.com/{k}", "http://127.0.0.1/{k}", "http://10.0.0.8/{k}", "http://[fe80::1]/{k}",
    "ftp://files.example.com/{k}", "https://News.example.org/story/{k}#top",
]


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links in the order they were submitted; the same link comes back inside and outside ten minutes."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return events.selectExpr("event_id AS url_id", f"{_url_text('STRING')} AS url", "ts")


def _url_text(string: str) -> str:
    return (f"replace(replace({_pick(_URLS, 'event_id % 12')}, '{{u}}', CAST(user_id % 7 AS {string})), "
            f"'{{k}}', CAST(event_id % 50 AS {string}))")


URLS_SQL = f"SELECT event_id AS url_id, {_url_text('VARCHAR')} AS url, ts FROM events"


def image_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(_IMAGE_ROWS).selectExpr(*_split(_image_columns("STRING", "array")))


_IMAGE_ROWS = "event_id % 5 = 2"


def _image_columns(string: str, array: str) -> str:
    def arr(*items):
        inner = ", ".join(f"'{i}'" for i in items)
        return f"array({inner})" if array == "array" else f"[{inner}]"
    return f"""'e' || CAST(event_id AS {string}) AS id,
  CASE WHEN event_id % 7 = 0 THEN '  ' WHEN event_id % 3 = 0
    THEN 'Confirmed  water over the road, verified by crews ' || repeat('and more detail ', 14)
    ELSE 'Water around a house ' || CAST(event_id AS {string}) END AS alt_text,
  event_id % 3 <> 1 AS hazard_visible,
  CASE event_id % 4 WHEN 0 THEN 'flood' WHEN 1 THEN 'tsunami' WHEN 2 THEN 'storm' END AS hazard,
  CASE event_id % 3 WHEN 0 THEN 'damage' WHEN 1 THEN 'access_blocked' ELSE 'gossip' END AS category,
  CASE event_id % 3 WHEN 0 THEN {arr('road', 'castle', 'house')} WHEN 1 THEN {arr('castle')} ELSE {arr('vehicle')} END AS submerged,
  CASE event_id % 3 WHEN 0 THEN 'knee' ELSE 'very deep' END AS water_depth,
  CASE event_id % 4 WHEN 0 THEN CAST(1.4 AS DOUBLE) WHEN 1 THEN CAST(-0.2 AS DOUBLE) ELSE CAST(event_id % 100 AS DOUBLE) / 100 END AS confidence,
  CASE WHEN event_id % 6 = 0 THEN '' ELSE 'caption ' || CAST(event_id AS {string}) END AS caption,
  CASE WHEN event_id % 10 = 2 THEN ' roads closed in Calgary ' ELSE ' ' END AS ocr_text"""


IMAGE_SQL = f"SELECT {_image_columns('VARCHAR', 'list')} FROM events WHERE {_IMAGE_ROWS}"

QUESTION_FORMS = ["How many posts mention {p}?", "Which roads or bridges are reported closed in {p}?",
                  "What do people need most right now?"]


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions about the posts, one per benchmark item, and the benchmark texts themselves."""
    b = table(spark, sf_dir, "benchmark")
    asked = b.selectExpr("item_id AS qid", f"replace({_pick(QUESTION_FORMS, 'item_id % 3')}, '{{p}}', {_pick(PLACES, 'item_id % 12')}) AS question")
    return asked.unionByName(b.selectExpr("item_id + 1000000 AS qid", "text AS question"))


QUESTIONS_SQL = f"""SELECT item_id AS qid, replace({_pick(QUESTION_FORMS, 'item_id % 3')}, '{{p}}', {_pick(PLACES, 'item_id % 12')}) AS question FROM benchmark
UNION ALL SELECT item_id + 1000000, text FROM benchmark"""

_LEDGER = """event_id AS pos,
  CASE WHEN event_id BETWEEN 6000 AND 6034 THEN 429 WHEN event_id % 17 = 3 THEN 429 WHEN event_id = 9000 THEN 402 ELSE 200 END AS status,
  CAST(0.00004 AS DOUBLE) AS cost, event_id % 50 = 7 AS own_key, ts"""
LEDGER_SQL = f"SELECT {_LEDGER} FROM events"


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model calls in candidate order, with scattered failures, one long run of them, and a refusal."""
    return table(spark, sf_dir, "events").selectExpr(*_split(_LEDGER))


_IMAGE_META = """'e' || CAST(event_id AS {string}) AS id,
  CASE WHEN event_id % 4 = 0 THEN CAST(0 AS DOUBLE) ELSE 50 + CAST(event_id % 100 AS DOUBLE) / 100 END AS lat,
  CASE WHEN event_id % 4 = 0 THEN CAST(0 AS DOUBLE) ELSE -113 + CAST(event_id % 60 AS DOUBLE) / 100 END AS lon,
  'meta ' || CAST(event_id AS {string}) AS ts"""
IMAGE_META_SQL = f"SELECT {_IMAGE_META.format(string='VARCHAR')} FROM events WHERE event_id % 3 <> 0"


def image_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_id % 3 <> 0").selectExpr(*_split(_IMAGE_META.format(string="STRING")))


def image_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth event as a photo without text."""
    e = widen(table(spark, sf_dir, "events").where("event_id % 5 IN (2, 3)").select("event_id", "event_type"))
    return e.selectExpr(*_split(_IMAGE_POSTS.format(string="STRING")))


_IMAGE_POSTS = """event_id AS seq, 'e' || CAST(event_id AS {string}) AS id, '' AS text,
  'img/' || CAST(event_id AS {string}) || '.jpg' AS image_ref,
  CASE WHEN event_type = 'view' THEN 'own time' END AS ts"""
IMAGE_POSTS_SQL = f"SELECT {_IMAGE_POSTS.format(string='VARCHAR')} FROM events WHERE event_id % 5 IN (2, 3)"
