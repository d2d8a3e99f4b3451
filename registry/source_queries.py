"""Ingest queries. Files are first written by Spark from the sample posts, then read back."""

from pyspark.sql import functions as F

from postsieve import values as V
from postsieve.functions import text as T
from postsieve.functions.regex import re2
from postsieve.operators import dedupe, geo
from postsieve.session import scratch_path
from postsieve.sources import csv_posts, files, links
from postsieve.sources.gazetteer import GAZETTEER_SCHEMA, merge_gazetteer, default_gazetteer
from registry import views
from registry.core import query
from registry.dedupe_queries import kept_sql
from registry.geo_sql import gazetteer_sql, ok_sql
from registry.text_queries import norm_sql, q
from registry.views import posts_sql, with_sql

_BLANK = "CASE WHEN seq % 100 = 7 THEN '  ' ELSE text END"


def _upload(spark, sf, sep=",", name="Tweet Text", time="Posted At"):
    """Posts as an upload in several parts, with an awkward header, blank texts and quoted separators."""
    path = scratch_path(spark, "upload")
    p = views.posts(spark, sf).selectExpr("seq AS `Nr`", f"{_BLANK} AS `{name}`", "lat AS `Lat`", "lon AS `Geo-Lon`", "author AS `User Name`", f"ts AS `{time}`")
    p.write.option("header", True).option("sep", sep).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


UP = {"posts": posts_sql(), "up": f"SELECT *, trim({_BLANK}) AS t FROM posts"}
UP_COLS = f"t AS text, CASE WHEN {ok_sql()} THEN lat END AS lat, CASE WHEN {ok_sql()} THEN lon END AS lon, author, ts"


@query("s1_read_csv", with_sql(f"SELECT {UP_COLS} FROM up WHERE t <> ''", **UP))
def s1(spark, sf):
    posts, _, _ = csv_posts.read_parts(spark, _upload(spark, sf))
    return posts.select("text", "lat", "lon", "author", "ts")


@query("s1_read_semicolons", with_sql(f"SELECT {UP_COLS} FROM up WHERE t <> ''", **UP))
def s1_semi(spark, sf):
    posts, _, _ = csv_posts.read_parts(spark, _upload(spark, sf, ";"))
    return posts.select("text", "lat", "lon", "author", "ts")


NEXT = 'and on "the" next line, too'


def _mixed_folder(spark, sf):
    """Four kinds of files: three orders of columns, one of them with line ends inside quotes and one without times, and one without text."""
    root, p = scratch_path(spark, "mixed"), views.posts(spark, sf).withColumn("more", F.concat("text", F.lit("\n" + NEXT)))
    kinds = {"a": "seq AS `Nr`, text AS `Tweet Text`, lat AS `Lat`, lon AS `Geo-Lon`, author AS `User Name`, ts AS `Posted At`",
             "b": "ts AS `Posted At`, more AS `tweet text`, author AS `User Name`, lat AS `Lat`, lon AS `Geo-Lon`",
             "c": "lon AS `Longitude`, author AS `User Name`, text AS `Message`, lat AS `Latitude`", "d": "seq AS `Nr`, author AS `User Name`"}
    for k, (name, columns) in enumerate(kinds.items()):
        rows = p.where(F.col("seq") % 4 == k).selectExpr(*views._split(columns))
        rows.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{root}/{name}")
    return root + "/*"


MIXED = {"posts": posts_sql(), "up": f"SELECT *, CASE WHEN seq % 4 = 1 THEN text || chr(10) || '{NEXT}' ELSE text END AS t FROM posts WHERE seq % 4 <> 3"}


@query("s1_mixed_headers", with_sql(f"SELECT t AS text, CASE WHEN {ok_sql()} THEN lat END AS lat, CASE WHEN {ok_sql()} THEN lon END AS lon, author, CASE WHEN seq % 4 <> 2 THEN ts END AS ts FROM up", **MIXED))
def s1_mixed(spark, sf):
    """A folder whose files differ in columns, their order and line ends inside quotes."""
    posts, _, _ = csv_posts.read_parts(spark, _mixed_folder(spark, sf))
    return posts.select("text", "lat", "lon", "author", "ts")


@query("s5_foreign_header", with_sql("""SELECT 'column "Tweet Text" is not in this file''s header' AS reason, count(*) AS n FROM posts WHERE seq % 4 = 3""", posts=posts_sql()))
def s5_foreign(spark, sf):
    _, rejects, _ = csv_posts.read_parts(spark, _mixed_folder(spark, sf))
    return rejects.groupBy("reason").agg(F.count("*").alias("n"))


@query("s3_infer_text_column", with_sql("SELECT count(*) AS n, 'Notes' AS chosen FROM up WHERE t <> ''", **UP))
def s3(spark, sf):
    posts, _, report = csv_posts.read_parts(spark, _upload(spark, sf, name="Notes", time="Date"))
    return posts.agg(F.count("*").alias("n")).withColumn("chosen", F.lit(report.chosen_column))


@query("s5_rejects", with_sql("""SELECT 'column "Tweet Text" was empty' AS reason, count(*) AS n FROM up WHERE t = ''""", **UP))
def s5(spark, sf):
    _, rejects, _ = csv_posts.read_parts(spark, _upload(spark, sf))
    return rejects.groupBy("reason").agg(F.count("*").alias("n"))


@query("s5_ragged_rows", with_sql("SELECT 'Too many fields: expected 3 fields but parsed 4' AS reason, count(*) AS n FROM posts WHERE seq % 50 = 3 UNION ALL SELECT 'Too few fields: expected 3 fields but parsed 2', count(*) FROM posts WHERE seq % 50 = 4", posts=posts_sql()))
def s5_ragged(spark, sf):
    """Rows with a field too many, behind a long quoted cell, and rows with one too few; each part has its header."""
    path, seq = scratch_path(spark, "ragged"), F.col("seq").cast("string")
    cell = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    line = (F.when(F.col("seq") % 50 == 3, F.concat(seq, F.lit(',"'), F.repeat(F.lit('wörd, ""x"" '), 900), F.lit('",y,extra')))
            .when(F.col("seq") % 50 == 4, F.concat(seq, F.lit(","), cell)).otherwise(F.concat(seq, F.lit(","), cell, F.lit(",y"))))
    first = F.monotonically_increasing_id() % F.lit(1 << 33) == 0
    views.posts(spark, sf).select(F.when(first, F.concat(F.lit("Nr,text,c\n"), line)).otherwise(line).alias("value")).write.text(path)
    _, rejects, _ = csv_posts.read_parts(spark, path)
    return rejects.groupBy("reason").agg(F.count("*").alias("n"))


@query("s6_coordinates", with_sql(f"SELECT seq, {ok_sql()} AS accepted FROM posts", posts=posts_sql()))
def s6(spark, sf):
    return views.posts(spark, sf).select("seq", geo.accepted_coordinates(F.col("lat"), F.col("lon")).alias("accepted"))


@query("s7_pasted_lines", f"SELECT doc_id, CAST(pos - 1 AS BIGINT) AS pos, text FROM (SELECT doc_id, regexp_replace(unnest(l), {q(r'^\s+|\s+$')}, '', 'g') AS text, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, regexp_split_to_array(text, '\\r?\\n') AS l FROM documents)) WHERE text <> ''")
def s7(spark, sf):
    d = views.table(spark, sf, "documents").select("doc_id", "text")
    return csv_posts.split_pasted(d).select("doc_id", F.col("pos").cast("long").alias("pos"), "text")


@query("s8_record_defaults", with_sql(
    f"""SELECT t AS text, 'csv' AS source, CASE WHEN {ok_sql()} THEN 'Provided coordinates' END AS place, CASE WHEN {ok_sql()} THEN CAST(1 AS DOUBLE) END AS confidence,
        'manual' AS fetch_method FROM up WHERE t <> ''""", **UP))
def s8(spark, sf):
    posts, _, _ = csv_posts.read_parts(spark, _upload(spark, sf))
    given = posts.lat.isNotNull()
    from postsieve.sources.gazetteer import Places
    p = geo.provided_place(F.col("lat"), F.col("lon"), Places.of())
    return posts.select("text", "source", F.when(given, p["name"]).alias("place"), F.when(given, p["confidence"]).alias("confidence"), "fetch_method")


@query("s9_read_parts", with_sql(f"SELECT count(*) AS n, count(*) AS ids FROM up WHERE t <> ''", **UP))
def s9(spark, sf):
    """Ids stay unique over all parts."""
    posts, _, _ = csv_posts.read_parts(spark, _upload(spark, sf))
    return posts.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


@query("s9_merged_upload", with_sql("SELECT CAST(sum(duplicate_count) AS BIGINT) AS rows, count(*) AS kept FROM k", **UP,
       k=kept_sql("(SELECT seq, t AS text FROM up WHERE t <> '')", norm_sql)))
def s9_merged(spark, sf):
    posts, _, _ = csv_posts.read_parts(spark, _upload(spark, sf))
    m = dedupe.collapse_exact(posts, strip_retweets=False)
    return m.agg(F.sum("duplicate_count").alias("rows"), F.count("*").alias("kept"))


_LINE = {"spark": "concat('é ', regexp_replace(regexp_replace(text, '[\\\\r\\\\n\"\\\\\\\\]+', ' '), '[^\\\\x00-\\\\x7F\\\\xA0-\\\\xFF]', '?'))",
         "sql": "'é ' || regexp_replace(regexp_replace(text, '[\\r\\n\"\\\\]+', ' ', 'g'), '[^\\x00-\\x7F\\xA0-\\xFF]', '?', 'g')"}
_AUDITED = [("UTF-8", "utf-8", "certain"), ("UTF-16LE", "utf-16le", "guessed"), ("UTF-16", "utf-16be", "certain"), ("ISO-8859-1", "windows-1252", "guessed")]  # equal but for 80 to 9F, which the lines do not hold


@query("s11_audit_files", "SELECT ['utf-8', 'utf-16le', 'utf-16be', 'windows-1252'][doc_id % 4 + 1] AS encoding, ['certain', 'guessed', 'certain', 'guessed'][doc_id % 4 + 1] AS confidence, "
       f"CAST(sum(length(line) + 1) AS BIGINT) AS chars, CAST(sum(length(line) - length(replace(line, 'e', ''))) AS BIGINT) AS es FROM (SELECT doc_id, {_LINE['sql']} AS line FROM documents) GROUP BY 1, 2")
def s11(spark, sf):
    """Texts written in four encodings, told apart and read back by ranges of 64 kB."""
    root = scratch_path(spark, "texts")
    texts = views.widen(views.table(spark, sf, "documents").selectExpr("doc_id", _LINE["spark"] + " AS line"))
    for k, (charset, _, _) in enumerate(_AUDITED):
        texts.where(F.col("doc_id") % 4 == k).select("line").write.options(encoding=charset, sep="\u0001", quote="\u0000", escape="\u0000", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(f"{root}/{k}")
    a = files.audit_files(spark, root + "/*/*.csv", 1 << 16)
    return a.groupBy("encoding", "confidence").agg(F.sum(F.length("text")).cast("long").alias("chars"), F.sum(F.length("text") - F.length(F.replace("text", F.lit("e"), F.lit("")))).cast("long").alias("es"))


@query("s12_image_rows_kept", with_sql(
    "SELECT (SELECT count(*) FROM k) + (SELECT count(*) FROM imgs) AS n, (SELECT count(*) FROM imgs) AS images", posts=posts_sql(), k=kept_sql(), imgs=views.IMAGE_POSTS_SQL))
def s12(spark, sf):
    p = views.posts(spark, sf).select("seq", "id", "text", F.lit(None).cast("string").alias("image_ref"), "ts")
    both = p.unionByName(views.image_posts(spark, sf).select("seq", "id", "text", "image_ref", "ts"))
    return dedupe.collapse_with_images(both).agg(F.count("*").alias("n"), F.count("image_ref").alias("images"))


_HOST = r"lower(regexp_extract(url, '(?i)^(https?)://(?:[^/?#@]*@)?(\[[^\]/?#]+\]|[^\[\]/?#:\s]+)', 2))"
_DOM = lambda d: f"(host = '{d}' OR ends_with(host, '.{d}'))"
TRIAGE = f"""SELECT url_id, url, CASE WHEN bad OR priv THEN 'invalid' WHEN hard IS NOT NULL THEN 'blocked' ELSE 'ok' END AS outcome,
  CASE WHEN bad OR priv OR hard IS NOT NULL THEN NULL WHEN img THEN 'image' WHEN {_DOM('x.com')} OR {_DOM('twitter.com')} THEN 'x' WHEN {_DOM('bsky.app')} THEN 'bluesky'
    WHEN status <> '' THEN 'mastodon' ELSE 'generic' END AS route,
  CASE WHEN bad THEN 'not an absolute http or https link' WHEN priv THEN 'private or local address' ELSE hard END AS reason,
  CASE WHEN {_DOM('bsky.app')} THEN regexp_extract(url, '/profile/[^/]+/post/([^/?#]+)', 1) WHEN status <> '' AND NOT {_DOM('x.com')} THEN status END AS post_key
  FROM (SELECT *, {_HOST} AS host, NOT regexp_matches(url, '(?i)^https?://') AS bad, {_HOST} IN ('127.0.0.1', '10.0.0.8', '[fe80::1]') AS priv,
    CASE WHEN contains(url, 'reddit.com/') THEN 'reddit_blocked' WHEN contains(url, 'facebook.com/') THEN 'facebook_blocked' END AS hard,
    regexp_matches(url, '(?i)\\.(jpe?g|png|webp|gif|heic)([?#]|$)') AS img,
    CASE WHEN regexp_matches(url, '/@[^/]+/[0-9]+/?$') THEN regexp_extract(url, '/@[^/]+/([0-9]+)/?$', 1) ELSE regexp_extract(url, '/users/[^/]+/statuses/([0-9]+)/?$', 1) END AS status FROM u)"""


@query("s13_url_triage", with_sql(TRIAGE, u=views.URLS_SQL))
def s13(spark, sf):
    return links.triage_urls(views.urls(spark, sf)).select("url_id", "url", "outcome", "route", "reason", "post_key")


@query("s13_page_urls", "SELECT page_id, 'ok' AS outcome, 'generic' AS route FROM pages")
def s13_pages(spark, sf):
    return links.triage_urls(views.table(spark, sf, "pages").select("page_id", "url")).select("page_id", "outcome", "route")


def unescape_sql(x):
    for n, c in V.NAMED_ENTITIES[1:] + V.NAMED_ENTITIES[:1]:
        x = "replace({}, '&{};', '{}')".format(x, n, c.replace("'", "''"))
    return x


def readable_sql():
    c = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
    for t in V.STRIPPED_TAGS:
        c = f"regexp_replace({c}, '(?is)<{t}\\b[^>]*>.*?</{t}>', '', 'g')"
    body = "regexp_replace(" + unescape_sql("regexp_replace(regexp_extract(c, '(?is)<article\\b[^>]*>(.*?)</article>', 1), '<[^>]*>', '', 'g')") + ", '[ \\t]+', ' ', 'g')"
    body = f"regexp_replace(regexp_replace({body}, {q(r'\n\s*\n\s*')}, chr(10) || chr(10), 'g'), {q(r'^\s+|\s+$')}, '', 'g')"
    return f"SELECT page_id, {body} AS text FROM (SELECT page_id, {c} AS c FROM pages)"


@query("s14_page_text", readable_sql())
def s14(spark, sf):
    p = views.widen(views.table(spark, sf, "pages").select("page_id", "url", "html"))
    return links.pages_to_posts(p).select(F.col("seq").alias("page_id"), "text")


@query("s15_embedded_text", f"""SELECT page_id, regexp_replace({unescape_sql("regexp_replace(regexp_replace(regexp_extract(html, '(?is)<p\\b[^>]*>(.*?)</p>', 1), '(?i)<br\\s*/?>', chr(10), 'g'), '<[^>]*>', '', 'g')")}, {q(r'^\s+|\s+$')}, '', 'g') AS text
  FROM pages WHERE regexp_matches(html, '(?is)<p\\b[^>]*>.*?</p>')""")
def s15(spark, sf):
    p = views.widen(views.table(spark, sf, "pages").select("page_id", "html"))
    return p.select("page_id", links.embedded_text(F.col("html")).alias("text")).where("text is not null")


@query("s15_status_text", f"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace({unescape_sql("regexp_replace(regexp_replace(regexp_replace(html, '(?i)<br\\s*/?>', chr(10), 'g'), '(?i)</p>', chr(10) || chr(10), 'g'), '<[^>]*>', '', 'g')")},
  '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), {q(r'^\s+|\s+$')}, '', 'g') AS text FROM pages""")
def s15_status(spark, sf):
    p = views.widen(views.table(spark, sf, "pages").select("page_id", "html"))
    return p.select("page_id", links.status_text(F.col("html")).alias("text"))


@query("s16_distinct_urls", with_sql("SELECT DISTINCT url FROM u", u=views.URLS_SQL))
def s16(spark, sf):
    return links.distinct_urls(views.urls(spark, sf)).select("url")


_NEW = """'Town ' || CAST(user_id % 50 AS {s}) AS name, CAST(event_id % 200 AS DOUBLE) AS lat, CAST(event_id % 170 AS DOUBLE) AS lon, event_id AS o"""


@query("s18_merge_gazetteer", with_sql(
    """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN lat > 90 THEN 'bad coordinates' WHEN name IN (SELECT name FROM gaz) THEN 'already present'
       WHEN o <> min(o) FILTER (lat <= 90) OVER (PARTITION BY name) THEN 'repeated in the new places' ELSE 'added' END AS reason FROM new) GROUP BY reason""",
    gaz=gazetteer_sql(), new=f"SELECT {_NEW.format(s='VARCHAR')} FROM events UNION ALL SELECT 'Calgary, AB', 51, -114, -1 FROM events WHERE event_id = 0"))
def s18(spark, sf):
    new = views.table(spark, sf, "events").selectExpr(*views._split(_NEW.format(s="STRING")))
    extra = views.table(spark, sf, "events").where("event_id = 0").selectExpr("'Calgary, AB' AS name", "CAST(51 AS DOUBLE) AS lat", "CAST(-114 AS DOUBLE) AS lon", "CAST(-1 AS BIGINT) AS o")
    new = new.unionByName(extra).selectExpr("CAST(o AS INT) AS ord", "name", "array(lower(name)) AS aliases", "lat", "lon", "'town' AS kind", "'' AS admin", "'CA' AS country",
                         "CAST(NULL AS BIGINT) AS population", "false AS is_first_nation", "CAST(NULL AS STRING) AS community")
    base = default_gazetteer(spark)
    merged, refused = merge_gazetteer(base, new)
    added = merged.join(base.select("name"), "name", "left_anti").select(F.lit("added").alias("reason"))
    return refused.select("reason").unionByName(added).groupBy("reason").agg(F.count("*").alias("n"))
