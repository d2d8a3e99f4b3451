"""Text functions over whole documents and posts."""

from pyspark.sql import functions as F

from postsieve import values as V
from postsieve.functions import text as T
from postsieve.functions.regex import re2
from registry import views
from registry.core import query
from registry.views import posts_sql, with_sql


def q(pattern: str) -> str:
    """SQL string literal of a pattern in RE2 form."""
    return "'" + re2(pattern).replace("'", "''") + "'"


def docs(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", "text")


def norm_sql(x: str) -> str:
    steps = [(r"https?://\S+", " "), (r"@\w+", " "), (r"#(\w+)", r" \1 "), (r"[^a-z0-9\s]", " "), (r"\s+", " ")]
    x = f"lower({x})"
    for pattern, by in steps:
        x = f"regexp_replace({x}, {q(pattern)}, '{by}', 'g')"
    return f"trim({x})"


def key_sql(x: str) -> str:
    return norm_sql(f"regexp_replace({x}, {q(r'(?i)^RT\s+@?\w+:?\s*')}, '')")


STOP_SQL = "[" + ", ".join(f"'{w}'" for w in V.STOP_WORDS) + "]"


def tokens_sql(x: str) -> str:
    return f"list_filter(string_split({norm_sql(x)}, ' '), lambda t: length(t) > 2 AND NOT list_contains({STOP_SQL}, t))"


def redact_sql(x: str) -> str:
    for pattern, marker in V.REDACTIONS:
        x = f"regexp_replace({x}, {q(pattern)}, '{marker}', 'g')"
    return x


def line_sql(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, {q(r'https?://\S+')}, '', 'g'), {q(r'\s+')}, ' ', 'g'))"


def snippet_sql(x: str, n: int) -> str:
    line = line_sql(x)
    return f"CASE WHEN length({line}) <= {n} THEN {line} ELSE rtrim(substr({line}, 1, {n - 1})) || '...' END"


def truncate_sql(x: str, n: int) -> str:
    cut = f"substr({x}, 1, {n})"
    space = f"(CASE WHEN instr(reverse({cut}), ' ') > 0 THEN length({cut}) - instr(reverse({cut}), ' ') ELSE -1 END)"
    return (f"CASE WHEN length({x}) <= {n} THEN {x} ELSE regexp_replace(CASE WHEN {space} > 0 "
            f"THEN substr({cut}, 1, {space}) ELSE {cut} END, {q(r'\s+$')}, '') END")


def short_sql(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) <= {n} THEN {x} ELSE ({truncate_sql(x, n - 3)}) || '...' END"


def cell_sql(x: str) -> str:
    safe = f"(CASE WHEN regexp_matches({x}, '^[=+\\-@\\t\\r]') THEN '''' || {x} ELSE {x} END)"
    return f"CASE WHEN regexp_matches({safe}, '[\",\\n\\r]') THEN '\"' || replace({safe}, '\"', '\"\"') || '\"' ELSE {safe} END"


@query("t1_normalize", f"SELECT doc_id, {norm_sql('text')} AS normalized FROM documents")
def t1(spark, sf):
    return docs(spark, sf).select("doc_id", T.normalize(F.col("text")).alias("normalized"))


@query("t2_tokenize", f"SELECT doc_id, len({tokens_sql('text')}) AS n_tokens, array_to_string({tokens_sql('text')}, ' ') AS tokens FROM documents")
def t2(spark, sf):
    d = docs(spark, sf).withColumn("t", T.tokenize(F.col("text")))
    return d.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@query("t3_strip_retweet", with_sql(f"SELECT id, regexp_replace(text, {q(r'(?i)^RT\s+@?\w+:?\s*')}, '') AS body FROM posts", posts=posts_sql()))
def t3(spark, sf):
    return views.posts(spark, sf).select("id", T.strip_retweet(F.col("text")).alias("body"))


@query("t4_redact", f"SELECT doc_id, {redact_sql('text')} AS redacted FROM documents")
def t4(spark, sf):
    return docs(spark, sf).select("doc_id", T.redact(F.col("text")).alias("redacted"))


@query("t6_snippet", f"SELECT doc_id, {snippet_sql('text', 60)} AS snippet FROM documents")
def t6(spark, sf):
    return docs(spark, sf).select("doc_id", T.snippet(F.col("text"), 60).alias("snippet"))


@query("t7_truncate_words", f"SELECT doc_id, {truncate_sql('text', 77)} AS cut FROM documents")
def t7(spark, sf):
    return docs(spark, sf).select("doc_id", T.truncate_words(F.col("text"), 77).alias("cut"))


@query("t8_short_text", f"SELECT doc_id, {short_sql('text', 80)} AS short FROM documents")
def t8(spark, sf):
    return docs(spark, sf).select("doc_id", T.short_text(F.col("text"), 80).alias("short"))


@query("t9_canonical", f"SELECT doc_id, trim(regexp_replace(nfc_normalize(text), {q(r'\s+')}, ' ', 'g')) AS canonical FROM documents")
def t9(spark, sf):
    return docs(spark, sf).select("doc_id", T.canonical(F.col("text")).alias("canonical"))


@query("t10_numbers", r"SELECT doc_id, array_to_string(regexp_extract_all(text, '[0-9][0-9,]*(?:\.[0-9]+)?'), '|') AS numbers FROM documents")
def t10(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(T.numbers(F.col("text")), "|").alias("numbers"))


@query("t13_csv_cell", f"SELECT doc_id, {cell_sql('text')} AS cell FROM documents")
def t13(spark, sf):
    return docs(spark, sf).select("doc_id", T.csv_cell(F.col("text")).alias("cell"))


@query("t14_mentions", with_sql(
    r"SELECT id FROM posts WHERE regexp_matches(text, '(?i)(?:^|[^a-z0-9])(?:high\s+river|highway\s+22|peguis)(?:[^a-z0-9]|$)')",
    posts=posts_sql()))
def t14(spark, sf):
    return views.posts(spark, sf).where(T.mentions(F.col("text"), ["high river", "Highway 22", "peguis"])).select("id")
