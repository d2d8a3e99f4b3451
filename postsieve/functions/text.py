"""Text functions. Each takes and returns Columns; none needs Python workers except NFC on non-ASCII text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from postsieve import values as V
from postsieve.functions.regex import java

SPACES = java(r"\s+")
_URL = java(r"https?://\S+")


def matches(col: Column, pattern: str) -> Column:
    return col.rlike(java(pattern))


def collapse(col: Column) -> Column:
    """White space runs become one blank, ends trimmed."""
    return F.trim(F.regexp_replace(col, SPACES, " "))


def trim_all(col: Column) -> Column:
    """Trims every kind of white space, not only blanks."""
    return F.regexp_replace(col, java(r"^\s+|\s+$"), "")


def is_blank(col: Column) -> Column:
    return F.coalesce(~col.rlike(java(r"\S")), F.lit(True))


def normalize(col: Column) -> Column:
    """Lower case words and digits only, links and mentions dropped, hashtag words kept.

    A run of anything else, the hash sign included, is one separator, so a single pass does it.
    """
    lowered = F.regexp_replace(F.lower(col), _URL, " ")
    return F.trim(F.regexp_replace(F.regexp_replace(lowered, java(r"@\w+"), " "), "[^a-z0-9]+", " "))


def is_token(word: Column) -> Column:
    return (F.length(word) > 2) & ~word.isin(V.STOP_WORDS)


def tokens_of(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), is_token)


def tokenize(col: Column) -> Column:
    """Words of the normalised text that are longer than two letters and not stop words."""
    return tokens_of(normalize(col))


def strip_retweet(col: Column) -> Column:
    return F.regexp_replace(col, java(r"(?i)^RT\s+@?\w+:?\s*"), "")


def copy_key(col: Column, strip_retweets: bool = True) -> Column:
    """Two posts are copies when this is equal. Empty means the post has no words."""
    return normalize(strip_retweet(col) if strip_retweets else col)


def redact(col: Column) -> Column:
    for pattern, marker in V.REDACTIONS:
        col = F.regexp_replace(col, java(pattern), marker)
    return col


def snippet(col: Column, limit: int) -> Column:
    """One line excerpt without links. The ellipsis may exceed the limit by two."""
    line = collapse(F.regexp_replace(col, _URL, ""))
    return F.when(F.length(line) <= limit, line).otherwise(
        F.concat(F.rtrim(F.substring(line, 1, limit - 1)), F.lit("...")))


def truncate_words(col: Column, limit: int) -> Column:
    """Cuts at the last blank inside the first ``limit`` characters, or hard when there is none."""
    cut = F.substring(col, 1, limit)
    # length of the part before the last blank; equals length(cut) when there is no blank
    head = F.length(cut) - F.length(F.substring_index(cut, " ", -1)) - 1
    shortened = F.when(head > 0, F.substring(cut, F.lit(1), head)).otherwise(cut)
    return F.when(F.length(col) <= limit, col).otherwise(F.regexp_replace(shortened, java(r"\s+$"), ""))


def short_text(col: Column, limit: int) -> Column:
    return F.when(F.length(col) <= limit, col).otherwise(
        F.concat(truncate_words(col, max(0, limit - 3)), F.lit("...")))


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


def canonical(col: Column, ascii_only: bool = False) -> Column:
    """White space collapsed and Unicode composed. Set ``ascii_only`` to plan no Python at all."""
    if ascii_only:
        return collapse(col)
    # a text of ASCII alone is its own composed form; only the others cross to Python
    return collapse(F.coalesce(_nfc(F.when(col.rlike(r"[^\x00-\x7F]"), col)), col))


def numbers(col: Column) -> Column:
    return F.regexp_extract_all(col, F.lit(r"([0-9][0-9,]*(?:\.[0-9]+)?)"), F.lit(1))


def csv_cell(col: Column) -> Column:
    """Formula prefix made harmless, then quoted when it holds a comma, quote or line end."""
    safe = F.when(col.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), col)).otherwise(col)
    return F.when(safe.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))
                  ).otherwise(safe)


def number_text(col: Column) -> Column:
    """Shortest decimal text: 51.0 reads 51."""
    return F.regexp_replace(col.cast("string"), r"\.0$", "")


def _escape(phrase: str) -> str:
    special = set(r".*+?^${}()|[]\/-")
    return "".join("\\" + c if c in special else c for c in phrase)


def phrase_pattern(phrases: list[str]) -> str:
    """Pattern that finds any of the phrases as whole words."""
    alternatives = "|".join(r"\s+".join(_escape(w) for w in p.lower().split()) for p in phrases)
    return rf"(?i)(?:^|[^a-z0-9])(?:{alternatives})(?:[^a-z0-9]|$)"


def mentions(col: Column, phrases: list[str]) -> Column:
    return matches(col, phrase_pattern(phrases))


def mentions_pattern_column(phrases: Column) -> Column:
    """``phrase_pattern`` for an ``array<string>`` column, for joins of many phrases with many posts."""
    escaped = F.transform(phrases, lambda p: F.regexp_replace(
        F.regexp_replace(F.lower(p), r"([.*+?^${}()|\[\]\\])", r"\\$1"), SPACES, F.lit(r"\\s+")))
    return F.concat(F.lit("(?i)(?:^|[^a-z0-9])(?:"), F.array_join(escaped, "|"), F.lit(")(?:[^a-z0-9]|$)"))
