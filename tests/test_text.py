import pytest
from pyspark.sql import functions as F

from postsieve.functions import text as T
from postsieve.functions.regex import java, re2


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("r")).first()["r"]


@pytest.mark.parametrize("raw,want", [
    ("Flood! http://t.co/x @you #YYCflood_2", "flood yycflood 2"), ("  ", ""), ("Été à Nice", "t nice"), ("a b http://x y", "a b y"),
])
def test_normalize(spark, raw, want):
    assert one(spark, raw, T.normalize) == want


def test_tokens_keep_repeats_and_drop_stop_words(spark):
    assert one(spark, "The river, the river is up", T.tokenize) == ["river", "river"]


@pytest.mark.parametrize("raw,want", [
    ("call 403-555-0199 now", "call [phone redacted] now"), ("x9403-555-0199", "x9403-555-0199"),
    ("mail a.b+c@ex-ample.org ok", "mail [email redacted] ok"), ("at 123 Main Street,", "at [address redacted],"), ("été 403 555 0199", "été [phone redacted]"),
])
def test_redact(spark, raw, want):
    assert one(spark, raw, T.redact) == want


def test_boundaries_are_ascii(spark):
    assert one(spark, "été", lambda c: T.matches(c, r"\bt")) is True
    assert java(r"[\s-]x\S") != re2(r"\b") and re2(r"a\b") == r"a\b"


@pytest.mark.parametrize("raw,n,want", [("one two three", 9, "one two"), ("abcdefghij", 4, "abcd"), ("ab cd", 5, "ab cd"), (" abcdef", 4, " abc")])
def test_truncate_words(spark, raw, n, want):
    assert one(spark, raw, lambda c: T.truncate_words(c, n)) == want


def test_snippet_may_exceed_by_two(spark):
    assert one(spark, "aaaa bbbb http://x cccc", lambda c: T.snippet(c, 8)) == "aaaa bb..."


@pytest.mark.parametrize("raw,want", [("=1+1", "'=1+1"), ('say "hi", x', '"say ""hi"", x"'), ("-a,b", "\"'-a,b\""), ("plain", "plain"), ("a\nb", '"a\nb"')])
def test_csv_cell(spark, raw, want):
    assert one(spark, raw, T.csv_cell) == want


def test_numbers_and_number_text(spark):
    assert one(spark, "1,200.50 of 3. and 4", T.numbers) == ["1,200.50", "3", "4"]
    assert one(spark, "x", lambda c: T.number_text(F.lit(51.0))) == "51"


def test_canonical_composes(spark):
    assert one(spark, " é  x ", T.canonical) == "é x"


def test_phrase_matcher(spark):
    assert one(spark, "x High   River.", lambda c: T.mentions(c, ["high river"])) is True
    assert one(spark, "highriver", lambda c: T.mentions(c, ["high river"])) is False
    assert one(spark, "a+b", lambda c: T.mentions(c, ["a+b"])) is True
