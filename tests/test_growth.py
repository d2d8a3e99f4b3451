"""Work that must grow in number of tasks and not in their length, and work that must be done once per row."""

import itertools
import re

from pyspark.sql import functions as F

from postsieve import values as V
from postsieve.functions.regex import java
from postsieve.operators import ask, geo, score
from postsieve.operators.position import with_position
from postsieve.sources import csv_posts
from postsieve.streaming import triage_stream as st
from registry import all_sql, pipeline_queries as P, views
from registry.check import compare, connect


class _Slow:
    """A stream that is not done within any time limit but does finish."""

    def awaitTermination(self, timeout=None):
        return None if timeout is None else False

    def stop(self):
        raise AssertionError("stopped before it had taken all its input")


def test_a_long_stream_is_waited_for():
    P._run(_Slow())


def test_a_micro_batch_has_as_many_files_as_its_rows_need(spark, monkeypatch):
    monkeypatch.setattr(P, "ROWS_PER_FILE", 10)
    path, batches = P.scratch_path(spark, "files"), []
    with monkeypatch.context() as m:
        m.setattr(P, "scratch_path", lambda *_: path)
        stream = P._stream_of(spark, spark.range(200), "files")
    P._run(stream.writeStream.foreachBatch(lambda b, _: batches.append(b.count())).option(
        "checkpointLocation", P.scratch_path(spark, "check")).trigger(availableNow=True).start())
    assert len(batches) == 4 and sum(batches) == 200 and len(spark.read.parquet(path).inputFiles()) == 20


def test_rules_try_each_pattern_once_per_text(spark):
    labels = spark.createDataFrame([("flood",)], "text string").select(score.rule_labels(F.col("text"), F.lit(True)).alias("l"))
    plan = labels.selectExpr("l.category", "l.severity", "l.relevant", "l.hazard")._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"RLIKE", plan)) <= len(V.CATEGORY_RULES) + 4


def test_narrow_rows_are_spread_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(views, "ROWS_PER_TASK", 100)
    assert views.widen(spark.range(0, 2000, 1, 8)).rdd.getNumPartitions() == 20
    assert views.widen(spark.range(0, 700, 1, 8)).rdd.getNumPartitions() == 8


def test_the_rows_to_be_ranked_are_worked_out_once(spark):
    tried = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        tried.add(1)
        return x

    rows = spark.range(0, 1000, 1, 4).select("id", counted("id").alias("s"))
    assert with_position(rows, "id", rank="s").where("position = 0").first()["id"] == 999
    assert tried.value == 1000


def test_reasons_of_a_row_come_from_one_pass(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Nr,text,c\n1,"' + 'x ""y"" ' * 50 + '",z,more\n2,\n3,t,u\n')
    _, rejects, _ = csv_posts.read_parts(spark, str(tmp_path))
    assert sorted(r["reason"] for r in rejects.collect()) == [
        'Too few fields: expected 3 fields but parsed 2', 'Too many fields: expected 3 fields but parsed 4', 'column "text" was empty']
    assert rejects._jdf.queryExecution().optimizedPlan().toString().count("from_csv") + rejects._jdf.queryExecution().optimizedPlan().toString().count("csvtostructs") == 1


def test_pairs_of_quotes_change_no_scan(spark):
    rows = [("".join(x), inside) for n in range(6) for x in itertools.product('a,"', repeat=n) for inside in (False, True)]
    df = spark.createDataFrame(rows, "value string, inside boolean")
    scan = F.when(F.col("inside"), csv_posts._scanned(F.col("value"), ",", True)).otherwise(csv_posts._scanned(F.col("value"), ",", False))
    for value, inside, found in df.select("value", "inside", scan.alias("s")).collect():
        assert (found["inside"], found["ends"]) == _scan(value, inside), (value, inside)


def _scan(value, inside):
    """The same, letter by letter and with every quote."""
    state, ends, segment, first = int(inside), 0, "", not inside
    for c in value:
        if c == '"':
            state = 2 if state == 1 else 1 if (state == 2 and not segment) or segment.endswith(",") or (first and not segment) else 0
            segment, first = "", False
        else:
            segment += c
            ends += c == "," and state != 1
    return state == 1, ends


def test_late_answers_in_several_files_a_batch(spark, sf, monkeypatch):
    monkeypatch.setattr(P, "ROWS_PER_FILE", 10)
    note, ok, _ = compare(spark, connect(sf), sf, P.st1_answers, all_sql()["st1_late_answers"])
    assert ok, note


SPACES = "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def test_words_and_white_space_are_predefined_classes(spark):
    assert "A-Z" not in java(r"\b\w[\w.]\b") and "2028" not in java(r"\s\S[^\s]")
    chars = [chr(i) for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000] + ["\U0001F30A", "\U00010400"]
    df = spark.createDataFrame([(c,) for c in chars], "c string")
    for pattern, expected in ((r"\w", lambda c: c.isascii() and (c.isalnum() or c == "_")), (r"[\w.+-]", lambda c: c.isascii() and (c.isalnum() or c in "_.+-")),
                              (r"\s", lambda c: c in SPACES), (r"[-.\s]", lambda c: c in SPACES + "-."), (r"\S", lambda c: c not in SPACES),
                              (r"[^a-z\s]", lambda c: c not in SPACES + "abcdefghijklmnopqrstuvwxyz")):
        found = {r["c"] for r in df.where(F.col("c").rlike("^(?:" + java(pattern) + ")$")).collect()} - {"\n"}
        assert found == {c for c in chars if expected(c)} - {"\n"}, pattern
    edges = df.select("c", F.concat("c", F.lit("a")).rlike(java(r"(?s)^.\ba$")).alias("before"), F.concat(F.lit("a"), "c").rlike(java(r"(?s)^a\b.$")).alias("after"))
    word = lambda c: c.isascii() and (c.isalnum() or c == "_")
    for c, before, after in edges.collect():
        assert before == after == (not word(c)), c


def test_marks_are_set_apart_without_a_class_of_many_parts(spark):
    texts = [("".join(x),) for n in range(5) for x in itertools.product("aZ \t.\u00e9\u00a0", repeat=n)]
    df = spark.createDataFrame(texts, "t string")
    both = df.select("t", ask._spaced(F.col("t")).alias("spaced"), geo._exact_words(F.col("t")).alias("words"))
    for t, spaced, words in both.collect():
        assert spaced == " ".join(re.sub(r"([^a-z0-9\s])", r" \1 ", t.lower()).split()), repr(t)
        assert words == re.sub("[^a-z0-9 ]", " | ", t.lower()).split(" "), repr(t)
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert "[^a-z0-9 ]" not in plan and "2028" not in plan


def test_copies_of_a_stream_are_keyed_once_and_dealt_out_once(spark):
    posts = spark.createDataFrame([(i, f"e{i}", f"post {i % 7}") for i in range(40)], "seq long, id string, text string")
    copies = st.running_copies(posts)
    assert copies._jdf.queryExecution().optimizedPlan().toString().count("https?://") == 1
    path = P.scratch_path(spark, "copies")
    for k, part in enumerate((posts.where("seq < 20"), posts)):
        st.running_copies(part).withColumn("batch_id", F.lit(k).cast("long")).withColumn("since", F.lit("2024-01-01").cast("timestamp")).write.parquet(f"{path}/batch={k:012d}")
    held = st.latest_copies(spark, path)
    assert sorted((r["seq"], r["duplicate_count"]) for r in held.collect()) == [(i, 6 if i < 5 else 5) for i in range(7)]
    assert st.latest_copies(spark, path)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
