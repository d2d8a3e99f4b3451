import hashlib
import re

from pyspark.sql import functions as F

import corpus_pipeline
import __spark_entry__ as entry


def test_registered_with_one_query_per_operator():
    names = [n for n in entry.queries() if re.match(r"op\d+_|pipeline$", n)]
    assert sorted({n.split("_")[0] for n in names}, key=lambda n: int(n[2:]) if n[2:].isdigit() else 99) == [*(f"op{i}" for i in range(1, 14)), "pipeline"]
    assert len(corpus_pipeline.STAGES) == 5


def test_each_stage_works_on_what_its_predecessor_kept(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen[-1], sf)
        out = corpus_pipeline.materialize(out, "test")
        if name != "shards":
            assert out.columns == docs.columns
        seen.append(out)
    ids = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in seen]
    assert all(b <= a for a, b in zip(ids, ids[1:])) and ids[-1]
    items = [re.findall(r"\S+", r["text"].lower()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = {r["doc_id"]: re.findall(r"[^\x20\x09-\x0D]+", r["text"].lower()) for r in seen[3].collect()}
    grams = lambda w: {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    sets = {d: grams(w) for d, w in kept.items()}
    assert not [d for d, s in sets.items() for i in items if grams(i) and 100 * len(grams(i) & s) >= 80 * len(grams(i))]
    near = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert not near
    good = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    lost = (ids[0] - ids[1]) & good
    assert len(lost) <= 0.03 * len(good)
    shards = seen[5].collect()
    assert len(shards) == seen[4].count()
    for k in {r["shard"] for r in shards}:
        assert sorted(r["slot"] for r in shards if r["shard"] == k) == list(range(sum(r["shard"] == k for r in shards)))
    assert hashlib.sha256(str(sorted((r["doc_id"], r["shard"]) for r in shards)).encode()).hexdigest() == hashlib.sha256(str(sorted((r["doc_id"], r["shard"]) for r in corpus_pipeline.STAGES[-1][1](spark, seen[4], sf).collect())).encode()).hexdigest()


def odd_rows(spark, sf):
    """Documents with repeated keys, null keys and texts, and columns whose names operators use themselves."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    extra = ["mark", "row", "kept", "n", "item", "score", "x", "size"]
    first = docs.orderBy("doc_id").limit(3)
    odd = (first.unionByName(first).unionByName(first.withColumn("text", F.concat(F.lit("Quite another text under an old number: "), F.reverse("text"))))
           .unionByName(first.withColumn("doc_id", F.lit(None).cast("long"))).unionByName(first.withColumn("doc_id", F.col("doc_id") + 10**6).withColumn("text", F.lit(None).cast("string")))
           .unionByName(first.withColumn("doc_id", F.col("doc_id") + 2 * 10**6).withColumn("text", F.lit(""))))
    return docs.unionByName(odd).withColumns({c: F.lit(c) for c in extra})


def test_stages_on_odd_rows_and_empty_tables(spark, sf):
    docs = corpus_pipeline.materialize(odd_rows(spark, sf), "odd")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        before = {(r["doc_id"], r["text"]) for r in docs.collect()}
        assert {(r["doc_id"], r["text"]) for r in out.collect()} <= before
        assert stage(spark, docs.limit(0), sf).count() == 0
    shards = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert shards.count() == docs.count() and corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf).count() == 0
    once = corpus_pipeline.keep_one_of_each_group(spark, docs, sf).where("doc_id IS NOT NULL").groupBy("doc_id", "text").count()
    assert once.where("count > 1").count() == 0
    quality = corpus_pipeline.keep_quality(spark, docs, sf)
    assert quality.where("doc_id IS NULL").count() == docs.where("doc_id IS NULL").count()


def test_repeated_keys_lose_no_text_that_nobody_else_has(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    copied = "the quick brown fox jumps over the lazy dog and runs away from the old barn"
    own = "a quiet harbour town keeps its lights on through the long winter nights by the sea"
    docs = spark.createDataFrame([(1, copied, "en", "s", 1), (2, copied, "en", "s", 1), (2, own, "en", "s", 1), (4, own + " again", "en", "t", 1), (4, own + " again", "en", "t", 1)], schema)
    kept = sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.keep_one_of_each_group(spark, docs, sf).collect())
    assert kept == [(1, copied), (2, own)]
    lone = docs.where("doc_id = 4")
    assert [(r["doc_id"], r["text"]) for r in corpus_pipeline.keep_one_of_each_group(spark, lone, sf).collect()] == [(4, own + " again")]
