import zlib

import numpy as np
import pyarrow as pa

from postsieve.llm import quality as Q

SCHEMA = "doc_id long, text string, quality string, score string, x string"


def test_held_out_accuracy_on_the_given_tables(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet"), spark.read.parquet(f"{sf}/../sf0.01/labels.parquet")
    rows = Q.quality(docs, labels).join(labels, "doc_id").where("held_out AND quality IS NOT NULL").collect()
    right = [r["predicted"] == r["quality"] for r in rows]
    clean = [r["predicted"] for r in rows if r["quality"] == 1]
    assert len(rows) > 50 and np.mean(right) > 0.95 and np.mean(clean) > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_nulls_empties_repeats_and_missing_labels(spark):
    rows = [(1, "Plain words in a row, as they come.", "a", "b", "c"), (1, "Plain words in a row, as they come.", "a", "b", "c"), (None, "$$$ !!!", "a", "b", "c"), (2, None, "a", "b", "c"), (3, "", "a", "b", "c"), (4, "w" * 100_000, "a", "b", "c")]
    docs = spark.createDataFrame(rows, SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = Q.quality(docs, none).collect()
    assert len(out) == 6 and {r["score"] for r in out} == {0.5}
    one = spark.createDataFrame([(1, 1, None), (2, 1, None), (3, 1, None), (4, None, 0)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in Q.quality(docs, one).collect()} == {1.0}
    two = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    many = spark.createDataFrame([(i, ("words and more words " * 9) if i % 2 else "## $$ %% " * 9 + str(i), "a", "b", "c") for i in range(40)] + rows, SCHEMA)
    out = Q.quality(many, two).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    assert len({r["score"] for r in out if r["doc_id"] in (2, 3) and r["predicted"] is not None}) <= 4
    assert Q.quality(docs.limit(0), two).count() == 0


def test_scores_are_log_density_differences():
    r = np.random.default_rng(0)
    x = r.normal(size=(20, len(Q.NAMES)))
    model, want = Q.Model(), []
    for k in (0, 1):
        a = r.normal(size=(len(Q.NAMES),) * 2)
        cov = a @ a.T + np.eye(len(Q.NAMES))
        factor = np.linalg.cholesky(cov)
        mean = r.normal(size=len(Q.NAMES))
        model.classes[k] = mean, factor, 2 * float(np.log(np.diag(factor)).sum()), float(np.log(0.5))
        d = x - mean
        want.append(-0.5 * np.einsum("ni,ij,nj->n", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1])
    assert np.allclose(model.score(x), 1 / (1 + np.exp(want[0] - want[1])))


def test_statistics_count_what_they_say():
    row = dict(zip(Q.NAMES, Q.statistics(pa.array(["Ab $x 12.\nAb $x 12.\n\nq"]))[0]))
    w, chars = 7, 22
    assert np.isclose(row["length"], np.log1p(w)) and np.isclose(row["distinct_words"], np.log((4 + 20) / (w + 20)))
    assert np.isclose(row["symbols"], np.log((2 + 60 * 0.002) / (chars + 60))) and np.isclose(row["upper"], np.log((2 + 60 * 0.02) / (chars + 60)))
    assert np.isclose(row["distinct_lines"], np.log((2 + 5) / (3 + 5))) and np.isclose(row["short_words"], np.log((1 + 60 * 0.03) / (w + 60)))
    assert np.isfinite(Q.statistics(pa.array(["", None, "\n", "é"]))).all()


def test_fit_equals_a_direct_computation(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet"), spark.read.parquet(f"{sf}/../sf0.01/labels.parquet")
    model = Q.fit(Q.features(docs), labels)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    known = [(r["doc_id"], r["quality"]) for r in labels.collect() if r["quality"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5]
    x, y = Q.statistics(pa.array([text[d] for d, _ in known])), np.array([q for _, q in known])
    d = x.shape[1]
    pooled = sum((np.cov(x[y == k].T) * ((y == k).sum() - 1) for k in (0, 1)), np.zeros((d, d))) / (len(y) - 2)
    pooled = (1 - Q.DIAGONAL) * pooled + Q.DIAGONAL * np.diag(np.diag(pooled)) + 1e-6 * np.eye(d)
    for k in (0, 1):
        mean, factor, log_det, prior = model.classes[k]
        cov = (1 - Q.SHRINK) * np.cov(x[y == k].T) + Q.SHRINK * pooled
        assert np.allclose(mean, x[y == k].mean(0)) and np.allclose(factor @ factor.T, cov, rtol=1e-6, atol=1e-9)
        assert np.isclose(log_det, np.linalg.slogdet(cov)[1]) and np.isclose(prior, np.log((y == k).mean()))


def test_accepted_judges_rows_by_their_own_text(spark):
    good, bad = "Plain words in a row, as they come. They go on for a while. ", "## $$ %% @@ "
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    rows = [(i, (good if i % 2 else bad) * 9 + str(i), "a", "b", "c") for i in range(60)]
    rows += [(500, bad * 9, "a", "b", "c"), (500, good * 9, "a", "b", "c"), (500, good * 9, "a", "b", "c"), (None, bad * 9, "a", "b", "c")]
    out = Q.accepted(spark.createDataFrame(rows, SCHEMA), labels)
    assert out.columns == ["doc_id", "text", "quality", "score", "x"]
    kept = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert (500, bad * 9) not in kept and kept.count((500, good * 9)) == 2 and (None, bad * 9) in kept and (1, good * 9 + "1") in kept
    assert all(t.startswith("Plain") for d, t in kept if d is not None)
    assert Q.accepted(spark.createDataFrame([], SCHEMA), labels).count() == 0
