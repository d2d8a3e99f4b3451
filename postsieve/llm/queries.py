"""One query per operator, with production parameters, over whole tables; SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) = 1 THEN ws[1] ELSE ws[i] || ' ' || ws[i + 1] END AS s
  FROM w, unnest(range(1, CASE WHEN len(ws) = 1 THEN 2 ELSE len(ws) END)) AS u(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * m >= 80 * (na.n + nb.n - m)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, x.b FROM reach r JOIN both_ways x ON r.b = x.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id
"""


@query("op3_near_duplicates", NEAR_SQL)
def near(spark, sf_dir):
    from postsieve.llm.near_dedup import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [3.0::DOUBLE, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT + 1] AS weight FROM d GROUP BY source),
c AS (SELECT *, source_size * 2.0::DOUBLE AS cap FROM s),
f AS (SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS step FROM c),
t AS (SELECT source, source_size, least(cap, max(step) OVER () * weight) AS target FROM f),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs, CASE WHEN source_size > 0 THEN floor(target)::BIGINT % source_size ELSE 0 END AS rest FROM t),
o AS (SELECT doc_id, size, source, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d)
SELECT doc_id, size::BIGINT AS size, source_size, target, (epochs * size + least(size, greatest(0, rest - start)))::BIGINT AS taken
FROM o JOIN g ON o.source IS NOT DISTINCT FROM g.source
"""


@query("op6_source_mix", MIX_SQL)
def source_mix(spark, sf_dir):
    from postsieve.llm.mixing import mix
    return mix(table(spark, sf_dir, "documents"))


@query("op7_vector_packing")
def vector_packing(spark, sf_dir):
    from postsieve.llm.sharding import assign_shards
    return assign_shards(table(spark, sf_dir, "documents"), shards=40)


CONTAINED_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM benchmark WHERE text IS NOT NULL),
si AS (SELECT DISTINCT item_id, least(5, len(ws)) AS k, array_to_string(ws[j:j + least(5, len(ws)) - 1], ' ') AS s FROM i, unnest(range(1, len(ws) - least(5, len(ws)) + 2)) AS u(j) WHERE len(ws) > 0),
sd AS (SELECT DISTINCT doc_id, k, array_to_string(ws[j:j + k - 1], ' ') AS s FROM d, (SELECT DISTINCT k FROM si), unnest(range(1, len(ws) - k + 2)) AS u(j)),
m AS (SELECT item_id, count(*) AS item_shingles FROM si GROUP BY item_id)
SELECT doc_id, item_id, any_value(item_shingles) AS item_shingles, count(*) AS shared
FROM sd JOIN si USING (k, s) JOIN m USING (item_id) GROUP BY doc_id, item_id HAVING 100 * count(*) >= 80 * any_value(item_shingles)
"""


@query("op8_decontamination", CONTAINED_SQL)
def decontamination(spark, sf_dir):
    from postsieve.llm.decontaminate import contaminated
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=5, percent=80)


REPEATS_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM d, unnest(range(1, len(ws) - 33)) AS u(i)),
r AS (SELECT doc_id, i FROM w JOIN (SELECT h FROM w GROUP BY h HAVING count(*) > 1) USING (h)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM r),
g AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(ws[j], ' ' ORDER BY j) AS kept FROM d, unnest(range(1, len(ws) + 1)) AS u(j) WHERE (doc_id, j) NOT IN (SELECT doc_id, j FROM gone) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)
"""


@query("op5_repeated_passages", REPEATS_SQL)
def repeats(spark, sf_dir):
    from postsieve.llm.substring_dedup import repeated_passages
    return repeated_passages(table(spark, sf_dir, "documents"), window=35).drop("spans")


@query("op9_quality")
def quality_scores(spark, sf_dir):
    from postsieve.llm.quality import quality
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_nearest")
def nearest_vectors(spark, sf_dir):
    from postsieve.llm.neighbours import nearest
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def url_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")], "host string, path string, verdict string")


URL_SQL = r"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path FROM pages),
r(h, start, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block'))
SELECT page_id, host, path, max_by(h || start, length(h || start)) AS rule, coalesce(max_by(verdict, length(h || start)), 'allow') AS verdict
FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, start) GROUP BY page_id, host, path
"""


@query("op1_url_rules", URL_SQL)
def url_verdicts(spark, sf_dir):
    from postsieve.llm.url_filter import judge_urls
    return judge_urls(table(spark, sf_dir, "pages"), url_rules(spark))


@query("op2_role_repair")
def role_repair(spark, sf_dir):
    from postsieve.llm.chat_roles import repair
    return repair(table(spark, sf_dir, "conversations"))


VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@query("op4_token_counts")
def token_counts(spark, sf_dir):
    from postsieve.llm.token_counts import count_tokens
    return count_tokens(table(spark, sf_dir, "documents"), VOCABULARY, fields=("source", "lang", "text"), rule="start")


SEARCH_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
d AS (SELECT r, doc_id, ts, len(ts)::BIGINT AS n FROM t WHERE len(ts) > 0),
a AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM d),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
o AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ts) AS term FROM d) JOIN (SELECT DISTINCT term FROM i) USING (term) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM o, a GROUP BY term, docs),
s AS (
  SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // words))))::BIGINT AS score
  FROM o JOIN d USING (r) JOIN w USING (term) JOIN i USING (term), a GROUP BY item_id, r, doc_id),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM k WHERE rank <= 10
"""


@query("op11_ranked_search", SEARCH_SQL)
def ranked_search(spark, sf_dir):
    from postsieve.llm.ranked_search import search
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def _cluster_sql(clusters: int, rounds: int, size: int, scale: int, seed: int) -> str:
    far = "SELECT e.r, k, sum((e.x - c.x) * (e.x - c.x))::BIGINT AS d FROM e JOIN c{n} c USING (j) GROUP BY e.r, k"
    steps = "".join(f""",
a{n} AS (SELECT r, (min(d * {clusters} + k) % {clusters})::INT AS k FROM ({far.format(n=n)}) GROUP BY r),
m{n} AS (SELECT k, j, sum(x)::BIGINT AS s, count(*)::BIGINT AS n FROM e JOIN a{n} USING (r) GROUP BY k, j),
c{n + 1} AS (SELECT k, j, coalesce((s - ((s % n) + n) % n) // n, x)::BIGINT AS x FROM c{n} LEFT JOIN m{n} USING (k, j))""" for n in range(rounds))
    return f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
g AS (SELECT r, vec_id, list_transform(v, lambda x: floor({scale} * x)::BIGINT) AS v FROM v WHERE len(v) = {size} AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT r, unnest(range(1, {size + 1})) AS j, unnest(v) AS x FROM g),
f AS (SELECT r, (row_number() OVER (ORDER BY sha256('{seed}:' || vec_id::VARCHAR), v) - 1)::INT AS k FROM g),
c0 AS (SELECT k, j, x FROM e JOIN f USING (r) WHERE k < {clusters}){steps},
z AS (SELECT r, min(d * {clusters} + k) AS t FROM ({far.format(n=rounds)}) GROUP BY r),
o AS (SELECT r, vec_id, (t % {clusters})::INT AS cluster, (t // {clusters})::BIGINT AS distance FROM z JOIN g USING (r)),
h AS (SELECT k AS cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY j)) AS centroid_sha256 FROM c{rounds} GROUP BY k)
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM o JOIN h USING (cluster)
"""


@query("op12_centroids", _cluster_sql(8, 10, 64, 1024, 3))
def centroids(spark, sf_dir):
    from postsieve.llm.centroids import cluster
    return cluster(table(spark, sf_dir, "embeddings"), clusters=8, rounds=10, size=64, scale=1024, seed=3)


NEAR_VECTORS_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
u AS (SELECT * FROM v WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
e AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
  WHERE list_cosine_similarity(x.v, y.v) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
n AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT v.vec_id, coalesce(any_value(n_links), 0)::BIGINT AS n_links, min(r.b) AS component_id, v.vec_id = min(r.b) AS kept
FROM v JOIN reach r ON r.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id GROUP BY v.vec_id
"""


@query("op13_near_vectors", NEAR_VECTORS_SQL)
def near_vector_rows(spark, sf_dir):
    from postsieve.llm.vector_dedup import near_vectors
    return near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.98)
