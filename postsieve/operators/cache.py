"""Paid labels kept by content, so the same text is not paid for twice."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from postsieve import schema as S, values as V
from postsieve.functions import text as T
from postsieve.functions.settle import settle
from postsieve.operators import decide, geo
from postsieve.operators.quantile import order_statistics
from postsieve.session import materialize
from postsieve.sources.gazetteer import Places

CACHE_COLUMNS = ("key string", "labels " + S.LABELS, "classifier string", "model_version string", "redacted_text string", "ts long")
CACHE = ", ".join(CACHE_COLUMNS)


def question_version(questions: Column | str = "", version: str = V.CACHE_VERSION) -> Column:
    """Changes with the wording of the questions, so an edit drops old entries."""
    return F.concat(F.lit(version + ":"), F.sha2(F.lit(questions) if isinstance(questions, str) else questions, 256))


def cache_key(text: Column, hazard: str, questions: str = "", version: str = V.CACHE_VERSION, ascii_only: bool = False) -> Column:
    """Digest of hazard, text (white space and Unicode form evened out) and question version; null for blank text."""
    material = F.concat_ws("|", F.lit(hazard), T.canonical(text, ascii_only), question_version(questions, version))
    return F.when(~T.is_blank(text), F.sha2(material, 256))


def with_key(posts: DataFrame, hazard: str, **kw) -> DataFrame:
    return posts.withColumn("key", settle(cache_key(F.col("text"), hazard, **kw)))


def newest(cache: DataFrame) -> DataFrame:
    """One entry per key: the newest; of equal times the later model version, then the larger digest of the entry."""
    rest = [c for c in cache.columns if c != "key"]
    order = F.struct("ts", F.coalesce("model_version", F.lit("")), F.xxhash64(F.to_json(F.struct(*rest))))
    return cache.groupBy("key").agg(F.max_by(F.struct(*rest), order).alias("e")).select("key", "e.*")  # the key stays as it is, and so does a partitioning by it


def lookup(keyed: DataFrame, cache: DataFrame) -> DataFrame:
    """Every post with its cache entry in ``entry``, null for a miss. Of several entries of one key the newest counts, so a post is one
    row whatever the cache holds. Blank posts have no key and stay out of the join, so they never meet in one task; a hot key is
    copies of one text, which Spark can split."""
    paid = newest(cache.where(F.col("classifier") == V.MODEL_CLASSIFIER))
    entry = paid.select(F.col("key"), F.struct("labels", "model_version", "redacted_text").alias("entry"))
    blank = keyed.where("key IS NULL").withColumn("entry", F.lit(None).cast(entry.schema["entry"].dataType))
    return keyed.where("key IS NOT NULL").join(entry, "key", "left").select(*keyed.columns, "entry").unionByName(blank)


@dataclass(frozen=True)
class CacheTable:
    """A cache kept as a table bucketed by key: a write adds files to the buckets, a read merges them, one entry per key.

    Entries of a key lie in one bucket, so reading, merging and joining them moves no entry; only posts are shuffled. ``compact``
    writes a new version of the table and drops the older one; its entries are then one file per bucket.
    """

    spark: SparkSession
    name: str
    folder: str
    buckets: int = 64

    def _versions(self) -> list[int]:
        prefix = f"{self.name}_v"
        return sorted(int(t.name[len(prefix):]) for t in self.spark.catalog.listTables(pattern=f"{prefix}*") if t.name[len(prefix):].isdigit())

    def _write(self, entries: DataFrame, version: int, mode: str) -> None:
        (entries.select([c.split(" ")[0] for c in CACHE_COLUMNS]).repartition(self.buckets, "key").write.mode(mode).format("parquet")
         .bucketBy(self.buckets, "key").sortBy("key").option("path", f"{self.folder}/{self.name}_v{version}").saveAsTable(f"{self.name}_v{version}"))

    def append(self, fresh: DataFrame) -> None:
        """Adds entries; nothing that is there is read or written again."""
        self._write(fresh, (self._versions() or [0])[-1], "append")

    def entries(self) -> DataFrame:
        """One entry per key, the newest."""
        versions = self._versions()
        return newest(self.spark.table(f"{self.name}_v{versions[-1]}")) if versions else self.spark.createDataFrame([], CACHE)

    def compact(self, max_entries: int | None = None) -> None:
        """Rewrites the table with one entry per key, without the oldest beyond ``max_entries``."""
        versions = self._versions()
        kept = self.entries() if max_entries is None else evict_oldest(materialize(self.entries(), "entries"), max_entries)
        self._write(kept, (versions or [0])[-1] + 1, "overwrite")
        for v in versions:
            self.spark.sql(f"DROP TABLE {self.name}_v{v}")


def hits(found: DataFrame, gazetteer: Places | DataFrame | None = None, countries: list[str] | None = None) -> DataFrame:
    """Records as a fresh model call would have made them: cached labels, places searched anew."""
    df = found.where("entry is not null").withColumn("labels", F.col("entry.labels"))
    df = geo.geoparse(df, gazetteer, countries, use_place=False, skip=decide.says_no_place())
    pii = decide.pii_fired()
    review = F.col("review") if "review" in found.columns else F.lit("auto")
    return (df.withColumn("text", F.when(pii, F.coalesce("entry.redacted_text", "text")).otherwise(F.col("text")))
            .withColumn("classifier", F.lit(V.MODEL_CLASSIFIER)).withColumn("model_version", F.col("entry.model_version"))
            .withColumn("review", decide.route_review(review)).drop("entry"))


def misses(keyed: DataFrame, cache: DataFrame) -> DataFrame:
    """Posts to send to the model; blank text always is one."""
    paid = cache.where(F.col("classifier") == V.MODEL_CLASSIFIER).select("key")
    return keyed.where("key IS NOT NULL").join(paid, "key", "left_anti").select(keyed.columns).unionByName(keyed.where("key IS NULL"))


def cacheable(records: DataFrame) -> DataFrame:
    return records.where((F.col("classifier") == V.MODEL_CLASSIFIER) & ~T.is_blank(F.col("text"))
                         & F.col("labels.relevant").isNotNull() & F.col("key").isNotNull())


def entries(records: DataFrame, now: int) -> DataFrame:
    """Cache entries of fresh records; the redacted text is kept only when personal data was found."""
    return cacheable(records).select(
        "key", "labels", "classifier", "model_version", F.when(decide.pii_fired(), F.col("text")).alias("redacted_text"),
        F.lit(now).cast("long").alias("ts"))


def store(cache: DataFrame, fresh: DataFrame, max_entries: int | None = None) -> DataFrame:
    """The cache with the fresh entries, one per key (see ``newest``). All are kept unless a number is given; then the oldest beyond it are taken out.

    The result is a new snapshot, written once to the shared folder.
    """
    merged = newest(cache.unionByName(fresh))
    return merged if max_entries is None else evict_oldest(materialize(merged, "entries"), max_entries)


def evict_oldest(cache: DataFrame, max_entries: int) -> DataFrame:
    """Keeps the newest ``max_entries``. Entries of one write share a time, so a digest of the key breaks ties.

    The cut is found as order statistics, in two passes and two more over the entries at the cut; the entries themselves are only filtered.
    """
    n = cache.count()
    if n <= max_entries:
        return cache
    tie = F.shiftrightunsigned(F.xxhash64("key"), 12)  # 52 bits, exact as a double
    marked = cache.withColumn("_tie", tie)
    gone = n - max_entries
    cut = order_statistics(marked, {"ts": [gone / n]}, lambda *_: gone)["ts", gone / n]
    level, spare = marked.where(F.col("ts") == F.lit(cut.value)), gone - cut.below  # of the entries at the cut, so many go
    share = spare / cut.equal
    least = order_statistics(level, {"_tie": [share]}, lambda *_: spare)["_tie", share]
    return marked.where((F.col("ts") > F.lit(cut.value)) | ((F.col("ts") == F.lit(cut.value)) & (F.col("_tie") >= F.lit(least.value)))).drop("_tie")


def funnel_delta(hit_records: DataFrame) -> DataFrame:
    """What the hits add to the funnel."""
    rel, placed = S.relevant(), F.size("places") > 0
    return hit_records.agg(F.count("*").alias("prefiltered"), F.count_if(rel).alias("relevant"),
                           F.count_if(rel & placed).alias("mappable"), F.count_if(rel & ~placed).alias("no_place"))
