"""The same operators on a stream."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from postsieve import schema as S, values as V
from postsieve.functions import text as T
from postsieve.functions.settle import settle
from postsieve.operators.meter import meter
from postsieve.operators.profile import EventProfile
from postsieve.plans import triage as plan
from postsieve.session import materialize
from postsieve.sources.gazetteer import Places


def triage_stream(posts: DataFrame, profile: EventProfile, labels: DataFrame | None = None,
                  gazetteer: Places | None = None) -> DataFrame:
    """Records of a stream of posts under a fixed profile. Stateless; ``labels`` may be a static table."""
    return plan.triage(posts, profile, labels, gazetteer=gazetteer)


def running_funnel(records: DataFrame) -> DataFrame:
    """Stage counts so far (complete or update mode)."""
    rel, placed = S.relevant(), F.size("places") > 0
    return records.groupBy().agg(
        F.count("*").alias("deduped"), F.count_if("is_candidate").alias("prefiltered"), F.count_if(rel).alias("relevant"),
        F.count_if(rel & placed).alias("mappable"), F.count_if(rel & ~placed).alias("no_place"))


def running_spend(ledger: DataFrame) -> DataFrame:
    paid = (F.col("status") == 200) & ~F.col("own_key")
    return ledger.groupBy().agg(F.count_if(paid).alias("calls"), F.coalesce(F.sum(F.when(paid, F.col("cost"))), F.lit(0.0)).alias("spent"))


def running_copies(posts: DataFrame, strip_retweets: bool = True, lifetime: str = "1 hour") -> DataFrame:
    """Copies per text and period of arrival so far: the first post of each and its count (update mode).

    A text's count is held for the period in which it arrived and dropped from the state after it, so the state is bounded by what
    arrives in ``lifetime``. Nothing is lost by that: a text that comes again begins a new count, and ``latest_copies`` adds them up.
    """
    key = T.copy_key(F.col("text"), strip_retweets)
    first = F.struct("seq", "id", "text")
    arrived = posts.withColumn("_key", settle(key)).where("_key <> ''").withColumn("_at", F.current_timestamp()).withWatermark("_at", "0 seconds")
    return (arrived.groupBy(F.sha2("_key", 256).alias("digest"), F.window("_at", lifetime).alias("_period"))
            .agg(F.min_by(first, "seq").alias("first"), F.count("*").alias("duplicate_count"))
            .select("digest", F.col("_period.start").alias("since"), "first.*", "duplicate_count"))


def latest_copies(spark: SparkSession, path: str) -> DataFrame:
    """(digest, seq, id, text, duplicate_count) of a change log of ``running_copies``: all periods together.

    The log is dealt out by digest once, which serves both groupings; a digest has a row per batch that changed it at most.
    """
    rows = _log(spark, path).repartition("digest")
    held = rows.groupBy("digest", "since").agg(F.max_by(F.struct("seq", "id", "text", "duplicate_count"), "batch_id").alias("r")).select("digest", "r.*")
    return held.groupBy("digest").agg(F.min_by(F.struct("seq", "id", "text"), "seq").alias("first"), F.sum("duplicate_count").alias("duplicate_count")).select("digest", "first.*", "duplicate_count")


def labelled_stream(posts: DataFrame, answers: DataFrame, wait: str = "1 hour", at: str = "at", answered: str = "answered_at") -> DataFrame:
    """Posts with the answers of a second stream (id, labels, ``answered``) in ``labels``; null where none came in time.

    Both streams carry an event time. A post waits until the watermark has passed ``wait`` after it, so late answers find it, and one that is
    never answered goes on without. Of several answers to one post the first that arrives counts. State on either side lives as long as the
    wait, in the session's state store.
    """
    left = posts.withWatermark(at, wait)
    right = (answers.select(F.col("id").alias("_id"), F.col("labels"), F.col(answered).alias("_answered")).withWatermark("_answered", wait)
             .dropDuplicatesWithinWatermark(["_id"]))
    in_time = (F.col("id") == F.col("_id")) & (F.col("_answered") >= F.col(at)) & (F.col("_answered") <= F.col(at) + F.expr(f"INTERVAL {wait}"))
    return left.join(right, in_time, "left_outer").drop("_id", "_answered")


def write_metered(ledger: DataFrame, path: str, checkpoint: str, budget: float = V.SESSION_BUDGET, breaker: int = V.BREAKER_FAILURES) -> StreamingQuery:
    """A stream of calls (pos, status, cost, own_key) through the meter; read with ``metered``.

    Each batch goes on from the state that the one before it left: cost, trailing failures, reason of a stop. So a budget reached, a refusal
    or a run of failures over several batches stops the model inside the stream. State and rows are written by batch, and
    a batch that is tried again overwrites its own.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        spark, kind = batch.sparkSession, "cost double, failures long, stopped string"
        state = f"{path}/state/batch={{:012d}}"
        prior = spark.read.schema(kind).parquet(state.format(batch_id - 1)).first() if batch_id else (0.0, 0, None)
        cost, failures, stopped = prior
        ok = F.col("status") == 200
        m = materialize(meter(batch, budget, prior_used=cost, breaker=breaker, prior_failures=failures, stopped=stopped), "metered")
        last = m.agg(F.max(F.when(ok, F.col("pos"))), F.max("running_cost"), F.max("trip_reason")).first()
        trailing = m.where(~ok if last[0] is None else ~ok & (F.col("pos") > last[0])).count() + (failures if last[0] is None else 0)
        m.withColumn("running_cost", F.col("running_cost") + F.lit(cost)).write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id:012d}")
        spark.createDataFrame([(cost + (last[1] or 0.0), trailing, stopped or last[2])], kind).write.mode("overwrite").parquet(state.format(batch_id))

    return ledger.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(save).trigger(availableNow=True).start()


def metered(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows").drop("batch")


def fresh_urls(urls: DataFrame, ttl: str = V.URL_TTL) -> DataFrame:
    """A link is passed on once per time to live. The watermark decides what is still remembered, so a link may
    be remembered somewhat longer than the limit, never shorter."""
    return urls.withColumn("url", T.trim_all(F.col("url"))).withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["url"])


# --- sinks --------------------------------------------------------------------------------------

def write_append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append-only parquet; takes all that is there, then stops."""
    return (stream.writeStream.format("parquet").outputMode("append").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def write_changes(stream: DataFrame, path: str, checkpoint: str, mode: str = "update", key: str | list[str] | None = None, order: str | None = None,
                  snapshot_every: int | None = None) -> StreamingQuery:
    """Each batch's changed rows as one folder, overwritten when the batch is retried; read with ``latest``.

    With ``snapshot_every``, every so many batches the newest row per key is written as a snapshot beside the log, from the
    snapshot before and the batches since, so a reader needs one snapshot and a bounded number of batches.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{path}/batch={batch_id:012d}")
        if snapshot_every and (batch_id + 1) % snapshot_every == 0:
            _newest(_log(batch.sparkSession, path, batch_id), key, order).write.mode("overwrite").parquet(f"{path}-snapshots/upto={batch_id:012d}")

    return (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(save)
            .trigger(availableNow=True).start())


def _log(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The rows of the newest snapshot (older than batch ``before``, where given) and of the batches after it, and of no other folder."""
    batches = spark.read.parquet(path)
    try:
        snapshots = spark.read.parquet(f"{path}-snapshots")
    except AnalysisException:
        return batches.drop("batch")
    if before is not None:
        snapshots = snapshots.where(F.col("upto") < before)
    upto = snapshots.agg(F.max("upto")).first()[0]
    if upto is None:
        return batches.drop("batch")
    return snapshots.where(F.col("upto") == upto).drop("upto").unionByName(batches.where(F.col("batch") > upto).drop("batch"))


def _newest(rows: DataFrame, key: str | list[str] | None, order: str | None) -> DataFrame:
    keys = [key] if isinstance(key, str) else key or []
    newest = F.struct(order, "batch_id") if order else F.col("batch_id")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), newest).alias("r")).select("r.*")


def latest(spark: SparkSession, path: str, key: str | list[str] | None = None, order: str | None = None) -> DataFrame:
    """Newest row per key of a change log; without a key, the newest single row. With an order column (a version or a time) the
    largest value wins, in whatever batch it came; equal ones, and all without it, go by batch."""
    return _newest(_log(spark, path), key, order).drop("batch_id")
