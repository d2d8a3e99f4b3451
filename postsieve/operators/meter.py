"""Spend and failure accounting over a call ledger in candidate order."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from postsieve import values as V
from postsieve.operators.position import with_position
from postsieve.session import materialize


def meter(ledger: DataFrame, budget: float = V.SESSION_BUDGET, prior_used: float = 0.0, unlimited: bool = False,
          breaker: int = V.BREAKER_FAILURES, rows_per_bucket: int = 1_000_000, prior_failures: int = 0, stopped: str | None = None) -> DataFrame:
    """Adds ``running_cost``, ``classifier`` and ``trip_reason`` to (pos, status, cost, own_key).

    The call that reaches the budget is still the model's; later rows are labelled by rules. A 402, or a run of
    ``breaker`` failures, stops the model as well. A ledger may go on from an earlier one: with what that one used, the
    failures it ended with, and the reason why it had stopped, if it had. Running sums come per bucket of ``pos``; a run of failures is
    told by the number of successes before it, and its length is a difference of running sums, so even one run
    over a third of the ledger is never gathered.
    """
    ok = F.col("status") == 200
    paid = F.when(ok & ~F.col("own_key"), F.col("cost")).otherwise(0.0)
    run = materialize(with_position(ledger, "pos", rows_per_bucket=rows_per_bucket, sums={
        "running_cost": paid, "_ok": F.when(ok, 1.0).otherwise(0.0), "_bad": F.when(ok, 0.0).otherwise(1.0)}), "ledger")
    spent = F.lit(prior_used) + F.col("running_cost")
    over = F.min(F.when(ok & ~F.col("own_key") & (spent >= budget) & F.lit(not unlimited), F.col("pos")))
    first = run.agg(over.alias("over"), F.min(F.when(F.col("status") == 402, F.col("pos"))).alias("refused")).first()
    failures = run.where(~ok).select("pos", "_ok", "_bad")
    earlier = F.when(F.col("_ok") == 0, min(prior_failures, breaker - 1)).otherwise(0)  # a run that began in the earlier ledger
    starts = failures.groupBy("_ok").agg((F.min("_bad") + (breaker - 1)).alias("_bad")).withColumn("_bad", F.col("_bad") - earlier)
    tripped = failures.join(starts, ["_ok", "_bad"]).agg(F.min("pos").alias("failing")).first()
    stops = {"over_budget": first["over"], "402": first["refused"], "429": tripped["failing"]}
    found = [(name, at) for name, at in stops.items() if at is not None]  # three values
    reason, stop = min(found, key=lambda f: f[1]) if found else (None, None)
    by_model = ok & F.lit(stopped is None) & (F.lit(True) if stop is None else F.col("pos") <= stop)
    reason = stopped or reason
    return run.drop("_ok", "_bad", "position").select(
        "*", F.when(by_model, V.MODEL_CLASSIFIER).otherwise(V.RULE_CLASSIFIER).alias("classifier"),
        F.lit(reason).cast("string").alias("trip_reason"))


def estimate(candidates: int) -> float:
    return candidates * V.COST_PER_CALL


def daily_spend(ledger: DataFrame, ceiling: float = V.DAILY_CEILING) -> DataFrame:
    """Metered cost per calendar day and whether the day's ceiling is reached."""
    day = ledger.where((F.col("status") == 200) & ~F.col("own_key")).groupBy(F.to_date("ts").alias("day")).agg(F.sum("cost").alias("cost"))
    return day.withColumn("blocked", F.col("cost") >= ceiling)


def merge_spend(reports: DataFrame) -> DataFrame:
    """Parallel batches each report (batch, at, used, spent, degraded); the total counts every batch once."""
    last = reports.groupBy("batch").agg(
        F.max_by("spent", "at").alias("spent"), F.max("degraded").alias("degraded"),
        F.min(F.struct("at", "batch", (F.col("used") - F.col("spent")).alias("base"))).alias("first"))
    return last.agg(F.min("first").alias("f"), F.sum("spent").alias("s"), F.max("degraded").alias("degraded")).select(
        (F.greatest(F.lit(0.0), F.col("f.base")) + F.col("s")).alias("used"), F.col("s").alias("spent"), "degraded")
