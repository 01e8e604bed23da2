"""Run history: health, trends, staleness and alerts without repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STALE_MINUTES, OVERDUE_HOURS, TREND = 60, 26, 20


def latest(runs: DataFrame, key: str, status: str | None = None) -> Column:
    """WIN-1 as an aggregate: started_at and run_id of the latest run with a status."""
    at = F.struct("started_at", "run_id")
    return F.max(at if status is None else F.when(F.col("status") == status, at))


def source_health(runs: DataFrame, as_of: Column) -> DataFrame:
    """MON-1: by source, status by precedence STALE (running too long), RUNNING, NO_DATA, FAILED, STALE (overdue), DEGRADED, HEALTHY; and alerts."""
    s = runs.groupBy("source_id").agg(*[latest(runs, "source_id", k).alias(k.lower()) for k in ("RUNNING", "SUCCESS", "FAILED")], F.max(F.when(F.col("status") != "RUNNING", F.struct("started_at", "run_id", "status"))).alias("done"), F.count(F.lit(1)).alias("runs"))
    limit = lambda minutes: as_of - F.make_dt_interval(mins=F.lit(minutes))
    running, success, failed, done = (F.col(f"{c}.started_at") for c in ("running", "success", "failed", "done"))
    is_running = running.isNotNull() & (done.isNull() | (running > done))
    stale, overdue = is_running & (running < limit(STALE_MINUTES)), success.isNull() | (success < limit(OVERDUE_HOURS * 60))
    status = (
        F.when(stale, "STALE").when(is_running, "RUNNING").when(done.isNull(), "NO_DATA").when(F.col("done.status") == "FAILED", "FAILED")
        .when(overdue, "STALE").when(F.col("done.status") == "PARTIAL", "DEGRADED").otherwise("HEALTHY")
    )
    alerts = F.array_compact(F.array(F.when(stale, "RUNNING_STALE"), F.when(failed.isNotNull() & (success.isNull() | (failed > success)), "PIPELINE_FAILED"), F.when(~is_running & overdue, "SUCCESS_OVERDUE")))
    return s.select("source_id", "runs", status.alias("status"), alerts.alias("alerts"))


def stage_trends(runs: DataFrame, last: int = TREND) -> DataFrame:
    """AGG-22, WIN-3: by source and stage, over the last runs: samples, latest, mean (half to even), least and most."""
    order = Window.partitionBy("source_id", "stage").orderBy(F.desc("started_at"), F.desc("run_id"))
    recent = runs.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= last)
    return recent.groupBy("source_id", "stage").agg(F.count(F.lit(1)).alias("samples"), F.max(F.when(F.col("nth") == 1, F.col("duration"))).alias("latest"), F.bround(F.avg(F.col("duration").cast("decimal(18,6)")), 0).cast("long").alias("mean"), F.min("duration").alias("least"), F.max("duration").alias("most"))


def run_history(runs: DataFrame) -> DataFrame:
    """MON-4: by source, counts by status, total duration and the last failing stage."""
    failed = F.max(F.when(F.col("status") == "FAILED", F.struct("started_at", "run_id", "stage")))
    return runs.groupBy("source_id").agg(*[F.count_if(F.col("status") == k).alias(k.lower()) for k in ("SUCCESS", "PARTIAL", "FAILED", "RUNNING")], F.sum(F.col("duration").cast("decimal(18,6)")).cast("double").alias("total_duration"), failed.alias("f")).select("*", F.col("f.stage").alias("last_failing_stage")).drop("f")


def alert_rows(health: DataFrame, channels: list[str]) -> DataFrame:
    """MON-2, FN-6: each alert once a channel, with the key by which repeats are known."""
    each = health.select("source_id", F.explode("alerts").alias("alert")).withColumn("channel", F.explode(F.array(*map(F.lit, channels))))
    return each.withColumn("dedup_key", F.sha2(F.concat_ws("|", F.col("source_id").cast("string"), "alert", "channel"), 256))


def due_sources(sources: DataFrame, defaults: DataFrame, last_attempts: DataFrame, as_of: Column) -> DataFrame:
    """MON-3, JOIN-9, FN-26, SORT-7: enabled sources by priority and code, with their next due time; the registry's own interval goes before the default.

    defaults has group, minutes: a small catalogue, one row a group.
    """
    joined = sources.join(defaults, "group", "left").join(last_attempts, "source_id", "left")
    minutes = F.coalesce("interval_minutes", "minutes")
    due = F.timestamp_add("MINUTE", minutes, F.col("last_attempt"))
    out = joined.where("enabled").select("source_id", "priority", minutes.alias("minutes"), due.alias("next_due"), F.coalesce(due <= as_of, F.lit(True)).alias("is_due"))
    return out.orderBy("priority", "source_id")


def freshness(runs: DataFrame, visible: DataFrame) -> DataFrame:
    """AGG-24: the last completion over runs of sources that are visible."""
    return runs.join(visible, "source_id", "left_semi").where("status = 'SUCCESS'").agg(F.max("started_at").alias("fresh_at"))


def counts_with_all(df: DataFrame, column: str, total: str = "ALL") -> DataFrame:
    """AGG-21: counts by value and one row for all."""
    return df.rollup(column).agg(F.count(F.lit(1)).alias("n"), F.grouping(column).alias("g")).select(F.when(F.col("g") == 1, total).otherwise(F.col(column)).alias(column), "n")


#: What keeps a candidate from being published, and the kinds that are.
SKIPPED = ("REVIEW_MISSING", "REVIEW_PENDING", "REVIEW_CANCELLED", "REJECTED", "REVERIFICATION_REQUESTED")
PUBLISHABLE = {"DIRECT": "direct_verified", "HUMAN_APPROVED": "human_approved", "HUMAN_CORRECTED": "human_corrected"}


def verification_summary(results: DataFrame) -> DataFrame:
    """AGG-27, verification: by batch, the sums over results (batch_id, fields_confirmed, fields_conflicted, fields_insufficient, fields_not_applicable, review_required, failed); a failed one counts as that alone."""
    done = ~F.col("failed")
    sums = [F.coalesce(F.sum(F.when(done, F.col(c))), F.lit(0)).cast("long").alias(c) for c in ("fields_confirmed", "fields_conflicted", "fields_insufficient", "fields_not_applicable")]
    return results.groupBy("batch_id").agg(F.count_if(done).alias("completed"), F.count_if("failed").alias("failed"), *sums, F.count_if(done & F.col("review_required")).alias("review_cases_queued"), F.count_if(done & ~F.col("review_required")).alias("no_review_required"))


def publication_summary(results: DataFrame) -> DataFrame:
    """AGG-27, publication: by batch, candidates by kind, and what became of those that were published.

    results: batch_id, kind, failed, master_exists, revision_exists. A kind of SKIPPED is counted there and
    as skipped; another one as what it is, and then as failed, or by what there was before: unchanged
    where the revision existed, updated where a master did, created else.
    """
    kind, live = F.col("kind"), F.col("kind").isin(*PUBLISHABLE)
    done = live & ~F.col("failed")
    return results.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("selected"), *[F.count_if(kind == k).alias(k.lower()) for k in SKIPPED], F.count_if(kind.isin(*SKIPPED)).alias("skipped"),
        *[F.count_if(kind == k).alias(c) for k, c in PUBLISHABLE.items()], F.count_if(live & F.col("failed")).alias("failed"), F.count_if(done & F.col("revision_exists")).alias("master_unchanged"),
        F.count_if(done & ~F.col("revision_exists") & F.col("master_exists")).alias("master_updated"), F.count_if(done & ~F.col("revision_exists") & ~F.col("master_exists")).alias("master_created"),
    )
