"""Review cases, human decisions, approved projections and batch maintenance of what is published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Decisions from strongest to weakest, with the outcome of a scope.
DECISIONS = ("REQUEST_REVERIFICATION", "REJECT", "CORRECT_AND_APPROVE", "APPROVE_AS_IS")
SCOPE_OUTCOMES = ("REVERIFICATION_REQUESTED", "REJECTED", "HUMAN_CORRECTED", "HUMAN_APPROVED")


def queue_cases(fields: DataFrame, revision_reasons: DataFrame) -> DataFrame:
    """PIPE-9, SET-4, SET-5: review items: one for each field with reasons, and one for a revision's reasons that no field covers.

    fields: case_id, path, reasons; revision_reasons: case_id, reasons (array).
    """
    some = fields.where(F.size("reasons") > 0)
    own = some.select("case_id", F.lit("FIELD").alias("scope"), F.col("path").alias("item_key"), F.array_sort("reasons").alias("reasons"))
    covered = some.select("case_id", F.explode("reasons").alias("r")).groupBy("case_id").agg(F.collect_set("r").alias("covered"))
    left = revision_reasons.join(covered, "case_id", "left")
    rest = left.withColumn("reasons", F.array_except("reasons", F.coalesce("covered", F.expr("cast(array() as array<string>)")))).where(F.size("reasons") > 0)
    return own.unionByName(rest.select("case_id", F.lit("REVISION").alias("scope"), F.lit("*").alias("item_key"), "reasons"))


def apply_decisions(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """PIPE-10: items (item_key, scope, value_type, value) with their decision, and an error where it isn't allowed.

    A correction must be of a field, keep the type and differ; a second, other decision is a conflict.
    """
    once = decisions.groupBy("item_key").agg(F.count_distinct("decision", F.coalesce("corrected_value", F.lit(""))).alias("kinds"), F.max(F.struct("decided_at", "decision", "corrected_type", "corrected_value")).alias("d"))
    j = items.join(once, "item_key", "left")
    fix = F.col("d.decision") == "CORRECT_AND_APPROVE"
    error = (
        F.when(F.col("kinds") > 1, "CONFLICTING_DECISIONS").when(fix & (F.col("scope") != "FIELD"), "CORRECTION_NEEDS_FIELD").when(fix & (F.col("d.corrected_type") != F.col("value_type")), "TYPE_CHANGED")
        .when(fix & F.col("d.corrected_value").eqNullSafe(F.col("value")), "NOT_CHANGED")
    )
    return j.select(*items.columns, F.col("d.decision").alias("decision"), error.alias("error"), F.when(fix & error.isNull(), F.col("d.corrected_value")).otherwise(F.col("value")).alias("final_value"), (F.col("d").isNotNull() & error.isNull()).alias("resolved"))


def scope_outcome(decided: DataFrame, *keys: str) -> DataFrame:
    """AGG-29, PIPE-11: null while an item is pending, else the strongest decision's outcome."""
    rank = F.array_position(F.array(*map(F.lit, DECISIONS)), F.col("decision"))
    grouped = decided.groupBy(*keys).agg(F.bool_and("resolved").alias("done"), F.min(F.when(F.col("resolved"), rank)).alias("rank"), F.count_if(~F.col("resolved")).alias("pending"), F.count(F.lit(1)).alias("items"))
    return grouped.select(*keys, F.when(F.col("done"), F.element_at(F.array(*map(F.lit, SCOPE_OUTCOMES)), F.col("rank").cast("int"))).alias("outcome"), "pending", "items")


def approved_projection(decided: DataFrame) -> DataFrame:
    """PIPE-12: fields that may be published: a rejected post blocks itself only, a rejected shared item its whole case, and so does a pending shared one.

    decided: case_id, post_key (null: shared), item_key, decision, resolved, final_value.
    """
    bad = (F.col("decision") == "REJECT") | ~F.col("resolved") | (F.col("decision") == "REQUEST_REVERIFICATION")
    flags = decided.withColumn("bad", F.coalesce(bad, F.lit(True)))
    cases = flags.groupBy("case_id").agg(F.coalesce(F.bool_or(F.col("bad") & F.col("post_key").isNull()), F.lit(False)).alias("blocked")).where(~F.col("blocked")).select("case_id")
    posts = flags.where("bad and post_key is not null").select("case_id", "post_key").distinct()
    return flags.join(cases, "case_id", "left_semi").join(posts, ["case_id", "post_key"], "left_anti").select("case_id", "post_key", "item_key", "final_value", F.when(F.col("decision") == "CORRECT_AND_APPROVE", "HUMAN_CORRECTED").otherwise("HUMAN_APPROVED_AS_IS").alias("origin"))


def queue_counts(items: DataFrame) -> DataFrame:
    """AGG-20: units by state."""
    return items.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("decision").isNull()).alias("pending"), F.count_if("resolved").alias("resolved"), F.count_if(F.col("error").isNotNull()).alias("errors"))


def maintain_published(facts: DataFrame, edits: DataFrame, valid: Column) -> DataFrame:
    """PIPE-21, PIPE-22: edits (subject, path, new_value) on published facts (subject, path, value): blank and equal ones do nothing, invalid ones are reported, new paths are additions."""
    j = edits.join(facts, ["subject", "path"], "left")
    kind = F.when(F.trim("new_value") == "", "IGNORED").when(~F.coalesce(valid, F.lit(False)), "INVALID").when(F.col("value").isNull(), "ADDED").when(F.col("value") == F.col("new_value"), "NO_CHANGE").otherwise("EDITED")
    return j.select("subject", "path", "value", "new_value", kind.alias("result"))


def approve_structure(posts: DataFrame, totals: DataFrame, most: int = 50) -> DataFrame:
    """PIPE-23: proposed posts (subject, post_key, n) by subject: 1 to `most` posts, unique keys, and a sum that is the stated total."""
    g = posts.groupBy("subject").agg(F.count(F.lit(1)).alias("posts"), F.count_distinct("post_key").alias("keys"), F.sum("n").alias("sum"))
    j = totals.join(g, "subject", "left")
    error = F.when(F.coalesce("posts", F.lit(0)) < 1, "NO_POSTS").when(F.col("posts") > most, "TOO_MANY").when(F.col("keys") < F.col("posts"), "DUPLICATE_KEY").when(F.col("sum") != F.col("total"), "TOTAL_DIFFERS")
    return j.select("subject", F.coalesce("posts", F.lit(0)).alias("posts"), error.alias("error"))


def bulk_publish(requests: DataFrame, ready: DataFrame, published: DataFrame) -> DataFrame:
    """PIPE-24: each distinct (case, post) alone: PUBLISHED, ALREADY or BLOCKED, never an exception."""
    keys = ["case_id", "post_key"]
    j = requests.select(*keys).distinct().join(ready.select(*keys, F.lit(True).alias("ok")).distinct(), keys, "left").join(published.select(*keys, F.lit(True).alias("was")).distinct(), keys, "left")
    return j.select(*keys, F.when(F.col("was"), "ALREADY").when(F.col("ok"), "PUBLISHED").otherwise("BLOCKED").alias("result"))


def review_queue(posts: DataFrame, unsplit: DataFrame, published: DataFrame) -> DataFrame:
    """PIPE-25, SET-1, SET-2, WIN-14: units of three families, the first of a family's order for each identity; unsplit ones go where posts of the subject exist."""
    split = posts.select("subject", "post_key").withColumn("family", F.lit(1))
    whole = unsplit.join(posts.select("subject"), "subject", "left_anti").select("subject", F.lit("").alias("post_key")).withColumn("family", F.lit(2))
    done = published.select("subject", "post_key").withColumn("family", F.lit(3))
    return split.unionByName(whole).unionByName(done).groupBy("subject", "post_key").agg(F.min("family").alias("family"))


def case_view(items: DataFrame, decided: DataFrame) -> DataFrame:
    """PIPE-26: every attribute of every case: trusted, or its decision, or review required; and its value in the end."""
    j = items.select("item_key", "value", "reasons").join(decided.select("item_key", "decision", "final_value", "resolved"), "item_key", "left")
    status = F.when(F.size("reasons") == 0, "TRUSTED").when(F.coalesce("resolved", F.lit(False)), F.col("decision")).otherwise("REVIEW_REQUIRED")
    return j.select("item_key", status.alias("status"), F.coalesce("final_value", "value").alias("value"))
