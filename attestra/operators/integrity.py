"""Integrity of what is about to be published: snapshots and coverage of verifications, snapshots and outcomes of reviews (PIPE-15)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _differ(pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a | b, [~F.col(a).eqNullSafe(F.col(b)) for a, b in pairs])


def _reported(df: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """key, violation: a row for each check that holds."""
    told = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()]))
    return df.select(key, F.explode(told).alias("violation"))


def verification_violations(runs: DataFrame, revisions: DataFrame, fields: DataFrame, verifications: DataFrame, assessments: DataFrame) -> DataFrame:
    """PIPE-15, JOIN-15, FLT-18: run_id, violation, each once; a sound run has no rows.

    runs: run_id, revision_id, confidence_revision_id, status, hash_snapshot, fields_total; revisions:
    revision_id, revision_hash, expected_hash (computed anew); fields: revision_id, field_id, path, type,
    value; verifications: run_id, field_id, status, path, type, value; assessments: run_id, field_id.

    REVISION_MISSING, REVISION_MISMATCH (the confidence is of another revision), RUN_STATUS, REVISION_HASH and
    RUN_HASH are of the run alone. COVERAGE says that fields, verifications and assessments aren't
    the same in number and key, or that one isn't FINALIZED; SNAPSHOT that a verification was
    made of another path, type or value than the field's. Fields meet verifications by run and field, so
    that a run with very many is many tasks' work; null equals null.
    """
    expected = runs.select("run_id", "revision_id").join(fields, "revision_id").select("run_id", "field_id", F.lit(True).alias("is_field"), *[F.col(c).alias(f"field_{c}") for c in ("path", "type", "value")])
    made = verifications.select("run_id", "field_id", F.lit(True).alias("is_made"), "status", "path", "type", "value")
    both = expected.join(made, ["run_id", "field_id"], "full")
    pair = F.col("is_field") & F.col("is_made")
    changed = pair & _differ([(c, f"field_{c}") for c in ("path", "type", "value")])
    seen = both.groupBy("run_id").agg(
        F.count_if(F.col("is_made")).alias("made"), F.count_if(F.col("is_field").isNull() | F.col("is_made").isNull()).alias("alone"),
        F.count_if(F.col("is_made") & ~F.col("status").eqNullSafe("FINALIZED")).alias("open"), F.count_if(changed).alias("changed"),
    )
    held = fields.groupBy("revision_id").agg(F.count(F.lit(1)).alias("fields"))
    scored = assessments.groupBy("run_id").agg(F.count(F.lit(1)).alias("scored"))
    j = runs.join(revisions.withColumn("known", F.lit(True)), "revision_id", "left").join(held, "revision_id", "left").join(seen, "run_id", "left").join(scored, "run_id", "left")
    n = {c: F.coalesce(c, F.lit(0)) for c in ("fields", "made", "alone", "open", "changed", "scored")}
    return _reported(j, "run_id", {
        "REVISION_MISSING": F.col("known").isNull(),
        "REVISION_MISMATCH": ~F.col("confidence_revision_id").eqNullSafe(F.col("revision_id")),
        "RUN_STATUS": ~F.col("status").eqNullSafe("COMPLETED"),
        "REVISION_HASH": F.col("known") & ~F.col("revision_hash").eqNullSafe(F.col("expected_hash")),
        "RUN_HASH": F.col("known") & ~F.col("hash_snapshot").eqNullSafe(F.col("revision_hash")),
        "COVERAGE": ~F.col("fields_total").eqNullSafe(n["fields"]) | (n["made"] != n["fields"]) | (n["scored"] != n["fields"]) | (n["alone"] > 0) | (n["open"] > 0),
        "SNAPSHOT": n["changed"] > 0,
    })


#: Fixed value: the outcome of a resolved case by the first of these decisions that any item has; APPROVED without any.
OUTCOMES = (("REQUEST_REVERIFICATION", "REVERIFICATION_REQUESTED"), ("REJECT", "REJECTED"), ("CORRECT_AND_APPROVE", "APPROVED_WITH_CORRECTIONS"))
#: What a case and a revision's item repeat of the revision's confidence, and a field's item of the field's.
CASE_SNAPSHOT, ITEM_SNAPSHOT = ("revision_id", "run_id", "policy", "priority", "score", "reasons"), ("field_id", "policy", "priority", "score", "reasons", "path", "type", "value")


def review_violations(cases: DataFrame, confidences: DataFrame, items: DataFrame, field_confidences: DataFrame) -> DataFrame:
    """PIPE-15: case_id, violation, each once; a sound case has no rows.

    cases: case_id, confidence_id, status, outcome and CASE_SNAPSHOT; confidences: confidence_id and
    CASE_SNAPSHOT; items: case_id, scope (FIELD or REVISION), field_confidence_id, ITEM_SNAPSHOT, decision,
    original_type, original_value; field_confidences: field_confidence_id and ITEM_SNAPSHOT.

    CASE_SNAPSHOT, ITEM_SNAPSHOT: another value than the confidence's; ITEM_CONFIDENCE: a field's item without one;
    DECISION_SNAPSHOT: a decision on another type or value than the item's; OUTCOME: not what the
    decisions of a resolved case add up to; UNDECIDED: a resolved case with an item that has none. A
    case without a confidence fails CASE_SNAPSHOT.
    """
    of = confidences.select("confidence_id", *[F.col(c).alias(f"own_{c}") for c in CASE_SNAPSHOT])
    told = cases.join(of, "confidence_id", "left")
    own = field_confidences.select("field_confidence_id", F.lit(True).alias("known"), *[F.col(c).alias(f"own_{c}") for c in ITEM_SNAPSHOT])
    i = items.join(own, "field_confidence_id", "left")
    is_field, decided = F.col("scope") == "FIELD", F.col("decision").isNotNull()
    flags = i.groupBy("case_id").agg(
        F.bool_or(is_field & F.col("known").isNull()).alias("no_confidence"), F.bool_or(is_field & F.col("known") & _differ([(c, f"own_{c}") for c in ITEM_SNAPSHOT])).alias("item_changed"),
        F.bool_or(decided & _differ([("original_type", "type"), ("original_value", "value")])).alias("decision_changed"), F.bool_or(~decided).alias("undecided"),
        *[F.bool_or(F.col("decision") == d).alias(d) for d, _ in OUTCOMES],
    )
    # a revision's item repeats what its case does
    whole = items.where(~is_field).select("case_id", *[F.col(c).alias(f"item_{c}") for c in ("policy", "priority", "score")]).join(told.select("case_id", "own_policy", "own_priority", "own_score"), "case_id")
    off = whole.groupBy("case_id").agg(F.bool_or(_differ([(f"item_{c}", f"own_{c}") for c in ("policy", "priority", "score")])).alias("whole_changed"))
    expected = F.lit("APPROVED")
    for decision, outcome in reversed(OUTCOMES):
        expected = F.when(F.col(decision), outcome).otherwise(expected)
    resolved = F.col("status") == "RESOLVED"
    return _reported(told.join(flags, "case_id", "left").join(off, "case_id", "left"), "case_id", {
        "CASE_SNAPSHOT": _differ([(c, f"own_{c}") for c in CASE_SNAPSHOT]),
        "ITEM_CONFIDENCE": F.col("no_confidence"),
        "ITEM_SNAPSHOT": F.coalesce("item_changed", F.lit(False)) | F.coalesce("whole_changed", F.lit(False)),
        "DECISION_SNAPSHOT": F.col("decision_changed"),
        "OUTCOME": resolved & ~F.col("outcome").eqNullSafe(expected),
        "UNDECIDED": resolved & F.col("undecided"),
    })


def revision_violations(revisions: DataFrame, fields: DataFrame, posts: DataFrame, facts: DataFrame) -> DataFrame:
    """FLT-17: revision_id, violation, each once: what keeps a revision from being taken in.

    revisions: revision_id, split_status; fields: revision_id, path; posts: revision_id, post_key, ordinal;
    facts: revision_id, post_key, path, a post's own fields. EMPTY has neither a field nor a post;
    NO_POSTS is EXPLICIT without any; NOT_EXPLICIT has posts under another status; POST_KEY, ORDINAL and PATH
    occur twice, a fact's path as posts.key.path among those of the fields. Values are counted once, by
    revision and value, so that neither a revision nor a value is one task's work.
    """
    text = lambda c: F.col(c).cast("string")
    item = lambda df, kind, value: df.select("revision_id", F.lit(kind).alias("kind"), value.alias("value"))
    own = F.concat(F.lit("posts."), text("post_key"), F.lit("."), F.col("path"))
    all_items = item(fields, "FIELD", F.col("path")).unionByName(item(facts, "FACT", own)).unionByName(item(posts, "KEY", text("post_key"))).unionByName(item(posts, "ORDINAL", text("ordinal")))
    shared = F.when(F.col("kind").isin("FIELD", "FACT"), "PATH").otherwise(F.col("kind"))
    counted = all_items.groupBy("revision_id", shared.alias("of"), "value").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "FIELD").alias("fields"))
    twice = lambda of: F.bool_or((F.col("of") == of) & (F.col("n") > 1) & F.col("value").isNotNull()).alias(of)
    found = counted.groupBy("revision_id").agg(F.sum("fields").alias("fields"), F.sum(F.when(F.col("of") == "KEY", F.col("n"))).alias("posts"), *map(twice, ("KEY", "ORDINAL", "PATH")))
    j = revisions.select("revision_id", "split_status").join(found, "revision_id", "left")
    n_fields, n_posts, explicit = F.coalesce("fields", F.lit(0)), F.coalesce("posts", F.lit(0)), F.col("split_status").eqNullSafe("EXPLICIT")
    return _reported(j, "revision_id", {
        "EMPTY": n_fields + n_posts == 0, "NO_POSTS": explicit & (n_posts == 0), "NOT_EXPLICIT": ~explicit & (n_posts > 0), "POST_KEY": F.col("KEY"), "ORDINAL": F.col("ORDINAL"), "PATH": F.col("PATH"),
    })
