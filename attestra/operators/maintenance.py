"""Edits of published facts and additions to reviews: successor revisions, carried evidence, forced review and cancelled cases in one batch.

A batch of edits is judged as a whole for each subject: all of its edits make one successor, or none is
made and the result says why. A successor's id is the hash of what it follows and what it says, so that a
batch which runs twice, or is replayed after a failure, makes the same rows, and `append_new` adds none again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions.scalars import canonical_hash, fact_set_hash, typed_value
from attestra.operators.history import append_new

#: Paths of whole numbers that mustn't be negative, the path of an address, and the longest comment.
NOT_NEGATIVE = r"(?:^|\.)(?:vacancies\.total|age\.minimum|age\.maximum)$"
ADDRESS = "application.url"
MOST_COMMENT = 8_000
#: Results, the first that holds.
ORDER = ("NO_COMMENT", "UNKNOWN_SUBJECT", "STALE", "NO_ACTIVE_CASE", "PATH_TWICE", "UNSUPPORTED", "WRONG_TYPE", "INVALID", "NO_CHANGE")


def own_path(path: Column) -> Column:
    """A post's path without the post; a shared path as it is."""
    return F.regexp_replace(path, r"^posts\.[^.]+\.", "")


def judged_edits(current: DataFrame, facts: DataFrame, edits: DataFrame, allowed: DataFrame, *, add_only: bool = False) -> DataFrame:
    """subject, path, kind, value, prior, error, change: every edit with what is wrong with it, or EDITED, ADDED or nothing changed.

    current: subject, revision_id, revision_number, case_id, case_status; facts: revision_id, path, kind,
    value; edits: subject, expected_revision_id, path, value, comment; allowed: path, kind. Blank values are
    passed over: they erase nothing. With add_only (PIPE-22) an existing path isn't allowed, a case must
    be queued or in review, and no comment is asked for.
    """
    j = edits.join(current, "subject", "left").join(allowed.withColumnsRenamed({"path": "allowed_path", "kind": "allowed_kind"}), own_path(F.col("path")) == F.col("allowed_path"), "left")
    prior = facts.select("revision_id", "path", F.col("kind").alias("prior_kind"), F.col("value").alias("prior"))
    j = j.join(prior, ["revision_id", "path"], "left")
    twice = j.where(F.trim("value") != "").groupBy("subject", "path").agg((F.count(F.lit(1)) > 1).alias("twice"))
    j = j.join(twice, ["subject", "path"], "left")
    blank = F.coalesce(F.trim("value") == "", F.lit(True))
    typed = F.coalesce(*[F.when(F.col("allowed_kind") == k, typed_value(F.lit(k), F.trim("value"))) for k in ("STRING", "INTEGER", "DATE", "BOOLEAN", "JSON", "DECIMAL")])
    canon, valid = typed["value_canon"], F.coalesce(typed["is_valid"], F.lit(False))
    negative = F.col("path").rlike(NOT_NEGATIVE) & (F.col("allowed_kind") == "INTEGER") & (canon.try_cast("decimal(38,0)") < 0)
    address = (own_path(F.col("path")) == ADDRESS) & ~canon.rlike(r"^https?://[^/\s]+")
    supported = F.col("allowed_path").isNotNull() & (F.col("prior_kind").isNull() if add_only else F.lit(True))
    error = F.when(F.lit(not add_only) & F.coalesce(~F.length(F.trim("comment")).between(1, MOST_COMMENT), F.lit(True)), "NO_COMMENT")
    error = (
        error.when(F.col("revision_id").isNull(), "UNKNOWN_SUBJECT").when(~F.col("revision_id").eqNullSafe(F.col("expected_revision_id")), "STALE")
        .when(F.lit(add_only) & ~F.coalesce(F.col("case_status").isin("QUEUED", "IN_REVIEW"), F.lit(False)), "NO_ACTIVE_CASE").when(F.col("twice"), "PATH_TWICE")
        .when(~supported, "UNSUPPORTED").when(~blank & F.col("prior_kind").isNotNull() & (F.col("prior_kind") != F.col("allowed_kind")), "WRONG_TYPE")
        .when(~blank & (~valid | F.coalesce(negative, F.lit(False)) | F.coalesce(address, F.lit(False))), "INVALID")
    )
    change = F.when(blank, F.lit(None)).when(F.col("prior_kind").isNull(), "ADDED").when(~canon.eqNullSafe(F.col("prior")), "EDITED")
    return j.select("subject", "path", F.col("allowed_kind").alias("kind"), canon.alias("value"), "prior", error.alias("error"), change.alias("change"))


def successors(current: DataFrame, facts: DataFrame, links: DataFrame, edits: DataFrame, allowed: DataFrame, *, add_only: bool = False) -> dict[str, DataFrame]:
    """PIPE-21 and, with add_only, PIPE-22. links: revision_id, path, evidence_id; the others as in judged_edits.

    Returns results (subject, result, revision_id, revision_number, changed), one row for each subject with
    edits; revisions (subject, revision_id, revision_number, follows, fact_hash); facts (revision_id,
    path, kind, value, change); links of unchanged facts, carried to the successor; items (case_id,
    revision_id, path, reason): every changed path must be reviewed; cancelled (case_id): the cases of the
    revisions that are followed.
    """
    judged = judged_edits(current, facts, edits, allowed, add_only=add_only)
    rank = F.array_position(F.array(*map(F.lit, ORDER)), F.col("error"))
    verdict = judged.groupBy("subject").agg(F.min(rank).alias("worst"), F.count("change").alias("changed"))
    result = F.when(F.col("worst").isNotNull(), F.element_at(F.array(*map(F.lit, ORDER)), F.col("worst").cast("int"))).when(F.col("changed") == 0, "NO_CHANGE").otherwise("ENRICHED" if add_only else "REPUBLISHED")
    told = verdict.select("subject", result.alias("result"), F.when(result.isin("ENRICHED", "REPUBLISHED"), F.col("changed")).otherwise(0).alias("changed"))
    going = told.where(F.col("result").isin("ENRICHED", "REPUBLISHED")).join(current, "subject")
    new = judged.where("change is not null").join(going.select("subject", "revision_id"), "subject").select("revision_id", "path", F.struct("kind", "value", "change").alias("n"))
    old = facts.join(going.select("revision_id"), "revision_id", "left_semi").select("revision_id", "path", F.struct("kind", "value", F.lit("KEPT").alias("change")).alias("o"))
    effective = old.join(new, ["revision_id", "path"], "full").select(F.col("revision_id").alias("follows"), "path", F.coalesce("n", "o").alias("f")).select("follows", "path", "f.*")
    hashes = effective.groupBy("follows").agg(fact_set_hash(F.collect_list(F.struct("path", "kind", "value"))).alias("fact_hash"))
    made = going.join(hashes, going["revision_id"] == hashes["follows"]).select("subject", canonical_hash(F.col("follows").cast("string"), F.col("fact_hash")).alias("revision_id"), (F.col("revision_number") + 1).alias("revision_number"), "follows", "fact_hash", "case_id")
    keyed = effective.join(made.select("follows", "revision_id"), "follows")
    carried = links.withColumnRenamed("revision_id", "follows").join(keyed.where("change = 'KEPT'").select("follows", "path", "revision_id"), ["follows", "path"])
    items = keyed.where("change <> 'KEPT'").select(F.concat(F.lit("case:"), "revision_id").alias("case_id"), "revision_id", "path", F.lit("MANUAL_" + ("ADDITION" if add_only else "EDIT")).alias("reason"))
    return {
        "results": told.join(made.select("subject", "revision_id", "revision_number"), "subject", "left").select("subject", "result", "revision_id", "revision_number", "changed"),
        "revisions": made.select("subject", "revision_id", "revision_number", "follows", "fact_hash"),
        "facts": keyed.select("revision_id", "path", "kind", "value", "change"),
        "links": carried.select("revision_id", "path", "evidence_id"),
        "items": items,
        "cancelled": made.where("case_id is not null").select("case_id").distinct(),
    }


def applied(stored: dict[str, DataFrame], made: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What a batch adds to the stored tables: rows whose key they lack, so that a batch that is run again adds nothing."""
    keys = {"revisions": ["revision_id"], "facts": ["revision_id", "path"], "links": ["revision_id", "path", "evidence_id"], "items": ["case_id", "path"], "cancelled": ["case_id"]}
    return {name: append_new(made[name], stored[name], key) for name, key in keys.items()}
