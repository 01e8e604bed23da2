"""Observations, immutable revisions, the published history and its change log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions.scalars import canonical_hash, fact_set_hash


def classify_observations(observations: DataFrame) -> DataFrame:
    """WIN-5, PIPE-1: adds label: UNCHANGED if the endpoint's URL had this content before, CHANGED if it had other content, else NEW.

    Windows are keyed by endpoint and URL, never by endpoint alone, so a busy endpoint is no hot key.
    Both windows share one shuffle.
    """
    order = ["observed_at", "observation_id"]
    url = Window.partitionBy("endpoint_id", "url").orderBy(*order)
    content = Window.partitionBy("endpoint_id", "url", "content_hash").orderBy(*order)
    seen = F.row_number().over(content) > 1
    return observations.withColumn("label", F.when(seen, "UNCHANGED").when(F.row_number().over(url) > 1, "CHANGED").otherwise("NEW"))


def observation_counters(labelled: DataFrame, *keys: str) -> DataFrame:
    """AGG-14."""
    return labelled.groupBy(*keys).agg(*[F.count_if(F.col("label") == x).alias(x.lower()) for x in ("NEW", "CHANGED", "UNCHANGED")], F.count(F.lit(1)).alias("total"))


def document_versions(observations: DataFrame) -> DataFrame:
    """Distinct versions with first and last sight."""
    return observations.groupBy("endpoint_id", "url", "content_hash").agg(F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen"), F.count(F.lit(1)).alias("sightings"))


def append_new(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """SRC-6: rows of new whose key neither repeats nor exists."""
    return new.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def number_revisions(versions: DataFrame) -> DataFrame:
    """WIN-4, PIPE-2: each subject's distinct projections, numbered by first sight."""
    first = versions.groupBy("subject", "projection").agg(F.min(F.struct("seq_ts", "seq_id")).alias("first"))
    number = F.row_number().over(Window.partitionBy("subject").orderBy("first"))
    return first.select("subject", "projection", "first.seq_ts", "first.seq_id", number.cast("int").alias("revision_number"))


def publish_events(versions: DataFrame) -> DataFrame:
    """PIPE-14, PIPE-16: what each version does to the published history: CREATED, UPDATED, UNCHANGED, or REPOINTED to a projection seen before."""
    order = ["seq_ts", "seq_id"]
    subject, same = Window.partitionBy("subject").orderBy(*order), Window.partitionBy("subject", "projection").orderBy(*order)
    before, nth = F.lag("projection").over(subject), F.row_number().over(same)
    kind = F.when(before.isNull(), "CREATED").when(before == F.col("projection"), "UNCHANGED").when(nth > 1, "REPOINTED").otherwise("UPDATED")
    return versions.withColumn("event", kind)


def current(versions: DataFrame) -> DataFrame:
    """JOIN-3 in effect: the latest version of each subject, by partial aggregates and no sort."""
    cols = [c for c in versions.columns if c not in ("subject", "seq_ts", "seq_id")]
    return versions.groupBy("subject").agg(F.max(F.struct("seq_ts", "seq_id", *cols)).alias("v")).select("subject", "v.*")


def change_log(old: DataFrame, new: DataFrame) -> DataFrame:
    """JOIN-7, SET-3: ADDED, REMOVED and UPDATED (value or type) by subject and path; both have subject, path, type, value."""
    o, n = old.select("subject", "path", F.struct("type", "value").alias("o")), new.select("subject", "path", F.struct("type", "value").alias("n"))
    both = o.join(n, ["subject", "path"], "full_outer")
    kind = F.when(F.col("o").isNull(), "ADDED").when(F.col("n").isNull(), "REMOVED").when(~F.col("o").eqNullSafe(F.col("n")), "UPDATED")
    return both.withColumn("change", kind).where("change is not null").select("subject", "path", "change", F.col("o.value").alias("old_value"), F.col("n.value").alias("new_value"))


def version_changes(versions: DataFrame, paths: list[str]) -> DataFrame:
    """The change log of all successive versions: a version that only points back leaves no rows."""
    events = publish_events(versions)
    w = Window.partitionBy("subject").orderBy("seq_ts", "seq_id")
    facts = F.array(*[F.struct(F.lit(p).alias("path"), F.lag(p).over(w).alias("old_value"), F.col(p).alias("new_value")) for p in paths])
    each = events.withColumn("facts", facts).where(F.col("event").isin("CREATED", "UPDATED")).select("subject", "seq_id", "event", F.explode("facts").alias("f")).select("subject", "seq_id", "event", "f.*")
    return each.where(~F.col("old_value").eqNullSafe(F.col("new_value"))).withColumn("change", F.when(F.col("event") == "CREATED", "ADDED").otherwise("UPDATED")).drop("event")


def conflict_free(facts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """AGG-19: a path with two different values is dropped as a whole."""
    return facts.groupBy(*keys).agg(F.min(value).alias(value), F.max(value).alias("other")).where(F.col(value).eqNullSafe(F.col("other"))).drop("other")


def carry_evidence(old: DataFrame, new: DataFrame, links: DataFrame) -> DataFrame:
    """JOIN-19: links of old facts go to new facts of the same subject, path and value."""
    o, n = old.select("subject", "path", "value", F.col("fact_id").alias("old_id")), new.select("subject", "path", F.col("value").alias("new_value"), F.col("fact_id").alias("new_id"))
    same = o.join(n, ["subject", "path"]).where(F.col("value").eqNullSafe(F.col("new_value")))
    return same.join(links.select(F.col("fact_id").alias("old_id"), "evidence_id"), "old_id").select(F.col("new_id").alias("fact_id"), "evidence_id")


def set_mismatches(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """JOIN-15: keys that one side lacks."""
    left, right = a.select(*keys).distinct().withColumn("in_a", F.lit(True)), b.select(*keys).distinct().withColumn("in_b", F.lit(True))
    return left.join(right, keys, "full_outer").where("in_a is null or in_b is null").select(*keys, F.when(F.col("in_a").isNull(), "MISSING_LEFT").otherwise("MISSING_RIGHT").alias("violation"))


def violations(df: DataFrame, rules: dict[str, str], keys: list[str]) -> DataFrame:
    """FLT-17, FLT-18, PIPE-15: one row for each row and rule that fails; a rule is a condition that must hold."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(r), F.lit(False)), F.lit(name)) for name, r in rules.items()]))
    return df.select(*keys, F.explode(broken).alias("rule"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """FLT-17: keys that repeat."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def reconciled(parts: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """AGG-16, JOIN-18: whether the parts' sum is the stated total, only if all parts are known; parts has key, n, totals key, total."""
    sums = parts.groupBy(key).agg(F.sum("n").alias("parts"), F.count("n").alias("known"), F.count(F.lit(1)).alias("all"))
    ok = F.when(F.col("known") == F.col("all"), F.col("parts") == F.col("total"))
    return totals.join(sums, key, "left").select(key, "total", "parts", ok.alias("reconciles"))


def facts_of(df: DataFrame, subject: str, columns: dict[str, str]) -> DataFrame:
    """subject, path, type, value in long form; columns maps a column to its declared type."""
    rows: list[Column] = [F.struct(F.lit(c).alias("path"), F.lit(k).alias("type"), F.col(c).cast("string").alias("value")) for c, k in columns.items()]
    return df.select(F.col(subject).alias("subject"), F.explode(F.array(*rows)).alias("f")).select("subject", "f.*")


def public_jobs(masters: DataFrame, posts: DataFrame) -> DataFrame:
    """JOIN-17: public_id, master_id, by_post: a master (master_id) is found by its posts (post_id, master_id), or by its own id only if it has none."""
    by_post = posts.join(masters, "master_id").select(F.col("post_id").alias("public_id"), "master_id", F.lit(True).alias("by_post"))
    alone = masters.join(posts, "master_id", "left_anti").select(F.col("master_id").alias("public_id"), "master_id", F.lit(False).alias("by_post"))
    return by_post.unionByName(alone)


def published_posts(posts: DataFrame, current: DataFrame, master_posts: DataFrame) -> DataFrame:
    """JOIN-16: posts (subject, post_key) of subjects with a current master (subject, master_id), which is null where that master lacks the post (master_id, post_key)."""
    has = master_posts.select(F.col("master_id").alias("has_master"), F.col("post_key").alias("has_post"))
    found = posts.join(current, "subject").join(has, (F.col("master_id") == F.col("has_master")) & (F.col("post_key") == F.col("has_post")), "left")
    return found.select("subject", "post_key", F.col("has_master").alias("master_id"))


def with_hashes(revisions: DataFrame) -> DataFrame:
    """FN-1, FN-3, FN-5: revisions (subject, status, priority, excerpt, facts) with input_hash, evidence_hash, fact_set and facts_total."""
    return revisions.select(
        "subject", "facts", canonical_hash(F.col("status"), F.col("priority")).alias("input_hash"), canonical_hash(F.col("subject"), F.col("excerpt")).alias("evidence_hash"),
        fact_set_hash(F.col("facts")).alias("fact_set"), F.greatest(F.coalesce(F.size("facts"), F.lit(0)), F.lit(0)).alias("facts_total"),
    )


def hash_violations(stored: DataFrame, anew: DataFrame) -> DataFrame:
    """PIPE-15, FN-2: subject and violation of each stored hash or count that differs from the one computed anew."""
    checks = {"INPUT_HASH": "input_hash", "EVIDENCE_HASH": "evidence_hash", "FACT_SET": "fact_set", "FACTS": "facts_total"}
    j = stored.alias("s").join(anew.alias("n"), "subject")
    broken = F.array_compact(F.array(*[F.when(~F.col(f"s.{c}").eqNullSafe(F.col(f"n.{c}")), F.lit(v)) for v, c in checks.items()]))
    return j.select("subject", F.explode(broken).alias("violation"))
