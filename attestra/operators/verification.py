"""Evidence counts, outcomes, confidence under two policies, and routing to review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions.scalars import clamp, comparison_text, let

CLASSES = {"auth": "AUTHORITATIVE_OFFICIAL", "official": "OFFICIAL_SUPPORTING", "secondary": "SECONDARY_DISCOVERY_ONLY"}
DIRECTIONS = {"support": "SUPPORTS", "conflict": "CONTRADICTS"}
OUTCOMES = ("CONFIRMED", "CONFLICT", "INSUFFICIENT_EVIDENCE", "NOT_APPLICABLE")
PRIORITIES = ("NONE", "NORMAL", "HIGH", "CRITICAL")


def count_evidence(fields: DataFrame, assessments: DataFrame) -> DataFrame:
    """AGG-1, AGG-4: by field, six counts of evidence and six of distinct endpoints, and all evidence; fields without any stay.

    The assessments are dealt out once, by field: counting endpoints first and fields then needs no
    other shuffle, and no row is expanded for the distinct counts.
    """
    each = assessments.repartition("field_id").groupBy("field_id", "endpoint_id", "source_class", "assessment").agg(F.count(F.lit(1)).alias("n"))
    totals = [F.sum("n").alias("evidence_count")]
    for c, cls in CLASSES.items():
        for d, direction in DIRECTIONS.items():
            hit = (F.col("source_class") == cls) & (F.col("assessment") == direction)
            totals += [F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias(f"{c}_{d}"), F.count(F.when(hit, 1)).alias(f"{c}_{d}_endpoints")]
    counted = each.groupBy("field_id").agg(*totals)
    return fields.join(counted, "field_id", "left").fillna(0, [c for c in counted.columns if c != "field_id"])


def decide_outcome(counts: DataFrame) -> DataFrame:
    """AGG-2: adds reason and outcome; the first condition that holds decides."""
    support, conflict = F.col("official_support") + F.col("secondary_support"), F.col("official_conflict") + F.col("secondary_conflict")
    reason = (
        F.when(F.col("not_applicable"), "MANUALLY_MARKED_NOT_APPLICABLE").when(F.col("auth_conflict") > 0, "AUTHORITATIVE_CONFLICT").when(F.col("auth_support") > 0, "AUTHORITATIVE_SUPPORT")
        .when((support > 0) & (conflict > 0), "SOURCE_CONFLICT").when(F.col("evidence_count") == 0, "NO_EVIDENCE")
        .when((F.col("secondary_support") > 0) & (F.col("official_support") == 0) & (conflict == 0), "ONLY_SECONDARY_EVIDENCE").otherwise("INSUFFICIENT_SUPPORT")
    )
    outcome = F.when(F.col("reason") == "MANUALLY_MARKED_NOT_APPLICABLE", "NOT_APPLICABLE").when(F.col("reason").isin("AUTHORITATIVE_CONFLICT", "SOURCE_CONFLICT"), "CONFLICT").when(F.col("reason") == "AUTHORITATIVE_SUPPORT", "CONFIRMED").otherwise("INSUFFICIENT_EVIDENCE")
    return counts.withColumn("reason", reason).withColumn("outcome", outcome)


def run_counters(verified: DataFrame) -> DataFrame:
    """AGG-3: fields of each run by outcome."""
    return verified.groupBy("run_id").agg(*[F.count_if(F.col("outcome") == o).alias(o.lower()) for o in OUTCOMES], F.count(F.lit(1)).alias("fields_total"))


def capped(count: Column, each: int, cap: int) -> Column:
    """AGG-5: points for a count, as far as the cap; a negative cap is a floor."""
    return F.least(count * each, F.lit(cap)) if each > 0 else F.greatest(count * each, F.lit(cap))


#: Where a score starts by reason, and points by endpoint with their caps.
ANCHORS = {"AUTHORITATIVE_SUPPORT": 90, "AUTHORITATIVE_CONFLICT": 15, "SOURCE_CONFLICT": 35, "NO_EVIDENCE": 20, "ONLY_SECONDARY_EVIDENCE": 45, "INSUFFICIENT_SUPPORT": 40}


def field_score_v1(verified: DataFrame) -> DataFrame:
    """AGG-6: adds score (null where not applicable)."""
    anchor = F.create_map(*[x for k, v in ANCHORS.items() for x in (F.lit(k), F.lit(v))])[F.col("reason")]
    extra = F.greatest(F.col("auth_support_endpoints") - 1, F.lit(0))
    points = capped(extra, 3, 6) + capped(F.col("official_support_endpoints"), 2, 4) + capped(F.col("secondary_support_endpoints"), 1, 2) + capped(F.col("secondary_conflict_endpoints"), -5, -10) + capped(F.col("official_conflict_endpoints"), -12, -24)
    score = clamp(anchor + points)
    score = F.when(F.col("auth_conflict") > 0, F.least(score, F.lit(25))).otherwise(score)
    return verified.withColumn("score", F.when(~F.col("not_applicable"), score).cast("int"))


def field_review_v1(scored: DataFrame) -> DataFrame:
    """PIPE-6: adds reasons (array) and priority of a field."""
    known = F.col("score").isNotNull()
    conflict = F.col("reason").isin("AUTHORITATIVE_CONFLICT", "SOURCE_CONFLICT", "NO_EVIDENCE", "ONLY_SECONDARY_EVIDENCE", "INSUFFICIENT_SUPPORT")
    parts = [F.when(known & conflict, F.col("reason")), F.when(known & F.col("critical") & (F.col("score") < 90), "CRITICAL_FIELD_BELOW_THRESHOLD"), F.when(known & F.col("critical") & (F.col("auth_support") == 0), "CRITICAL_FIELD_NO_AUTHORITATIVE_SUPPORT"), F.when(known & ~F.col("critical") & (F.col("score") < 80), "FIELD_SCORE_BELOW_THRESHOLD")]
    out = scored.withColumn("reasons", F.array_compact(F.array(*parts)))
    auth = F.col("reason") == "AUTHORITATIVE_CONFLICT"
    high = auth | (F.col("critical") & ((F.col("reason") == "SOURCE_CONFLICT") | (F.col("auth_support") == 0) | (F.col("score") < 50)))
    rank = F.when(F.size("reasons") == 0, 0).when(auth & F.col("critical"), 3).when(high, 2).otherwise(1)
    return out.withColumn("priority_rank", rank)


def revision_score(scored: DataFrame, *, policy: int) -> DataFrame:
    """AGG-8, AGG-9, AGG-10, AGG-12, AGG-13: by run, the weighted score, coverage and counts.

    Critical fields weigh 2, others 1, null scores nothing. Version 1 multiplies by coverage; version
    2 takes 20 off an ambiguous split instead. Scores round half up, coverage half to even.
    """
    weight = F.when(F.col("critical"), 2).otherwise(1)
    known = F.col("score").isNotNull()
    final = F.when(F.col("outcome").isNotNull(), 1)
    out = scored.groupBy("run_id").agg(
        F.sum(F.when(known, F.col("score") * weight)).cast("decimal(18,0)").alias("points"), F.sum(F.when(known, weight)).cast("decimal(18,0)").alias("weights"), F.count(F.lit(1)).alias("fields_total"), F.count(final).alias("finalised"),
        F.count_if("critical").alias("critical_fields"), F.count_if(F.col("outcome") != "CONFIRMED").alias("unconfirmed_fields"), F.max(F.col("ambiguous").cast("int")).alias("ambiguous"), *([F.max("priority_rank").alias("priority_rank")] if "priority_rank" in scored.columns else []),
    )
    ratio = F.col("finalised").cast("decimal(18,0)") / F.col("fields_total").cast("decimal(18,0)")
    out = out.withColumn("coverage", F.bround(ratio, 4).cast("decimal(5,4)"))
    mean = F.col("points") / F.col("weights")
    if policy == 1:
        score = F.round(mean * F.col("coverage"), 0).cast("int")
    else:
        score = F.greatest(F.round(mean, 0).cast("int") - 20 * F.col("ambiguous"), F.lit(0))
    return out.withColumn("score", score)


def field_score_v2(verified: DataFrame) -> DataFrame:
    """AGG-7: adds score from presence of support and conflict, extraction, locator and ambiguity."""
    has = lambda c: F.col(c) > 0
    base = F.when(F.col("outcome") == "CONFIRMED", 50).when(F.col("outcome") == "CONFLICT", 20).when(F.col("outcome") == "INSUFFICIENT_EVIDENCE", 25)
    when = lambda cond, n: F.when(cond, n).otherwise(0)
    method = F.when(F.col("method").isNull(), 0).when((F.col("method") == "CONTROLLED_INPUT") | F.col("method").endswith("_V1"), 10).otherwise(5)
    supporters = F.col("auth_support_endpoints") + F.col("official_support_endpoints") + F.col("secondary_support_endpoints")
    points = when(has("auth_support"), 30) + when(has("official_support"), 20) + when(has("secondary_support"), 8) + method + when(F.col("has_locator"), 5)
    points = points + F.greatest(F.lit(0), F.least(supporters - 1, F.lit(5))) - when(has("auth_conflict"), 45) - when(has("official_conflict"), 30) - when(has("secondary_conflict"), 10) - when(F.col("ambiguous"), 30)
    return verified.withColumn("score", F.when(base.isNotNull(), clamp(base + points)).cast("int"))


#: Reasons for review, in the order in which they are listed.
ROUTING = ("AUTHORITATIVE_CONFLICT", "SOURCE_CONFLICT", "INSUFFICIENT_CRITICAL_EVIDENCE", "UNCLEAR_CRITICAL_MEANING", "AMBIGUOUS_POST_DETAILS", "UNCERTAIN_VACANCY_MAPPING", "POSSIBLE_WRONG_POST_OWNERSHIP", "AMBIGUOUS_POST_SPLIT", "PARTIAL_VERIFICATION", "MISSING_PUBLIC_REQUIRED_FIELDS")


def route_review(verified: DataFrame, partial_runs: DataFrame) -> DataFrame:
    """PIPE-8, AGG-11: by run, the union of its fields' reasons in listed order, and the highest priority with its floors.

    partial_runs has run_id of runs that ended early. A field's priority: authoritative conflict of a
    critical field CRITICAL, other conflicts and missing critical evidence HIGH.
    """
    weak = F.col("critical") & (F.col("outcome") == "INSUFFICIENT_EVIDENCE")
    field = F.array_compact(F.array(
        F.when(F.col("reason").isin("AUTHORITATIVE_CONFLICT", "SOURCE_CONFLICT"), F.col("reason")), F.when(weak, "INSUFFICIENT_CRITICAL_EVIDENCE"), F.when(weak, "UNCLEAR_CRITICAL_MEANING"), F.when(F.col("ambiguous"), "AMBIGUOUS_POST_DETAILS"),
    ))
    rank = F.when((F.col("reason") == "AUTHORITATIVE_CONFLICT") & F.col("critical"), 3).when((F.col("outcome") == "CONFLICT") | weak, 2).when(F.col("ambiguous"), 1).otherwise(0)
    runs = verified.select("run_id", field.alias("r"), rank.alias("rank")).groupBy("run_id").agg(F.array_distinct(F.flatten(F.collect_set("r"))).alias("found"), F.max("rank").alias("rank"))
    runs = runs.join(partial_runs.select("run_id", F.lit(True).alias("partial")), "run_id", "left")
    found = F.when(F.col("partial"), F.array_append("found", F.lit("PARTIAL_VERIFICATION"))).otherwise(F.col("found"))
    ordered = F.filter(F.array(*map(F.lit, ROUTING)), lambda x: F.array_contains(F.col("all"), x))
    out = runs.withColumn("all", found).withColumn("reasons", ordered).withColumn("rank", F.when(F.col("partial"), F.greatest("rank", F.lit(1))).otherwise(F.col("rank")))
    return out.select("run_id", "reasons", F.element_at(F.array(*map(F.lit, PRIORITIES)), F.col("rank") + 1).alias("priority"), (F.col("rank") > 0).alias("review_required"))


def interpret_text(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """PIPE-3 for strings: facts (fact_id, value) against evidence (evidence_id, excerpt, context) joined on fact_id; containment supports, nothing contradicts."""
    joined = facts.join(evidence, "fact_id")
    inside = comparison_text("excerpt", "context").contains(F.lower(F.trim(F.regexp_replace("value", r"\s+", " "))))
    return joined.select("fact_id", "evidence_id", F.when(inside, "SUPPORTS").otherwise("CONTEXT_ONLY").alias("assessment"))


#: Words of a window by which a fact finds the texts that may contain it.
WINDOW = 8


#: Characters of a gram by which a short fact finds them.
GRAM = 3


def contained_facts(facts: DataFrame, documents: DataFrame) -> DataFrame:
    """PIPE-3 for strings over all pairs: doc_id and fact_id of each text that contains a fact; all other pairs are context.

    facts: fact_id, value; documents: doc_id, text; ids may repeat. A fact's inner words are whole words of
    a text that contains it, so they meet in one window, the one of least hash. A fact of one or two words
    has no inner word and meets texts in one run of characters, of its own the one that fewest texts
    have. What meets is compared in full. Texts are read once for their windows, once for their runs, and
    once to be compared; nothing meets without a key in common. A window is one number, the hash of its
    words' hashes and its width, so that a text's distinct ones are found by hashing, not pair by pair.
    """
    known = facts.select("fact_id", comparison_text("value", F.lit(None).cast("string")).alias("value")).where("value <> ''").distinct()
    words = lambda text: F.transform(F.split(text, " "), lambda w: F.xxhash64(w))
    windows = lambda x, width: F.transform(F.sequence(F.lit(0), F.size(x) - width), lambda i: F.xxhash64(F.lit(width), F.slice(x, i + 1, F.lit(width))))
    inner = known.withColumn("words", F.expr("greatest(size(split(value, ' ')) - 2, 0)")).withColumn("width", F.least("words", F.lit(WINDOW)))
    none = F.expr("cast(array() as array<bigint>)")
    texts = documents.select("doc_id", comparison_text("text", F.lit(None).cast("string")).alias("text"))
    widths = sorted(r["width"] for r in inner.where("width > 0").select("width").distinct().collect())  # WINDOW at most
    met = _met_by_gram(inner.where("width = 0").select("fact_id", "value"), texts)
    if widths:
        least = let(F.slice(words("value"), F.lit(2), F.col("words")), lambda x: F.coalesce(*[F.when(F.col("width") == w, F.array_min(windows(x, w))) for w in widths]))
        keys = inner.where("width > 0").select("fact_id", "value", least.alias("key"))
        every = let(words("text"), lambda x: F.array_distinct(F.concat(*[F.when(F.size(x) >= w, windows(x, w)).otherwise(none) for w in widths])))
        own = texts.select("doc_id", F.explode_outer(every).alias("key"))  # outer: no filter is inferred that computes the windows once more; no key, no match
        met = met.unionByName(own.join(keys, "key").select("doc_id", "fact_id", "value"))
    met = met.select(F.col("doc_id").alias("met"), "fact_id", "value").distinct()
    return texts.join(met, F.col("doc_id").eqNullSafe(F.col("met"))).where(F.col("text").contains(F.col("value"))).select("doc_id", "fact_id").distinct()


def _met_by_gram(facts: DataFrame, texts: DataFrame) -> DataFrame:
    """doc_id, fact_id, value where a text has the run of up to GRAM characters that is the rarest of the fact's own: an inverted index of runs, kept to those that facts have."""
    runs = lambda text, n: F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
    sizes = [r["n"] for r in facts.select(F.least(F.length("value"), F.lit(GRAM)).alias("n")).distinct().collect()]  # GRAM at most
    if not sizes:
        return texts.select("doc_id").join(facts, F.lit(False))
    size = F.least(F.length("value"), F.lit(GRAM))
    own = facts.select("fact_id", "value", F.explode(F.array_distinct(F.coalesce(*[F.when(size == n, runs("value", n)) for n in sizes]))).alias("gram"))
    held = texts.select("doc_id", F.explode(F.array_distinct(F.concat(*[runs("text", n) for n in sizes]))).alias("gram"))
    held = held.join(own.select("gram").distinct(), "gram", "left_semi")
    counts = held.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rare = own.join(counts, "gram", "left").groupBy("fact_id", "value").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), F.col("gram"))).alias("gram"))
    return held.join(rare, "gram").select("doc_id", "fact_id", "value")


# What labels a number, and a date in the order in which labels are tried.
_AGE = r"(?:not\s+(?:be\s+)?{less}\s+than|{least}\s+age)\s*[:=\-]?\s*(\d+)\s*years?\b"
NUMBER_LABELS = {
    "vacancies.total": r"(?:no\.?\s*of\s*posts?|number\s+of\s+posts?|vacanc(?:y|ies)|total\s+posts?)\s*[:=\-]{0,2}\s*0*(\d+)\b",
    **{path: _AGE.format(less="less", least="minimum") for path in ("eligibility.minimum_age", "age.minimum")},
    **{path: _AGE.format(less="more", least="maximum") for path in ("eligibility.maximum_age", "age.maximum")},
}
DATE_LABELS = {
    "application.start_date": ("starting date for online application", "application start date", "start date"), "application.end_date": ("closing date for online application", "application end date", "last date", "end date"),
    "eligibility.age_cutoff_date": ("age cutoff date", "reckoned as on", "as on"), "notification.date": ("notification date", "dated", "guwahati the"),
}


def _asserted(values: Column, expected: Column) -> Column:
    """One labelled value supports or contradicts; none or several are context."""
    return F.when(F.size(values) != 1, "CONTEXT_ONLY").when(F.get(values, F.lit(0)) == expected, "SUPPORTS").otherwise("CONTRADICTS")


def interpret_integer(path: Column, expected: Column, text: Column) -> Column:
    """PIPE-3 and AGG-17 for whole numbers: counts of posts that sum to a total support it, several others are context; else the path's labels decide."""
    number = lambda x: F.regexp_replace(x, ",", "").try_cast("decimal(38,0)")
    expected = expected.try_cast("decimal(38,0)")
    posts = F.transform(F.regexp_extract_all(text, F.lit(r"\b([0-9][0-9,]*)\s+posts?\b"), F.lit(1)), number)
    total = F.aggregate(posts, F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + x).cast("decimal(38,0)"))
    out = F.lit("CONTEXT_ONLY")
    for p, label in NUMBER_LABELS.items():
        found = _asserted(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(label), F.lit(1)), number)), expected)
        if p == "vacancies.total":
            found = F.when((F.size(posts) > 0) & (total == expected), "SUPPORTS").when(F.size(posts) > 1, "CONTEXT_ONLY").otherwise(found)
        out = F.when(path == p, found).otherwise(out)
    return out


def interpret_date(path: Column, expected: Column, text: Column) -> Column:
    """PIPE-3 for dates: the first label with a date after it decides."""
    day = lambda x: F.coalesce(*[F.try_to_timestamp(x, F.lit(f)).cast("date") for f in ("dd/MM/yyyy", "dd-MM-yyyy", "yyyy-MM-dd")])
    out = F.lit("CONTEXT_ONLY")
    for p, labels in DATE_LABELS.items():
        decided = F.lit("CONTEXT_ONLY")
        for label in reversed(labels):
            found = F.regexp_extract_all(text, F.lit(label + r"[^\n]{0,100}?(\d{2}[/-]\d{2}[/-]\d{4}|\d{4}-\d{2}-\d{2})"), F.lit(1))
            values = F.array_distinct(F.array_compact(F.transform(found, day)))
            decided = F.when(F.size(values) > 0, _asserted(values, expected.try_cast("date"))).otherwise(decided)
        out = F.when(path == p, decided).otherwise(out)
    return out


def interpret_evidence(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """PIPE-3: facts (fact_id, path, value_type, value) against their evidence (fact_id, evidence_id, excerpt, context), by the value's type."""
    text, kind = F.col("comparison"), F.col("value_type")
    value = comparison_text("value", F.lit(None).cast("string"))
    joined = facts.join(evidence.withColumn("comparison", comparison_text("excerpt", "context")), "fact_id")
    string = F.when((value != "") & text.contains(value), "SUPPORTS").otherwise("CONTEXT_ONLY")
    assessment = F.when(kind == "STRING", string).when(kind == "INTEGER", interpret_integer(F.col("path"), F.col("value"), text)).when(kind == "DATE", interpret_date(F.col("path"), F.col("value"), text)).otherwise("CONTEXT_ONLY")
    return joined.select("fact_id", "evidence_id", "path", assessment.alias("assessment"))


def select_for_verification(revisions: DataFrame, completed: DataFrame, requests: DataFrame, limit: int) -> DataFrame:
    """PIPE-5, JOIN-5, JOIN-14, SORT-5: revisions (revision_id, created_at) never completed, or asked for again after their last run; oldest first.

    completed has revision_id, completed_at; requests has revision_id, requested_at.
    """
    last = completed.groupBy("revision_id").agg(F.max("completed_at").alias("last_run"))
    asked = requests.groupBy("revision_id").agg(F.max("requested_at").alias("last_request"))
    state = revisions.join(last, "revision_id", "left").join(asked, "revision_id", "left")
    return state.where(F.col("last_run").isNull() | (F.col("last_request") > F.col("last_run"))).orderBy("created_at", "revision_id").limit(limit).select("revision_id", "created_at", "last_run", "last_request")
