"""Filtered, ordered and paged reads, readiness, and eligibility of profiles for jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions.scalars import age_on, lifecycle, word_key

#: Fixed value: the order in which lifecycles are listed.
LIFECYCLES = ("OPEN", "RECENTLY_CLOSED", "UPCOMING", "CLOSED", "UNKNOWN")


def list_rows(df: DataFrame, *, equal: dict | None = None, order: list[Column] | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """SRC-5: optional equality filters, a total order, offset and limit."""
    for c, v in (equal or {}).items():
        df = df if v is None else df.where(F.col(c) == v)
    df = df.orderBy(*order) if order else df
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)


def contains_text(columns: list[str], query: str) -> Column:
    """FLT-13: any column contains the query, whatever the case; no character is a wildcard."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.lower(F.col(c)).contains(query.lower()), F.lit(False)) for c in columns])


def public_filters(*, segment: str | None = None, authority: int | None = None, text: str | None = None, start_from=None, start_to=None, end_from=None, end_to=None, vacancies_from: int | None = None, vacancies_to: int | None = None, status: str | None = None) -> Column:
    """FLT-12: a conjunction of the given predicates; a bound on a null value excludes the row."""
    parts = []
    for column, low, high in (("start_date", start_from, start_to), ("end_date", end_from, end_to), ("vacancies", vacancies_from, vacancies_to)):
        parts += [F.col(column) >= F.lit(low).cast("date" if "date" in column else "int")] if low is not None else []
        parts += [F.col(column) <= F.lit(high).cast("date" if "date" in column else "int")] if high is not None else []
    parts += [F.col(c) == v for c, v in (("segment", segment), ("authority", authority), ("status", status)) if v is not None]
    parts += [contains_text(["name", "segment"], text)] if text else []
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def public_status(state: Column) -> Column:
    return F.when(state.isin("RECENTLY_CLOSED", "CLOSED"), "CLOSED").otherwise(state)


def with_status(jobs: DataFrame, as_of: Column) -> DataFrame:
    """FN-23 on jobs, and the status shown to the public."""
    out = jobs.withColumn("lifecycle", lifecycle("start_date", "end_date", as_of))
    return out.withColumn("status", public_status(F.col("lifecycle")))


def in_history(as_of: Column) -> Column:
    """FLT-14: hides only closed rows that ended over a year ago."""
    return (F.col("status") != "CLOSED") | F.coalesce(F.col("end_date") >= F.add_months(as_of, -12), F.lit(True))


def lifecycle_order(id_col: str, *, start: str = "start_date", end: str = "end_date", refreshed: str | None = None) -> list[Column]:
    """SORT-2: by lifecycle; open and upcoming ones soonest first, closed ones latest first, others latest refreshed first where that is known, nulls last."""
    rank = F.array_position(F.array(*map(F.lit, LIFECYCLES)), F.col("lifecycle"))
    days = lambda c: F.datediff(F.col(c), F.lit("1970-01-01").cast("date"))
    within = F.when(F.col("lifecycle") == "OPEN", days(end)).when(F.col("lifecycle") == "UPCOMING", days(start)).when(F.col("lifecycle").isin("RECENTLY_CLOSED", "CLOSED"), -days(end))
    unknown = [] if refreshed is None else [F.when(F.col("lifecycle") == "UNKNOWN", F.col(refreshed)).desc_nulls_last()]
    return [rank.asc(), within.asc_nulls_last(), *unknown, F.col(id_col).asc()]


SORTS = {
    "newest": lambda i: [F.col("start_date").desc_nulls_last(), F.col(i)], "oldest": lambda i: [F.col("start_date").asc_nulls_last(), F.col(i)],
    "ending_soon": lambda i: [F.col("end_date").asc_nulls_last(), F.col(i)], "ending_late": lambda i: [F.col("end_date").desc_nulls_last(), F.col(i)],
    "most_vacancies": lambda i: [F.col("vacancies").desc_nulls_last(), F.col(i)], "fewest_vacancies": lambda i: [F.col("vacancies").asc_nulls_last(), F.col(i)],
    "name": lambda i: [F.lower("name").asc_nulls_last(), F.col(i)],
}


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """SORT-3, SORT-4: one page by top-k, beside the count of all rows and pages."""
    counts = df.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.ceil(F.col("total") / size).cast("long"))
    rows = df.orderBy(*order).offset((number - 1) * size).limit(size)
    return rows.join(F.broadcast(counts), F.lit(True))  # one row


def readiness(jobs: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """FLT-15: the items that a job misses, and whether it is ready."""
    missing = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(k)) for k, ok in checks.items()]))
    return jobs.withColumn("missing", missing).withColumn("ready", F.size("missing") == 0)


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """WIN-2, WIN-14, WIN-15, SORT-6: the first row of each key."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("nth = 1").drop("nth")


def capped_by(df: DataFrame, key: str, order: list[Column], cap: int) -> DataFrame:
    """SORT-8: at most cap rows of a key, and whether the key had more. Rows are counted by aggregate, and the window keeps cap rows of a key in each task before it shuffles."""
    top = df.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("nth") <= cap)
    return top.join(df.groupBy(key).agg((F.count(F.lit(1)) > cap).alias("exceeded")), key)


def sections(fields: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """FLT-22: fields by the first prefix rule that fits; others go to the overview."""
    out = F.lit("overview")
    for prefix, section in reversed(rules):
        out = F.when(F.col("path").startswith(prefix), F.lit(section)).otherwise(out)
    return fields.withColumn("section", out)


def visible_path(path: Column, post_key: Column, collides: Column) -> Column:
    """FLT-21: a post's own path without its prefix; a shared path that collides with one gets another."""
    own = F.concat(F.lit("posts."), post_key, F.lit("."))
    return F.when(path.startswith(own), path.substr(F.length(own) + 1, F.length(path))).when(collides, F.concat(F.lit("advertisement."), path)).otherwise(path)


#: Fixed value: outcomes from least to most severe.
SEVERITY = ("ELIGIBLE", "UNKNOWN", "REVIEW_REQUIRED", "NOT_ELIGIBLE")


def overall(*outcomes: Column) -> Column:
    """AGG-28: the most severe outcome."""
    names = F.array(*map(F.lit, SEVERITY))
    return F.element_at(names, F.greatest(*[F.array_position(names, o) for o in outcomes]).cast("int"))


def age_outcome(age: Column, low: Column, high: Column, category: Column, relaxation: Column) -> Column:
    """PIPE-19, age: below is out; above is out for the general category, beyond a structured relaxation too, and else for review."""
    general = category.isNull() | (category == "GENERAL")
    return (
        F.when(low.isNull() & high.isNull(), "UNKNOWN").when(age.isNull(), "UNKNOWN").when(age < low, "NOT_ELIGIBLE").when(high.isNull() | (age <= high), "ELIGIBLE")
        .when(general, "NOT_ELIGIBLE").when(relaxation.isNull(), "REVIEW_REQUIRED").when(age > high + relaxation, "NOT_ELIGIBLE").otherwise("ELIGIBLE")
    )


def eligible_jobs(profiles: DataFrame, rules: DataFrame) -> DataFrame:
    """JOIN-13, the age rule of PIPE-19 alone: by profile, how many rules' outcomes there are.

    A rule's outcome changes at a few ages, so that the counts of all rules at an age are the running sum
    of their changes: nothing is paired. Rules are first reduced to distinct bounds and these to the
    changes at an age; profiles take their counts by an equi-join. profiles: profile_id, age, category;
    rules: low, high, relaxation. Ages and bounds are whole years.
    """
    bounds = rules.groupBy("low", "high", "relaxation").agg(F.count(F.lit(1)).alias("jobs"))
    low, high = F.col("low").cast("int"), F.col("high").cast("int")
    ever = F.lit(-(1 << 31))
    above = F.greatest(high + 1, F.coalesce(low, high + 1))
    # what a rule says from an age on, for the general category and for the others
    start = F.when(low.isNull() & high.isNull(), "UNKNOWN").when(low.isNull(), "ELIGIBLE").otherwise("NOT_ELIGIBLE")
    over = F.when(F.col("general"), "NOT_ELIGIBLE").when(F.col("relaxation").isNull(), "REVIEW_REQUIRED").otherwise("ELIGIBLE")
    eased = F.greatest((high + F.col("relaxation") + 1).cast("int"), above)
    says = F.array_compact(F.array(
        F.struct(ever.alias("age"), start.alias("outcome")), F.when(low.isNotNull(), F.struct(low.alias("age"), F.lit("ELIGIBLE").alias("outcome"))),
        F.when(high.isNotNull(), F.struct(above.alias("age"), over.alias("outcome"))),
        F.when(high.isNotNull() & ~F.col("general") & F.col("relaxation").isNotNull(), F.struct(eased.alias("age"), F.lit("NOT_ELIGIBLE").alias("outcome"))),
    ))
    change = lambda s, i, name: (s["outcome"] == name).cast("long") - F.coalesce((F.get("says", i - 1)["outcome"] == name).cast("long"), F.lit(0))
    names = [s.lower() for s in SEVERITY]
    moves = F.transform("says", lambda s, i: F.struct(s["age"].alias("age"), *[(F.col("jobs") * F.when(i > 0, change(s, i, n.upper())).otherwise((s["outcome"] == n.upper()).cast("long"))).alias(n) for n in names]))
    both = bounds.withColumn("general", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("says", says)
    changes = both.select("general", F.explode(moves).alias("m")).select("general", "m.*")
    seen = profiles.select("profile_id", F.col("age").cast("int").alias("age"), (F.col("category").isNull() | (F.col("category") == "GENERAL")).alias("general"))
    ages = seen.where("age is not null").select("general", "age").distinct().select("general", "age", *[F.lit(0).cast("long").alias(n) for n in names])
    at = changes.unionByName(ages).groupBy("general", "age").agg(*[F.sum(n).alias(n) for n in names])
    so_far = Window.partitionBy("general").orderBy("age").rowsBetween(Window.unboundedPreceding, 0)  # a row for each year
    told = at.select("general", "age", *[F.sum(n).over(so_far).alias(n) for n in names])
    ageless = bounds.agg(F.coalesce(F.sum("jobs"), F.lit(0)).alias("all"))
    known = seen.where("age is not null").join(told, ["general", "age"]).select("profile_id", *names)
    zero = F.lit(0).cast("long")
    unknown = seen.where("age is null").join(F.broadcast(ageless), F.lit(True)).select("profile_id", *[(F.col("all") if n == "unknown" else zero).alias(n) for n in names])  # one row
    return known.unionByName(unknown)


#: What an eligibility rule is made of.
RULE = ("low", "high", "cutoff", "relaxations", "qualification", "qualification_kind", "domicile", "months", "years", "experience")
#: Slices into which the profiles of one year of birth are dealt, so that a year that many share is many tasks' work; each rule meets every slice.
SLICES = 8


def day_key(day: Column) -> Column:
    """A date as an integer in which a year is 10,000: someone is at least n years old on a day if the key of the birth is at most the day's less 10,000 n."""
    return F.year(day).cast("long") * 10_000 + F.month(day) * 100 + F.dayofmonth(day)


def _distinct_rules(rules: DataFrame, region: str) -> DataFrame:
    """The distinct rules, what their texts say decided once: first_job, jobs, birth bounds, wanted (a qualification's key), domicile_rule, least (months)."""
    whole = lambda c: F.col(c).try_cast("int").cast("long")
    low, high, text = whole("low"), whole("high"), F.lower("domicile")
    unread = F.col("cutoff").isNull() | (F.col("low").isNotNull() & low.isNull()) | (F.col("high").isNotNull() & high.isNull())
    cutoff, least = day_key(F.col("cutoff")), F.coalesce(F.col("months"), F.col("years") * 12)
    known = text.contains(region.lower()) & text.rlike("domicile|resident")
    return rules.groupBy(*RULE).agg(F.count(F.lit(1)).alias("jobs"), F.min("job_id").alias("first_job")).select(
        "first_job", "jobs", "relaxations",
        F.when(F.col("low").isNull() & F.col("high").isNull(), "NONE").when(unread, "UNREAD").otherwise("BOUNDS").alias("age_rule"),
        (cutoff - low * 10_000).alias("old_enough"), (cutoff - (high + 1) * 10_000).alias("too_old"),
        F.when(F.col("qualification").isNull(), "NONE").when(F.col("qualification_kind") == "STRING", "TEXT").otherwise("OTHER").alias("qualification_rule"), word_key("qualification").alias("wanted"),
        F.when(text.isNull(), "NONE").when(known, "REGION").otherwise("OTHER").alias("domicile_rule"),
        F.when(least.isNotNull(), "MONTHS").when(F.col("experience").isNotNull(), "OTHER").otherwise("NONE").alias("experience_rule"), least.alias("least"),
    )


#: Keys below and above those of all dates.
_EVER, _NEVER = -(1 << 62), 1 << 62


def _zones(rules: DataFrame) -> DataFrame:
    """Rules by the zones of births in which their age criterion says one thing: after (exclusive), upto (inclusive), zone.

    FIT lies between the bounds, YOUNG below the minimum and OLD above the maximum, which relaxations may
    mend; a rule without bounds that can be read has one zone of all births. The zones of a rule
    are disjoint and cover every birth.
    """
    low, high = F.coalesce("old_enough", F.lit(_NEVER)), F.coalesce("too_old", F.lit(_EVER))
    zone = lambda name, after, upto: F.struct(F.lit(name).alias("zone"), after.alias("after"), upto.alias("upto"))
    ever, never = F.lit(_EVER), F.lit(_NEVER)
    bounds = F.array(zone("YOUNG", low, never), zone("FIT", F.least(high, low), low), zone("OLD", ever, F.least(high, low)))
    out = rules.withColumn("z", F.explode(F.when(F.col("age_rule") == "BOUNDS", bounds).otherwise(F.array(zone("ANY", ever, never)))))
    return out.select("*", "z.*").drop("z").where("after < upto")


def _seen(profiles: DataFrame) -> DataFrame:
    """Profiles with their key and year of birth, their slice and the keys of their qualifications; a profile without a birth is of the year 0, in every zone."""
    return profiles.select(
        "profile_id", "category", "lives_there", "experience_months", day_key(F.col("born")).alias("birth"), F.coalesce(F.year("born").cast("long"), F.lit(0)).alias("year"),
        F.pmod(F.xxhash64("profile_id"), F.lit(SLICES)).cast("int").alias("slice"), F.array_distinct(F.transform("qualifications", lambda x: word_key(x))).alias("held"),
    )


def _years(zones: DataFrame, seen: DataFrame) -> DataFrame:
    """Zones once for each year of birth that they touch, among the years in which a profile was born, and for each slice."""
    born = seen.select("year").where("year <> 0").distinct()
    years = born.agg(F.coalesce(F.min("year"), F.lit(0).cast("long")).alias("first"), F.coalesce(F.max("year"), F.lit(-1).cast("long")).alias("last"))  # one row
    of = lambda key: F.floor(key / 10_000).cast("long")
    start, stop = F.greatest(of(F.col("after")), F.col("first")), F.least(of(F.col("upto")), F.col("last"))
    near = zones.join(F.broadcast(years), F.lit(True)).withColumn("year", F.explode(F.when(start <= stop, F.sequence(start, stop)).otherwise(F.array().cast("array<bigint>")))).drop("first", "last")
    return near.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))


def _outcomes(pairs: DataFrame) -> DataFrame:
    """PIPE-19 of pairs of a profile and the zone of a rule: the four criteria's outcomes and the most severe."""
    relaxation = F.get(F.transform(F.filter("relaxations", lambda x: x["category"] == F.col("category")), lambda x: x["years"]), F.lit(0))
    general = F.col("category").isNull() | (F.col("category") == "GENERAL")
    older = F.when(general, "NOT_ELIGIBLE").when(relaxation.isNull(), "REVIEW_REQUIRED").when(F.col("birth") <= F.col("too_old") - relaxation.cast("long") * 10_000, "NOT_ELIGIBLE").otherwise("ELIGIBLE")
    age = (
        F.when((F.col("age_rule") == "NONE") | F.col("birth").isNull(), "UNKNOWN").when(F.col("age_rule") == "UNREAD", "REVIEW_REQUIRED").when(F.col("zone") == "YOUNG", "NOT_ELIGIBLE")
        .when(F.col("zone") == "FIT", "ELIGIBLE").otherwise(older)
    )
    match = (F.col("qualification_rule") == "TEXT") & F.array_contains("held", F.col("wanted"))
    qualification = F.when((F.col("qualification_rule") == "NONE") | F.coalesce(F.size("held") == 0, F.lit(True)), "UNKNOWN").when(match, "ELIGIBLE").otherwise("REVIEW_REQUIRED")
    lives, has = F.col("lives_there"), F.col("experience_months")
    domicile = F.when(F.col("domicile_rule") == "NONE", "UNKNOWN").when(F.col("domicile_rule") == "OTHER", "REVIEW_REQUIRED").when(lives.isNull(), "UNKNOWN").when(lives, "ELIGIBLE").otherwise("NOT_ELIGIBLE")
    rule = F.col("experience_rule")
    experience = F.when(rule == "NONE", "UNKNOWN").when(rule == "OTHER", "REVIEW_REQUIRED").when(has.isNull(), "UNKNOWN").when(has >= F.col("least"), "ELIGIBLE").otherwise("NOT_ELIGIBLE")
    out = pairs.select("profile_id", "first_job", "jobs", age.alias("age"), qualification.alias("qualification"), domicile.alias("domicile"), experience.alias("experience"))
    return out.withColumn("outcome", overall(*map(F.col, ("age", "qualification", "domicile", "experience"))))


def evaluate_eligibility(profiles: DataFrame, rules: DataFrame, region: str) -> DataFrame:
    """PIPE-19, JOIN-13, AGG-28: by profile and distinct rule, the four criteria's outcomes and the most severe.

    profiles: profile_id, born, category, qualifications (array), lives_there, experience_months. rules:
    job_id and RULE; low and high are text as published, relaxations an array of (category, years).
    A rule's jobs, counted in jobs and the least in first_job, share its outcome; jobs meet their rule again
    by RULE. Every profile is told about every distinct rule, so the result is as large as that says:
    eligible_pairs finds the fitting ones without it. A profile meets the one zone of a rule's ages in which it
    was born, by year and slice; texts are read once a rule or profile.
    """
    seen, zones = _seen(profiles), _zones(_distinct_rules(rules, region))
    dated = seen.join(_years(zones, seen), ["year", "slice"]).where("birth > after and birth <= upto")
    # without a birth no zone is needed: the rule meets it as it is
    all_births = F.lit("ANY").alias("zone"), F.lit(_EVER).alias("after"), F.lit(_NEVER).alias("upto"), F.lit(0).cast("long").alias("year")
    undated = _distinct_rules(rules, region).select("*", *all_births, F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("slice"))
    missing = seen.where("birth is null").join(undated, ["year", "slice"])
    return _outcomes(dated.unionByName(missing))


def eligible_pairs(profiles: DataFrame, rules: DataFrame, region: str) -> DataFrame:
    """JOIN-13, PIPE-19: the pairs of a profile and a distinct rule that come out ELIGIBLE, and no others are made.

    A pair is eligible only if a qualification that the profile holds has the rule's key and the birth lies
    in a zone that is not YOUNG, so profiles and rules meet by that key, year of birth and slice; what
    is left is decided on the pair. Same inputs and columns as evaluate_eligibility. A profile
    without a birth, qualification, residence or experience is eligible nowhere.
    """
    may = "age_rule = 'BOUNDS' and qualification_rule = 'TEXT' and domicile_rule = 'REGION' and experience_rule = 'MONTHS'"
    seen = _seen(profiles).where("birth is not null and lives_there and experience_months is not null")
    eased = F.coalesce(F.array_max(F.transform("relaxations", lambda x: x["years"])), F.lit(0))
    zones = _zones(_distinct_rules(rules, region).where(may)).where("zone <> 'YOUNG'")
    zones = zones.withColumn("after", F.when(F.col("zone") == "OLD", F.col("too_old") - eased.cast("long") * 10_000).otherwise(F.col("after"))).where("after < upto")
    wanted = _years(zones, seen)
    each = seen.withColumn("wanted", F.explode("held"))
    pairs = each.join(wanted, ["wanted", "year", "slice"]).where("birth > after and birth <= upto and experience_months >= least")
    return _outcomes(pairs).where("outcome = 'ELIGIBLE'")


def detail_results(jobs: DataFrame, links: DataFrame, sources: DataFrame) -> DataFrame:
    """PIPE-18, JOIN-1: job_id, sources, result: a job with a source that is missing or of another authority isn't shown.

    jobs: job_id, authority; links: job_id, source_id; sources: source_id, source_authority.
    """
    j = links.join(jobs, "job_id").join(sources, "source_id", "left")
    own = F.bool_and(F.col("source_authority") == F.col("authority"))
    out = j.groupBy("job_id").agg(F.count(F.lit(1)).alias("sources"), F.bool_or(F.col("source_authority").isNull()).alias("missing"), own.alias("own"))
    return out.select("job_id", "sources", F.when(F.col("missing"), "SOURCE_MISSING").when(~F.col("own"), "OTHER_AUTHORITY").otherwise("SHOWN").alias("result"))
