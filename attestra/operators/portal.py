"""The review portal's list: units of three families told apart, counted, filtered, searched and paged; public sort modes; reviews by source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions.scalars import lifecycle

from .serving import lifecycle_order

IDENTITY = ["authority", "candidate", "post_key"]
#: Fixed value: families by which of them stands for an identity that several hold.
FAMILIES = ("ACTIVE", "PUBLISHED", "RESOLVED")
#: Fixed value: outcomes that count as approved.
APPROVED = ("APPROVED", "APPROVED_WITH_CORRECTIONS")
#: The texts that a search looks through, in this order, a space between them.
SEARCHED = ("post_name", "organization", "authority_name", "title")


def portal_rows(rows: DataFrame, order: list[str], as_of: Column) -> DataFrame:
    """PIPE-25, SET-1, SET-2, WIN-14: each family's first row of an identity, its lifecycle, and whether it leads.

    rows: family, IDENTITY, status, outcome, path, priority, completeness, SEARCHED, opening_date,
    closing_date, refreshed_at and the columns of order, by which the first one is told. A row without a
    post isn't shown where any family has posts of its candidate. leads marks the row that stands for the
    identity among all families. Rows are first reduced within each task; the windows that follow are of a
    candidate's rows, on one shuffle.
    """
    held = [c for c in rows.columns if c not in (*IDENTITY, "family")]
    each = rows.groupBy("family", *IDENTITY).agg(F.min_by(F.struct(*held), F.struct(*order)).alias("r")).select("family", *IDENTITY, "r.*")
    candidate, identity = Window.partitionBy("authority", "candidate"), Window.partitionBy("authority", "candidate", "post_key")
    rank = F.array_position(F.array(*map(F.lit, FAMILIES)), F.col("family"))
    shown = each.withColumn("split", F.max(F.col("post_key").isNotNull()).over(candidate)).where("post_key is not null or not split").drop("split")
    led = shown.withColumn("rank", rank).withColumn("leads", F.col("rank") == F.min("rank").over(identity)).drop("rank")
    return led.withColumn("lifecycle", lifecycle("opening_date", "closing_date", as_of)).withColumn("stable_id", F.concat_ws(":", *[F.col(c).cast("string") for c in IDENTITY]))


def in_state(selected: str) -> Column:
    """The rows of one of the portal's seven states."""
    return {
        "ALL": F.col("leads"),
        "REVIEW_REQUIRED": (F.col("family") == "ACTIVE") & (F.col("status") == "QUEUED"),
        "IN_REVIEW": (F.col("family") == "ACTIVE") & (F.col("status") == "IN_REVIEW"),
        "RESOLVED": (F.col("family") == "RESOLVED") & F.col("outcome").isin(*APPROVED),
        "REJECTED": (F.col("family") == "RESOLVED") & (F.col("outcome") == "REJECTED"),
        "AUTO_PUBLISHED": (F.col("family") == "PUBLISHED") & (F.col("path") == "AUTO_PUBLISHED"),
        "HUMAN_PUBLISHED": (F.col("family") == "PUBLISHED") & (F.col("path") == "HUMAN_PUBLISHED"),
    }[selected]


def portal_counts(rows: DataFrame) -> DataFrame:
    """PIPE-25, AGG-20: one row, the identities and the rows of each state, of what portal_rows gives."""
    states = {"total_jobs": "ALL", "review_required": "REVIEW_REQUIRED", "in_review": "IN_REVIEW", "approved": "RESOLVED", "rejected": "REJECTED", "auto_published": "AUTO_PUBLISHED", "human_published": "HUMAN_PUBLISHED"}
    return rows.agg(*[F.count_if(in_state(s)).alias(c) for c, s in states.items()])


def portal_filter(rows: DataFrame, *, selected: str = "ALL", outcome: str | None = None, priority: str | None = None, completeness: str | None = None, text: str = "") -> DataFrame:
    """PIPE-25, FLT-13: a state's rows under the given filters; text is looked for across SEARCHED whatever the case, and none of its characters is a wildcard."""
    out = rows.where(in_state(selected))
    if outcome is not None:
        out = out.where(F.col("outcome").isin(*APPROVED) if outcome == "APPROVED" else F.col("outcome") == outcome)
    for column, value in (("priority", priority), ("completeness", completeness)):
        out = out if value is None else out.where(F.col(column) == value)
    term = text.strip().lower()
    return out.where(F.lower(F.concat_ws(" ", *SEARCHED)).contains(term)) if term else out


def clamped_page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """SORT-4 with a page that exists: a number beyond the last page is the last one, below the first the first; an empty table has one empty page. The rows are counted by a job of their own."""
    total = rows.count()
    pages = max(1, -(-total // size))
    number = min(max(number, 1), pages)
    found = rows.orderBy(*order).offset((number - 1) * size).limit(size)
    return found.withColumns({"total": F.lit(total).cast("long"), "pages": F.lit(pages).cast("long"), "page": F.lit(number).cast("long")})


def portal_order() -> list[Column]:
    """SORT-2 in the portal: lifecycles without a date of their own latest refreshed first, ties by the identity."""
    return lifecycle_order("stable_id", start="opening_date", end="closing_date", refreshed="refreshed_at")


#: SORT-3: the seven public orders; dates and numbers that are missing come last in all of them.
SORT_MODES = {
    "published_desc": lambda i: [F.col("published_at").desc(), F.col(i)],
    "published_asc": lambda i: [F.col("published_at").asc(), F.col(i)],
    "application_end_asc": lambda i: [F.col("end_date").asc_nulls_last(), F.col(i)],
    "application_end_desc": lambda i: [F.col("end_date").desc_nulls_last(), F.col(i)],
    "display_name_asc": lambda i: [F.lower("name"), F.col("candidate"), F.col(i)],
    "vacancies_desc": lambda i: [F.col("vacancies").desc_nulls_last(), F.col(i)],
    "lifecycle": lambda i: lifecycle_order(i, refreshed="published_at"),
}


def sort_pages(jobs: DataFrame, size: int, *, id_col: str = "job_id") -> DataFrame:
    """SORT-3: the first page in each of SORT_MODES: mode, place, id. Each is a top-k, so that only `size` rows of a mode leave a task."""
    pages = None
    for mode, order in SORT_MODES.items():
        top = jobs.orderBy(*order(id_col)).limit(size)
        # the window is over one page
        one = top.select(F.lit(mode).alias("mode"), F.row_number().over(Window.orderBy(*order(id_col))).alias("place"), id_col)
        pages = one if pages is None else pages.unionByName(one)
    return pages


def review_counts(cases: DataFrame, revisions: DataFrame, candidates: DataFrame, authorities: DataFrame, states: list[str]) -> DataFrame:
    """AGG-23: by source, how many cases of its candidates' revisions are in each state (columns in lower case); a source without cases has zeros.

    cases: revision_id, status; revisions: revision_id, candidate_id; candidates: candidate_id,
    authority_id; authorities: authority_id, code. Cases are counted before each join, on the join's own key, so
    that what is shuffled next has a row for each key.
    """
    names = [s.lower() for s in states]
    add = [F.sum(n).alias(n) for n in names]
    by_revision = cases.groupBy("revision_id").agg(*[F.count_if(F.col("status") == s).alias(n) for s, n in zip(states, names)])
    by_candidate = by_revision.join(revisions.select("revision_id", "candidate_id"), "revision_id").groupBy("candidate_id").agg(*add)
    by_authority = by_candidate.join(candidates.select("candidate_id", "authority_id"), "candidate_id").groupBy("authority_id").agg(*add)
    return authorities.join(by_authority, "authority_id", "left").select("code", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names])
