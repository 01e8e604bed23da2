"""Listing pages to notices: anchors with what encloses them, a table of rules by source, the last row of each address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions.scalars import listing_date
from attestra.operators.extraction import text_of
from attestra.operators.postings import listing_notices

_UNSEEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
_ALT = r"(?is)<img\b[^>]*?\balt\s*=\s*\"([^\"]*)\"[^>]*>"
_TAG = r"(?i)</?(?:li|tr|article|a)\b[^>]*>"
RULE = "source string, wanted string, unwanted string, excluded string, campaign string, elsewhere string"


def enclosed_anchors(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """SRC-3: id, at, href, link_text, container, context: every anchor with the innermost list item, table row or article that is open where it stands, and all of that one's text.

    Tags are rows of their page. A box's level is the number of boxes open, itself included, so the last
    box opened at an anchor's level is the innermost one around it, and the next that closes there ends
    it: both are windows over page and level, however deep boxes are nested. Comments, scripts and styles
    are not seen, an image's alt text is. Outside of all boxes, container and context are null; a box that is
    never closed reaches to the page's end. A page without anchors gives no rows.
    """
    seen = F.regexp_replace(F.regexp_replace(html_col, _UNSEEN, ""), _ALT, " $1 ")
    base = pages.select(F.col(id_col).alias("id"), seen.alias("html"))
    tags, texts = F.regexp_extract_all("html", F.lit(f"({_TAG})".replace("(?i)", "(?i)", 1)), F.lit(1)), F.split("html", _TAG)
    boxed = lambda t: ~F.lower(t).rlike(r"^</?a\b")
    said = lambda t, i: F.concat(F.when(boxed(t), F.lit(" ")).otherwise(""), F.get(texts, i + 1))
    cut = base.select("id", F.transform(tags, lambda t, i: F.struct(t.alias("tag"), said(t, i).alias("said"))).alias("cut"))
    whole = cut.select("id", F.array_join(F.transform("cut", lambda x: x["said"]), "").alias("page"))
    each = cut.select("id", F.posexplode("cut").alias("at", "x"))
    name, closing = F.lower(F.regexp_extract("x.tag", r"^</?([A-Za-z]+)", 1)), F.col("x.tag").startswith("</")
    rows = each.select("id", "at", "x.tag", F.length("x.said").alias("size"), name.alias("name"), closing.alias("closing"), (name != "a").alias("box"))
    order = Window.partitionBy("id").orderBy("at")
    before, after = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(1, Window.unboundedFollowing)
    step = F.when(F.col("box"), F.when(F.col("closing"), -1).otherwise(1)).otherwise(0)
    placed = rows.withColumn("place", F.sum("size").over(before) - F.col("size")).withColumn("level", F.sum(step).over(before) + (F.col("box") & F.col("closing")).cast("int"))
    placed = placed.withColumn("ends", F.first(F.when((F.col("name") == "a") & F.col("closing"), F.col("place")), ignorenulls=True).over(after))
    level = Window.partitionBy("id", "level").orderBy("at")
    opened = F.last(F.when(F.col("box") & ~F.col("closing"), F.struct("name", "place")), ignorenulls=True).over(level.rowsBetween(Window.unboundedPreceding, 0))
    closed = F.first(F.when(F.col("box") & F.col("closing"), F.col("place")), ignorenulls=True).over(level.rowsBetween(1, Window.unboundedFollowing))
    found = placed.withColumn("opened", F.when(F.col("level") > 0, opened)).withColumn("closed", closed).where(~F.col("box") & ~F.col("closing"))
    part = lambda a, b: text_of(F.col("page").substr(a + 1, F.greatest(F.coalesce(b, F.length("page")) - a, F.lit(0))))
    href = F.regexp_extract("tag", r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]*)", 1)
    joined = found.join(whole, "id")
    return joined.select(
        F.col("id").alias(id_col), "at", href.alias("href"), part(F.col("place"), F.col("ends")).alias("link_text"), F.col("opened.name").alias("container"),
        F.when(F.col("opened").isNotNull(), part(F.col("opened.place"), F.col("closed"))).alias("context"),
    )


def accepted(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """FLT-6, FLT-8, FLT-9 by source: rows (source, title, href, …) whose source's rule wants them; a source without a rule has none.

    rules: RULE, patterns of alternatives: wanted and unwanted of the title, excluded of title and address
    together, campaign that the title must have and elsewhere that it mustn't; a null pattern asks nothing.
    Each title is matched once against each pattern of its own source, whatever the number of terms.
    """
    has = lambda text, pattern: F.coalesce(F.expr(f"{text} rlike {pattern}"), F.lit(False))
    free = lambda text, pattern: F.col(pattern).isNull() | ~has(text, pattern)
    asked = lambda text, pattern: F.col(pattern).isNull() | has(text, pattern)
    j = rows.join(rules, "source").withColumn("both", F.concat_ws(" ", "title", "href"))
    keep = asked("title", "wanted") & free("title", "unwanted") & free("both", "excluded") & asked("title", "campaign") & free("title", "elsewhere")
    return j.where(keep).select(*rows.columns)


def source_labels(href: Column, kind: Column, markers: dict[str, str]) -> Column:
    """FLT-20: the label of the first marker in an address, else 'Official KIND'."""
    out = F.concat(F.lit("Official "), F.upper(kind))
    for marker, label in reversed(markers.items()):
        out = F.when(href.contains(marker), F.lit(label)).otherwise(out)
    return out


def notices_of_pages(pages: DataFrame, rules: DataFrame, cutoff: Column, cap: int, id_col: str = "page_id") -> DataFrame:
    """EXT-14: source, url, title, day, exceeded: SRC-3, the rules of each source, the history's cutoff (FLT-10), the last row of each address (WIN-15) and the cap (SORT-8) as one job.

    pages: id, source, html. Rows without a date stay. Rows are numbered by page and place.
    """
    links = enclosed_anchors(pages, id_col).join(pages.select(id_col, "source"), id_col)
    rows = links.select("source", "href", F.col("link_text").alias("title"), F.struct(F.col(id_col), "at").alias("position"), listing_date(F.coalesce("context", "link_text")).alias("day"))
    kept = accepted(rows.where((F.col("href") != "") & (F.col("title") != "")), rules)
    return listing_notices(kept.withColumnRenamed("href", "url"), cutoff, cap)
