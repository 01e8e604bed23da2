"""Queries over listing pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.operators import listings as L

from . import bindings as B

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return keep


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, source, html: a page with a list within an article at its end, whose outer link stands behind the list; the source is the host's last label."""
    p = B.t(spark, sf_dir, "pages")
    day = F.concat(F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0"), F.lit("/06/2030"))
    more = F.concat(
        F.lit('<article>Notice of '), day, F.lit(': <ul><li>Annex <a href="/in/'), F.col("page_id").cast("string"), F.lit('">inner <b>file</b></a></li></ul><!-- <a href="/no">no</a> --><a href="/out/'),
        F.col("page_id").cast("string"), F.lit('">outer <img src=x alt="picture"></a> end</article><a href="/loose">loose</a>'),
    )
    source = F.regexp_extract("url", r"^https?://[^/]*\.([a-z]+)(?:[:/]|$)", 1)
    return p.select("page_id", source.alias("source"), F.concat("html", more).alias("html"))


_LINKS = r"""WITH own AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">[^<]*</a></li>', 1)) AS href, unnest(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1)) AS title FROM pages),
d AS (SELECT page_id, url, lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') AS day FROM pages),
links AS (SELECT page_id, url, 1 AS late, href, title, 'li' AS container, title AS context, CAST(NULL AS VARCHAR) AS day FROM own
  UNION ALL SELECT page_id, url, 2, '/in/' || page_id, 'inner file', 'li', 'Annex inner file', NULL FROM d
  UNION ALL SELECT page_id, url, 3, '/out/' || page_id, 'outer picture', 'article', 'Notice of ' || day || '/06/2030: Annex inner file outer picture end', day FROM d
  UNION ALL SELECT page_id, url, 4, '/loose', 'loose', NULL, NULL, NULL FROM d)"""


@query(_LINKS + " SELECT page_id, href, title AS link_text, container, context FROM links")
def enclosed_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-3: anchors with the innermost box around them; every page ends with a list inside an article."""
    return L.enclosed_anchors(listing_pages(spark, sf_dir)).select("page_id", "href", "link_text", "container", "context")


#: By source: wanted, unwanted, excluded, campaign, elsewhere; hosts that end otherwise have no rule.
_RULES = [("com", "th|en|o", "ion|ß", "/loose|qu", None, None), ("net", None, None, None, "[aeiou]n|er", "ch$")]


@query(_LINKS + r""", r AS (SELECT *, regexp_extract(url, '^https?://[^/]*\.([a-z]+)(?:[:/]|$)', 1) AS source FROM links),
k AS (SELECT * FROM r WHERE (source = 'com' AND regexp_matches(title, 'th|en|o') AND NOT regexp_matches(title, 'ion|ß') AND NOT regexp_matches(title || ' ' || href, '/loose|qu'))
  OR (source = 'net' AND regexp_matches(title, '[aeiou]n|er') AND NOT regexp_matches(title, 'ch$'))),
l AS (SELECT source, href AS url, arg_max(title, (page_id, late)) AS title, arg_max(coalesce(day, ''), (page_id, late)) AS day FROM k WHERE (day IS NULL OR day >= '10') AND href <> '' AND title <> '' GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY day DESC, url) AS nth, count(*) OVER (PARTITION BY source) > 20 AS exceeded FROM l)
SELECT source, url, title, CASE WHEN day <> '' THEN CAST('2030-06-' || day AS DATE) END AS day, exceeded FROM n WHERE nth <= 20""")
def listed_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXT-14, SRC-3, FLT-6, FLT-8, FLT-9, FLT-10, WIN-15, SORT-8: notices of all pages by a rule table of sources."""
    rules = spark.createDataFrame(_RULES, L.RULE)
    return L.notices_of_pages(listing_pages(spark, sf_dir), rules, F.lit("2030-06-10").cast("date"), 20)
