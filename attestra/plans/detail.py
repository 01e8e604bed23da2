"""Queries over posts of notices, identities, publication and single functions, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions import scalars as S
from attestra.operators import extraction as E
from attestra.operators import history as H
from attestra.operators import postings as N
from attestra.operators.notices import pipe_tables
from attestra.operators import serving as P
from attestra.operators import verification as V
from attestra.sources import tables as T

from . import bindings as B
from .core import COUNTS_SQL, verified
from .streams import folder

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return keep


# Notices that are written out of orders and their lines


def _order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, status, r (array of line, supplier and quantity)."""
    li, o = B.t(spark, sf_dir, "lineitem"), B.t(spark, sf_dir, "orders")
    r = F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("i"), F.col("l_suppkey").alias("s"), F.col("l_quantity").cast("int").alias("q"))))
    lines = li.groupBy(F.col("l_orderkey").alias("doc_id")).agg(r.alias("r"))
    return lines.join(o.select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("status")), "doc_id")


_LINES_SQL = """WITH g AS (SELECT l_orderkey AS doc_id, o_orderstatus AS status, count(*) AS n, count(DISTINCT l_suppkey) AS names, CAST(sum(CAST(l_quantity AS INTEGER)) AS BIGINT) AS total FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2)
"""


def _text(head: str, row: str) -> F.Column:
    """A heading and one row for each line, of which {i} is the number, {s} the supplier and {q} the quantity."""
    parts = F.expr("transform(r, (x, k) -> " + row + ")")
    return F.concat(F.lit(head), F.array_join(parts, "\n"))


@query(_LINES_SQL + """SELECT doc_id, CASE WHEN status = 'P' THEN 'LEGACY_UNSPLIT' WHEN (status = 'O' AND n > 1) OR names < n THEN 'AMBIGUOUS' ELSE 'EXPLICIT' END AS found,
  CASE WHEN status <> 'P' AND NOT ((status = 'O' AND n > 1) OR names < n) THEN total END AS total FROM g""")
def vacancy_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXT-3, WIN-9, WIN-10: tables whose columns survived as lines; open orders skip a serial, pending ones lack the header."""
    docs = _order_lines(spark, sf_dir)
    head = "Notice\nSl. Name of the Posts\nMinimum Educational Qualification and\nScale of Pay with total no. of vacant posts\n"
    serial = "case when status = 'O' and k > 0 then k + 2 else k + 1 end"
    row = f"concat({serial}, if(k % 2 = 0, '. Clerk', ' Clerk'), if(x.s % 3 = 0, concat('\\nof unit ', x.s, '\\nHSLC passed'), concat(' of unit ', x.s, ' HSLC passed')), '\\n14,000 - 60,500\\nGrade pay\\n', x.q, ' Nos. in all')"
    text = F.when(F.col("status") != "P", _text(head, row)).otherwise(_text("Notice\n", row))
    out = N.whitespace_tables(docs.select("doc_id", text.alias("text")))
    return out.select("doc_id", F.col("status").alias("found"), F.aggregate("posts", F.lit(0).cast("long"), lambda a, p: a + p["total"]).alias("total"))


@query(_LINES_SQL + """SELECT doc_id, CASE WHEN status = 'P' THEN 'LEGACY_UNSPLIT' WHEN status = 'O' OR names < n THEN 'AMBIGUOUS' ELSE 'EXPLICIT' END AS found,
  CASE WHEN status = 'F' AND names = n THEN total END AS total FROM g""")
def position_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXT-4: numbered positions; open orders have rows without counts, pending ones lack the header."""
    docs = _order_lines(spark, sf_dir)
    row = "concat(k + 1, ') Clerk', if(k % 2 = 0, '\\nof unit ', ' of unit '), x.s, if(status = 'O', '\\nThree posts.', concat('\\n(', x.q, ' Nos.)')), '\\nAs the rules say.')"
    text = F.when(F.col("status") != "P", _text("Position\nEssential\nQualification\n", row)).otherwise(_text("", row))
    out = N.numbered_positions(docs.select("doc_id", text.alias("text")))
    return out.select("doc_id", F.col("status").alias("found"), F.aggregate("posts", F.lit(0).cast("long"), lambda a, p: a + p["total"]).alias("total"))


@query("""WITH c AS (SELECT l_orderkey AS doc_id, l_returnflag AS parent, sum(CAST(l_quantity AS BIGINT)) AS s, count(*) AS k FROM lineitem GROUP BY 1, 2),
d AS (SELECT doc_id, bool_and(o_orderstatus <> 'P') AS refined FROM c JOIN orders ON o_orderkey = doc_id GROUP BY 1)
SELECT doc_id, CAST(sum(CASE WHEN refined THEN k ELSE 1 END) AS BIGINT) AS posts, bool_and(refined) AS refined, CAST(sum(CASE WHEN refined THEN s ELSE s + CASE parent WHEN (SELECT min(parent) FROM c x WHERE x.doc_id = c.doc_id) THEN 1 ELSE 0 END END) AS BIGINT) AS total,
  CAST(sum(CASE WHEN refined THEN k ELSE 1 END) AS INTEGER) AS last_ordinal FROM c JOIN d USING (doc_id) GROUP BY 1""")
def refined_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-18, EXT-11, WIN-13: orders' lines by return flag as parents, the lines as children; one parent of a pending order states a wrong total."""
    li, o = B.t(spark, sf_dir, "lineitem"), B.t(spark, sf_dir, "orders")
    key, q = F.col("l_orderkey").alias("doc_id"), F.col("l_quantity").cast("long")
    sums = li.groupBy(key, F.col("l_returnflag").alias("name")).agg(F.sum(q).alias("n"))
    first = sums.groupBy("doc_id").agg(F.min("name").alias("first")).join(o.select(F.col("o_orderkey").alias("doc_id"), "o_orderstatus"), "doc_id")
    wrong = (F.col("o_orderstatus") == "P") & (F.col("name") == F.col("first"))
    parents = sums.join(first, "doc_id").select("doc_id", "name", (F.col("n") + wrong.cast("int")).alias("n"))
    children = li.select(key, F.col("l_returnflag").alias("parent"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("name"), q.alias("n"))
    out = N.refined_parents(parents, children)
    return out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("posts"), F.bool_and("refined").alias("refined"), F.sum("n").alias("total"), F.max("ordinal").alias("last_ordinal"))


@query("""WITH l AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey) AS i, string_split(p_name, ' ') AS p, list_distinct(list_concat(string_split(p_name, ' '), [lower(p_type)])) AS w FROM lineitem JOIN part ON p_partkey = l_partkey),
n AS (SELECT doc_id, count(*) AS n FROM l GROUP BY 1),
x AS (SELECT a.doc_id, a.i, len(list_intersect(list_distinct(a.p), a.w)) AS own, coalesce(max(len(list_intersect(list_distinct(a.p), b.w))), 0) AS other FROM l a LEFT JOIN l b ON a.doc_id = b.doc_id AND (a.i <> b.i) GROUP BY a.doc_id, a.i, a.p, a.w)
SELECT doc_id, n > 1 AND bool_and(own > 0 AND own > other) AS aligned FROM x JOIN n USING (doc_id) GROUP BY doc_id, n""")
def aligned_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-12: the parts of an order's lines as posts, and with their types as the listing's names."""
    li, p = B.t(spark, sf_dir, "lineitem"), B.t(spark, sf_dir, "part")
    j = li.join(p, F.col("l_partkey") == F.col("p_partkey"))
    r = F.array_sort(F.collect_list(F.struct("l_linenumber", "p_name", "p_type")))
    docs = j.groupBy(F.col("l_orderkey").alias("doc_id")).agg(r.alias("r"))
    docs = docs.select("doc_id", F.transform("r", lambda x: x["p_name"]).alias("parsed"), F.transform("r", lambda x: F.concat_ws(" ", x["p_name"], x["p_type"])).alias("listing"))
    return N.aligned_names(docs).select("doc_id", "aligned")


@query("""SELECT c_custkey AS owner_id, n_nationkey AS post_id FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_mktsegment IN ('BUILDING', 'FURNITURE')""")
def owned_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-11: customers' phrases name a nation's office and a segment; nations' posts are of building and furniture."""
    c, n = B.t(spark, sf_dir, "customer"), B.t(spark, sf_dir, "nation")
    j = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    owners = j.select(F.col("c_custkey").alias("owner_id"), F.concat(F.lit("The "), F.col("c_mktsegment"), F.lit(" branch, Office of "), F.col("n_name"), F.lit(".")).alias("phrase"))
    of = lambda base: n.select(F.col("n_nationkey").alias("post_id"), F.concat(F.lit("office of "), F.col("n_name")).alias("organisation"), F.lit(base).alias("base"))
    return N.owner_posts(owners, of("Building branch").unionByName(of("furniture")))


@query("""SELECT l_orderkey AS doc_id, CASE l_returnflag WHEN 'A' THEN 'OBC' WHEN 'N' THEN 'SC' ELSE 'UR' END AS category, CAST(arg_max(CAST(l_quantity AS INTEGER), (l_linenumber, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR))) AS INTEGER) AS n FROM lineitem GROUP BY 1, 2""")
def category_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-33: category counts whose labels wrap; the last line of a category counts."""
    li = B.t(spark, sf_dir, "lineitem")
    label = F.when(F.col("l_returnflag") == "A", "OBC").when(F.col("l_returnflag") == "N", "SC").otherwise("UR")
    text = F.concat(label, F.lit(" (of 7 kinds,\n  wrapped) posts :\n "), F.col("l_quantity").cast("int").cast("string"))
    r = F.array_sort(F.collect_list(F.struct("l_linenumber", text.alias("x"))))
    docs = li.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.concat(F.lit("Break-up 99\n"), F.array_join(F.transform(r, lambda z: z["x"]), "\n")).alias("text"))
    return N.category_counts(docs)


@query("""WITH k AS (SELECT o_custkey % 25 AS source, o_custkey AS url, max(o_orderdate) AS day, max(o_orderkey) FILTER (o_orderdate >= TIMESTAMP '1996-01-01') AS p FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1, 2),
l AS (SELECT k.source, k.url, CAST(o.o_orderdate AS DATE) AS day, p FROM k JOIN orders o ON o_orderkey = p),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY day DESC, url) AS nth, count(*) OVER (PARTITION BY source) > 5 AS exceeded FROM l)
SELECT source, url, 'Notice ' || p AS title, day, exceeded FROM r WHERE nth <= 5""")
def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXT-14: listing rows with a date in words, from a cutoff on; the last of each URL, five by source, and whether there are more."""
    o = B.t(spark, sf_dir, "orders")
    shown = F.concat(F.lit("Notice "), F.col("o_orderkey").cast("string"), F.lit(" dated "), F.date_format("o_orderdate", "dd.MM.yyyy"))
    rows = o.select((F.col("o_custkey") % 25).alias("source"), F.col("o_custkey").alias("url"), F.col("o_orderkey").alias("position"), shown.alias("shown"))
    rows = rows.select("source", "url", "position", S.without_trailing_date("shown").alias("title"), S.listing_date("shown").alias("day"))
    return N.listing_notices(rows, F.lit("1996-01-01").cast("date"), 5)


# Identity


_POST_SQL = """(SELECT p_partkey AS id, CASE p_size % 5 WHEN 0 THEN '***' WHEN 1 THEN repeat(p_name || ' ', 12) ELSE '  ' || p_name || ', ' END AS title, CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN p_brand ELSE p_type || '.' END AS unit FROM part)"""


@query(f"""WITH p AS {_POST_SQL}, s AS (SELECT id, lower(trim(trim(regexp_replace(title, '\\s+', ' ', 'g')) || ' ' || trim(unit))) AS seed FROM p), k AS (SELECT id, seed, CASE WHEN trim(regexp_replace(seed, '[^a-z0-9]+', '_', 'g'), '_') = '' THEN 'post' ELSE trim(regexp_replace(seed, '[^a-z0-9]+', '_', 'g'), '_') END AS slug FROM s)
SELECT id, CASE WHEN length(slug) > 110 THEN rtrim(slug[1:97], '_') || '_' || sha256(seed)[1:12] ELSE slug END AS post_key FROM k""")
def post_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-11: keys of long, common and empty names."""
    p, s = B.t(spark, sf_dir, "part"), F.col("p_size")
    title = F.when(s % 5 == 0, "***").when(s % 5 == 1, F.repeat(F.concat("p_name", F.lit(" ")), 12)).otherwise(F.concat(F.lit("  "), "p_name", F.lit(", ")))
    unit = F.when(s % 3 == 0, "").when(s % 3 == 1, F.col("p_brand")).otherwise(F.concat("p_type", F.lit(".")))
    return p.select(F.col("p_partkey").alias("id"), S.post_key(title, unit).alias("post_key"))


@query("""SELECT p_partkey AS id, p_name || ' – ' || p_brand AS name, replace(p_name, ' ', '_') || '_' || lower(replace(p_brand, '#', '_')) AS post_key FROM part""")
def canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-12, EXT-16: titles that name a unit already, the previous one, both, or none, in any case, with one result."""
    p, k = B.t(spark, sf_dir, "part"), F.col("p_partkey") % 4
    title = F.when(k == 0, F.concat_ws(" - ", "p_name", F.upper("p_brand"))).when(k == 1, F.concat_ws(" – ", "p_name", "p_type")).when(k == 2, F.concat(F.lit("  "), "p_name", F.lit(" –  "), "p_brand", F.lit(" . ")))
    posts = p.select(F.col("p_partkey").alias("id"), F.coalesce(title, F.concat("p_name", F.lit(";"))).alias("name"), F.concat(F.lit(" "), "p_brand", F.lit(",")).alias("organisation"), F.when(k == 1, F.lower("p_type")).alias("previous"))
    return N.canonical_posts(posts).select("id", "name", "post_key")


_PATH_SQL = """(SELECT o_orderkey AS id, CASE o_orderkey % 8 WHEN 0 THEN 'posts.' || (o_orderkey % 7) || '.vacancies.total' WHEN 1 THEN 'posts.clerk.vacancies' WHEN 2 THEN 'eligibility.domicile.state' WHEN 3 THEN 'vacancies.total'
  WHEN 4 THEN 'posts.3.application' WHEN 5 THEN 'posts.2.name' WHEN 6 THEN 'qualification.degree' ELSE lower(o_orderpriority) END AS path FROM orders)"""


@query(f"SELECT id, path, (id % 8) IN (0, 2, 3, 6) AS critical_1, (id % 8) IN (0, 1, 2, 3, 4, 6) AS critical_2 FROM {_PATH_SQL}")
def critical_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-11: under the first policy a post is a number, under the second any key."""
    o, k = B.t(spark, sf_dir, "orders"), F.col("o_orderkey")
    told = [F.concat(F.lit("posts."), (k % 7).cast("string"), F.lit(".vacancies.total")), "posts.clerk.vacancies", "eligibility.domicile.state", "vacancies.total", "posts.3.application", "posts.2.name", "qualification.degree", F.lower("o_orderpriority")]
    rows = o.select(k.alias("id"), F.element_at(F.array(*[F.lit(x) if isinstance(x, str) else x for x in told]), (k % 8 + 1).cast("int")).alias("path"))
    return rows.select("id", "path", S.is_critical("path", 1).alias("critical_1"), S.is_critical("path", 2).alias("critical_2"))


_KEYS_SQL = """SELECT o_orderkey, 'DHS_ADVT_' || o_custkey || '_' || year(o_orderdate) AS numbered, CASE WHEN o_orderstatus <> 'P' THEN 'DHS_' || year(o_orderdate) || '_REF_' || o_custkey END AS campaign FROM orders"""


@query(_KEYS_SQL)
def reference_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-9, FN-10: keys of a notice's number, leading zeros off; a campaign without a reference has none."""
    o, year = B.t(spark, sf_dir, "orders"), F.year("o_orderdate")
    number = F.concat(F.lit("No. 00"), F.col("o_custkey").cast("string"), F.lit(" / "), year.cast("string"))
    ref = F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("Ref/"), F.col("o_custkey").cast("string"), F.lit(".")))
    return o.select("o_orderkey", S.number_year_key("DHS", number).alias("numbered"), S.campaign_key("DHS", year, ref).alias("campaign"))


@query("""SELECT p_partkey, lower(p_type) AS label, p_name AS value, p_name AS item, upper(p_brand[1:1]) || lower(p_brand[2:5]) || ' Clerk' AS spaced, 'Vacancy of ' || p_name AS undated,
  CASE WHEN p_size % 2 = 0 THEN p_name END AS evidence, 'jdbc://***:***@db/' || p_size AS redacted, p_name AS compared, CASE WHEN length(p_name) > 7 THEN upper(p_name)[1:4] || '...' ELSE upper(p_name) END AS cut FROM part""")
def text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-2, FLT-4, FLT-5, FN-14 to FN-17: names of parts, dressed up and undressed again."""
    p, lit = B.t(spark, sf_dir, "part"), F.lit
    brand = F.concat(F.upper(F.substring("p_brand", 1, 1)), F.lower(F.substring("p_brand", 2, 4)))
    pair = S.labelled(F.concat(lit("  "), "p_type", lit(". :  "), "p_name", lit(" ")))
    name = F.col("p_name")
    return p.select(
        "p_partkey", pair["label"].alias("label"), pair["value"].alias("value"), S.clean_item(F.concat(lit(" ("), (F.col("p_size") % 90).cast("string"), lit(") "), name)).alias("item"),
        S.split_camel(F.concat(brand, lit("Clerk; "))).alias("spaced"), S.without_trailing_date(F.concat(lit("Vacancy of "), name, lit(", dated 1/02/2024 "))).alias("undated"),
        S.evidence_text(F.when(F.col("p_size") % 2 == 0, F.concat(lit("\r\n "), name, lit("\r"))).otherwise(" \n")).alias("evidence"),
        S.redacted_error(F.concat(lit("jdbc://user:p"), name.substr(1, 3), lit("@db/"), F.col("p_size").cast("string"), lit("\nline"))).alias("redacted"),
        S.comparison_text(F.concat(lit(" "), F.upper(name)), lit(None).cast("string")).alias("compared"), S.bounded(F.upper(name), 7, "...").alias("cut"),
    )


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS start_date, CAST(o_orderdate AS DATE) + 10 AS end_date, CAST(o_orderdate AS DATE) AS worded, o_orderdate >= TIMESTAMP '1999-06-01' AS within,
  strftime(o_orderdate + INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') AS due FROM orders""")
def window_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-10, FN-21, FN-22, FN-26: dates that notices write in several ways."""
    o, day = B.t(spark, sf_dir, "orders"), F.to_date("o_orderdate")
    write = lambda d: F.date_format(d, "d/M/yyyy")
    window = S.application_window(F.concat(F.lit("Apply from "), write(day), F.lit(" until "), write(F.date_add(day, 10)), F.lit(".")))
    worded = S.worded_date(F.concat(F.lit("on the "), F.date_format(day, "d"), F.lit("th "), F.date_format(day, "MMMM"), F.lit(", "), F.date_format(day, "yyyy")))
    due = S.next_due(F.col("o_orderdate").cast("timestamp_ntz"), F.lit(90))
    return o.select("o_orderkey", window["start_date"].alias("start_date"), window["end_date"].alias("end_date"), worded.alias("worded"), S.within_history(day, F.lit("2001-06-01").cast("date"), 24).alias("within"), F.date_format(due, "yyyy-MM-dd HH:mm:ss").alias("due"))


@query("""SELECT page_id, contains(lower(url), 'page') AND NOT contains(lower(url), 'old') AS accepted FROM pages""")
def accepted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-9: by a rule of wanted and unwanted terms."""
    return B.t(spark, sf_dir, "pages").select("page_id", S.accepted_by_rule("url", ("page",), ("old",)).alias("accepted"))


# Publication


_POSTS = "(SELECT l_orderkey * 10 + l_linenumber AS post_id, l_orderkey AS master_id, l_suppkey AS post_key FROM lineitem)"


@query(f"""WITH p AS {_POSTS}, m AS (SELECT o_orderkey AS master_id FROM orders WHERE o_orderstatus <> 'P') SELECT DISTINCT post_id AS public_id, master_id, TRUE AS by_post FROM p JOIN m USING (master_id)
UNION ALL SELECT master_id, master_id, FALSE FROM m WHERE master_id NOT IN (SELECT master_id FROM p)""")
def published_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-17: an active master is found by each of its posts, or by itself only if it has none."""
    posts = B.t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("post_id"), F.col("l_orderkey").alias("master_id")).distinct()
    masters = B.t(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("master_id"))
    return H.public_jobs(masters, posts)


@query("""WITH c AS (SELECT o_custkey AS subject, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS master_id, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM orders GROUP BY 1)
SELECT DISTINCT o_custkey AS subject, l_suppkey AS post_key, CASE WHEN EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = c.master_id AND x.l_suppkey = lineitem.l_suppkey) THEN master_id END AS master_id
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN c ON subject = o_custkey AND c.status <> 'P'""")
def latest_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-16: every post that a customer's orders ever had, and its master if the current, active one has it."""
    o, li = B.t(spark, sf_dir, "orders"), B.t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("master_id"), F.col("l_suppkey").alias("post_key")).distinct()
    current = o.groupBy(F.col("o_custkey").alias("subject")).agg(F.max_by(F.struct(F.col("o_orderkey").alias("master_id"), F.col("o_orderstatus").alias("status")), F.struct("o_orderdate", "o_orderkey")).alias("m")).select("subject", "m.*")
    posts = o.select(F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("master_id")).join(li, "master_id").select("subject", "post_key").distinct()
    return H.published_posts(posts, current.where("status <> 'P'").select("subject", "master_id"), li)


@query("""WITH s AS (SELECT l_orderkey, count(*) AS n, bool_and(s_nationkey = c_nationkey) AS own FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_suppkey % 5 <> 0 GROUP BY 1),
m AS (SELECT l_orderkey, bool_or(l_suppkey % 5 = 0) AS missing FROM lineitem GROUP BY 1)
SELECT l_orderkey AS job_id, n AS sources, CASE WHEN missing THEN 'SOURCE_MISSING' WHEN NOT own THEN 'OTHER_AUTHORITY' ELSE 'SHOWN' END AS result FROM s JOIN m USING (l_orderkey)""")
def public_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIPE-18: a job is shown only if every source is there and of its own authority; every fifth supplier isn't in the register."""
    o, c, li = B.t(spark, sf_dir, "orders"), B.t(spark, sf_dir, "customer"), B.t(spark, sf_dir, "lineitem")
    jobs = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("job_id"), F.col("c_nationkey").alias("authority"))
    sources = B.t(spark, sf_dir, "supplier").where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("source_id"), F.col("s_nationkey").alias("source_authority"))
    return P.detail_results(jobs, li.select(F.col("l_orderkey").alias("job_id"), F.col("l_suppkey").alias("source_id")), sources)


@query("""SELECT l_orderkey AS subject, l_suppkey AS post_key, count(*) AS facts, concat_ws(',', CASE WHEN max(l_quantity) < 10 THEN 'vacancies' END, CASE WHEN max(l_discount) = 0 THEN 'pay' END) AS missing,
  CASE WHEN bool_or(o_orderpriority IN ('1-URGENT', '2-HIGH')) THEN 'HUMAN' ELSE 'AUTO' END AS category FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2""")
def published_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIPE-20: one row a published post: what it misses, and whether a human decided on any of its facts."""
    li, o = B.t(spark, sf_dir, "lineitem"), B.t(spark, sf_dir, "orders")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    facts = j.select(F.col("l_orderkey").alias("subject"), F.col("l_suppkey").alias("post_key"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("human"), "l_quantity", "l_discount")
    rows = facts.groupBy("subject", "post_key").agg(F.count(F.lit(1)).alias("facts"), F.bool_or("human").alias("human"), F.max("l_quantity").alias("q"), F.max("l_discount").alias("d"))
    out = P.readiness(rows, {"vacancies": F.col("q") >= 10, "pay": F.col("d") > 0})
    return out.select("subject", "post_key", "facts", F.concat_ws(",", "missing").alias("missing"), F.when(F.col("human"), "HUMAN").otherwise("AUTO").alias("category"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'vacancies.total' WHEN o_orderstatus = 'O' THEN 'advertisement.vacancies.total' ELSE 'fee.amount' END AS shown, CASE WHEN o_orderstatus = 'F' THEN 'vacancies' WHEN o_orderstatus = 'O' THEN 'overview' ELSE 'fees' END AS section FROM orders""")
def visible_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-21, FLT-22: a post's own path, a shared path that collides with one, and another; then their sections."""
    o, s = B.t(spark, sf_dir, "orders"), F.col("o_orderstatus")
    key = F.concat(F.lit("k"), (F.col("o_orderkey") % 3).cast("string"))
    path = F.when(s == "F", F.concat(F.lit("posts."), key, F.lit(".vacancies.total"))).when(s == "O", "vacancies.total").otherwise("fee.amount")
    shown = o.select(F.col("o_orderkey").alias("id"), P.visible_path(path, key, s == "O").alias("path"))
    return P.sections(shown, [("vacancies", "vacancies"), ("fee", "fees")]).select("id", F.col("path").alias("shown"), "section")


@query("""SELECT o_orderkey AS case_id, o_orderpriority AS priority, CAST(o_orderdate AS DATE) AS opened FROM orders WHERE o_orderstatus = 'O'
ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END, o_orderdate, o_orderkey""")
def review_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SORT-1: open cases by priority, then oldest first."""
    cases = B.t(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("priority"), F.to_date("o_orderdate").alias("opened"))
    rank = F.when(F.col("priority") == "1-URGENT", 0).when(F.col("priority") == "2-HIGH", 1).when(F.col("priority") == "3-MEDIUM", 2).otherwise(3)
    return cases.orderBy(rank, "opened", "case_id")


@query("WITH " + B.VERSIONS_SQL + " SELECT subject, count(DISTINCT projection) AS revisions, CAST(count(DISTINCT projection) AS INTEGER) AS latest FROM versions GROUP BY 1")
def subject_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-26: how many revisions a subject has, and the latest number."""
    return H.number_revisions(B.versions(spark, sf_dir)).groupBy("subject").agg(F.count(F.lit(1)).alias("revisions"), F.max("revision_number").alias("latest"))


@query("SELECT DISTINCT user_id AS source_id FROM events ORDER BY 1")
def source_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-25: distinct sources in order."""
    return B.t(spark, sf_dir, "events").select(F.col("user_id").alias("source_id")).distinct().orderBy("source_id")


@query("""SELECT l_orderkey AS subject, bool_and(l_returnflag IN ('N', 'R')) AS covered, concat_ws(',', CASE WHEN bool_or(l_returnflag = 'N') THEN 'N' END, CASE WHEN bool_or(l_returnflag = 'R') THEN 'R' END) AS allowed FROM lineitem GROUP BY 1""")
def covered_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-4, SET-6: an order's flags, whether all are allowed, and those that are, in listed order."""
    sets = B.t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("subject")).agg(F.collect_set("l_returnflag").alias("s"))
    allowed = F.array(F.lit("N"), F.lit("R"))
    return sets.select("subject", (F.size(F.array_except("s", allowed)) == 0).alias("covered"), F.concat_ws(",", F.array_intersect(allowed, F.col("s"))).alias("allowed"))


@query("""SELECT o_orderkey AS subject, 'INPUT_HASH' AS violation FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_orderkey, 'EVIDENCE_HASH' FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT o_orderkey, 'FACTS' FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 5)""")
def integrity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIPE-15, FN-1, FN-2, FN-3, FN-5: stored hashes and counts against those computed anew; the stored input, evidence or count of some orders was changed since."""
    o, li = B.t(spark, sf_dir, "orders"), B.t(spark, sf_dir, "lineitem")
    facts = li.groupBy(F.col("l_orderkey").alias("subject")).agg(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_quantity")).alias("facts"))
    now = o.select(F.col("o_orderkey").alias("subject"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("excerpt")).join(facts, "subject", "left")
    changed = now.withColumn("excerpt", F.when(F.col("priority") == "1-URGENT", F.col("excerpt") + 1).otherwise(F.col("excerpt")))
    changed = changed.withColumn("status", F.when(F.col("status") == "P", "F").otherwise(F.col("status")))
    stored = H.with_hashes(now).withColumn("facts_total", F.when(F.size("facts") > 5, 0).otherwise(F.col("facts_total")))
    return H.hash_violations(stored.select("subject", "input_hash", "evidence_hash", "fact_set", "facts_total"), H.with_hashes(changed))


# Confidence of runs that aren't finished


@query(COUNTS_SQL + """, pq AS (SELECT run_id, critical, CASE WHEN method IS NOT NULL THEN outcome END AS outcome, CASE WHEN method IS NOT NULL THEN score END AS score, ambiguous FROM s1),
pg AS (SELECT run_id, CAST(sum(score * CASE WHEN critical THEN 2 ELSE 1 END) AS BIGINT) AS points, CAST(sum(CASE WHEN score IS NOT NULL THEN CASE WHEN critical THEN 2 ELSE 1 END END) AS BIGINT) AS weights, count(*) AS n, count(outcome) AS f FROM pq GROUP BY run_id),
pc AS (SELECT *, CAST(round_even(CAST(10000 * f AS DECIMAL(18,4)) / n, 0) AS BIGINT) AS share FROM pg)
SELECT run_id, CASE WHEN weights > 0 THEN CAST((2 * points * share + weights * 10000) // (2 * weights * 10000) AS INTEGER) END AS score, CAST(share AS DOUBLE) / 10000 AS coverage FROM pc""")
def partial_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-8, AGG-10: fields without a method have no outcome yet, so coverage is less than one and takes its share off the score."""
    done = F.col("method").isNotNull()
    scored = V.field_score_v1(verified(spark, sf_dir))
    scored = scored.withColumn("outcome", F.when(done, F.col("outcome"))).withColumn("score", F.when(done, F.col("score")))
    return V.revision_score(scored, policy=1).select("run_id", "score", F.col("coverage").cast("double").alias("coverage"))


@query("""WITH x AS (SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS a, o_orderstatus AS b, o_orderpriority AS c FROM orders)
SELECT id, 'UR' AS path, a AS value FROM x UNION ALL SELECT id, 'OBC.men', b FROM x UNION ALL SELECT id, 'OBC.women.total', c FROM x""")
def breakdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-28, FN-29: nested JSON as rows of path and value."""
    o = B.t(spark, sf_dir, "orders")
    body = F.struct(F.struct(F.col("o_orderstatus").alias("men"), F.struct(F.col("o_orderpriority").alias("total")).alias("women")).alias("OBC"), F.col("o_custkey").alias("UR"))
    return E.breakdown_rows(o.select(F.col("o_orderkey").alias("id"), F.to_json(body).alias("json")), "id", "json")


# Sources: files are written under the shared folder first, and read as a source


@query("SELECT s_name || ' ' || s_suppkey AS text FROM supplier WHERE contains(s_name, '7')")
def feed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-2: a JSON feed for each nation's suppliers, of which the rows with a term are kept."""
    into = folder(spark, "feed")
    rows = B.t(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.collect_list(F.struct("s_name", "s_suppkey")).alias("result"))
    rows.select("s_nationkey", F.to_json(F.struct("result")).alias("value")).write.partitionBy("s_nationkey").text(into)
    return T.scan_json_feed(spark, into, ["7"]).select("text").where(F.regexp_extract("text", r"^(\S+)", 1).contains("7"))


@query("""SELECT '{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","none":null}' AS value FROM customer""")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-7: customers as JSON lines with sorted keys, read again as text."""
    into = folder(spark, "lines")
    T.write_json_lines(B.t(spark, sf_dir, "customer").select(F.lit(None).cast("string").alias("none"), "c_mktsegment", "c_custkey"), into)
    return spark.read.text(into)


@query("""SELECT source, sha256(text) AS sha, count(*) AS rows FROM documents WHERE text IS NOT NULL GROUP BY 1, 2""")
def landed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-1: the sink: contents land once by source and hash, and are read again beside how often they came."""
    into = folder(spark, "raw")
    files = B.t(spark, sf_dir, "documents").where("text is not null").select("source", F.col("text").cast("binary").alias("content"), F.lit("2024-01-01").cast("timestamp").alias("modificationTime"))
    T.write_raw(T.land_raw(files), into)
    landed = spark.read.parquet(into).select(F.col("source").cast("string").alias("source"), "sha")
    return landed.join(files.groupBy("source", F.sha2("content", 256).alias("sha")).agg(F.count(F.lit(1)).alias("rows")), ["source", "sha"])


@query("""WITH s AS (SELECT doc_id, CASE WHEN n_chars < 300 THEN 'short text' END AS a, CASE WHEN lang <> 'en' THEN 'other language' END AS b FROM documents)
SELECT doc_id, '["' || concat_ws('","', b, a) || '"]' AS value, 'extraction.ambiguities' AS path FROM s WHERE a IS NOT NULL OR b IS NOT NULL""")
def ambiguity_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXT-12: all ambiguities of a document as one fact."""
    d = B.t(spark, sf_dir, "documents")
    found = F.array_compact(F.array(F.when(F.col("n_chars") < 300, "short text"), F.when(F.col("lang") != "en", "other language")))
    return E.ambiguity_fact(d.select("doc_id", F.explode(found).alias("message")))


@query("""SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'posts.k.vacancies' WHEN '2-HIGH' THEN 'posts.k.pay.scale' ELSE o_orderpriority END AS path FROM orders""")
def rekeyed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXT-15, FN-16: a post's paths by their alias; others stay."""
    aliases = {"1-URGENT": "vacancies", "2-HIGH": "pay.scale"}
    return B.t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), E.rekeyed(F.col("o_orderpriority"), aliases, "posts.k.").alias("path"))


@query(r"""WITH l AS (SELECT doc_id, i, trim(regexp_replace(line, '\s+', ' ', 'g')) AS line FROM (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS line FROM documents)),
s AS (SELECT *, sum((length(line) < 25)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS section_no FROM l WHERE line <> ''),
f AS (SELECT doc_id, section_no, trim(regexp_replace(line, '^\s*(?:[-*•]|\(?(?:\d{1,2}|[ivxIVX]{1,5}|[a-zA-Z])[.)])\s+', '')) AS line, min(i) AS i FROM s WHERE length(line) >= 25 GROUP BY 1, 2, 3)
SELECT doc_id, CAST(section_no AS BIGINT) AS section_no, CAST(row_number() OVER (PARTITION BY doc_id, section_no ORDER BY i) - 1 AS INTEGER) AS item_no, line AS item FROM f""")
def section_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXT-8, SET-7, FN-17: the distinct lines of each section, in order."""
    lines = E.document_lines(B.t(spark, sf_dir, "documents"))
    return E.section_items(E.sections(lines, F.length("line") < 25))


@query(r"""WITH l AS (SELECT doc_id, trim(regexp_replace(unnest(string_split(text, chr(10))), '\s+', ' ', 'g')) AS line FROM documents)
SELECT d.doc_id, (SELECT count(DISTINCT line) FROM l WHERE l.doc_id = d.doc_id AND line <> '' AND length(line) < 25) AS headings, 'LEGACY_UNSPLIT' AS status FROM documents d""")
def quality_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXT-13: all documents with all their headings; some have bars, but none a header of a vacancy table."""
    d = B.t(spark, sf_dir, "documents")
    headings = E.document_lines(d).where(F.length("line") < 25).select("doc_id", F.col("line").alias("heading"))
    report = E.quality_report(d, headings, pipe_tables(d).select("doc_id", "status", F.lit("TABLE").alias("strategy")))
    return report.select("doc_id", F.coalesce(F.size("headings"), F.lit(0)).cast("long").alias("headings"), "status")
