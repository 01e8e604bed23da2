"""Queries over review, extraction, sources and streams; those that SQL can say have the same in SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions import scalars as S
from attestra.operators import extraction as E
from attestra.operators import history as H
from attestra.operators import review as R
from attestra.sources import tables as T
from attestra.streaming import jobs as J

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


# Review: documents are items of their source's case, labels are decisions


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.t(spark, sf_dir, "documents")
    reasons = F.array_compact(F.array(F.when(F.col("n_chars") < 500, "SHORT"), F.when(F.col("lang") != "en", "FOREIGN")))
    return d.select(F.col("doc_id").alias("item_key"), F.col("source").alias("case_id"), F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("post_key"), F.when(F.col("doc_id") % 17 == 0, "REVISION").otherwise("FIELD").alias("scope"), F.lit("INTEGER").alias("value_type"), F.col("n_chars").cast("string").alias("value"), reasons.alias("reasons"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = B.t(spark, sf_dir, "labels")
    decision = F.when(F.col("quality") == 0, "REJECT").when(F.col("toxic") == 1, "CORRECT_AND_APPROVE").otherwise("APPROVE_AS_IS")
    return lab.select(F.col("doc_id").alias("item_key"), decision.alias("decision"), F.lit("INTEGER").alias("corrected_type"), F.when(F.col("toxic") == 1, F.lit("1")).alias("corrected_value"), F.col("doc_id").alias("decided_at"))


_ITEMS = """WITH i AS (SELECT doc_id AS item_key, source AS case_id, CASE WHEN doc_id % 5 <> 0 THEN lang END AS post_key, CASE WHEN doc_id % 17 = 0 THEN 'REVISION' ELSE 'FIELD' END AS scope, CAST(n_chars AS VARCHAR) AS value, n_chars < 500 AS short, lang <> 'en' AS foreign_ FROM documents),
d AS (SELECT doc_id AS item_key, CASE WHEN quality = 0 THEN 'REJECT' WHEN toxic = 1 THEN 'CORRECT_AND_APPROVE' ELSE 'APPROVE_AS_IS' END AS decision, CASE WHEN toxic = 1 THEN '1' END AS corrected FROM labels),
x AS (SELECT i.*, decision, CASE WHEN decision = 'CORRECT_AND_APPROVE' AND scope <> 'FIELD' THEN 'CORRECTION_NEEDS_FIELD' WHEN decision = 'CORRECT_AND_APPROVE' AND corrected = value THEN 'NOT_CHANGED' END AS error, corrected FROM i LEFT JOIN d USING (item_key)),
z AS (SELECT *, CASE WHEN decision = 'CORRECT_AND_APPROVE' AND error IS NULL THEN corrected ELSE value END AS final_value, decision IS NOT NULL AND error IS NULL AS resolved FROM x) """


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.apply_decisions(items(spark, sf_dir), decisions(spark, sf_dir))


@query(_ITEMS + "SELECT item_key, decision, error, final_value, resolved FROM z")
def applied_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIPE-10."""
    return decided(spark, sf_dir).select("item_key", "decision", "error", "final_value", "resolved")


@query(_ITEMS + ", g AS (SELECT case_id, post_key, bool_and(resolved) AS done, min(CASE WHEN resolved THEN CASE decision WHEN 'REJECT' THEN 2 WHEN 'CORRECT_AND_APPROVE' THEN 3 ELSE 4 END END) AS r, count(*) FILTER (NOT resolved) AS pending, count(*) AS items FROM z GROUP BY 1, 2) SELECT case_id, post_key, CASE WHEN done THEN CASE r WHEN 2 THEN 'REJECTED' WHEN 3 THEN 'HUMAN_CORRECTED' ELSE 'HUMAN_APPROVED' END END AS outcome, pending, items FROM g")
def scope_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-29, PIPE-11."""
    return R.scope_outcome(decided(spark, sf_dir), "case_id", "post_key")


_SMALL = _ITEMS.replace("source AS case_id", "CAST(doc_id // 3 AS VARCHAR) AS case_id")


@query(_SMALL + """, f AS (SELECT *, coalesce(decision = 'REJECT' OR NOT resolved, TRUE) AS bad FROM z),
c AS (SELECT case_id FROM f GROUP BY 1 HAVING NOT coalesce(bool_or(bad AND post_key IS NULL), FALSE)), p AS (SELECT DISTINCT case_id, post_key FROM f WHERE bad AND post_key IS NOT NULL)
SELECT case_id, post_key, item_key, final_value, CASE WHEN decision = 'CORRECT_AND_APPROVE' THEN 'HUMAN_CORRECTED' ELSE 'HUMAN_APPROVED_AS_IS' END AS origin FROM f WHERE case_id IN (SELECT case_id FROM c) AND NOT EXISTS (SELECT 1 FROM p WHERE p.case_id = f.case_id AND p.post_key = f.post_key)""")
def approved_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIPE-12: cases of three documents."""
    return R.approved_projection(decided(spark, sf_dir).withColumn("case_id", F.floor(F.col("item_key") / 3).cast("string")))


@query(_ITEMS + """, own AS (SELECT case_id, 'FIELD' AS scope, CAST(item_key AS VARCHAR) AS item_key, concat_ws(',', CASE WHEN foreign_ THEN 'FOREIGN' END, CASE WHEN short THEN 'SHORT' END) AS reasons FROM i WHERE short OR foreign_),
cov AS (SELECT case_id, bool_or(short) AS s, bool_or(foreign_) AS f FROM i GROUP BY 1)
SELECT * FROM own UNION ALL SELECT case_id, 'REVISION', '*', concat_ws(',', CASE WHEN NOT s THEN 'SHORT' END, 'PARTIAL_VERIFICATION') FROM cov""")
def review_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIPE-9, SET-4, SET-5."""
    it = items(spark, sf_dir)
    revision = it.select("case_id").distinct().withColumn("reasons", F.array(F.lit("SHORT"), F.lit("PARTIAL_VERIFICATION")))
    out = R.queue_cases(it.select("case_id", F.col("item_key").cast("string").alias("path"), "reasons"), revision)
    return out.withColumn("reasons", F.concat_ws(",", "reasons"))


@query(_ITEMS + "SELECT count(*) AS all, count(*) FILTER (decision IS NULL) AS pending, count(*) FILTER (resolved) AS resolved, count(error) AS errors FROM z")
def queue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-20."""
    return R.queue_counts(decided(spark, sf_dir))


@query(_ITEMS + "SELECT item_key, CASE WHEN NOT short AND NOT foreign_ THEN 'TRUSTED' WHEN resolved THEN decision ELSE 'REVIEW_REQUIRED' END AS status, final_value AS value FROM z")
def case_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIPE-26."""
    return R.case_view(items(spark, sf_dir), decided(spark, sf_dir))


@query("""SELECT o_orderkey AS subject, 'status' AS path, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS value, CASE o_orderkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN 'F' WHEN 2 THEN 'O' ELSE 'X' END AS new_value,
CASE WHEN o_orderkey % 4 = 0 THEN 'IGNORED' WHEN o_orderkey % 4 = 3 THEN 'INVALID' WHEN o_orderkey % 3 = 0 THEN 'ADDED' WHEN o_orderstatus = CASE o_orderkey % 4 WHEN 1 THEN 'F' ELSE 'O' END THEN 'NO_CHANGE' ELSE 'EDITED' END AS result FROM orders""")
def maintained_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIPE-21, PIPE-22."""
    o, k = B.t(spark, sf_dir, "orders"), F.col("o_orderkey")
    facts = o.where("o_orderkey % 3 <> 0").select(k.alias("subject"), F.lit("status").alias("path"), F.col("o_orderstatus").alias("value"))
    edits = o.select(k.alias("subject"), F.lit("status").alias("path"), F.element_at(F.array(*map(F.lit, " FOX")), (k % 4 + 1).cast("int")).alias("new_value"))
    return R.maintain_published(facts, edits, F.col("new_value").isin("F", "O", "P"))


@query("""WITH p AS (SELECT l_orderkey AS subject, l_suppkey % 40 AS post_key, CAST(l_quantity AS BIGINT) AS n FROM lineitem), g AS (SELECT subject, count(*) AS posts, count(DISTINCT post_key) AS keys, sum(n) AS s FROM p GROUP BY 1)
SELECT o_orderkey AS subject, coalesce(posts, 0) AS posts, CASE WHEN posts IS NULL THEN 'NO_POSTS' WHEN posts > 50 THEN 'TOO_MANY' WHEN keys < posts THEN 'DUPLICATE_KEY' WHEN s <> s + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END THEN 'TOTAL_DIFFERS' END AS error FROM orders LEFT JOIN g ON subject = o_orderkey""")
def approved_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIPE-23."""
    li, o = B.t(spark, sf_dir, "lineitem"), B.t(spark, sf_dir, "orders")
    posts = li.select(F.col("l_orderkey").alias("subject"), (F.col("l_suppkey") % 40).alias("post_key"), F.col("l_quantity").cast("long").alias("n"))
    sums = posts.groupBy("subject").agg(F.sum("n").alias("s"))
    totals = o.select(F.col("o_orderkey").alias("subject")).join(sums, "subject", "left").select("subject", (F.col("s") + F.when(F.col("subject") % 3 == 0, 1).otherwise(0)).alias("total"))
    return R.approve_structure(posts, totals)


@query("SELECT DISTINCT l_orderkey AS case_id, l_suppkey AS post_key, CASE WHEN l_suppkey % 7 = 0 THEN 'ALREADY' WHEN EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F') THEN 'PUBLISHED' ELSE 'BLOCKED' END AS result FROM lineitem")
def bulk_publication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIPE-24."""
    li, o = B.t(spark, sf_dir, "lineitem"), B.t(spark, sf_dir, "orders")
    keys = li.select(F.col("l_orderkey").alias("case_id"), F.col("l_suppkey").alias("post_key"))
    ready = keys.join(o.where("o_orderstatus = 'F'"), F.col("case_id") == F.col("o_orderkey"), "left_semi")
    return R.bulk_publish(keys, ready, keys.where("post_key % 7 = 0"))


@query("""WITH p AS (SELECT DISTINCT o_custkey AS subject, o_orderstatus AS post_key FROM orders WHERE o_orderkey % 20 = 0), f AS (SELECT subject, post_key, 1 AS family FROM p UNION ALL SELECT c_custkey, '', 2 FROM customer WHERE c_custkey NOT IN (SELECT subject FROM p) UNION ALL SELECT o_custkey, o_orderstatus, 3 FROM orders)
SELECT subject, post_key, CAST(min(family) AS INTEGER) AS family FROM f GROUP BY 1, 2""")
def queue_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIPE-25, SET-1, SET-2, WIN-14."""
    o, c = B.t(spark, sf_dir, "orders"), B.t(spark, sf_dir, "customer")
    of = lambda df: df.select(F.col("o_custkey").alias("subject"), F.col("o_orderstatus").alias("post_key"))
    return R.review_queue(of(o.where("o_orderkey % 20 = 0")), c.select(F.col("c_custkey").alias("subject")), of(o))


@query("SELECT l_orderkey AS subject, n.o_orderkey % 9 AS e, count(*) AS n FROM lineitem JOIN orders n ON l_orderkey = n.o_orderkey WHERE n.o_orderkey % 2 = 0 GROUP BY 1, 2")
def carried_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-19: facts of even orders keep their value, so their links, the lines, go along."""
    o, li = B.t(spark, sf_dir, "orders"), B.t(spark, sf_dir, "lineitem")
    k = F.col("o_orderkey")
    old = o.select(k.alias("subject"), F.lit("status").alias("path"), F.col("o_orderstatus").alias("value"), k.alias("fact_id"))
    new = o.select(k.alias("subject"), F.lit("status").alias("path"), F.when(k % 2 == 0, F.col("o_orderstatus")).otherwise("?").alias("value"), (k + 1_000_000_000).alias("fact_id"))
    links = H.carry_evidence(old, new, li.select(F.col("l_orderkey").alias("fact_id"), F.struct("l_linenumber", "l_suppkey").alias("evidence_id")))
    return links.groupBy((F.col("fact_id") - 1_000_000_000).alias("subject")).agg(F.count(F.lit(1)).alias("n")).select("subject", (F.col("subject") % 9).alias("e"), "n")


# Extraction


@query(r"""WITH b AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<(?:li|tr)\b[^>]*>(.*?)</(?:li|tr)>', 1)) AS block, unnest(range(0, len(regexp_extract_all(html, '(?is)<(?:li|tr)\b[^>]*>(.*?)</(?:li|tr)>', 1)))) AS block_no FROM pages)
SELECT page_id, CAST(block_no AS INTEGER) AS block_no, regexp_extract(block, 'href="([^"]*)"', 1) AS href, regexp_replace(block, '<[^>]*>', '', 'g') AS link_text FROM b WHERE block LIKE '%<a%'""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-3, EXT-14."""
    return E.extract_links(B.t(spark, sf_dir, "pages")).select("page_id", "block_no", "href", "link_text")


@query(r"""SELECT doc_id, CAST(i AS INTEGER) AS line_no, line FROM (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS i, trim(regexp_replace(unnest(string_split(text, chr(10))), '\s+', ' ', 'g')) AS line FROM documents) WHERE line <> ''""")
def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-4."""
    return E.document_lines(B.t(spark, sf_dir, "documents"))


_LINES = r"""WITH l AS (SELECT doc_id, i AS line_no, line FROM (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS i, trim(regexp_replace(unnest(string_split(text, chr(10))), '\s+', ' ', 'g')) AS line FROM documents) WHERE line <> ''),
s AS (SELECT *, length(line) < 25 AS h, sum((length(line) < 25)::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS section_no FROM l) """


@query(_LINES + "SELECT doc_id, CAST(section_no AS BIGINT) AS section_no, max(line) FILTER (h) AS heading, count(*) FILTER (NOT h) AS lines, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT h), '') AS body FROM s GROUP BY 1, 2")
def text_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-6, WIN-12, EXT-8: lines of under 25 characters head sections."""
    return E.sections(E.document_lines(B.t(spark, sf_dir, "documents")), F.length("line") < 25)


@query(_LINES + ", r AS (SELECT *, sum(contains(line, '.')::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS row_no FROM l) SELECT doc_id, CAST(row_no AS BIGINT) AS row_no, string_agg(line, ' ' ORDER BY line_no) AS line FROM r WHERE row_no > 0 GROUP BY 1, 2")
def continued_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-8."""
    return E.joined_continuations(E.document_lines(B.t(spark, sf_dir, "documents")), F.col("line").contains("."))


@query("SELECT doc_id, path, value FROM (SELECT doc_id, 'contact' AS path, trim(regexp_extract(text, '([a-z0-9]+@[a-z.]+)', 1)) AS value FROM documents UNION ALL SELECT doc_id, 'opening', trim(regexp_extract(text, '^([A-Za-z]+)', 1)) FROM documents) WHERE value <> ''")
def labelled_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXT-7."""
    return E.labelled_fields(B.t(spark, sf_dir, "documents"), [("contact", "([a-z0-9]+@[a-z.]+)"), ("opening", "^([A-Za-z]+)")])


@query("SELECT l_orderkey * 10 + l_linenumber AS row_id, CASE WHEN count(s_suppkey) = 1 THEN min(s_suppkey) END AS post_id, CASE count(s_suppkey) WHEN 1 THEN 'ATTACHED' WHEN 0 THEN 'UNMATCHED' ELSE 'AMBIGUOUS' END AS status FROM lineitem LEFT JOIN (SELECT s_suppkey, s_suppkey % 60 AS k FROM supplier WHERE s_suppkey % 4 <> 0) ON k = l_partkey % 60 GROUP BY l_orderkey, l_linenumber")
def attached_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-10."""
    rows = B.t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), (F.col("l_partkey") % 60).alias("k"))
    posts = B.t(spark, sf_dir, "supplier").where("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("post_id"), (F.col("s_suppkey") % 60).alias("k"))
    return E.unambiguous_matches(rows, posts, ["k"], "row_id")


@query("SELECT a.c_custkey AS a, b.n_nationkey AS b, CASE WHEN a.c_mktsegment = 'BUILDING' THEN 2 ELSE 1 END AS overlap FROM customer a JOIN nation b ON a.c_nationkey = b.n_nationkey")
def name_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-12."""
    c, n = B.t(spark, sf_dir, "customer"), B.t(spark, sf_dir, "nation")
    left = F.concat(F.col("c_mktsegment"), F.lit(" office"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("a"), F.col("n_nationkey").alias("b"), E.token_overlap(left, F.lit("Office of building works")).alias("overlap"))


# Sources


@query("SELECT md5('w-' || c_custkey) AS wrapper_id, c_custkey, 'LEGACY_UNSPLIT' AS split_status FROM customer")
def wrapper_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-8."""
    return T.backfill_wrappers(B.t(spark, sf_dir, "customer"), "c_custkey", "w-", "LEGACY_UNSPLIT")


@query("SELECT source, sha256(text) AS sha, count(*) AS n FROM documents GROUP BY 1, 2")
def landed_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-1: documents as files: one row for each source and content, and how many files it stands for."""
    files = B.t(spark, sf_dir, "documents").select("source", F.col("text").cast("binary").alias("content"), F.lit("2024-01-01").cast("timestamp").alias("modificationTime"))
    counts = files.groupBy("source", F.sha2("content", 256).alias("sha")).agg(F.count(F.lit(1)).alias("n"))
    return T.land_raw(files).select("source", "sha").join(counts, ["source", "sha"])


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 3)")
def missing_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-9."""
    return T.missing_objects(B.t(spark, sf_dir, "orders"), B.t(spark, sf_dir, "customer").where("c_nationkey <> 3").select(F.col("c_custkey").alias("o_custkey")), "o_custkey")


# Streams over the tables' files, run to their end


@query("SELECT CAST(time_bucket(INTERVAL 60 SECOND, ts) AS VARCHAR) AS start, user_id, count(*) AS requests, count(*) > 2 AS limited FROM events GROUP BY 1, 2")
def request_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-4, the batch twin."""
    e = B.t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return J.request_counts(e, limit=2, client="user_id").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("WITH " + B.OBSERVATIONS_SQL + " SELECT endpoint_id, url, content_hash, count(*) AS n FROM observations GROUP BY 1, 2, 3")
def streamed_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIPE-1 as a stream: orders are read as a stream, joined to the customers and counted; every micro-batch writes the result as Parquet under spark.checkpoint.dir."""
    schema = B.t(spark, sf_dir, "orders").schema
    orders = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(sf_dir)
    c = B.t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    seen = orders.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("endpoint_id"), F.col("o_custkey").alias("url"), F.sha2(F.concat("o_orderstatus", "o_orderpriority"), 256).alias("content_hash")).agg(F.count(F.lit(1)).alias("n"))
    folder = f"{spark.conf.get('spark.checkpoint.dir', None) or tempfile.mkdtemp(prefix='spark-')}/versions_{uuid.uuid4().hex}"
    rows = f"{folder}/rows"
    spark.createDataFrame([], seen.schema).write.parquet(rows)  # a stream without files makes no batch
    write = lambda batch, epoch: batch.write.mode("overwrite").parquet(rows)
    seen.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(seen.schema).parquet(rows)


@query("SELECT page_id, regexp_replace(lower(url), '[^a-z0-9]+', '', 'g') AS header, CASE WHEN contains(url, 'example.com') THEN 'COM' WHEN contains(url, 'example.org') THEN 'ORG' ELSE 'Official PAGE' END AS label, CASE WHEN regexp_matches(lower(url), 'page|en') AND NOT regexp_matches(lower(url), 'ref|top') THEN TRUE ELSE FALSE END AS opening FROM pages")
def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-6, FLT-8, FLT-9, FLT-20."""
    return B.t(spark, sf_dir, "pages").select("page_id", S.header_key("url").alias("header"), S.first_label("url", [("example.com", "COM"), ("example.org", "ORG")], F.lit("Official PAGE")).alias("label"), S.opening_notice("url", "page|en", ("ref", "top")).alias("opening"))
