"""The query over edits of published facts: customers are published, orders edit them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.operators import maintenance as M

from . import bindings as B

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

ALLOWED = [("title", "STRING"), ("vacancies.total", "INTEGER"), ("application.url", "STRING")]


def edited_customers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """current, facts, links, edits, allowed: a customer's last order edits the path that its priority names; pending orders follow another revision."""
    c, o = B.t(spark, sf_dir, "customer"), B.t(spark, sf_dir, "orders")
    revision, total = F.concat(F.lit("r"), F.col("c_custkey").cast("string")), F.floor(F.abs("c_acctbal")).cast("long").cast("string")
    current = c.select(F.col("c_custkey").alias("subject"), revision.alias("revision_id"), F.col("c_nationkey").alias("revision_number"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("case_id"), F.lit("QUEUED").alias("case_status"))
    url = F.when(F.col("c_mktsegment") == "BUILDING", "https://a.example/")
    each = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(k).alias("kind"), v.alias("value")) for (p, k), v in zip(ALLOWED, (F.col("c_name"), total, url))])
    facts = c.select(revision.alias("revision_id"), F.explode(each).alias("f")).select("revision_id", "f.*").where("value is not null")
    links = facts.select("revision_id", "path", F.explode(F.when(F.col("path") == "title", F.array(F.lit("e1"), F.lit("e2"))).otherwise(F.array(F.lit("e1")))).alias("evidence_id"))
    last = o.groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_orderstatus", "o_orderpriority"), F.struct("o_orderdate", "o_orderkey")).alias("o")).select("o_custkey", "o.*").join(c, F.col("o_custkey") == F.col("c_custkey"))
    p, key = F.substring("o_orderpriority", 1, 1), F.col("o_orderkey").cast("string")
    path = F.when(p == "1", "title").when(p.isin("2", "3"), "vacancies.total").when(p == "4", "owner").otherwise("application.url")
    value = F.when(p == "1", F.col("c_name")).when(p == "2", "-5").when(p == "3", key).when(p == "4", "x").otherwise(F.concat(F.lit("https://b.example/"), key))
    expected = F.when(F.col("o_orderstatus") == "P", "old").otherwise(revision)
    edits = last.select(F.col("o_custkey").alias("subject"), expected.alias("expected_revision_id"), path.alias("path"), value.alias("value"), F.lit("checked").alias("comment"))
    return current, facts, links, edits, spark.createDataFrame(ALLOWED, "path string, kind string")


SQL = """WITH l AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS k FROM orders GROUP BY 1),
x AS (SELECT c_custkey, c_nationkey, c_mktsegment = 'BUILDING' AS b, o_orderstatus AS st, left(o_orderpriority, 1) AS p, CAST(o_orderkey AS VARCHAR) = CAST(CAST(floor(abs(c_acctbal)) AS BIGINT) AS VARCHAR) AS same FROM l JOIN orders ON o_orderkey = k JOIN customer ON c_custkey = l.o_custkey),
r AS (SELECT *, CASE WHEN st = 'P' THEN 'STALE' WHEN p = '4' THEN 'UNSUPPORTED' WHEN p = '2' THEN 'INVALID' WHEN p = '1' OR (p = '3' AND same) THEN 'NO_CHANGE' ELSE 'REPUBLISHED' END AS result FROM x)
SELECT c_custkey AS subject, result, CAST(CASE WHEN result = 'REPUBLISHED' THEN c_nationkey + 1 END AS INTEGER) AS revision_number,
  CASE WHEN result <> 'REPUBLISHED' THEN 0 WHEN p = '3' THEN CASE WHEN b THEN 3 ELSE 2 END ELSE 3 END AS links, CASE WHEN result = 'REPUBLISHED' THEN 1 ELSE 0 END AS items,
  CASE WHEN result <> 'REPUBLISHED' THEN 0 WHEN b OR p = '5' THEN 3 ELSE 2 END AS facts FROM r"""


def republished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIPE-21, FLT-1, JOIN-19: by subject, what became of its edit, and the links, review items and facts of the successor."""
    made = M.successors(*edited_customers(spark, sf_dir))
    count = lambda name: made[name].groupBy("revision_id").agg(F.count(F.lit(1)).alias(name))
    out = made["results"].select("subject", "result", "revision_id", "revision_number")
    for name in ("links", "items", "facts"):
        out = out.join(count(name), "revision_id", "left")
    return out.drop("revision_id").fillna(0, ["links", "items", "facts"])


QUERIES["republished"], ORACLE_SQL["republished"] = republished, SQL
