"""Small cases of single operators."""

import datetime
import uuid

import pytest
from pyspark.sql import functions as F

from attestra.functions import scalars as S
from attestra.operators import extraction as E
from attestra.operators import history as H
from attestra.operators import serving as P
from attestra.sources import tables as T
from attestra.streaming import jobs as J


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("kind", "raw", "canon", "ok"),
    [
        ("STRING", "x", "x", True), ("INTEGER", "7", "7", True), ("INTEGER", "1.0", None, False), ("INTEGER", "true", None, False), ("DECIMAL", "1.500", "1.5", True), ("DECIMAL", "-0", "0", True),
        ("DECIMAL", "10", "10", True), ("DECIMAL", "NaN", None, False), ("BOOLEAN", "true", "true", True), ("BOOLEAN", "1", None, False), ("DATE", "2024-02-29", "2024-02-29", True), ("DATE", "2023-02-30", None, False),
        ("DATETIME", "2024-01-01T10:00:00+02:00", "2024-01-01T08:00:00Z", True), ("DATETIME", "2024-01-01T10:00:00", None, False), ("JSON", '{"b": 1, "a": [2]}', '{"a":[2],"b":1}', True), ("JSON", "{", None, False), ("NULL", None, None, True), ("NULL", "x", None, False), ("STRING", None, None, False),
    ],
)
def test_typed_value(spark, kind, raw, canon, ok):
    got = value(spark, S.typed_value(F.lit(kind), F.lit(raw).cast("string")))
    assert (got["value_canon"], got["is_valid"]) == (canon, ok)


def test_urls(spark):
    norm = lambda u: value(spark, S.normalize_url(F.lit(u)))
    assert norm("HTTPS://Ex.Org:443#top") == "https://ex.org/"
    assert norm("http://ex.org:8080/a?b=1#c") == "http://ex.org:8080/a?b=1"
    assert norm("http://u:p@ex.org/") is None and norm("ftp://ex.org/") is None


def test_uuid5_is_pythons(spark):
    for name in ("a", "posts/7", "é"):
        assert value(spark, S.uuid5(uuid.NAMESPACE_URL.hex, F.lit(name))) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


def test_dates(spark):
    day = datetime.date
    assert value(spark, S.listing_date(F.lit("dated 4th August 2026"))) == day(2026, 8, 4)
    assert value(spark, S.listing_date(F.lit("on 31.02.2024"))) is None
    assert value(spark, S.age_on(F.lit("2000-03-01").cast("date"), F.lit("2024-02-29").cast("date"))) == 23
    window = value(spark, S.application_window(F.lit("Apply from 01/02/2024 to 15-03-2024")))
    assert (window["start_date"], window["end_date"]) == (day(2024, 2, 1), day(2024, 3, 15))
    assert value(spark, S.application_window(F.lit("from 01/02/2024 to 15-01-2024"))) is None


@pytest.mark.parametrize(("start", "end", "want"), [("2024-02-01", "2024-01-01", "UNKNOWN"), ("2024-07-01", None, "UPCOMING"), ("2024-01-01", None, "UNKNOWN"), ("2024-01-01", "2024-06-01", "OPEN"), ("2024-01-01", "2024-05-02", "RECENTLY_CLOSED"), ("2024-01-01", "2024-05-01", "CLOSED"), (None, None, "UNKNOWN")])
def test_lifecycle(spark, start, end, want):
    d = lambda x: F.lit(x).cast("date")
    assert value(spark, S.lifecycle(d(start), d(end), d("2024-06-01"))) == want


def test_names_and_keys(spark):
    assert value(spark, S.canonical_post_name(F.lit("Clerk - North"), F.lit("North"))) == "Clerk – North"
    assert value(spark, S.split_camel(F.lit("JuniorClerk."))) == "Junior Clerk"
    assert value(spark, S.without_trailing_date(F.lit("Notice dated 01/02/2024"))) == "Notice"
    assert len(value(spark, S.post_key(F.lit("very long " * 30), F.lit("unit")))) == 110
    assert value(spark, S.number_year_key("X", F.lit("Advt 012/2026"))) == "X_ADVT_12_2026"
    assert value(spark, S.redacted_error(F.lit("db://me:secret@host down\nmore"))) == "db://***:***@host down"
    assert value(spark, S.nfc(F.lit("é"))) == "é"
    assert value(spark, S.clean_item(F.lit(" iv) Fourth"))) == "Fourth"


def test_fact_set_hash_ignores_order(spark):
    df = spark.createDataFrame([(["b", "a"],), (["a", "b"],)], "x array<string>")
    assert df.select(S.fact_set_hash(F.transform("x", lambda v: F.struct(v.alias("p"))))).distinct().count() == 1


TABLE = "Intro\n| Name of Post | Unit | UR | SC | Total |\n| Clerk | A | 2 | 1 | 3 |\n| Clerk | B | 1 | 1 | 2 |\nEnd"


def test_history_repoints_without_changes(spark):
    rows = [(1, i, i, p, p, "x") for i, p in enumerate("AABA")]
    v = spark.createDataFrame(rows, "subject int, seq_ts int, seq_id int, projection string, status string, priority string")
    assert [r["event"] for r in H.publish_events(v).orderBy("seq_id").collect()] == ["CREATED", "UNCHANGED", "UPDATED", "REPOINTED"]
    assert {r["seq_id"] for r in H.version_changes(v, ["status", "priority"]).collect()} == {0, 2}


def test_append_is_idempotent(spark):
    new = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    first = H.append_new(new, new.limit(0), ["k"])
    assert first.count() == 2 and H.append_new(new, first, ["k"]).count() == 0


def test_eligibility_outcomes(spark):
    f = lambda age, low, high, cat, rel: value(spark, P.age_outcome(*(F.lit(x).cast("int") for x in (age, low, high)), F.lit(cat).cast("string"), F.lit(rel).cast("int")))
    assert [f(30, None, None, None, None), f(None, 18, 30, None, None), f(17, 18, 30, None, None), f(31, 18, 30, "GENERAL", 5), f(31, 18, 30, "R", None), f(36, 18, 30, "R", 5), f(35, 18, 30, "R", 5)] == ["UNKNOWN", "UNKNOWN", "NOT_ELIGIBLE", "NOT_ELIGIBLE", "REVIEW_REQUIRED", "NOT_ELIGIBLE", "ELIGIBLE"]


def test_json_feed(spark, tmp_path):
    (tmp_path / "feed.json").write_text('{"result": [{"t": "Advt 12/2026 \\"x\\"", "n": {"y": 5}}, {"t": "other"}]}')
    rows = T.scan_json_feed(spark, str(tmp_path / "feed.json"), ["advt"]).collect()
    assert len(rows) == 1 and "Advt 12/2026" in rows[0]["text"] and "5" in rows[0]["text"]


def test_streamed_labels_equal_the_batch(spark, tmp_path):
    rows = [(e, f"u{u}", f"h{(i * 7 + u) % 3}", i, i) for i in range(40) for e, u in [(i % 2, i % 5)]]
    df = spark.createDataFrame(rows, "endpoint_id int, url string, content_hash string, observed_at int, observation_id long")
    for lo in (0, 20):
        df.where(f"observed_at >= {lo} and observed_at < {lo + 20}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    J.label_observations(stream).writeStream.format("memory").queryName("labels_seen").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = {r["observation_id"]: r["label"] for r in spark.table("labels_seen").collect()}
    assert got == {r["observation_id"]: r["label"] for r in H.classify_observations(df).collect()}


def test_each_batch_appends_once(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string").write.parquet(f"{tmp_path}/in")
    for n in ("one", "two"):
        stream = spark.readStream.schema("k int, v string").parquet(f"{tmp_path}/in")
        J.append_each_batch(stream, lambda df: df, f"{tmp_path}/out", ["k"], f"{tmp_path}/{n}").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_alerts_are_distinct_in_a_stream(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([("a", at), ("a", at), ("b", at)], "dedup_key string, at timestamp").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("dedup_key string, at timestamp").parquet(f"{tmp_path}/in")
    J.distinct_alerts(stream).writeStream.format("memory").queryName("alerts_seen").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("alerts_seen").count() == 2
