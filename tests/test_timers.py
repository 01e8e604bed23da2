"""Request windows and overdue sources over several micro-batches, by timers where nothing follows."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from attestra.streaming import jobs as J
from attestra.streaming import timers as T

START = datetime(2030, 1, 1)


def batches(spark, tmp_path, rows, schema, cuts):
    """A stream that reads one file a micro-batch."""
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")


def test_windows_begin_with_the_first_request(spark, tmp_path):
    rng = random.Random(1)
    at = sorted(rng.randrange(3_000) for _ in range(240))
    rows = [(f"c{rng.randrange(3)}", START + timedelta(seconds=s)) for s in at] + [("end", START + timedelta(days=1))]
    want, open_ = set(), {}
    for client, ts in rows:
        start, n = open_.get(client, (None, 0))
        if start is None or ts >= start + timedelta(seconds=60):
            if start is not None:
                want.add((client, start, n, n > 2))
            start, n = ts, 0
        open_[client] = (start, n + 1)
    want |= {(c, s, n, n > 2) for c, (s, n) in open_.items() if c != "end"}  # by timer: a day has passed since
    stream = batches(spark, tmp_path, rows, "client string, ts timestamp", [0, 80, 160, 240, 241])
    got = J.run_to_end(T.request_windows(stream, limit=2), f"{tmp_path}/out").collect()
    assert {(r["client"], r["start"], r["requests"], r["limited"]) for r in got} == want and len(got) == len(want)


def test_a_source_that_falls_silent_is_overdue(spark, tmp_path):
    hour = lambda h: START + timedelta(hours=h)
    rows = [("a", hour(0)), ("b", hour(1)), ("a", hour(20)), ("b", hour(30)), ("c", hour(40)), ("a", hour(45)), ("d", hour(100))]
    want = {("b", hour(1)), ("b", hour(30)), ("c", hour(40)), ("a", hour(45))}
    stream = batches(spark, tmp_path, rows, "source_id string, at timestamp", [0, 2, 4, 6, 7])
    got = J.run_to_end(T.overdue_sources(stream), f"{tmp_path}/out").collect()
    assert {(r["source"], r["since"]) for r in got} == want and len(got) == 4
    twin = T.overdue_gaps(spark.createDataFrame(rows, "source_id string, at timestamp"), F.lit(hour(99)))
    assert {(r["source"], r["since"]) for r in twin.collect()} == want
