"""Personal data: long digit runs against brute force, and what nearby words do to a score."""

import random
import re

from attestra.llm import pii


def brute_ips(text):
    """Octets are compared as text, since no number of their length is built."""
    low = lambda p: p.lstrip("0") == "" or len(p.lstrip("0")) < 3 or (len(p.lstrip("0")) == 3 and p.lstrip("0") <= "255")
    return [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(map(low, m[0].split(".")))]


def test_long_digit_runs():
    rng = random.Random(4)
    parts = ["1", "255", "256", ".", ".", ".", "9" * 5000, "0" * 5000 + "7", " ", "-", "+", "(", "@a.b"]
    for _ in range(300):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(16)))
        assert [s[1:] for s in pii.base_spans(t) if s[0] == "ip"] == brute_ips(t)
        pii.find(t)
    assert [s[1:] for s in pii.find("1.1.1." + "9" * 5000)[0]] == []


def kinds(text):
    return [k for k, *_ in pii.find(text)[1]]


def test_words_move_every_added_kind():
    iban, ssn = "GB82 WEST 1234 5698 7654 32", "123-45-6789"
    assert kinds(f"{iban}") == ["iban"] and kinds(f"sample {iban}") == [] and kinds(f"sample {iban} of my bank") == ["iban"]
    assert kinds(ssn) == [] and kinds(f"social security {ssn}") == ["ssn"] and kinds(f"invoice {ssn}, tax") == []


def test_words_are_whole():
    scores = lambda t: [p for *_, p in pii.find(t)[1]]
    assert scores("ship 10.0.0.1 border") == [0.7] and scores("host 10.0.0.1") == [0.9] and scores("order 10.0.0.1") == [0.5]
    far = "x" * 38
    assert scores(f"order {far} 10.0.0.1") == [0.7]  # beyond the reach
    assert scores(f"xorder {'y' * 33} 10.0.0.1") == [0.7]  # cut by the reach
    assert scores("Kreditkarte 4111 1111 1111 1111") == [1.0]


def test_no_added_span_over_a_base_span():
    text = "iban GB82 WEST 1234 5698 7654 32 " * 50 + "card 4111 1111 1111 1111 "
    base, every = pii.find(text)
    added = [s for s in every if s[0] in pii.ADDED]
    assert len(added) == 50 and not any(a < e and s < b for _, s, e, _ in added for _, a, b in base)


def test_copies_of_one_secret_are_dealt_out(spark):
    """5,000 exact copies of a text: its candidate meets its counts in as many tasks as rows of one key are split into, and the result is that of each copy."""
    from pyspark.sql import functions as F

    from attestra.llm import secrets

    text = "token = 93f225f22ac4fd8e52991f66d5fe2fb55b67009f"
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"), F.concat(F.lit("s"), F.col("id") % 7).alias("source"))
    found = secrets.candidates(docs, "doc_id", "text", "source").select("id", "print", F.explode("found").alias("c")).select("id", "print", "c.start")
    salts = found.groupBy(F.pmod(F.xxhash64("id", "print", "start"), F.lit(20)).alias("salt")).count().collect()
    assert len(salts) == 20 and max(r["count"] for r in salts) < 2 * found.count() / 20
    out = secrets.find_secrets(docs)
    assert out.count() == 5000 and out.select("n_assign", "n_hex", "spans", "base_sha256").distinct().count() == 1
