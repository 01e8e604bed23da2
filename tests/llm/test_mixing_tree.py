"""The splitting tree and what comes of it: draws against the exact distribution, groups of sources, repeated rows, and the mixed corpus."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from attestra.llm import mixing


@pytest.mark.parametrize("of, marked, taken", [(50, 20, 25), (7, 1, 3), (1000, 3, 500), (3000, 1500, 1500), (12, 12, 5), (12, 4, 0), (9, 8, 8)])
def test_draws_invert_the_exact_distribution(spark, of, marked, taken):
    chances = [(k + 0.5) / 200 for k in range(200)]
    df = spark.createDataFrame([(c,) for c in chances], "c double")
    got = [r[0] for r in df.select(F.expr(mixing._drawn(f"{of}L", f"{marked}L", f"{taken}L", "c"))).collect()]
    low, high = max(0, taken - (of - marked)), min(marked, taken)
    total, cumulative, at = math.comb(of, taken), 0, low
    want = []
    weight = [math.comb(marked, x) * math.comb(of - marked, taken - x) for x in range(low, high + 1)]
    for c in chances:
        while at < high and (cumulative + weight[at - low]) / total < c:
            cumulative += weight[at - low]
            at += 1
        want.append(at)
    assert got == want


def test_more_sources_than_a_row_draws(spark, monkeypatch):
    monkeypatch.setattr(mixing, "WIDTH", 3)
    quotas = {f"s{i}": (i * 37) % 50 for i in range(20)} | {"hot": 3000}
    rows = mixing.split_tree(spark.createDataFrame(list(quotas.items()), "k string, n long"), 2, 7).collect()
    assert {k: sum(r["n"] for r in rows if r["k"] == k) for k in quotas} == quotas and min(r["n"] for r in rows) >= 0
    totals = [sum(r["n"] for r in rows if r["shard"] == s) for s in range(4)]
    assert max(totals) - min(totals) <= 2 and all(600 < r["n"] < 900 for r in rows if r["k"] == "hot")


def test_rows_with_one_id_or_none_spread(spark):
    rows = [(None, f"word {'x ' * (i % 7)}{i}", "a") for i in range(300)] + [(1, "same text here", "a")] * 300 + [(2, None, None), (3, "", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in rows)
    shards = Counter(c["shard"] for r in out if r["doc_id"] == 1 for c in r["copies"])
    assert len(shards) == 16 and max(shards.values()) < 60
    assert all(r["taken"] == sum(c["words"] for c in r["copies"]) for r in out)
    assert len({c["place"] for r in out for c in r["copies"]}) == sum(len(r["copies"]) for r in out)


def test_many_sources_are_ranked_and_levelled(spark):
    sizes = {f"s{i:03d}": (i * 7919) % 1000 for i in range(120)} | {None: 50}
    df = spark.createDataFrame([("0" if s is None else f"1{s}", s, n) for s, n in sizes.items()], "k string, source string, size long").repartition(5)
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    names = sorted(s for s in sizes if s is not None) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, full = dict.fromkeys(names, 0.0), set()
    while True:
        left, rest = sum(sizes.values()) - sum(target[s] for s in full), [s for s in names if s not in full]
        for s in rest:
            target[s] = left * weight[s] / sum(weight[x] for x in rest)
        over = {s for s in rest if target[s] > 3 * sizes[s]}
        if not over:
            break
        full |= over
        target |= {s: 3.0 * sizes[s] for s in over}
    assert all(abs(got[s] - target[s]) < 1e-6 for s in names)


def test_the_mixed_corpus_has_its_texts(spark):
    rows = [(i, f"text number {i} " * (i % 5), ["a", "b", None][i % 3], i) for i in range(60)] + [(7, "text number 7 " * 2, "b", 7)] * 2 + [(None, "no id", "a", 0), (None, None, "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    out = mixing.mix_corpus(docs).collect()
    assert {(r["doc_id"], r["text"]) for r in out} == {r[:2] for r in rows} and len(out) == len({r[:2] for r in rows})
    mixed = mixing.mix(docs).collect()
    assert sum(r["taken"] for r in out) == sum(r["taken"] for r in mixed) == sum(c["words"] for r in out for c in r["copies"])
    assert out[0].asDict().keys() == {"doc_id", "text", "source", "size", "source_size", "target", "taken", "copies"}
    assert mixing.mix_corpus(docs.where("1 = 0")).count() == 0
