"""Quality rules: repeated windows by their words, whatever their hashes, and buckets whose number no corpus changes."""

import random

from pyspark.sql import functions as F

from attestra.llm import quality_rules


def repeated(words):
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    return len({j for at in seen.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)})


def test_repeated_windows_of_few_words_and_of_long_texts(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcd") * rng.randrange(1, 3) for _ in range(rng.randrange(60))) for _ in range(200)]
    texts.append(" ".join(str(rng.randrange(3000)) for _ in range(60_000)))
    out = quality_rules.quality_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), [0] * 8)
    assert {r["doc_id"]: r["n_repeat_words"] for r in out.collect()} == {i: repeated(t.split()) for i, t in enumerate(texts)}


def test_windows_with_equal_hashes_count_by_their_words(spark):
    """All hashes are made equal, so that only the words can tell windows apart."""
    rows = [(0, "a b c d e a b c x"), (1, "a b c d e f"), (2, "a a a a")]
    df = quality_rules._hashes(spark.createDataFrame(rows, "id long, text string"))
    same = df.withColumn("h", F.transform("h", lambda x: F.lit(5).cast("long"))).withColumn("p", F.transform("p", lambda x: F.lit(7).cast("long")))
    assert {r["id"]: r["n_repeat_words"] for r in quality_rules._repeat_words(same).collect()} == {0: 6, 1: 0, 2: 4}


def test_a_verdict_does_not_depend_on_size_steps(spark):
    """A corpus of any size has the same buckets, and a document that shares no word with the others keeps its verdict."""
    words = " ".join(f"w{i}" for i in range(60))
    small = spark.createDataFrame([(1, words), (2, None)], "id long, text string")
    assert len(quality_rules.bucket_ratios(small.where("1 = 0"))) == quality_rules.BUCKETS
    large = small.union(spark.range(3, 2003).select("id", F.repeat(F.lit("x"), 50_000).alias("text")))
    few, many = quality_rules.bucket_ratios(small), quality_rules.bucket_ratios(large)
    assert len(few) == len(many) == quality_rules.BUCKETS
    kept = [{r["id"]: r["kept"] for r in quality_rules.quality_rules(small, r, id_col="id").collect()} for r in (few, many)]
    assert kept[0] == kept[1] == {1: True, 2: False}


def test_counting_computes_a_text_once(spark):
    """What stands in for a costly text says how often it is computed: once for each row, also of texts without words."""
    calls = spark.sparkContext.accumulator(0)

    def costly(text):
        calls.add(1)
        return text

    docs = spark.createDataFrame([(1, "a b"), (2, ""), (3, None), (4, "a c a b")], "id long, text string")
    ratios = quality_rules.bucket_ratios(docs.withColumn("text", F.udf(costly, "string")("text")), F.col("n") >= 3, buckets=64)
    assert calls.value == 4
    assert ratios == quality_rules.bucket_ratios(docs, F.col("n") >= 3, buckets=64) and len(set(ratios)) > 1
