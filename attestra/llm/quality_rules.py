"""Quality rules and a hashed n-gram log-likelihood ratio, in Spark's own expressions only.

The ratio compares two multinomials over hash buckets of words and word pairs: one of documents
that are trusted, one of all documents. Each document's sum is divided by its n-grams and held
against a fixed threshold; nothing is drawn at random.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_of, table

#: Hash buckets of words and word pairs, together, whatever the size of the corpus: a verdict depends on the counts alone.
BUCKETS = 1 << 17
#: Thousandths of a nat, as which ratios are stored: sums are then exact and the same in any order.
UNIT = 1000
#: Nats for each n-gram; a document below this reads less like the trusted ones than like the others.
THRESHOLD = -0.05
#: Pseudo-counts of a bucket.
SMOOTHING = 1.0

_SPACES = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    trimmed = F.btrim(text, F.lit(_SPACES))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, "[\\x20\\x09-\\x0D]+")).otherwise(F.array().cast("array<string>"))


def without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(_SPACES))) > 0)


def _from(array: str, first: int) -> Column:
    return F.slice(array, F.lit(first), F.greatest(F.size(array) - (first - 1), F.lit(0)))


def _but_last(array: str, short: int) -> Column:
    return F.slice(array, F.lit(1), F.greatest(F.size(array) - short, F.lit(0)))


def _hashes(df: DataFrame) -> DataFrame:
    """id, text, lines (those with a word), n (number of words), h (a hash of each word) and p (one of each pair of neighbours)."""
    t = F.coalesce("text", F.lit(""))
    out = df.select("id", t.alias("text"), words(t).alias("w"), _lines(t).alias("lines"))
    out = out.select("id", "text", "lines", F.size("w").alias("n"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    return out.withColumn("p", F.zip_with(_but_last("h", 1), _from("h", 2), lambda a, b: F.xxhash64(a, b)))


def _beside_equal(items: str, same: str) -> Column:
    """The items of a sorted array that equal a neighbour, where same[i] says whether items i and i + 1 are equal."""
    return F.filter(items, lambda x, i: F.coalesce(F.get(same, i), F.lit(False)) | F.coalesce(F.get(same, i - 1), F.lit(False)))


def _repeat_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words inside a 3-word window that occurs twice or more.

    Only where windows repeat at all, the lower bits of a window's hash and its position share one
    long integer, so that windows which may be equal are neighbours once sorted. Those alone are
    sorted again by their whole hash and their words, which decide: the number is exact.
    """
    none, nothing = F.array().cast("array<bigint>"), F.expr("cast(array() as array<struct<h:bigint,words:array<string>,at:bigint>>)")
    out = df.withColumn("t", F.zip_with(_but_last("p", 1), _from("h", 3), lambda a, b: F.xxhash64(a, b)))
    out = out.withColumn("bits", F.when(F.size(F.array_distinct("t")) < F.size("t"), F.length(F.bin(F.col("n")))).otherwise(F.lit(0)))
    marked = F.sort_array(F.transform("t", lambda x, i: _shift(x, F.col("bits")).bitwiseOR(i.cast("long"))))
    out = out.withColumn("m", F.when(F.col("bits") > 0, marked).otherwise(none))
    out = out.withColumn("same", F.zip_with(_but_last("m", 1), _from("m", 2), lambda a, b: _unshift(a, F.col("bits")) == _unshift(b, F.col("bits"))))
    places = F.transform(_beside_equal("m", "same"), lambda x: x.bitwiseAND(F.expr("shiftleft(1L, bits) - 1")))
    out = out.withColumn("maybe", F.when(F.array_contains("same", True), places).otherwise(none))
    window = lambda w, i: F.struct(F.get("t", i.cast("int")).alias("h"), F.slice(w, i.cast("int") + 1, F.lit(3)).alias("words"), i.alias("at"))
    # The words are split once more, as the only item of an array, so that the optimizer can't move the split into the inner loop.
    whole = F.get(F.transform(F.array(words(F.col("text"))), lambda w: F.sort_array(F.transform("maybe", lambda i: window(w, i)))), F.lit(0))
    out = out.withColumn("m", F.when(F.size("maybe") > 0, whole).otherwise(nothing))
    out = out.withColumn("same", F.zip_with(_but_last("m", 1), _from("m", 2), lambda a, b: (a["h"] == b["h"]) & (a["words"] == b["words"])))
    out = out.withColumn("at", F.sort_array(F.transform(_beside_equal("m", "same"), lambda x: x["at"])))
    gaps = F.zip_with(_but_last("at", 1), _from("at", 2), lambda a, b: F.least(b - a, F.lit(3)))
    return out.withColumn("n_repeat_words", F.when(F.size("at") > 0, F.aggregate(gaps, F.lit(3).cast("long"), lambda s, x: s + x)).otherwise(F.lit(0).cast("long")))


def _shift(x: Column, bits: Column) -> Column:
    return F.call_function("shiftleft", x, bits)


def _unshift(x: Column, bits: Column) -> Column:
    return F.call_function("shiftright", x, bits)


def _counts(df: DataFrame) -> DataFrame:
    """Adds the counts of the base rules to what _hashes gives."""
    return (
        _repeat_words(df)
        .withColumn("word_chars", F.length(without(F.col("text"), _SPACES)).cast("long"))
        .withColumn("n_symbols", (F.length("text") - F.length(without(F.col("text"), _SYMBOLS))).cast("long"))
        .withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    )


def trusted_by_rule() -> Column:
    """A stricter rule than the base ones, which no label enters: long enough, few symbols and shouts, many different words, no repeated line."""
    n, length = F.col("n"), F.length("text")
    symbols, shouts = length - F.length(without(F.col("text"), _SYMBOLS)), length - F.length(without(F.col("text"), "!"))
    return (n >= 50) & (100 * symbols <= n) & (20 * shouts <= n) & (100 * F.size(F.array_distinct("h")) >= 35 * n) & (F.size("lines") == F.size(F.array_distinct("lines")))


def bucket_ratios(docs: DataFrame, trusted: Column | None = None, *, buckets: int = BUCKETS) -> list[int]:
    """For each bucket, the log of its share among trusted documents over its share among all, in thousandths.

    docs has id and text; trusted is a condition on text, lines and n (the number of words). All
    documents are counted, first within each task. What reaches the driver is a row for each bucket,
    `buckets` of them at most, whatever the corpus.
    """
    of = _hashes(docs).select(F.coalesce(trusted_by_rule() if trusted is None else trusted, F.lit(False)).cast("long").alias("trusted"), "h", "p")
    # Of a plain column the optimizer would first filter the rows where it is empty, below the projections, where that computes all arrays once more.
    each = of.select("trusted", F.explode(F.concat("h", "p")).alias("x"))
    counted = each.groupBy(F.pmod("x", F.lit(buckets)).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum("trusted").alias("t"))
    target, raw = [0] * buckets, [0] * buckets
    for b, n, t in counted.select("b", "n", "t").collect():
        raw[b], target[b] = n, t
    shift = math.log((SMOOTHING * buckets + sum(raw)) / (SMOOTHING * buckets + sum(target)))
    return [round(UNIT * (math.log((t + SMOOTHING) / (r + SMOOTHING)) + shift)) for t, r in zip(target, raw)]


def quality_rules(docs: DataFrame, ratios: list[int] | None = None, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept.

    score is the mean log-likelihood ratio of the text's words and word pairs (0 without any);
    kept says that no base rule failed and score is at least threshold. ratios are taken from docs
    unless given. Null and empty texts have no words and fail. Repeated rows give repeated results,
    an empty table an empty one; only the named columns are read. A long text is one row of arrays
    in its task, and nothing of a text is shuffled.
    """
    rows = columns_of(docs, id=id_col, text=text_col)
    ratios = bucket_ratios(rows) if ratios is None else ratios
    size = len(ratios)
    held = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<int>")  # folded once, by the optimizer
    out = _counts(_hashes(rows)).withColumn("g", F.concat("h", "p"))
    total = F.aggregate("g", F.lit(0).cast("long"), lambda s, x: s + F.get(held, F.pmod(x, F.lit(size)).cast("int")))
    out = out.withColumn("score", F.when(F.col("n") > 0, total / (UNIT * F.size("g"))).otherwise(F.lit(0.0)))
    # Row numbers are no function of the row, so a later filter on kept isn't pushed below, where it would compute all arrays again and again.
    once = F.monotonically_increasing_id() >= 0
    failed = (F.col("n") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n"))
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "score", (once & ~failed & (F.col("score") >= threshold)).alias("kept"))


def keep_by_rules(docs: DataFrame, ratios: list[int] | None = None, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that quality_rules keeps, with their columns; the verdict is computed beside the row, without a join."""
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text_col].alias("text"))
    judged = quality_rules(packed, ratios, id_col="row", text_col="text", threshold=threshold).where("kept")
    return judged.select(*[judged["row"][c].alias(c) for c in docs.columns])


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("score")
