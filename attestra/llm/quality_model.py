"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import trees
from .common import columns_of, map_batches, table

#: Labelled rows that the trees are fitted on, at most; chosen by a hash of the id.
LABELLED = 20_000
THRESHOLD = 0.3

_CLASSES = ("letter_low", "letter_up", "digit", "space", "newline", "high", "symbol", "bang", "stop", "other")
_CLASS_OF = np.full(256, _CLASSES.index("other"), np.uint8)
for _chars, _name in ((b"abcdefghijklmnopqrstuvwxyz", "letter_low"), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "letter_up"), (b"0123456789", "digit"), (b" \t\r\x0b\x0c", "space"), (b"\n", "newline"), (bytes(range(128, 256)), "high"), (b"#*$%&|<>{}[]\\^~_=@", "symbol"), (b"!?", "bang"), (b".,;:", "stop")):
    _CLASS_OF[list(_chars)] = _CLASSES.index(_name)

FEATURES = ("bytes", "words", *_CLASSES, "word_bytes", "distinct_words", "top_word", "same_as_before", "line_words", "distinct_lines", "symbol_words", "ends_stopped", "distinct_pairs")
_SYMBOL_WORD = re.compile(rb"[#*$%&|<>!]")


def statistics(text: str | None) -> list[float]:
    """The statistics of one text, in the order of FEATURES; the whole text counts, and an empty one gives zeros."""
    b = text.encode() if text else b""
    w = b.split()
    if not w:
        return [0.0] * len(FEATURES)
    shares = np.bincount(_CLASS_OF[np.frombuffer(b, np.uint8)], minlength=len(_CLASSES)) / len(b)
    counts: dict[bytes, int] = {}
    for x in w:
        counts[x] = counts.get(x, 0) + 1
    lines = [x for x in b.split(b"\n") if x.strip()]
    n = len(w)
    return [
        float(np.log1p(len(b))), float(np.log1p(n)), *shares.tolist(), sum(map(len, w)) / n, len(counts) / n, max(counts.values()) / n, sum(map(bytes.__eq__, w, w[1:])) / n,
        n / len(lines), len(set(lines)) / len(lines), sum(c for x, c in counts.items() if _SYMBOL_WORD.search(x)) / n, sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / len(lines), len(set(zip(w, w[1:]))) / n,
    ]


def held_out(id_col: Column) -> Column:
    """Whether a row's label must not be learned: CRC-32 of the id as text is divisible by 5. A null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_labels(labels: DataFrame, id_col: str, label_col: str, most: int) -> DataFrame:
    """At most `most` labelled ids that are not held out, by a hash of the id; of repeated ids the larger label counts."""
    seen = columns_of(labels, id=id_col, y=labels[label_col].cast("int")).where("id is not null and y is not null")
    once = seen.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    return once.orderBy(F.xxhash64("id"), "id").limit(most)


def fit_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", labelled: int = LABELLED) -> trees.Trees:
    """Trees fitted on at most `labelled` ids with labels that are not held out; of rows that repeat an id, one counts. Only those rows' statistics reach the driver."""
    rows = columns_of(docs, id=id_col, text=text_col).join(F.broadcast(training_labels(labels, id_col, label_col, labelled)), "id")

    def run(x: dict[str, list]) -> dict[str, list]:
        return {"id": x["id"], "y": x["y"], "x": [statistics(t) for t in x["text"]]}

    each = map_batches(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, y int, x array<double>")
    got = each.groupBy("id").agg(F.max("y").alias("y"), F.min("x").alias("x")).collect()
    got.sort(key=lambda r: (r["id"], r["x"]))
    return trees.fit(np.array([r["x"] for r in got]).reshape(len(got), len(FEATURES)), np.array([r["y"] for r in got], float))


def score_quality(docs: DataFrame, model: trees.Trees, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs: id, held_out, score (0 to 1), predicted (1 from threshold on).

    Null and empty texts have all statistics at zero and get a score like any other. Repeated rows
    give repeated results, an empty table an empty one; only the named columns are read.
    """
    rows = columns_of(docs, id=id_col, text=text_col)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(x: dict[str, list]) -> dict[str, list]:
        return {"id": x["id"], "score": held.value.probability(np.array([statistics(t) for t in x["text"]]).reshape(-1, len(FEATURES)))}

    out = map_batches(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, score double")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
