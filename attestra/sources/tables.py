"""Landing files, feeds, append-only tables and JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def land_raw(files: DataFrame) -> DataFrame:
    """SRC-1: content-addressed rows of binaryFile rows (source, modificationTime, content): one for each source and SHA-256."""
    out = files.withColumn("sha", F.sha2("content", 256)).withColumn("year", F.year("modificationTime")).withColumn("month", F.month("modificationTime"))
    return out.dropDuplicates(["source", "sha"])


def write_raw(landed: DataFrame, path: str) -> None:
    landed.write.mode("append").partitionBy("source", "year", "month").parquet(path)


def scan_json_feed(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """SRC-2: rows of {result: […]} or […]: all nested scalars as one text, kept if it contains a term."""
    raw = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    items = F.coalesce(F.try_variant_get("v", "$.result", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))
    rows = raw.select(F.posexplode(items).alias("row_no", "item")).select("row_no", F.to_json("item").alias("json"))
    scalars = F.regexp_extract_all("json", F.lit(r'(?::|\[|,)\s*("(?:[^"\\]|\\.)*"(?!\s*:)|-?[0-9][0-9.eE+-]*|true|false)'), F.lit(1))
    text = F.array_join(F.transform(scalars, lambda x: F.regexp_replace(x, '^"|"$', "")), " ")
    out = rows.select("row_no", text.alias("text"), "json")
    return out.where(F.exists(F.array(*map(F.lit, terms)), lambda t: F.lower("text").contains(F.lower(t)))) if terms else out


def write_json_lines(rows: DataFrame, path: str) -> None:
    """SRC-7: one object a line, keys sorted."""
    rows.select(*sorted(rows.columns)).write.mode("append").option("ignoreNullFields", "false").json(path)


def backfill_wrappers(subjects: DataFrame, key: str, prefix: str, status: str) -> DataFrame:
    """SRC-8: one wrapper a subject, with an id that a rerun repeats."""
    return subjects.select(F.md5(F.concat(F.lit(prefix), F.col(key).cast("string"))).alias("wrapper_id"), key, F.lit(status).alias("split_status"))


def missing_objects(referenced: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """SRC-9: references whose object isn't stored."""
    return referenced.select(key).distinct().join(stored.select(key), key, "left_anti")
