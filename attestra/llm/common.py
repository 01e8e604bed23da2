"""What the text operators share: table access, checkpoints and Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows that a Python task holds at once; long texts are split further by Spark's limit on bytes of a batch.
ROWS_AT_ONCE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder, `spark.checkpoint.dir`; a temporary one only where that is unset (tests on one machine)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-"))
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and reads it from there: a lost executor loses nothing that was written."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """cut_lineage by a Parquet table in that folder: the planner knows its size, and nothing of what df was made from stays in later plans."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of one key that a task joins before the key is dealt out further, and keys that are dealt out at most: no other key has more than a ten-thousandth of all rows.
HOT_ROWS, MOST_HOT = 256, 10_000


def hot_keys(counts: DataFrame, key: str, rows: int = HOT_ROWS) -> DataFrame:
    """key, salts of the keys in counts (key, n) with more than `rows` rows: the MOST_HOT largest, so that they can be broadcast."""
    top = counts.where(F.col("n") > rows).orderBy(F.desc("n"), key).limit(MOST_HOT)
    return F.broadcast(top.select(key, F.ceil(F.col("n") / rows).cast("int").alias("salts")))


def spread_join(left: DataFrame, right: DataFrame, key: str, by: list[str], *, counts: DataFrame | None = None, how: str = "inner", rows: int = HOT_ROWS) -> DataFrame:
    """left joined with right, which has at most one row for each key; hot keys of left lie in several tasks, by a hash of its columns `by`.

    counts (key, n) says how many rows of left a key has; it is counted unless given.
    """
    hot = hot_keys(left.groupBy(key).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts, key, rows)
    salts = F.coalesce("salts", F.lit(1))
    many = left.join(hot, key, "left").withColumn("salt", F.pmod(F.xxhash64(*by), salts).cast("int")).drop("salts")
    one = right.join(hot, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return many.join(one, [key, "salt"], how).drop("salt")


def sized_join(left: DataFrame, right: DataFrame, key: str, by: list[str], n: str, *, rows: int = HOT_ROWS) -> DataFrame:
    """spread_join where every row of either side says in column n how many rows of left its key has; right's column n is dropped."""
    salts = F.ceil(F.col(n) / rows).cast("int")
    many = left.withColumn("salt", F.pmod(F.xxhash64(*by), salts).cast("int"))
    one = right.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop(n)
    return many.join(one, [key, "salt"]).drop("salt")


def columns_of(df: DataFrame, **names: str | Column) -> DataFrame:
    """df with exactly these columns, so that other columns of the input can't clash with results."""
    return df.select(*[(df[c] if isinstance(c, str) else c).alias(k) for k, c in names.items()])


def clear_of(spans: Iterable[tuple[int, int]]) -> Callable[[int, int], bool]:
    """Whether a span (start, end) overlaps none of these, found by bisection."""
    joined: list[list[int]] = []
    for a, b in sorted(spans):
        if joined and a <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b])
    starts = [a for a, _ in joined]
    return lambda a, b: not (k := bisect_left(starts, b)) or joined[k - 1][1] <= a


def map_batches(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str | StructType) -> DataFrame:
    """Applies fn to small batches of df: {column: values} to {column: values}, in Python tasks over Arrow."""
    kind = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                part = whole.slice(at, ROWS_AT_ONCE)
                out = fn({name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, kind)


def beside(docs: DataFrame, text_col: str) -> DataFrame:
    """row (a struct of all other columns) and text: an operator takes row for the id and carries it along, without a join."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns if c != text_col]).alias("row"), docs[text_col].alias("text"))


def restored(df: DataFrame, columns: list[str], text_col: str) -> DataFrame:
    """The columns that beside packed, in their order; df has row and text."""
    return df.select(*[df["text"].alias(c) if c == text_col else df["row"][c].alias(c) for c in columns])
