"""Observation labels, run staleness, alert and request streams. Each has a batch twin among the operators."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Labels(StatefulProcessor):
    """What an endpoint's URL has shown so far: one entry of state for each content hash, as long as ttl_ms says."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "content_hash string", "n long", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        df = pd.concat(rows).sort_values(["observed_at", "observation_id"])
        first = ~df["content_hash"].duplicated()
        hashes = df.loc[first, "content_hash"]
        fresh = {h for h in hashes if not self.seen.containsKey((h,))}
        label = np.where(first & df["content_hash"].isin(fresh), "CHANGED", "UNCHANGED")
        if not self.seen.exists():
            label[0] = "NEW"
        for h in hashes:
            self.seen.updateValue((h,), (1,))
        yield pd.DataFrame({"observation_id": df["observation_id"].to_numpy(), "label": label})

    def close(self) -> None:
        pass


def label_observations(stream: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """STR-1: NEW, CHANGED or UNCHANGED as observations arrive, by endpoint and URL. Needs the RocksDB state store. Twin: classify_observations.

    With ttl_ms, content that wasn't seen for so long is forgotten, which bounds the state.
    """
    mode = "None" if ttl_ms is None else "ProcessingTime"
    return stream.groupBy("endpoint_id", "url").transformWithStateInPandas(_Labels(ttl_ms), "observation_id long, label string", "Append", mode)


def stale_runs(stream: DataFrame, minutes: int = 60) -> DataFrame:
    """STR-2: runs in RUNNING for which no end came within the time, as the watermark passes. stream: run_id, status, at."""
    bounded = stream.withWatermark("at", f"{minutes} minutes")
    sessions = bounded.groupBy("run_id", F.session_window("at", f"{minutes} minutes")).agg(F.max(F.when(F.col("status") != "RUNNING", 1).otherwise(0)).alias("ended"), F.min("at").alias("since"))
    return sessions.where("ended = 0").select("run_id", "since", F.lit("RUNNING_STALE").alias("alert"))


def distinct_alerts(stream: DataFrame, key: str = "dedup_key", at: str = "at", within: str = "1 day") -> DataFrame:
    """STR-3: the first alert of a key within the watermark."""
    return stream.withWatermark(at, within).dropDuplicatesWithinWatermark([key])


def request_counts(requests: DataFrame, limit: int = 120, window: str = "60 seconds", client: str | Column = "client", at: str = "ts") -> DataFrame:
    """STR-4: requests by client and clock-aligned window, and whether they pass the limit. Rows later than the watermark are dropped in a stream; a batch counts all."""
    if requests.isStreaming:
        requests = requests.withWatermark(at, "5 minutes")
    return requests.groupBy(F.window(at, window), client).agg(F.count(F.lit(1)).alias("requests")).select(F.col("window.start").alias("start"), client, "requests", (F.col("requests") > limit).alias("limited"))


def append_each_batch(stream: DataFrame, operator, path: str, keys: list[str], checkpoint: str):
    """STR-5: runs a batch operator on every micro-batch and adds rows whose key is new; a replayed batch replaces what it wrote before.

    Each batch writes a folder of its own, named by the checkpoint and the epoch, and looks up its keys in all other folders.
    """
    spark = stream.sparkSession
    empty = operator(spark.createDataFrame([], stream.schema))
    empty.write.mode("overwrite").parquet(f"{path}/batch=none")
    schema = StructType([*empty.schema.fields, StructField("batch", StringType())])
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def write(batch: DataFrame, epoch: int) -> None:
        mine = f"{name}_{epoch}"
        known = batch.sparkSession.read.schema(schema).option("basePath", path).parquet(path).where(F.col("batch") != mine).select(*keys)
        new = operator(batch).dropDuplicates(keys).join(known, keys, "left_anti")
        new.write.mode("overwrite").parquet(f"{path}/batch={mine}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_end(stream: DataFrame, folder: str) -> DataFrame:
    """What the stream appends for all that is there now, as files in the folder."""
    rows = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state")
    rows.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
