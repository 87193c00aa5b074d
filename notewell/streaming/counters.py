"""Structured Streaming: session counters, repeat suppression and gated capture."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Event files as a stream; ts becomes a timestamp, which watermarks need."""
    return spark.readStream.schema(EVENTS).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def session_totals(events: DataFrame) -> DataFrame:
    """Running counters of each user and event type: one keyed state row each."""
    return events.groupBy("user_id", "event_type").agg(
        F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("decimal(18,2)")), 2).alias("total"), F.max("event_id").alias("last_event"))


def run_available(stream: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """Run the stream over all that is there, and read what its batches wrote below ``folder``, which executors share.

    A complete result is that of the last batch; in other modes the batches add up.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch_id={batch_id}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = stream.sparkSession.read.parquet(f"{folder}/out")
    if mode == "complete":
        rows = rows.where(F.col("batch_id") == rows.agg(F.max("batch_id")).first()[0])
    return rows.drop("batch_id")


def gated_capture(stream: DataFrame, target: str, checkpoint: str, complete: Callable[[DataFrame], bool]) -> None:
    """Write each micro-batch to its own folder; a batch that is not complete raises, so its offsets stay and it runs again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        if not complete(batch):
            raise RuntimeError(f"batch {batch_id} is incomplete")
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def keyed_state(events: DataFrame) -> DataFrame:
    """(user_id, total, hits, last_tier, last_event) kept as state of each user and sent out when it changes.

    The newest event by (ts, event_id) names the last tier, in whatever order batches arrive.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    schema = "user_id long, total long, hits long, last_tier string, last_event long"

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, hits, tier, last, ts = state.get if state.exists else (0, 0, "", -1, -1)
        for rows in batches:
            total += len(rows)
            hits += int(rows["event_type"].isin(["purchase", "signup"]).sum())
            newest = rows.sort_values(["us", "event_id"]).iloc[-1]
            if (int(newest["us"]), int(newest["event_id"])) > (ts, last):
                tier, last, ts = newest["event_type"], int(newest["event_id"]), int(newest["us"])
        state.update((total, hits, tier, last, ts))
        yield pd.DataFrame({"user_id": [key[0]], "total": [total], "hits": [hits], "last_tier": [tier], "last_event": [last]})

    ship(events.sparkSession)
    narrow = events.select("user_id", "event_id", "event_type", F.unix_micros("ts").alias("us"))
    return narrow.groupBy("user_id").applyInPandasWithState(update, schema, "total long, hits long, tier string, last long, ts long", "update", GroupStateTimeout.NoTimeout)
