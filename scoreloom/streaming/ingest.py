"""Incremental ingestion of results, and event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

KEYS = ("model_name", "prompt_type", "question_id")


def result_stream(spark: SparkSession, folder: str, pattern: str, schema, late: str = "10 days") -> DataFrame:
    """New result rows of a folder, each (model, prompt, question) once within the watermark."""
    rows = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    return rows.withWatermark("run_timestamp", late).dropDuplicatesWithinWatermark(list(KEYS))


def append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write a stream once through to Parquet, as far as its source has data; run again to go on."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_batches(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write each micro-batch of a stream as a checkpoint of its own; one that is written again after a failure replaces itself."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retry_history(errors: DataFrame, size: int = 10, key: str = "model_name", ts: str = "ts") -> DataFrame:
    """The last `size` errors of each key as state of a stream: at every batch key, n and `spacing`, the mean seconds between them.

    `errors` is a stream with the key and a time. State is bounded by `size` a key.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def update(group, batches, state):
        kept = list(state.get[0]) if state.exists else []
        for frame in batches:
            kept += [int(x) for x in frame["__at"].dropna()]
        kept = sorted(kept)[-size:]
        state.update((kept,))
        gaps = [(b - a) / 1e6 for a, b in zip(kept, kept[1:])]
        yield pd.DataFrame({key: [group[0]], "n": [len(kept)], "spacing": [sum(gaps) / len(gaps) if gaps else None]})

    rows = errors.select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("__at"))
    return rows.groupBy(key).applyInPandasWithState(update, f"{key} string, n bigint, spacing double", "history array<bigint>", "update", GroupStateTimeout.NoTimeout)


def windowed(events: DataFrame, ts: str, late: str = "10 minutes", width: str = "1 hour", slide: str | None = None, key: str = "event_type") -> DataFrame:
    """Counts and means of values in tumbling or sliding windows; batch or stream alike."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return rows.groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select(F.col("w.start").alias("window_start"), key, "n", "mean_value")


def sessions(events: DataFrame, ts: str, gap: str = "30 minutes", late: str = "10 minutes", key: str = "user_id") -> DataFrame:
    """Sessions of each key, which end where nothing follows within the gap."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    g = rows.where(F.col(ts).isNotNull()).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n_events"))
    return g.select(key, F.col("w.start").alias("session_start"), "n_events")
