"""Structured Streaming forms over event streams (event_id, ts, user_id, event_type, value).

Event time rules: a watermark bounds how late an event may come; later ones are dropped
by the stateful operators, and their state goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.plans.store import newest

LATE = "10 minutes"
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 4, schema: str = EVENTS) -> DataFrame:
    """STR6/STR7: a folder of Parquet files as a stream, so many files a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def deduplicated(events: DataFrame, late: str = LATE) -> DataFrame:
    """STR3/STR8: the first event of each id within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def windowed_counts(events: DataFrame, seconds: int = 60, slide: int = 30, late: str = LATE) -> DataFrame:
    """STR1: events of a user in sliding windows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", f"{seconds} seconds", f"{slide} seconds").alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "user_id", "n")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """STR10: sessions of a user by gaps."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def progress(events: DataFrame) -> DataFrame:
    """STR5: running totals by kind, for update mode."""
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("ts").alias("latest"))


def limited(events: DataFrame, limit: int, seconds: int = 60, late: str = LATE) -> DataFrame:
    """STR1/STR2: exactly the allowed events of each user: at most limit allowed ones in any window of so many seconds.

    State is the times of a user's allowed events in the window; it goes with the watermark.
    """

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(frames).sort_values(["ts", "event_id"])
        span, out = seconds * 1_000_000, []
        for i, t in zip(rows["event_id"], rows["ts"].astype("datetime64[us]").astype("int64"), strict=True):
            kept = [x for x in kept if x > t - span]
            ok = len(kept) < limit
            if ok:
                kept.append(int(t))
            out.append((int(i), key[0], ok))
        state.update((kept,))
        state.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + seconds * 1000 + 1)
        yield pd.DataFrame(out, columns=["event_id", "user_id", "allowed"])

    from pyspark.sql.streaming.state import GroupStateTimeout

    return events.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(step, "event_id long, user_id long, allowed boolean", "times array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def upsert_sink(path: str, key: str, order: str):
    """SNK9/STR6: a foreachBatch function that writes each micro-batch's newest row a key by order as a batch folder of its own, so a retried batch overwrites itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        newest(batch, key, order).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is now and return its result."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def run_to_table(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is now into a table below path, and return the table.

    append: a Parquet sink. complete: each micro-batch's whole result replaces the one before, in a folder of its own; the
    last one is returned, so that a retried batch overwrites itself and readers never see half a result.
    """
    spark, where = stream.sparkSession, {}
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{path}/rows").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{path}/rows")

    def write(batch: DataFrame, batch_id: int) -> None:
        where["last"] = f"{path}/batch={batch_id}"
        batch.write.mode("overwrite").parquet(where["last"])

    writer.foreachBatch(write).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(where["last"])


def assembled(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """STR11: the text of each answer from its token events (keys, seq, token), which may come in any order or twice."""
    once = tokens.groupBy(*keys, "seq").agg(F.min("token").alias("token"))
    lists = once.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("seq", "token"))).alias("l"))
    return lists.select(*keys, F.array_join(F.transform("l", lambda x: x["token"]), "").alias("text"))
