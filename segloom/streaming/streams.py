"""The pipeline and the controller's state as structured streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from segloom.operators import render, segments, units
from segloom.plans import telemetry
from segloom.sources import formats


def sources(spark: SparkSession, path: str, files_at_once: int = 64) -> DataFrame:
    """path, source of text files as they arrive; the trigger bounds how many are open."""
    raw = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_at_once).option("recursiveFileLookup", True).load(path)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("source"))


def packed(stream: DataFrame, format_: str, batch: int = units.BATCH, context: int = units.CONTEXT) -> DataFrame:
    """stream with blocks, segments and units: all on one row, so it streams without state."""
    df = formats.parse(stream, format_).withColumn("segments", segments.of_blocks(F.col("blocks")))
    return df.withColumn("units", units.units(F.col("segments"), units.starts_fixed(F.size("segments"), batch), context))


def produce(stream: DataFrame, format_: str, translate: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "bilingual"):
    """Starts a query that renders each micro-batch's files and gives them to sink(path, output), once for each batch.

    translate: packed rows -> path, tr (a map from segment to text).
    """
    if format_ in ("epub", "docx") and mode == "replace":
        raise ValueError(f"{format_} can't be written in replace mode")

    def each(batch: DataFrame, number: int) -> None:
        out = translate(batch).withColumn("output", render.render(format_, F.col("blocks"), F.col("tr"), mode))
        sink(out.select("path", "output"), number)

    return packed(stream, format_).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()


def throttled(updates: DataFrame, interval_s: int = telemetry.INTERVAL_S) -> DataFrame:
    """key, at (seconds) of updates that are written: the first of a key, then one that comes interval_s after the last written."""

    def walk(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        kept = []
        for t in sorted(t for df in rows for t in df["at"]):
            if last is None or t - last >= interval_s:
                last = int(t)
                kept.append(last)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({"key": [key[0]] * len(kept), "at": kept})

    return updates.select("key", "at").groupBy("key").applyInPandasWithState(walk, "key string, at long", "last long", "append", GroupStateTimeout.NoTimeout)


def probes(results: DataFrame, limit: int = telemetry.FAILURES) -> DataFrame:
    """key, at of each time that `limit` probes in a row have failed. results: key, at, ok."""

    def walk(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        hit = []
        for at, ok in sorted((int(a), bool(o)) for df in rows for a, o in zip(df["at"], df["ok"], strict=True)):
            n = 0 if ok else n + 1
            if n >= limit:
                hit.append(at)
                n = 0
        state.update((n,))
        yield pd.DataFrame({"key": [key[0]] * len(hit), "at": hit})

    return results.select("key", "at", "ok").groupBy("key").applyInPandasWithState(walk, "key string, at long", "n int", "append", GroupStateTimeout.NoTimeout)


def leases(uses: DataFrame, late: str = "10 minutes", idle_s: int = telemetry.IDLE_S) -> DataFrame:
    """Sessions of uses(key, ts) that end idle_s after their last use; a session is given when no late use can extend it."""
    return telemetry.lease_sessions(uses.withWatermark("ts", late), "key", "ts", idle_s)


def newest(updates: DataFrame, window_ms: int = 350) -> DataFrame:
    """key, at, the last value of each window: updates in quick succession are one. updates: key, ts, value."""
    w = F.window("ts", f"{window_ms} milliseconds")
    return updates.withWatermark("ts", "10 seconds").groupBy("key", w).agg(F.max_by("value", "ts").alias("value")).select("key", F.col("window.end").alias("at"), "value")
