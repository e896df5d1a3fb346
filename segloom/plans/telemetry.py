"""Controller telemetry as queries over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segloom.functions.text import sanitize_log, startup_signal

FAILURES, RECENT, EXPECTED_S, IDLE_S, INTERVAL_S = 3, 40, 360, 600, 3


def signals(lines: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """keys, line, stage, progress of cleaned lines that aren't empty."""
    rows = lines.withColumn(line, sanitize_log(F.col(line))).filter(F.col(line) != "")
    s = startup_signal(F.col(line))
    return rows.select(*keys, line, s["stage"].alias("stage"), s["progress"].alias("progress"))


def startup_progress(found: DataFrame, run: str, order: list[Column]) -> DataFrame:
    """found with the progress and stage in force: a lower signal is passed over, an equal one taken."""
    upto = Window.partitionBy(run).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    so_far = F.coalesce(F.max("progress").over(upto), F.lit(0))
    taken = found.withColumn("now_progress", so_far)
    stage = F.last(F.when(F.col("progress") >= F.col("now_progress"), F.col("stage")), True).over(upto)
    return taken.withColumn("now_stage", stage)


def probe_failures(probes: DataFrame, run: str, order: list[Column], ok: str = "ok", limit: int = FAILURES) -> DataFrame:
    """probes with the failures in a row up to each, and whether that one reaches the limit; a limit starts the count anew."""
    upto = Window.partitionBy(run).orderBy(*order)
    island = F.sum(F.col(ok).cast("int")).over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = probes.withColumn("__g", F.coalesce(island, F.lit(0)))
    n = F.sum((~F.col(ok)).cast("int")).over(Window.partitionBy(run, "__g").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    row = F.when(F.col(ok), 0).otherwise((n - 1) % limit + 1)
    return rows.withColumn("failures", row.cast("long")).withColumn("failed", F.col("failures") == limit).drop("__g")


def eta(progress: Column, elapsed: Column, timeout: Column) -> Column:
    """Seconds left of a start: the schedule's, or its mean with what the progress so far foretells."""
    scheduled = F.greatest(F.lit(0), EXPECTED_S - elapsed)
    observed = F.floor(elapsed * (100 - progress) / F.when(progress > 0, progress))
    blend = F.least(F.floor((scheduled + observed) / 2), F.greatest(F.lit(0), timeout - elapsed))
    return F.when(progress <= 5, scheduled).otherwise(blend).cast("long")


def recent_logs(lines: DataFrame, run: str, order: list[Column], n: int = RECENT) -> DataFrame:
    """The last n lines of each run with 1 for the newest."""
    w = Window.partitionBy(run).orderBy(*[c.desc() for c in order])
    return lines.withColumn("back", F.row_number().over(w).cast("long")).filter(F.col("back") <= n)


def lease_sessions(uses: DataFrame, key: str, at: str, idle_s: int = IDLE_S) -> DataFrame:
    """key, session_start, session_end, uses: uses of a key without an idle gap of idle_s; the end is the last use and the gap."""
    return uses.groupBy(key, F.session_window(at, f"{idle_s} seconds").alias("s")).agg(F.count("*").alias("uses")).select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "uses")


def throttled(updates: DataFrame, key: str, at: str, interval_s: int = INTERVAL_S) -> DataFrame:
    """key, at of the progress updates that are written: the first, then each that comes interval_s or later after the last written one.

    at: seconds. Keys' updates pass in order, sorted by the shuffle; what is held is the last written one of a key.
    """
    rows = updates.select(F.col(key).alias("key"), F.col(at).cast("long").alias("at"))
    kind = rows.schema["key"].dataType.simpleString()

    def walk(batches):
        import pyarrow as pa

        now, last = object(), 0
        for b in batches:
            keep = []
            for i, (k, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if k != now or t - last >= interval_s:
                    now, last = k, t
                    keep.append(i)
            yield b.take(pa.array(keep, pa.int64()))

    kept = rows.filter("at is not null").distinct().repartition("key").sortWithinPartitions("key", "at").mapInArrow(walk, f"key {kind}, at long")
    return kept.select(F.col("key").alias(key), F.col("at").alias(at))
