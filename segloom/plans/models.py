"""Model directories, their status and order, storage sizes, start attempts and what a service accepts, as queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Files that a model directory needs, presets in their order, and limits.
REQUIRED = ("config.json", "tokenizer.json", "model.safetensors.index.json")
ORDER = ("7b-fp8", "30b-fp8")
STARTS, FRESH_S, UPLOAD_BYTES, FIELD_BYTES = 3, 86_400, 512 << 20, 8 << 10


def validated(files: DataFrame, shards: DataFrame) -> DataFrame:
    """model, problem (null if none), bytes of each model of files(model, path, size) and shards(model, shard) that its weight map names.

    The first problem counts: required files in their order, then no shards, then the shards by name.
    """
    models = files.select("model").union(shards.select("model")).distinct()
    need = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(x).alias("path")) for i, x in enumerate(REQUIRED)])
    wanted = models.select("model", F.explode(need).alias("w")).select("model", "w.*")
    wanted = wanted.unionByName(shards.filter("shard is not null").distinct().select("model", F.lit(len(REQUIRED) + 1).alias("rank"), F.col("shard").alias("path")))
    met = wanted.join(files.select("model", "path", "size"), ["model", "path"], "left")
    bad = F.when(F.col("size").isNull(), F.concat(F.lit("missing "), "path")).when(F.col("size") <= 0, F.concat(F.lit("invalid "), "path"))
    none = models.join(shards.filter("shard is not null"), "model", "left_anti").select("model", F.lit(len(REQUIRED)).alias("rank"), F.lit("").alias("path"), F.lit("no shards").alias("problem"))
    found = met.select("model", "rank", "path", bad.alias("problem")).filter("problem is not null").unionByName(none)
    first = found.groupBy("model").agg(F.min_by("problem", F.struct("rank", "path")).alias("problem"))
    return models.join(first, "model", "left").join(sizes(files, "model"), "model", "left").select("model", "problem", F.coalesce("bytes", F.lit(0)).alias("bytes"))


def sizes(files: DataFrame, group: str, without: Column | None = None) -> DataFrame:
    """group, bytes of all files but those under the folder `without`."""
    kept = files if without is None else files.filter(~((F.col("path") == without) | F.col("path").startswith(F.concat(without, F.lit("/")))))
    return kept.groupBy(group).agg(F.sum("size").cast("long").alias("bytes"))


def status(checked: DataFrame, partial: DataFrame) -> DataFrame:
    """model, state, bytes: ready if nothing is wrong, paused with what a download has left, or absent. partial: model, downloaded."""
    have = F.coalesce("downloaded", F.lit(0)).cast("long")
    ok = F.col("problem").isNull()
    return checked.join(partial, "model", "left").select("model", F.when(ok, "ready").when(have > 0, "paused").otherwise("absent").alias("state"), F.when(ok, F.col("bytes")).otherwise(have).alias("bytes"))


def display_rank(preset: Column) -> Column:
    """Where a preset stands in a list; unknown ones come last."""
    out = F.lit(99)
    for i, name in enumerate(ORDER):
        out = F.when(preset == name, i).otherwise(out)
    return out


def usable_benchmarks(runs: DataFrame, group: str, now: int) -> DataFrame:
    """The last run of each group and whether it still serves: complete and less than a day old. runs: group, tested_at, state."""
    last = runs.groupBy(group).agg(F.max_by(F.struct("tested_at", "state"), F.struct("tested_at", "state")).alias("r")).select(group, "r.*")
    return last.withColumn("usable", F.coalesce((F.col("state") == "complete") & (now - F.col("tested_at") < FRESH_S), F.lit(False)))


def start_attempts(events: DataFrame, run: str, order: list[Column], failed: str = "failed", most: int = STARTS) -> DataFrame:
    """events up to the failure that uses up the attempts, with the failures so far and what follows: wait, retry or give_up."""
    so_far = F.sum(F.col(failed).cast("int")).over(Window.partitionBy(run).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = events.withColumn("failures", so_far.cast("long"))
    what = F.when(~F.col(failed), "wait").when(F.col("failures") < most, "retry").otherwise("give_up")
    return rows.withColumn("then", what).filter((F.col("failures") < most) | ((F.col("failures") == most) & F.col(failed)))


def accepts(kind: Column, length: Column) -> Column:
    """Whether an uploaded file, or another field of a request, is within its limit."""
    return length <= F.when(kind == "file", UPLOAD_BYTES).otherwise(FIELD_BYTES)


def ascending(ranges: DataFrame, group: str) -> DataFrame:
    """group, ok: whether ranges(group, start, end) don't overlap, in the order of their starts."""
    before = F.lag("end").over(Window.partitionBy(group).orderBy("start", "end"))
    return ranges.withColumn("__ok", F.coalesce(before <= F.col("start"), F.lit(True))).groupBy(group).agg(F.bool_and("__ok").alias("ok"))
