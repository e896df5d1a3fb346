"""Selections, destinations, dispatch, sources, downloads and launch sizing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segloom.functions import paths as P

#: The two presets.
PRESETS = (("7b-fp8", 8192, 8_046_402_613, 8 << 30, 256), ("30b-fp8", 4096, 30_593_608_342, 3 << 30, 128))
#: Download mirrors, in order of preference.
SOURCES = ("modelscope", "hf_mirror", "huggingface")
MAX_ACTIVE, NEAR_TIE, SLACK, RESERVE = 8, 85, 1 << 20, 2 << 30
GIB, STEP, CEILING = 1 << 30, 0.05, 0.90


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PRESETS), "preset string, max_model_len long, download_bytes long, kv_bytes long, concurrency long")


def select_inputs(requests: DataFrame, files: DataFrame) -> DataFrame:
    """storage, path of the distinct supported files under the requested roots. requests and files: storage, path.

    A file is under each of its folders, so the roots meet files in an equality join.
    """
    folders = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda n: F.array_join(F.slice(F.split("path", "/"), F.lit(1), n), "/"))
    under = files.filter(P.detect(F.col("path")).isNotNull()).select("storage", "path", F.explode(folders).alias("root"))
    return under.join(requests.select("storage", F.col("path").alias("root")).distinct(), ["storage", "root"], "left_semi").select("storage", "path").distinct()


def destinations(inputs: DataFrame, mode: Column, strategy: Column, save_path: Column, mixed: Column) -> DataFrame:
    """inputs with outcome (generated, incompatible, planned) and save_path by strategy: beside the source, over it, or in a folder."""
    beside = P.output_path(F.col("path"), mode)
    foldered = P.api_path(F.concat_ws("/", save_path, F.when(mixed, F.col("storage")), beside))
    to = F.when(strategy == "sibling_suffix", P.api_path(beside)).when(strategy == "sibling_overwrite", P.api_path(F.col("path"))).otherwise(foldered)
    outcome = F.when(P.is_generated(F.col("path")), "generated").when((mode == "replace") & (P.detect(F.col("path")) == "docx"), "incompatible").otherwise("planned")
    return inputs.withColumn("outcome", outcome).withColumn("save_path", F.when(F.col("outcome") == "planned", to))


def skip_existing(planned: DataFrame, existing: DataFrame, strategy: Column) -> DataFrame:
    """planned with outcome 'existing' where the target is there and may not be overwritten. existing: save_path."""
    there = existing.select("save_path").distinct().withColumn("__there", F.lit(True))
    p = planned.join(there, "save_path", "left")
    return p.withColumn("outcome", F.when(F.col("__there") & (F.col("outcome") == "planned") & (strategy != "sibling_overwrite"), "existing").otherwise(F.col("outcome"))).drop("__there")


def dispatch(queue: DataFrame, running: DataFrame | None = None, most: int = MAX_ACTIVE) -> DataFrame:
    """id, place of the queued jobs that start at once, from a queue(id, preset, output, queue_pos) beside the running(preset, output).

    Only jobs of the running ones' preset start, or of the head's where nothing runs;
    of jobs with one output the first runs, and none while that output is being
    written. The head is a minimum, not a sort.
    """
    busy = running if running is not None else queue.limit(0)
    head = queue.agg(F.min_by("preset", "queue_pos").alias("head"))
    now = busy.agg(F.max("preset").alias("current"), F.count("*").alias("busy"))
    state = F.broadcast(head.join(now))  # one row
    same = queue.crossJoin(state).filter(F.col("preset") == F.coalesce("current", "head"))
    taken = busy.filter("output is not null").select("output").distinct()
    first = same.filter("output is not null").join(F.broadcast(taken), "output", "left_anti").groupBy("output").agg(F.min_by(F.struct("id", "queue_pos", "busy"), "queue_pos").alias("j")).select("j.*")
    chosen = first.unionByName(same.filter("output is null").select("id", "queue_pos", "busy")).orderBy("queue_pos").limit(most)
    placed = chosen.select("id", "busy", F.row_number().over(Window.orderBy("queue_pos")).cast("long").alias("place"))  # of `most` rows
    return placed.filter(F.col("place") + F.col("busy") <= most).select("id", "place")


def ranked_sources(results: DataFrame, group: str) -> DataFrame:
    """group, recommended: the fastest available source, the last among equals, but the first choice if it is nearly as fast.

    results: group, source, available, speed.
    """
    rank = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source"))
    up = results.filter("available").withColumn("speed", F.coalesce("speed", F.lit(0)).cast("long"))
    best = up.groupBy(group).agg(F.max_by("source", F.struct("speed", rank.alias("r"))).alias("fastest"), F.max("speed").alias("most"), F.max(F.when(F.col("source") == SOURCES[0], F.col("speed"))).alias("own"))
    return best.select(group, F.when(F.col("own") >= F.floor(F.col("most") * NEAR_TIE / 100), SOURCES[0]).otherwise(F.col("fastest")).alias("recommended"))


def preference(results: DataFrame, group: str) -> DataFrame:
    """group, sources: recommended, then measured by speed, then all in fixed order; equal neighbours are one, repeats stay."""
    rank = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source"))
    by_speed = results.filter("available").groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.coalesce("speed", F.lit(0))).alias("s"), rank.alias("r"), "source"))), lambda x: x.source).alias("measured"))
    every = F.array(*map(F.lit, SOURCES))
    row = results.select(group).distinct().join(ranked_sources(results, group), group, "left").join(by_speed, group, "left")
    joined = F.concat(F.when(F.col("recommended").isNotNull(), F.array("recommended")).otherwise(F.array().cast("array<string>")), F.coalesce("measured", F.array().cast("array<string>")), every)
    row = row.withColumn("__all", joined)
    return row.select(group, F.expr("filter(__all, (x, i) -> i = 0 or x != __all[i - 1])").alias("sources"))


def download_plan(files: DataFrame, group: str) -> DataFrame:
    """group, total, present, remaining of files(group, size, final_size, partial_size): whole files count, else what their part has."""
    got = F.when(F.least(F.coalesce("final_size", F.lit(0)), "size") == F.col("size"), F.col("size")).otherwise(F.least(F.coalesce("partial_size", F.lit(0)), "size"))
    return files.groupBy(group).agg(F.sum("size").cast("long").alias("total"), F.sum(got).cast("long").alias("present")).withColumn("remaining", F.greatest(F.lit(0), F.col("total") - F.col("present")))


def download_ok(total: Column, expected: Column, remaining: Column, free: Column) -> Column:
    return F.when(F.abs(total - expected) > SLACK, "unexpected_size").when(free < remaining + RESERVE, "no_space").otherwise("ok")


def speed_and_eta(total: Column, present: Column, transferred: Column, elapsed: Column) -> Column:
    speed = F.floor(transferred / F.greatest(elapsed, F.lit(0.25))).cast("long")
    return F.struct(speed.alias("speed"), F.when(speed > 0, F.floor((total - present) / F.greatest(speed, F.lit(1))).cast("long")).alias("eta"))


def launch_profile(weights: Column, kv: Column, tuned: Column, total: Column, free: Column, kv_flag: Column) -> Column:
    """struct(utilization, kv_bytes, ok): tuned values if they fit, else a higher share, else less cache, else no start."""
    need = weights + kv + 2 * GIB
    ceiling = F.least(F.lit(CEILING), free / total)
    shrunk = (F.floor(F.greatest(F.lit(0), F.floor(total * ceiling) - weights - 2 * GIB) / (256 << 20)) * (256 << 20)).cast("long")
    raised = F.least(F.ceil(need / total / STEP) * STEP, ceiling)
    as_is, fits = need <= tuned * total, need <= ceiling * total
    ok = as_is | fits | (shrunk >= GIB)
    share = F.when(as_is, tuned).when(fits, raised).otherwise(ceiling)
    cache = F.when(as_is | fits, kv).otherwise(shrunk)
    return F.struct(F.when(ok, share.cast("double")).alias("utilization"), F.when(ok & kv_flag, cache).cast("long").alias("kv_bytes"), ok.alias("ok"))


def listing(entries: DataFrame, folder: str) -> DataFrame:
    """name, path, kind, supported, size of one folder's visible entries. entries: path, size of files everywhere."""
    inside = entries.filter(F.col("path").startswith(folder + "/") if folder else F.lit(True))
    rest = F.substring(F.col("path"), F.lit(len(folder) + 2 if folder else 1), F.char_length("path"))
    parts = F.split(rest, "/")
    row = inside.select(F.element_at(parts, 1).alias("name"), F.when(F.size(parts) > 1, "directory").otherwise("file").alias("kind"), "size")
    row = row.filter(~F.col("name").startswith(".")).groupBy("name", "kind").agg(F.max(F.when(F.col("kind") == "file", F.col("size"))).alias("size"))
    path = F.concat(F.lit(f"{folder}/" if folder else ""), F.col("name"))
    return row.select("name", path.alias("path"), "kind", ((F.col("kind") == "file") & P.detect(F.col("name")).isNotNull()).alias("supported"), "size").orderBy(F.col("kind") != "directory", F.lower("name"))


def folder_filter(entries: DataFrame, query: str, kind: str | None = None) -> DataFrame:
    """Entries whose name or path has the query in it."""
    rows = entries.filter(F.contains(F.lower(F.concat_ws(" ", "name", "path")), F.lit(query.lower())))
    return rows.filter(F.col("kind") == kind) if kind else rows
