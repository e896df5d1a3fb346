"""The translation table: key, value. Keys hash model, target and the untrimmed text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segloom.functions.text import cache_key


def keyed(segments: DataFrame, model: Column, target: Column) -> DataFrame:
    return segments.withColumn("key", cache_key(model, target, F.col("text")))


def hits(keyed_segments: DataFrame, cache: DataFrame) -> DataFrame:
    """Segments with the value that the table has for them. Frequent texts are split by adaptive skew joins."""
    return keyed_segments.join(cache.select("key", "value"), "key")


def misses(keyed_segments: DataFrame, cache: DataFrame) -> DataFrame:
    """Segments to translate: these alone reach a translator."""
    return keyed_segments.join(cache.select("key"), "key", "left_anti")


def put(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The table after a write: a key's new value replaces its old one."""
    fresh = new.groupBy("key").agg(F.max("value").alias("value"))
    return cache.join(fresh.select("key"), "key", "left_anti").select("key", "value").unionByName(fresh)


def write(new: DataFrame, path: str, at: int) -> None:
    """Appends new values of the time `at`, partitioned by the first two digits of the key, as lookups may be; old ones stay until compacted and count no more."""
    new.select("key", "value", F.lit(at).cast("long").alias("at"), F.substring("key", 1, 2).alias("shard")).write.mode("append").partitionBy("shard").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table: the newest value of each key; nothing where nothing has been written yet."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "key string, value string")
    return spark.read.schema("key string, value string, at long, shard string").parquet(path).groupBy("key").agg(F.max_by("value", F.struct("at", "value")).alias("value"))
