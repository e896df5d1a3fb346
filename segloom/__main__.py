"""python -m segloom ROOT: bilingual or translated files beside those of a folder tree, from the command line."""

from __future__ import annotations

import argparse
import sys
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segloom.functions import paths as P
from segloom.operators import cache, engine, translate, units
from segloom.sources import files

#: Formats whose files are text; archives are written by sources.zipped.
TEXT_FORMATS = ("txt", "srt", "vtt", "ass", "lrc", "md")


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="segloom", description=__doc__)
    p.add_argument("root", help="folder tree with the files")
    p.add_argument("--out", help="folder for the outputs; beside the sources if not given")
    p.add_argument("--mode", choices=("bilingual", "replace"), default="bilingual")
    p.add_argument("--target", default="Chinese")
    p.add_argument("--model", default="7b-fp8")
    p.add_argument("--endpoint", default="http://127.0.0.1:8000/v1", help="chat server")
    p.add_argument("--translator", choices=("http", "fake", "echo"), default="http")
    p.add_argument("--cache", required=True, help="folder of the translation table, which all machines see")
    p.add_argument("--batch-size", type=int, default=units.BATCH)
    p.add_argument("--context", type=int, default=units.CONTEXT)
    a = p.parse_args(argv)
    if not 1 <= a.batch_size <= 100 or not 0 <= a.context <= 50:
        p.error("batch size is 1 to 100, context 0 to 50")
    return a


def run(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """path, outcome, error of each supported text file: what became of its output, or why there is none."""
    found = files.texts(files.scan(spark, a.root)).withColumn("doc_id", F.xxhash64("path"))
    endpoint, model, kind = a.endpoint, a.model, a.translator
    make = (lambda: translate.http(endpoint, model)) if kind == "http" else (lambda: translate.fake) if kind == "fake" else (lambda: translate.echo)
    table, out = f"{a.cache.rstrip('/')}/table", []

    def save(new: DataFrame) -> DataFrame:
        at = f"{a.cache.rstrip('/')}/runs/{uuid.uuid4().hex}"
        new.write.parquet(at)
        kept = spark.read.schema(new.schema).parquet(at)
        cache.write(kept.groupBy("key").agg(F.max("value").alias("value")), table, time.time_ns())
        return kept

    for name in TEXT_FORMATS:
        docs = found.filter((F.col("format") == name) & F.col("error").isNull())
        got = engine.produce(docs.select("doc_id", "source"), name, cache.read(spark, table), make, a.model, a.target, save, a.mode, a.batch_size, a.context)
        named = docs.select("doc_id", "path").join(got, "doc_id")
        to = P.output_path(F.col("path"), F.lit(a.mode))
        out.append(files.save(named.select(to.alias("path"), F.col("output").alias("content"), F.lit(False).alias("overwrite")), a.out or a.root).withColumn("error", F.lit(None).cast("string")))
    bad = found.filter(F.col("error").isNotNull()).select("path", F.lit("skipped").alias("outcome"), "error")
    for df in out:
        bad = bad.unionByName(df)
    return bad


def main(argv: list[str] | None = None) -> int:
    a = arguments(argv)
    spark = SparkSession.builder.appName("segloom").getOrCreate()
    rows = run(spark, a).collect()  # a row for each file, for people to read
    for r in sorted(rows):
        print(r.outcome, r.path, r.error or "", sep="\t")
    return int(any(r.outcome not in ("written", "identical") for r in rows))


if __name__ == "__main__":
    sys.exit(main())
