"""Files of a folder tree as rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segloom.functions import paths as P


def scan(spark: SparkSession, root: str) -> DataFrame:
    """path (under root), format, length, content of the supported files that aren't outputs themselves.

    Rows have no order of their own; order by paths.components(path) where it matters.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(re.sub(r"([\[\]{}*?\\])", r"\\\1", root))
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/+", "/"), r"^/*\Q" + root.removeprefix("file:").strip("/") + r"\E/", "")
    rows = files.select(path.alias("path"), F.col("length"), F.col("content")).withColumn("format", P.detect(F.col("path")))
    return rows.filter(F.col("format").isNotNull() & ~P.is_generated(F.col("path"))).select("path", "format", "length", "content")


def texts(files: DataFrame) -> DataFrame:
    """files with source, or error where the bytes aren't UTF-8."""
    ok = F.is_valid_utf8(F.col("content").cast("string"))
    return files.withColumn("source", F.when(ok, F.col("content").cast("string"))).withColumn("error", F.when(~ok, "not valid UTF-8"))


def manifest(json_rows: DataFrame, body: str) -> DataFrame:
    """Rows' other columns, path, size, sha256 of the model files in a mirror's JSON list, of either of two shapes.

    The size is a number or text, or stands beside the hash of a large file; a file without one is an error of its row.
    """
    keep = [c for c in json_rows.columns if c != body]
    one = F.from_json(F.col(body), "array<struct<rfilename:string,size:string,lfs:struct<size:string,sha256:string>>>")
    two = F.from_json(F.col(body), "array<struct<Path:string,Size:string,Sha256:string>>")
    f = json_rows.select(*keep, F.explode(F.arrays_zip(one.alias("one"), two.alias("two"))).alias("f")).select(*keep, F.col("f.one").alias("one"), F.col("f.two").alias("two"))
    size = F.coalesce(F.col("one.size").try_cast("long"), F.col("one.lfs.size").try_cast("long"), F.col("two.Size").try_cast("long"))
    out = f.select(*keep, F.coalesce("one.rfilename", "two.Path").alias("path"), size.alias("size"), F.coalesce("one.lfs.sha256", "two.Sha256").alias("sha256"))
    return out.filter(P.is_runtime_file(F.col("path")))


def missing_shards(weight_map: DataFrame, files: DataFrame) -> DataFrame:
    """model, shard named by a weight map that no file of size holds. weight_map: model, body; files: model, path, size."""
    shards = weight_map.select("model", F.explode(F.array_distinct(F.map_values(F.from_json(F.get_json_object("body", "$.weight_map"), "map<string,string>")))).alias("shard"))
    there = files.filter("size > 0").select("model", F.col("path").alias("shard"))
    return shards.join(there, ["model", "shard"], "left_anti")


def weights_bytes(files: DataFrame, group: str) -> DataFrame:
    """group, bytes of weight files; null without any."""
    return files.groupBy(group).agg(F.sum(F.when(F.col("path").endswith(".safetensors"), F.col("size"))).cast("long").alias("bytes"))


def save(outputs: DataFrame, root: str) -> DataFrame:
    """path, outcome of outputs(path, content, overwrite), written under the root: written, identical, exists, unsafe or gone.

    A file is written beside its target under another name and then moved there, so
    no reader sees a part of one and a task that runs again does no harm. Without
    overwrite a file that is there stays: identical if it has the same content. With
    it the target has to be there. Paths that leave the root are refused.
    """

    def run(batches):
        import uuid

        import pyarrow as pa
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)

        def put(path: str, content: bytes, overwrite: bool) -> str:
            if path.startswith("/") or ".." in path.split("/"):
                return "unsafe"
            target = f"{at.rstrip('/')}/{path}"
            there = store.get_file_info(target).type
            if there == fs.FileType.File and not overwrite:
                with store.open_input_stream(target) as f:
                    return "identical" if f.read() == content else "exists"
            if there != (fs.FileType.File if overwrite else fs.FileType.NotFound):
                return "gone" if there == fs.FileType.NotFound else "exists"
            folder = target.rsplit("/", 1)[0]
            store.create_dir(folder, recursive=True)
            temp = f"{folder}/.segloom-{uuid.uuid4().hex}.tmp"
            try:
                with store.open_output_stream(temp) as f:
                    f.write(content)
                store.move(temp, target)
            finally:
                if store.get_file_info(temp).type == fs.FileType.File:
                    store.delete_file(temp)
            return "written"

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([put(p, c or b"", bool(o)) for p, c, o in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)], pa.string())], ["path", "outcome"])

    return outputs.select("path", F.col("content").cast("binary").alias("content"), "overwrite").mapInArrow(run, "path string, outcome string")
