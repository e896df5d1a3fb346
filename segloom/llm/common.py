"""Shared pieces: tables, shared scratch tables, text partitions, word rules."""

from __future__ import annotations

import atexit
import pickle
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of anything but blank and U+0009 to U+000D; the word rule of several contracts.
WORD = r"[^\x20\x09-\x0D]+"
_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where none is set: the warehouse, which a cluster shares, or on one machine a temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        alone = re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master)
        at = f"file://{tempfile.mkdtemp(prefix='segloom-')}" if alone else f"{spark.conf.get('spark.sql.warehouse.dir')}/segloom-scratch"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


class Sent:
    """A broadcast of a value with its classes, so that executors need no copy of the package."""

    def __init__(self, spark: SparkSession, value) -> None:
        self.bytes, self.got = spark.sparkContext.broadcast(cloudpickle.dumps(value)), []

    def __getstate__(self) -> dict:
        return {"bytes": self.bytes, "got": []}

    @property
    def value(self):
        if not self.got:
            self.got.append(pickle.loads(self.bytes.value))
        return self.got[0]


def materialize(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """Writes df to a table in the shared folder and reads it back: lineage ends there, and a lost executor loses nothing.

    The table of instead_of, which nothing else may read, is deleted after that.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/segloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._segloom_path = path
    if (old := getattr(instead_of, "_segloom_path", None)) is not None:
        _delete(spark, old)
        _written.remove((spark, old))
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release() -> None:
    """Deletes the tables that materialize() wrote; runs by itself when Python ends."""
    while _written:
        spark, path = _written.pop()
        try:
            if spark.sparkContext._jvm is not None:
                _delete(spark, path)
        except Exception:  # the session has ended already
            return


atexit.register(release)


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def by_batch(f: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow's function from one on batches, in slices of 512 rows so that long texts don't add up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                yield f(batch.slice(at, 512))

    return run


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a text column; null is empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def by_bytes(batch: pa.RecordBatch, most: int, name: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with texts of `most` bytes in all, or one row."""
    begin = total = 0
    for i, n in enumerate(map(len, raw_texts(batch, name))):
        if i > begin and total + n > most:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


def crc_part(id_col: str, n: int):
    """crc32 of the id's text modulo n: the folds of the contracts."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n
