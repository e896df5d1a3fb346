"""Streams give what the batch queries give."""

import os

from pyspark.sql import functions as F

from segloom.streaming import streams


def drained(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
        return df.sparkSession.table(name).collect()
    finally:
        q.stop()


def test_files_become_outputs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.txt").write_text(f"line {k}\n[skip]\nend")
    out = {}

    def sink(df, number):
        out.update({os.path.basename(r.path): r.output for r in df.collect()})

    q = streams.produce(streams.sources(spark, str(tmp_path / "in"), 1), "txt", lambda df: df.withColumn("tr", F.expr("map_from_entries(transform(segments, s -> struct(s.seg_id, upper(s.text))))")), sink, str(tmp_path / "ck"), "replace")
    q.processAllAvailable()
    q.stop()
    assert out == {f"{k}.txt": f"LINE {k}\n[skip]\nEND" for k in range(3)}


def test_throttle_and_probes(spark, tmp_path):
    at = [0, 1, 3, 4, 7, 20]
    spark.createDataFrame([("j", t, t in (0, 20)) for t in at], "key string, at long, ok boolean").write.parquet(str(tmp_path / "u"))
    source = spark.readStream.schema("key string, at long, ok boolean").parquet(str(tmp_path / "u"))
    assert sorted(r["at"] for r in drained(streams.throttled(source), "throttled")) == [0, 3, 7, 20]
    assert [r["at"] for r in drained(streams.probes(source), "probes")] == [4]
