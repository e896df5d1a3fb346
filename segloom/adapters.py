"""The driver's tables as the inputs of the engine: text files, subtitles, pages, ledgers and telemetry.

The SQL fragments are written in what Spark and the oracle's dialect share, so
both sides start from the same rows and part ways where the operators begin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NL = "chr(10)"
#: Text files: some begin with a bracket, some have CRLF.
TXT = f"CASE WHEN doc_id % 7 = 0 THEN '[' || text WHEN doc_id % 5 = 1 THEN replace(text, {NL}, chr(13) || {NL}) ELSE text END"
_SEC = "lpad(CAST(turn % 60 AS STRING), 2, '0')"
_TEXT = "coalesce(text, '')"
_LINE = f"replace({_TEXT}, {NL}, ' ')"
PIECES = {
    "srt": f"CASE WHEN turn % 5 = 3 THEN 'NOTE ' || role || {NL} || {_TEXT} ELSE CAST(turn + 1 AS STRING) || {NL} || '00:00:' || {_SEC} || ',000 --> 00:00:' || {_SEC} || ',900' || {NL} || {_TEXT} END",
    "lrc": f"CASE WHEN turn % 6 = 5 THEN '[ti:' || role || ']' ELSE '[00:' || {_SEC} || '.00]' || CASE WHEN turn % 4 = 1 THEN '[1:30]' ELSE '' END || {_LINE} END",
    "ass": f"CASE WHEN turn % 5 = 4 THEN 'Comment: 0,0:00:01.00,0:00:02.00,Default,,0,0,0,,' || {_LINE} WHEN conv_id % 2 = 0 THEN 'Dialogue: 0,0:00:01.00,0:00:02.00,Default,,0,0,0,,{{\\\\an8}}{{i1}}' || {_LINE} ELSE 'Dialogue: 0:00:01.00,0:00:02.00,' || {_LINE} END",
    "md": f"CASE turn % 8 WHEN 0 THEN '# ' || {_LINE} WHEN 2 THEN '- ' || {_LINE} || {NL} || '- b' WHEN 3 THEN '```txt' || {NL} || {_TEXT} || {NL} || {NL} || '````' WHEN 4 THEN '* * *' WHEN 5 THEN '[x]: http://e.org/' WHEN 7 THEN {_TEXT} || {NL} || '~~~' || {NL} || 'code' ELSE {_TEXT} END",
}
HEADS = {
    "srt": "''",
    "vtt": f"'WEBVTT' || {NL} || {NL}",
    "lrc": f"'[ar:x]' || {NL}",
    "ass": f"'[Script Info]' || {NL} || 'Title: x' || {NL} || {NL} || '[V4+ Styles]' || {NL} || 'Format: Name, Text, Size' || {NL} || '[Events]' || {NL} || CASE WHEN conv_id % 2 = 0 THEN 'Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text' ELSE ' Format: Start, End, text' END || {NL}",
    "md": f"CASE WHEN conv_id % 4 = 0 THEN '---' || {NL} || 'title: x' || {NL} || '---' || {NL} ELSE '' END",
}
SEPARATORS = {"srt": "\n\n", "vtt": "\n\n", "lrc": "\n", "ass": "\n", "md": "\n\n"}
#: Files: a path for each part, of all kinds of extension.
PATH = """'d' || CAST(p_partkey % 5 AS STRING) || '/' || replace(p_name, ' ', '_') || '-' || CAST(p_partkey AS STRING) || CASE p_partkey % 13 WHEN 0 THEN '.epub' WHEN 1 THEN '.SRT' WHEN 2 THEN '.vtt' WHEN 3 THEN '.ass' WHEN 4 THEN '.ssa' WHEN 5 THEN '.lrc' WHEN 6 THEN '.TXT' WHEN 7 THEN '.md' WHEN 8 THEN '.markdown' WHEN 9 THEN '.docx' WHEN 10 THEN '.rtf' WHEN 11 THEN '' ELSE '.bilingual.txt' END"""
#: Jobs: a job for each order.
STATUS = "CASE o_orderkey % 7 WHEN 0 THEN 'queued' WHEN 1 THEN 'starting_model' WHEN 2 THEN 'translating' WHEN 3 THEN 'writing' WHEN 4 THEN 'completed' WHEN 5 THEN 'failed' ELSE 'cancelled' END"
#: Log lines, by event.
LOG = """CASE event_type WHEN 'view' THEN 'Loading safetensors checkpoint shards: ' || CAST(event_id % 101 AS STRING) || '% done' WHEN 'click' THEN chr(27) || '[32mCapturing CUDA graph ' || CAST(event_id % 300 AS STRING) || ' %' || chr(7) WHEN 'signup' THEN CASE WHEN event_id % 3 = 0 THEN ' Model loading took 3 s ' ELSE 'torchinductor: compiling' END WHEN 'purchase' THEN CASE WHEN event_id % 4 = 0 THEN 'Application startup complete.' ELSE props END ELSE repeat('x', CAST(event_id % 700 AS INT)) END"""
NOW = 1_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def txt_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source."""
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(TXT).alias("source"))


def subtitles(spark: SparkSession, sf_dir: str, format_: str) -> DataFrame:
    """conv_id, source: a file of the format for each conversation."""
    piece = PIECES["srt" if format_ == "vtt" else format_]
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(piece).alias("piece"))
    joined = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "piece"))).alias("p"))
    body = F.array_join(F.transform("p", lambda p: p.piece), SEPARATORS[format_])
    text = F.concat(F.expr(HEADS[format_]), body)
    return joined.select("conv_id", F.when(F.expr("conv_id % 3 = 1"), F.replace(text, F.lit("\n"), F.lit("\r\n"))).otherwise(text).alias("source"))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", F.expr(PATH).alias("path"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger."""
    created = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    total = F.expr("10 + o_orderkey % 90")
    return table(spark, sf_dir, "orders").select(
        F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("id"), F.substring(F.sha2(F.col("o_custkey").cast("string"), 256), 1, 32).alias("owner"), F.expr(STATUS).alias("status"),
        F.when(F.expr("o_orderkey % 2 = 0"), "7b-fp8").otherwise("30b-fp8").alias("preset"), F.when(F.expr("o_orderkey % 3 = 0"), "replace").otherwise("bilingual").alias("output_mode"), total.alias("total"), F.expr("(10 + o_orderkey % 90) * (o_orderkey % 5) div 4").alias("completed"),
        F.expr("o_orderkey % 10").alias("translated"), F.expr("o_orderkey % 4").alias("failed_segments"), F.when(F.expr("o_orderkey % 7 = 5"), "model failed").alias("error"), F.expr("o_orderkey % 7 = 4").alias("result_available"),
        F.expr("'out/' || CAST(o_orderkey % 50 AS STRING)").alias("save_to"), created.alias("created_at"), (created + F.expr("o_orderkey % 1000")).alias("updated_at"),
    )


#: The ledger in the oracle's dialect.
JOBS_SQL = f"""jobs AS (SELECT lpad(o_orderkey::VARCHAR, 12, '0') AS id, substr(sha256(o_custkey::VARCHAR), 1, 32) AS owner, {STATUS} AS status, CASE WHEN o_orderkey % 2 = 0 THEN '7b-fp8' ELSE '30b-fp8' END AS preset,
  CASE WHEN o_orderkey % 3 = 0 THEN 'replace' ELSE 'bilingual' END AS output_mode, (10 + o_orderkey % 90)::BIGINT AS total, ((10 + o_orderkey % 90) * (o_orderkey % 5) // 4)::BIGINT AS completed, (o_orderkey % 10)::BIGINT AS translated, (o_orderkey % 4)::BIGINT AS failed_segments,
  CASE WHEN o_orderkey % 7 = 5 THEN 'model failed' END AS error, o_orderkey % 7 = 4 AS result_available, 'out/' || (o_orderkey % 50)::VARCHAR AS save_to, epoch(o_orderdate)::BIGINT AS created_at, (epoch(o_orderdate)::BIGINT + o_orderkey % 1000)::BIGINT AS updated_at FROM orders)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, run, at (s), ts, line, ok."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("run"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), F.col("ts").cast("timestamp").alias("ts"), F.expr(LOG).alias("line"), (F.col("event_type") != "error").alias("ok"))
