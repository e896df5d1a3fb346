"""Settings, their bounds, and small rules of the service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segloom.functions import text as X
from segloom.plans import ledger

#: Defaults and bounds.
BATCH, CONTEXT, MOST_BATCH, MOST_CONTEXT, TARGET_BYTES, FILES = 25, 5, 100, 50, 64, 1000
LEASE_S, LEASE_LEAST, LEASE_MOST = 120, 30, 3600
STORAGES, MODES, STRATEGIES = ("documents", "remote_fs"), ("bilingual", "replace"), ("directory", "sibling_suffix", "sibling_overwrite")
PRESETS, STATUSES = ("7b-fp8", "30b-fp8"), (*ledger.ACTIVE, *ledger.TERMINAL)
#: Strategy of each format.
FORMATS = (("epub", "independent"), ("srt", "batched"), ("vtt", "batched"), ("ass", "batched"), ("lrc", "batched"), ("txt", "batched"), ("md", "batched"), ("docx", "independent"))


def strategies(spark: SparkSession) -> DataFrame:
    """format, kind, batch_size, context: how each format's segments go out."""
    f = spark.createDataFrame(list(FORMATS), "format string, kind string")
    many = F.col("kind") == "batched"
    return f.select("format", "kind", F.when(many, BATCH).otherwise(1).cast("long").alias("batch_size"), F.when(many, CONTEXT).otherwise(0).cast("long").alias("context"))


def valid(batch: Column, context: Column) -> Column:
    return batch.between(1, MOST_BATCH) & context.between(0, MOST_CONTEXT)


def valid_target(target: Column) -> Column:
    return F.octet_length(X.trim(target)).between(1, TARGET_BYTES)


def lease_ttl(asked: Column) -> Column:
    return F.least(F.lit(LEASE_MOST), F.greatest(F.lit(LEASE_LEAST), F.coalesce(asked, F.lit(LEASE_S)))).cast("long")


def live_leases(leases: DataFrame, now: int) -> DataFrame:
    """Leases that haven't run out; an older controller's are out whatever they say."""
    return leases.filter(F.col("expires_at") > now)


def retention_cutoff(now: Column, keep_s: Column) -> Column:
    return F.greatest(F.lit(0), now - keep_s).cast("long")


def page_size(asked: Column) -> Column:
    return F.least(F.lit(ledger.MOST), F.greatest(F.lit(1), F.coalesce(asked, F.lit(ledger.PAGE)))).cast("long")


def violations(jobs: DataFrame) -> DataFrame:
    """id, rule of each rule that a job breaks: values of presets, modes and statuses, and counts below zero."""
    rules = {"preset": ~F.col("preset").isin(*PRESETS), "mode": ~F.col("output_mode").isin(*MODES), "status": ~F.col("status").isin(*STATUSES)}
    rules |= {c: F.col(c) < 0 for c in ("total", "completed", "translated", "failed_segments", "created_at", "updated_at")}
    broken = F.filter(F.array(*[F.when(bad, F.lit(k)) for k, bad in rules.items()]), lambda x: x.isNotNull())
    return jobs.select("id", F.explode(broken).alias("rule"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """id, change between two snapshots(id, status): disappeared, appeared, phase or same."""
    b, a = before.select("id", F.col("status").alias("was"), F.lit(True).alias("b")), after.select("id", F.col("status").alias("now"), F.lit(True).alias("a"))
    same = ledger.phase(F.col("was")).eqNullSafe(ledger.phase(F.col("now")))
    return b.join(a, "id", "full").select("id", F.when(F.col("a").isNull(), "disappeared").when(F.col("b").isNull(), "appeared").when(same, "same").otherwise("phase").alias("change"))


def overlay(page: DataFrame, active: DataFrame, columns: list[str]) -> DataFrame:
    """page with the newer values that the active jobs have."""
    new = active.select("id", *[F.col(c).alias(f"__{c}") for c in columns])
    return page.join(new, "id", "left").select("id", *[F.coalesce(f"__{c}", c).alias(c) for c in columns])


def display_bytes(n: Column) -> Column:
    """For display; the unit names are fixed values."""
    kb, mib, gib = n / 1024, n / 1024 / 1024, n / 1024 / 1024 / 1024
    number = lambda x, digits: F.format_string(f"%.{digits}f", x)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, F.concat(number(kb, 1), F.lit(" KB"))).when(n < 1024**3, F.concat(number(mib, 1), F.lit(" MiB"))).otherwise(F.concat(number(gib, 2), F.lit(" GiB")))


def display_speed(per_second: Column) -> Column:
    return F.concat(display_bytes(per_second), F.lit("/s"))


def display_duration(seconds: Column) -> Column:
    """For display; the unit names are fixed values."""
    s = F.greatest(F.lit(0), F.round(seconds)).cast("long")
    minutes = F.floor(s / 60).cast("string")
    return F.when(s < 60, F.concat(s.cast("string"), F.lit(" 秒"))).when(s % 60 > 0, F.concat(minutes, F.lit(" 分 "), (s % 60).cast("string"), F.lit(" 秒"))).otherwise(F.concat(minutes, F.lit(" 分钟")))


def attribute_escape(x: Column) -> Column:
    return F.replace(F.replace(X.html_escape(x), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#39;"))


def file_url(source: Column, repo: Column, revision: Column, path: Column) -> Column:
    """Where a mirror has a file; the addresses' forms are fixed values."""
    hub = lambda base: F.concat(F.lit(base), repo, F.lit("/resolve/"), revision, F.lit("/"), path)
    scope = F.concat(F.lit("https://modelscope.cn/api/v1/models/"), repo, F.lit("/repo?Revision=master&FilePath="), F.url_encode(path))
    return F.when(source == "huggingface", hub("https://huggingface.co/")).when(source == "hf_mirror", hub("https://hf-mirror.com/")).when(source == "modelscope", scope)


def range_starts_at(content_range: Column, offset: Column) -> Column:
    return F.coalesce(content_range.startswith(F.concat(F.lit("bytes "), offset.cast("string"), F.lit("-"))), F.lit(False))


def log_lines(chunk: Column, most: int = 8192) -> Column:
    """Lines of a log chunk: ended by LF or CR, none empty, none over `most` bytes; a character that a cut splits shows as replacement characters on both sides."""
    pieces = F.transform(F.split(chunk, "[\n\r]"), lambda p: F.encode(p, "UTF-8"))
    cut = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.octet_length(p), F.lit(1)) - 1) / most).cast("int")), lambda k: F.make_valid_utf8(F.substring(p, k * most + 1, F.lit(most)).cast("string")))
    return F.filter(F.flatten(F.transform(pieces, cut)), lambda x: x != "")


def spine(items: DataFrame, refs: DataFrame, book: str = "book") -> DataFrame:
    """book, path, pos of content in reading order: references joined to the manifest, XHTML without navigation, each path once.

    items: book, id, href, media_type, properties, folder; refs: book, pos, idref.
    """
    from segloom.functions import paths as P

    kept = items.filter((F.col("media_type") == "application/xhtml+xml") & ~F.array_contains(F.split(F.coalesce("properties", F.lit("")), r"\s+"), "nav"))
    named = refs.join(kept.select(book, F.col("id").alias("idref"), P.join_archive(F.col("folder"), F.col("href")).alias("path")), [book, "idref"])
    return named.groupBy(book, "path").agg(F.min("pos").alias("pos"))
