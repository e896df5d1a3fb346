"""Segments of blocks, and numbers that run over all rows without one partition for all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segloom.functions.text import is_blank


def of_blocks(blocks: Column) -> Column:
    """Array of struct(seg_id, text): blocks to translate, by their place among all blocks."""
    numbered = F.transform(blocks, lambda b, i: F.struct(i.cast("long").alias("seg_id"), b.kind.alias("kind"), b.text.alias("text")))
    kept = F.filter(numbered, lambda b: (b.kind == "text") & ~is_blank(b.text))
    return F.transform(kept, lambda b: F.struct(b.seg_id.alias("seg_id"), b.text.alias("text")))


def explode_segments(df: DataFrame, keys: list[str], segments: str = "segments") -> DataFrame:
    """keys, seg_id, ord, text."""
    rows = df.select(*keys, F.posexplode(segments).alias("ord", "s"))
    return rows.select(*keys, F.col("s.seg_id").alias("seg_id"), F.col("ord").cast("long").alias("ord"), F.col("s.text").alias("text"))


def running_number(df: DataFrame, group: list[str], order: list[Column], out: str) -> DataFrame:
    """df with 0, 1, 2, ... in the order of group, then order.

    Groups are numbered inside themselves; only their counts, a row for each
    group, are summed in one place.
    """
    counts = df.groupBy(*group).agg(F.count("*").alias("__n"))
    before = Window.orderBy(*group).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(g).alias(f"__g_{g}") for g in group], F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inner = df.withColumn("__k", F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1)
    on = [F.col(g).eqNullSafe(F.col(f"__g_{g}")) for g in group]
    joined = inner.join(offsets, on)
    return joined.withColumn(out, (F.col("__before") + F.col("__k")).cast("long")).drop("__before", "__k", *[f"__g_{g}" for g in group])
