"""Request units: segments packed in order, under a count, a size and a global limit.

A document's segments are one array column, so packing is an expression on one
row: parallel over documents, and nothing moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segloom.functions.text import let

BATCH, CONTEXT, HEAD, EACH = 25, 5, 512, 16


def starts_fixed(n: Column, batch: int = BATCH) -> Column:
    """First places of batches of `batch`."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(batch))).otherwise(F.array().cast("array<int>"))


def starts_greedy(sizes: Column, batch: int, context: int, budget: int) -> Column:
    """First places of units whose estimated prompt stays within budget; a unit's first cue always fits.

    sizes: UTF-8 bytes of each segment. A prompt counts HEAD, the context's bytes,
    and each cue's bytes with EACH for its tags.
    """
    none = F.array().cast("array<int>")

    def fold(a: Column) -> Column:
        def before(k: Column) -> Column:
            seen = F.slice(a, F.greatest(k - context, F.lit(0)) + 1, F.least(k, F.lit(context)))
            return F.aggregate(seen, F.lit(0).cast("long"), lambda x, y: x + y)

        def step(acc: Column, k: Column) -> Column:
            own = F.element_at(a, k + 1) + EACH
            new = (F.size(acc.starts) == 0) | (k - acc.i >= batch) | (acc.c + own > budget)
            return F.struct(F.when(new, k).otherwise(acc.i).alias("i"), F.when(new, HEAD + before(k) + own).otherwise(acc.c + own).cast("long").alias("c"), F.when(new, F.concat(acc.starts, F.array(k))).otherwise(acc.starts).alias("starts"))

        start = F.struct(F.lit(0).alias("i"), F.lit(0).cast("long").alias("c"), none.alias("starts"))
        return F.when(F.size(a) > 0, F.aggregate(F.sequence(F.lit(0), F.size(a) - 1), start, step)["starts"]).otherwise(none)

    return let(sizes, fold)


def units(segments: Column, starts: Column, context: int = CONTEXT) -> Column:
    """Array of struct(ids, cues, context) from segments and the units' first places."""

    def unit(bound: Column, start: Column, u: Column) -> Column:
        end = F.coalesce(F.get(bound.starts, u + 1), F.size(bound.segments))
        own = F.slice(bound.segments, start + 1, end - start)
        before = F.slice(bound.segments, F.greatest(start - context, F.lit(0)) + 1, F.least(start, F.lit(context)))
        return F.struct(F.transform(own, lambda s: s.seg_id).alias("ids"), F.transform(own, lambda s: s.text).alias("cues"), F.transform(before, lambda s: s.text).alias("context"))

    return let(F.struct(segments.alias("segments"), starts.alias("starts")), lambda b: F.transform(b.starts, lambda start, u: unit(b, start, u)))


def prompt_size(cues: Column, context: Column) -> Column:
    total = lambda a, extra: F.aggregate(a, F.lit(0).cast("long"), lambda n, s: n + F.octet_length(s) + extra)
    return HEAD + total(context, 0) + total(cues, EACH)


def _room(counts: DataFrame, limit: int, key: str) -> DataFrame:
    """__key, __room of the documents that get some of `limit`, in order of the key, where each takes its __n.

    Quantiles of the keys cut them into blocks; sums by block tell in which one the
    limit is reached, and only the blocks up to it are sorted.
    """
    n = counts.count()
    m = max(1, min(4096, n // 2000))
    cuts = sorted(set(counts.agg(F.percentile_approx(key, [k / m for k in range(1, m)], 40_000)).first()[0] or [])) if m > 1 else []
    block = F.size(F.filter(F.lit(cuts).cast("array<bigint>"), lambda c: c < F.col(key))) if cuts else F.lit(0)
    counts = counts.withColumn("__b", block)
    sums = counts.groupBy("__b").agg(F.sum("__n").alias("__s"))
    bases = sums.select("__b", F.coalesce(F.sum("__s").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base")).filter(F.col("__base") < limit)
    own = Window.partitionBy("__b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    within = counts.join(F.broadcast(bases), "__b")  # a row for each block
    return within.select(F.col(key).alias("__key"), (limit - F.col("__base") - F.coalesce(F.sum("__n").over(own), F.lit(0))).alias("__room")).filter(F.col("__room") > 0)


def limited(df: DataFrame, limit: int, key: str = "doc_id", segments: str = "segments") -> DataFrame:
    """df with each document's segments cut so that `limit` of them, first documents first, are left in all."""
    room = _room(df.select(key, F.size(segments).alias("__n")), limit, key)
    cut = F.slice(segments, F.lit(1), F.least(F.size(segments).cast("long"), F.col("__room")).cast("int"))
    return df.join(room, df[key] == room["__key"]).withColumn(segments, cut).drop("__key", "__room")


def limited_greedy(df: DataFrame, limit: int, batch: int, context: int, budget: int, key: str = "doc_id", segments: str = "segments") -> DataFrame:
    """df with units under a size budget and a global limit, first documents first.

    A unit is charged what it could have held by count, also where the size budget
    then leaves some of that to the next unit, which is charged for it again. The unit
    in which the limit ends holds as many cues as are left of it at most.
    """
    sizes = F.transform(segments, lambda s: F.octet_length(s.text).cast("long"))
    d = df.withColumn("__starts", starts_greedy(sizes, batch, context, budget))
    charge = lambda start: F.least(F.lit(batch), F.size(segments) - start).cast("long")
    d = d.withColumn("__n", F.aggregate("__starts", F.lit(0).cast("long"), lambda n, s: n + charge(s)))
    room = _room(d.select(key, "__n"), limit, key)
    d = d.join(room, d[key] == room["__key"]).withColumn("units", units(F.col(segments), F.col("__starts"), context))
    before = F.transform("__starts", lambda s, u: F.aggregate(F.slice("__starts", F.lit(1), u), F.lit(0).cast("long"), lambda n, x: n + charge(x)))
    paired = F.filter(F.arrays_zip("units", before.alias("before")), lambda p: p.before < F.col("__room"))

    def held(p: Column) -> Column:
        n = F.least(F.size(p.units.ids).cast("long"), F.col("__room") - p.before).cast("int")
        return F.struct(F.slice(p.units.ids, F.lit(1), n).alias("ids"), F.slice(p.units.cues, F.lit(1), n).alias("cues"), p.units.context.alias("context"))

    return d.withColumn("units", F.transform(paired, held)).drop("__starts", "__n", "__key", "__room")
