"""From files to bilingual files: parse, look up, translate what is missing, keep it, render."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segloom.operators import cache, render, segments, translate, units
from segloom.sources import formats

def produce(
    docs: DataFrame, format_: str, table: DataFrame, make: Callable[[], Callable[[str], str]], model: str, target: str, save: Callable[[DataFrame], DataFrame],
    mode: str = "bilingual", batch: int = units.BATCH, context: int = units.CONTEXT, key: str = "doc_id",
) -> DataFrame:
    """key, output, n_segments, n_hits, n_translated of docs(key, source).

    Segments that the translation table has never reach the translator; the others
    of a file go out in units of `batch`. Their answers can differ between runs, so
    save() writes them, key and value, and gives back what it has written; outputs
    are rendered from that. A segment without an answer stays as it is.
    """
    d = formats.parse(docs, format_).withColumn("segments", segments.of_blocks(F.col("blocks")))
    asked = cache.keyed(segments.explode_segments(d, [key]), F.lit(model), F.lit(target))
    known = cache.hits(asked, table)
    missed = cache.misses(asked, table).groupBy(F.col(key).alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("seg_id", "text"))).alias("segments"))
    made = units.units(F.col("segments"), units.starts_fixed(F.size("segments"), batch), context)
    todo = missed.select("doc_id", F.explode(made).alias("u")).select("doc_id", "u.ids", "u.cues", "u.context")
    new = translate.translate_units(todo, make, target).withColumnRenamed("text", "value")
    rows = asked.join(new, (asked[key] == new.doc_id) & (asked.seg_id == new.seg_id)).select(asked[key].alias("of"), asked.seg_id, asked.key, "value")
    kept = save(rows)
    every = known.select(F.col(key).alias("of"), "seg_id", F.col("value").alias("text"), F.lit(0).alias("fresh")).unionByName(kept.select("of", "seg_id", F.col("value").alias("text"), F.lit(1).alias("fresh")))
    counts = every.groupBy("of").agg(F.count_if(F.col("fresh") == 0).alias("n_hits"), F.count_if(F.col("fresh") == 1).alias("n_translated"))
    out = render.by_number(d, every.select(F.col("of").alias(key), "seg_id", "text"), key)
    out = out.select(key, render.render(format_, F.col("blocks"), F.col("tr"), mode).alias("output"), F.size("segments").cast("long").alias("n_segments"))
    return out.join(counts.withColumnRenamed("of", key), key, "left").select(key, "output", "n_segments", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_hits", "n_translated")])
