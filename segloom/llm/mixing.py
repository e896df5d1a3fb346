"""Mixes sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations alone.

Every document gets the key e = -ln(u) / q: u is uniform and hashed from its id,
q its quality weight; the least keys of a source are a weighted sample without
replacement. A source whose budget exceeds its size is taken whole as often as
it fits (complete epochs); the rest of the budget is the prefix of the source in
the order of e, and the document on which it ends is taken in part.

The prefix needs no sort of a whole source. e is cut into steps of 2^(1 / STEPS):
whatever the weights are, no step holds more than a thousandth of a source, as
exponential keys are nowhere denser on that scale. Sums by step tell in which one
the budget ends, and only its rows are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segloom.llm.common import WORD, materialize

STEPS, LAST, FLOOR, SHARE, CAP, WEIGHTS, SEED = 256, (1 << 31) - 1, 0.05, 1.5, 2.0, (3.0, 1.0, 2.0), "mix"


def quality(text: Column) -> Column:
    """Share of letters and white space among the characters, FLOOR at least; FLOOR for empty and null."""
    n = F.char_length(text)
    return F.greatest(F.lit(FLOOR), F.coalesce(F.char_length(F.regexp_replace(text, r"[^\p{L}\s]+", "")) / F.when(n > 0, n), F.lit(0.0)))


def unit(id_: Column, seed: str = SEED) -> Column:
    """A uniform double in (0, 1) from the id: 52 bits of an MD5."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), id_.cast("string")).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size -> with target: the share of all sizes dealt by weight, where no source exceeds cap times its own.

    Sources by code point, null last, have the weights in turn. Resharing the
    excess until none is left ends where each target is min(cap * size, weight *
    level); with sources in the order of cap * size / weight the level follows
    from running sums. There is a row for each source here, never one for each document.
    """
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(turn) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", F.lit(cap) * F.col("source_size"))
    order = [F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    s = s.withColumn("level", (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(onward))
    level = F.max(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))).over(everything)
    return s.withColumn("target", F.coalesce(F.least("cap", F.col("w") * level), F.col("cap"))).select("source", "source_size", "target")


def keyed(rows: DataFrame, seed: str) -> DataFrame:
    """rows(i, t, s, q, ...) with __id, __source, __size, __e and __slice; a null id is keyed by its text."""
    size = F.coalesce(F.regexp_count(F.col("t"), F.lit(WORD)), F.lit(0)).cast("long")
    id_ = F.coalesce(F.col("i").cast("string"), F.concat(F.lit("null"), F.md5(F.coalesce(F.col("t"), F.lit("")).cast("binary"))))
    rows = rows.select("*", F.col("i").cast("long").alias("__id"), F.col("s").alias("__source"), size.alias("__size"), (-F.log(unit(id_, seed)) / F.col("q")).alias("__e")).drop("i", "t", "s", "q")
    return rows.withColumn("__slice", F.floor(F.log2("__e") * STEPS).cast("int"))


def _fields(docs: DataFrame, id_col: str, text_col: str, source_col: str, weight: Column | None) -> list[Column]:
    q = quality(F.col(text_col)) if weight is None else weight
    return [F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(source_col).alias("s"), q.alias("q")]


def plan(rows: DataFrame, **law) -> DataFrame:
    """A row for each source: its size, target, complete epochs, the rest of its budget and the slice in which the rest ends."""
    slices = materialize(rows.groupBy("__source", "__slice").agg(F.sum("__size").alias("n")))
    sizes = slices.groupBy(F.col("__source").alias("source")).agg(F.sum("n").alias("source_size"))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    wanted = targets(sizes, **law).withColumn("epochs", epochs.cast("long")).withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    upto = Window.partitionBy("__source").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    before = slices.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    ends = wanted.alias("p").join(before.alias("s"), F.col("p.source").eqNullSafe(F.col("s.__source")) & (F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("n")), "left")
    return materialize(ends.select(F.col("p.source").alias("__of"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("epochs").alias("__epochs"), F.col("rest").alias("__rest"), F.col("before").alias("__before"), F.coalesce("__slice", F.lit(LAST)).alias("__end")))


def with_taken(rows: DataFrame, made: DataFrame) -> DataFrame:
    """rows with their source's plan and __taken; rows move only where their slice is the one that ends the budget."""
    r = rows.join(made, F.col("__source").eqNullSafe(F.col("__of")))
    whole = r.filter(F.col("__slice") != F.col("__end")).withColumn("__more", F.when(F.col("__slice") < F.col("__end"), F.col("__size")).otherwise(0).cast("long"))
    run = Window.partitionBy("__source").orderBy("__e", "__id", "__size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("__rest") - F.col("__before") - F.coalesce(F.sum("__size").over(run), F.lit(0))
    last = r.filter(F.col("__slice") == F.col("__end")).withColumn("__more", F.greatest(F.lit(0), F.least(F.col("__size"), left)).cast("long"))
    return whole.unionByName(last).withColumn("__taken", (F.col("__size") * F.col("__epochs") + F.col("__more")).cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None, seed: str = SEED, **law) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs.

    taken sums to the source's target, rounded to whole words; a document's is
    its size times the complete epochs, plus all, some or none of it. A null or
    empty text has size 0 and nothing is taken of it; null is a source of its own.
    Repeated rows have the same key and are drawn one after the other. An empty table gives no rows. Other columns are not read.
    """
    rows = materialize(keyed(docs.select(*_fields(docs, id_col, text_col, source_col, weight)), seed))
    out = with_taken(rows, plan(rows, **law))
    return out.select(F.col("__id").alias("doc_id"), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__taken").alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None, seed: str = SEED, **law) -> DataFrame:
    """The rows of docs, with their columns, as often as the mix takes them; a part counts as a whole from its half on."""
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *_fields(docs, id_col, text_col, source_col, weight))
    rows = keyed(packed, seed)
    out = with_taken(rows, plan(rows, **law)).filter("__size > 0")
    return out.select("row", F.explode(F.expr("array_repeat(0, cast(floor((__taken * 2 + __size) / (2 * __size)) as int))"))).select("row.*")


#: The mix in DuckDB: resharing as it is defined, in rounds, and a running sum over whole sources.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         -ln((('0x' || substr(md5('mix:' || doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
           / greatest(0.05, coalesce(length(regexp_replace(text, '[^\p{L}\s]+', '', 'g'))::DOUBLE / nullif(length(text), 0), 0.0)) AS e
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
             ([3.0, 1.0, 2.0])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM s),
k AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, coalesce(least(cap, w * max(CASE WHEN level * w <= cap THEN level END) OVER ()), cap) AS target FROM k),
b AS (SELECT *, round(target)::BIGINT AS budget, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS epochs FROM t),
r AS (SELECT doc_id, size, source_size, target, epochs, budget - epochs * source_size AS rest,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY e, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (size * epochs + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM r
"""
