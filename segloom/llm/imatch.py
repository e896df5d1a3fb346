"""I-Match fingerprints over randomised lexicons, in DataFrame operations alone.

The lexicon holds the terms whose document frequency lies in a band of shares of
all documents, so its inverse document frequency does too. A text's distinct
lexicon terms are sorted and hashed once for each of several random subsets of
the lexicon: some bits of a term's own hash say whether it belongs to a subset.
Subsets keep a 32nd, a 128th or a 512th of the terms: each part then depends on a
few terms of a text and outlasts the change of others, and some suit a text of any
length. A subset with no term of the text leaves its part empty. A text all of whose
parts would be empty, as it has few lexicon terms or none, is hashed over all its
distinct terms instead, in a part of its own.

The lexicon's size has a bound: frequencies add up to the distinct terms of all
documents, so at most (mean distinct terms) / LOW terms reach LOW. Terms that are in
no subset are left out, and the others are a table of terms and their subsets,
which texts' exploded terms meet in a join, broadcast if its rows are few enough.
Only terms of a subset are shuffled; a row's parts come together under a hash of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segloom.llm.common import materialize

LOW, HIGH, RATE_BITS, EACH, BROADCAST = 0.002, 0.1, (5, 7, 9), 8, 1_000_000
PER_BUCKET, MOST_BUCKETS, STRIDE = 2000, 4096, 64


def term_hashes(text: Column) -> Column:
    """Sorted distinct 64-bit hashes of the lower-cased words."""
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.array_sort(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))))


def lexicon(docs: DataFrame, text_col: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """t: hashes of the terms that low to high of all documents hold."""
    n = docs.count()
    terms = docs.select(F.explode(term_hashes(F.col(text_col))).alias("t"))
    return terms.groupBy("t").count().filter((F.col("count") >= max(2.0, low * n)) & (F.col("count") <= high * n)).select("t")


def subsets(known: DataFrame, rate_bits: tuple[int, ...] = RATE_BITS, each: int = EACH) -> DataFrame:
    """t, of: the numbers of the subsets that each term of the lexicon belongs to; terms of none are left out."""
    cells = [f"if((shiftrightunsigned(t, {(7 * j + 2 * i) % (64 - bits)}) & {(1 << bits) - 1}) = 0, {i * each + j}, null)" for i, bits in enumerate(rate_bits) for j in range(each)]
    return known.select("t", F.expr(f"array_compact(array({', '.join(cells)}))").alias("of")).filter("size(of) > 0")


def with_parts(df: DataFrame, terms_of: dict[str, Column], known: DataFrame, rate_bits: tuple[int, ...] = RATE_BITS, each: int = EACH) -> DataFrame:
    """df's rows with the parts, an array of strings, of each of the sets of terms under its name; df(k, ...): k tells rows apart, but repeats of a row may share it."""
    lex = subsets(known, rate_bits, each)
    lex = F.broadcast(lex) if known.count() <= BROADCAST else lex
    names = list(terms_of)
    terms = [f"__terms{i}" for i in range(len(names))]
    own = df.withColumns({t: terms_of[n] for t, n in zip(terms, names, strict=True)})
    # what a row has besides terms goes with one entry of it
    row = F.struct(*[c for c in df.columns if dict(df.dtypes)[c] != "array<bigint>"], *[F.when(F.size(t) > 0, F.substring(F.md5(F.array_join(t, ",").cast("binary")), 1, 8)).otherwise("").alias(f"{t}_all") for t in terms])
    mark = F.array(F.struct(F.lit(-1).alias("i"), F.lit(None).cast("long").alias("t"), row.alias("row")))
    none = F.lit(None).cast(own.select(row).schema[0].dataType)

    def entry(i: int):
        return lambda x: F.struct(F.lit(i).alias("i"), x.alias("t"), none.alias("row"))

    entries = F.concat(mark, *[F.transform(t, entry(i)) for i, t in enumerate(terms)])
    rows = own.select("k", F.explode(entries).alias("e")).select("k", "e.i", "e.t", "e.row").join(lex, "t", "left").filter("i < 0 or of is not null")
    met = rows.groupBy("k").agg(F.first("row", True).alias("row"), F.count_if(F.col("i") < 0).alias("copies"), F.collect_set(F.when(F.col("i") >= 0, F.struct("i", "t", "of"))).alias("got"))
    met = met.withColumn("got", F.array_sort("got"))

    def parts(i: int) -> str:
        chosen = f"transform(sequence(0, {len(rate_bits) * each - 1}), j -> transform(filter(got, x -> x.i = {i} and array_contains(x.of, j)), x -> x.t))"
        return f"transform({chosen}, c -> if(size(c) = 0, '', substr(md5(cast(array_join(c, ',') as binary)), 1, 8)))"

    out = met.select("row", F.explode(F.expr("array_repeat(0, cast(copies as int))")), *[F.expr(parts(i)).alias(f"__parts{i}") for i in range(len(names))])
    whole = lambda i: f"concat(__parts{i}, array(if(array_join(__parts{i}, '') = '', row.{terms[i]}_all, '')))"
    return out.select(*[F.col(f"row.{c}").alias(c) for c in df.columns if dict(df.dtypes)[c] != "array<bigint>"], *[F.expr(whole(i)).alias(n) for i, n in enumerate(names)])


def likeness(a: str, b: str) -> Column:
    """Share of equal parts among those that a or b has; 1 for two that have none."""
    return F.expr(f"""if(array_join({a}, '.') = array_join({b}, '.'), 1.0D,
        size(filter(zip_with({a}, {b}, (x, y) -> x = y AND x != ''), e -> e)) / cast(greatest(1, size(filter(zip_with({a}, {b}, (x, y) -> x != '' OR y != ''), e -> e))) as double))""")


def with_next(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows(doc_id, h, ...) with next_<c> of the row that follows by descending (doc_id, h), the first after the last; null ids come last.

    Quantiles of the ids cut them into buckets of about PER_BUCKET rows, each in
    order by itself; the last row of a bucket gets the head of the one below,
    and there is one head for each of MOST_BUCKETS buckets at most.
    """
    n, nulls = rows.agg(F.count("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    m = max(1, min(MOST_BUCKETS, n // PER_BUCKET))
    cuts = rows.agg(F.percentile_approx("doc_id", [k / m for k in range(1, m)], 4 * MOST_BUCKETS)).first()[0] if m > 1 else []
    cuts = sorted(set(cuts or []))
    array = lambda xs: f"cast(array({','.join(f'{x}L' for x in xs)}) as array<bigint>)"
    coarse = f"size(filter({array(cuts[STRIDE - 1 :: STRIDE])}, b -> b < doc_id))"
    rows = rows.withColumn("coarse", F.expr(coarse)).withColumn("cut", F.expr(f"coarse * {STRIDE} + size(filter(slice({array(cuts)}, coarse * {STRIDE} + 1, {STRIDE}), b -> b < doc_id))")).drop("coarse")
    # beyond MOST_BUCKETS quantiles, equal pieces between two of them; null ids go by their hash
    pieces, null_pieces = 1 + n // (MOST_BUCKETS * PER_BUCKET), 1 + nulls // PER_BUCKET
    ends = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    edges = array([(ends[0] or 0) - 1, *cuts, ends[1] or 0])
    inside = f"least({pieces - 1}, cast(floor((cast(doc_id as double) - element_at({edges}, cut + 1) - 1) / greatest(1, element_at({edges}, cut + 2) - element_at({edges}, cut + 1)) * {pieces}) as int))" if pieces > 1 else "0"
    rows = rows.withColumn("bucket", F.expr(f"if(doc_id is null, cast(floor((h / 18446744073709551616D + 0.5D) * {null_pieces}) as int) - {null_pieces}, cut * {pieces} + {inside})")).drop("cut")
    order = [F.col("doc_id").desc_nulls_last(), F.col("h").desc()]
    tops = rows.groupBy("bucket").agg(F.max(F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), "h")).alias("top"))
    below = F.lag("top").over(Window.orderBy("bucket"))  # a row for each bucket
    last = F.max_by("top", "bucket").over(Window.partitionBy())
    tops = tops.select("bucket", F.coalesce(below, last).alias("top"))
    heads = rows.withColumn("id", F.coalesce("doc_id", F.lit(-(2**63)))).join(F.broadcast(tops.select(F.col("top.id").alias("id"), F.col("top.h").alias("h"), F.col("bucket").alias("above"))), ["id", "h"])
    heads = materialize(heads.dropDuplicates(["above"]).select(F.col("above").alias("bucket"), *(F.col(c).alias(f"head_{c}") for c in columns)))
    w = Window.partitionBy("bucket").orderBy(*order)
    rows = rows.select("*", *(F.lead(c).over(w).alias(f"lead_{c}") for c in columns), F.lead(F.lit(True)).over(w).alias("has_next")).join(heads, "bucket", "left")
    return rows.select(*[c for c in rows.columns if not c.startswith(("lead_", "head_")) and c not in ("bucket", "has_next")], *(F.when(F.col("has_next"), F.col(f"lead_{c}")).otherwise(F.col(f"head_{c}")).alias(f"next_{c}") for c in columns))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """doc_id, n_chars, edited_sha256, parts, edited_parts, next_parts for each row of docs.

    A null text is as an empty one: no terms, all parts empty. Repeated rows
    follow each other; a table of one row follows itself; an empty one gives
    none. Equal texts have equal parts. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    known = materialize(lexicon(docs.select(text.alias("text")), "text", low, high))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("h", F.xxhash64("text"))
    rows = with_next(rows, ["text", "h"])
    half = F.floor(F.char_length("text") / 2).cast("int")
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.char_length("text") - half), F.substring(F.col("next_text"), F.lit(1), half)))
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256)).withColumn("k", F.xxhash64("doc_id", "h", "next_h"))
    # texts themselves stay behind: parts come from their terms
    both = materialize(_parts_of(rows, known))
    named = both.select(F.col("h").alias("next_h"), F.col("parts").alias("next_parts")).dropDuplicates(["next_h"])
    return both.join(named, "next_h")


def _parts_of(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows(k, doc_id, h, next_h, n_chars, edited_sha256, text, edited) with parts and edited_parts in place of the texts."""
    kept = rows.select("k", "doc_id", "h", "next_h", "n_chars", "edited_sha256", term_hashes(F.col("text")).alias("a"), term_hashes(F.col("edited")).alias("b"))
    return with_parts(kept, {"parts": F.col("a"), "edited_parts": F.col("b")}, known)


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_chars", "edited_sha256", F.array_join("parts", ".").alias("fingerprint"), F.array_join("edited_parts", ".").alias("edited_fingerprint"),
        likeness("parts", "edited_parts").alias("near_edited"), likeness("parts", "next_parts").alias("near_next"),
    )
