"""SimHash near-duplicates, found with Golay-code fuzzy hashing.

A fingerprint has 64 bits; two link at ``bits`` or fewer differing ones (2 at
most here). It is cut into segments of 22, 21 and 21 bits. Of three segments with
two errors in all, one has none, and each of the others one at most or this one is
one of two without any: so in the cycle 1-2, 2-3, 3-1 some pair has an exact first
segment and a second one with one error at most, and the fuzzy keys of that second
segment, joined to the exact first one, meet. That gives 3 to 18 keys for each
distinct fingerprint.

Buckets of two are pairs as they stand; buckets up to ``small`` are joined to
themselves and verified. In a larger one pairs would grow with its square; its
fingerprints are instead linked by their neighbours: each is sent to itself and
to the 64 words that differ in one bit. Words that meet there differ in two bits
at most, and all that differ so meet, so a star around the least of each meeting
point keeps every connection, exactly, with 65 rows for each fingerprint.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segloom.llm.common import by_batch, materialize, raw_texts
from segloom.llm.components import components
from segloom.llm.golay import Golay

SMALL, BLOCK = 16, 1 << 15


def majority(hashes: np.ndarray) -> np.ndarray:
    """Counts of set bits in uint64 hashes, as 64 numbers."""
    out = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at : at + BLOCK]
        out += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return out


def fingerprint(text: bytes, shingle: int, hash_: Callable[[bytes, int], int]) -> int:
    """SimHash of the word shingles of a text, repeats included; 0 without words."""
    words = text.lower().split()  # ASCII alone, as bytes do
    if not words:
        return 0
    flat = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    hashes = np.fromiter((hash_(flat[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[len(ends) - n :].tolist(), strict=True)), np.uint64, n)
    return int(np.packbits(majority(hashes) * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (long) for each row; a null text is as an empty one."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        from xxhash import xxh64_intdigest

        fp = np.array([fingerprint(x, shingle, xxh64_intdigest) for x in raw_texts(batch)], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(by_batch(run), "doc_id long, fp long")


def fuzzy_keys(fp: np.ndarray, golay: Golay) -> np.ndarray:
    """(n, 18) keys of int64 fingerprints; -1 where there are fewer."""
    x = fp.view(np.uint64)
    cut = [(x & 0x3FFFFF).astype(np.int64), (x >> np.uint64(22) & 0x1FFFFF).astype(np.int64), (x >> np.uint64(43)).astype(np.int64)]
    out = []
    for a in range(3):
        near = golay.indices(cut[(a + 1) % 3]).astype(np.int64)
        out.append(np.where(near < 0, -1, (a << 34 | cut[a] << 12)[:, None] | near))
    return np.concatenate(out, axis=1)


def keyed(fps: DataFrame) -> DataFrame:
    """key, fp for each distinct fingerprint and key."""
    made: list[Golay] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(Golay())
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        keys = fuzzy_keys(fp, made[0])
        return pa.RecordBatch.from_arrays([pa.array(keys[keys >= 0]), pa.array(np.repeat(fp, (keys >= 0).sum(axis=1)))], ["key", "fp"])

    return fps.select("fp").mapInArrow(by_batch(run), "key long, fp long")


def links(fps: DataFrame, bits: int = 2, small: int = SMALL) -> DataFrame:
    """u, v: edges that connect just the fingerprints that chains of links connect. fps: distinct fp."""
    if not 0 <= bits <= 2:
        raise ValueError("the keys are proven for 2 differing bits at most")
    close = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= bits
    keys = keyed(fps)
    buckets = materialize(keys.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).filter("n > 1"))
    two = buckets.filter("n = 2").select("u", "v").filter(close)
    rest = materialize(keys.join(buckets.filter("n > 2").select("key", "n"), "key"))
    few = rest.filter(F.col("n") <= small)
    some = few.select("key", F.col("fp").alias("u")).join(few.select("key", F.col("fp").alias("v")), "key").filter(F.col("u") < F.col("v")).filter(close).select("u", "v")
    many = rest.filter(F.col("n") > small).select("fp").distinct()
    if bits == 0:  # different fingerprints don't link
        star = many.filter("false").select(F.col("fp").alias("u"), F.col("fp").alias("v"))
    elif bits == 1:  # a word and its neighbours that are there
        beside = many.select(F.col("fp").alias("u"), F.explode(F.expr("transform(sequence(0, 63), b -> fp ^ shiftleft(1L, b))")).alias("v"))
        star = beside.join(many, beside.v == many.fp, "left_semi").filter("u < v")
    else:
        around = many.select("fp", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), b -> fp ^ shiftleft(1L, b)))")).alias("at"))
        meet = around.groupBy("at").agg(F.min("fp").alias("u"), F.count("*").alias("n")).filter("n > 1")
        star = around.join(meet, "at").select("u", F.col("fp").alias("v")).filter("u != v")
    return two.unionByName(some).unionByName(star).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id for each row: the least doc_id that chains of links reach, itself included.

    Null, empty and blank texts have fingerprint 0 and link like any other.
    Repeated rows and copies share a fingerprint and so a component. A null id is
    never the least. An empty table gives no rows; other columns are not read.
    """
    rows = materialize(fingerprints(docs, shingle, id_col, text_col))
    fps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    nodes = components(links(fps, bits))
    reached = fps.join(nodes, fps.fp == nodes.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = reached.groupBy("root").agg(F.min("first").alias("component_id"))
    named = materialize(reached.join(least, "root").select("fp", "component_id"))
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def digest(found: DataFrame) -> DataFrame:
    """The fingerprint as 16 lowercase hex digits."""
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
