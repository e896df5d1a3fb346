"""Benchmark decontamination with suffix arrays of the documents' words.

A shard is the whole documents of up to SHARD bytes. Words that the benchmark block
doesn't have end a match, so the shard is cut there; stretches too short for the
shortest window go, and the others are one string of word numbers with its suffix
array, by induced sorting (suffix_array.py). Every suffix of every benchmark item
is binary-searched in it, word by word to its end. Its neighbours there give its
longest verbatim match. Where it begins a window (WINDOW words of an item, or a
shorter item whole), the range of suffixes that begin with the window gives all its
places; equal windows have one range, so a place is met once for each length of
window and not once for each item.

The places' own longest matches come from the other side, a binary search in the
block's suffix array. A document lies in one shard, so nothing is shuffled. The
benchmark goes to the executors in blocks of about BLOCK bytes, one pass over the
documents for each: its size sets the number of passes and not what is held at once.

Words are compared by a 64-bit hash with their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segloom.llm.common import by_bytes, fresh, materialize, raw_texts
from segloom.llm.suffix_array import of_names

WINDOW, SHARD, BLOCK, WORDS_AT_ONCE, STEP, SEPARATOR = 13, 8 << 20, 8 << 20, 1 << 17, 16, 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)


def word_spans(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of lower-cased bytes."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], _IS_WORD[text], [False]]).view(np.int8)))
    return edge[::2], edge[1::2]


def word_hashes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each word, mixed with its length."""
    out = np.empty(len(starts), np.uint64)
    for at in range(0, len(starts), WORDS_AT_ONCE):
        s, e = starts[at : at + WORDS_AT_ONCE], ends[at : at + WORDS_AT_ONCE]
        n = e - s
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        powers = np.multiply.accumulate(np.full(int(n.max()), _BASE, np.uint64))
        h = np.add.reduceat((text[np.repeat(s, n) + inside].astype(np.uint64) + np.uint64(1)) * powers[inside], np.cumsum(n) - n)
        h ^= n.astype(np.uint64) << np.uint64(48)
        h ^= h >> np.uint64(29)
        out[at : at + WORDS_AT_ONCE] = h * np.uint64(0xBF58476D1CE4E5B9)
    return out


class Words:
    """The words of some texts, one after the other: hash, text and place in it of each."""

    def __init__(self, texts: list[bytes]) -> None:
        flat = _LOWER[np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)]
        self.starts, self.ends = word_spans(flat)
        self.hash = word_hashes(flat, self.starts, self.ends)
        begins = np.cumsum([0, *(len(x) + 1 for x in texts)])
        self.first = np.searchsorted(self.starts, begins)  # of each text, and the end
        self.n = np.diff(self.first)
        self.text = np.repeat(np.arange(len(texts)), self.n)


class Suffixes:
    """A string of numbers above 0, in which SEPARATOR ends a match, and its suffix array."""

    def __init__(self, ids: np.ndarray) -> None:
        self.ids = np.concatenate([ids, [0]])
        self.sa = of_names(self.ids, int(self.ids.max()) + 1)[1:]  # without the end mark

    def compare(self, own: np.ndarray, other: np.ndarray, at: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words that suffixes `own` of this string share with suffixes `at` of `other`, `most` at most, and whether they are less."""
        n, less = np.zeros(len(own), np.int64), np.zeros(len(own), bool)
        open_, k = np.arange(len(own)), 0
        while len(open_):
            cols = np.arange(k, k + STEP)
            a = self.ids[np.minimum(own[open_, None] + cols, len(self.ids) - 1)]
            b = other[np.minimum(at[open_, None] + cols, len(other) - 1)]
            differ = (a != b) | (a <= SEPARATOR) | (cols >= most[open_, None])
            first = differ.argmax(axis=1)
            done = differ[np.arange(len(open_)), first]
            n[open_] = k + np.where(done, first, STEP)
            i = np.flatnonzero(done)
            less[open_[i]] = (a[i, first[i]] < b[i, first[i]]) & (cols[first[i]] < most[open_[i]])
            open_, k = open_[~done], k + STEP
        return n, less

    def insertion(self, other: np.ndarray, at: np.ndarray, most: np.ndarray, after: bool = False) -> np.ndarray:
        """How many suffixes are less than the first `most` words of suffixes `at` of other; after: or begin with them."""
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(self.sa), np.int64)
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            n, less = self.compare(self.sa[mid], other, at[open_], most[open_])
            if after:
                less |= n >= most[open_]
            lo[open_], hi[open_] = np.where(less, mid + 1, lo[open_]), np.where(less, hi[open_], mid)
        return lo

    def longest(self, other: np.ndarray, at: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length of the longest match of suffixes `at` of other with any here, and where one begins."""
        if not len(self.sa):
            return np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        p = self.insertion(other, at, most)
        n, where = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for q in (np.maximum(p - 1, 0), np.minimum(p, len(self.sa) - 1)):
            got, _ = self.compare(self.sa[q], other, at, most)
            better = got > n
            n[better], where[better] = got[better], self.sa[q][better]
        return n, where


class Tests:
    """A block of benchmark items: vocabulary, suffixes and windows."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW) -> None:
        self.window, self.names = window, [x[0] for x in items]
        w = Words([x[1] for x in items])
        self.vocabulary, ids = np.unique(w.hash, return_inverse=True)
        ids = ids.astype(np.int64) + SEPARATOR + 1
        self.least = int(np.minimum(w.n[w.n > 0], window).min()) if len(ids) else 0
        if not len(ids):
            return
        # items one after the other with a separator after each
        place = np.arange(len(ids)) + w.text
        self.ids = np.full(len(ids) + len(items), SEPARATOR, np.int64)
        self.ids[place] = ids
        self.item, self.offset = np.full(len(self.ids), -1), np.zeros(len(self.ids), np.int64)
        self.item[place], self.offset[place] = w.text, np.arange(len(ids)) - np.repeat(w.first[:-1], w.n)
        self.at, self.left = place, np.repeat(w.first[1:], w.n) - np.arange(len(ids))  # the suffixes, and their lengths
        self.suffixes = Suffixes(self.ids)
        # windows, each once: the first of equal neighbours in suffix order
        k = np.minimum(w.n, window)[w.text]
        begins = np.flatnonzero(self.left >= k)
        key = [tuple(ids[b : b + n].tolist()) for b, n in zip(begins.tolist(), k[begins].tolist(), strict=True)]
        number: dict[tuple, int] = {}
        of = np.array([number.setdefault(x, len(number)) for x in key], np.int64)
        _, first = np.unique(of, return_index=True)
        self.win_at, self.win_size = place[begins[first]], k[begins[first]]
        self.win_items = [np.unique(x) for x in np.split(w.text[begins][np.argsort(of, kind="stable")], np.cumsum(np.bincount(of))[:-1])]


def stretches(w: Words, t: Tests) -> tuple[np.ndarray, np.ndarray]:
    """The shard's string of word numbers, and the number of the word at each place of it (-1 for a separator)."""
    k = np.searchsorted(t.vocabulary, w.hash)
    ids = np.where(t.vocabulary[np.minimum(k, len(t.vocabulary) - 1)] == w.hash, k + SEPARATOR + 1, 0)
    edge = np.zeros(len(ids) + 1, bool)
    edge[w.first] = True  # a text's end ends a match as well
    known = ids > 0
    begin = np.flatnonzero(known & (edge[:-1] | ~np.concatenate([[False], known[:-1]])))
    end = np.flatnonzero(known & (edge[1:] | ~np.concatenate([known[1:], [False]]))) + 1
    long = end - begin >= t.least
    begin, n = begin[long], (end - begin)[long]
    out, word = np.full(int(n.sum()) + len(n), SEPARATOR, np.int64), np.full(int(n.sum()) + len(n), -1, np.int64)
    of = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    place = np.arange(len(of)) + of
    word[place] = begin[of] + inside
    out[place] = ids[word[place]]
    return out, word


def search(w: Words, t: Tests) -> tuple[list[list[tuple[int, int, str, int]]], list[list[str]], np.ndarray]:
    """Of each text its longest verbatim matches as (first word, words, item, the item's first word) in order, and its items; of each suffix of the block its longest match in the shard.

    A match is given where it begins, unless it is the rest of one that begins earlier.
    """
    found: list[list[tuple[int, int, str, int]]] = [[] for _ in w.n]
    items: list[list[str]] = [[] for _ in w.n]
    if not t.least or not len(w.hash):
        return found, items, np.zeros(len(t.at) if t.least else 0, np.int64)
    ids, word = stretches(w, t)
    if not len(ids):
        return found, items, np.zeros(len(t.at), np.int64)
    shard = Suffixes(ids)
    longest, _ = shard.longest(t.ids, t.at, t.left)  # every suffix of the block
    lo, hi = shard.insertion(t.ids, t.win_at, t.win_size), shard.insertion(t.ids, t.win_at, t.win_size, after=True)
    n = hi - lo
    place = shard.sa[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    window = np.repeat(np.arange(len(n)), n)
    if not len(place):
        return found, items, longest
    text = w.text[word[place]]
    for x in np.unique(text * len(n) + window).tolist():
        items[x // len(n)].append(t.win_items[x % len(n)])
    names = [sorted({t.names[i] for i in np.unique(np.concatenate(x)).tolist()}) if x else [] for x in items]
    # the longest match at each place: a long window's by search, a short item's own length
    spot, first = np.unique(place, return_inverse=True)
    size, where = np.zeros(len(spot), np.int64), np.zeros(len(spot), np.int64)
    order = np.argsort(t.win_size[window], kind="stable")
    size[first[order]], where[first[order]] = t.win_size[window][order], t.win_at[window][order]
    whole = np.flatnonzero(size == t.window)
    size[whole], where[whole] = t.suffixes.longest(shard.ids, spot[whole], np.full(len(whole), len(t.ids)))
    upto = spot + size
    best = np.maximum.accumulate(np.concatenate([[-1], upto[:-1]]))  # separators keep texts apart
    for i in np.flatnonzero(upto > best).tolist():
        a, x = int(word[spot[i]]), int(where[i])
        found[w.text[a]].append((a - int(w.first[w.text[a]]), int(size[i]), t.names[t.item[x]], int(t.offset[x])))
    return found, names, longest


_MATCH = "array<struct<first:int,words:int,item:string,item_first:int>>"


def with_matches(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, n_words: str = "__n_words", found: str = "__matches", items: str = "__items") -> DataFrame:
    """docs with the number of words, the longest verbatim matches with the benchmark and all items with occurring windows as three more columns.

    Benchmark rows without a text or an id are no items.
    """
    spark = docs.sparkSession
    bench = bench.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).cast("binary").alias("text")).filter("text is not null and item is not null").distinct()
    total = bench.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-total // (BLOCK // 2)))
    schema = T.StructType([*docs.schema.fields, T.StructField(n_words, T.LongType()), T.StructField(found, T._parse_datatype_string(_MATCH)), T.StructField(items, T.ArrayType(T.StringType()))])
    text_at, width = docs.columns.index(text_col), len(docs.columns)
    kind = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32()), ("item", pa.string()), ("item_first", pa.int32())]))
    out, done = docs, None
    for b in range(blocks):
        rows = [(r[0], bytes(r[1])) for r in bench.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()]  # about half of BLOCK
        block = spark.sparkContext.broadcast(sorted(rows))

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            tests = None
            for batch in batches:
                tests = tests or Tests(block.value, window)
                for part in by_bytes(batch, SHARD, text_col):
                    w = Words([x or b"" for x in part.column(text_at).cast(pa.binary()).to_pylist()])
                    got, names, _ = search(w, tests)
                    got = [[{"first": a, "words": n, "item": i, "item_first": o} for a, n, i, o in x] for x in got]
                    if part.num_columns > width:
                        got = [(x or []) + y for x, y in zip(part.column(width + 1).to_pylist(), got, strict=True)]
                        names = [sorted({*(x or []), *y}) for x, y in zip(part.column(width + 2).to_pylist(), names, strict=True)]
                    yield pa.RecordBatch.from_arrays([*part.columns[:width], pa.array(w.n.astype(np.int64)), pa.array(got, kind), pa.array(names, pa.list_(pa.string()))], schema.names)

        out = out.mapInArrow(run, schema)
        if b < blocks - 1:  # or all blocks' workers would live at once
            out = done = materialize(out, done)
            block.unpersist()
    return out


def covered(found: str = "__matches"):
    """Words inside matches: the length of the union of their spans."""
    return F.expr(f"""aggregate(array_sort(transform({found}, m -> struct(m.first as a, m.first + m.words as b))), struct(0L as n, 0 as upto),
        (s, m) -> struct(s.n + greatest(0, m.b - greatest(m.a, s.upto)) as n, greatest(s.upto, m.b) as upto), s -> s.n)""")


def report(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 20, **at) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and longest (words of the longest match) for each row.

    A null or empty text has no words and no hits; an empty benchmark hits
    nothing; items without a text or an id are none. Items of one id and different
    texts count once. Repeated rows get the same answer, an empty table none; other
    columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = with_matches(rows, bench, **at).drop("text")
    return rows.select("doc_id", F.col("__n_words").alias("n_words"), covered().alias("n_hit"), F.array_sort("__items").alias("items"), F.coalesce(F.array_max("__matches.words"), F.lit(0)).cast("long").alias("longest")).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "longest"
    )


def decontaminate(docs: DataFrame, bench: DataFrame, text_col: str = "text", share: int | None = None, **at) -> DataFrame:
    """The rows of docs, with all their columns, in which no window of the benchmark occurs; with a share, those of whose words less than one in `share` are hit."""
    n, found, items = fresh(docs, "__n_words"), fresh(docs, "__matches"), fresh(docs, "__items")
    rows = with_matches(docs, bench, text_col, n_words=n, found=found, items=items, **at)
    hit = covered(found)
    keep = hit == 0 if share is None else ~((hit > 0) & (share * hit >= F.col(n)))
    return rows.filter(keep).drop(n, found, items)


#: The contract in DuckDB: every window of every text, joined by its words. `longest` extends each place along both texts.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
t AS (SELECT item_id, w, least(13, len(w))::INT AS k, unnest(range(1, len(w) - least(13, len(w)) + 2))::INT AS j FROM b WHERE len(w) > 0),
win AS (SELECT item_id, j, k, list_aggregate(w[j:j + k - 1], 'string_agg', ' ') AS x FROM t),
pos AS (SELECT doc_id, len(w) AS n, w, k, unnest(range(1, len(w) - k + 2))::INT AS i FROM d, (SELECT DISTINCT k FROM t) WHERE len(w) >= k),
spot AS (SELECT doc_id, i, k, list_aggregate(w[i:i + k - 1], 'string_agg', ' ') AS x FROM pos),
hit AS (SELECT doc_id, item_id, i, j, k FROM spot JOIN win USING (k, x)),
cov AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS q FROM hit) GROUP BY 1),
run AS (SELECT doc_id, item_id, k, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS g, i - j AS o FROM (SELECT DISTINCT * FROM hit)),
far AS (SELECT doc_id, max(n) AS longest FROM (SELECT doc_id, count(*) + max(k) - 1 AS n FROM run GROUP BY doc_id, item_id, o, g) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(longest, 0)::BIGINT AS longest
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN far USING (doc_id)
"""
