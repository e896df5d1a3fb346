"""Removes every byte that a repeated string of LENGTH bytes covers, exactly, with suffix arrays of shards.

1. Anchors. Each stretch of LENGTH bytes contains the least hash of its GRAM-byte
   windows, and both copies of a repeated string have it at the same place. The
   places of least hashes of all stretches are a document's anchors, about one in
   (LENGTH - GRAM) / 2 bytes; an anchor's context is all that a stretch around it
   can reach. A stretch can be repeated only where its anchor's hash is.
2. Anchors that occur twice are candidates. Where two contexts are the same all
   through, they are repeated as they stand. A context that is the only one of its
   kind goes to a shard, with one of each other kind at that anchor.
3. In a shard, stretches that begin at up to CORE neighbouring places share all but
   CORE - 1 bytes; where no other context of the anchor has that core, none of them
   is repeated. What is left of a context, less the stretches that have their least
   hash at another anchor, is sorted.
4. A shard's pieces form one string; induced sorting gives its suffix array and
   permuted common prefixes (suffix_array.py). Suffixes with a common prefix of
   LENGTH bytes or more are neighbours, and those at two places or more in the
   corpus are repeated.

An anchor with more than HOT kinds of context is dealt over shards by content:
stretches that begin at up to SPLIT neighbouring places share all but SPLIT - 1
bytes, and the hash of that core is their shard's key. Runs of one short period
would make every turn an anchor: where a run repeats itself for LENGTH bytes it
is covered by itself, and only its outer two anchors at either end are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segloom.llm.common import by_bytes, materialize, raw_texts
from segloom.llm.suffix_array import permuted_prefixes, suffix_array

LENGTH, GRAM, SEGMENT, SHARD, HOT, SPLIT, CORE, SLICE = 400, 160, 1 << 19, 1 << 20, 1500, 48, 16, 1 << 21
_BASE = 0x9E3779B97F4A7C15


class Powers:
    """Powers of an odd number modulo 2^64 and of its inverse."""

    def __init__(self, n: int) -> None:
        one = np.ones(1, np.uint64)
        self.up = np.concatenate([one, np.multiply.accumulate(np.full(n, _BASE, np.uint64))])
        self.down = np.concatenate([one, np.multiply.accumulate(np.full(n, pow(_BASE, -1, 1 << 64), np.uint64))])

    def grams(self, x: np.ndarray, k: int) -> np.ndarray:
        """A hash of each k bytes of x."""
        n = len(x)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((x.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=total[1:])
        h = (total[k:] - total[:-k]) * self.down[: n - k + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        return h


def _sliding(x: np.ndarray, w: int, f: np.ufunc, pad: int) -> np.ndarray:
    """f over each w neighbours."""
    n = len(x)
    y = np.concatenate([x, np.full(-n % w, pad, np.uint64)]).reshape(-1, w)
    left = f.accumulate(y, axis=1).ravel()
    right = f.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(right[: n - w + 1], left[w - 1 : n])


def anchors(text: bytes, powers: Powers, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Places and hashes of the anchors of a text, and the spans that repeat themselves."""
    w = length - gram + 1
    places, hashes = [], []
    for at in range(0, max(0, len(text) - length + 1), SEGMENT):
        h = powers.grams(np.frombuffer(text, np.uint8, min(SEGMENT + length - 1, len(text) - at), at), gram)
        low = _sliding(h, w, np.minimum, 2**64 - 1)
        edge = np.zeros(w - 1, np.uint64)
        top = _sliding(np.concatenate([edge, low, edge]), w, np.maximum, 0)
        p = np.flatnonzero(top == h)
        places.append(p + at)
        hashes.append(h[p])
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.uint64), []
    place, first = np.unique(np.concatenate(places), return_index=True)
    hash_ = np.concatenate(hashes)[first]
    spans, keep = [], np.ones(len(place), bool)
    if len(place) > 5:
        step = np.diff(place)
        same = np.concatenate([(hash_[1:] == hash_[:-1]), [False]]) & np.concatenate([step < gram, [False]])
        alike = np.concatenate([same[1:] & same[:-1] & np.concatenate([step[1:] == step[:-1], [False]]), [False]])
        cut = np.flatnonzero(np.diff(np.concatenate([[False], alike, [False]]).astype(np.int8)))
        for b, e in zip(cut[::2].tolist(), cut[1::2].tolist(), strict=True):  # anchors b .. e + 1 are one period apart
            e, period = e + 1, int(step[b])
            lo, hi = int(place[b]), int(place[e]) + gram
            if hi - lo >= length + period and text[lo : hi - period] == text[lo + period : hi]:
                spans.append((lo, hi))
                keep[b + 2 : e - 1] = False
    return place[keep], hash_[keep], spans


def _reach(place: np.ndarray, size: int, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the contexts of anchors."""
    return np.maximum(place - (length - gram), 0), np.minimum(place + length, size)


def _anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """doc_id, th, place, anchor, context for each anchor; context -1 and the anchor as an end for a span that repeats itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        powers = Powers(SEGMENT + length)
        for batch in batches:
            for part in by_bytes(batch, SLICE):
                n, out = [], ([], [], [], [])
                for text in raw_texts(part):
                    place, hash_, spans = anchors(text, powers, length, gram)
                    begin, end = _reach(place, len(text), length, gram)
                    seed = [(p - b) for p, b in zip(place.tolist(), begin.tolist(), strict=True)]
                    context = [xxh3_64_intdigest(text[b:e], s) >> 1 for b, e, s in zip(begin.tolist(), end.tolist(), seed, strict=True)]
                    out[0].append(np.concatenate([place, np.array([a for a, _ in spans], np.int64)]))
                    out[1].append(np.concatenate([hash_.view(np.int64), np.array([b for _, b in spans], np.int64)]))
                    out[2].append(np.array(context + [-1] * len(spans), np.int64))
                    n.append(len(place) + len(spans))
                at = pa.array(np.repeat(np.arange(len(n)), n))
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), *(pa.array(np.concatenate(x).astype(t)) for x, t in zip(out[:3], (np.int32, np.int64, np.int64), strict=True))], ["doc_id", "th", "place", "anchor", "context"])

    return docs.select("doc_id", "th", "text").mapInArrow(run, "doc_id long, th long, place int, anchor long, context long")


def open_stretches(contexts: list[bytes], keys: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts' numbers, first and last begins of the stretches that may be those of another context of the same key.

    at: where in its context the anchor begins. Each stretch is left with the anchor
    of its least hash, unless the context has the same `gram` bytes twice.
    """
    size = np.fromiter(map(len, contexts), np.int64, len(contexts))
    flat = np.frombuffer(b"".join(contexts), np.uint8)
    first = np.cumsum(size) - size
    powers = Powers(len(flat))
    # cores: block j has the stretches that begin CORE * j + CORE - 1 .. CORE * j bytes before the anchor
    core = length - CORE + 1
    blocks = -(-(length - gram + 1) // CORE)
    j = np.tile(np.arange(blocks), len(size))
    of = np.repeat(np.arange(len(size)), blocks)
    lo, hi = np.maximum(at[of] - j * CORE - CORE + 1, 0), np.minimum(at[of] - j * CORE, size[of] - length)
    some = lo <= hi
    j, of, lo, hi = j[some], of[some], lo[some], hi[some]
    h = powers.grams(flat, core) if len(flat) >= core else np.empty(0, np.uint64)
    mark = h[first[of] + at[of] - j * CORE]
    key = keys[of].view(np.uint64) * np.uint64(_BASE) + j.astype(np.uint64)
    order = np.lexsort((mark, key))
    same = (key[order][1:] == key[order][:-1]) & (mark[order][1:] == mark[order][:-1])
    twice = np.empty(len(order), bool)
    twice[order] = np.concatenate([same, [False]])[: len(order)] | np.concatenate([[False], same])[: len(order)]
    of, lo, hi = of[twice], lo[twice], hi[twice]
    # the stretches of the contexts that are left whose least hash is the anchor's
    left = np.unique(of)
    least, most = np.zeros(len(size), np.int64), size - length
    h = powers.grams(flat, gram) if len(flat) >= gram else np.empty(0, np.uint64)
    for c in left.tolist():
        x = h[first[c] : first[c] + size[c] - gram + 1]
        y = np.sort(x)
        if (y[1:] != y[:-1]).all():
            smaller = np.flatnonzero(x < x[at[c]])
            k = int(np.searchsorted(smaller, at[c]))
            if k:
                least[c] = smaller[k - 1] + 1
            if k < len(smaller):
                most[c] = min(most[c], smaller[k] - (length - gram) - 1)
    lo, hi = np.maximum(lo, least[of]), np.minimum(hi, most[of])
    some = lo <= hi
    of, lo, hi = of[some], lo[some], hi[some]
    order = np.lexsort((lo, of))
    of, lo, hi = of[order], lo[order], hi[order]
    new = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (lo[1:] > hi[:-1] + 1)])) if len(of) else np.empty(0, np.int64)
    return of[new], lo[new], hi[np.concatenate([new[1:], [len(of)]]) - 1] if len(new) else new


def repeated(contexts: list[bytes], begins: np.ndarray, weights: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """Spans of each context that repeated strings of `length` bytes cover.

    begins: numbers such that a byte's place in the corpus is its context's number plus its place in it;
    weights: how many times a context occurs.
    """
    size = np.fromiter(map(len, contexts), np.int64, len(contexts))
    flat = np.frombuffer(b"\1".join(contexts) + b"\1\0", np.uint8)
    first = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    owner = np.repeat(np.arange(len(contexts)), size + 1)
    sep = np.zeros(len(flat), bool)
    sep[first + size] = True
    used = np.zeros(256, bool)
    used[np.unique(flat[:-1][~sep[:-1]])] = True
    rank = np.cumsum(used).astype(np.uint8) + np.uint8(1)  # text letters from 2, the separator 1, the end mark 0
    letters = rank[flat]  # UTF-8 leaves some values of a byte unused, so ranks fit
    letters[sep], letters[-1] = 1, 0
    sa = suffix_array(letters, int(rank.max()) + 1)
    common = permuted_prefixes(letters, sa)
    cls = np.cumsum(common[sa] < length)
    at = sa.astype(np.int64)
    inside = at < len(owner)
    at, cls = at[inside], cls[inside]
    left = (first + size)[owner[at]] - at
    at, cls = at[left >= length], cls[left >= length]
    own = owner[at]
    spot = begins[own] + (at - first[own])  # the same place can be in more than one context
    order = np.lexsort((spot, cls))
    at, cls, own, spot = at[order], cls[order], own[order], spot[order]
    new = np.concatenate([[True], (cls[1:] != cls[:-1]) | (spot[1:] != spot[:-1])]) if len(at) else np.empty(0, bool)
    _, number = np.unique(cls, return_inverse=True)
    distinct = np.bincount(number, weights=new)
    most = np.zeros(len(distinct), np.int64)
    np.maximum.at(most, number, weights[own])
    hit = ((distinct > 1) | (most > 1))[number] if len(at) else new
    out: list[list[tuple[int, int]]] = [[] for _ in contexts]
    at, own = at[hit], own[hit]
    order = np.argsort(at, kind="stable")
    for o, p in zip(own[order].tolist(), (at[order] - first[own[order]]).tolist(), strict=True):
        if out[o] and p <= out[o][-1][1]:
            out[o][-1] = (out[o][-1][0], p + length)
        else:
            out[o].append((p, p + length))
    return out


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans; those that touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPANS = "array<struct<a:int,b:int>>"
_span_type = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, spans, kept for each row: the merged spans of repeated strings and the SHA-256 of what lies outside.

    A null text is empty. Repeated rows are copies of each other, so texts of
    `length` bytes or more in them are removed whole. Rows of one id and
    different texts are told apart by a hash of the text. An empty table gives no
    rows; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    found = materialize(_anchor_rows(rows, length, gram))
    at = found.filter("context >= 0")
    twice = at.groupBy("anchor").agg(F.count("*").alias("n"), F.min("context").alias("a"), F.max("context").alias("b")).filter("n > 1").select("anchor", (F.col("a") != F.col("b")).alias("mixed"))
    cand = materialize(at.join(twice, "anchor"))
    kinds = materialize(cand.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "place")).alias("one"), F.first("mixed").alias("mixed")))
    again = kinds.filter("n > 1").select("anchor", "context")
    covered = cand.join(again, ["anchor", "context"], "left_semi").select("doc_id", "th", "place", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("anchor"), F.lit(0).cast("long").alias("n"))
    own = found.filter("context < 0").select("doc_id", "th", "place", F.lit(1).alias("kind"), "anchor", F.lit(0).cast("long").alias("n"))
    variants = kinds.filter("mixed").groupBy("anchor").agg(F.count("*").alias("variants"))
    sent = kinds.filter("mixed").join(variants, "anchor").select("one.*", F.when(F.col("variants") > HOT, 3).otherwise(2).alias("kind"), "anchor", "n")
    lists = covered.unionByName(own).unionByName(sent).groupBy("doc_id", "th").agg(F.collect_list(F.struct("place", "kind", "anchor", "n")).alias("at"))

    # one pass over the texts with their lists: what is known is covered, what is not goes to the shards, clean texts are done
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        kind_type = pa.list_(pa.struct([("key", pa.int64()), ("begin", pa.int32()), ("at", pa.int32()), ("n", pa.int64()), ("bytes", pa.binary())]))
        for batch in batches:
            for part in by_bytes(batch, SLICE):
                texts, known, todo, kept = raw_texts(part), [], [], []
                for text, got in zip(texts, part.column(3).to_pylist(), strict=True):
                    spans, pieces = [], []
                    for x in got or ():
                        p = x["place"]
                        b, e = max(p - (length - gram), 0), min(p + length, len(text))
                        if x["kind"] == 1:
                            spans.append((p, x["anchor"]))
                        elif e - b >= length and x["kind"] == 0:
                            spans.append((b, e))
                        elif e - b >= length and x["kind"] == 2:
                            pieces.append((x["anchor"], b, p - b, x["n"], text[b:e]))
                        elif e - b >= length:
                            for j in range(0, length - gram + 1, SPLIT):  # stretches that begin j .. j + SPLIT - 1 bytes before the anchor
                                lo, hi = max(b, p - j - SPLIT + 1), min(p - j, e - length)
                                if lo <= hi:
                                    core = text[p - j : p - j - SPLIT + 1 + length]
                                    pieces.append((xxh3_64_intdigest(core, (x["anchor"] ^ j) & (2**64 - 1)) >> 1, lo, -1, x["n"], text[lo : hi + length]))
                    spans = merge(spans)
                    known.append([{"a": a, "b": b} for a, b in spans])
                    todo.append([{"key": k, "begin": b, "at": a, "n": n, "bytes": t} for k, b, a, n, t in pieces])
                    kept.append(None if pieces else _sha(text, spans))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(map(len, texts), pa.int64()), pa.array(known, _span_type), pa.array(todo, kind_type), pa.array(kept, pa.string()), pa.array([None if k else t for k, t in zip(kept, texts, strict=True)], pa.binary())],
                    ["doc_id", "th", "n_bytes", "known", "todo", "kept", "rest"],
                )

    joined = rows.join(lists, ["doc_id", "th"], "left").select("doc_id", "th", "text", "at")
    state = materialize(joined.mapInArrow(split, f"doc_id long, th long, n_bytes long, known {_SPANS}, todo array<struct<key:long,begin:int,at:int,n:long,bytes:binary>>, kept string, rest binary"))
    # a row and its copies have the same pieces: one set of them will do
    pieces = state.filter("kept is null").select("doc_id", "th", F.explode("todo").alias("t")).select("doc_id", "th", "t.*")
    total = pieces.agg(F.sum(F.octet_length("bytes") + 1)).first()[0] or 0
    shards = max(1, -(-total // SHARD))

    def sort(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        at = rows.column("at").to_numpy()
        whole, cut = np.flatnonzero(at < 0), np.flatnonzero(at >= 0)
        of, lo, hi = open_stretches(rows.column("bytes").take(pa.array(cut)).to_pylist(), rows.column("key").to_numpy()[cut], at[cut].astype(np.int64), length, gram)
        texts = rows.column("bytes").take(pa.array(np.concatenate([cut[of], whole]))).to_pylist()
        texts = [t[a : b + length] for t, a, b in zip(texts, lo.tolist(), hi.tolist())] + texts[len(of) :]  # noqa: B905  whole ones follow
        rows = rows.take(pa.array(np.concatenate([cut[of], whole])))
        begin = rows.column("begin").to_numpy().astype(np.int64) + np.concatenate([lo, np.zeros(len(whole), np.int64)])
        ids = np.column_stack([rows.column("doc_id").to_numpy(), rows.column("th").to_numpy()])
        _, doc = np.unique(ids, axis=0, return_inverse=True)
        spans = repeated(texts, doc.ravel().astype(np.int64) * (1 << 32) + begin, rows.column("n").to_numpy(), length) if texts else []
        n = np.fromiter(map(len, spans), np.int64, len(spans))
        at = np.repeat(np.arange(len(spans)), n)
        ab = np.array([y for x in spans for y in x], np.int64).reshape(-1, 2) + begin[at][:, None]
        take = pa.array(at, pa.int64())
        return pa.table({"doc_id": rows.column("doc_id").take(take), "th": rows.column("th").take(take), "a": pa.array(ab[:, 0].astype(np.int32)), "b": pa.array(ab[:, 1].astype(np.int32))})

    met = pieces.groupBy(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard")).applyInArrow(sort, "doc_id long, th long, a int, b int")
    more = met.groupBy("doc_id", "th").agg(F.collect_list(F.struct("a", "b")).alias("more"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known, kept = [], []
            for text, a, b in zip(raw_texts(batch, "rest"), batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True):
                spans = merge([(x["a"], x["b"]) for x in [*a, *(b or ())]])
                known.append([{"a": a, "b": b} for a, b in spans])
                kept.append(_sha(text, spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(known, _span_type), pa.array(kept, pa.string())], ["doc_id", "n_bytes", "spans", "kept"])

    open_ = state.filter("kept is null").select("doc_id", "th", "n_bytes", "known", "rest").join(more, ["doc_id", "th"], "left").select("doc_id", "th", "n_bytes", "known", "rest", "more")
    out = state.filter("kept is not null").select("doc_id", "n_bytes", F.col("known").alias("spans"), "kept").unionByName(open_.mapInArrow(finish, f"doc_id long, n_bytes long, spans {_SPANS}, kept string"))
    return out.withColumn("doc_id", F.when(F.col("doc_id") > -(2**63), F.col("doc_id")))


def _sha(text: bytes, spans: list[tuple[int, int]]) -> str:
    h, at = hashlib.sha256(), 0
    for a, b in spans:
        h.update(text[at:a])
        at = b
    h.update(text[at:])
    return h.hexdigest()


def digest(found: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.b - s.a)
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.col("kept").alias("kept_sha256"))


#: The contract in DuckDB: every 400-byte window of every text, compared by its hash.
ORACLE = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT r, i, hash(substr(h, (2 * i + 1)::BIGINT, 800)) AS k FROM (SELECT r, h, unnest(range(0, length(h) // 2 - 399)) AS i FROM d)),
q AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS n FROM p) WHERE n > 1),
g AS (SELECT r, i, sum(CASE WHEN b IS NULL OR i > b + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS s FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS b FROM q)),
sp AS (SELECT r, min(i) AS a, max(i) + 400 AS b FROM g GROUP BY r, s),
cut AS (SELECT r, a, b FROM sp UNION ALL SELECT r, length(h) // 2, length(h) // 2 FROM d),
gap AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a, b), 0) AS f, a FROM cut),
kept AS (SELECT gap.r, string_agg(substr(h, (2 * f + 1)::BIGINT, (2 * (a - f))::BIGINT), '' ORDER BY f) AS x FROM gap JOIN d ON d.r = gap.r GROUP BY gap.r),
n AS (SELECT r, sum(b - a) AS removed, count(*) AS spans FROM sp GROUP BY r)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(x)) AS kept_sha256
FROM d JOIN kept ON kept.r = d.r LEFT JOIN n ON n.r = d.r
"""
