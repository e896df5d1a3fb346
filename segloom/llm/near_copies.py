"""Near copies: SimHash candidates by Golay keys, verified exactly by five-word shingles.

Nodes are the distinct texts, sets of the hashes of their distinct SHINGLE-word
shingles. Texts of which more than 1 - similarity are shingles that no other text
has can resemble none and are out, in two rounds, the second among the texts that
are left; this is exact, and counts travel by ranges of the hash, so that a
shingle that many texts have is one number a range and text.

The others get FPS fingerprints, SimHashes of the shingles that some other text
has too: near copies agree in most of these, whatever was edited. Each
fingerprint's three segments are decoded to fuzzy Golay indices; pairs of segments
make keys. A node is filed under the nearest index of each pair and asks under all
of them, so that near copies with some errors in each segment meet.

Links are found for connection alone. The files of a bucket are first compared with
that of the largest shared part, the hub, mostly the text that the others were made
of. Who asks then meets a bucket of up to SMALL files only if one of them is in
another component and by its size can be alike; of the hubs that are met, the best
one is compared first. What is then not in one component is compared, under keys of up to SMALL files
as pairs and in larger buckets in blocks of about BLOCK nodes, so that no candidate
is left out but those that are connected already. Every link has the wanted similarity by
the whole sets of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segloom.llm.common import by_batch, by_bytes, fresh, materialize, raw_texts
from segloom.llm.components import components
from segloom.llm.golay import Golay
from segloom.llm.simhash import majority

SHINGLE, SIMILARITY, FPS, SMALL, BLOCK, SLICE, RANGE, SLICED, COLUMNS, BROADCAST = 5, 0.8, 4, 16, 256, 1 << 21, 1 << 21, 1 << 13, 1 << 14, 1_000_000
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)


def hashes(text: bytes, shingle: int) -> np.ndarray:
    """Sorted hashes of a text's distinct word shingles; a text of fewer words, or none, is one shingle."""
    from xxhash import xxh3_64_intdigest

    words = text.lower().split()
    if len(words) <= shingle:
        return np.array([xxh3_64_intdigest(b" ".join(words))], np.uint64)
    flat, n = b" ".join(words), len(words) - shingle + 1
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.unique(np.fromiter((xxh3_64_intdigest(flat[a:b]) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64, n))


def shared(texts: DataFrame, ranges: int, slices: int, whole: bool, shingle: int) -> DataFrame:
    """th, m (shingles), own (those that no other of the texts has) and, if whole, held (the others) of texts(th, text), which are distinct.

    A range's hashes are compared by 32 bits unless whole: a text's own shingle
    can be taken for a shared one by chance, never the other way round. What a
    range tells of its texts comes together by slices of them, a row for each of both.
    """
    kind = np.dtype(np.uint64 if whole else np.uint32)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, SLICE):
                sets = [hashes(x, shingle) for x in raw_texts(part)]
                th, size = part.column(0).to_numpy(zero_copy_only=False), np.fromiter(map(len, sets), np.int64, len(sets))
                flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
                at = ((flat >> np.uint64(32)) % np.uint64(ranges)).astype(np.int64)
                order = np.argsort(at, kind="stable")
                flat, owner, at = flat[order].astype(kind), owner[order], at[order]
                run = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])]))  # of one text in one range
                n, cut = np.diff(np.concatenate([run, [len(at)]])), np.flatnonzero(np.concatenate([[True], at[run][1:] != at[run][:-1]]))
                stop = np.concatenate([cut[1:], [len(run)]])
                ends = np.concatenate([run, [len(at)]])[stop]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(at[run[cut]]), pa.ListArray.from_arrays(pa.array(np.concatenate([cut, [len(run)]]).astype(np.int32)), pa.array(th[owner[run]])),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([cut, [len(run)]]).astype(np.int32)), pa.array(n.astype(np.int32))), pa.array([flat[a:b].tobytes() for a, b in zip(run[cut].tolist(), ends.tolist(), strict=True)], pa.binary()),
                    ],
                    ["at", "ths", "ns", "hashes"],
                )

    def count(table: pa.Table) -> pa.Table:
        ths, n = (table.column(c).combine_chunks().flatten().to_numpy() for c in ("ths", "ns"))
        flat = np.frombuffer(b"".join(table.column("hashes").to_pylist()), kind)
        order = np.argsort(flat, kind="stable").astype(np.int32)
        x = flat[order]
        same = np.concatenate([[False], x[1:] == x[:-1], [False]])
        del x
        alone = np.empty(len(flat), bool)
        alone[order] = ~(same[1:] | same[:-1])
        del order, same
        own = np.add.reduceat(alone, np.cumsum(n) - n, dtype=np.int64)
        order = np.argsort(ths % slices, kind="stable")
        at, n, own = (ths % slices)[order], n[order], own[order]
        cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        stops = pa.array(np.concatenate([cut, [len(at)]]).astype(np.int32))
        lists = lambda x: pa.ListArray.from_arrays(stops, pa.array(x))
        out = {"at": pa.array(at[cut]), "ths": lists(ths[order]), "ns": lists(n.astype(np.int64)), "own": lists(own)}
        if whole:
            flat, size = flat[~alone].view(np.int64), n - own
            ends, before = np.cumsum(size), _undo(size, order)
            begin = (np.cumsum(before) - before)[order]
            take = np.repeat(begin - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
            out["held"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends])[np.concatenate([cut, [len(at)]])].astype(np.int32)), pa.array(flat[take]))
        return pa.table(out)

    def gather(table: pa.Table) -> pa.Table:
        ths, n, own = (table.column(c).combine_chunks().flatten().to_numpy() for c in ("ths", "ns", "own"))
        order = np.argsort(ths, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(ths[order]) != 0]))
        out = {"th": pa.array(ths[order][first]), "m": pa.array(np.add.reduceat(n[order], first)), "own": pa.array(np.add.reduceat(own[order], first))}
        if whole:
            size = n - own
            begin, held = (np.cumsum(size) - size)[order], table.column("held").combine_chunks().flatten().to_numpy()
            size, ends = size[order], np.cumsum(size[order])
            take = np.repeat(begin - ends + size, size) + np.arange(ends[-1])
            out["held"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.add.reduceat(size, first))]).astype(np.int32)), pa.array(held[take]))
        return pa.table(out)

    more = ", held array<long>" if whole else ""
    parts = texts.select("th", "text").mapInArrow(deal, "at long, ths array<long>, ns array<int>, hashes binary").groupBy("at").applyInArrow(count, f"at long, ths array<long>, ns array<long>, own array<long>{more}")
    return parts.groupBy("at").applyInArrow(gather, f"th long, m long, own long{more}")


def _undo(x: np.ndarray, order: np.ndarray) -> np.ndarray:
    """x as it was before x = x[order]."""
    out = np.empty_like(x)
    out[order] = x
    return out


def fingerprints(held: list[np.ndarray]) -> np.ndarray:
    """(texts, FPS) SimHashes of int64 hashes."""
    out = np.empty((len(held), FPS), np.uint64)
    for i, h in enumerate(held):
        for j in range(FPS):
            x = h.view(np.uint64) * np.uint64(_MIX[j])
            x ^= x >> np.uint64(31)
            out[i, j] = np.packbits(majority(x * np.uint64(_MIX[0])) * 2 > len(x), bitorder="little").view("<u8")[0]
    return out


def _keyed(nodes: DataFrame, filed: bool, columns: tuple[str, ...] = ("th", "m", "s")) -> DataFrame:
    """key and the columns, numbers: the keys under which nodes(th, m, s, held) are filed (3 for each fingerprint), or ask (108 at most)."""
    made: list[Golay] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(Golay())
        held = batch.column(len(columns))
        flat, ends = held.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(held.value_lengths().to_numpy(zero_copy_only=False))])
        fps = fingerprints([flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)])
        keys = []
        for f in range(FPS):
            x = fps[:, f]
            cut = [made[0].indices((x >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64)).astype(np.int64)[:, : 1 if filed else 6] for at, n in ((0, 22), (22, 21), (43, 21))]
            for a in range(3):
                i, j = cut[a][:, :, None], cut[(a + 1) % 3][:, None, :]
                keys.append(np.where((i < 0) | (j < 0), -1, (f * 3 + a) << 24 | i << 12 | j).reshape(len(x), -1))
        keys = np.concatenate(keys, axis=1)
        at = pa.array(np.repeat(np.arange(len(fps)), (keys >= 0).sum(axis=1)))
        return pa.RecordBatch.from_arrays([pa.array(keys[keys >= 0].astype(np.int32)), *(batch.column(k).take(at) for k in range(len(columns)))], ["key", *columns])

    return nodes.select(*columns, "held").mapInArrow(by_batch(run), ", ".join(["key int", *(f"{c} long" for c in columns)]))


def linked(a: list[np.ndarray], b: list[np.ndarray], m: np.ndarray, m2: np.ndarray, similarity: float) -> np.ndarray:
    """(len(a), len(b)) whether sets of m and m2 hashes, of which a and b are those to be shared, have the similarity."""
    common = np.intersect1d(np.concatenate(a), np.concatenate(b))
    both = np.zeros((len(a), len(b)), np.float32)
    for at in range(0, len(common), COLUMNS):  # a bounded piece of the two tables of sets at a time
        part = common[at : at + COLUMNS]
        x, y = (np.array([np.isin(part, h, assume_unique=True) for h in side], np.float32) for side in (a, b))
        both += x @ y.T
    return both >= similarity * (m[:, None] + m2[None, :] - both) - 1e-6


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if its rows are few enough for that."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


def _rest(met: DataFrame, roots: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """u, v: links that connect members(key, th, filed, n, hub) of one bucket that have different roots, in blocks.

    Those apart from the hub's component meet that component's members and each other.
    """
    r = small(materialize(roots.select(F.col("node").alias("th"), "root")))
    named = met.join(r, "th", "left").withColumn("root", F.coalesce("root", "th"))
    hub_root = r.select(F.col("th").alias("hub"), F.col("root").alias("hub_root"))
    named = named.join(hub_root, "hub", "left").withColumn("apart", F.col("root") != F.coalesce("hub_root", "hub"))
    sides = materialize(named.select("key", "th", "filed", "root", "apart"))
    sizes = sides.groupBy("key").agg(F.ceil(F.count_if("apart") / BLOCK).cast("int").alias("others"), F.ceil(F.count_if(~F.col("apart")) / BLOCK).cast("int").alias("near")).filter("others > 0")
    dealt = sides.join(small(sizes), "key").withColumn("b", F.expr("cast(pmod(xxhash64(th), if(apart, others, greatest(near, 1))) as int)"))
    # block pairs: (0, other, near one) and (1, lesser other, greater other)
    meets = F.expr("""if(apart, concat(if(near > 0, transform(sequence(0, near - 1), j -> struct(0 as kind, b as x, j as y)), array()),
        transform(sequence(0, others - 1), j -> struct(1 as kind, least(b, j) as x, greatest(b, j) as y))), transform(sequence(0, others - 1), j -> struct(0 as kind, j as x, b as y)))""")
    rows = dealt.select("key", "th", "filed", "root", "apart", "b", F.explode(meets).alias("p")).select("key", "p.*", "th", "filed", "root", "apart", "b")
    rows = rows.join(nodes.select("th", "m", "held"), "th")

    def compare(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        th, root, m, b = (t.column(c).to_numpy() for c in ("th", "root", "m", "b"))
        filed, apart = t.column("filed").to_numpy(), t.column("apart").to_numpy()
        held = [np.asarray(x, np.int64) for x in t.column("held").to_pylist()]
        first = apart if t.column("kind")[0].as_py() == 0 else b == t.column("x")[0].as_py()
        second = ~apart if t.column("kind")[0].as_py() == 0 else b == t.column("y")[0].as_py()
        i, j = np.flatnonzero(first), np.flatnonzero(second)
        out, up = [], {x: x for x in np.unique(root).tolist()}
        if len(i) and len(j):
            ok = linked([held[k] for k in i], [held[k] for k in j], m[i], m[j], similarity) & (filed[i][:, None] | filed[j][None, :]) & (root[i][:, None] != root[j][None, :])

            def top(x: int) -> int:
                while up[x] != x:
                    x = up[x]
                return x

            for p, q in np.argwhere(ok).tolist():  # what connects components, once
                x, y = top(int(root[i[p]])), top(int(root[j[q]]))
                if x != y:
                    up[x] = y
                    out.append((int(th[i[p]]), int(th[j[q]])))
        return pa.table({"u": pa.array([x for x, _ in out], pa.int64()), "v": pa.array([y for _, y in out], pa.int64())})

    return rows.groupBy("key", "kind", "x", "y").applyInArrow(compare, "u long, v long")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, th, component_id for each row: the least doc_id of the texts that chains of links reach.

    Null, empty and blank texts are the same shingle and alike; a text of fewer
    words than a shingle has is one. Repeated rows and copies are one node; a null
    id is never the least. An empty table gives no rows; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    rows = materialize(named.select("doc_id", "th", F.octet_length("text").alias("bytes")))
    nodes = materialize(rows.groupBy("th").agg(F.min("doc_id").alias("first"), F.max("bytes").alias("bytes")))
    repeated = rows.groupBy("doc_id", "th").count().filter("count > 1").limit(1).count() > 0

    def texts_of(some: DataFrame) -> DataFrame:
        """th, text once for each of the nodes(th, first)."""
        s = small(some.select(F.col("th").alias("t"), "first"))
        out = named.join(s, (F.col("th") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("first")), "left_semi").select("th", "text")
        return out.dropDuplicates(["th"]) if repeated else out

    def dealt(some: DataFrame) -> tuple[int, int]:
        """Ranges of about RANGE hashes, slices of SLICED texts."""
        total, n = some.agg(F.sum("bytes"), F.count("*")).first()
        return 1 + (total or 0) // (6 * RANGE), 1 + n // SLICED  # six bytes a word

    might = F.col("own") <= (1 - similarity) * F.col("m") + 1e-9
    first = shared(texts_of(nodes), *dealt(nodes), False, shingle).filter(might).select("th")
    left = materialize(nodes.join(first, "th"))
    sets = materialize(shared(texts_of(left), *dealt(left), True, shingle).filter(might).select("th", "m", (F.col("m") - F.col("own")).alias("s"), "held"))

    def able(m: str, s: str, m2: str, s2: str) -> Column:
        """More than either's shared part can't be in both."""
        return F.least(s, s2) >= similarity / (1 + similarity) * (F.col(m) + F.col(m2)) - 1e-9

    files = materialize(_keyed(sets, True))
    buckets = materialize(files.groupBy("key").agg(F.count("*").alias("n"), F.max_by(F.struct("th", "m", "s"), F.struct(F.col("s") / F.col("m"), F.col("th"))).alias("hub")))
    pair = [F.least("th", "th2").alias("u"), F.greatest("th", "th2").alias("v")]
    side = lambda name, to: sets.select(F.col("th").alias(to), F.col("m").alias(f"m_{name}"), F.col("held").alias(name))
    common = F.size(F.array_intersect("a", "b"))

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = materialize(pairs.filter(able("m", "s", "m2", "s2")).select(*pair).distinct())
        return materialize(pairs.join(side("a", "u"), "u").join(side("b", "v"), "v").filter(common >= similarity * (F.col("m_a") + F.col("m_b") - common) - 1e-6).select("u", "v"))

    def rooted(df: DataFrame, r: DataFrame, th: str = "th", root: str = "root") -> DataFrame:
        return df.join(r.select(F.col("node").alias(th), F.col("root").alias(root)), th, "left").withColumn(root, F.coalesce(root, th))

    def of_hubs(df: DataFrame) -> DataFrame:
        return verified(df.select("th", "m", "s", F.col("hub.th").alias("th2"), F.col("hub.m").alias("m2"), F.col("hub.s").alias("s2")))

    # the files of a bucket and its hub
    links = of_hubs(files.join(small(buckets.filter("n > 1")), "key").filter(F.col("th") != F.col("hub.th")))
    r = small(materialize(components(links)))
    # who asks, and buckets that it may be connected with: large ones, and small ones with a file elsewhere that can be alike
    known = rooted(files, r).join(small(buckets.filter(F.col("n") <= SMALL).select("key")), "key").groupBy("key").agg(F.collect_list(F.struct("m", "s", "root")).alias("files"))
    known = materialize(buckets.join(known, "key", "left"))
    if files.count() <= BROADCAST:
        known = F.broadcast(known)
    may = F.exists("files", lambda f: (f.root != F.col("root")) & (F.least(f.s, F.col("s")) >= similarity / (1 + similarity) * (f.m + F.col("m")) - 1e-9))
    met = materialize(_keyed(rooted(sets, r), False, ("th", "m", "s", "root")).join(known, "key").filter((F.col("n") > SMALL) | may).select("key", "th", "m", "s", "root", "n", "hub"))
    # the best hub elsewhere that it meets
    hubs = rooted(met.withColumn("h", F.col("hub.th")), r, "h", "hub_root").filter((F.col("root") != F.col("hub_root")) & able("m", "s", "hub.m", "hub.s"))
    hubs = hubs.groupBy("th", "m", "s").agg(F.max_by("hub", F.struct(F.col("hub.s") / F.col("hub.m"), F.col("hub.th"))).alias("hub"))
    links = materialize(links.unionByName(of_hubs(hubs)))
    met = met.drop("root")
    # the files of a small bucket that are not in one component with who asks
    r = small(materialize(components(links)))
    file2 = rooted(files.select("key", F.col("th").alias("th2"), F.col("m").alias("m2"), F.col("s").alias("s2")), r, "th2", "root2")
    few = rooted(met.filter(F.col("n") <= SMALL), r).join(file2, "key").filter((F.col("root") != F.col("root2")) & able("m", "s", "m2", "s2"))
    links = materialize(links.unionByName(verified(few.select("th", "m", "s", "th2", "m2", "s2"))))
    roots = materialize(components(links))
    hot = met.filter(F.col("n") > SMALL).select("key", "th", F.col("hub.th").alias("hub")).join(files.select("key", "th", F.lit(True).alias("f")), ["key", "th"], "left").select("key", "th", "hub", F.col("f").isNotNull().alias("filed"))
    more = materialize(_rest(hot, roots, sets, similarity))
    roots = components(links.unionByName(more))
    whole = nodes.join(roots, nodes.th == roots.node, "left").select("th", "first", F.coalesce("root", "th").alias("root"))
    least = whole.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.select("doc_id", "th").join(materialize(whole.join(least, "root").select("th", "component_id")), "th")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with one row of each group, that of the least id; of repeated rows one stays. A group whose ids are all null keeps one row."""
    found = materialize(groups(docs, id_col, text_col, **how))
    stay = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    repeated = stay.groupBy("doc_id", "th").count().filter("count > 1").limit(1).count() > 0
    i, t = fresh(docs, "__id"), fresh(docs, "__th")
    out = docs.withColumns({i: F.col(id_col).cast("long"), t: F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    si, st = fresh(out, "__stay_id"), fresh(out, "__stay_th")
    s = stay.distinct().select(F.col("doc_id").alias(si), F.col("th").alias(st))
    out = out.join(small(s), F.col(i).eqNullSafe(F.col(si)) & (F.col(t) == F.col(st)), "left_semi")
    if repeated:
        out = out.dropDuplicates([i, t])
    return out.drop(i, t)
