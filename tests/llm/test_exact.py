"""Operators with exact contracts against plain versions, on tables with nulls, blanks, ties, copies and clashing columns."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from segloom.llm import attention, decontamination, imatch, lm_scoring, mixing, sharding, simhash, substring_dedup, suffix_array, token_counts
from segloom.llm.common import crc_part
from segloom.llm.components import components
from segloom.llm.golay import Golay

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard string, score double, fp long, th long, `key` string"


def docs_of(spark, rows):
    """Rows (doc_id, text, lang, source) with columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, la, s, len(t or ""), 7, "x", 0.5, 1, 2, "k") for i, t, la, s in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = ["the", "of", "Ändern", "idiot", "thion", "x1", "ABC", "été,", "日本", "in", "an"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    out = [(i, prose(rng.randint(1, 60)), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "z", None])) for i in range(60)]
    out += [(60, None, None, None), (61, "", "en", "a"), (62, " \n\t ", "fr", "b"), (63, "12 !?", None, "a"), (64, "only", "en", "solo"), (65, prose(3000), "fr", "z")]
    copy = prose(50)
    out += [(70 + i, copy, "en", "a") for i in range(40)] + [(3, out[3][1], out[3][2], out[3][3])] * 2 + [(-5, "neg", "en", "b")]
    return out


def test_token_counts(spark, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    got = token_counts.count_tokens(docs_of(spark, rows), path, limit=40, chunk=150, overlap=8).collect()
    want = [(i, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False))) for i, t, _, _ in rows]
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == sorted(want)
    assert all(r.over_limit == (r.n_tokens > 40) for r in got)


def test_token_counts_of_any_text():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib, count, rng = Tokenizer.from_file(path), token_counts.token_counter(open(path, encoding="utf-8").read(), 120, 8), random.Random(1)
    for k in range(400):
        x = "".join(rng.choice("ab ÉéＡ́ \n\t'sre<|endoftext|>12!?　 ") for _ in range(rng.randint(100, 900))) if k % 3 else "x" * rng.randint(100, 500) + rng.choice(["", "<|endoftext|>", " "]) + "é" * rng.randint(0, 300)
        assert count([x]) == [len(lib.encode(x, add_special_tokens=False))]


def test_token_counts_of_texts_without_blanks():
    """Chunks grow to double their length: the time at doubling stays in proportion, and other pre-tokenisers are left to the library."""
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    vocabulary = open(path, encoding="utf-8").read()
    lib, count, took = Tokenizer.from_file(path), token_counts.token_counter(vocabulary), []
    for n in (50_000, 200_000):
        x = "".join(random.Random(2).choices("abcdé1", k=n))
        began = time.time()
        assert count([x, x[:100]]) == [len(lib.encode(y, add_special_tokens=False)) for y in (x, x[:100])]
        took.append(time.time() - began)
    assert took[1] < 12 * took[0] + 0.5
    assert token_counts.splits_at_blanks(vocabulary)
    other = json.loads(vocabulary)
    other["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    other = json.dumps(other)
    assert not token_counts.splits_at_blanks(other)
    text = "Some words  and more.\n" * 40
    assert token_counts.token_counter(other, 50, 8)([text]) == [len(Tokenizer.from_str(other).encode(text, add_special_tokens=False))]


def folded(text, pattern):
    return re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_decontamination(spark, rows):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    items = [(1, "the of an in"), (10, rows[5][1]), (2, None), (3, "!"), (4, "IDIOT"), (11, rows[65][1][:400]), (5, "the of an in")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.report(docs_of(spark, rows), bench).collect()
    windows = [(i, tuple(w[j : j + min(13, len(w))])) for i, t in items for w in [folded(t, pattern)] if w for j in range(len(w) - min(13, len(w)) + 1)]
    want = []
    for i, t, _, _ in rows:
        w = folded(t, pattern)
        hit, found = set(), set()
        for item, x in windows:
            for p in range(len(w) - len(x) + 1):
                if tuple(w[p : p + len(x)]) == x:
                    hit.update(range(p, p + len(x)))
                    found.add(str(item))
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == sorted(want)
    kept = decontamination.decontaminate(docs_of(spark, rows), bench)
    assert kept.columns == docs_of(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(w[0] for w in want if not w[2])
    share = decontamination.decontaminate(docs_of(spark, rows), bench, share=20)
    assert sorted(r.doc_id for r in share.collect()) == sorted(w[0] for w in want if not w[5])


def test_suffix_search_finds_longest_matches():
    """Every suffix of the block has its longest match in the shard, and every text its longest ones, against plain loops."""
    rng = random.Random(3)
    for k in range(60):
        vocab = [f"w{i}" for i in range(rng.choice([1, 2, 5, 40]))]
        draw = lambda n: [rng.choice(vocab) for _ in range(n)]
        items = [draw(rng.randint(1, 12)) for _ in range(rng.randint(1, 6))]
        texts = [[*draw(rng.randint(0, 15)), "other", *rng.choice(items), *draw(rng.randint(0, 9))] for _ in range(5)] + [[], draw(30)]
        t = decontamination.Tests([(str(i), " ".join(x).encode()) for i, x in enumerate(items)], 4)
        w = decontamination.Words([" ".join(x).encode() for x in texts])
        found, names, longest = decontamination.search(w, t)
        least = min(min(len(x), 4) for x in items)

        def match(x, i, y, j):
            n = 0
            while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n]:
                n += 1
            return n

        places = [(a, b) for a, x in enumerate(texts) for b in range(len(x))]
        plain = [max((n for n in (match(x, j, texts[a], b) for a, b in places) if n), default=0) for x in items for j in range(len(x))]
        assert all(n == m or (n < m < least) for n, m in zip(longest.tolist(), plain, strict=True)), k
        for a, x in enumerate(texts):
            at = [max((n for i, y in enumerate(items) for j in range(len(y)) if (n := match(x, b, y, j)) >= min(4, len(y)) and (j == 0 or len(y) > 4 or n >= 4)), default=0) for b in range(len(x))]
            want = [(b, n) for b, n in enumerate(at) if n and all(b + n > c + m for c, m in enumerate(at[:b]))]
            assert [(b, n) for b, n, _, _ in found[a]] == want
            for b, n, i, o in found[a]:
                assert items[int(i)][o : o + n] == x[b : b + n]
            assert names[a] == sorted(str(i) for i, y in enumerate(items) if any(y[j : j + min(4, len(y))] == x[b : b + min(4, len(y))] for j in range(len(y) - min(4, len(y)) + 1) for b in range(len(x))))


def test_repeated_words_make_no_pairs():
    """A text of one word against an item of it: the search's rows are places, not places times windows."""
    took = []
    for n in (10_000, 40_000):
        t = decontamination.Tests([("1", b"so " * 2000)])
        began = time.time()
        found, names, _ = decontamination.search(decontamination.Words([b"so " * n]), t)
        took.append(time.time() - began)
        assert names == [["1"]] and found[0][0][:2] == (0, 2000) and max(a + k for a, k, _, _ in found[0]) == n
    assert took[1] < 10 * took[0] + 1


def test_decontamination_in_blocks(spark, rows, monkeypatch):
    items = [(k, rows[k][1]) for k in range(20)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(tuple, decontamination.report(docs_of(spark, rows), bench).collect()))
    monkeypatch.setattr(decontamination, "BLOCK", 2000)
    assert sorted(map(tuple, decontamination.report(docs_of(spark, rows), bench).collect())) == one


def test_suffix_arrays():
    rng = random.Random(1)
    for names in (1 << 11, 16):
        suffix_array.LETTERS = names
        for k in range(300):
            b = bytes(rng.randint(1, rng.choice([1, 2, 3, 200])) for _ in range(rng.randint(0, 60))) * (rng.randint(1, 4) if k % 3 == 0 else 1) + b"\0"
            s = np.frombuffer(b, np.uint8)
            sa = suffix_array.suffix_array(s, 256)
            assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
            p = suffix_array.permuted_prefixes(s, sa)
            for x, y in zip(sa[1:].tolist(), sa[:-1].tolist(), strict=True):
                n = next(n for n in range(len(b)) if b[x + n : x + n + 1] != b[y + n : y + n + 1])
                assert p[x] == n
    suffix_array.LETTERS = 1 << 11


def test_induced_sorting_recurses_at_any_size(monkeypatch):
    """A shard's reduced string has far more names than letters: it is sorted by the same routine, on strings that get shorter."""
    calls, sort = [], suffix_array.suffix_array
    monkeypatch.setattr(suffix_array, "suffix_array", lambda s, n: (calls.append((len(s), n)), sort(s, n))[1])
    rng = np.random.default_rng(3)
    words = [bytes(rng.integers(2, 28, rng.integers(2, 9)).astype(np.uint8)) for _ in range(3000)]
    text = b"\1".join(words[k] for k in rng.integers(0, 3000, 30_000))
    s = np.frombuffer(text + text[50_000:90_000] + b"\0", np.uint8)
    sa = suffix_array.suffix_array(s, 28)
    assert len(calls) > 3 and all(a[0] > b[0] for a, b in zip(calls, calls[1:], strict=False)) and all(n <= suffix_array.LETTERS for _, n in calls)
    raw = s.tobytes()
    assert np.array_equal(np.sort(sa), np.arange(len(s))) and all(raw[a : a + 50_000] < raw[b : b + 50_000] for a, b in zip(sa[:-1:37].tolist(), sa[1::37].tolist(), strict=False))


def removed(rows, length):
    seen = collections.Counter(t[i : i + length] for _, t in rows for i in range(len(t) - length + 1))
    out = []
    for k, t in rows:
        spans = []
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
        kept = b"".join(t[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(t)], strict=True))
        out.append((k, len(t), len(t) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [2, 1500])
def test_substring_dedup(spark, rows, hot, monkeypatch):
    rng = random.Random(8)
    more = [(200 + i, "".join(rng.choice("abé") for _ in range(rng.randint(0, 90))) + "shared passage of some forty bytes " * rng.randint(0, 3) + "".join(rng.choice("ab") for _ in range(40)), None, None) for i in range(60)]
    more += [(300 + i, "ab" * rng.randint(10, 60) + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 30))) + "Und " * rng.randint(0, 30), None, None) for i in range(25)]
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "SPLIT", 7)
    monkeypatch.setattr(substring_dedup, "SEGMENT", 64)
    every = rows + more
    got = substring_dedup.digest(substring_dedup.repeats(docs_of(spark, every), length=40, gram=16)).collect()
    assert sorted(map(tuple, got)) == removed([(i, (t or "").encode()) for i, t, _, _ in every], 40)


def test_substring_dedup_sorts_open_stretches_alone():
    """Of contexts that share their anchor, only stretches that another one may have reach the suffix array."""
    rng = np.random.default_rng(4)
    some = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8))
    core, long = some(300), some(420)
    h = substring_dedup.Powers(1000).grams(np.frombuffer(long, np.uint8), 160)
    p = int(np.argmin(h[:241]))  # the least hash of all stretches that begin here up to 20 bytes later
    contexts = [some(120) + core + some(220) for _ in range(2)] + [some(240 - p) + long + some(400 + p - 420) for _ in range(2)]
    of, lo, hi = substring_dedup.open_stretches(contexts, np.array([1, 1, 2, 2]), np.array([240] * 4), 400, 160)
    assert set(of.tolist()) <= {2, 3} and (hi - lo <= 20 + 2 * substring_dedup.CORE).all()
    # whatever another one has stays, with its place, for any contexts whose anchors are the least hashes
    for k in range(200):
        shared, n = bytes(rng.integers(97, 97 + (2, 26)[k % 2], 90).astype(np.uint8)) if k % 3 else b"ab" * 45, 40
        contexts, at = [], []
        for _ in range(3):
            a, b = sorted(rng.integers(0, 91, 2).tolist())
            text = some(int(rng.integers(0, 30))) + shared[a:b] + some(60)
            h = substring_dedup.Powers(len(text)).grams(np.frombuffer(text, np.uint8), 16)
            for q in {i + int(np.argmin(h[i : i + n - 15])) for i in range(len(text) - n + 1)}:
                contexts.append(text[max(0, q - 24) : q + n])
                at.append(min(q, 24))
        keys = np.array([hash(c[q : q + 16]) for c, q in zip(contexts, at, strict=True)])
        left = {}
        for o, a, b in zip(*(x.tolist() for x in substring_dedup.open_stretches(contexts, keys, np.array(at), n, 16)), strict=True):
            left.setdefault(o, set()).update(range(a, b + 1))
        seen = collections.defaultdict(set)
        for c, x in enumerate(contexts):
            grams = substring_dedup.Powers(len(x)).grams(np.frombuffer(x, np.uint8), 16)
            for i in range(len(x) - n + 1):
                if i <= at[c] <= i + n - 16 and grams[at[c]] == grams[i : i + n - 15].min():
                    seen[x[i : i + n], at[c] - i].add((c, i))
        for places in seen.values():
            if len(places) > 1:
                assert all(i in left.get(c, ()) for c, i in places)


def test_golay():
    g = Golay()
    words = np.random.default_rng(0).integers(0, 1 << 23, 3000)
    keys = g.indices(words)
    assert (keys[:, 0] >= 0).all() and set(np.unique((keys >= 0).sum(axis=1))) == {1, 6}
    for b in range(23):
        other = g.indices(words ^ (1 << b))
        assert all(other[i, 0] in keys[i] for i in range(len(words)))


def test_simhash(spark, rows, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL", 3)  # so that larger buckets go their own way
    rng = random.Random(2)
    base = [rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randint(0, 30)) for _ in range(300)]
    near = [(500 + i, " ".join(w if rng.random() > 0.002 else "zz" for w in base), None, None) for i in range(60)]
    every = rows + near
    got = simhash.digest(simhash.near_duplicates(docs_of(spark, every))).collect()
    fps = {}
    for i, t, _, _ in every:
        w = folded(t, r"[^\x20\x09-\x0D]+")
        sh = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        c = [sum(xxhash.xxh64_intdigest(x.encode(), 42) >> b & 1 for x in sh) for b in range(64)]
        fps[i] = sum(1 << b for b in range(64) if c[b] * 2 > len(sh))
    up = {i: i for i in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 2:
                lo, hi = sorted((find(a), find(b)))
                up[hi] = lo
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((i, f"{fps[i]:016x}", find(i)) for i, _, _, _ in every)
    assert len({find(i) for i, *_ in near}) < 60


@pytest.mark.parametrize("bits", [0, 1, 2])
def test_simhash_links_in_large_buckets(spark, bits):
    rng = random.Random(bits)
    base = [rng.getrandbits(64) for _ in range(3)]
    words = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 3))) for b in base for _ in range(60)}
    fps = spark.createDataFrame([(w - (1 << 64) if w >> 63 else w,) for w in words], "fp long")
    up = {w: w for w in words}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in words:
        for b in words:
            if (a ^ b).bit_count() <= bits:
                up[find(a)] = find(b)
    want = {frozenset(x for x in words if find(x) == find(w)) for w in words}
    up = {w: w for w in words}
    for r in simhash.links(fps, bits, small=2).collect():
        up[find(r.u & (1 << 64) - 1)] = find(r.v & (1 << 64) - 1)
    assert {frozenset(x for x in words if find(x) == find(w)) for w in words} == want


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(-1, k) for k in range(5000, 5050)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        up[hi] = lo
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    want = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert {r.node: r.root for r in got} == want and len(got) == len(want)


def test_mixing(spark, rows):
    got = mixing.mix(docs_of(spark, rows)).collect()
    size = lambda t: len(folded(t, r"[^\x20\x09-\x0D]+"))
    by = collections.Counter()
    for _, t, _, s in rows:
        by[s] += size(t)
    order = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None] * (None in by)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(by.values())
    while open_:  # reshare until none is above
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * by[s]}
        for s in over or open_:
            target[s] = 2.0 * by[s] if over else weight[s] * level
        left -= sum(target[s] for s in over)
        open_ -= over or open_
    where = {i: s for i, _, _, s in rows}
    taken = collections.Counter()
    for r in got:
        assert r.source_size == by[where[r.doc_id]] and abs(r.target - target[where[r.doc_id]]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[where[r.doc_id]] += r.taken
    assert all(taken[s] == round(target[s]) for s in order) and len(got) == len(rows)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs_of(spark, rows).repartition(5)).collect()))
    full = mixing.mixed(docs_of(spark, rows))
    assert full.columns == docs_of(spark, rows).columns
    n = collections.Counter(r.doc_id for r in full.collect())
    assert sum(n.values()) == sum((2 * r.taken + r.size) // (2 * r.size) for r in got if r.size)


def test_mixing_with_clashing_columns_and_null_ids(spark):
    rows = [(None if k % 9 == 0 else k, " ".join(["w"] * (k % 13)) if k % 17 else None, "ab"[k % 2], 1.0, 2, k) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __id double, __size int, row int")
    got = mixing.mix(docs).collect()
    assert len(got) == 300 and abs(sum(r.taken for r in got) - 1.5 * sum(r.size for r in got)) <= 2
    assert mixing.mixed(docs).columns == docs.columns and sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()), key=repr) == sorted(map(tuple, got), key=repr)


def test_no_step_of_the_mix_is_large(spark):
    """At any weight a step of keys holds a small share of a source, so the one that is sorted does."""
    for q in (0.05, 1.0):
        rows = mixing.keyed(spark.range(40_000).select(F.col("id").alias("i"), F.lit("one two").alias("t"), F.lit("s").alias("s"), F.lit(q).alias("q")), "mix")
        assert rows.groupBy("__slice").count().agg(F.max("count")).first()[0] < 0.003 * 40_000


def test_sampling_follows_weights(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one two three four").alias("text"), F.lit("s").alias("source"))
    heavy = F.col("doc_id") % 2 == 0
    got = mixing.mix(docs, weight=F.when(heavy, 0.9).otherwise(0.3), share=0.5).groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.sum("taken").alias("n")).collect()
    n = {r.odd: r.n for r in got}
    assert n[0] + n[1] == 8000 and n[0] > 1.5 * n[1]


def test_sharding(spark, rows):
    got = sharding.shard(docs_of(spark, rows), 5).collect()
    text = {i: t or "" for i, t, _, _ in rows}
    assert len(got) == len(rows) and all(r.size == len(text[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.law == "bytes" and r.grown_shard is None for r in got)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    even = sharding.shard(spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("x"), F.repeat(F.lit("y"), (F.col("id") % 97).cast("int")), F.when(F.col("id") % 3 > 0, F.col("id")).otherwise(0).cast("string")).alias("text")), 8).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    sizes = [r.n for r in even]
    assert len(sizes) == 8 and max(sizes) < 1.02 * min(sizes)


def plain_packing(sizes, capacity):
    """Best fit decreasing, one item after the other: a sorted list of (size, bin)."""
    left, out = [], []
    for n in sorted(sizes, reverse=True):
        fits = [(c, b) for b, c in enumerate(left) if c >= n]
        if not fits:
            left.append(max(capacity, n))
            fits = [(left[-1], len(left) - 1)]
        out.append((n, min(fits)[1]))
        left[min(fits)[1]] -= n
    return sorted(out), len(left)


def test_packing_is_best_fit_decreasing():
    rng = random.Random(0)
    for _ in range(50):
        sizes = [rng.randint(1, 60) for _ in range(rng.randint(1, 80))]
        want, bins = plain_packing(sizes, 50)
        got = sharding.pack(list(collections.Counter(sizes).items()), 50)
        assert sorted((s, b) for s, n, b in got for _ in range(n)) == want and len({b for _, _, b in got}) == bins


def test_shards_are_the_plain_packing_of_whole_groups(spark):
    rng = random.Random(1)
    texts = ["x" * rng.randint(0, 300) + str(rng.randint(0, 40)) for _ in range(900)] + ["hot " * 60] * 120 + [None, "", None]
    rows = [(None if k % 50 == 0 else k % 700, t) for k, t in enumerate(texts)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 8).collect()
    size = collections.Counter()
    for t in texts:
        size[t or ""] += len(t or "") + 16
    at = collections.defaultdict(set)
    for r in got:
        at[r.text_crc32, r.size].add(r.shard)
    assert len(got) == len(texts) and all(len(x) == 1 for x in at.values())  # groups are whole
    runs = list(collections.Counter(size.values()).items())
    share = sum(size.values()) / 8
    assert size["hot " * 60] > share  # has a shard to itself, the others share the rest
    (own,) = at[zlib.crc32(b"hot " * 60), 256]
    assert {r.text_crc32 for r in got if r.shard == own} == {zlib.crc32(b"hot " * 60)}
    bins = sharding.pack_into(runs, 8)
    capacity = max(sum(s * n for s, n, b in bins if b == k) for k in range(1, 8))
    want, _ = plain_packing(list(size.values()), capacity)
    sums = collections.Counter()
    for r in got:
        sums[r.shard] += r.size
    assert sorted(sums.values()) == sorted(sum(n for n, b in want if b == k) for k in range(8))
    others = sorted(v for k, v in sums.items() if k != own)
    assert others[-1] < 1.02 * others[0]


def plain_parts(terms, known):
    """Parts of a sorted set of signed term hashes: an MD5 for each subset of the lexicon that bits of the hash make."""
    md5 = lambda x: hashlib.md5(",".join(map(str, x)).encode()).hexdigest()[:8] if x else ""
    out = []
    for i, bits in enumerate(imatch.RATE_BITS):
        for j in range(imatch.EACH):
            out.append(md5([t for t in terms if t in known and ((t & (1 << 64) - 1) >> (7 * j + 2 * i) % (64 - bits)) & ((1 << bits) - 1) == 0]))
    return [*out, "" if any(out) else md5(terms)]


def signed(w):
    return (h := xxhash.xxh64_intdigest(w.encode(), 42)) - ((h >> 63) << 64)


@pytest.mark.parametrize("buckets", [4096, 3])
def test_imatch(spark, rows, buckets, monkeypatch):
    """Edits, parts and likeness against a plain version, with repeated rows, null ids, blanks and ties."""
    monkeypatch.setattr(imatch, "PER_BUCKET", 10)
    monkeypatch.setattr(imatch, "MOST_BUCKETS", buckets)
    rows = [*rows, (None, "no id", None, None), (None, rows[5][1], None, None), (None, None, None, None), (10**12, "far away", None, None), (-(10**12), "x " * 5000, None, None)]
    words = lambda t: {w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if w}
    df = collections.Counter(w for _, t, _, _ in rows for w in words(t))
    known = {signed(w) for w, n in df.items() if max(2, 0.02 * len(rows)) <= n <= 0.6 * len(rows)}
    parts = lambda t: plain_parts(sorted(map(signed, words(t))), known)
    down = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1] or "")), reverse=True)
    want = []
    for (i, t, _, _), (_, after, _, _) in zip(down, [*down[1:], down[0]], strict=True):
        t, after = t or "", after or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        p, e, x = parts(t), parts(edited), parts(after)
        like = lambda a, b: 1.0 if a == b else sum(u == v != "" for u, v in zip(a, b, strict=True)) / max(1, sum(u != "" or v != "" for u, v in zip(a, b, strict=True)))
        want.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest(), ".".join(p), ".".join(e), round(like(p, e), 9), round(like(p, x), 9)))
    got = [(str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in imatch.digest(imatch.fingerprints(docs_of(spark, rows), low=0.02, high=0.6)).collect()]
    assert sorted(got) == sorted(want)


def test_imatch_lexicon(spark, rows):
    docs = docs_of(spark, rows)
    known = {r.t for r in imatch.lexicon(docs, "text", 0.02, 0.6).collect()}
    df = collections.Counter(w for _, t, _, _ in rows for w in set(re.split(r"[\x20\x09-\x0D]+", (t or "").lower())) - {""})
    assert known == {signed(w) for w, n in df.items() if max(2, 0.02 * len(rows)) <= n <= 0.6 * len(rows)}


def test_imatch_tells_short_texts_apart(spark):
    words = [f"term{k}" for k in range(200)]
    texts = ["", *(f"{w} only{w}" for w in words), *words]  # one lexicon term at most, which few subsets hold
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = rows.filter("doc_id > 200").select(F.xxhash64("text").alias("t"))
    terms = rows.select(F.col("doc_id").alias("k"), imatch.term_hashes(F.col("text")).alias("a"))
    got = {r.k: ".".join(r.parts) for r in imatch.with_parts(terms, {"parts": F.col("a")}, known).collect()}
    assert not got[0].strip(".") and all(got[i].strip(".") for i in range(1, len(texts)))
    assert len({got[i] for i in range(201, 401)}) == 200


def test_lm_scores(spark, rows, monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(lm_scoring, "TOP", 4)  # so that words meet their counts in the join
    docs = docs_of(spark, rows)
    got = lm_scoring.score(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), crc_part("doc_id", 5) == 1).collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    words = {i: [*folded(t, r"[^\x20\x09-\x0D]+"), None] for i, t, _, _ in rows}
    c = collections.Counter(w for i, *_ in rows if not held(i) for w in words[i])
    n, v = sum(c.values()), len(c)
    assert len(got) == len(rows)
    for r in got:
        w = words[r.doc_id]
        base = sum(np.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(w), sum(c[x] > 0 for x in w), n)
        assert abs(r.base_score - base) < 1e-6 * abs(base) and np.isfinite(r.score) and r.score < 0


def test_lm_refines_on_all_texts(spark, monkeypatch):
    """Also in a table that is said to be large, each training text reaches the tasks that refine the model."""
    import public_tokenizers

    seen = spark.sparkContext.accumulator(0)

    class Counting(lm_scoring.Reader):
        def read(self, texts):
            seen.add(len(texts))
            return super().read(texts)

    monkeypatch.setattr(lm_scoring, "Reader", Counting)
    texts = [(i, f"word{i} and some more words of text {i}") for i in range(640)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    words = lm_scoring.count_words(docs)
    counts = lm_scoring.count_ids(words, ranks)
    size = lm_scoring.Subwords(ranks.value).end
    counts[size] = len(texts)
    lm_scoring.train(docs, ranks, lm_scoring.Units(counts, size + 1), 10**12)  # a share of the seed that takes none of these
    assert seen.value == len(texts)


def test_lm_shards_reach_the_driver_as_one(spark, monkeypatch):
    """The parameters of many shards are added on the cluster: one row of them is collected, and it is their mean by windows."""
    import public_tokenizers
    from pyspark.sql.classic.dataframe import DataFrame

    own = []
    collect = DataFrame.collect

    def counted(df):
        rows = collect(df)
        own.extend(r.w for r in rows if "w" in df.columns)
        return rows

    monkeypatch.setattr(DataFrame, "collect", counted)
    monkeypatch.setattr(lm_scoring, "SHARD", 8)

    class Marked(lm_scoring.Attention):
        def train(self, x, *a, **b):  # in place of learning, so that the mean is known
            self.p["cb"] = np.full_like(self.p["cb"], len(x))

    monkeypatch.setattr(lm_scoring, "Attention", Marked)
    texts = [(i, f"word{i} " * (1 + i % 90)) for i in range(320)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    counts = lm_scoring.count_ids(lm_scoring.count_words(docs), ranks)
    size = lm_scoring.Subwords(ranks.value).end
    model = lm_scoring.train(docs, ranks, lm_scoring.Units(counts, size + 1), 10**12)
    by_shard = collections.Counter()
    sub = lm_scoring.Subwords(ranks.value)
    for r in docs.withColumn("s", F.pmod(lm_scoring._hash(docs, 3), F.lit(41))).select("text", "s").toLocalIterator():
        n = 1 + sum(len(sub.ids(x.encode())) for x in r.text.split())
        by_shard[r.s] += 1 + max(0, -(-(n - attention.T) // attention.STEP))
    assert len(by_shard) > 2 * lm_scoring.FAN
    assert len(own) == 1
    want = sum(n * n for n in by_shard.values()) / sum(by_shard.values())
    assert np.allclose(model.p["cb"], want, rtol=1e-6)


def test_lm_scores_are_the_mix_and_do_not_depend_on_files(spark, rows, monkeypatch):
    """The mean over weights of the products of mixed word probabilities, from the trained network's own answers; the same for rows in other partitions and order."""
    import public_tokenizers

    path, held = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), crc_part("doc_id", 5) == 1
    made, train = [], lm_scoring.train
    monkeypatch.setattr(lm_scoring, "train", lambda *a: made.append((train(*a), a[2])) or made[-1][0])
    monkeypatch.setattr(lm_scoring, "TOP", 4)
    monkeypatch.setattr(lm_scoring, "SHARD", 20)
    one = {(r.doc_id, r.n_tokens): r.score for r in lm_scoring.score(docs_of(spark, rows), path, held).collect()}
    two = {(r.doc_id, r.n_tokens): r.score for r in lm_scoring.score(docs_of(spark, rows[::-1]).repartition(7), path, held).collect()}
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-4 * abs(one[k]) for k in one)
    (model, units), sub = made[0], lm_scoring.Subwords(open(path, "rb").read())
    words = {i: folded(t, r"[^\x20\x09-\x0D]+") for i, t, _, _ in rows}
    learned = [[*words[i], None] for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    c = collections.Counter(w for x in learned for w in x)
    n, v = sum(c.values()), len(c)
    for i, w in words.items():
        ids = [sub.ids(x.encode()) for x in w] + [[sub.end]]
        flat = np.array([y for x in ids for y in x])
        lp = lm_scoring.score_units(model, units.of[flat], np.array([0, len(flat)])) + units.tail[flat]
        ends = np.cumsum([len(x) for x in ids])
        net = [lp[a:b].sum() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        share = [(c[x] + 0.5) / (n + 0.5 * (v + 1)) if c[x] else 0.0 for x in [*w, None]]
        each = [sum(np.log10(k * np.exp(a) + (1 - k) * b) for a, b in zip(net, share, strict=True)) for k in lm_scoring.WEIGHTS]
        want = max(each) + np.log10(np.mean([10 ** (x - max(each)) for x in each]))
        assert abs(one[i, len(w) + 1] - want) < 1e-4 * abs(want) + 1e-4


def test_a_pass_takes_each_window_once(monkeypatch):
    taken = []
    model = lm_scoring.Attention(np.full(attention.UNITS, 1 / attention.UNITS))
    monkeypatch.setattr(model, "gradients", lambda x, counted: (taken.extend(x[:, 0].tolist()), (0.0, {}))[1], raising=False)
    model.train(np.arange(150)[:, None], np.ones((150, 1), bool), None)
    assert sorted(taken) == list(range(150))


def test_empty_tables(spark):
    import public_tokenizers

    none = docs_of(spark, [(1, "a", "en", "s")]).filter("false")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert token_counts.count_tokens(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert decontamination.report(none, bench).count() == 0
    assert decontamination.report(docs_of(spark, [(1, "a", "en", "s")]), bench.filter("false")).first().n_hit == 0
    assert sharding.shard(none).count() == 0
    assert substring_dedup.repeats(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0
    assert imatch.digest(imatch.fingerprints(none)).count() == 0
    assert lm_scoring.score(none, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), crc_part("doc_id", 5) == 1).count() == 0
