"""Language-model scores of texts, beside the add-half unigram over words.

Words are runs without blanks, ASCII folded to lower case; a text ends with one
more token. A public byte-level vocabulary gives the subword ids of " " + word,
so that ids tell words and spaces apart and no text is out of vocabulary. The
attention model (attention.py) sees the INPUTS most frequent ids in training one by
one and predicts units: the UNITS - 1 most frequent ids, and one for the others,
whose own probabilities are add-half shares.

The score mixes two models of the next word: the network's, the product of its
subwords, and the add-half share of the words seen in training. A text's
probability is the mean of those that the mixes with each of WEIGHTS give it, so
each text has the weight that suits it at the price of one choice.

Training: all training texts are counted, words and ids. A seed of SEED_WINDOWS
windows sets the network up on the driver; then it is refined on all windows of all
training texts, in shards of about SHARD texts that a hash of the row makes, each in
the order of the hash, and the parameters are averaged by windows. So the model
depends on the rows and not on how files or partitions hold them.

Scoring walks whole texts in overlapping windows. The TOP most frequent words
have their counts on the executors; the others, few in each text but without
bound in all, meet the count table in a join by their XXH64, with the network's
probability of each, and are mixed there.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segloom.llm import attention
from segloom.llm.attention import INPUTS, STEP, T, UNITS, Attention, targets, window_places, windows
from segloom.llm.common import Sent, by_bytes, materialize, raw_texts

TOP, SEED_WINDOWS, STEPS, SHARD, FAN, SLICE, MEMO, PIECE, COUNTED, WEIGHTS = 1 << 18, 24_000, 3000, 4096, 16, 1 << 20, 150_000, 1 << 22, 1 << 23, (0.1, 0.3, 0.5, 0.7, 0.9)
#: Fixed value: the pattern that splits text before the vocabulary's merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


_LN10 = float(np.log(10))


class Subwords:
    """Ids of words by a rank file; the id after the last ends a text."""

    def __init__(self, ranks: bytes) -> None:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.end = max(table.values()) + 1
        self.encoding = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})

    def ids(self, word: bytes) -> list[int]:
        return self.encoding.encode_ordinary(" " + word.decode("utf-8", "replace"))


def text_words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists from about PIECE bytes each."""
    at = 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        while end < len(text) and not text[end : end + 1].isspace():
            end += 1
        yield text[at:end].lower().split()
        at = end


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word, c: all words of all texts; counts of COUNTED bytes of text are summed before they leave a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, COUNTED):
                words = pc.list_flatten(pc.ascii_split_whitespace(pc.ascii_lower(part.column(0))))
                seen = pc.value_counts(words.filter(pc.not_equal(words, "")))
                yield pa.RecordBatch.from_arrays([seen.field(0).cast(pa.string()), seen.field(1)], ["word", "c"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def common_words(words: DataFrame, most: int = TOP) -> dict[bytes, int]:
    """The words with counts from some count on, `most` of them at most, with their counts."""
    step = F.floor(F.log2("c") * 16).cast("int")  # so that there is a row for each step of counts and not for each word
    left, least = most, 1 << 30
    for r in sorted(words.groupBy(step.alias("s")).count().collect(), reverse=True):
        left -= r[1]
        if left < 0:
            break
        least = r[0]
    got = words.filter(step >= least).select("word", "c").toArrow()  # Row objects would take far more memory
    return dict(zip(got.column(0).cast(pa.binary()).to_pylist(), got.column(1).to_pylist(), strict=True))


def count_ids(words: DataFrame, ranks) -> dict[int, int]:
    """Subword ids of word, c with their counts; as many as the vocabulary has at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub, seen = Subwords(ranks.value), Counter()
        for batch in batches:
            for word, c in zip(raw_texts(batch, "word"), batch.column(1).to_pylist(), strict=True):
                for i in sub.ids(word):
                    seen[i] += c
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.int64()), pa.array(seen.values(), pa.int64())], ["id", "c"])

    return {r[0]: r[1] for r in words.mapInArrow(run, "id long, c long").groupBy("id").agg(F.sum("c")).collect()}


class Units:
    """Inputs of ids by frequency, log probabilities of the ids that share the last unit, and shares of the units."""

    def __init__(self, counts: dict[int, int], ids: int) -> None:
        c = np.zeros(ids, np.int64)
        c[list(counts)] = list(counts.values())
        order = np.argsort(-c, kind="stable")
        self.of = np.empty(ids, np.int32)
        self.of[order] = np.minimum(np.arange(ids), INPUTS - 1)
        unit = targets(self.of)
        rest = c[order[UNITS - 1 :]].sum()
        self.tail = np.where(unit == UNITS - 1, np.log((c + 0.5) / (rest + 0.5 * max(1, ids - UNITS + 1))), 0.0)
        self.share = np.bincount(unit, weights=c, minlength=UNITS) + 0.5
        self.share /= self.share.sum()


class Common:
    """The words with the highest counts, their counts and subword ids, as a few arrays."""

    def __init__(self, counts: dict[bytes, int], sub: Subwords | None = None) -> None:
        self.words = list(counts)
        ids = [sub.ids(w) for w in self.words] if sub else []
        self.count = np.fromiter(counts.values(), np.int64, len(counts))
        self.size = np.fromiter(map(len, ids), np.int64, len(ids)).astype(np.int64)
        self.flat = np.fromiter(chain.from_iterable(ids), np.int64, int(self.size.sum()))


class Reader:
    """Texts to units, with what is known of each word by the way; the memo starts with the common words and is bounded."""

    def __init__(self, ranks: bytes, common: Common | None = None) -> None:
        self.sub, self.common = Subwords(ranks), common or Common({})
        self.forget()

    def forget(self) -> None:
        """Back to the end of a text, which is entry 0, and the common words."""
        c = self.common
        self.number: dict[bytes, int] = dict(zip(c.words, range(1, len(c.words) + 1), strict=True))
        self.new: list[bytes] = []  # not in the tables yet
        self.size = np.concatenate([[1], c.size])  # subword ids of each entry
        self.first, self.flat = np.cumsum(self.size) - self.size, np.concatenate([[self.sub.end], c.flat])
        self.count, self.hash = np.concatenate([[0], c.count]), np.zeros(len(c.words) + 1, np.int64)  # -1 of a word that isn't common

    def words(self, text: bytes) -> np.ndarray:
        """Numbers of a text's words in the tables, and 0 for its end."""
        out = []
        for words in text_words(text):
            got = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
            if len(got) and got.min() < 0:
                for i in np.flatnonzero(got < 0).tolist():
                    got[i] = self.number.setdefault(words[i], len(self.number) + 1)
                    if got[i] == len(self.size) + len(self.new):
                        self.new.append(words[i])
            out.append(got)
        return np.concatenate([*out, [0]])

    def grow(self) -> None:
        """Takes the new words into the tables."""
        from xxhash import xxh64_intdigest

        if self.new:
            ids = [self.sub.ids(w) for w in self.new]
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.int64, int(size.sum()))])
            self.count = np.concatenate([self.count, np.full(len(ids), -1)])
            self.hash = np.concatenate([self.hash, np.array([xxh64_intdigest(w, 42) for w in self.new], np.uint64).view(np.int64)])
            self.new = []

    def read(self, texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Word numbers of each text with its end; subword ids of all texts, and where each begins."""
        if len(self.number) > MEMO + len(self.common.words):
            self.forget()
        words = [self.words(x) for x in texts]
        self.grow()
        every = np.concatenate(words)
        size = self.size.take(every)
        upto = np.cumsum(size)
        ids = self.flat.take(np.arange(upto[-1]) + np.repeat(self.first.take(every) - upto + size, size))
        ends = np.cumsum([len(w) for w in words]) - 1
        return words, ids, np.concatenate([[0], upto[ends]])


def score_units(model: Attention, inputs: np.ndarray, begins: np.ndarray, at_once: int = 128, together: int = 4) -> np.ndarray:
    """Natural log of the probability of each unit of the texts; each is scored in one window.

    States are worked out for at_once windows, which stay in a core's cache, and scored for some times as many.
    """
    text, number = window_places(begins)
    out = np.zeros(len(inputs))
    for a in range(0, len(text), at_once * together):
        hs, ys, places = [], [], []
        for b in range(a, min(a + at_once * together, len(text)), at_once):
            t, n = text[b : b + at_once], number[b : b + at_once]
            x, scored = windows(inputs, begins, t, n)
            at = np.flatnonzero(scored)
            hs.append(model.states(x).take(at, axis=0))
            ys.append(targets(x[:, 1:].ravel().take(at)))
            places.append((begins[t] + n.astype(np.int64) * STEP)[at // T] + at % T)
        out[np.concatenate(places)] = model.log_probs(np.concatenate(hs), np.concatenate(ys))
    return out


def _hash(docs: DataFrame, salt: int) -> Column:
    return F.xxhash64("doc_id", "text", F.lit(salt))


def train(docs: DataFrame, ranks, units: Units, total: int) -> Attention:
    """docs: training rows doc_id, text; total: their subwords. Seeded on the driver, refined over the cluster."""
    spark = docs.sparkSession
    model = Attention(units.share)
    expected = max(1.0, total / STEP)
    sent = Sent(spark, units)
    thin = min(1.0, SEED_WINDOWS / expected)
    of_docs = min(1.0, 8 * thin)  # many texts, some windows of each

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(ranks.value)
        for batch in batches:
            for part in by_bytes(batch, SLICE):
                _, ids, begins = reader.read(raw_texts(part))
                text, number = window_places(begins)
                h = part.column(1).to_numpy(zero_copy_only=False).view(np.uint64)[text] + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
                keep = (h >> np.uint64(32)).astype(np.float64) < thin / of_docs * 2.0**32
                x, scored = windows(sent.value.of[ids], begins, text[keep], number[keep])
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x.astype(np.int16)], pa.binary()), pa.array([r.tobytes() for r in scored], pa.binary())], ["x", "scored"])

    sample = docs.filter(F.pmod(_hash(docs, 1), F.lit(1 << 30)) < int(of_docs * (1 << 30)))
    got = sorted((bytes(r[0]), bytes(r[1])) for r in sample.select("text", _hash(docs, 2).alias("h")).mapInArrow(seed, "x binary, scored binary").collect())
    x = np.frombuffer(b"".join(r[0] for r in got), np.int16).reshape(-1, T + 1).astype(np.int32)
    model.train(x, np.frombuffer(b"".join(r[1] for r in got), bool).reshape(-1, T), min(STEPS, len(x) // 4))
    start = Sent(spark, model)
    names = sorted(model.p)

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, shard, own, n, texts, size = Reader(ranks.value), None, None, 0, [], 0

        def learn() -> int:
            _, ids, begins = reader.read(texts)
            x, scored = windows(sent.value.of[ids], begins, *window_places(begins))
            own.train(x, scored, None, batch=256, rate=2e-3, seed=len(x))
            return len(x)

        def made() -> pa.RecordBatch:
            flat = np.concatenate([own.p[k].ravel() for k in names]).astype(np.float64) * n
            return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([n]), pa.array([flat.tobytes()], pa.binary())], ["part", "n", "w"])

        for batch in batches:
            for s, text in zip(batch.column(1).to_pylist(), raw_texts(batch), strict=True):
                if texts and (s != shard or size + len(text) > SLICE):
                    n += learn()
                    texts, size = [], 0
                if s != shard:
                    if own is not None:
                        yield made()
                    shard, n, own = s, 0, Attention(sent.value.share)
                    own.p = {k: v.copy() for k, v in start.value.p.items()}
                texts.append(text)
                size += len(text)
        if own is not None:
            n += learn()
            yield made()

    shards = 1 + docs.count() // SHARD
    dealt = docs.select("text", F.pmod(_hash(docs, 3), F.lit(shards)).alias("shard"), _hash(docs, 4).alias("h"))
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "h").select("text", "shard")
    n, w = sum_shards(dealt.mapInArrow(refine, "part long, n long, w binary"), shards)
    if n:
        at = 0
        for k in names:
            size = model.p[k].size
            model.p[k], at = (w[at : at + size] / n).reshape(model.p[k].shape).astype(np.float32), at + size
    return model


def sum_shards(tuned: DataFrame, shards: int) -> tuple[int, np.ndarray]:
    """Sums of n and of w (float64 as bytes) over the rows part, n, w, a row for each part from 0 to shards - 1 at most.

    They are added in steps of FAN neighbours, each in the order of its parts, so
    that no task holds more and one row reaches the driver, whatever the number of shards.
    """

    def add(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("part")
        w = sum(np.frombuffer(x.as_buffer()) for x in rows.column("w"))
        return pa.table({"part": [key[0].as_py()], "n": [pc.sum(rows.column("n")).as_py()], "w": pa.array([w.tobytes()], pa.binary())})

    while shards > 1:
        tuned = tuned.withColumn("step", F.floor(F.col("part") / FAN)).groupBy("step").applyInArrow(add, "part long, n long, w binary")
        shards = -(-shards // FAN)
    got = tuned.collect()
    return (got[0].n, np.frombuffer(got[0].w)) if got else (0, np.zeros(0))


def word_sums(values: np.ndarray, words: list[np.ndarray], size: np.ndarray) -> np.ndarray:
    """Sums over each word's subwords, of texts one after the other."""
    n = size.take(np.concatenate(words))
    return np.add.reduceat(values, np.cumsum(n) - n)


def mixed(net: np.ndarray, share: np.ndarray) -> np.ndarray:
    """(WEIGHTS, words) log10 probabilities of words from the network's and their shares' (-inf for none)."""
    return np.array([np.logaddexp(net * _LN10 + np.log(w), share * _LN10 + np.log(1 - w)) / _LN10 for w in WEIGHTS])


def score(docs: DataFrame, ranks_path: str, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row; learns where held_out is not true.

    base_score sums log10((c + 0.5) / (N + 0.5 (V + 1))) over tokens, score is the
    mix's log10 probability. A null or empty text is its end alone. Repeated
    rows get the same answer. Without training rows N and V are 0 and the network
    is as it starts. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    with open(ranks_path, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    learn = rows.filter(~F.col("held_out")).select("doc_id", "text")
    texts = learn.count()
    words = materialize(count_words(learn))
    seen, distinct = words.agg(F.sum("c"), F.count("*")).first()
    n, v = (seen or 0) + texts, distinct + (texts > 0)
    counts = count_ids(words, ranks)
    size = Subwords(ranks.value).end
    counts[size] = texts
    units = Units(counts, size + 1)
    model = train(learn, ranks, units, sum(counts.values()))
    common = Common(common_words(words), Subwords(ranks.value))
    log_all = float(np.log10(n + 0.5 * (v + 1)))
    sent = Sent(spark, (model, units, common))  # TOP words at most and the parameters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, units, common = sent.value
        reader = Reader(ranks.value, common)
        for batch in batches:
            for part in by_bytes(batch, SLICE):
                texts_ = raw_texts(part)
                words_, ids, begins = reader.read(texts_)
                net = word_sums(score_units(model, units.of[ids], begins) + units.tail[ids], words_, reader.size) / _LN10
                every = np.concatenate(words_)
                c = reader.count[every].astype(np.float64)
                ends = np.cumsum([len(w) for w in words_])
                first = np.concatenate([[0], ends[:-1]])
                c[ends - 1] = texts
                base = np.where(c >= 0, np.log10(np.maximum(c, 0) + 0.5) - log_all, 0.0)
                sure = np.where(c < 0, 0.0, mixed(net, np.where(c > 0, base, -np.inf)))
                at = np.flatnonzero(c < 0)
                kind = pa.struct([("h", pa.int64()), ("p", pa.float64())])
                pairs = pa.StructArray.from_arrays([pa.array(reader.hash[every[at]]), pa.array(net[at])], fields=list(kind))
                scores = np.add.reduceat(sure, first, axis=1).T
                scores = pa.FixedSizeListArray.from_arrays(pa.array(scores.ravel()), len(WEIGHTS)).cast(pa.list_(pa.float64()))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(at, np.concatenate([first, ends[-1:]])).astype(np.int32)), pairs)
                sums = lambda x: pa.array(np.add.reduceat(x, first))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([zip_hash(x) for x in texts_], pa.int64()), pa.array(np.diff(np.concatenate([[0], ends]))), sums((c > 0).astype(np.int64)), sums(base), scores, lists],
                    ["doc_id", "held_out", "text_hash", "n_tokens", "known", "base", "scores", "rare"],
                )

    done = materialize(rows.mapInArrow(run, "doc_id long, held_out boolean, text_hash long, n_tokens long, known long, base double, scores array<double>, rare array<struct<h:long,p:double>>"))
    # rows of one id and text are alike: their sums are divided by their number
    spread = done.select("doc_id", "text_hash", F.posexplode("rare").alias("pos", "r")).select("doc_id", "text_hash", "pos", F.col("r.h").alias("h"), F.col("r.p").alias("p"))
    table = words.select(F.xxhash64("word").alias("h"), "c")
    share = F.log10(F.col("c") + 0.5) - log_all
    met = spread.join(table, "h", "left")

    def mixed_(w: float) -> Column:
        a, b = F.col("p") + float(np.log10(w)), share + float(np.log10(1 - w))
        return F.when(F.col("c") > 0, F.greatest(a, b) + F.log10(1 + F.pow(F.lit(10.0), -F.abs(a - b)))).otherwise(a)

    sums = met.groupBy("doc_id", "text_hash").agg(
        F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5) - log_all).alias("base_rare"), F.array(*[F.sum(mixed_(w)) for w in WEIGHTS]).alias("scores_rare"), F.count_if(F.col("c") > 0).alias("known_rare"), F.count_if(F.col("pos") == 0).alias("rows")
    )
    d, s = done.drop("rare").alias("d"), sums.alias("s")
    both = d.join(s, F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.text_hash") == F.col("s.text_hash")), "left")
    with_rare = lambda own, rare: F.col(own) + F.coalesce(F.col(rare) / F.col("rows"), F.lit(0.0))
    each = both.withColumn("each", F.expr("if(rows is null, scores, zip_with(scores, scores_rare, (x, y) -> x + y / rows))"))
    mean = F.expr(f"array_max(each) + log10(aggregate(each, 0D, (s, x) -> s + pow(10D, x - array_max(each))) / {len(WEIGHTS)})")
    return each.select(
        F.col("d.doc_id").alias("doc_id"), "held_out", "n_tokens", with_rare("known", "known_rare").cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        with_rare("base", "base_rare").alias("base_score"), mean.alias("score"),
    )


def zip_hash(text: bytes) -> int:
    """A signed 64-bit hash of a text."""
    from xxhash import xxh3_64_intdigest

    h = xxh3_64_intdigest(text)
    return h - (1 << 64) if h >> 63 else h
