"""Language identification with error-correcting output codes.

Each language has a codeword of +1 and -1: all distinct splits of up to EXHAUSTIVE
languages, else a random code with the best least distance of several tries. For
each bit a logistic classifier on hashed byte 3-grams (square roots of their
shares, ASCII folded to lower case) predicts the side of the split. Decoding sums
each bit's logistic loss against a codeword, weighted by the bit's accuracy in
training, and takes the language of least loss; the score is its share of
exp(-loss), and a text whose runner-up is close is flagged as ambiguous.

The classifiers are fitted on PER_LANG labelled rows of a language and ROWS in
all, at most, drawn by a hash of the id; every row is predicted on its whole text.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segloom.llm.common import Sent, by_batch, raw_texts

DIM, PER_LANG, ROWS, EXHAUSTIVE, UNKNOWN, MARGIN = 1 << 12, 500, 6000, 6, "und", 0.5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[9:14] = 32


def grams(texts: list[bytes]) -> np.ndarray:
    """(texts, DIM) square roots of the shares of each hashed 3-gram."""
    out = np.zeros((len(texts), DIM), np.float32)
    for i, text in enumerate(texts):
        x = _LOWER[np.frombuffer(b" " + text + b" ", np.uint8)].astype(np.uint32)
        if len(x) > 2:
            h = x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA6B) + x[2:] * np.uint32(0xC2B2AE35)
            n = np.bincount((h ^ h >> np.uint32(15)) & np.uint32(DIM - 1), minlength=DIM)
            out[i] = np.sqrt(n / len(h))
    return out


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """(n, bits) of +1 and -1; no bit is constant."""
    if n <= EXHAUSTIVE:
        return np.array([(1, *x) for x in product((1, -1), repeat=n - 1) if -1 in x], np.int64).T.reshape(n, -1)
    rng, best, far = np.random.default_rng(seed), None, -1
    for _ in range(64):
        c = rng.choice([-1, 1], (n, int(np.ceil(10 * np.log2(n)))))
        c = c[:, np.abs(c.sum(axis=0)) < n]
        gap = ((c.shape[1] - c @ c.T) // 2 + np.eye(n, dtype=np.int64) * c.shape[1]).min()
        if gap > far:
            best, far = c, gap
    return best


class Model:
    """Languages, codewords, one linear classifier for each bit, and the bits' weights."""

    def __init__(self, languages: list[str], x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 40.0, decay: float = 1e-5) -> None:
        self.languages = languages
        self.code = codewords(len(languages)) if languages else np.zeros((0, 0), np.int64)
        side = self.code[y].astype(np.float32) if len(languages) else np.zeros((len(x), 0), np.float32)
        share = np.bincount(y, minlength=len(languages))[y] if len(y) else np.ones(0)
        weight = (1 / np.maximum(share, 1) / max(1, len(languages))).astype(np.float32)[:, None]  # languages count alike
        w, b = np.zeros((DIM, side.shape[1]), np.float32), np.zeros(side.shape[1], np.float32)
        vw, vb = w.copy(), b.copy()
        for _ in range(rounds if side.size else 0):
            g = -side * weight / (1 + np.exp(np.clip(side * (x @ w + b), -30, 30)))
            vw, vb = 0.9 * vw - rate * (x.T @ g + decay * w), 0.9 * vb - g.sum(axis=0)
            w, b = w + vw, b + vb
        self.w, self.b = w, b
        right = ((side * (x @ w + b) > 0) * weight).sum(axis=0) if side.size else np.zeros(side.shape[1])
        self.trust = np.maximum(0.05, 2 * right - 1)
        self.trust = self.trust / max(self.trust.sum(), 1e-9) * len(self.trust)

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether it is ambiguous, of each text."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        f = (grams(texts) @ self.w + self.b).astype(np.float64)
        loss = np.logaddexp(0, -self.code[None] * f[:, None, :]) @ self.trust  # (texts, languages)
        p = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        p /= p.sum(axis=1, keepdims=True)
        top = np.sort(p, axis=1)
        runner = top[:, -2] if p.shape[1] > 1 else np.zeros(len(p))
        return [self.languages[k] for k in p.argmax(axis=1)], p.max(axis=1), runner > MARGIN * top[:, -1]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def sample(labelled: DataFrame, per_lang: int = PER_LANG, rows: int = ROWS) -> DataFrame:
    """text, lang of the rows to learn from, of labelled(id, text, lang)."""
    from pyspark.sql import Window

    labelled = labelled.filter("lang is not null and text is not null")
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    quota = max(1, min(per_lang, rows // max(1, counts.count())))
    at = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30))
    # about twice the quota, before any text is dealt by language (the counts are as many as the model's languages); then the quota itself
    some = labelled.withColumn("at", at).join(F.broadcast(counts), "lang").filter(F.col("at") <= F.least(F.lit(1.0), 2.0 * quota / F.col("n")) * (1 << 30)).select("id", "text", "lang", "at")
    first = F.row_number().over(Window.partitionBy("lang").orderBy("at", "id"))
    return some.withColumn("k", first).filter(F.col("k") <= quota).select("text", "lang")


def fit(labelled: DataFrame, per_lang: int = PER_LANG, rows: int = ROWS) -> Model:
    """labelled: id, text, lang. Rows without a language or a letter teach nothing."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = raw_texts(batch)
        keep = [i for i, x in enumerate(texts) if has_letter(x.decode("utf-8", "replace"))]
        x = grams([texts[i] for i in keep])
        return pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(keep, pa.int64())), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "x"])

    got = sample(labelled, per_lang, rows).mapInArrow(by_batch(run), "lang string, x binary").collect()
    got.sort(key=lambda r: (r[0], bytes(r[1])))
    languages = sorted({r[0] for r in got})
    x = np.frombuffer(b"".join(bytes(r[1]) for r in got), np.float32).reshape(len(got), DIM)
    return Model(languages, x, np.array([languages.index(r[0]) for r in got], np.int64))


def identify(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **bounds) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for each row; learns where held_out is not true.

    A null text or one without a letter is 'und' with score 0, as is every text
    when nothing can be learned. Repeated rows get the same answer; an empty table
    none. Other columns are not read.
    """
    held = F.coalesce(held_out, F.lit(False))
    model = fit(docs.filter(~held).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")), **bounds)
    sent = Sent(docs.sparkSession, model)  # DIM times the code's bits

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = raw_texts(batch)
        lang, score, unsure = sent.value.predict(texts)
        no = [not has_letter(x.decode("utf-8", "replace")) for x in texts]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([UNKNOWN if n else x for n, x in zip(no, lang, strict=True)], pa.string()), pa.array([0.0 if n else float(x) for n, x in zip(no, score, strict=True)]), pa.array([n or bool(x) for n, x in zip(no, unsure, strict=True)])],
            ["doc_id", "held_out", "lang_pred", "score", "ambiguous"],
        )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text")).mapInArrow(by_batch(run), "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")
