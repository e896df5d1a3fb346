"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w.x): one weight vector on hashed text
features, shared by all grades, and ordered thresholds at least GAP
apart. A text's features are present or not: its distinct words, the
stems of STEMS letters of longer ones, and steps of style shares (words in
capitals, runs of marks, words repeated at once, bars, distinct words). Weights
are held at zero or less: a feature can lower a grade, and no number of harmless
words outweighs one strong word in a long text or is missed in a short one. Only
features that are clearly more common in a lower grade get a weight.

Expected grade and tail probability (of the best grade) follow from the
thresholds. The model is fitted on PER_GRADE labelled rows of a grade at most, drawn by a
hash of the id; every row is scored on its whole text. What is kept follows from a
fold of FOLD of these rows that a first fit leaves out: the least probability of
the best grade, KEEP at least, at which no lower grade has over MISSED of its rows
left. With fewer than ENOUGH rows of a grade in the fold it is KEEP.
"""

from __future__ import annotations

import zlib
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segloom.llm.common import Sent, by_batch, fresh, raw_texts

DIM, PER_GRADE, STEMS, LEAST, ERRORS, GAP, KEEP, MISSED, FOLD, ENOUGH, MEMO = 1 << 18, 3000, (4, 5), 3, 3.5, 0.5, 0.5, 0.03, 0.25, 20, 400_000
_STEPS = np.array([1e-9, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9])
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_MARKS = bytes(97 if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 if c in b" \t\n\r\v\f" else 33 for c in range(256))


def _slot(x: bytes) -> int:
    return zlib.crc32(x) & (DIM - 1)


def style(text: bytes) -> list[int]:
    """Slots of the steps that each style share reaches."""
    words = text.split()
    n = max(1, len(words))
    marks = text.translate(_MARKS)
    shares = (sum(map(bytes.isupper, words)), marks.count(b"!!"), sum(map(eq, words, words[1:])), words.count(b"|"), n - len(set(words)))
    return [_slot(b"\0style%d,%d" % (k, s)) for k, x in enumerate(shares) for s in range(int(np.searchsorted(_STEPS, x / n, side="right")))]


def features(text: bytes, memo: dict[bytes, tuple[int, ...]]) -> np.ndarray:
    """Distinct slots of a text."""
    out: set[int] = set(style(text)) if text else set()
    if len(memo) > MEMO:
        memo.clear()
    for w in set(text.translate(_LETTERS).split()):
        got = memo.get(w)
        if got is None:
            s = w.decode("utf-8", "ignore")
            got = memo[w] = (_slot(w), *(_slot(b"\0stem" + s[:k].encode()) for k in STEMS if len(s) >= k))
        out.update(got)
    return np.fromiter(out, np.int64, len(out))


class Ordinal:
    """Shared weights and ordered thresholds."""

    def __init__(self, grades: int) -> None:
        self.w, self.grades = np.zeros(DIM, np.float32), grades
        self.cut, self.keep = np.linspace(-1.0, 1.0, max(1, grades - 1)), KEEP

    def telling(self, rows: list[tuple[np.ndarray, int]]) -> np.ndarray:
        """Features of LEAST rows or more whose share in a lower grade exceeds that in the best one by ERRORS standard errors."""
        shown = lambda g: np.bincount(np.concatenate([np.empty(0, np.int64), *(x for x, y in rows if y == g)]), minlength=DIM)
        size = np.maximum(1, np.bincount([y for _, y in rows], minlength=self.grades))
        best, out = shown(self.grades - 1), np.zeros(DIM, bool)
        for g in range(self.grades - 1):
            own = shown(g)
            p = (own + best + 1) / (size[g] + size[-1] + 2)
            out |= (own >= LEAST) & (own / size[g] - best / size[-1] > ERRORS * np.sqrt(p * (1 - p) * (1 / size[g] + 1 / size[-1])))
        return out

    def fit(self, rows: list[tuple[np.ndarray, int]], epochs: int = 40, rate: float = 0.5, seed: int = 3) -> Ordinal:
        """AdaGrad over shuffled rows; a grade weighs as the root of its share, between rows and grades alike."""
        seen = np.bincount([y for _, y in rows], minlength=self.grades)
        share = np.sqrt(len(rows) / np.maximum(seen, 1) / self.grades)
        telling = self.telling(rows)
        rows = [(x[telling[x]], y) for x, y in rows]  # the others would be learned by heart
        g2, c2 = np.full(DIM, 1e-2, np.float32), np.full(len(self.cut), 1e-2)
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                x, y = rows[i]
                s = self.w[x].sum()
                low = 1 / (1 + np.exp(np.clip(s - self.cut[y - 1], -30, 30))) if y else 0.0  # P(grade < y)
                high = 1 / (1 + np.exp(np.clip(s - self.cut[y], -30, 30))) if y < self.grades - 1 else 1.0
                gap = 1 - np.exp(self.cut[y - 1] - self.cut[y]) if 0 < y < self.grades - 1 else 1.0
                # of -log P(grade = y) by the sum and by the two thresholds, in forms without differences of small numbers
                g = (1 - high - low) * share[y]
                above = -(1 - high) / ((1 - low) * gap) * share[y] if y < self.grades - 1 else 0.0
                below = low / (high * gap) * share[y] if y else 0.0
                if len(x):
                    g2[x] += g * g
                    self.w[x] = np.minimum(0, self.w[x] - rate * g / np.sqrt(g2[x]))
                for k, d in ((y, above), (y - 1, below)):
                    if 0 <= k < self.grades - 1:
                        c2[k] += d * d
                        self.cut[k] -= rate * d / np.sqrt(c2[k])
                for k in range(1, len(self.cut)):
                    self.cut[k] = max(self.cut[k], self.cut[k - 1] + GAP)
        return self

    def grade(self, x: np.ndarray) -> tuple[float, float]:
        """Expected grade and the probability of the best one."""
        above = 1 / (1 + np.exp(np.clip(self.cut - self.w[x].sum(), -60, 60)))  # P(grade > k)
        return float(above.sum()), float(above[-1])


def threshold(rows: list[tuple[np.ndarray, int]], grades: int, missed: float = MISSED) -> float:
    """What to keep, from a fold that a fit on the other rows hasn't seen."""
    every = int(1 / FOLD)
    fold = rows[::every]
    model = Ordinal(grades).fit([r for k, r in enumerate(rows) if k % every])
    out = KEEP
    for g in range(grades - 1):
        tails = np.sort([model.grade(x)[1] for x, y in fold if y == g])
        if len(tails) >= ENOUGH:
            out = max(out, float(np.nextafter(tails[-1 - int(missed * len(tails))], 1)))
    return min(out, 0.9)


def fit(docs: DataFrame, ratings: DataFrame, grades: int = 3, per_grade: int = PER_GRADE, id_col: str = "doc_id", text_col: str = "text") -> Ordinal:
    """ratings: doc_id, grade. Null grades teach nothing; without ratings every text gets the middle grade.

    Rows of one id are all drawn or none; of more than twice the rows asked for those of least hash count.
    """
    ratings = ratings.filter("grade is not null and doc_id is not null").distinct()
    counts = {r[0]: r[1] for r in ratings.groupBy("grade").count().collect()}
    limit = F.lit(-1)
    for g, n in counts.items():
        limit = F.when(F.col("grade") == g, int(min(1.0, per_grade / n) * (1 << 30))).otherwise(limit)
    chosen = ratings.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) <= limit)  # about per_grade for each grade

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        memo: dict[bytes, tuple[int, ...]] = {}
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([np.sort(features(x, memo)).astype(np.int32).tobytes() for x in raw_texts(batch)], pa.binary())], ["doc_id", "grade", "x"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("grade").cast("int").alias("grade"), "text").orderBy(F.xxhash64("doc_id", "text")).limit(2 * per_grade * grades)
    got = sorted((r[0], r[1], bytes(r[2])) for r in rows.mapInArrow(by_batch(run), "doc_id long, grade int, x binary").collect())
    learn = [(np.frombuffer(x, np.int32).astype(np.int64), g) for _, g, x in got if 0 <= g < grades]
    model = Ordinal(grades).fit(learn)
    model.keep = threshold(learn, grades)
    return model


def grades_of(labels: DataFrame) -> DataFrame:
    """doc_id, grade: 0 poor, 1 toxic, 2 neither, in the order of use: noise is no text, toxic text is well formed but unwanted. A poor text that is toxic too is poor."""
    poor, toxic = F.col("quality") == 0, F.coalesce(F.col("toxic") == 1, F.lit(False))
    return labels.filter("quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.when(poor, 0).when(toxic, 1).otherwise(2).alias("grade"))


def with_grades(docs: DataFrame, model: Ordinal, text_col: str = "text", expected: str = "expected_grade", tail: str = "tail_prob") -> DataFrame:
    """docs with two more columns: the expected grade and the probability of the best one.

    Null is as the empty text, which has no features and gets the thresholds'
    own grade. Repeated rows get the same; an empty table stays empty. Where docs has
    a column of a new one's name, underscores are added to the new one.
    """
    expected, tail = fresh(docs, expected), fresh(docs, tail)
    sent = Sent(docs.sparkSession, model)  # DIM weights
    schema = T.StructType([*docs.schema.fields, T.StructField(expected, T.DoubleType()), T.StructField(tail, T.DoubleType())])
    text_at = docs.columns[docs.columns.index(text_col)]
    memo: dict[bytes, tuple[int, ...]] = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [sent.value.grade(features(x, memo)) for x in raw_texts(batch, text_at)]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([g for g, _ in got], pa.float64()), pa.array([p for _, p in got], pa.float64())], schema.names)

    return docs.mapInArrow(by_batch(run), schema)


def select(docs: DataFrame, model: Ordinal, keep: float | None = None, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose probability of the best grade is `keep` or more; the model's own threshold if none is given."""
    expected, tail = fresh(docs, "__expected"), fresh(docs, "__tail")
    return with_grades(docs, model, text_col, expected, tail).filter(F.col(tail) >= (model.keep if keep is None else keep)).drop(expected, tail)
