"""Translators and what is asked of them: batches in tagged prompts, halved while cues are missing.

A translator answers one prompt. The fake one follows the test server's rule and
exists as a column too, so batch runs with it stay in the JVM; the others run
over Arrow batches of the units that missed the cache, and nothing else.
"""

from __future__ import annotations

import json
import random
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segloom.functions.text import BOUNDARIES, OVERFLOW, SAMPLING, batch_prompt_text, single_prompt_text

ATTEMPTS, MAX_DEPTH, MIN_CHARS = 4, 6, 64


class Fatal(Exception):
    """Won't get better by asking again; overflow if the prompt was too long."""

    def __init__(self, message: str) -> None:
        super().__init__(message)
        self.overflow = bool(re.search(OVERFLOW, message.lower()))


class Transient(Exception):
    """May get better; retry_after in seconds where the server says so."""

    def __init__(self, message: str, retry_after: float | None = None) -> None:
        super().__init__(message)
        self.retry_after = retry_after


def fake(prompt: str) -> str:
    """One answer a numbered tag, else one word."""
    ids = sorted(set(re.findall(r"<c(\d+)>", prompt)), key=int)
    return "\n".join(f"<c{i}>translated {i}</c{i}>" for i in ids) or "translated"


def fake_column(prompt: Column) -> Column:
    ids = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(prompt, F.lit("<c([0-9]+)>"), F.lit(1)), lambda n: n.cast("long"))))
    tag = lambda n: F.concat(F.lit("<c"), n.cast("string"), F.lit(">translated "), n.cast("string"), F.lit("</c"), n.cast("string"), F.lit(">"))
    return F.when(F.size(ids) > 0, F.array_join(F.transform(ids, tag), "\n")).otherwise("translated")


def echo(prompt: str) -> str:
    """The tagged cues themselves, or what follows the instruction."""
    tags = re.findall(r"(?s)<c\d+>.*?</c\d+>", prompt)
    return "\n".join(tags) if tags else prompt.split("\n\n", 1)[-1]


def http(endpoint: str, model: str, timeout: float = 180) -> Callable[[str], str]:
    """A chat server with the usual completions route."""

    def ask(prompt: str) -> str:
        body = {"model": model, "messages": [{"role": "user", "content": prompt}], **SAMPLING}
        req = urllib.request.Request(f"{endpoint.rstrip('/')}/chat/completions", json.dumps(body).encode(), {"content-type": "application/json"})
        try:
            with urllib.request.urlopen(req, timeout=timeout) as r:
                choices = json.load(r).get("choices")
        except urllib.error.HTTPError as e:
            said = e.read().decode("utf-8", "replace")
            if 400 <= e.code < 500 and e.code != 429:
                raise Fatal(f"{e.code}: {said[:500]}") from e
            after = e.headers.get("retry-after", "")
            raise Transient(f"{e.code}: {said[:500]}", float(after) if after.isdigit() else None) from e
        except (OSError, ValueError) as e:
            raise Transient(str(e)) from e
        if not choices:
            raise Transient("empty choices")
        return choices[0]["message"]["content"]

    return ask


def parse(response: str, count: int) -> list[str | None]:
    """Texts by tag number, the first of each; None where one is missing."""
    got: dict[int, str] = {}
    for m in re.finditer(r"(?s)<c0*([0-9]{1,10})>(.*?)</c\1>", response):
        got.setdefault(int(m[1]), m[2].strip())
    return [got.get(k + 1) for k in range(count)]


def halves(text: str) -> tuple[str, str] | None:
    """Parts at the run of boundary characters nearest to the middle, or None."""
    mid = len(text) // 2
    marks = [i for i, c in enumerate(text) if c in BOUNDARIES]
    if not marks:
        return None
    cut = min(marks, key=lambda i: (abs(i - mid), i)) + 1
    while cut < len(text) and text[cut] in BOUNDARIES:
        cut += 1
    return (text[:cut], text[cut:]) if text[:cut].strip() and text[cut:].strip() else None


def _asking(ask: Callable[[str], str], prompt: str, wait: Callable[[float], None]) -> str:
    for n in range(ATTEMPTS):
        try:
            return ask(prompt)
        except Transient as e:
            if n == ATTEMPTS - 1:
                raise
            wait(min(30.0, max(0.5 * 2**n, e.retry_after or 0.0)) * random.uniform(0.5, 1.5))
    raise AssertionError


def translate_one(ask: Callable[[str], str], text: str, target: str, prompt_of: Callable = single_prompt_text, wait=time.sleep, depth: int = 0) -> str | None:
    """A single segment, trimmed as its answer is; one that is too long for the model is halved, at most MAX_DEPTH times."""
    text = text.strip()
    try:
        return _asking(ask, prompt_of(text, target), wait).strip()
    except Transient:
        return None
    except Fatal as e:
        parts = halves(text) if e.overflow and depth < MAX_DEPTH and len(text) >= MIN_CHARS else None
        if parts is None:
            return None
        done = [translate_one(ask, p, target, prompt_of, wait, depth + 1) for p in parts]
        return None if None in done else "".join(done)


def translate_batch(ask: Callable[[str], str], cues: list[str], context: list[str], target: str, prompt_of: Callable = batch_prompt_text, wait=time.sleep) -> list[str | None]:
    """Cues in one prompt, the best of ATTEMPTS; halves with the same context while two or more are missing, whose answers then count.

    A fatal error that isn't an overflow is not split: every half would fail alike.
    """
    best: list[str | None] = [None] * len(cues)
    for n in range(ATTEMPTS):
        try:
            got = parse(ask(prompt_of(cues, context, target)), len(cues))
        except Fatal as e:
            if not e.overflow:
                return best
            break
        except Transient as e:
            if n < ATTEMPTS - 1:
                wait(min(30.0, max(0.5 * 2**n, e.retry_after or 0.0)) * random.uniform(0.5, 1.5))
            continue
        if sum(x is not None for x in got) > sum(x is not None for x in best):
            best = got
        if None not in best:
            return best
    if len(cues) > 1 and sum(x is None for x in best) >= 2:
        mid = len(cues) // 2
        best = translate_batch(ask, cues[:mid], context, target, prompt_of, wait) + translate_batch(ask, cues[mid:], context, target, prompt_of, wait)
    return best


def translate_units(units: DataFrame, make: Callable[[], Callable[[str], str]], target: str, single: bool = False) -> DataFrame:
    """seg_id, text of each translated segment, with the units' doc_id. units: doc_id, ids, cues, context.

    make() gives the translator on the executor, once for each task that has a
    unit. Answers can differ between runs: write them to the cache before use.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = None
        for b in batches:
            rows = []
            for u in b.to_pylist():
                ask = ask or make()
                got = [translate_one(ask, c, target) for c in u["cues"]] if single else translate_batch(ask, u["cues"], u["context"], target)
                rows += [(u["doc_id"], i, t) for i, t in zip(u["ids"], got, strict=True) if t is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], ["doc_id", "seg_id", "text"])

    return units.select("doc_id", "ids", "cues", "context").mapInArrow(run, "doc_id long, seg_id long, text string")


def split_plan(batches: DataFrame, n: str = "n") -> DataFrame:
    """path, first, size of every request that a batch of n cues leads to if none is ever answered: n halves down to one."""
    node = lambda path, first, size: F.struct(path.alias("path"), first.alias("first"), size.alias("size"))
    level = F.array(node(F.lit(""), F.lit(0), F.col(n).cast("int")))
    out = [level]
    for _ in range(max(0, int(batches.agg(F.max(n)).first()[0] or 0) - 1).bit_length()):  # as deep as the largest batch needs
        mid = lambda h: F.floor(h.size / 2).cast("int")
        both = lambda h: F.array(node(F.concat(h.path, F.lit("L")), h.first, mid(h)), node(F.concat(h.path, F.lit("R")), h.first + mid(h), h.size - mid(h)))
        level = F.flatten(F.transform(F.filter(level, lambda h: h.size > 1), both))
        out.append(level)
    return batches.select("*", F.explode(F.concat(*out)).alias("h")).select(*batches.columns, "h.path", "h.first", "h.size")


def best_attempt(attempts: DataFrame, key: str) -> DataFrame:
    """key, attempt, n: the attempt with most texts, the first among equals."""
    best = F.max_by(F.struct("attempt", "n"), F.struct("n", (-F.col("attempt")).alias("first")))
    return attempts.groupBy(key).agg(best.alias("b")).select(key, "b.attempt", "b.n")
