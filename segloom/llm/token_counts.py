"""Token counts of texts of any length with a public tokenizer's own library.

A text of over ``chunk`` characters is encoded in overlapping chunks with
offsets; two neighbours are spliced at a stable common boundary, and an overlap
without one is doubled until it has one or the chunks have become one.

A boundary is stable if a blank, tab or line end stands before it: the
vocabulary's pre-tokeniser drops them, no pre-token spans one, and neither does an
added token, so tokens on either side depend on that side alone. As a second
proof, both encodings must show the same tokens on the whole overlap after it, up
to the last such character. By the same law a shorter text's count is the sum
over its pieces between blanks and line ends, so the library encodes each
distinct piece once while the memo holds it.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segloom.llm.common import by_batch

CHUNK, OVERLAP, MEMO = 16_384, 256, 500_000


class Chunk:
    """The encoding of text[begin:end]; places are those of the whole text."""

    def __init__(self, text: str, begin: int, end: int, encode: Callable) -> None:
        self.begin, self.end, self.encoding = begin, end, encode(text[begin:end])

    def first(self, place: int) -> int:
        """Number of the first token that starts at place or later; starts never fall."""
        lo, hi = 0, len(self.encoding)
        while lo < hi:
            mid = (lo + hi) // 2
            if self.encoding.token_to_chars(mid)[0] + self.begin < place:
                lo = mid + 1
            else:
                hi = mid
        return lo

    def between(self, lo: int, hi: int) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids and spans of the tokens that start in [lo, hi)."""
        at = range(self.first(lo), self.first(hi))
        spans = (self.encoding.token_to_chars(i) for i in at)
        return self.encoding.ids[at.start : at.stop], [(a + self.begin, b + self.begin) for a, b in spans]


def splice_at(text: str, left: Chunk, right: Chunk) -> int | None:
    """A stable common boundary in the overlap of two chunks, or None."""
    spaces = [p + 1 for p in range(right.begin, left.end) if text[p] in " \t\n\r"]
    if len(spaces) < 2:
        return None
    return spaces[0] if left.between(spaces[0], spaces[-1]) == right.between(spaces[0], spaces[-1]) else None


def count_long(text: str, encode: Callable, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of one long text. encode: text -> the library's encoding with ids and offsets."""
    total, at = 0, 0  # tokens before `at` are counted
    left, wide = Chunk(text, 0, min(chunk, len(text)), encode), overlap
    while left.end < len(text):
        while True:
            begin = max(left.end - wide, at, left.begin)
            right = Chunk(text, begin, min(begin + chunk + wide, len(text)), encode)
            cut = splice_at(text, left, right)
            if cut is not None:
                total += left.first(cut) - left.first(at)
                at, left, wide = cut, right, max(overlap, wide // 2)
                break
            if begin <= max(at, left.begin):  # nothing to widen into: both become one chunk
                left = Chunk(text, left.begin, min(2 * left.end - left.begin, len(text)), encode)
                break
            wide *= 2
    return total + len(left.encoding) - left.first(at)


def splits_at_blanks(vocabulary: str) -> bool:
    """Whether a tokenizer file is known to drop blanks and to let no token, added ones included, span one; its normalizer may only change letters and runs of blanks."""
    file = json.loads(vocabulary)

    def steps(x: dict | None) -> list[dict]:
        return [y for part in x.get("pretokenizers", x.get("normalizers", [])) for y in steps(part)] or [x] if x else []

    def plain(x: dict) -> bool:
        return x["type"] in ("Lowercase", "NFC", "NFD", "NFKC", "NFKD", "StripAccents") or x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"} and x["content"] == " "

    first = (steps(file.get("pre_tokenizer")) or [{"type": ""}])[0]
    alternatives = first.get("pattern", {}).get("Regex", "").split("|")  # literals, or classes that a blank isn't in
    pieces = first["type"] == "Split" and first.get("behavior") == "Removed" and first.get("invert") and all(re.fullmatch(r"'?\w+|\[(\\p\{\w+\})+\]\+?|\[\^\\s(\\p\{\w+\})*\]\+?", x) for x in alternatives)
    added = all(not t.get("lstrip") and not t.get("rstrip") and not re.search(r"\s", t["content"]) for t in file.get("added_tokens") or [])
    return bool((pieces or first["type"] in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer")) and added and all(map(plain, steps(file.get("normalizer")))))


def token_counter(vocabulary: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Callable[[list[str]], list[int]]:
    """texts -> token counts, with the text of a tokenizer file; one thread, as a task has one core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(vocabulary)
    tok.no_truncation()
    tok.no_padding()

    memo: dict[str, int] = {}

    def encode(x: str):
        return tok.encode(x, add_special_tokens=False)

    if not splits_at_blanks(vocabulary):
        return lambda texts: [len(encode(x)) for x in texts]

    def count(texts: list[str]) -> list[int]:
        pieces = [x.replace("\n", " ").split(" ") if len(x) <= chunk else [] for x in texts]
        new = list({y for x in pieces for y in x if y not in memo})
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = list({y for x in pieces for y in x})
        memo.update(zip(new, map(len, tok.encode_batch_fast(new, add_special_tokens=False)), strict=True))
        return [sum(map(memo.__getitem__, y)) if len(x) <= chunk else count_long(x, encode, chunk, overlap) for x, y in zip(texts, pieces, strict=True)]

    return count


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs.

    Null is the empty text, with 0 tokens. Repeated rows give repeated rows, an
    empty table none; other columns of docs are not read. The file at path is read
    on the driver and sent to the executors.
    """
    with open(path, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())
    made: dict[str, Callable] = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if path not in made:
            made[path] = token_counter(vocabulary.value, chunk, overlap)
        texts = [x or "" for x in batch.column(1).to_pylist()]
        n = np.asarray(made[path](texts), np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(by_batch(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
