"""Suffix arrays by induced sorting (SA-IS) and permuted common prefixes, in whole-array steps.

Induction takes a bucket at a time: the suffixes that begin with one letter are
known in order once all lesser (or, from the right, greater) ones have been
taken, so their predecessors are dealt to their own buckets in one stable sort by
letter. A predecessor in the same bucket waits for the bucket's next round; the
rounds are as many as the longest run of the letter.

The reduced string is sorted by the same routine, to any depth. It can have very
many names, whose buckets would hold a suffix or two; so each name over LETTERS is
written as two or more letters of a smaller alphabet, in a fixed width. That keeps
the order of the suffixes that begin with a name.
"""

from __future__ import annotations

import numpy as np

LETTERS = 1 << 11


def _types(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is less than the next one (S-type); the last one, the end mark, is."""
    change = np.flatnonzero(s[1:] != s[:-1])
    run = np.diff(np.concatenate([[-1], change, [len(s) - 1]]))
    return np.repeat(np.concatenate([s[change] < s[change + 1], [True]]), run)


def _deal(out: np.ndarray, next_: np.ndarray, step: int, at: np.ndarray, s: np.ndarray) -> None:
    """Puts suffixes in order into their letters' buckets, from next_ on upward (step 1) or downward (-1)."""
    if not len(at):
        return
    letter = s[at]
    order = letter.argsort(kind="stable")
    at, letter = at[order], letter[order]
    if letter[0] == letter[-1]:
        of, size = letter[0], len(at)
        begin = next_[of]
        if step > 0:
            out[begin : begin + size] = at
        else:
            out[begin - size + 1 : begin + 1] = at[::-1]
        next_[of] += step * size
        return
    cut = np.concatenate([[0], (letter[1:] != letter[:-1]).nonzero()[0] + 1])
    size, of = np.concatenate([cut[1:], [len(at)]]) - cut, letter[cut]
    out[(next_[of] - step * cut).repeat(size) + step * np.arange(len(at))] = at
    next_[of] += step * size


def _induce(s: np.ndarray, is_s: np.ndarray, lms: np.ndarray, letters: int) -> np.ndarray:
    """All suffixes in order (by their induced part) from the leftmost-smaller ones in order."""
    first = np.searchsorted(s[lms], np.arange(letters + 1))  # lms is sorted by letter at least
    begin = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=letters))])
    end = begin[1:] - 1
    head, out = begin[:-1].copy(), np.empty(len(s), np.int32)
    for c in range(letters):
        at = begin[c]
        while at < head[c]:  # what the bucket gets from itself comes in the next round
            chunk, at = out[at : head[c]], head[c]
            before = chunk[chunk > 0] - 1
            _deal(out, head, 1, before[~is_s[before]], s)
        star = lms[first[c] : first[c + 1]]
        _deal(out, head, 1, star[star > 0] - 1, s)
    tail = end.copy()
    for c in range(letters - 1, -1, -1):
        at = end[c]
        if c == 0:  # the end mark
            out[0], tail[0] = len(s) - 1, tail[0] - 1
        while at > tail[c]:
            chunk, at = out[tail[c] + 1 : at + 1][::-1], tail[c]
            before = chunk[chunk > 0] - 1
            _deal(out, tail, -1, before[is_s[before]], s)
        larger = out[begin[c] : head[c]][::-1]
        before = larger[larger > 0] - 1
        _deal(out, tail, -1, before[is_s[before]], s)
    return out


def of_names(names: np.ndarray, count: int) -> np.ndarray:
    """Suffix array of a string of names below `count`, however many; the last one is 0, and no other is."""
    if count <= LETTERS:
        return suffix_array(names.astype(np.uint16), count)
    width = 2
    while LETTERS**width < count:
        width += 1
    base = int(np.ceil(count ** (1 / width))) + 1
    powers = base ** np.arange(width - 1, -1, -1, dtype=np.int64)
    s = np.concatenate([(names[:-1, None] // powers % base + 1).ravel(), [0]]).astype(np.uint16)  # whose stable sort is by digits
    sa = suffix_array(s, base + 1)
    return sa[sa % width == 0] // width


def _names(s: np.ndarray, ends: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Whether each leftmost-smaller substring differs from the one before it in order; ends: last place by start."""
    a, b = order[:-1], order[1:]
    size = ends[a] - a
    differ = size != ends[b] - b
    open_ = np.flatnonzero(~differ)
    k = 0
    while len(open_):
        bad = s[a[open_] + k] != s[b[open_] + k]
        differ[open_[bad]] = True
        k += 1
        open_ = open_[~bad & (size[open_] >= k)]
    return np.concatenate([[True], differ])


def suffix_array(s: np.ndarray, letters: int) -> np.ndarray:
    """Starts of all suffixes of s in order. s: letters in 1 .. letters - 1, and 0 once, at the end."""
    if len(s) == 1:
        return np.zeros(1, np.int32)
    is_s = _types(s)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]).astype(np.int32) + 1
    order = lms[np.argsort(s[lms], kind="stable")]
    if len(lms) > 1:
        whole = _induce(s, is_s, order, letters)
        mark = np.zeros(len(s), bool)
        mark[lms] = True
        order = whole[mark[whole]]
        ends = np.empty(len(s), np.int32)
        ends[lms] = np.concatenate([lms[1:], lms[-1:]])
        new = _names(s, ends, order)
        name = np.empty(len(s), np.int64)
        name[order] = np.cumsum(new) - 1
        if not new.all():
            order = lms[of_names(name[lms], int(new.sum()))]
    return _induce(s, is_s, order, letters)


def permuted_prefixes(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each start the length of the common prefix with the suffix before it in order; s is uint8 with the end mark.

    Where the letters before a suffix and its neighbour agree the value is that
    of the start before, less one; only the other starts are compared, by eight letters a step.
    """
    n = len(s)
    phi = np.empty(n, np.int64)
    phi[sa[1:]], phi[sa[0]] = sa[:-1], -1
    at = np.arange(n)
    own = (phi <= 0) | (at == 0) | (s[at - 1] != s[np.maximum(phi, 1) - 1])
    start = np.flatnonzero(own & (phi >= 0))
    padded = np.concatenate([s, np.zeros(16, np.uint8)])
    eight = np.ndarray((n + 8,), "<u8", padded.data, strides=(1,))
    value = np.zeros(n, np.int64)
    k, open_ = 0, start
    while len(open_):
        x = eight[np.minimum(open_ + k, n + 7)] ^ eight[np.minimum(phi[open_] + k, n + 7)]
        done = x != 0  # the end mark is in one of the two only, so this comes
        low = x[done] & (~x[done] + np.uint64(1))
        value[open_[done]] = k + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
        open_ = open_[~done]
        k += 8
    last = np.maximum.accumulate(np.where(own, at, 0))
    return value[last] - np.where(phi >= 0, at - last, 0)
