"""A causal self-attention language model over units, trained and applied in numpy.

Ids are numbered by frequency. What is predicted is a unit: one of the UNITS - 1
most frequent ids, or that it is another one. What is seen is finer: the INPUTS - 1
most frequent ids have embeddings of their own. A place's input is the sum of the
embeddings of the two ids before it and of its place in the window; one attention layer and one feed-forward layer, both with a residual,
give a state. The next unit's probability is that of its class times that of the
unit in its class, two softmaxes of about the root of the number of units.

Windows are T places long and overlap: a window after the first scores its last
STEP places and has the others as context, so each unit is scored once.
"""

from __future__ import annotations

import numpy as np

T, STEP, DIM, HIDDEN, CLASSES, UNITS, INPUTS = 32, 28, 24, 32, 32, 1024, 4096
#: Windows and places worked on at once: arrays of these sizes stay in a core's cache.
TOGETHER, ROWS = 128, 1024
_MASK = np.tril(np.ones((T, T), np.float32))


class Attention:
    """Parameters by name, as float32 arrays."""

    def __init__(self, unigram: np.ndarray, seed: int = 11) -> None:
        """unigram: probabilities of the UNITS units, most frequent first; the outputs' biases start there."""
        rng = np.random.default_rng(seed)
        size = UNITS // CLASSES
        normal = lambda *s, by=1.0: (rng.standard_normal(s) * by / np.sqrt(s[-2])).astype(np.float32)
        p = unigram.reshape(CLASSES, size) + 1e-9
        self.p = {
            "e1": normal(INPUTS + 1, DIM, by=0.3 * np.sqrt(INPUTS + 1)), "e2": normal(INPUTS + 1, DIM, by=0.3 * np.sqrt(INPUTS + 1)), "at": np.zeros((T, DIM), np.float32),
            "q": normal(DIM, DIM), "k": normal(DIM, DIM), "v": normal(DIM, DIM), "o": normal(DIM, DIM, by=0.3),
            "w1": normal(DIM, HIDDEN), "b1": np.zeros(HIDDEN, np.float32), "w2": normal(HIDDEN, DIM, by=0.3),
            "c": normal(DIM, CLASSES, by=0.1), "cb": np.log(p.sum(axis=1)).astype(np.float32),
            "m": normal(CLASSES, DIM, size, by=0.1), "mb": np.log(p / p.sum(axis=1, keepdims=True)).astype(np.float32),
        }

    def _states(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        p = self.p
        n = len(x)
        seen = x[:, :T]
        h = p["e1"].take(seen, axis=0)
        h[:, 1:] += p["e2"].take(seen[:, :-1], axis=0)
        h += p["at"]
        flat = h.reshape(-1, DIM)
        to = np.zeros((DIM, 3 * DIM + 1), flat.dtype)  # queries, keys, values and a column of ones, whose sum is the attention's
        to[:, :DIM], to[:, DIM : 2 * DIM], to[:, 2 * DIM : -1] = p["q"] / np.float32(np.sqrt(DIM)), p["k"], p["v"]
        qkv = (flat @ to).reshape(n, T, 3 * DIM + 1)
        qkv[:, :, -1] = 1
        a = np.matmul(qkv[:, :, :DIM], qkv[:, :, DIM : 2 * DIM].transpose(0, 2, 1))
        np.minimum(a, 60, out=a)
        np.exp(a, out=a)
        a *= _MASK
        z = np.matmul(a, qkv[:, :, 2 * DIM :])
        by = 1 / z[:, :, DIM:]
        mixed = (z[:, :, :DIM] * by).reshape(-1, DIM)
        h1 = mixed @ p["o"]
        h1 += flat
        r = h1 @ p["w1"]
        r += p["b1"]
        np.maximum(r, 0, out=r)
        h2 = r @ p["w2"]
        h2 += h1
        if keep is not None:
            a *= by
            keep |= {"flat": flat, "qkv": qkv, "a": a, "mixed": mixed, "h1": h1, "r": r}
        return h2

    def states(self, x: np.ndarray, keep: list[dict] | None = None) -> np.ndarray:
        """(n * T, DIM) states from (n, T + 1) inputs: x[:, t + 1] is what place t predicts, x[:, t] and x[:, t - 1] what it sees.

        TOGETHER windows at once, whose arrays stay in a core's cache.
        """
        keeps = [None if keep is None else {} for _ in range(0, len(x), TOGETHER)]
        out = [self._states(x[a : a + TOGETHER], k) for a, k in zip(range(0, len(x), TOGETHER), keeps, strict=True)]
        if keep is not None:
            keep += keeps
        return np.concatenate(out) if out else np.empty((0, DIM), np.float32)

    def log_probs(self, h: np.ndarray, y: np.ndarray, grads: dict | None = None) -> np.ndarray:
        """Natural logs of the probabilities of units y (n) in states h (n, DIM); grads gets those of their mean, negated, and of h as "h".

        Places are sorted by class, so that one product gives both softmaxes' logits.
        """
        p, size = self.p, UNITS // CLASSES
        n = len(y)
        cls = (y // size).astype(np.uint8)
        order = np.argsort(cls, kind="stable")
        bounds = np.searchsorted(cls[order], np.arange(CLASSES + 1)).tolist()
        hs, members = np.ones((n, DIM + 1), h.dtype), (y % size)[order] + CLASSES  # the last column meets the biases
        np.take(h, order, axis=0, out=hs[:, :DIM], mode="clip")
        to = np.empty((CLASSES, DIM + 1, CLASSES + size), h.dtype)
        to[:, :DIM, :CLASSES], to[:, DIM, :CLASSES], to[:, :DIM, CLASSES:], to[:, DIM, CLASSES:] = p["c"], p["cb"], p["m"], p["mb"]
        sums = np.zeros((CLASSES + size, 2), h.dtype)
        sums[:CLASSES, 0] = sums[CLASSES:, 1] = 1
        got = np.empty(n, h.dtype)
        if grads is not None:
            dto, dh = np.zeros_like(to), np.empty((n, DIM), h.dtype)
        for c in range(CLASSES):
            for a in range(bounds[c], bounds[c + 1], ROWS):
                s = slice(a, min(a + ROWS, bounds[c + 1]))
                e = hs[s] @ to[c]
                rows, m = np.arange(len(e)), members[s]
                right = e[:, c] + e[rows, m]
                np.exp(e, out=e)
                z = e @ sums
                got[s] = right - np.log(z[:, 0] * z[:, 1])
                if grads is not None:
                    z *= n
                    z = 1 / z
                    e[:, :CLASSES] *= z[:, :1]
                    e[:, CLASSES:] *= z[:, 1:]
                    e[:, c] -= 1 / n
                    e[rows, m] -= 1 / n
                    dto[c] += hs[s].T @ e
                    np.matmul(e, to[c, :DIM].T, out=dh[s])
        if grads is not None:
            of_class = dto[:, :, :CLASSES].sum(axis=0)
            grads |= {"c": of_class[:DIM], "cb": of_class[DIM], "m": dto[:, :DIM, CLASSES:], "mb": dto[:, DIM, CLASSES:], "h": np.empty_like(dh)}
            grads["h"][order] = dh
        out = np.empty(n, h.dtype)
        out[order] = got
        return out

    def gradients(self, x: np.ndarray, counted: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over the counted places of windows x (n, T + 1) and its gradients."""
        p, keeps, g = self.p, [], {}
        h2 = self.states(x, keeps)
        at = np.flatnonzero(counted.ravel())
        loss = -float(self.log_probs(h2.take(at, axis=0), targets(x[:, 1:].ravel().take(at)), g).mean())
        every = np.zeros_like(h2)
        every[at] = g.pop("h")
        scale = np.float32(1 / np.sqrt(DIM))
        back = np.concatenate([p["q"].T * scale, p["k"].T, p["v"].T])
        more = {k: np.zeros_like(p[k]) for k in ("w1", "b1", "w2", "o")}
        dto = np.zeros((DIM, 3 * DIM), h2.dtype)
        for b, keep in enumerate(keeps):
            dh = every[b * TOGETHER * T : (b + 1) * TOGETHER * T]
            n = len(dh) // T
            a, q, k, v = keep["a"], *(keep["qkv"][:, :, i * DIM : (i + 1) * DIM] for i in range(3))
            more["w2"] += keep["r"].T @ dh
            dr = dh @ p["w2"].T
            dr *= keep["r"] > 0
            more["w1"] += keep["h1"].T @ dr
            more["b1"] += np.ones(len(dr), dr.dtype) @ dr
            dh += dr @ p["w1"].T
            more["o"] += keep["mixed"].T @ dh
            dz = dh @ p["o"].T
            own = np.einsum("ij,ij->i", dz, keep["mixed"]).reshape(n, T, 1)  # what each place's weights have in common
            dz = dz.reshape(n, T, DIM)
            ds = np.matmul(dz, v.transpose(0, 2, 1))
            ds -= own
            ds *= a
            d = np.empty((n, T, 3 * DIM), h2.dtype)
            np.matmul(ds, k, out=d[:, :, :DIM])
            np.matmul(ds.transpose(0, 2, 1), q, out=d[:, :, DIM : 2 * DIM])
            np.matmul(a.transpose(0, 2, 1), dz, out=d[:, :, 2 * DIM :])
            d = d.reshape(-1, 3 * DIM)
            dto += keep["flat"].T @ d
            dh += d @ back
        # keys' gradients take q as scaled in the forward pass
        g |= more | {"q": dto[:, :DIM] * scale, "k": dto[:, DIM : 2 * DIM], "v": dto[:, 2 * DIM :]}
        dh = every.reshape(-1, T, DIM)
        g["at"] = dh.sum(axis=0)
        # an input is seen at its own place and at the next one
        both = np.zeros((len(x), T, 2 * DIM), h2.dtype)
        both[:, :, :DIM], both[:, :-1, DIM:] = dh, dh[:, 1:]
        seen = x[:, :T].astype(np.uint16).ravel()
        order = np.argsort(seen, kind="stable")
        u = seen[order]
        first = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
        sums = np.add.reduceat(both.reshape(-1, 2 * DIM).take(order, axis=0), first, axis=0)
        for name, d in (("e1", sums[:, :DIM]), ("e2", sums[:, DIM:])):
            g[name] = np.zeros_like(p[name])
            g[name][u[first]] = d
        return loss, g

    def train(self, x: np.ndarray, counted: np.ndarray, steps: int | None, batch: int = 64, rate: float = 4e-3, seed: int = 5) -> float:
        """Adam on random batches of windows, the rate falling to a tenth; the mean loss of the last steps. Without a number of steps each window is taken once."""
        if not len(x) or steps == 0:
            return float("nan")
        rng, losses = np.random.default_rng(seed), []
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        order = rng.permutation(len(x)) if steps is None else None
        steps = -(-len(x) // batch) if steps is None else steps
        for t in range(steps):
            i = rng.integers(0, len(x), batch) if order is None else order[t * batch : (t + 1) * batch]
            loss, g = self.gradients(x[i], counted[i])
            losses.append(loss)
            r = rate * min(1.0, (t + 1) / 20) * (1 - 0.9 * t / steps)
            for name, d in g.items():
                a, b = first[name], second[name]
                a *= 0.9
                a += 0.1 * d
                b *= 0.98
                d = d * d
                d *= 0.02
                b += d
                np.sqrt(b, out=d)
                d *= 1 / np.sqrt(1 - 0.98 ** (t + 1))
                d += 1e-8
                np.divide(a, d, out=d)
                d *= r / (1 - 0.9 ** (t + 1))
                self.p[name] -= d
        return float(np.mean(losses[-50:]))


def targets(x: np.ndarray) -> np.ndarray:
    """Units of inputs."""
    return np.minimum(x, UNITS - 1)


def window_places(begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and number in it of each window over texts of units, one after the other. begins: where each text begins, and the end."""
    n = np.diff(begins)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - T) // STEP)), 0)
    text = np.repeat(np.arange(len(n), dtype=np.int32), count)
    return text, (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)).astype(np.int32)


def windows(units: np.ndarray, begins: np.ndarray, text: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, T + 1) inputs of windows and which of their T places are scored.

    The input INPUTS stands before a text and pads its last window; no window
    reaches into another text.
    """
    first, end = begins[text][:, None], begins[text + 1][:, None]
    place = first + (number.astype(np.int64) * STEP)[:, None] + np.arange(-1, T)
    inside = (place >= first) & (place < end)
    x = np.where(inside, units[np.clip(place, 0, max(len(units) - 1, 0))], INPUTS)
    return x, inside[:, 1:] & ((np.arange(T) >= T - STEP) | (number == 0)[:, None])
