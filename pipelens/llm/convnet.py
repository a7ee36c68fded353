"""A small convolutional network for texts, trained and run in numpy.

Units (bytes, or words by hashed features) have embeddings; filters of several widths slide over them; each filter
keeps its largest value (max pooling, at least 0); a dense layer with a softmax follows. Texts are cut into windows of
a fixed number of units that also see the first units of the next window, so that no place is missed between windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

PAD = 0


def window_slices(counts: np.ndarray, length: int, beyond: int, step: int) -> tuple[np.ndarray, np.ndarray, Iterator[np.ndarray]]:
    """Each text's first window and number of windows, and index matrices (length + beyond, step windows) into units
    laid end to end, -1 for none.

    Texts without units have one empty window.
    """
    n = np.maximum(1, -(-counts // length))
    first = np.cumsum(n) - n
    doc = np.repeat(np.arange(len(counts)), n)
    begin = (np.cumsum(counts) - counts)[doc] + (np.arange(len(doc)) - first[doc]) * length
    stop = np.cumsum(counts)[doc]

    def slices() -> Iterator[np.ndarray]:
        for k in range(0, len(doc), step):
            at = begin[k : k + step] + np.arange(length + beyond)[:, None]
            yield np.where(at < stop[k : k + step], at, -1)

    return first, n, slices()


def windows(counts: np.ndarray, length: int, beyond: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One index matrix for all windows; each text's first window and number of windows."""
    first, n, slices = window_slices(counts, length, beyond, 1 << 30)
    return next(slices), first, n


@dataclass
class ConvNet:
    vocabulary: int
    dim: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    classes: int = 2
    seed: int = 7
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        if not self.p:
            rng = np.random.default_rng(self.seed)
            self.p["E"] = rng.normal(0, 0.3, (self.vocabulary, self.dim)).astype(np.float32)
            self.p["E"][PAD] = 0
            for w in self.widths:
                self.p[f"W{w}"] = rng.normal(0, (self.dim * w) ** -0.5, (w, self.dim, self.filters)).astype(np.float32)
                self.p[f"b{w}"] = np.zeros(self.filters, np.float32)
            self.p["U"] = rng.normal(0, 0.3, (len(self.widths) * self.filters, self.classes)).astype(np.float32)
            self.p["c"] = np.zeros(self.classes, np.float32)

    @property
    def beyond(self) -> int:
        return max(self.widths) - 1

    def embed(self, units: np.ndarray) -> np.ndarray:
        """Sums of the embeddings of the last axis' features."""
        out = self.p["E"][units[..., 0]]
        for k in range(1, units.shape[-1]):
            out += self.p["E"][units[..., k]]
        return out

    def convolve(self, x: np.ndarray, length: int) -> list[np.ndarray]:
        """(length, windows, filters) for each width, of embeddings (length + beyond, windows, dim)."""
        out = []
        for w in self.widths:
            a = x[:length] @ self.p[f"W{w}"][0]
            for j in range(1, w):
                a += x[j : j + length] @ self.p[f"W{w}"][j]
            out.append(a)
        return out

    def pooled(self, units: np.ndarray, length: int) -> np.ndarray:
        """Largest value of each filter in each window, at least 0; units: (length + beyond, windows, features)."""
        return np.concatenate([np.maximum(a.max(0), 0) for a in self.convolve(self.embed(units), length)], 1)

    def pooled_bytes(self, data: np.ndarray, length: int) -> np.ndarray:
        """As pooled(), for one byte a unit: tables of all pairs of bytes spare most of the arithmetic."""
        if not hasattr(self, "_tables"):
            self._tables = {}
            for w in self.widths:
                single = [self.p["E"] @ self.p[f"W{w}"][j] for j in range(w)]
                pairs = [(single[j][:, None] + single[j + 1][None]).reshape(-1, self.filters) for j in range(0, w - 1, 2)]
                self._tables[w] = [(2 * j, t, True) for j, t in enumerate(pairs)] + ([(w - 1, single[-1], False)] if w % 2 else [])
        wide = data.astype(np.intp)
        both = wide[:-1] * 256 + wide[1:] if len(data) > 1 else wide
        out = []
        for w in self.widths:
            total = None
            for j, t, pair in self._tables[w]:
                part = np.take(t, (both if pair else wide)[j : j + length], axis=0)
                total = part if total is None else np.add(total, part, out=total)
            out.append(np.maximum(total.max(0), 0))
        return np.concatenate(out, 1)

    def classify(self, pooled: np.ndarray) -> np.ndarray:
        bias = np.concatenate([self.p[f"b{w}"] for w in self.widths])
        z = np.maximum(pooled + bias, 0) @ self.p["U"] + self.p["c"]
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def fit(self, samples: list[np.ndarray], y: np.ndarray, length: int, epochs: int = 6, batch: int = 32, rate: float = 0.01, decay: float = 1e-4, weight: np.ndarray | None = None) -> None:
        """Adam on cross entropy. samples: for each text its units (n, features); a text is pooled over its windows."""
        rng = np.random.default_rng(self.seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        weight = np.ones(self.classes) if weight is None else weight
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(samples))
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                g = self._gradients([samples[i] for i in some], y[some], length, weight)
                step += 1
                for k, d in g.items():
                    d = d + decay * self.p[k] if k != "E" else d
                    m[k] += 0.1 * (d - m[k])
                    v2[k] += 0.01 * (d * d - v2[k])
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-6)
                self.p["E"][PAD] = 0

    def _gradients(self, texts: list[np.ndarray], y: np.ndarray, length: int, weight: np.ndarray) -> dict[str, np.ndarray]:
        counts = np.array([len(t) for t in texts])
        units = np.concatenate([*texts, np.zeros((1, texts[0].shape[1]), texts[0].dtype)])
        at, first, n = windows(counts, length, self.beyond)
        u = units[at]
        x = self.embed(u)
        n_docs, f = len(texts), self.filters
        tops, wheres = [], []
        for a in self.convolve(x, length):
            best = a.argmax(0)
            value = np.take_along_axis(a, best[None], 0)[0]
            top, place = np.zeros((n_docs, f), np.float32), np.zeros((n_docs, f, 2), int)
            for d in range(n_docs):
                k = value[first[d] : first[d] + n[d]].argmax(0) + first[d]
                top[d] = value[k, np.arange(f)]
                place[d, :, 0], place[d, :, 1] = best[k, np.arange(f)], k
            tops.append(top)
            wheres.append(place)
        raw = np.concatenate(tops, 1)
        bias = np.concatenate([self.p[f"b{w}"] for w in self.widths])
        pooled = np.maximum(raw, 0)
        hidden = np.maximum(pooled + bias, 0)
        z = hidden @ self.p["U"] + self.p["c"]
        z = np.exp(z - z.max(1, keepdims=True))
        dz = z / z.sum(1, keepdims=True)
        dz[np.arange(n_docs), y] -= 1
        dz *= weight[y][:, None] / n_docs
        dz = dz.astype(np.float32)
        g = {"U": hidden.T @ dz, "c": dz.sum(0), "E": np.zeros_like(self.p["E"])}
        dh = (dz @ self.p["U"].T) * (hidden > 0)
        for i, w in enumerate(self.widths):
            d = dh[:, i * f : (i + 1) * f]
            g[f"b{w}"] = d.sum(0)
            d = np.where(tops[i] > 0, d, 0)
            g[f"W{w}"] = np.zeros_like(self.p[f"W{w}"])
            pos, win = wheres[i][..., 0], wheres[i][..., 1]
            for j in range(w):
                g[f"W{w}"][j] = np.einsum("nfd,nf->df", x[pos + j, win], d)
                dx = d[..., None] * self.p[f"W{w}"][j].T
                for k in range(u.shape[-1]):
                    np.add.at(g["E"], u[pos + j, win, k], dx)
        return g
