"""Gradient-boosted trees as flat arrays, with monotonic constraints.

Trees are fitted on a bounded sample of labelled rows that the caller draws.  All trees have the
same depth and lie in heap order, so that scoring is ``depth`` vectorised steps per tree.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """``feature``, ``cut`` and ``value`` have a row per tree and a column per heap node."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1; NaN features count as 0."""
        return 1 / (1 + np.exp(-np.clip(self.margin(np.nan_to_num(x)), -40, 40)))


def fit(
    x: np.ndarray,
    y: np.ndarray,
    monotone: dict[int, int] | None = None,
    trees: int = 40,
    depth: int = 4,
    rate: float = 0.2,
    bins: int = 64,
    ridge: float = 1.0,
    least_weight: float = 2.0,
) -> Trees:
    """Logistic boosting over quantile bins.

    ``monotone`` maps a feature to +1 (the score never falls as it grows) or -1.  A split that
    breaks its sign is refused, and the midpoint of the two children bounds all values below, so
    the constraint holds for each tree and so for their sum.  Without rows of both labels the
    result is the (smoothed) share of label 1 alone.
    """
    monotone = monotone or {}
    x = np.nan_to_num(np.asarray(x, np.float64))
    y = np.asarray(y, np.float64)
    n, d = x.shape if x.ndim == 2 else (0, 1)
    nodes = 2 ** (depth + 1) - 1
    share = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(share / (1 - share)))
    if n == 0 or y.min() == y.max():
        return Trees(np.zeros((0, nodes), np.int64), np.zeros((0, nodes)), np.zeros((0, nodes)), base, depth)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    all_f, all_c, all_v = [], [], []
    margin = np.full(n, base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        feature, cut, value = np.zeros(nodes, np.int64), np.full(nodes, np.inf), np.zeros(nodes)
        low, high = np.full(nodes, -np.inf), np.full(nodes, np.inf)
        node = np.zeros(n, np.int64)
        value[0] = g.sum() / (h.sum() + ridge)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.zeros(width)
            pick: list[tuple | None] = [None] * width
            for j in range(d):
                k = len(cuts[j]) + 1
                if k < 2:
                    continue
                cell = (node - first) * k + binned[:, j]
                sg = np.bincount(cell, g, width * k).reshape(width, k).cumsum(1)
                sh = np.bincount(cell, h, width * k).reshape(width, k).cumsum(1)
                gl, hl = sg[:, :-1], sh[:, :-1]
                gr, hr = sg[:, -1:] - gl, sh[:, -1:] - hl
                at = slice(first, first + width)
                lo, hi = low[at, None], high[at, None]
                vl, vr = np.clip(gl / (hl + ridge), lo, hi), np.clip(gr / (hr + ridge), lo, hi)
                v0 = value[at, None]

                def worth(gs, hs, v):
                    return gs * v - 0.5 * (hs + ridge) * v * v

                gain = worth(gl, hl, vl) + worth(gr, hr, vr) - worth(gl + gr, hl + hr, v0)
                gain[(hl < least_weight) | (hr < least_weight)] = 0
                if sign := monotone.get(j, 0):
                    gain[sign * (vr - vl) < 0] = 0
                b = gain.argmax(1)
                for w in range(width):
                    if gain[w, b[w]] > best[w] + 1e-9:
                        best[w] = gain[w, b[w]]
                        pick[w] = (j, cuts[j][b[w]], vl[w, b[w]], vr[w, b[w]])
            for w in range(width):
                i = first + w
                left, right = 2 * i + 1, 2 * i + 2
                low[left] = low[right] = low[i]
                high[left] = high[right] = high[i]
                if pick[w] is None:
                    value[left] = value[right] = value[i]
                    continue
                j, c, vl, vr = pick[w]
                feature[i], cut[i], value[left], value[right] = j, c, vl, vr
                if sign := monotone.get(j, 0):
                    middle = (vl + vr) / 2
                    if sign > 0:
                        high[left] = low[right] = middle
                    else:
                        low[left] = high[right] = middle
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        value *= rate
        margin += value[node]
        all_f.append(feature)
        all_c.append(cut)
        all_v.append(value)
    return Trees(np.array(all_f), np.array(all_c), np.array(all_v), base, depth)
