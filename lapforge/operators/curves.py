"""The nearest span of a curve to each of many points in plain arrays: what a task runs on the points and spans of one tile."""

from __future__ import annotations

import numpy as np

_STRIDE = 1 << 32
BLOCK = 1 << 20  # pairs held at once


def nearest_spans(x: np.ndarray, z: np.ndarray, at: tuple[np.ndarray, np.ndarray], spans: tuple[np.ndarray, ...], cells: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    """(span, width, t, rx, rz): for each point the span nearest to it of those in the nine cells around (ties: the first), -1 if there is none.

    ``at``: cells of the points; ``spans``: px, pz, qx, qz in order; ``cells``: cells of the spans.
    """
    px, pz, qx, qz = spans
    key = cells[0] * _STRIDE + cells[1]
    order = np.argsort(key, kind="stable")
    asked = (at[0] * _STRIDE + at[1])[:, None] + np.array([i * _STRIDE + j for i in (-1, 0, 1) for j in (-1, 0, 1)])
    low = np.searchsorted(key[order], asked)
    n = np.searchsorted(key[order], asked, "right") - low
    ends = np.cumsum(n.sum(1))
    out = (np.full(len(x), -1), *(np.zeros(len(x)) for _ in range(4)))
    a = 0
    while a < len(x):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + BLOCK, "right")))
        each, first = n[a:b].ravel(), low[a:b].ravel()
        j = order[np.arange(each.sum()) + np.repeat(first - np.cumsum(each) + each, each)]
        of = n[a:b].sum(1)
        i = np.repeat(np.arange(a, b), of)
        if len(i):
            dx, dz = qx[j] - px[j], qz[j] - pz[j]
            long2 = dx * dx + dz * dz
            with np.errstate(divide="ignore", invalid="ignore"):
                t = np.where(long2 < 1e-12, 0.0, np.fmax(0.0, np.fmin(1.0, ((x[i] - px[j]) * dx + (z[i] - pz[j]) * dz) / long2)))
            rx, rz = px[j] + dx * t, pz[j] + dz * t
            ox, oz = rx - x[i], rz - z[i]
            width = np.sqrt(ox * ox + oz * oz)
            best = np.lexsort((j, width, i))
            best = best[np.concatenate([[True], np.diff(i[best]) > 0])]
            for held, values in zip(out, (j, width, t, rx, rz)):
                held[i[best]] = values[best]
        a = b
    return out
