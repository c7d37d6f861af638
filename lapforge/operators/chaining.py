"""Chains of one border in plain arrays: what a task runs on a border that Spark hands it whole.

The same links and places as ``borders.cell_links`` and ``paths.ranked`` give by joins. Nodes are numbers from 0; port 2 n of node n is its +1 port, 2 n + 1 its -1 port.
"""

from __future__ import annotations

import numpy as np

_STRIDE = 1 << 32


def _neighbours(x: np.ndarray, z: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a < b) of points whose grid cells of ``size`` touch, each once."""
    at = np.flatnonzero(np.isfinite(x) & np.isfinite(z))
    key = np.floor(x[at] / size).astype(np.int64) * _STRIDE + np.floor(z[at] / size).astype(np.int64)
    order = np.argsort(key, kind="stable")
    at, key, pairs = at[order], key[order], []
    for shift in (0, 1, _STRIDE - 1, _STRIDE, _STRIDE + 1):
        low = np.searchsorted(key, key + shift) if shift else np.arange(1, len(key) + 1)
        n = np.searchsorted(key, key + shift, "right") - low
        i = np.repeat(np.arange(len(key)), n)
        j = np.arange(len(i)) + np.repeat(low - np.cumsum(n) + n, n)
        pairs.append((at[i], at[j]))
    i, j = (np.concatenate(p) for p in zip(*pairs))
    return np.minimum(i, j), np.maximum(i, j)


def links(x: np.ndarray, z: np.ndarray, hx: np.ndarray, hz: np.ndarray, step: float, forward: float, tangent: float) -> tuple[np.ndarray, np.ndarray]:
    """Ports that are linked (of a, of b): pairs that come first for both of their ports, round by round."""
    a, b = _neighbours(x, z, step)
    dx, dz = x[b] - x[a], z[b] - z[a]
    d = np.sqrt(dx * dx + dz * dz)
    near = (d > 0) & (d <= step)
    a, b, dx, dz, d = a[near], b[near], dx[near], dz[near], d[near]
    fa, fb = (dx * hx[a] + dz * hz[a]) / d, -((dx * hx[b] + dz * hz[b]) / d)
    ahead = np.minimum(np.abs(fa), np.abs(fb))
    good = (ahead >= forward) & (np.abs(hx[a] * hx[b] + hz[a] * hz[b]) >= tangent)
    a, b, fa, fb, score = a[good], b[good], fa[good], fb[good], d[good] / ahead[good]
    order = np.lexsort((b, a, score))
    pa, pb = (2 * a + (fa <= 0))[order], (2 * b + (fb <= 0))[order]
    chosen, used = [], np.zeros(2 * len(x), bool)
    while len(pa):
        n, first = np.arange(len(pa)), np.full(2 * len(x), len(pa))
        np.minimum.at(first, pa, n)
        np.minimum.at(first, pb, n)
        won = (first[pa] == n) & (first[pb] == n)
        chosen.append((pa[won], pb[won]))
        used[pa[won]] = used[pb[won]] = True
        rest = ~(used[pa] | used[pb])
        pa, pb = pa[rest], pb[rest]
    return tuple(np.concatenate(c) for c in zip(*chosen)) if chosen else (pa, pb)


def ranked(seed: np.ndarray, pa: np.ndarray, pb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(path, place, size) of every node by pointer jumping; ``seed`` orders the nodes, the least of a path names it, a ring is opened behind it."""
    link = np.full(2 * len(seed), -1)
    link[pa], link[pb] = pb, pa
    while True:
        end = link < 0
        to, hops = np.where(end, np.arange(len(link)), link ^ 1), (~end).astype(np.int64)
        least = np.repeat(seed, 2)
        for _ in range(len(seed).bit_length() + 1):
            least, hops, to = np.minimum(least, least[to]), hops + hops[to], to[to]
        opened = np.flatnonzero(~end[to[::2]] & (least[::2] == seed))
        if not len(opened):
            break
        behind = 2 * opened + 1
        link[link[behind]] = -1
        link[behind] = -1
    path = np.argsort(seed)[np.minimum(least[::2], least[1::2])]
    back = to[1::2] // 2
    return path, np.where(back == back[path], hops[1::2], hops[::2]), hops[::2] + hops[1::2] + 1
