"""Clustering kernels on plain arrays; no Spark here.

All take hits in time order and return a cluster number for each hit.
"""

from __future__ import annotations

import numpy as np

from hitweave.model import CHIP, JOIN_TICKS


class Clusters:
    """Open clusters of a pixel-list clustering.

    A hit joins every cluster that has owned a pixel around it and whose last hit is less than
    ``max_dt`` ticks ago, however old the neighbouring hit itself is; several are merged.
    """

    def __init__(self, max_dt: int = JOIN_TICKS, tile: int = 1):
        if CHIP % tile:
            raise ValueError("the tile size must divide 256")
        self.max_dt, self.tile, self.side = max_dt, tile, CHIP // tile
        self.owner: dict[int, int] = {}
        self.parent: list[int] = []
        self.first: list[int] = []
        self.last: list[int] = []

    def root(self, c: int) -> int:
        while self.parent[c] != c:
            self.parent[c] = self.parent[self.parent[c]]
            c = self.parent[c]
        return c

    def add(self, tick: int, x: int, y: int) -> int:
        tx, ty = x // self.tile, y // self.tile
        near: list[int] = []
        for nx in range(max(0, tx - 1), min(self.side, tx + 2)):
            for ny in range(max(0, ty - 1), min(self.side, ty + 2)):
                c = self.owner.get(nx * self.side + ny)
                if c is not None:
                    c = self.root(c)
                    if c not in near and abs(tick - self.last[c]) < self.max_dt:
                        near.append(c)
        if near:
            own = min(near, key=lambda c: (self.first[c], c))
            for c in near:
                self.parent[c] = own
                self.last[own] = max(self.last[own], self.last[c])
            self.extend(own, tick)
        else:
            own = len(self.parent)
            self.parent.append(own)
            self.first.append(tick)
            self.last.append(tick)
        self.owner[tx * self.side + ty] = own
        return own

    def extend(self, c: int, tick: int) -> None:
        self.first[c], self.last[c] = min(self.first[c], tick), max(self.last[c], tick)


def pixel_list(tick: np.ndarray, x: np.ndarray, y: np.ndarray, max_dt: int = JOIN_TICKS, tile: int = 1) -> list[int]:
    state = Clusters(max_dt, tile)
    own = [state.add(*h) for h in zip(tick.tolist(), x.tolist(), y.tolist(), strict=True)]
    return [state.root(c) for c in own]


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest row of its component under the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def neighbours(session: np.ndarray, tick: np.ndarray, x: np.ndarray, y: np.ndarray, max_dt: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows of one session that are neighbouring pixels and at most ``max_dt`` ticks apart; rows in time order."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    alive, d = np.arange(len(tick) - 1), 0
    while len(alive):
        d += 1
        alive = alive[alive + d < len(tick)]
        other = alive + d
        on = (session[other] == session[alive]) & (tick[other] - tick[alive] <= max_dt)
        alive, other = alive[on], other[on]
        near = (np.abs(x[other] - x[alive]) <= 1) & (np.abs(y[other] - y[alive]) <= 1)
        left.append(alive[near])
        right.append(other[near])
    return np.concatenate(left), np.concatenate(right)


def split_groups(session: np.ndarray, tick: np.ndarray, x: np.ndarray, y: np.ndarray, max_dt: int) -> np.ndarray:
    """Connected components, in each session, of hits that are neighbours and at most ``max_dt`` ticks apart."""
    return joined(len(tick), *neighbours(session, tick, x.astype(np.int32), y.astype(np.int32), max_dt))


def pixel_list_sessions(session: np.ndarray, tick: np.ndarray, x: np.ndarray, y: np.ndarray, max_dt: int = JOIN_TICKS, tile: int = 1) -> np.ndarray:
    """Pixel-list labels of many sessions in time order, by the number of a row in the cluster.

    In a session shorter than ``max_dt`` no pixel is ever too old, so its clusters are the connected
    parts of its pixels, which all such sessions get at once; only longer ones go hit by hit.
    """
    edge = np.append(np.flatnonzero(np.append(True, session[1:] != session[:-1])), len(session)) if len(session) else np.zeros(1, np.int64)
    size = np.diff(edge)
    short = (tick[edge[1:] - 1] - tick[edge[:-1]] < max_dt) & (size <= 256) if len(size) else np.zeros(0, bool)
    label = np.arange(len(session))
    at = np.flatnonzero(np.repeat(short, size))
    own = neighbours(session[at], tick[at], (x[at] // tile).astype(np.int32), (y[at] // tile).astype(np.int32), max_dt)
    label[at] = at[joined(len(at), *own)]
    for s in np.flatnonzero(~short).tolist():
        rows = np.arange(edge[s], edge[s + 1])
        _, group = np.unique(pixel_list(tick[rows], x[rows], y[rows], max_dt, tile), return_inverse=True)
        first = np.full(group.max() + 1, len(session))
        np.minimum.at(first, group, rows)
        label[rows] = first[group]
    return label


def each_session(session: np.ndarray, kernel, *columns: np.ndarray) -> np.ndarray:
    """Labels of a kernel for single sessions, made different from session to session."""
    out, made = np.zeros(len(session), np.int64), 0
    edges = [*np.flatnonzero(np.append(True, session[1:] != session[:-1])).tolist(), len(session)] if len(session) else [0]
    for start, end in zip(edges, edges[1:], strict=False):
        own = np.array(kernel(*(c[start:end] for c in columns)))
        out[start:end] = made + own
        made += int(own.max()) + 1
    return out


def halo_boxes(tick: np.ndarray, x: np.ndarray, y: np.ndarray, e: np.ndarray, window: int, threshold: float = 120.0, max_dt: int = JOIN_TICKS, tile: int = 2) -> list[int]:
    """Halo clustering: hot hits form clusters whose boxes draw in the other hits of a buffer.

    A buffer opens with a hit and takes hits up to ``window`` ticks later.
    """
    out = [0] * len(tick)
    start, made = 0, 0
    ticks, xs, ys = tick.tolist(), x.tolist(), y.tolist()
    hot = (e >= threshold).tolist()
    while start < len(ticks):
        end = start
        while end < len(ticks) and ticks[end] - ticks[start] <= window:
            end += 1
        state = Clusters(max_dt, tile)
        own: dict[int, int] = {i: state.add(ticks[i], xs[i], ys[i]) for i in range(start, end) if hot[i]}
        roots: dict[int, list[int]] = {}
        for i, c in own.items():
            roots.setdefault(state.root(c), []).append(i)
        # oldest first hit first; a box is a pixel wider on each side, within the chip
        opened = sorted(roots, key=lambda c: c)
        boxes = {c: (max(min(xs[i] for i in h) - 1, 0), min(max(xs[i] for i in h) + 1, CHIP - 1), max(min(ys[i] for i in h) - 1, 0), min(max(ys[i] for i in h) + 1, CHIP - 1)) for c, h in roots.items()}
        begin = 0
        for i in range(start, end):
            if begin >= len(opened):
                break
            if i in own:
                continue
            at = begin
            while at < len(opened):
                c = opened[at]
                if not (state.first[c] - ticks[i] < max_dt and ticks[i] - state.last[c] < max_dt):
                    break
                left, right, top, bottom = boxes[c]
                if left <= xs[i] <= right and top <= ys[i] <= bottom:
                    own[i] = c
                    state.owner[(xs[i] // tile) * state.side + ys[i] // tile] = c
                    state.extend(c, ticks[i])
                    break
                at += 1
            if at < len(opened) and ticks[i] - state.last[opened[at]] > max_dt:
                begin += 1
        for i in range(start, end):
            if i not in own:
                own[i] = state.add(ticks[i], xs[i], ys[i])
        for i in range(start, end):
            out[i] = made + state.root(own[i])
        made += len(state.parent)
        start = end
    return out


def halo_width(x: np.ndarray, y: np.ndarray, e: np.ndarray, threshold: float = 50.0, full: float = 0.74) -> list[tuple[float, int]]:
    """(energy, halo width) of the hits above the threshold; nothing if the cluster touches the chip's edge.

    The width is the largest r such that all rings 1 to r around the hit are full enough.  A ring's
    first corner counts twice.
    """
    if not len(x) or min(x.min(), y.min()) == 0 or max(x.max(), y.max()) == CHIP - 1:
        return []
    there = set(zip(x.tolist(), y.tolist(), strict=True))
    out = []
    for px, py, energy in zip(x.tolist(), y.tolist(), e.tolist(), strict=True):
        if energy <= threshold:
            continue
        r = 0
        while True:
            r += 1
            n = (px + r, py + r) in there
            for i in range(-r, r):
                n += ((px + i, py - r) in there) + ((px - r, py + i) in there) + ((px + r, py + i) in there) + ((px + i, py + r) in there)
            if n / (8 * r) < full:
                break
        out.append((energy, r - 1))
    return out
