"""Kernels on the lines of one network: what lies outside a polygon, and which way edges run."""

from __future__ import annotations

from collections import deque

import numpy as np


def inside(ring: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether places lie in a ring, by the even-odd rule."""
    out = np.zeros(len(places), bool)
    for (ax, ay), (bx, by) in zip(ring, np.roll(ring, -1, axis=0)):
        spans = (ay > places[:, 1]) != (by > places[:, 1])
        if spans.any():
            at = ax + (places[:, 1] - ay) * (bx - ax) / (by - ay)
            out ^= spans & (places[:, 0] < at)
    return out


def _crossings(p: np.ndarray, q: np.ndarray, ring: np.ndarray) -> list[float]:
    """Where a segment meets a ring, as fractions of the segment, in order."""
    a, b = ring, np.roll(ring, -1, axis=0)
    d, e = q - p, b - a
    cross = d[0] * e[:, 1] - d[1] * e[:, 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = ((a[:, 0] - p[0]) * e[:, 1] - (a[:, 1] - p[1]) * e[:, 0]) / cross
        u = ((a[:, 0] - p[0]) * d[1] - (a[:, 1] - p[1]) * d[0]) / cross
    return sorted(set(t[(cross != 0) & (t > 0) & (t < 1) & (u >= 0) & (u <= 1)].tolist()))


def outside(line: np.ndarray, ring: np.ndarray) -> list[tuple[np.ndarray, bool, bool]]:
    """Parts of a line outside a ring: (vertices, begins with the line, ends with it)."""
    points, spots = [line[0]], [0.0]
    for i in range(len(line) - 1):
        for t in _crossings(line[i], line[i + 1], ring):
            points.append(line[i] + t * (line[i + 1] - line[i]))
            spots.append(i + t)
        points.append(line[i + 1])
        spots.append(i + 1.0)
    p = np.array(points)
    if len(p) < 2:
        return []
    out_ = ~inside(ring, (p[:-1] + p[1:]) / 2)
    parts, start = [], None
    for i, o in enumerate([*out_.tolist(), False]):
        if o and start is None:
            start = i
        elif not o and start is not None:
            parts.append((p[start : i + 1], start == 0, i == len(p) - 1))
            start = None
    return parts


def _heading(line: np.ndarray) -> np.ndarray:
    d = line[-1] - line[0]
    size = float(np.hypot(*d))
    return d / size if size else np.zeros(2)


def directions(lines: dict[int, np.ndarray], ends: dict[int, tuple], faces: dict[int, list[int]], outer: list[np.ndarray], flip_outliers: bool = False) -> tuple[dict[int, bool], dict[int, bool]]:
    """(turned, known) of each edge: by the outer banks it shares over two vertices with, then from face to face."""
    turned, known = dict.fromkeys(lines, False), dict.fromkeys(lines, False)
    for bank in outer:
        place = {(float(x), float(y)): i for i, (x, y) in reversed(list(enumerate(bank)))}
        for k, line in lines.items():
            met = [place[v] for v in map(tuple, line.tolist()) if v in place]
            if len(met) > 2 and not known[k]:
                turned[k], known[k] = met[-1] < met[0], True
    heading = {k: _heading(line) for k, line in lines.items()}
    towards = lambda k: -heading[k] if turned[k] else heading[k]
    of: dict[int, list[int]] = {}
    for f, around in faces.items():
        for k in around:
            of.setdefault(k, []).append(f)
    todo = deque(sorted(f for f, around in faces.items() if any(known.get(k) for k in around)))
    done: set[int] = set()
    while todo:
        f = todo.popleft()
        if f in done:
            continue
        done.add(f)
        sure = [k for k in faces[f] if known.get(k)]
        total = sum((towards(k) for k in sure), np.zeros(2))
        for k in faces[f]:
            if k in lines and not known[k]:
                turned[k], known[k] = bool(heading[k] @ total < 0), True
        todo.extend(sorted({g for k in faces[f] for g in of.get(k, ()) if g not in done}))
    if flip_outliers:
        touching: dict = {}
        for k, nodes in ends.items():
            for n in nodes:
                touching.setdefault(n, set()).add(k)
        for k in sorted(lines):
            near, front = {k}, {k}
            for _ in range(3):
                front = {j for i in front for n in ends[i] for j in touching[n]} - near
                near |= front
            mean = sum((towards(j) for j in near - {k}), np.zeros(2))
            size = float(np.hypot(*mean))
            if size and np.arccos(np.clip(towards(k) @ mean / size, -1, 1)) > np.pi / 1.8:
                turned[k] = not turned[k]
    return turned, known
