"""Main directions of a cloud's convex hull, and the frames that pairs of them give."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthant.operators.cells import spatial_representatives


def outline(points: DataFrame, parts: int = 20) -> np.ndarray:
    """One position for each cell of a grid of ``parts`` cells along the longest side, and the extremes of all axes.

    At most ``(parts + 1) ** 3 + 6`` positions, whatever the cloud's size; they
    depend on the positions alone, not on copies or order.
    """
    points = points.select("id", "x", "y", "z")
    ends = points.agg(
        *[F.min(a).alias("l" + a) for a in "xyz"], *[F.max(a).alias("h" + a) for a in "xyz"],
        *[f(F.struct(a, *[b for b in "xyz" if b != a])).alias(n + a) for n, f in (("first_", F.min), ("last_", F.max)) for a in "xyz"],
    ).first()
    if ends["lx"] is None:
        return np.zeros((0, 3))
    extent = max(ends["h" + a] - ends["l" + a] for a in "xyz") or 1.0
    chosen = spatial_representatives(points, extent / parts, [ends["l" + a] for a in "xyz"]).select("id")
    rows = points.join(chosen, "id", "left_semi").select("x", "y", "z").distinct().collect()  # at most (parts + 1) ** 3
    rows = [tuple(r) for r in rows] + [tuple(ends[n + a][b] for b in "xyz") for n in ("first_", "last_") for a in "xyz"]
    return np.array(sorted(set(rows)))


def facets(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Outward unit normals and areas of the triangles of the convex hull of positions in space; none if they are flat.

    The farthest position outside is taken in, the faces that see it give way
    to a fan over their border, and the positions behind them look for a new
    face.
    """
    none = np.zeros((0, 3)), np.zeros(0)
    if len(p) < 4:
        return none
    p = p - p.mean(axis=0)
    size = np.abs(p).max() or 1.0
    p, eps = p / size, 1e-11
    a = int(np.argmin(p[:, 0]))
    b = int(np.argmax(np.linalg.norm(p - p[a], axis=1)))
    c = int(np.argmax(np.linalg.norm(np.cross(p - p[a], p[b] - p[a]), axis=1)))
    normal = np.cross(p[b] - p[a], p[c] - p[a])
    d = int(np.argmax(np.abs((p - p[a]) @ normal)))
    if abs((p[d] - p[a]) @ normal) <= eps:
        return none
    middle = p[[a, b, c, d]].mean(axis=0)

    def plane(tri: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.cross(p[tri[:, 1]] - p[tri[:, 0]], p[tri[:, 2]] - p[tri[:, 0]])
        n /= np.maximum(np.linalg.norm(n, axis=1), 1e-300)[:, None]
        return n, (n * p[tri[:, 0]]).sum(axis=1)

    tri = np.array([t for t in combinations((a, b, c, d), 3)])
    n, off = plane(tri)
    flip = n @ middle > off
    tri[flip] = tri[flip][:, [0, 2, 1]]
    n, off = plane(tri)
    away = p @ n.T - off
    owner, height = away.argmax(axis=1), away.max(axis=1)
    while height.max() > eps:
        top = int(height.argmax())
        seen = n @ p[top] - off > eps
        seen[owner[top]] = True
        edges = np.concatenate([tri[seen][:, [i, (i + 1) % 3]] for i in range(3)])
        both = set(map(tuple, edges.tolist()))
        border = np.array([e for e in both if (e[1], e[0]) not in both])
        behind = np.flatnonzero(seen[owner] & (height > eps))
        fan = np.column_stack((border, np.full(len(border), top)))
        number = np.cumsum(~seen) - 1
        owner = np.where(seen[owner], 0, number[owner])
        fn, foff = plane(fan)
        away = p[behind] @ fn.T - foff
        owner[behind], height[behind] = (~seen).sum() + away.argmax(axis=1), away.max(axis=1)
        height[top] = 0.0
        tri, n, off = np.concatenate((tri[~seen], fan)), np.concatenate((n[~seen], fn)), np.concatenate((off[~seen], foff))
    area = np.linalg.norm(np.cross(p[tri[:, 1]] - p[tri[:, 0]], p[tri[:, 2]] - p[tri[:, 0]]), axis=1) / 2 * size * size
    return n[area > 1e-15], area[area > 1e-15]


def _polygon_sides(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions and lengths of the sides of the convex hull of positions in a plane."""
    order = p[np.lexsort((p[:, 1], p[:, 0]))]

    def half(rows: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for q in rows:
            while len(out) > 1 and np.linalg.det(np.stack((out[-1] - out[-2], q - out[-1]))) <= 1e-14:
                out.pop()
            out.append(q)
        return out[:-1]

    ring = np.array(half(order) + half(order[::-1]))
    sides = np.roll(ring, -1, axis=0) - ring
    length = np.linalg.norm(sides, axis=1)
    return sides[length > 0] / length[length > 0, None], length[length > 0]


def _grouped(ways: np.ndarray, mass: np.ndarray, degrees: float, least: float) -> list[tuple[np.ndarray, float]]:
    """Directions, whatever their sign, gathered around the heaviest ones; groups below a share of ``least`` go."""
    found, total, free = [], mass.sum(), np.ones(len(ways), bool)
    while free.any():
        lead = ways[np.flatnonzero(free)[np.argmax(mass[free])]]
        for _ in range(2):
            near = free & (np.abs(ways @ lead) >= np.cos(np.radians(degrees)))
            mean = (np.sign(ways[near] @ lead)[:, None] * ways[near] * mass[near, None]).sum(axis=0)
            lead = mean / np.linalg.norm(mean)
        near |= free & (np.abs(ways @ lead) >= np.cos(np.radians(degrees)))
        free &= ~near
        if mass[near].sum() >= least * total:
            found.append((lead * (1 if lead[np.abs(lead).argmax()] > 0 else -1), float(mass[near].sum() / total)))
    return sorted(found, key=lambda f: (-f[1], *f[0]))


def hull_directions(points: DataFrame, parts: int = 20, *, degrees: float = 8.0, least: float = 0.035) -> list[tuple[np.ndarray, float]]:
    """Main normals of the cloud's hull with their shares of its area, largest first.

    Of a flat cloud: its own normal with a share of 1, and the directions of
    its outline's sides with their shares of the length. None of a line.
    """
    p = outline(points, parts)
    if len(p) < 3:
        return []
    values, axes = np.linalg.eigh(np.cov(p.T))
    if values[1] <= 1e-12 * values[2]:
        return []
    if values[0] <= 1e-12 * values[2]:
        sides, length = _polygon_sides((p - p.mean(axis=0)) @ axes[:, 1:])
        return [(axes[:, 0], 1.0), *_grouped(sides @ axes[:, 1:].T, length, degrees, least)]
    return _grouped(*facets(p), degrees, least)


def frames_of(directions: list[tuple[np.ndarray, float]], degrees: float = 12.0) -> list[np.ndarray]:
    """Right-handed frames of all pairs that stand square within ``degrees``, best first."""
    found = []
    for (a, wa), (b, wb) in combinations(directions, 2):
        slant = abs(float(a @ b))
        if slant <= np.sin(np.radians(degrees)):
            u, _, v = np.linalg.svd(np.column_stack((a, b, np.cross(a, b))))
            frame = u @ v
            found.append(((wa + wb) * (1 - slant), frame if np.linalg.det(frame) > 0 else frame * [1, 1, -1]))
    return [frame for _, frame in sorted(found, key=lambda f: -f[0])]
