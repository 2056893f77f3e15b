"""Unions, dissolves, line buffers and repair of polygons, by decomposition into trapezoids."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasieve.functions.wkt import rings_of


def _edges(polygons: list[list[np.ndarray]]) -> np.ndarray:
    """x1, y1, x2, y2, polygon of all non-vertical edges, left to right."""
    out = []
    for k, rings in enumerate(polygons):
        for p in rings:
            e = np.column_stack([p, np.roll(p, -1, axis=0), np.full(len(p), k)])
            swap = e[:, 0] > e[:, 2]
            e[swap] = e[swap][:, [2, 3, 0, 1, 4]]
            out.append(e[e[:, 0] < e[:, 2]])
    return np.concatenate(out) if out else np.empty((0, 5))


def _crossings(e: np.ndarray) -> np.ndarray:
    """x of all crossings of edges; edges are compared in order of x with those still open."""
    e = e[np.argsort(e[:, 0], kind="stable")]
    slope = (e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0])
    found, low, high = [], np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3])
    for i in range(len(e)):
        stop = int(np.searchsorted(e[:, 0], e[i, 2], side="left"))
        j = np.arange(i + 1, stop)
        j = j[(low[j] <= high[i]) & (high[j] >= low[i]) & (slope[j] != slope[i])]
        x = (e[j, 1] - slope[j] * e[j, 0] - e[i, 1] + slope[i] * e[i, 0]) / (slope[i] - slope[j])
        found.append(x[(x > np.maximum(e[i, 0], e[j, 0])) & (x < np.minimum(e[i, 2], e[j, 2]))])
    return np.concatenate(found) if found else np.empty(0)


def union_trapezoids(polygons: list[list[np.ndarray]]) -> np.ndarray:
    """Rows x1, low1, high1, x2, low2, high2 of disjoint trapezoids that cover the union.

    Each polygon is its rings by even-odd parity, which also repairs rings that cross themselves.
    The plane is cut into slabs at all vertices and crossings; in a slab no two edges cross.
    """
    e = _edges(polygons)
    if not len(e):
        return np.empty((0, 6))
    xs = np.unique(np.concatenate([e[:, 0], e[:, 2], _crossings(e)]))
    out = []
    slope = (e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0])
    for left, right in zip(xs[:-1], xs[1:]):
        if right - left <= 1e-12 * max(1.0, abs(left)):
            continue
        live = np.nonzero((e[:, 0] <= left) & (e[:, 2] >= right))[0]
        mid = e[live, 1] + ((left + right) / 2 - e[live, 0]) * slope[live]
        live = live[np.argsort(mid, kind="stable")]
        inside: set[int] = set()
        start = None
        for k in live:
            before = bool(inside)
            inside ^= {int(e[k, 4])}
            if not before and inside:
                start = k
            elif before and not inside:
                at = lambda i, x: e[i, 1] + (x - e[i, 0]) * slope[i]  # noqa: B023, E731
                out.append((left, at(start, left), at(k, left), right, at(start, right), at(k, right)))
    return np.array(out).reshape(-1, 6)


def trapezoid_area(t: np.ndarray) -> float:
    return float(np.sum((t[:, 3] - t[:, 0]) * ((t[:, 2] - t[:, 1]) + (t[:, 5] - t[:, 4])) / 2))


def trapezoid_wkt(t: np.ndarray) -> str:
    """MULTIPOLYGON of the trapezoids; POLYGON EMPTY for none."""
    if not len(t):
        return "POLYGON EMPTY"
    ring = lambda r: [(r[0], r[1]), (r[3], r[4]), (r[3], r[5]), (r[0], r[2]), (r[0], r[1])]
    return "MULTIPOLYGON (" + ", ".join("((" + ", ".join(f"{x!r} {y!r}" for x, y in ring([float(v) for v in r])) + "))" for r in t) + ")"


def _clipped(t: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> np.ndarray:
    """The trapezoids' parts inside a box, as trapezoids (cut where a side meets the box)."""
    box = [np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1]])]
    out = []
    for r in t:
        quad = np.array([[r[0], r[1]], [r[3], r[4]], [r[3], r[5]], [r[0], r[2]]])
        cells = _both([quad], box)
        out.append(cells)
    return np.concatenate(out) if out else np.empty((0, 6))


def _both(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Trapezoids of the intersection of two polygons."""
    e = _edges([a, b])
    xs = np.unique(np.concatenate([e[:, 0], e[:, 2], _crossings(e)])) if len(e) else np.empty(0)
    slope = (e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0]) if len(e) else e
    out = []
    for left, right in zip(xs[:-1], xs[1:]):
        live = np.nonzero((e[:, 0] <= left) & (e[:, 2] >= right))[0]
        live = live[np.argsort(e[live, 1] + ((left + right) / 2 - e[live, 0]) * slope[live], kind="stable")]
        inside, start = set(), None
        for k in live:
            before = len(inside) == 2
            inside ^= {int(e[k, 4])}
            if not before and len(inside) == 2:
                start = k
            elif before and len(inside) < 2:
                at = lambda i, x: e[i, 1] + (x - e[i, 0]) * slope[i]  # noqa: B023, E731
                out.append((left, at(start, left), at(k, left), right, at(start, right), at(k, right)))
    return np.array(out).reshape(-1, 6)


def segment_capsules(line: np.ndarray, distance: float, quad_segments: int = 1) -> list[list[np.ndarray]]:
    """One polygon a segment: all within distance, round ends drawn with quad_segments a quarter circle."""
    out = []
    for p, q in zip(line[:-1], line[1:]):
        way = np.arctan2(q[1] - p[1], q[0] - p[0]) if np.any(p != q) else 0.0
        turn = np.linspace(-np.pi / 2, np.pi / 2, 2 * quad_segments + 1)
        ends = [np.column_stack([c[0] + distance * np.cos(way + side + turn), c[1] + distance * np.sin(way + side + turn)]) for c, side in ((q, 0.0), (p, np.pi))]
        out.append([np.concatenate(ends)])
    return out


def buffer_lines(df: DataFrame, key: str, line_col: str, distance: float = 5.0, quad_segments: int = 1, factor_col: str | None = None) -> DataFrame:
    """(key, area, wkt): each row's buffer; line_col ARRAY<STRUCT<x, y>>, or an array of such lines, distance times factor_col where given.

    The buffer is the union of all segments' capsules, as disjoint trapezoids. Lines of fewer than
    two points or with null give an empty buffer.
    """
    key_type = df.schema[key].dataType.simpleString()
    one = df.schema[line_col].dataType.elementType.typeName() == "struct"
    lines = F.array(line_col) if one else F.col(line_col)
    xs, ys = F.transform(F.flatten(lines), lambda p: p["x"]), F.transform(F.flatten(lines), lambda p: p["y"])
    rows = df.select(key, xs.alias("_x"), ys.alias("_y"), F.transform(lines, F.size).alias("_n"), (F.lit(float(distance)) * (F.coalesce(F.col(factor_col).cast("double"), F.lit(1.0)) if factor_col else F.lit(1.0))).alias("_d"))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, x, y, n, d in zip(batch[key], batch["_x"], batch["_y"], batch["_n"], batch["_d"]):
                points = np.column_stack([x, y]).astype(float) if x is not None else np.empty((0, 2))
                parts = np.split(points, np.cumsum(n)[:-1]) if len(points) else []
                capsules = [c for line in parts if len(line) > 1 for c in segment_capsules(line, d, quad_segments)]
                t = union_trapezoids(capsules) if capsules else np.empty((0, 6))
                out.append((k, trapezoid_area(t), trapezoid_wkt(t)))
            yield pd.DataFrame(out, columns=[key, "area", "wkt"])

    return rows.mapInPandas(run, f"`{key}` {key_type}, area double, wkt string")


def repair(df: DataFrame, key: str, wkt_col: str) -> DataFrame:
    """(key, area, parts): each polygon's area by even-odd parity, also where rings cross themselves, and its trapezoids."""
    key_type = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = []
            for k, wkt in zip(batch[key], batch[wkt_col]):
                t = union_trapezoids(rings_of(wkt or ""))
                rows.append((k, trapezoid_area(t), len(t)))
            yield pd.DataFrame(rows, columns=[key, "area", "parts"])

    return df.select(key, wkt_col).mapInPandas(run, f"`{key}` {key_type}, area double, parts int")


def dissolve(df: DataFrame, class_col: str, wkt_col: str, cell: float, first: list[str] | None = None, order: str | None = None) -> DataFrame:
    """(class, cx, cy, area, wkt, ...): the union of each class's polygons, cell by cell of a grid.

    A polygon goes to every cell its box meets; each cell's union is clipped to the cell, so that a
    class with a third of all rows spreads over tasks, and areas of cells add up to the class's
    area. Equal polygons count once. first: columns of which the value of the first row, by order,
    comes along. Rows without polygon take no part; the null class is one class.
    """
    shape = {"_c": class_col, "_w": wkt_col}

    def spread(batches):
        for batch in batches:
            rows = []
            for c, wkt in zip(batch["_c"], batch["_w"]):
                parts = rings_of(wkt or "")
                if not parts:
                    continue
                p = np.concatenate([r for rings in parts for r in rings])
                for cx in range(int(np.floor(p[:, 0].min() / cell)), int(np.floor(p[:, 0].max() / cell)) + 1):
                    rows += [(c, cx, cy, wkt) for cy in range(int(np.floor(p[:, 1].min() / cell)), int(np.floor(p[:, 1].max() / cell)) + 1)]
            yield pd.DataFrame(rows, columns=["_c", "cx", "cy", "_w"])

    kind = df.schema[class_col].dataType.simpleString()
    placed = df.select(*[F.col(v).alias(k) for k, v in shape.items()]).mapInPandas(spread, f"_c {kind}, cx long, cy long, _w string").distinct()

    def unite(pdf: pd.DataFrame) -> pd.DataFrame:
        c, cx, cy = pdf["_c"].iloc[0], int(pdf["cx"].iloc[0]), int(pdf["cy"].iloc[0])
        t = union_trapezoids([rings for wkt in pdf["_w"] for rings in rings_of(wkt)])
        t = _clipped(t, cx * cell, cy * cell, (cx + 1) * cell, (cy + 1) * cell)
        return pd.DataFrame([(c, cx, cy, trapezoid_area(t), trapezoid_wkt(t))], columns=[class_col, "cx", "cy", "area", "wkt"])

    out = placed.groupBy("_c", "cx", "cy").applyInPandas(unite, f"`{class_col}` {kind}, cx long, cy long, area double, wkt string")
    if first:
        lead = df.groupBy(F.col(class_col).alias("_k")).agg(*[(F.min_by(c, order) if order else F.first(c)).alias(c) for c in first])
        out = out.join(lead, out[class_col].eqNullSafe(F.col("_k")), "left").drop("_k")
    return out
