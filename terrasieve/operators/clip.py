"""Features cut to boxes: the geometry itself, not only its share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasieve.functions.wkt import rings_of


def _signed_area(p: np.ndarray) -> float:
    q = np.roll(p, -1, axis=0) - p[0]
    u = p - p[0]
    return float(np.sum(u[:, 0] * q[:, 1] - u[:, 1] * q[:, 0]) / 2)


def _half_plane(rings: list[np.ndarray], axis: int, at: float, keep_less: bool) -> list[np.ndarray]:
    """The rings' part on one side of an axis-parallel line.

    Exteriors run counter-clockwise and holes clockwise, so that the interior lies to the left.
    Each ring is cut into chains on the kept side; along the line the interior lies between an
    exit and the next entry (seen in the right direction), which joins the chains to rings again.
    """
    along = 1 - axis
    turn = 1.0 if (axis == 1) != keep_less else -1.0  # direction of the line in which the interior lies between an exit and the next entry
    out, chains = [], []
    for p in rings:
        d = (at - p[:, axis]) if keep_less else (p[:, axis] - at)
        on = d > 0
        if on.all():
            out.append(p)
            continue
        if not on.any():
            continue
        n = len(p)
        begin = next(i for i in range(n) if on[i] and not on[i - 1])
        cross = lambda i, j: _cross(p[i], p[j], d[i], d[j], axis, at)  # noqa: B023, E731
        i = begin
        while True:
            chain = [cross((i - 1) % n, i % n)]
            while on[i % n]:
                chain.append(p[i % n])
                i += 1
            chain.append(cross((i - 1) % n, i % n))
            chains.append(np.array(chain))
            while not on[i % n] and i % n != begin:
                i += 1
            if i % n == begin:
                break
    if not chains:
        return out
    ends = [(turn * c[-1][along], k) for k, c in enumerate(chains)]  # exits
    starts = [(turn * c[0][along], k) for k, c in enumerate(chains)]  # entries
    ends.sort()
    starts.sort()
    following = {e[1]: s[1] for e, s in zip(ends, starts)}
    while following:
        first, k = next(iter(following.items()))
        parts, at_chain = [chains[first]], following.pop(first)
        while at_chain != first:
            parts.append(chains[at_chain])
            at_chain = following.pop(at_chain)
        out.append(np.concatenate(parts))
    return out


def _cross(p: np.ndarray, q: np.ndarray, dp: float, dq: float, axis: int, at: float) -> np.ndarray:
    r = p + (q - p) * (dp / (dp - dq))
    r[axis] = at
    return r


def _clean(p: np.ndarray) -> np.ndarray:
    """Without repeated vertices, the last not the first again."""
    keep = np.any(p != np.roll(p, 1, axis=0), axis=1)
    return p[keep]


def clip_polygon(parts: list[list[np.ndarray]], box: tuple[float, float, float, float]) -> list[list[np.ndarray]]:
    """The parts (exterior, holes) of a polygon inside a box; exteriors counter-clockwise, holes clockwise; [] without area in common."""
    out = []
    for rings in parts:
        turned = []
        for k, p in enumerate(rings):
            p = _clean(p)
            if len(p) > 2:
                turned.append(p if (_signed_area(p) > 0) == (k == 0) else p[::-1])
        for axis, at, less in ((0, box[0], False), (1, box[1], False), (0, box[2], True), (1, box[3], True)):
            turned = [c for p in _half_plane(turned, axis, at, less) if len(c := _clean(p)) > 2]
        areas = [_signed_area(p) for p in turned]
        shells = [[p] for p, a in zip(turned, areas) if a > 0]
        for p, a in zip(turned, areas):
            if a < 0:
                home = next((s for s in shells if _inside(s[0], p)), None)
                if home is not None:
                    home.append(p)
        out += shells
    return out


def _inside(shell: np.ndarray, hole: np.ndarray) -> bool:
    """Whether a hole lies in a shell it doesn't cross, by the middle of one of its edges."""
    x, y = (hole[0] + hole[1]) / 2
    q = np.roll(shell, -1, axis=0)
    over = (shell[:, 1] > y) != (q[:, 1] > y)
    with np.errstate(all="ignore"):
        at = shell[:, 0] + (y - shell[:, 1]) * (q[:, 0] - shell[:, 0]) / (q[:, 1] - shell[:, 1])
    return bool(np.sum(over & (x < at)) % 2)


def clip_line(line: np.ndarray, box: tuple[float, float, float, float]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(lines, points): the pieces of a line inside a closed box, and places where it only touches the box."""
    lines: list[list[np.ndarray]] = []
    touches = []
    for p, q in zip(line[:-1], line[1:]):
        t0, t1, d = 0.0, 1.0, q - p
        for axis in (0, 1):
            lo, hi = box[axis] - p[axis], box[axis + 2] - p[axis]
            if d[axis] == 0:
                if lo > 0 or hi < 0:
                    t0, t1 = 1.0, 0.0
                continue
            a, b = sorted((lo / d[axis], hi / d[axis]))
            t0, t1 = max(t0, a), min(t1, b)
        if t0 > t1:
            continue
        a, b = (p + t * d if 0 < t < 1 else (p if t <= 0 else q) for t in (t0, t1))
        if t0 == t1 or np.array_equal(a, b):
            touches.append(a)
        elif lines and np.array_equal(lines[-1][-1], a):
            lines[-1].append(b)
        else:
            lines.append([a, b])
    pieces = [np.array(x) for x in lines]
    alone = [t for t in touches if not any((x == t).all(1).any() for x in pieces)]
    return pieces, [t for k, t in enumerate(alone) if not any(np.array_equal(t, u) for u in alone[:k])]


def _ring_text(p: np.ndarray) -> str:
    return "(" + ", ".join(f"{x!r} {y!r}" for x, y in [*p.tolist(), p[0].tolist()]) + ")"


def polygon_text(parts: list[list[np.ndarray]]) -> str:
    """WKT of closed rings given without their last vertex; numbers keep all their digits."""
    bodies = ["(" + ", ".join(map(_ring_text, rings)) + ")" for rings in parts]
    return "POLYGON EMPTY" if not bodies else f"POLYGON {bodies[0]}" if len(bodies) == 1 else f"MULTIPOLYGON ({', '.join(bodies)})"


def line_text(pieces: list[np.ndarray], points: list[np.ndarray]) -> tuple[str, str]:
    """(kind, WKT) of what is left of a line; lines and points together are a GeometryCollection."""
    body = lambda p: "(" + ", ".join(f"{x!r} {y!r}" for x, y in p.tolist()) + ")"
    if pieces and points:
        return "GeometryCollection", "GEOMETRYCOLLECTION (" + ", ".join([f"LINESTRING {body(p)}" for p in pieces] + [f"POINT ({p[0]!r} {p[1]!r})" for p in points]) + ")"
    if points:
        one = len(points) == 1
        return ("Point", f"POINT {body(points[0][None])}") if one else ("MultiPoint", "MULTIPOINT " + body(np.array(points)))
    if not pieces:
        return "LineString", "LINESTRING EMPTY"
    return ("LineString", f"LINESTRING {body(pieces[0])}") if len(pieces) == 1 else ("MultiLineString", f"MULTILINESTRING ({', '.join(map(body, pieces))})")


def _line_of(wkt: str) -> np.ndarray:
    head, _, body = wkt.partition("(")
    if not head.strip().upper().startswith("LINESTRING"):
        return np.empty((0, 2))
    try:
        return np.array([[float(v) for v in p.split()[:2]] for p in body.rstrip(" )").split(",")]).reshape(-1, 2)
    except ValueError:
        return np.empty((0, 2))


def cut_features(pairs: DataFrame, wkt_col: str, box: list[str], kind: str = "Polygon", least_share: float = 0.0, orig_area: str | None = None, orig_length: str | None = None, transform: list[str] | None = None) -> DataFrame:
    """pairs plus geometry (WKT of the part inside the box), kind, origarea, origlen, partialDec and truncated.

    kind Polygon: origarea is the column orig_area where it isn't null, else the feature's own
    area, origlen the column or 0; partialDec is the cut area over origarea; features of a share up
    to least_share drop out, and truncated tells a share other than 1 (within 1e-9, which is
    rounding). kind LineString: origarea is the column or 0, origlen the column or the line's
    length; what is cut to a GeometryCollection or to nothing drops out, partialDec is 1 and
    truncated 0. transform: columns tr_a..tr_f of the chip; pix_geometry is then the cut in its
    pixels. Texts of another kind and null boxes give nothing. Columns of these names in pairs are replaced.
    """
    if kind not in ("Polygon", "LineString"):
        raise ValueError("kind must be Polygon or LineString")
    names = ["geometry", "kind", "origarea", "origlen", "partialDec", "truncated", *(["pix_geometry"] if transform else [])]
    null = F.lit(None).cast("double")
    column = lambda c: F.col(c).cast("double") if c else null
    given = pairs.withColumns({"_cut_area": column(orig_area), "_cut_length": column(orig_length)})
    fields = [f for f in pairs.schema.fields if f.name not in names]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "geometry string, kind string, origarea double, origlen double, partialDec double, truncated int", *(["pix_geometry string"] if transform else [])])

    def pixels(p: np.ndarray, tr) -> np.ndarray:
        a, b, c, d, e, f = tr
        det, x, y = a * e - b * d, p[:, 0] - c, p[:, 1] - f
        return np.column_stack([(e * x - b * y) / det, (a * y - d * x) / det])

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, at = [], []
            corners, areas, lengths = batch[box].to_numpy(float), batch["_cut_area"].to_numpy(float), batch["_cut_length"].to_numpy(float)
            trs = batch[transform].to_numpy(float) if transform else None
            for k, wkt in enumerate(batch[wkt_col]):
                if not wkt or np.isnan(corners[k]).any():
                    continue
                if kind == "Polygon":
                    parts = rings_of(wkt)
                    own = sum(abs(_signed_area(_clean(r))) * (1 if i == 0 else -1) for rings in parts for i, r in enumerate(rings) if len(_clean(r)) > 2)
                    area = own if np.isnan(areas[k]) else areas[k]
                    cut = clip_polygon(parts, tuple(corners[k]))
                    share = sum(_signed_area(r) for rings in cut for r in rings) / area if area else 0.0
                    if share <= least_share + 1e-9:
                        continue
                    row = [polygon_text(cut), "Polygon" if len(cut) == 1 else "MultiPolygon", area, 0.0 if np.isnan(lengths[k]) else lengths[k], share, int(abs(share - 1) > 1e-9)]
                    if transform:
                        row.append(polygon_text([[pixels(r, trs[k]) for r in rings] for rings in cut]))
                else:
                    line = _line_of(wkt)
                    pieces, points = clip_line(line, tuple(corners[k])) if len(line) > 1 else ([], [])
                    what, text = line_text(pieces, points)
                    if what == "GeometryCollection" or not (pieces or points):
                        continue
                    row = [text, what, 0.0 if np.isnan(areas[k]) else areas[k], float(np.hypot(*np.diff(line, axis=0).T).sum()) if np.isnan(lengths[k]) else lengths[k], 1.0, 0]
                    if transform:
                        row.append(line_text([pixels(p, trs[k]) for p in pieces], [pixels(p[None], trs[k])[0] for p in points])[1])
                rows.append(row)
                at.append(k)
            out = batch.iloc[at][[f.name for f in fields]].reset_index(drop=True)
            yield pd.concat([out, pd.DataFrame(rows, columns=names).reset_index(drop=True)], axis=1)

    return given.mapInPandas(run, schema)
