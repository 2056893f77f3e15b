"""Geometry as nested arrays, computed by Column expressions.

    POINT  STRUCT<x, y>        RING  ARRAY<POINT>
    POLYGON ARRAY<RING>        first the exterior, then holes
    MULTI  ARRAY<POLYGON>      the form all functions take; an empty geometry is an empty array
    BOX    STRUCT<xmin, ymin, xmax, ymax>

Null geometry gives null; an empty one gives area 0, length 0, and a null box and centroid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MULTI_TYPE = "array<array<array<struct<x:double,y:double>>>>"


def point(x, y) -> Column:
    return F.struct(F.lit(x).cast("double").alias("x") if not isinstance(x, Column) else x.cast("double").alias("x"), (F.lit(y) if not isinstance(y, Column) else y).cast("double").alias("y"))


def _position(text: Column) -> Column:
    xy = F.split(F.trim(text), r"\s+")
    return F.struct(xy[0].try_cast("double").alias("x"), xy[1].try_cast("double").alias("y"))


def parse_wkt(wkt: Column) -> Column:
    """MULTI of a POLYGON or MULTIPOLYGON text; heights are dropped; EMPTY is the empty array."""
    body = F.regexp_replace(wkt, r"(?i)^\s*(SRID\s*=\s*\d+\s*;)?\s*(MULTI)?POLYGON\s*Z?\s*", "")
    ring = lambda r: F.transform(F.split(F.regexp_replace(r, r"[()]", ""), ","), _position)
    parts = F.transform(F.split(body, r"\)\s*\)\s*,\s*\(\s*\("), lambda p: F.transform(F.split(p, r"\)\s*,\s*\("), ring))
    kind = wkt.rlike(r"(?i)^\s*(SRID\s*=\s*\d+\s*;)?\s*(MULTI)?POLYGON")
    return F.when(kind & body.rlike(r"(?i)^EMPTY"), F.array().cast(MULTI_TYPE)).when(kind, parts)


def once(df: DataFrame, keep: list, **columns: Column) -> DataFrame:
    """keep and the new columns, each worked out once a row: the optimizer doesn't merge a generator with what uses it,
    whereas a long expression is else repeated wherever its column occurs."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def parse_line(wkt: Column) -> Column:
    """RING of a LINESTRING text."""
    body = F.regexp_extract(wkt, r"(?i)^\s*LINESTRING\s*Z?\s*\(([^()]*)\)", 1)
    return F.when(body != "", F.transform(F.split(body, ","), _position))


def line_wkt(line: Column) -> Column:
    """LINESTRING text with all digits."""
    return F.concat(F.lit("LINESTRING ("), F.array_join(F.transform(line, lambda p: F.concat(p["x"].cast("string"), F.lit(" "), p["y"].cast("string"))), ", "), F.lit(")"))


def _number(x: Column, decimals: int) -> Column:
    return F.format_string(f"%.{decimals}f", F.bround(x, decimals))


def format_ring(ring: Column, decimals: int) -> Column:
    return F.concat(F.lit("("), F.array_join(F.transform(ring, lambda p: F.concat(_number(p["x"], decimals), F.lit(" "), _number(p["y"], decimals))), ", "), F.lit(")"))


def format_wkt(multi: Column, decimals: int = 2) -> Column:
    """POLYGON or MULTIPOLYGON text with fixed decimals, halves rounded to even."""
    part = lambda p: F.concat(F.lit("("), F.array_join(F.transform(p, lambda r: format_ring(r, decimals)), ", "), F.lit(")"))
    text = F.array_join(F.transform(multi, part), ", ")
    return F.when(F.size(multi) == 0, "POLYGON EMPTY").when(F.size(multi) == 1, F.concat(F.lit("POLYGON "), text)).otherwise(F.concat(F.lit("MULTIPOLYGON ("), text, F.lit(")")))


def map_points(multi: Column, f) -> Column:
    """MULTI with f(x, y) -> (x, y) applied to every vertex."""
    def one(p):
        x, y = f(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(multi, lambda part: F.transform(part, lambda r: F.transform(r, one)))


def geo_to_pixel(a: Column, b: Column, c: Column, d: Column, e: Column, f: Column):
    """The inverse of the affine x = a*col + b*row + c, y = d*col + e*row + f, as a function of (x, y)."""
    det = a * e - b * d
    return lambda x, y: ((e * (x - c) - b * (y - f)) / det, (a * (y - f) - d * (x - c)) / det)


def pixel_to_geo(a: Column, b: Column, c: Column, d: Column, e: Column, f: Column):
    return lambda col, row: (a * col + b * row + c, d * col + e * row + f)


def reduce_precision(multi: Column, decimals: int = 2) -> Column:
    return map_points(multi, lambda x, y: (F.bround(x, decimals), F.bround(y, decimals)))


def _fold(ring: Column, term) -> Column:
    """Sum of term(previous, next) over a ring's edges, which is closed where it isn't."""
    n = F.size(ring)
    at = lambda i: F.get(ring, i)
    steps = F.when(n > 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.lit(0.0), lambda acc, i: acc + term(at(i - 1), at(F.when(i == n, F.lit(0)).otherwise(i))))


def ring_area(ring: Column) -> Column:
    """Signed shoelace area; counter-clockwise is positive. Taken about the ring's first vertex."""
    x0, y0 = F.get(ring, F.lit(0))["x"], F.get(ring, F.lit(0))["y"]
    return _fold(ring, lambda p, q: (p["x"] - x0) * (q["y"] - y0) - (q["x"] - x0) * (p["y"] - y0)) / 2


def area(multi: Column) -> Column:
    """Exteriors less holes."""
    rings = lambda p: F.transform(p, lambda r, i: F.when(i == 0, F.abs(ring_area(r))).otherwise(-F.abs(ring_area(r))))
    return F.aggregate(F.flatten(F.transform(multi, rings)), F.lit(0.0), lambda a, v: a + v)


def ring_length(ring: Column) -> Column:
    return _fold(ring, lambda p, q: F.hypot(q["x"] - p["x"], q["y"] - p["y"]))


def perimeter(multi: Column) -> Column:
    return F.aggregate(F.flatten(multi), F.lit(0.0), lambda a, r: a + ring_length(r))


def line_length(line: Column) -> Column:
    n = F.size(line)
    steps = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.lit(0.0), lambda a, i: a + F.hypot(F.get(line, i)["x"] - F.get(line, i - 1)["x"], F.get(line, i)["y"] - F.get(line, i - 1)["y"]))


def box(multi: Column) -> Column:
    """BOX around all vertices."""
    points = F.flatten(F.flatten(multi))
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.when(F.size(points) > 0, F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax")))


def box_of(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    return F.struct(xmin.alias("xmin"), ymin.alias("ymin"), xmax.alias("xmax"), ymax.alias("ymax"))


def boxes_touch(a: Column, b: Column) -> Column:
    """Closed boxes that share at least a point."""
    return (a["xmin"] <= b["xmax"]) & (b["xmin"] <= a["xmax"]) & (a["ymin"] <= b["ymax"]) & (b["ymin"] <= a["ymax"])


def corners(left: Column, bottom: Column, right: Column, top: Column) -> Column:
    """RING of a rectangle: top left, bottom left, bottom right, top right, top left."""
    return F.array(point(left, top), point(left, bottom), point(right, bottom), point(right, top), point(left, top))


def square(x: Column, y: Column, half: float) -> Column:
    """RING of the axis-aligned square of side 2 * half around a centre."""
    return corners(x - half, y - half, x + half, y + half)


def centroid(multi: Column) -> Column:
    """Area centroid of exteriors less holes; null where the area is 0."""
    def moment(axis):
        def ring(r, i):
            o = F.get(r, F.lit(0))[axis]
            x0, y0 = F.get(r, F.lit(0))["x"], F.get(r, F.lit(0))["y"]
            cross = lambda p, q: (p["x"] - x0) * (q["y"] - y0) - (q["x"] - x0) * (p["y"] - y0)
            m = _fold(r, lambda p, q: (p[axis] - o + q[axis] - o) * cross(p, q)) / 6
            signed = ring_area(r)
            value = m * F.signum(signed) + o * F.abs(signed)
            return F.when(i == 0, value).otherwise(-value)

        return F.aggregate(F.flatten(F.transform(multi, lambda p: F.transform(p, ring))), F.lit(0.0), lambda a, v: a + v)

    total = area(multi)
    return F.when(total > 0, F.struct((moment("x") / total).alias("x"), (moment("y") / total).alias("y")))


def contains_point(multi: Column, x: Column, y: Column) -> Column:
    """Whether (x, y) lies inside by the parity of crossings over all rings."""
    def crossing(p, q):
        over = (p["y"] > y) != (q["y"] > y)
        at = p["x"] + (y - p["y"]) * (q["x"] - p["x"]) / F.when(over, q["y"] - p["y"]).otherwise(F.lit(1.0))
        return F.when(over & (x < at), F.lit(1.0)).otherwise(F.lit(0.0))

    crossings = F.aggregate(F.flatten(multi), F.lit(0.0), lambda a, r: a + _fold(r, crossing))
    return crossings % 2 == 1


def line_box(line: Column, half_width: Column) -> Column:
    """RING of the rectangle with flat ends at half_width to both sides of a line's first and last point."""
    p, q = F.get(line, F.lit(0)), F.get(line, F.size(line) - 1)
    length = F.hypot(q["x"] - p["x"], q["y"] - p["y"])
    nx, ny = -(q["y"] - p["y"]) / F.nullif(length, F.lit(0.0)) * half_width, (q["x"] - p["x"]) / F.nullif(length, F.lit(0.0)) * half_width
    return F.array(point(p["x"] + nx, p["y"] + ny), point(q["x"] + nx, q["y"] + ny), point(q["x"] - nx, q["y"] - ny), point(p["x"] - nx, p["y"] - ny), point(p["x"] + nx, p["y"] + ny))


def compass(dx: Column, dy: Column) -> Column:
    """Degrees clockwise from the y axis, 0 up to 360."""
    return F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0))


def plane_label(line: Column) -> Column:
    """STRUCT<ring, length, width, aspect, compass> of an aircraft drawn as nose, wing, tail, wing."""
    p = [F.get(line, F.lit(i)) for i in range(4)]
    length = F.hypot(p[0]["x"] - p[2]["x"], p[0]["y"] - p[2]["y"])
    width = F.hypot(p[1]["x"] - p[3]["x"], p[1]["y"] - p[3]["y"])
    return F.struct(F.concat(F.slice(line, 1, 4), F.array(p[0])).alias("ring"), length.alias("length"), width.alias("width"), F.try_divide(length, width).alias("aspect"), compass(p[0]["x"] - p[2]["x"], p[0]["y"] - p[2]["y"]).alias("compass"))


def boat_label(line: Column, aspect: float = 3.0) -> Column:
    """STRUCT<ring, length, width, aspect, compass> of a vessel drawn from stern to bow."""
    p, q = F.get(line, F.lit(0)), F.get(line, F.lit(1))
    length = F.hypot(q["x"] - p["x"], q["y"] - p["y"])
    return F.struct(line_box(F.slice(line, 1, 2), length / (2 * aspect)).alias("ring"), length.alias("length"), (length / aspect).alias("width"), F.lit(float(aspect)).alias("aspect"), compass(q["x"] - p["x"], q["y"] - p["y"]).alias("compass"))


def feature_label(line: Column, label: Column) -> Column:
    """plane_label for 'Airplane', boat_label for anything else."""
    return F.when(label == "Airplane", plane_label(line)).otherwise(boat_label(line))


def relative_box(b: Column, width: Column, height: Column) -> Column:
    """STRUCT<x, y, w, h>: a pixel box's centre and size as shares of the image."""
    return F.struct(((b["xmin"] + b["xmax"]) / 2 / width).alias("x"), ((b["ymin"] + b["ymax"]) / 2 / height).alias("y"), ((b["xmax"] - b["xmin"]) / width).alias("w"), ((b["ymax"] - b["ymin"]) / height).alias("h"))


def resize_box(b: Column, factor: float) -> Column:
    """BOX scaled about its centre."""
    cx, cy = (b["xmin"] + b["xmax"]) / 2, (b["ymin"] + b["ymax"]) / 2
    hx, hy = (b["xmax"] - b["xmin"]) / 2 * factor, (b["ymax"] - b["ymin"]) / 2 * factor
    return box_of(cx - hx, cy - hy, cx + hx, cy + hy)
