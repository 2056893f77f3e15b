"""Raster operators over pixel rows (image, row, col, value) and over tiles as flat arrays."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasieve.functions import geom
from terrasieve.operators.components import components
from terrasieve.session import cut_lineage


def pixels(df: DataFrame, image: str, data: str, width: int) -> DataFrame:
    """(image, row, col, value) of row-major arrays."""
    rows = df.select(F.col(image).alias("image"), F.posexplode(data).alias("_i", "value"))
    return rows.select("image", F.floor(F.col("_i") / width).cast("int").alias("row"), (F.col("_i") % width).cast("int").alias("col"), F.col("value").cast("double").alias("value"))


def tile_percentiles(df: DataFrame, image: str, data: str, shares: dict[str, float]) -> DataFrame:
    """(image, one column a share): linearly interpolated percentiles of all values of an image's tiles.

    Exact, from histograms of the values: each task counts its tiles' values first, so that an image
    of very many tiles sends a row a value and task (at most 256 or 65,536 values for whole
    numbers of 8 or 16 bits). Null tiles and values don't count.
    """
    kind = df.schema[image].dataType.simpleString()

    def count(batches):
        for batch in batches:
            rows = []
            for k, tiles in batch.groupby("_k", dropna=False, sort=False)["_t"]:
                values = np.concatenate([np.empty(0), *[np.asarray(t, dtype=float) for t in tiles if t is not None]])
                value, n = np.unique(values[~np.isnan(values)], return_counts=True)
                rows.append(pd.DataFrame({"image": np.repeat(np.array([k], dtype=object), len(value)), "value": value, "n": n}))
            if rows:
                out = pd.concat(rows, ignore_index=True)
                yield out.astype({"image": batch["_k"].dtype})

    counts = df.select(F.col(image).alias("_k"), F.col(data).alias("_t")).mapInPandas(count, f"image {kind}, value double, n long").groupBy("image", "value").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy("image")
    rows = counts.withColumns({"_upto": F.sum("n").over(whole.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("n").over(whole)})
    columns = []
    for name, share in shares.items():
        at = (F.col("_all") - 1) * share
        low, high = (F.min(F.when(F.col("_upto") > f(at), F.col("value"))) for f in (F.floor, F.ceil))
        columns.append((low + (high - low) * F.first(at - F.floor(at))).alias(name))
    return rows.groupBy("image").agg(*columns)


def stretch_8bit(df: DataFrame, image: str, data: str, high: float = 98.0, most: float = 255.0) -> DataFrame:
    """df's tiles clipped at their image's high percentile, scaled to most and cut to whole numbers in 0..255; a percentile of 0 or less gives 0."""
    p = tile_percentiles(df, image, data, {"_p": high / 100}).withColumnRenamed("image", "_image")
    scaled = lambda v: F.floor(F.round(F.least(v, F.col("_p")) * most / F.nullif(F.col("_p"), F.lit(0.0)), 9))  # else noise in the percentile shows
    value = lambda v: F.when(v.isNotNull(), F.when(F.col("_p") > 0, F.greatest(F.lit(0), F.least(F.lit(255), scaled(v)))).otherwise(0)).cast("int")
    return df.join(p, F.col(image).eqNullSafe(F.col("_image")), "left").withColumn(data, F.transform(data, value)).drop("_p", "_image")


def normalise(df: DataFrame, image: str, data: str, most: float = -1.0, share: float | None = None) -> DataFrame:
    """df's tiles over their image's percentile (share) or the given maximum, clipped to 0..1; most -1: neither scaled nor clipped."""
    if share is None and most == -1:
        return df
    p = tile_percentiles(df, image, data, {"_p": share}).withColumnRenamed("image", "_image") if share is not None else None
    rows = df.join(p, F.col(image).eqNullSafe(F.col("_image")), "left") if p is not None else df.withColumn("_p", F.lit(float(most)))
    value = lambda v: F.when(v.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(v, F.col("_p")), F.lit(0.0)))))
    return rows.withColumn(data, F.transform(data, value)).drop("_p", "_image")


def masked(px: DataFrame, mask_value: float = 0.0) -> DataFrame:
    return px.where(F.col("value") != mask_value)


def cut(px: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """The chip of columns x0..x1-1 and rows y0..y1-1, numbered from 0."""
    rows = px.where((F.col("col") >= x0) & (F.col("col") < x1) & (F.col("row") >= y0) & (F.col("row") < y1))
    return rows.withColumns({"col": F.col("col") - x0, "row": F.col("row") - y0})


def mask_by_outline(px: DataFrame, outline: Column, fill: float = 0.0) -> DataFrame:
    """Pixels whose centre lies outside the outline become fill."""
    inside = geom.contains_point(outline, F.col("col") + 0.5, F.col("row") + 0.5)
    return px.withColumn("value", F.when(inside, F.col("value")).otherwise(fill))


def overlap_add(tiles: DataFrame) -> DataFrame:
    """(image, row, col, total, n, mean) of window pixels (image, y0, x0, row, col, value) added at their place."""
    at = tiles.select("image", (F.col("y0") + F.col("row")).alias("row"), (F.col("x0") + F.col("col")).alias("col"), "value")
    return at.groupBy("image", "row", "col").agg(F.sum("value").alias("total"), F.count("*").alias("n"), F.avg("value").alias("mean"))


def _near(rings: list[np.ndarray], distance: float, r0: int, c0: int, rows: int, cols: int) -> np.ndarray:
    """Which pixels of a window have their centre within distance of an edge."""
    y, x = (np.arange(r0, r0 + rows) + 0.5)[:, None], (np.arange(c0, c0 + cols) + 0.5)[None, :]
    out = np.zeros((rows, cols), dtype=bool)
    for p in rings:
        for (ax, ay), (bx, by) in zip(p, np.roll(p, -1, axis=0)):
            dx, dy = bx - ax, by - ay
            t = np.clip(((x - ax) * dx + (y - ay) * dy) / max(dx * dx + dy * dy, 1e-300), 0, 1)
            out |= (x - ax - t * dx) ** 2 + (y - ay - t * dy) ** 2 <= distance * distance
    return out


def _burnt(rings: list[np.ndarray], r0: int, c0: int, rows: int, cols: int) -> np.ndarray:
    """Which pixels of a window have their centre inside, by the parity of crossings over all rings."""
    e = np.concatenate([np.column_stack([p, np.roll(p, -1, axis=0)]) for p in rings])
    y = np.arange(r0, r0 + rows) + 0.5
    r, k = np.nonzero((e[None, :, 1] > y[:, None]) != (e[None, :, 3] > y[:, None]))
    at = e[k, 0] + (y[r] - e[k, 1]) * (e[k, 2] - e[k, 0]) / (e[k, 3] - e[k, 1])
    left = np.clip(np.ceil(at - 0.5) - c0, 0, cols).astype(np.int64)  # so many columns lie left of the crossing
    ends = np.zeros((rows, cols + 1), dtype=np.int64)
    np.add.at(ends, (r, left), 1)
    return np.cumsum(ends[:, ::-1], axis=1)[:, ::-1][:, 1:] % 2 == 1


#: Rows of a raster that one task burns at a time.
BAND_ROWS = 256


def rasterize(polygons: DataFrame, image: str, geometry: str, order: str, burn: Column, width: int | str, height: int | str, cell: float = 1.0, buffer: float = 0.0) -> DataFrame:
    """(image, row, col, value): pixels whose centre lies in a polygon, or within buffer of one; of several, the last in order wins.

    width and height are numbers or, for rasters of several sizes, columns. The polygons go to the
    bands of BAND_ROWS rows that their boxes meet and are burnt there in order; what comes back are
    runs of pixels. Pixels outside all polygons don't come out (they are 0). cell is the pixel's
    size in the polygons' units.
    """
    size = lambda n: F.lit(n) if isinstance(n, int) else F.col(n)
    wide = buffer / cell
    rows = geom.once(polygons, [F.col(image).alias("image"), F.col(order).alias("_o"), burn.alias("_v"), size(width).cast("int").alias("_w"), size(height).cast("int").alias("_h")], _g=F.col(geometry))
    points, scaled = F.flatten(F.flatten("_g")), lambda axis: lambda p: p[axis] / cell
    keep = ["image", "_o", "_v", "_w", "_h"]
    rows = geom.once(rows.where(F.size("_g") > 0), keep, _x=F.transform(points, scaled("x")), _y=F.transform(points, scaled("y")), _n=F.transform(F.flatten("_g"), lambda r: F.size(r)))
    rows = geom.once(rows, [*keep, "_x", "_y", "_n"], _x0=F.array_min("_x") - wide, _y0=F.array_min("_y") - wide, _x1=F.array_max("_x") + wide, _y1=F.array_max("_y") + wide)
    rows = rows.where("_x1 >= 0 and _y1 >= 0 and _x0 < _w and _y0 < _h")
    first, last = F.greatest(F.floor("_y0"), F.lit(0)), F.least(F.floor("_y1"), F.col("_h") - 1)
    rows = rows.select(*keep, "_x", "_y", "_n", F.explode(F.sequence(F.floor(first / BAND_ROWS), F.floor(last / BAND_ROWS))).alias("_band"))
    image_type, value_type = (rows.schema[c].dataType.simpleString() for c in ("image", "_v"))

    def burn_band(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_o", kind="stable", na_position="first", ignore_index=True)
        top, columns = int(pdf["_band"].iloc[0]) * BAND_ROWS, int(pdf["_w"].max())
        canvas = np.full((BAND_ROWS, columns), -1, dtype=np.int32)
        for k, (x, y, n, w, h) in enumerate(zip(pdf["_x"], pdf["_y"], pdf["_n"], pdf["_w"], pdf["_h"])):
            r0, r1 = max(top, int(np.floor(np.nanmin(y) - wide))), min(top + BAND_ROWS, int(h), int(np.floor(np.nanmax(y) + wide)) + 1)
            c0, c1 = max(0, int(np.floor(np.nanmin(x) - wide))), min(int(w), int(np.floor(np.nanmax(x) + wide)) + 1)
            if r0 < r1 and c0 < c1:
                rings = [r for r in np.split(np.column_stack([x, y]).astype(float), np.cumsum(n)[:-1]) if len(r)]
                hit = _burnt(rings, r0, c0, r1 - r0, c1 - c0)
                canvas[r0 - top : r1 - top, c0:c1][hit | _near(rings, wide, r0, c0, r1 - r0, c1 - c0) if wide else hit] = k
        start = np.column_stack([np.ones(BAND_ROWS, dtype=bool), canvas[:, 1:] != canvas[:, :-1]])
        row, col = np.nonzero(start)
        k = canvas[row, col]
        until = np.append(col[1:], 0)
        until[np.append(row[1:] != row[:-1], True)] = columns
        on = k >= 0
        return pd.DataFrame({"image": pdf["image"].iloc[0], "row": row[on] + top, "_c0": col[on], "_c1": until[on] - 1, "value": pdf["_v"].to_numpy()[k[on]]})

    runs = rows.groupBy("image", "_band").applyInPandas(burn_band, f"image {image_type}, row int, _c0 int, _c1 int, value {value_type}")
    return runs.select("image", "row", F.explode(F.sequence("_c0", "_c1")).alias("col"), "value")


def distance_to(mask: np.ndarray) -> np.ndarray:
    """Euclidean distance of every pixel to the nearest true pixel; inf where there is none.

    First along columns by running maxima of the last true row, then across: out(c) is the least of
    (c - k)^2 + down(k)^2, tried by growing |c - k| for all pixels at once until it can't help any more.
    """
    rows, cols = mask.shape
    at = np.arange(rows, dtype=float)[:, None]
    seen = np.maximum.accumulate(np.where(mask, at, -np.inf), axis=0)
    ahead = np.minimum.accumulate(np.where(mask, at, np.inf)[::-1], axis=0)[::-1]
    down = np.minimum(at - seen, ahead - at) ** 2
    out = down.copy()
    for d in range(1, cols):
        if d * d >= out.max():
            break
        out[:, d:] = np.minimum(out[:, d:], down[:, :-d] + d * d)
        out[:, :-d] = np.minimum(out[:, :-d], down[:, d:] + d * d)
    return np.sqrt(out)


def signed_distance(inside: np.ndarray, scale: float = 1.0) -> np.ndarray:
    """Distance to the outside where inside, minus the distance to the inside elsewhere; 0 for a missing side."""
    out, back = distance_to(~inside), distance_to(inside)
    return scale * (np.where(np.isfinite(out), out, 0.0) - np.where(np.isfinite(back), back, 0.0))


def signed_distance_tiles(df: DataFrame, data: str, width: int, scale: float = 1.0) -> DataFrame:
    """df plus distance ARRAY<DOUBLE> of tiles whose positive values are inside; one tile a row."""

    @F.pandas_udf("array<double>")
    def run(tiles: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else signed_distance(np.asarray(t, dtype=float).reshape(-1, width) > 0, scale).ravel() for t in tiles])

    return df.withColumn("distance", run(data))


def class_segmentation(px: DataFrame) -> DataFrame:
    """1 where the distance is positive, 0 where negative, unchanged at 0."""
    return px.withColumn("value", F.when(F.col("value") > 0, 1.0).when(F.col("value") < 0, 0.0).otherwise(F.col("value")))


def class_boundaries(px: DataFrame) -> DataFrame:
    """The sparse boundary: (image, row, col, 1) where the distance is at most 1 from 0."""
    return px.where(F.abs("value") <= 1).withColumn("value", F.lit(1))


def voc_classes(px: DataFrame, buffer: float = 2.5, inner: int = 100, border: int = 255, position: Column | None = None) -> DataFrame:
    """Class mask by signed distance: border up to buffer around the outline, inner (or the feature's position) farther in, else 0."""
    return px.withColumn("value", F.when(F.abs("value") <= buffer, border).when(F.col("value") > buffer, inner if position is None else position).otherwise(0).cast("int"))


def resample(tile: np.ndarray, factor: float) -> np.ndarray:
    """Bilinear resampling of (rows, cols) by factor, sample points at pixel centres, edges repeated."""
    rows, cols = max(1, round(tile.shape[0] * factor)), max(1, round(tile.shape[1] * factor))
    y = np.clip((np.arange(rows) + 0.5) * tile.shape[0] / rows - 0.5, 0, tile.shape[0] - 1)
    x = np.clip((np.arange(cols) + 0.5) * tile.shape[1] / cols - 0.5, 0, tile.shape[1] - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, tile.shape[0] - 1), np.minimum(x0 + 1, tile.shape[1] - 1)
    v, u = (y - y0)[:, None], (x - x0)[None, :]
    return (tile[y0][:, x0] * (1 - u) + tile[y0][:, x1] * u) * (1 - v) + (tile[y1][:, x0] * (1 - u) + tile[y1][:, x1] * u) * v


def resample_tiles(df: DataFrame, data: str, width: int, factor: float) -> DataFrame:
    """df plus resampled ARRAY<DOUBLE>."""

    @F.pandas_udf("array<double>")
    def run(tiles: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else resample(np.asarray(t, dtype=float).reshape(-1, width), factor).ravel() for t in tiles])

    return df.withColumn("resampled", run(data))


def resampled_affine(tr: list[Column], factor: float) -> list[Column]:
    """The transform of a raster resampled by factor: pixel sizes over factor, the same origin."""
    a, b, c, d, e, f = tr
    return [a / factor, b / factor, c, d / factor, e / factor, f]


def labels_of(tile: np.ndarray) -> np.ndarray:
    """A number for each pixel, the same within a 4-connected region of equal value; numbers follow the regions' first pixels.

    Runs of equal value in a row are joined with those they touch in the row above: labels take the
    least of their neighbours' until nothing moves, halving paths as they go.
    """
    rows, cols = tile.shape
    start = np.ones(tile.shape, dtype=bool)
    start[:, 1:] = tile[:, 1:] != tile[:, :-1]
    run = np.cumsum(start).reshape(tile.shape) - 1
    parent = np.arange(run[-1, -1] + 1) if tile.size else np.empty(0, dtype=np.int64)
    same = tile[1:] == tile[:-1]
    a, b = run[:-1][same], run[1:][same]
    while len(a):
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        open_ = low != high
        if not open_.any():
            break
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(parent, high, low)
        while not np.array_equal(parent, nearer := parent[parent]):
            parent = nearer
    return np.unique(parent, return_inverse=True)[1][run] if tile.size else run


def regions_of(tile: np.ndarray, mask_value: float = 0.0) -> list[tuple[float, list[np.ndarray]]]:
    """(value, rings) of the 4-connected regions of equal value other than mask_value; the exterior ring first."""
    label = labels_of(tile)
    order = np.argsort(label, axis=None, kind="stable")
    cuts = np.nonzero(np.diff(label.ravel()[order]))[0] + 1
    out = []
    for cells in np.split(order, cuts) if tile.size else []:
        y, x = np.divmod(cells, tile.shape[1])
        if tile[y[0], x[0]] != mask_value:
            out.append((float(tile[y[0], x[0]]), _trace(set(zip(y.tolist(), x.tolist())))))
    return out


def _outline(cells: set[tuple[int, int]]) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """The directed unit edges around a set of pixels, interior on the left."""
    out = []
    for y, x in cells:
        for (v, u), a, b in (((y - 1, x), (x + 1, y), (x, y)), ((y + 1, x), (x, y + 1), (x + 1, y + 1)), ((y, x - 1), (x, y), (x, y + 1)), ((y, x + 1), (x + 1, y + 1), (x + 1, y))):
            if (v, u) not in cells:
                out.append((a, b))
    return out


def _trace(cells: set[tuple[int, int]]) -> list[np.ndarray]:
    """Boundary rings of a set of pixels, interior on the left, straight runs merged."""
    return _rings(_outline(cells))


def _rings(outline: list[tuple[tuple[int, int], tuple[int, int]]]) -> list[np.ndarray]:
    edges = defaultdict(list)
    for a, b in outline:
        edges[a].append(b)
    rings = []
    while edges:
        start = min(edges)
        ring, at, way = [start], start, None
        while True:
            options = edges[at]
            # where two corners touch, turn so that the regions stay apart
            nxt = options[0] if len(options) == 1 or way is None else max(options, key=lambda p: way[0] * (p[1] - at[1]) - way[1] * (p[0] - at[0]))
            options.remove(nxt)
            if not options:
                del edges[at]
            way = nxt[0] - at[0], nxt[1] - at[1]
            at = nxt
            ring.append(at)
            if at == start:
                break
        p = np.array(ring, dtype=float)
        keep = [0, *(i for i in range(1, len(p) - 1) if not np.array_equal(p[i] - p[i - 1], p[i + 1] - p[i])), len(p) - 1]
        rings.append(p[keep])
    area = lambda p: abs(np.sum(p[:-1, 0] * p[1:, 1] - p[1:, 0] * p[:-1, 1]))
    return sorted(rings, key=area, reverse=True)


def polygonize(df: DataFrame, key: str, data: str, width: int, mask_value: float = 0.0) -> DataFrame:
    """(key, region, value, wkt, n_rings): polygons of the equal-valued regions of each tile, in pixel coordinates."""
    key_type = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = []
            for k, t in zip(batch[key], batch[data]):
                if t is None:
                    continue
                for i, (value, rings) in enumerate(regions_of(np.asarray(t, dtype=float).reshape(-1, width), mask_value)):
                    text = ", ".join("(" + ", ".join(f"{x:g} {y:g}" for x, y in r) + ")" for r in rings)
                    rows.append((k, i, value, f"POLYGON ({text})", len(rings)))
            yield pd.DataFrame(rows, columns=[key, "region", "value", "wkt", "n_rings"])

    return df.select(key, data).mapInPandas(run, f"`{key}` {key_type}, region int, value double, wkt string, n_rings int")


def polygonize_tiles(df: DataFrame, image: str, row: str, col: str, data: str, size: int, mask_value: float = 0.0) -> DataFrame:
    """(image, region, value, area, wkt): polygons of the equal-valued regions of whole rasters that lie in tiles.

    Tiles are row-major arrays of size columns (those at the right and lower edge may be padded
    with mask_value) at tile row and tile column. Regions are found in each tile, those that meet across
    a border are linked, and components of these links are the raster's regions, named by their
    least pixel number in tile order. Outlines come from the tiles' edges without those that two parts
    of one region share. Only border pixels and outlines are shuffled; one region's outline is traced
    in one task. Null tiles have no regions.
    """
    kind = df.schema[image].dataType.simpleString()
    tiles = df.select(F.col(image).alias("image"), F.col(row).cast("long").alias("ty"), F.col(col).cast("long").alias("tx"), F.col(data).alias("tile"))
    schema = f"image {kind}, node long, value double, area long, edges array<long>, side array<string>, place array<long>"

    def run(batches):
        for batch in batches:
            rows = []
            for k, ty, tx, t in zip(batch["image"], batch["ty"], batch["tx"], batch["tile"]):
                if t is None or not len(t):
                    continue
                a = np.asarray(t, dtype=float).reshape(-1, size)
                label, high = labels_of(a), a.shape[0]
                base = ((int(ty) << 24) + int(tx)) * (size * size)
                order = np.argsort(label, axis=None, kind="stable")
                for cells in np.split(order, np.nonzero(np.diff(label.ravel()[order]))[0] + 1):
                    y, x = np.divmod(cells, size)
                    value = a[y[0], x[0]]
                    if value == mask_value or np.isnan(value):
                        continue
                    edges = [v for (ax, ay), (bx, by) in _outline(set(zip(y.tolist(), x.tolist()))) for v in (ax + tx * size, ay + ty * size, bx + tx * size, by + ty * size)]
                    side, place = [], []
                    for name, on, border, at in (("v", x == 0, tx, y + ty * size), ("v", x == size - 1, tx + 1, y + ty * size), ("h", y == 0, ty, x + tx * size), ("h", y == high - 1, ty + 1, x + tx * size)):
                        side += [f"{name}{int(border)}"] * int(on.sum())
                        place += at[on].tolist()
                    rows.append((k, base + int(cells[0]), float(value), len(cells), edges, side, place))
            yield pd.DataFrame(rows, columns=["image", "node", "value", "area", "edges", "side", "place"])

    parts = cut_lineage(tiles.mapInPandas(run, schema))
    border = parts.select("image", "node", "value", F.explode(F.arrays_zip("side", "place")).alias("_b")).select("image", "node", "value", "_b.side", "_b.place")
    links = border.groupBy("image", "side", "place", "value").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b")  # two pixels a place at most
    named = components(parts.select("image", "node"), links.select("image", "a", "b"), "image")
    whole = parts.select("image", "node", "value", "area", "edges").join(named, ["image", "node"])
    placed = whole.repartition("image", "group").sortWithinPartitions("image", "group")

    def polygon(key: tuple, value: float, area: int, edges: list[np.ndarray]) -> tuple:
        outline = np.concatenate(edges).reshape(-1, 4).tolist()
        if len(edges) > 1:  # without the edges that two parts share
            there = {tuple(e) for e in outline}
            outline = [e for e in outline if (e[2], e[3], e[0], e[1]) not in there]
        text = ", ".join("(" + ", ".join(f"{x:g} {y:g}" for x, y in r) + ")" for r in _rings([((e[0], e[1]), (e[2], e[3])) for e in outline]))
        return *key, value, area, f"POLYGON ({text})"

    def trace(batches):
        key, value, area, edges, held = None, 0.0, 0, [], []
        for batch in batches:
            for k, group, v, n, e in zip(batch["image"], batch["group"], batch["value"], batch["area"], batch["edges"]):
                if key != (k, group):
                    if key is not None:
                        held.append(polygon(key, value, area, edges))
                    key, value, area, edges = (k, group), v, 0, []
                area += n
                edges.append(e)
            yield pd.DataFrame(held, columns=["image", "region", "value", "area", "wkt"])
            held = []
        if key is not None:
            yield pd.DataFrame([polygon(key, value, area, edges)], columns=["image", "region", "value", "area", "wkt"])

    return placed.mapInPandas(trace, f"image {kind}, region long, value double, area long, wkt string")


def with_confidence(df: DataFrame, conf: Column | None = None) -> DataFrame:
    """df plus conf, 1 unless given."""
    return df.withColumn("conf", F.lit(1) if conf is None else conf)


def last_window(px: DataFrame) -> DataFrame:
    """The pixel of the last window where windows repeat."""
    w = Window.partitionBy("image", "row", "col").orderBy(F.desc("y0"), F.desc("x0"))
    return px.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
