"""Chips: extents, windows, grids, spatial join of features with chips, clipping, names, positional pairing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasieve.functions import geom
from terrasieve.session import cut_lineage

#: Cells that one box is spread over at most; a larger one goes to the coarse level, where cells are COARSE times as wide.
MOST_CELLS, COARSE = 64, 64


def extent(chips: DataFrame) -> DataFrame:
    """chips plus left, top, right, bottom from tr_a..tr_f, width and height."""
    c = F.col
    x = lambda col, row: c("tr_a") * col + c("tr_b") * row + c("tr_c")
    y = lambda col, row: c("tr_d") * col + c("tr_e") * row + c("tr_f")
    zero = F.lit(0)
    return chips.withColumns({"left": x(zero, zero), "top": y(zero, zero), "right": x(c("width"), c("height")), "bottom": y(c("width"), c("height"))})


def unwrapped(chips: DataFrame, group: str, order: str) -> DataFrame:
    """Chips of extent with left and right moved by whole turns, so that no group jumps at 180 degrees.

    Each chip goes to the turn nearest to its group's first chip by order; the group's least left
    then lies in -180 up to 180. Groups that don't reach 180 degrees keep their values.
    """
    turn = F.round((F.col("_uw_at") - F.col("left")) / 360)
    near = chips.join(chips.groupBy(F.col(group).alias("_uw")).agg(F.min_by("left", F.when(F.col("left").isNotNull(), F.col(order))).alias("_uw_at")), F.col(group).eqNullSafe(F.col("_uw"))).withColumn("_uw_turn", turn)
    least = near.groupBy(F.col(group).alias("_uw_g")).agg(F.floor((F.min(F.col("left") + 360 * F.col("_uw_turn")) + 180) / 360).alias("_uw_base"))
    move = 360 * (F.col("_uw_turn") - F.col("_uw_base"))
    rows = near.join(least, F.col(group).eqNullSafe(F.col("_uw_g")))
    return rows.withColumns({"left": F.col("left") + move, "right": F.col("right") + move}).drop("_uw", "_uw_at", "_uw_turn", "_uw_g", "_uw_base")


def sliding_windows(df: DataFrame, width: str, height: str, stride: int, size: int, clamp: bool) -> DataFrame:
    """df with one row a window (x0, y0, x1, y1), row-major; clamp moves windows back inside and keeps repeats.

    Images smaller than size give windows that start at 0 or, clamped, are moved out to negative starts as in the source rule.
    """
    starts = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    rows = df.withColumn("y0", F.explode(starts(height))).withColumn("x0", F.explode(starts(width)))
    if clamp:
        rows = rows.withColumns({"y0": F.least("y0", F.col(height) - size), "x0": F.least("x0", F.col(width) - size)})
    return rows.withColumns({"x1": F.col("x0") + size, "y1": F.col("y0") + size})


def stride_of(scene_size: int, overlap: float) -> int:
    """A stride fraction: 1.0 means no overlap."""
    return round(overlap * scene_size)


def grid(df: DataFrame, step: float, size: float) -> DataFrame:
    """df (xmin, ymin, xmax, ymax) with one row a cell: ix, iy and its box; half-open steps from the minima, by integer index."""
    n = lambda lo, hi: F.ceil((F.col(hi) - F.col(lo)) / step).cast("int")
    index = lambda k: F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>"))
    rows = df.withColumn("ix", F.explode(index(n("xmin", "xmax")))).withColumn("iy", F.explode(index(n("ymin", "ymax"))))
    x, y = F.col("xmin") + F.col("ix") * step, F.col("ymin") + F.col("iy") * step
    return rows.withColumns({"cell_left": x, "cell_bottom": y, "cell_right": x + size, "cell_top": y + size})


def ordered_index(df: DataFrame, order: list[Column], name: str, start: int = 0) -> DataFrame:
    """df plus a running number in the total order, without bringing all rows to one task.

    Range-partitioned, sorted and frozen; each partition's counted size gives the next one's start.
    """
    frozen = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_oi_part", F.spark_partition_id()).withColumn("_oi_at", F.monotonically_increasing_id()))
    sizes = frozen.groupBy("_oi_part").agg(F.count("*").alias("_oi_rows"))
    before = F.coalesce(F.sum("_oi_rows").over(Window.orderBy("_oi_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_oi_part", before.alias("_oi_start"))  # one row a partition
    local = F.col("_oi_at") - F.shiftleft(F.col("_oi_part").cast("long"), 33)
    return frozen.join(F.broadcast(starts), "_oi_part").withColumn(name, F.col("_oi_start") + local + start).drop("_oi_part", "_oi_at", "_oi_rows", "_oi_start")


def box_join(left: DataFrame, right: DataFrame, left_box: list[str], right_box: list[str], size: float, on: tuple[str, str] | None = None) -> DataFrame:
    """All pairs of rows whose closed boxes (xmin, ymin, xmax, ymax) meet and, with on, whose columns equal; columns must differ by name.

    Both sides are spread over grid cells of the given size and joined on them; a pair counts in
    the cell of its common lower corner only, so that no pair comes twice and nothing has to be
    made distinct. Large boxes use cells COARSE times as wide; the other side is then spread over
    these too. Hot cells are split by AQE. Rows with a null box take no part.
    """
    def spread(df: DataFrame, box: list[str], side: str, kinds: dict[str, list[int]]) -> DataFrame:
        cell = lambda c, s: F.floor(F.col(c) / s).cast("long")
        many = (cell(box[2], size) - cell(box[0], size) + 1) * (cell(box[3], size) - cell(box[1], size) + 1) > MOST_CELLS

        def cells(kind: int) -> Column:
            s = size if kind == 0 else size * COARSE
            ys = F.sequence(cell(box[1], s), cell(box[3], s))
            return F.flatten(F.transform(F.sequence(cell(box[0], s), cell(box[2], s)), lambda x: F.transform(ys, lambda y: F.struct(F.lit(kind).alias("k"), x.alias("x"), y.alias("y")))))

        every = F.when(many, F.concat(*map(cells, kinds["large"]))).otherwise(F.concat(*map(cells, kinds["small"])))
        return df.where(F.col(box[0]).isNotNull()).withColumn(f"_{side}", F.explode(every))

    # kinds of pairs: 0 small with small on fine cells; 1 small with large, 2 large with small, 3 large with large on coarse ones
    a = spread(left, left_box, "l", {"small": [0, 1], "large": [2, 3]})
    b = spread(right, right_box, "r", {"small": [0, 2], "large": [1, 3]})
    scale = F.when(F.col("_l.k") == 0, size).otherwise(size * COARSE)
    own = (F.col("_l.x") == F.floor(F.greatest(left_box[0], right_box[0]) / scale)) & (F.col("_l.y") == F.floor(F.greatest(left_box[1], right_box[1]) / scale))
    meet = (F.col(left_box[0]) <= F.col(right_box[2])) & (F.col(right_box[0]) <= F.col(left_box[2])) & (F.col(left_box[1]) <= F.col(right_box[3])) & (F.col(right_box[1]) <= F.col(left_box[3]))
    same = F.col(on[0]) == F.col(on[1]) if on else F.lit(True)
    return a.join(b, same & (F.col("_l") == F.col("_r")) & own & meet).drop("_l", "_r")


def rectangle_edges(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """The signed edges of a box, as matching.signed_edges has them."""
    one = F.lit(1.0)
    return F.array(xmin, ymin, xmax, ymin, -one, xmin, ymax, xmax, ymax, one)


def clip_features(pairs: DataFrame, edges: str, area: str, box: list[str], least_share: float = 0.0) -> DataFrame:
    """pairs plus partialDec, the share of the feature inside the box, and truncated; shares up to least_share drop out."""
    from terrasieve.operators.matching import clip_area

    shared = clip_area(F.col(edges), rectangle_edges(*map(F.col, box)))
    share = F.coalesce(F.try_divide(F.greatest(shared, F.lit(0.0)), F.col(area)), F.lit(0.0))
    rows = pairs.withColumn("partialDec", share)
    # differences of 1e-9 are rounding, not truncation
    return rows.where(F.col("partialDec") > least_share + 1e-9).withColumn("truncated", (F.abs(F.col("partialDec") - 1) > 1e-9).cast("int"))


def shift_inside(df: DataFrame, left: str, bottom: str, size: float, box: list[str]) -> DataFrame:
    """Chips moved back so that they don't reach past the raster."""
    return df.withColumns({left: F.greatest(F.least(F.col(left), F.col(box[2]) - size), F.col(box[0])), bottom: F.greatest(F.least(F.col(bottom), F.col(box[3]) - size), F.col(box[1]))})


def chip_name(prefix: Column, number: Column, left: Column, bottom: Column, label: Column | None = None, suffix: str = ".tif") -> Column:
    """prefix[_label]_img<number>, or by coordinates where the number is negative."""
    head = prefix if label is None else F.concat(prefix, F.lit("_"), F.regexp_replace(label, " ", ""))
    by_place = F.concat(head, F.lit("_"), F.format_string("%.6f", left), F.lit("_"), F.format_string("%.6f", bottom))
    return F.concat(F.when(number < 0, by_place).otherwise(F.concat(head, F.lit("_img"), number.cast("string"))), F.lit(suffix))


def split_rows(df: DataFrame, key: str, shares: list[tuple[str, float]], seed: str = "", drop_boundary: bool = False) -> DataFrame:
    """df plus split: rows in the order of md5(seed + key) cut at the cumulated shares; the rest gets the last name.

    drop_boundary leaves out the first row of every split but the first, as slicing by limits did.
    """
    numbered = ordered_index(df, [F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), F.col(key)], "_rank")
    n = df.count()
    limits, total = [], 0.0
    for name, share in shares[:-1]:
        total += share
        limits.append((name, math.floor(n * total + 1e-9)))
    split = F.lit(shares[-1][0])
    for name, limit in reversed(limits):
        split = F.when(F.col("_rank") < limit, name).otherwise(split)
    rows = numbered.withColumn("split", split)
    if drop_boundary and limits:
        rows = rows.where(~F.col("_rank").isin([limit for _, limit in limits]))
    return rows.drop("_rank")


def pair_by_position(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of both sides joined by their place in sorted order; ValueError if the sides differ in length."""
    if (n := left.count()) != (m := right.count()):
        raise ValueError(f"{n} and {m} rows can't be paired")
    a = ordered_index(left, [F.col(left_key)], "position", 1)
    return a.join(ordered_index(right, [F.col(right_key)], "position", 1), "position")


def object_centred_boxes(df: DataFrame, x: str, y: str, half: float) -> DataFrame:
    """df plus the box of the chip centred on each object."""
    return df.withColumn("chip_box", geom.box(F.array(F.array(geom.square(F.col(x), F.col(y), half)))))


def chip_summary(cells: DataFrame, base: Column, number: Column, left: Column, bottom: Column, layers: list[str], vectors: list[str], folder: str, prefix: str = "", label: Column | None = None) -> DataFrame:
    """cells with one row a raster layer: layer, rasterSource, chipName, geoVectorName ARRAY (one a vector layer) and pixVectorName, empty until pixels are written.

    Names are prefix[class_]layer_base_img<number>, or by coordinates where the number is negative;
    rasters go to folder/layer[/class], vectors to folder/geojson/layer.
    """
    def name(layer: Column, suffix: str, with_class: bool) -> Column:
        cls = F.concat(F.regexp_replace(label, " ", ""), F.lit("_")) if label is not None and with_class else F.lit("")
        return chip_name(F.concat(F.lit(prefix), cls, layer, F.lit("_"), base), number, left, bottom, suffix=suffix)

    rows = cells.withColumn("layer", F.explode(F.array(*map(F.lit, layers))))
    chip = name(F.col("layer"), ".tif", True)
    place = [F.lit(folder), F.col("layer"), *([F.regexp_replace(label, " ", "")] if label is not None else [])]
    geo = F.array(*[F.concat_ws("/", F.lit(f"{folder}/geojson/{v}"), name(F.lit(v), ".geojson", False)) for v in vectors]) if vectors else F.array().cast("array<string>")
    return rows.withColumns({"rasterSource": F.concat_ws("/", *place, chip), "chipName": chip, "geoVectorName": geo, "pixVectorName": F.lit("")})


def cut_arrays(pairs: DataFrame, data: str, width: str, affine: list[str], box: list[str]) -> DataFrame:
    """pairs with data, width and affine of the part of each raster whose pixel centres lie in the box (left and bottom edge included); rows without any drop out.

    data is a row-major array; affine are the columns a..f of an upright raster (b and d are 0).
    """
    import numpy as np

    fields = pairs.schema.fields
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def run(batches):
        for batch in batches:
            keep, cut, wide, cs, fs = [], [], [], [], []
            for k, (values, n, a, c, e, f, l, b, r, t) in enumerate(zip(batch[data], batch[width], *(batch[affine[i]] for i in (0, 2, 4, 5)), *(batch[x] for x in box))):
                if values is None or not len(values) or any(v is None or v != v for v in (a, c, e, f, l, b, r, t)):
                    continue
                grid = np.asarray(values).reshape(-1, int(n))
                x, y = c + a * (np.arange(grid.shape[1]) + 0.5), f + e * (np.arange(grid.shape[0]) + 0.5)
                col, row = np.nonzero((x >= l) & (x < r))[0], np.nonzero((y >= b) & (y < t))[0]
                if len(col) and len(row):
                    keep.append(k)
                    cut.append(grid[row[0] : row[-1] + 1, col[0] : col[-1] + 1].ravel())
                    wide.append(len(col))
                    cs.append(c + a * col[0])
                    fs.append(f + e * row[0])
            out = batch.iloc[keep].reset_index(drop=True)
            out[data], out[width], out[affine[2]], out[affine[5]] = cut, wide, cs, fs
            yield out[[f.name for f in fields]]

    return pairs.mapInPandas(run, schema)


def write_chips(cells: DataFrame, name: str, box: list[str], rasters: DataFrame, features: DataFrame, wkt: str, properties: list[str], size: float, folder: str, least_share: float = 0.0, dtype: str = "u2") -> tuple[DataFrame, DataFrame]:
    """Cuts rasters and polygons to cells and writes folder/raster/<name>_<raster>.tif and folder/geojson/<name>/; the lists of both.

    cells: (name, box); rasters: (image_id, data, width, height, tr_a..tr_f); features: (wkt, properties). Both
    meet the cells through box_join with grid cells of the given size. A cell without features has no collection.
    """
    from terrasieve.operators.clip import cut_features
    from terrasieve.operators.matching import polygon_table
    from terrasieve.sources import geojson, tiff

    tr = [f"tr_{x}" for x in "abcdef"]
    c = cells.select(F.col(name).alias("chip"), *[F.col(b).cast("double").alias(f"_c{i}") for i, b in enumerate(box)])
    corners = [f"_c{i}" for i in range(4)]
    r = extent(rasters).select("image_id", "data", "width", *tr, F.least("left", "right").alias("_r0"), F.least("bottom", "top").alias("_r1"), F.greatest("left", "right").alias("_r2"), F.greatest("bottom", "top").alias("_r3"))
    met = cut_arrays(box_join(c, r, corners, ["_r0", "_r1", "_r2", "_r3"], size), "data", "width", tr, corners)
    images = tiff.write_rasters(met.withColumn("_file", F.concat_ws("_", "chip", "image_id")), "_file", "data", "width", None, tr, f"{folder}/raster", dtype)
    marked = features.select(*properties, F.col(wkt).alias("_w"), F.monotonically_increasing_id().alias("_id"), F.lit("").alias("_i"))
    shapes = cut_lineage(marked)
    f = polygon_table(shapes, "_id", "_i", "_w", keep=True).select("id", "xmin", "ymin", "xmax", "ymax", "wkt")
    cut = cut_features(box_join(f, c, ["xmin", "ymin", "xmax", "ymax"], corners, size), "wkt", corners, least_share=least_share)
    rows = cut.join(shapes.select(*properties, F.col("_id").alias("id")), "id")
    g = geom.once(rows, ["chip", *properties, "origarea", "origlen", "partialDec", "truncated"], g=geom.parse_wkt(F.col("geometry")))
    g = g.withColumns({"coordinates": geojson.coordinates_json(F.col("g")), "_kind": F.when(F.size("g") == 1, "Polygon").otherwise("MultiPolygon")})
    vectors = geojson.write_geojson(g, f"{folder}/geojson", "coordinates", "_kind", [*properties, "origarea", "origlen", "partialDec", "truncated"], "chip")
    return images, vectors
