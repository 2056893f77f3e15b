"""Raster operators over the embeddings as 8 x 8 tiles and over the chips' footprints."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from terrasieve.functions import geom
from terrasieve.operators import raster as X
from terrasieve.plans.registry import Registry, vertices_sql
from terrasieve.session import read, read_spread, temporary_folder
from terrasieve.sources import tiff as T

query = Registry()
R = lambda c, n=6: F.round(c, n)
_PX = """px AS (SELECT vec_id AS image, CAST(i // 8 AS INTEGER) AS row, CAST(i % 8 AS INTEGER) AS col, CAST(floor((CAST(v AS DOUBLE) + 1) * 1000) AS DOUBLE) AS value
  FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings))"""


def _px(spark, sf_dir):
    rows = X.pixels(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8)
    return rows.withColumn("value", F.floor((F.col("value") + 1) * 1000).cast("double"))


def _tiles(spark, sf_dir):
    return read_spread(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), F.transform("embedding", lambda v: F.floor((v.cast("double") + 1) * 1000).cast("double")).alias("tile"))


@query(f"WITH {_PX} SELECT image, round(quantile_cont(value, 0.02), 4) AS low, round(quantile_cont(value, 0.98), 4) AS high FROM px GROUP BY image")
def ag7_percentiles(spark, sf_dir):
    """AG7: low and high percentiles of each image."""
    p = X.tile_percentiles(_tiles(spark, sf_dir), "image", "tile", {"low": 0.02, "high": 0.98})
    return p.select("image", R("low", 4).alias("low"), R("high", 4).alias("high"))


@query(f"""WITH {_PX}, p AS (SELECT image, quantile_cont(value, 0.98) AS p FROM px GROUP BY image)
SELECT image, "row", col, CAST(CASE WHEN p > 0 THEN greatest(0, least(255, floor(round(least(value, p) * 255 / p, 9)))) ELSE 0 END AS INTEGER) AS value FROM px JOIN p USING (image)""")
def r7_stretch_8bit(spark, sf_dir):
    """8-bit stretch to the 98th percentile."""
    return X.pixels(X.stretch_8bit(_tiles(spark, sf_dir), "image", "tile"), "image", "tile", 8).withColumn("value", F.col("value").cast("int"))


@query(f"""WITH {_PX}, p AS (SELECT image, quantile_cont(value, 0.9) AS p FROM px GROUP BY image)
SELECT image, "row", col, round(greatest(0, least(1, value / p)), 9) AS value FROM px JOIN p USING (image)""")
def r12_normalise(spark, sf_dir):
    """Values over a percentile, clipped."""
    return X.pixels(X.normalise(_tiles(spark, sf_dir), "image", "tile", share=0.9), "image", "tile", 8).withColumn("value", R("value", 9))


@query(f"""WITH {_PX} SELECT image, count(*) AS n, sum(value) AS total FROM px WHERE value <> 1000 AND col >= 2 AND col < 6 AND "row" >= 1 AND "row" < 7 GROUP BY image""")
def r8_cut_masked(spark, sf_dir):
    """R8, SNK16, F10: a chip cut out of each image without masked values."""
    return X.masked(X.cut(_px(spark, sf_dir), 2, 1, 6, 7), 1000.0).groupBy("image").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query(f"""WITH {_PX}, w AS (SELECT image // 4 AS image, (image % 4) // 2 * 4 + "row" AS "row", image % 2 * 4 + col AS col, value FROM px)
SELECT image, "row", col, sum(value) AS total, count(*) AS n, round(avg(value), 4) AS mean FROM w GROUP BY ALL""")
def r11_overlap_add(spark, sf_dir):
    """R11, AG9, Q8: four windows of 8 x 8 at a stride of 4 added up on a canvas of 12 x 12."""
    i = F.col("image")
    w = _px(spark, sf_dir).select(F.floor(i / 4).cast("bigint").alias("image"), (F.floor(i % 4 / 2) * 4).cast("int").alias("y0"), (i % 2 * 4).cast("int").alias("x0"), "row", "col", "value")
    return X.overlap_add(w).withColumn("mean", R("mean", 4))


_BURN = vertices_sql("f", "footprints", "footprint_id", "ImageId", "PolygonWKT_Pix", "true")


@query(f"""WITH {_BURN}, box AS (SELECT f_b.id, image, greatest(0, floor(xmin)) AS c0, least(width - 1, floor(xmax)) AS c1, greatest(0, floor(ymin)) AS r0, least(height - 1, floor(ymax)) AS r1 FROM f_b JOIN chips ON image = imageId),
across AS (SELECT b.id, b.image, r, c0, c1, x1 + (r + 0.5 - y1) * (x2 - x1) / (y2 - y1) AS x FROM (SELECT *, unnest(range(CAST(r0 AS BIGINT), CAST(r1 + 1 AS BIGINT))) AS r FROM box) b
  JOIN f_s s ON s.id = b.id AND (y1 > r + 0.5) <> (y2 > r + 0.5)),
hit AS (SELECT id, image, r, c FROM (SELECT id, image, r, x, unnest(range(CAST(c0 AS BIGINT), CAST(least(c1 + 1, greatest(c0, ceil(x - 0.5))) AS BIGINT))) AS c FROM across) WHERE c + 0.5 < x GROUP BY ALL HAVING count(*) % 2 = 1)
SELECT image, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, arg_max(BuildingId, id) AS value FROM hit JOIN footprints ON footprint_id = id GROUP BY image, r, c""")
def r4_rasterize(spark, sf_dir):
    """Footprints burnt on the pixels of their chip, later features over earlier ones.

    The raster is as wide and high as the chip. Footprints of images without chip have no raster.
    """
    f = read_spread(spark, sf_dir, "footprints").where(F.col("PolygonWKT_Pix").contains("((")).select("ImageId", "footprint_id", "BuildingId", geom.parse_wkt(F.col("PolygonWKT_Pix")).alias("g"))
    c = read(spark, sf_dir, "chips").groupBy(F.col("imageId").alias("_i")).agg(F.max("width").alias("width"), F.max("height").alias("height"))
    return X.rasterize(f.join(c, f["ImageId"] == c["_i"]), "ImageId", "g", "footprint_id", F.col("BuildingId"), "width", "height")


_OUTLINE = [(1.2, 0.4), (7.6, 2.2), (5.3, 7.7), (0.3, 5.1), (1.2, 0.4)]
_SEGMENTS = ", ".join(f"({a[0]}, {a[1]}, {b[0]}, {b[1]})" for a, b in zip(_OUTLINE, _OUTLINE[1:]))


@query(f"""WITH {_PX}, o(x1, y1, x2, y2) AS (VALUES {_SEGMENTS}), hit AS (SELECT r, c FROM range(0, 8) rs(r), range(0, 8) cs(c), o
  WHERE (y1 > r + 0.5) <> (y2 > r + 0.5) AND c + 0.5 < x1 + (r + 0.5 - y1) * (x2 - x1) / (y2 - y1) GROUP BY ALL HAVING count(*) % 2 = 1)
SELECT image, "row", col, CASE WHEN hit.r IS NULL THEN 0 ELSE value END AS value FROM px LEFT JOIN hit ON hit.r = "row" AND hit.c = col""")
def r9_mask_by_outline(spark, sf_dir):
    """R9, SNK17, SNK18: pixels outside an outline set to 0."""
    ring = F.array(*[geom.point(x, y) for x, y in _OUTLINE])
    return X.mask_by_outline(_px(spark, sf_dir), F.array(F.array(ring)))


_DIST = """px AS (SELECT vec_id AS image, CAST(i // 8 AS INTEGER) AS r, CAST(i % 8 AS INTEGER) AS c, v > 0 AS inside
  FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)),
d AS (SELECT a.image, a.r, a.c, coalesce(min(CASE WHEN b.inside <> a.inside THEN sqrt((a.r - b.r) ** 2 + (a.c - b.c) ** 2) END), 0) * CASE WHEN a.inside THEN 1 ELSE -1 END AS v
  FROM px a JOIN px b ON a.image = b.image GROUP BY a.image, a.r, a.c, a.inside)"""


def _distance(spark, sf_dir):
    return X.pixels(X.signed_distance_tiles(read_spread(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", 8), "vec_id", "distance", 8)


@query(f'WITH {_DIST} SELECT image, r AS "row", c AS col, round(v, 6) AS value FROM d')
def r6_signed_distance(spark, sf_dir):
    """R6, P7, SNK20: signed distance transform of each tile."""
    return _distance(spark, sf_dir).withColumn("value", R("value"))


@query(f"""WITH {_DIST} SELECT image, CAST(sum(CASE WHEN v > 0 THEN 1 ELSE 0 END) AS DOUBLE) AS inside, CAST(sum(CASE WHEN abs(v) <= 1 THEN 1 ELSE 0 END) AS BIGINT) AS boundary FROM d GROUP BY image""")
def r13_segmentation(spark, sf_dir):
    """Class segmentation and sparse boundaries."""
    d = _distance(spark, sf_dir)
    a = X.class_segmentation(d).groupBy("image").agg(F.sum("value").alias("inside"))
    b = X.class_boundaries(d).groupBy("image").agg(F.sum("value").alias("boundary"))
    return a.join(b, "image", "left").select("image", "inside", F.coalesce("boundary", F.lit(0)).cast("bigint").alias("boundary"))


@query(f"""WITH {_DIST} SELECT image, r AS "row", c AS col, CAST(CASE WHEN abs(v) <= 1.5 THEN 255 WHEN v > 1.5 THEN 100 ELSE 0 END AS INTEGER) AS value FROM d""")
def r15_voc_classes(spark, sf_dir):
    """Class mask by distance to the outline."""
    return X.voc_classes(_distance(spark, sf_dir), 1.5)


@query()
def r1_polygonize(spark, sf_dir):
    """Equal-valued regions of each tile, values cut to quarters, as polygons with conf."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.floor(v * 4 + 2).cast("double")).alias("tile"))
    return X.with_confidence(X.polygonize(e, "vec_id", "tile", 8))


@query("""WITH px AS (SELECT vec_id, (i - 1) // 8 AS r, (i - 1) % 8 AS c, CAST(v AS DOUBLE) AS v FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)),
pos AS (SELECT k, greatest(0, least(7, (k + 0.5) / 2 - 0.5)) AS p FROM range(0, 16) ks(k)),
w AS (SELECT CAST(floor(p) AS INTEGER) AS i, 1 - (p - floor(p)) AS w FROM pos UNION ALL SELECT least(7, CAST(floor(p) AS INTEGER) + 1), p - floor(p) FROM pos),
s AS (SELECT i, sum(w) AS w FROM w GROUP BY i)
SELECT vec_id, 256 AS n, round(sum(v * a.w * b.w), 4) AS total FROM px JOIN s a ON a.i = r JOIN s b ON b.i = c GROUP BY vec_id""")
def r10_resample(spark, sf_dir):
    """Bilinear resampling of each tile to twice its size."""
    e = X.resample_tiles(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", 8, 2.0)
    return e.select("vec_id", F.size("resampled").alias("n"), R(F.aggregate("resampled", F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


@query("""WITH RECURSIVE px AS (SELECT vec_id, CAST((i - 1) // 8 AS INTEGER) AS r, CAST((i - 1) % 8 AS INTEGER) AS c, CAST(floor(v * 4 + 2) AS DOUBLE) AS v FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)),
near AS (SELECT a.vec_id, a.r * 8 + a.c AS f, b.r * 8 + b.c AS t FROM px a JOIN px b ON a.vec_id = b.vec_id AND a.v = b.v AND abs(a.r - b.r) + abs(a.c - b.c) = 1 WHERE a.v <> 0),
reach(vec_id, f, t) AS (SELECT vec_id, r * 8 + c, r * 8 + c FROM px WHERE v <> 0 UNION SELECT e.vec_id, e.f, n.t FROM reach e JOIN near n ON n.vec_id = e.vec_id AND n.f = e.t),
home AS (SELECT vec_id, t, min(f) AS region FROM reach GROUP BY ALL)
SELECT home.vec_id, CAST(row_number() OVER (PARTITION BY home.vec_id ORDER BY home.region) - 1 AS INTEGER) AS region, any_value(v) AS value, CAST(count(*) AS DOUBLE) AS area FROM home JOIN px ON px.vec_id = home.vec_id AND px.r * 8 + px.c = t GROUP BY home.vec_id, home.region""")
def r1_region_areas(spark, sf_dir):
    """The regions of each tile with their polygons' area."""
    e = read_spread(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.floor(v * 4 + 2).cast("double")).alias("tile"))
    return X.polygonize(e, "vec_id", "tile", 8).select("vec_id", "region", "value", R(geom.area(geom.parse_wkt(F.col("wkt"))), 6).alias("area"))


@query("""WITH RECURSIVE px AS (SELECT vec_id // 2 AS image, CAST((i - 1) // 8 AS INTEGER) AS r, CAST((i - 1) % 8 + vec_id % 2 * 8 AS INTEGER) AS c, CAST(floor(v * 4 + 2) AS DOUBLE) AS v FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)),
near AS (SELECT a.image, a.r * 16 + a.c AS f, b.r * 16 + b.c AS t FROM px a JOIN px b ON a.image = b.image AND a.v = b.v AND abs(a.r - b.r) + abs(a.c - b.c) = 1 WHERE a.v <> 0),
reach(image, f, t) AS (SELECT image, r * 16 + c, r * 16 + c FROM px WHERE v <> 0 UNION SELECT e.image, e.f, n.t FROM reach e JOIN near n ON n.image = e.image AND n.f = e.t),
home AS (SELECT image, t, min(f) AS region FROM reach GROUP BY ALL),
areas AS (SELECT home.image, home.region, any_value(v) AS value, count(*) AS area FROM home JOIN px ON px.image = home.image AND px.r * 16 + px.c = t GROUP BY home.image, home.region)
SELECT image, value, CAST(area AS BIGINT) AS area, CAST(area AS DOUBLE) AS outlined, count(*) AS n FROM areas GROUP BY ALL""")
def r1_whole_regions(spark, sf_dir):
    """Regions of rasters of two tiles each, joined across the tiles' border, with the area of their outline."""
    e = read_spread(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 2).cast("long").alias("image"), F.lit(0).alias("ty"), (F.col("vec_id") % 2).alias("tx"), F.transform("embedding", lambda v: F.floor(v * 4 + 2).cast("double")).alias("tile"))
    rows = X.polygonize_tiles(e, "image", "ty", "tx", "tile", 8)
    return rows.select("image", "value", "area", R(geom.area(geom.parse_wkt(F.col("wkt"))), 6).alias("outlined")).groupBy("image", "value", "area", "outlined").agg(F.count("*").alias("n"))


@query(f"""WITH {_DIST} SELECT image, r AS "row", c AS col, CAST(CASE WHEN abs(v) <= 1 THEN 255 WHEN v > 1 THEN image % 7 ELSE 0 END AS INTEGER) AS value FROM d""")
def r16_voc_instances(spark, sf_dir):
    """Instance mask, the feature's position inside, the border around it."""
    return X.voc_classes(_distance(spark, sf_dir), 1.0, position=F.col("image") % 7)


@query(f"""WITH {_BURN}, box AS (SELECT f_b.id, image, greatest(0, floor(xmin - 3)) AS c0, least(width - 1, floor(xmax + 3)) AS c1, greatest(0, floor(ymin - 3)) AS r0, least(height - 1, floor(ymax + 3)) AS r1 FROM f_b JOIN chips ON image = imageId),
line AS (SELECT *, unnest(range(CAST(r0 AS BIGINT), CAST(r1 + 1 AS BIGINT))) AS r FROM box), cell AS (SELECT *, unnest(range(CAST(c0 AS BIGINT), CAST(c1 + 1 AS BIGINT))) AS c FROM line),
across AS (SELECT l.id, l.image, r, c0, c1, x1 + (r + 0.5 - y1) * (x2 - x1) / (y2 - y1) AS x FROM line l JOIN f_s s ON s.id = l.id AND (y1 > r + 0.5) <> (y2 > r + 0.5)),
hit AS (SELECT id, image, r, c FROM (SELECT id, image, r, x, unnest(range(CAST(c0 AS BIGINT), CAST(least(c1 + 1, greatest(c0, ceil(x - 0.5))) AS BIGINT))) AS c FROM across) WHERE c + 0.5 < x GROUP BY ALL HAVING count(*) % 2 = 1
  UNION SELECT k.id, k.image, r, c FROM cell k JOIN (SELECT *, x2 - x1 AS dx, y2 - y1 AS dy FROM f_s) s ON s.id = k.id AND r + 0.5 BETWEEN least(y1, y2) - 3 AND greatest(y1, y2) + 3 AND c + 0.5 BETWEEN least(x1, x2) - 3 AND greatest(x1, x2) + 3
  WHERE (c + 0.5 - x1 - greatest(0, least(1, ((c + 0.5 - x1) * dx + (r + 0.5 - y1) * dy) / greatest(dx * dx + dy * dy, 1e-300))) * dx) ** 2 + (r + 0.5 - y1 - greatest(0, least(1, ((c + 0.5 - x1) * dx + (r + 0.5 - y1) * dy) / greatest(dx * dx + dy * dy, 1e-300))) * dy) ** 2 <= 9)
SELECT image, value, count(*) AS n FROM (SELECT image, r, c, arg_max(BuildingId, id) AS value FROM hit JOIN footprints ON footprint_id = id GROUP BY image, r, c) GROUP BY ALL""")
def r5_buffered(spark, sf_dir):
    """Footprints with a buffer of 3 pixels burnt on their chip, as pixels a building."""
    f = read_spread(spark, sf_dir, "footprints").where(F.col("PolygonWKT_Pix").contains("((")).select("ImageId", "footprint_id", "BuildingId", geom.parse_wkt(F.col("PolygonWKT_Pix")).alias("g"))
    c = read(spark, sf_dir, "chips").groupBy(F.col("imageId").alias("_i")).agg(F.max("width").alias("width"), F.max("height").alias("height"))
    burnt = X.rasterize(f.join(c, f["ImageId"] == c["_i"]), "ImageId", "g", "footprint_id", F.col("BuildingId"), "width", "height", buffer=3.0)
    return burnt.groupBy("image", "value").agg(F.count("*").alias("n"))


@query("""WITH px AS (SELECT vec_id, (i - 1) // 8 AS r, (i - 1) % 8 AS c, least(65535, greatest(0, floor((CAST(v AS DOUBLE) + 1) * 1000))) AS v FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings))
SELECT CAST(vec_id AS VARCHAR) AS image_id, CAST(c // 5 * 5 AS INTEGER) AS x0, CAST(r // 5 * 5 AS INTEGER) AS y0, CAST(least(5, 8 - c // 5 * 5) AS INTEGER) AS width, sum(v) AS total FROM px GROUP BY ALL""")
def snk16_rasters(spark, sf_dir):
    """SNK16, SNK17, SNK18, SRC12: a TIFF a tile, written and read again in windows of 5 pixels."""
    folder = temporary_folder(spark, "rasters")
    T.write_rasters(_tiles(spark, sf_dir).withColumn("width", F.lit(8)), "image", "tile", "width", None, None, folder, "u2")
    w = T.read_tiles(spark, folder, 5)
    return w.select("image_id", "x0", "y0", "width", F.aggregate("data", F.lit(0.0), lambda a, v: a + v).alias("total"))


@query(f'WITH {_DIST} SELECT CAST(image AS VARCHAR) AS image_id, round(sum(abs(v)), 4) AS total FROM d GROUP BY image')
def snk20_distance_arrays(spark, sf_dir):
    """SNK20: a .npy file of each tile's signed distance, written and read again."""
    folder = temporary_folder(spark, "arrays")
    tiles = X.signed_distance_tiles(read_spread(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", 8).withColumn("width", F.lit(8))
    T.write_arrays(tiles, "vec_id", "distance", "width", folder)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(folder)

    @F.pandas_udf("double")
    def total(content: pd.Series) -> pd.Series:
        return pd.Series([float(np.abs(np.load(io.BytesIO(bytes(c)))).sum()) for c in content])

    return files.select(F.regexp_extract("path", r"([^/]+)\.npy$", 1).alias("image_id"), R(total("content"), 4).alias("total"))


def queries() -> dict:
    return query.named


def oracle_sql() -> dict[str, str]:
    return query.sql
