"""Vector sources, geometry, chips, labels, tables and strings over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrasieve.functions import crs, geom
from terrasieve.operators import chips as C
from terrasieve.operators import clip as K
from terrasieve.operators import labels as L
from terrasieve.operators import matching as M
from terrasieve.operators import overlay as O
from terrasieve.operators import tables as T
from terrasieve.operators.nearby import positions
from terrasieve.plans.registry import POINTS_SQL as _POINTS_SQL
from terrasieve.plans.registry import Registry, overlap_sql, union_sql, vertices_sql
from terrasieve.session import temporary_folder, read, read_spread
from terrasieve.sources import geojson as G
from terrasieve.sources import reports as S

query = Registry()
R = lambda c, n=6: F.round(c, n)
_PIX = vertices_sql("f", "footprints", "footprint_id", "ImageId", "PolygonWKT_Pix", "true")
_GEO = vertices_sql("f", "footprints", "footprint_id", "ImageId", "PolygonWKT_Geo", "true")


def _pix_rows(spark, sf_dir):
    return read_spread(spark, sf_dir, "footprints").where(F.col("PolygonWKT_Pix").contains("(("))


def _pix(spark, sf_dir):
    """footprints with a pixel polygon, parsed."""
    return geom.once(_pix_rows(spark, sf_dir), ["footprint_id", "ImageId", "BuildingId"], g=geom.parse_wkt(F.col("PolygonWKT_Pix")))


# sources


@query("""SELECT file_id, geoVectorName AS source, coalesce(json_extract_string(f, '$.properties.ImageId'), '') AS ImageId,
  CAST(json_extract_string(f, '$.properties.BuildingId') AS INTEGER) AS BuildingId, json_extract_string(f, '$.geometry.type') AS kind
FROM (SELECT file_id, geoVectorName, unnest(json_extract(body, '$.features[*]')) AS f FROM vector_files WHERE json_valid(body))
WHERE CAST(json_extract_string(f, '$.properties.BuildingId') AS INTEGER) IS DISTINCT FROM -1""")
def src1_summary_geojson(spark, sf_dir):
    """SRC1, F1, S17: features of summary files without placeholder rows; null BuildingIds stay."""
    rows = G.features(read(spark, sf_dir, "vector_files"), "body", ["file_id", "geoVectorName"])
    rows = rows.select("file_id", F.col("geoVectorName").alias("source"), F.coalesce(F.get_json_object("properties", "$.ImageId"), F.lit("")).alias("ImageId"), F.get_json_object("properties", "$.BuildingId").try_cast("int").alias("BuildingId"), "kind")
    return G.without_placeholders(rows)


@query("""SELECT file_id, regexp_extract(geoVectorName, '([^/]+?)(\\.[^./]*)?$', 1) AS ImageId, CAST(generate_subscripts(fs, 1) AS INTEGER) AS BuildingId
FROM (SELECT file_id, geoVectorName, json_extract(body, '$.features[*]') AS fs FROM vector_files WHERE json_valid(body))""")
def src2_chip_geojson(spark, sf_dir):
    """SRC2, W6, S1: ImageId from the file's base name, BuildingId 1..n in file order."""
    return G.chip_features(read(spark, sf_dir, "vector_files"), "body", "geoVectorName", ["file_id"]).select("file_id", "ImageId", "BuildingId")


@query("""SELECT file_id, CAST(CASE WHEN json_valid(body) THEN coalesce(json_array_length(body, '$.features'), 0) ELSE 0 END AS INTEGER) AS n_features,
  CASE WHEN json_valid(body) AND json_array_length(body, '$.features') > 0 THEN [1] ELSE [] END AS classes FROM vector_files""")
def src11_classes_present(spark, sf_dir):
    """SRC11, SRC4, AG10: number of features and the classes present; unreadable or empty files have none."""
    return G.classes_present(read(spark, sf_dir, "vector_files"), "body").select("file_id", "n_features", "classes")


@query("""SELECT imageId, round(tr_c, 6) AS "left", round(tr_f, 6) AS top, round(tr_a * width + tr_b * height + tr_c, 6) AS "right", round(tr_d * width + tr_e * height + tr_f, 6) AS bottom,
  printf('POLYGON ((%.6f %.6f, %.6f %.6f, %.6f %.6f, %.6f %.6f, %.6f %.6f))', tr_c, tr_f, tr_c, tr_d * width + tr_e * height + tr_f, tr_a * width + tr_b * height + tr_c, tr_d * width + tr_e * height + tr_f,
  tr_a * width + tr_b * height + tr_c, tr_f, tr_c, tr_f) AS outline FROM chips""")
def src6_raster_extent(spark, sf_dir):
    """SRC6, SRC7, A6: extents and outline polygon of every raster from its transform and size."""
    c = C.extent(read(spark, sf_dir, "chips"))
    ring = geom.corners(F.col("left"), F.col("bottom"), F.col("right"), F.col("top"))
    return c.select("imageId", *[R(x).alias(x) for x in ("left", "top", "right", "bottom")], geom.format_wkt(F.array(F.array(ring)), 6).alias("outline"))


# geometry


@query(f"""WITH {_PIX}, len AS (SELECT id, sum(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))) AS l FROM f_s GROUP BY id),
cen AS (SELECT id, sum(cx * s) AS mx, sum(cy * s) AS my FROM (
  SELECT s.id, s.part, s.ring, sum((x1 + x2) * (x1 * y2 - x2 * y1)) / 6 * any_value(sign(o.a)) AS cx, sum((y1 + y2) * (x1 * y2 - x2 * y1)) / 6 * any_value(sign(o.a)) AS cy, CASE WHEN s.ring = 1 THEN 1 ELSE -1 END AS s
  FROM f_s s JOIN f_o o USING (id, part, ring) GROUP BY ALL) GROUP BY id)
SELECT id AS footprint_id, round(area, 6) AS area, round(l, 4) AS length, round(mx / area, 3) AS cx, round(my / area, 3) AS cy, xmin, ymin, xmax, ymax FROM f_b JOIN len USING (id) JOIN cen USING (id)""")
def a22_measures(spark, sf_dir):
    """Area, perimeter, centroid and envelope of parsed polygons with holes and parts."""
    g = F.col("g")
    rows = geom.once(_pix(spark, sf_dir), ["footprint_id"], area=geom.area(g), length=geom.perimeter(g), c=geom.centroid(g), b=geom.box(g))
    return rows.select("footprint_id", R("area", 6).alias("area"), R("length", 4).alias("length"), R("c.x", 3).alias("cx"), R("c.y", 3).alias("cy"), "b.xmin", "b.ymin", "b.xmax", "b.ymax")


@query(f"""WITH {_GEO}, p AS (SELECT id, (tr_e * (x - tr_c) - tr_b * (y - tr_f)) / (tr_a * tr_e - tr_b * tr_d) AS px, (tr_a * (y - tr_f) - tr_d * (x - tr_c)) / (tr_a * tr_e - tr_b * tr_d) AS py
  FROM f_v JOIN chips ON image = imageId)
SELECT id AS footprint_id, round(min(px), 3) AS xmin, round(min(py), 3) AS ymin, round(max(px), 3) AS xmax, round(max(py), 3) AS ymax FROM p GROUP BY id""")
def a1_geo_to_pixel(spark, sf_dir):
    """A1, A3, L2, SRC4: geographic polygons in their chip's pixels."""
    f = read(spark, sf_dir, "footprints").where(F.col("PolygonWKT_Geo").contains("((")).select("footprint_id", F.col("ImageId").alias("image"), "PolygonWKT_Geo")
    tr = [F.col(f"tr_{x}") for x in "abcdef"]
    j = f.join(read(spark, sf_dir, "chips").select(F.col("imageId").alias("image"), *tr), "image")
    g = geom.once(j, ["footprint_id", *tr], g=geom.parse_wkt(F.col("PolygonWKT_Geo")))
    p = geom.once(g, ["footprint_id"], p=geom.map_points(F.col("g"), geom.geo_to_pixel(*tr)))
    return geom.once(p, ["footprint_id"], b=geom.box(F.col("p"))).select("footprint_id", *[R(f"b.{x}", 3).alias(x) for x in ("xmin", "ymin", "xmax", "ymax")])


@query(f"""WITH {_PIX}, p AS (SELECT id, tr_a * x + tr_b * y + tr_c AS gx, tr_d * x + tr_e * y + tr_f AS gy FROM f_v JOIN chips ON image = imageId)
SELECT id AS footprint_id, round(min(gx), 9) AS xmin, round(min(gy), 9) AS ymin, round(max(gx), 9) AS xmax, round(max(gy), 9) AS ymax FROM p GROUP BY id""")
def a2_pixel_to_geo(spark, sf_dir):
    """A2, A3, SNK14: pixel polygons in degrees."""
    tr = [F.col(f"tr_{x}") for x in "abcdef"]
    j = _pix(spark, sf_dir).select("footprint_id", F.col("ImageId").alias("image"), "g").join(read(spark, sf_dir, "chips").select(F.col("imageId").alias("image"), *tr), "image")
    p = geom.once(j, ["footprint_id"], p=geom.map_points(F.col("g"), geom.pixel_to_geo(*tr)))
    return geom.once(p, ["footprint_id"], b=geom.box(F.col("p"))).select("footprint_id", *[R(f"b.{x}", 9).alias(x) for x in ("xmin", "ymin", "xmax", "ymax")])


@query(f"""WITH {_PIX}, r AS (SELECT id, part, ring, string_agg(printf('%.0f %.0f', round_even(x, 0), round_even(y, 0)), ', ' ORDER BY k) AS t FROM f_v GROUP BY ALL),
p AS (SELECT id, part, '(' || string_agg('(' || t || ')', ', ' ORDER BY ring) || ')' AS t FROM r GROUP BY ALL)
SELECT id AS footprint_id, CASE WHEN count(*) = 1 THEN 'POLYGON ' || any_value(t) ELSE 'MULTIPOLYGON (' || string_agg(t, ', ' ORDER BY part) || ')' END AS wkt FROM p GROUP BY id""")
def a18_rounded_wkt(spark, sf_dir):
    """Coordinates rounded half to even and written as WKT with fixed decimals."""
    return _pix(spark, sf_dir).select("footprint_id", geom.format_wkt(geom.reduce_precision(F.col("g"), 0), 0).alias("wkt"))


@query(f"""WITH {_PIX} SELECT id AS footprint_id, CAST(part - 1 AS INTEGER) AS part, CAST(max(ring) AS INTEGER) AS rings, CAST(count(*) AS INTEGER) AS vertices FROM f_v GROUP BY id, part""")
def s13_exploded_parts(spark, sf_dir):
    """Multi geometries split into parts, other columns repeated."""
    rows = _pix(spark, sf_dir).select("footprint_id", F.posexplode("g").alias("part", "p"))
    return rows.select("footprint_id", "part", F.size("p").alias("rings"), F.size(F.flatten("p")).alias("vertices"))


@query(f"""WITH {_PIX}, l AS (SELECT id, max(CASE WHEN k = 1 THEN x END) AS ax, max(CASE WHEN k = 1 THEN y END) AS ay, max(CASE WHEN k = 2 THEN x END) AS bx, max(CASE WHEN k = 2 THEN y END) AS by_,
  max(CASE WHEN k = 3 THEN x END) AS cx, max(CASE WHEN k = 3 THEN y END) AS cy, max(CASE WHEN k = 4 THEN x END) AS dx, max(CASE WHEN k = 4 THEN y END) AS dy FROM f_v WHERE part = 1 AND ring = 1 GROUP BY id),
d AS (SELECT id, BuildingId % 2 = 0 AS plane, CASE WHEN BuildingId % 2 = 0 THEN sqrt((ax - cx) ** 2 + (ay - cy) ** 2) ELSE sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) END AS length,
  sqrt((bx - dx) ** 2 + (by_ - dy) ** 2) AS wings, CASE WHEN BuildingId % 2 = 0 THEN degrees(atan2(ax - cx, ay - cy)) ELSE degrees(atan2(bx - ax, by_ - ay)) END AS deg,
  abs((ax - cx) * (by_ - dy) - (bx - dx) * (ay - cy)) / 2 AS quad FROM l JOIN footprints ON footprint_id = id)
SELECT id AS footprint_id, round(length, 4) AS length, round(CASE WHEN plane THEN wings ELSE length / 3 END, 4) AS width, round(CASE WHEN plane THEN length / wings ELSE 3 END, 3) AS aspect,
  round(CASE WHEN deg < 0 THEN deg + 360 ELSE deg END, 3) AS compass, round(CASE WHEN plane THEN quad ELSE length * length / 3 END, 6) AS area FROM d""")
def a12_line_labels(spark, sf_dir):
    """Aircraft from 4-point and vessels from 2-point lines, drawn from the footprints' first vertices."""
    line = F.slice(F.get(F.get("g", F.lit(0)), F.lit(0)), 1, 4)
    rows = _pix(spark, sf_dir).select("footprint_id", geom.feature_label(line, F.when(F.col("BuildingId") % 2 == 0, "Airplane").otherwise("Boat")).alias("l"))
    return rows.select("footprint_id", R("l.length", 4).alias("length"), R("l.width", 4).alias("width"), R("l.aspect", 3).alias("aspect"), R("l.compass", 3).alias("compass"), R(geom.area(F.array(F.array("l.ring"))), 6).alias("area"))


_UTM = crs.forward_sql("lon", "lat", "zone")


@query(f"""WITH {_POINTS_SQL}, z AS (SELECT *, CAST(floor(1 + (lon + 180) / 6) AS INTEGER) AS zone FROM pt)
SELECT point_id, zone, CASE WHEN lat < 0 THEN 0 ELSE 1 END AS northern, round({_UTM["easting"]}, 3) AS easting, round({_UTM["northing"]}, 3) AS northing,
  '+proj=utm +zone=' || zone || CASE WHEN lat < 0 THEN ' +south' ELSE ' +north' END || ' +datum=WGS84 +units=m +no_defs' AS proj FROM z""")
def a16_utm(spark, sf_dir):
    """Zone, hemisphere and UTM coordinates of positions."""
    p = positions(read(spark, sf_dir, "scene_points"), "point_id", "geometry")
    rows = p.select(F.col("id").alias("point_id"), crs.utm_forward(F.col("lon"), F.col("lat")).alias("u"), crs.utm_proj(F.col("lon"), F.col("lat")).alias("proj"))
    return rows.select("point_id", "u.zone", "u.northern", R("u.easting", 3).alias("easting"), R("u.northing", 3).alias("northing"), "proj")


_UTM_FIRST = crs.forward_sql("lon", "lat", "z0")


@query(f"""WITH {_POINTS_SQL}, fr AS (SELECT *, CAST(floor((lon - 10 - 360 * floor((lon - 10) / 360)) / 20) AS INTEGER) AS frame FROM pt),
z AS (SELECT point_id, lon, lat, z0 FROM fr JOIN (SELECT frame, CAST(floor(1 + (arg_min(lon, point_id) + 180) / 6) AS INTEGER) AS z0 FROM fr GROUP BY frame) USING (frame))
SELECT point_id, z0 AS zone, round({_UTM_FIRST["easting"]}, 2) AS easting, round({_UTM_FIRST["northing"]}, 2) AS northing FROM z""")
def a17_frame_to_utm(spark, sf_dir):
    """Frames in the zone of their first feature.

    The positions belong to no file, so a frame is a strip of 20 degrees, from 10 degrees on eastwards;
    the strip from 170 degrees goes on beyond 180.
    """
    p = positions(read(spark, sf_dir, "scene_points"), "point_id", "geometry").withColumn("frame", F.floor(F.pmod(F.col("lon") - 10, F.lit(360.0)) / 20).cast("int"))
    zones = p.groupBy("frame").agg(crs.utm_zone(F.min_by("lon", "id")).alias("zone"))  # 18 rows at most
    rows = p.join(F.broadcast(zones), "frame").select(F.col("id").alias("point_id"), crs.utm_forward(F.col("lon"), F.col("lat"), F.col("zone")).alias("u"))
    return rows.select("point_id", "u.zone", R("u.easting", 2).alias("easting"), R("u.northing", 2).alias("northing"))


@query(f"""WITH m AS (SELECT imageId, (tr_c + tr_a * width + tr_b * height + tr_c) / 2 AS lon, (tr_f + tr_d * width + tr_e * height + tr_f) / 2 AS lat FROM chips),
{crs.circle_box_sql("c", "m", "imageId", "lon", "lat", 100.0)}
SELECT imageId, round(xmin, 6) AS xmin, round(ymin, 6) AS ymin, round(xmax, 6) AS xmax, round(ymax, 6) AS ymax FROM c_box""")
def a7_metric_square(spark, sf_dir):
    """100 m around every chip's centre: the buffer's 64 vertices in UTM, taken back, then their envelope."""
    c = C.extent(read(spark, sf_dir, "chips")).select("imageId", ((F.col("left") + F.col("right")) / 2).alias("lon"), ((F.col("top") + F.col("bottom")) / 2).alias("lat"))
    return T.metric_square(c, "lon", "lat", 100.0).select("imageId", *[R(f"box.{x}").alias(x) for x in ("xmin", "ymin", "xmax", "ymax")])


# joins and chips


@query(f"""WITH {_GEO}, c AS (SELECT row_number() OVER () AS cid, imageId, tr_c AS l, tr_f AS t, tr_a * width + tr_c AS r, tr_e * height + tr_f AS b FROM chips),
near AS (SELECT f_b.id AS pid, cid AS tid, area FROM f_b JOIN c ON xmin <= r AND l <= xmax AND ymin <= t AND b <= ymax),
c_e AS (SELECT cid AS id, l AS x1, b AS y1, r AS x2, b AS y2, -1 AS s FROM c UNION ALL SELECT cid, l, t, r, t, 1 FROM c),
sh AS ({overlap_sql("near", "f_e", "c_e")}),
res AS (SELECT imageId, pid AS footprint_id, shared / area AS partialDec FROM near JOIN sh USING (pid, tid) JOIN c ON cid = tid)
SELECT imageId, footprint_id, round(partialDec, 4) AS partialDec FROM res WHERE partialDec > 1e-4""")
def l7_clip_to_chips(spark, sf_dir):
    """All features against all chips through the grid join, with the share inside."""
    geo = read_spread(spark, sf_dir, "footprints").where(F.col("PolygonWKT_Geo").contains("(("))
    f = M.polygon_table(geo, "footprint_id", "ImageId", "PolygonWKT_Geo").select(F.col("id").alias("footprint_id"), "area", "xmin", "ymin", "xmax", "ymax", "edges")
    c = C.extent(read(spark, sf_dir, "chips")).select("imageId", "left", "bottom", "right", "top")
    pairs = C.box_join(f, c, ["xmin", "ymin", "xmax", "ymax"], ["left", "bottom", "right", "top"], 0.002)
    return C.clip_features(pairs, "edges", "area", ["left", "bottom", "right", "top"], 1e-4).select("imageId", "footprint_id", R("partialDec", 4).alias("partialDec"))


def cut_sql(pairs: str, boxes: str) -> str:
    """CTEs that end in cut (pid, tid, shared, xmin, ymin, xmax, ymax): area and bounds of f's polygons inside boxes (tid, l, b, r, t)."""
    t = lambda p, d, lo, hi, best, at: f"CASE WHEN {d} <> 0 THEN {best}(({lo} - {p}) / {d}, ({hi} - {p}) / {d}) WHEN {p} BETWEEN {lo} AND {hi} THEN {'-' * (at < 0)}1e300 ELSE {'-' * (at > 0)}1e300 END"
    return f"""box_e AS (SELECT tid AS id, l AS x1, b AS y1, r AS x2, b AS y2, -1 AS s FROM {boxes} UNION ALL SELECT tid, l, t, r, t, 1 FROM {boxes}),
shares AS ({overlap_sql(pairs, "f_e", "box_e")}),
way AS (SELECT pid, tid, l, b, r, t, x1, y1, x2 - x1 AS dx, y2 - y1 AS dy FROM {pairs} JOIN f_s ON f_s.id = pid JOIN {boxes} USING (tid)),
part AS (SELECT *, greatest(0, {t("x1", "dx", "l", "r", "least", -1)}, {t("y1", "dy", "b", "t", "least", -1)}) AS t0, least(1, {t("x1", "dx", "l", "r", "greatest", 1)}, {t("y1", "dy", "b", "t", "greatest", 1)}) AS t1 FROM way),
corner AS (SELECT pid, tid, unnest([l, l, r, r]) AS x, unnest([b, t, b, t]) AS y FROM {pairs} JOIN {boxes} USING (tid)),
within AS (SELECT pid, tid, x, y FROM corner JOIN f_s ON f_s.id = pid AND (y1 > y) <> (y2 > y) AND x < x1 + (y - y1) * (x2 - x1) / (y2 - y1) GROUP BY ALL HAVING count(*) % 2 = 1),
spots AS (SELECT pid, tid, greatest(l, least(r, x1 + k * dx)) AS x, greatest(b, least(t, y1 + k * dy)) AS y FROM (SELECT *, unnest([t0, t1]) AS k FROM part WHERE t0 <= t1) UNION ALL SELECT * FROM within),
cut AS (SELECT pid, tid, shared, xmin, ymin, xmax, ymax FROM shares JOIN (SELECT pid, tid, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM spots GROUP BY ALL) USING (pid, tid))"""


def _bounds(df, keys: list[str], digits: int):
    b = geom.box(geom.parse_wkt(F.col("geometry")))
    rows = df.select(*keys, R("partialDec", 4).alias("partialDec"), "truncated", b.alias("b"))
    return rows.select(*keys, "partialDec", "truncated", *[R(f"b.{c}", digits).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


_HALVES = "(SELECT imageId || '/' || q AS tid, width / 2.0 * q AS l, 0.0 AS b, width / 2.0 * (q + 1) AS r, height / 2.0 AS t, imageId FROM chips, range(0, 2) qs(q))"


@query(f"""WITH {_PIX}, h AS {_HALVES}, near AS (SELECT f_b.id AS pid, tid FROM f_b JOIN h ON f_b.image = h.imageId AND xmin <= r AND l <= xmax AND ymin <= t AND b <= ymax), {cut_sql("near", "h")}
SELECT tid AS chip, pid AS footprint_id, round(shared / f_a.area, 4) AS partialDec, CAST(abs(shared / f_a.area - 1) > 1e-9 AS INTEGER) AS truncated, round(xmin, 3) AS xmin, round(ymin, 3) AS ymin, round(xmax, 3) AS xmax, round(ymax, 3) AS ymax
FROM cut JOIN f_a ON f_a.id = pid WHERE shared / f_a.area > 0.1 + 1e-9""")
def l7_cut_features(spark, sf_dir):
    """Footprints cut to the two upper quarters of their chip, with share, truncation and the cut polygon's bounds."""
    f = M.polygon_table(_pix_rows(spark, sf_dir), "footprint_id", "ImageId", "PolygonWKT_Pix", keep=True)
    c = read(spark, sf_dir, "chips").select(F.col("imageId").alias("_image"), "width", "height", F.explode(F.array(F.lit(0), F.lit(1))).alias("q"))
    half = F.col("width") / 2.0
    c = c.select("_image", F.concat_ws("/", "_image", "q").alias("chip"), (half * F.col("q")).alias("left"), F.lit(0.0).alias("bottom"), (half * (F.col("q") + 1)).alias("right"), (F.col("height") / 2.0).alias("top"))
    pairs = C.box_join(f.drop("edges"), c, ["xmin", "ymin", "xmax", "ymax"], ["left", "bottom", "right", "top"], 325.0, ("image_id", "_image"))
    cut = K.cut_features(pairs.select("chip", F.col("id").alias("footprint_id"), "wkt", "left", "bottom", "right", "top"), "wkt", ["left", "bottom", "right", "top"], least_share=0.1)
    return _bounds(cut, ["chip", "footprint_id"], 3)


@query(f"""WITH {_POINTS_SQL}, {_GEO}, {crs.circle_box_sql("o", "pt", "point_id", "lon", "lat", 20.0)}, ob AS (SELECT point_id AS tid, xmin AS l, ymin AS b, xmax AS r, ymax AS t FROM o_box),
near AS (SELECT f_b.id AS pid, tid FROM f_b JOIN ob ON xmin <= r AND l <= xmax AND ymin <= t AND b <= ymax), {cut_sql("near", "ob")}
SELECT tid AS point_id, pid AS footprint_id, round(shared / f_a.area, 4) AS partialDec, CAST(abs(shared / f_a.area - 1) > 1e-9 AS INTEGER) AS truncated, round(xmin, 9) AS xmin, round(ymin, 9) AS ymin, round(xmax, 9) AS xmax, round(ymax, 9) AS ymax
FROM cut JOIN f_a ON f_a.id = pid WHERE shared / f_a.area > 1e-4""")
def l10_cut_features(spark, sf_dir):
    """Footprints cut to the chips of 20 m around every object."""
    p = positions(read_spread(spark, sf_dir, "scene_points"), "point_id", "geometry")
    o = T.object_centred(p, "lon", "lat", 20.0).select(F.col("id").alias("point_id"), F.col("box.xmin").alias("left"), F.col("box.ymin").alias("bottom"), F.col("box.xmax").alias("right"), F.col("box.ymax").alias("top"))
    geo = read_spread(spark, sf_dir, "footprints").where(F.col("PolygonWKT_Geo").contains("(("))
    f = M.polygon_table(geo, "footprint_id", "ImageId", "PolygonWKT_Geo", keep=True).drop("edges", "image_id")
    pairs = C.box_join(o, f, ["left", "bottom", "right", "top"], ["xmin", "ymin", "xmax", "ymax"], 0.001)
    cut = K.cut_features(pairs.select("point_id", F.col("id").alias("footprint_id"), "wkt", "left", "bottom", "right", "top"), "wkt", ["left", "bottom", "right", "top"], least_share=1e-4 - 1e-9)
    return _bounds(cut, ["point_id", "footprint_id"], 9)


@query(f"""WITH {_PIX}, way AS (SELECT id, x1, y1, x2 - x1 AS dx, y2 - y1 AS dy FROM f_s WHERE part = 1 AND ring = 1),
p AS (SELECT id, sqrt(dx * dx + dy * dy) AS d, greatest(0, CASE WHEN dx <> 0 THEN least((100 - x1) / dx, (300 - x1) / dx) WHEN x1 BETWEEN 100 AND 300 THEN 0 ELSE 2 END, CASE WHEN dy <> 0 THEN least((100 - y1) / dy, (300 - y1) / dy) WHEN y1 BETWEEN 100 AND 300 THEN 0 ELSE 2 END) AS t0,
  least(1, CASE WHEN dx <> 0 THEN greatest((100 - x1) / dx, (300 - x1) / dx) ELSE 1 END, CASE WHEN dy <> 0 THEN greatest((100 - y1) / dy, (300 - y1) / dy) ELSE 1 END) AS t1 FROM way),
l AS (SELECT id, sum(d) AS origlen, sum(CASE WHEN t0 < t1 THEN (t1 - t0) * d ELSE 0 END) AS length FROM p GROUP BY id)
SELECT id AS footprint_id, round(origlen, 4) AS origlen, round(length, 4) AS length, 1.0::DOUBLE AS partialDec, 0 AS truncated FROM l WHERE length > 0""")
def l7_cut_lines(spark, sf_dir):
    """Lines (the footprints' outer rings) cut to a box of 200 pixels; mixed leftovers drop out, shares stay 1."""
    ring = F.get(F.get("g", F.lit(0)), F.lit(0))
    rows = _pix(spark, sf_dir).select("footprint_id", geom.line_wkt(ring).alias("wkt"), *[F.lit(v).alias(n) for n, v in (("left", 100.0), ("bottom", 100.0), ("right", 300.0), ("top", 300.0))])
    cut = K.cut_features(rows, "wkt", ["left", "bottom", "right", "top"], "LineString").where(F.col("kind").isin("LineString", "MultiLineString"))
    pieces = F.regexp_extract_all("geometry", F.lit(r"(\([^()]+\))"), 1)
    length = F.aggregate(F.transform(pieces, lambda p: geom.line_length(geom.parse_line(F.concat(F.lit("LINESTRING "), p)))), F.lit(0.0), lambda a, v: a + v)
    return cut.select("footprint_id", R("origlen", 4).alias("origlen"), R(length, 4).alias("length"), "partialDec", "truncated")


@query("""SELECT c.imageId, count(f.footprint_id) AS n_features FROM chips c LEFT JOIN footprints f ON f.ImageId = c.imageId AND f.PolygonWKT_Geo LIKE '%((%' GROUP BY ALL""")
def j5_outputs_per_tile(spark, sf_dir):
    """Every tile emits an output, also without features."""
    f = read(spark, sf_dir, "footprints").where(F.col("PolygonWKT_Geo").contains("((")).groupBy(F.col("ImageId").alias("_i")).agg(F.count("*").alias("n"))
    c = read(spark, sf_dir, "chips")
    return c.join(f, c["imageId"] == f["_i"], "left").select("imageId", F.coalesce("n", F.lit(0)).cast("long").alias("n_features"))


@query("""SELECT imageId, CAST(least(y, height - 256) AS INTEGER) AS y0, CAST(least(x, width - 256) AS INTEGER) AS x0, count(*) AS n FROM chips, range(0, 650, 200) ys(y), range(0, 650, 200) xs(x)
WHERE y < height AND x < width GROUP BY ALL""")
def w2_clamped_windows(spark, sf_dir):
    """Sliding windows moved back inside, repeats kept."""
    rows = C.sliding_windows(read(spark, sf_dir, "chips").select("imageId", "width", "height"), "width", "height", 200, 256, True)
    return rows.groupBy("imageId", "y0", "x0").agg(F.count("*").alias("n"))


@query("""SELECT imageId, count(*) AS n_windows, CAST(max(x) + 256 AS INTEGER) AS x1, CAST(max(y) + 256 AS INTEGER) AS y1 FROM chips, range(0, 650, 192) ys(y), range(0, 650, 192) xs(x) WHERE y < height AND x < width GROUP BY ALL""")
def w1_scene_tiles(spark, sf_dir):
    """W1, SRC12: unclamped windows at a stride fraction of 0.75."""
    rows = C.sliding_windows(read(spark, sf_dir, "chips").select("imageId", "width", "height"), "width", "height", C.stride_of(256, 0.75), 256, False)
    return rows.groupBy("imageId").agg(F.count("*").alias("n_windows"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


@query("""WITH c AS (SELECT aoi, imageId, tr_c AS l, tr_e * height + tr_f AS b, tr_a * width + tr_c AS r, tr_f AS t FROM chips),
first AS (SELECT aoi, arg_min(l, imageId) AS l0 FROM c GROUP BY aoi),
near AS (SELECT aoi, l + 360 * round_even((l0 - l) / 360, 0) AS l, b, r + 360 * round_even((l0 - l) / 360, 0) AS r, t FROM c JOIN first USING (aoi)),
base AS (SELECT aoi, floor((min(l) + 180) / 360) * 360 AS m FROM near GROUP BY aoi),
u AS (SELECT aoi, l - m AS l, b, r - m AS r, t FROM near JOIN base USING (aoi)),
e AS (SELECT aoi, min(l) AS xmin, min(b) AS ymin, max(r) AS xmax, max(t) AS ymax FROM u GROUP BY aoi),
g AS (SELECT aoi, ix, iy, xmin + ix * 0.004 AS gl, ymin + iy * 0.004 AS gb FROM e, range(0, 400) xs(ix), range(0, 400) ys(iy) WHERE ix < ceil((xmax - xmin) / 0.004) AND iy < ceil((ymax - ymin) / 0.004)),
k AS (SELECT DISTINCT aoi, ix, iy FROM g JOIN u USING (aoi) WHERE gl <= r AND l <= gl + 0.005 AND gb <= t AND b <= gb + 0.005)
SELECT aoi, CAST(ix AS INTEGER) AS ix, CAST(iy AS INTEGER) AS iy, CAST(row_number() OVER (PARTITION BY aoi ORDER BY ix, iy) AS INTEGER) AS chip_no,
  aoi || '_img' || row_number() OVER (PARTITION BY aoi ORDER BY ix, iy) || '.tif' AS name FROM k""")
def l9_grid_chips(spark, sf_dir):
    """Each area's grid; cells that meet an outline are numbered x-major and named.

    Areas that lie across 180 degrees are one grid.
    """
    c = C.unwrapped(C.extent(read(spark, sf_dir, "chips")), "aoi", "imageId")
    area = c.groupBy("aoi").agg(F.min("left").alias("xmin"), F.min("bottom").alias("ymin"), F.max("right").alias("xmax"), F.max("top").alias("ymax"))
    cells = C.grid(area, 0.004, 0.005).select(F.col("aoi").alias("grid_aoi"), "ix", "iy", "cell_left", "cell_bottom", "cell_right", "cell_top")
    met = C.box_join(cells, c.select("aoi", "left", "bottom", "right", "top"), ["cell_left", "cell_bottom", "cell_right", "cell_top"], ["left", "bottom", "right", "top"], 0.004).where("aoi = grid_aoi")
    kept = met.groupBy("aoi", "ix", "iy").agg(F.first("cell_left").alias("l"), F.first("cell_bottom").alias("b"))
    kept = C.ordered_index(kept, [F.col("aoi"), F.col("ix"), F.col("iy")], "_n")
    kept = kept.join(kept.groupBy("aoi").agg(F.min("_n").alias("_first")), "aoi").withColumn("chip_no", (F.col("_n") - F.col("_first") + 1).cast("int"))
    return kept.select("aoi", "ix", "iy", "chip_no", C.chip_name(F.col("aoi"), F.col("chip_no"), F.col("l"), F.col("b")).alias("name"))


@query(f"""WITH g AS ({query.sql["l9_grid_chips"]}), l AS (SELECT *, unnest(['PAN', 'RGB']) AS layer FROM g)
SELECT layer, '/out/' || layer || '/clip_' || layer || '_' || aoi || '_img' || chip_no || '.tif' AS rasterSource, 'clip_' || layer || '_' || aoi || '_img' || chip_no || '.tif' AS chipName,
  '/out/geojson/buildings/clip_buildings_' || aoi || '_img' || chip_no || '.geojson' AS geoVectorName FROM l""")
def l8_chip_summary(spark, sf_dir):
    """Names of every grid chip's rasters and vectors, a row a raster layer."""
    cells = l9_grid_chips(spark, sf_dir)
    rows = C.chip_summary(cells, F.col("aoi"), F.col("chip_no"), F.lit(0.0), F.lit(0.0), ["PAN", "RGB"], ["buildings"], "/out", "clip_")
    return rows.select("layer", "rasterSource", "chipName", F.col("geoVectorName")[0].alias("geoVectorName"))


@query("""SELECT CAST(row_number() OVER (ORDER BY chipName) AS BIGINT) AS position, chipName FROM chips""")
def o1_positions(spark, sf_dir):
    """O1, SRC9: place of every file in sorted order, ranked by ranges and not in one task."""
    return C.ordered_index(read(spark, sf_dir, "chips").select("chipName"), [F.col("chipName")], "position", 1)


@query("""SELECT a.position, chipName, geoVectorName FROM (SELECT row_number() OVER (ORDER BY chipName, imageId) AS position, chipName FROM chips) a
JOIN (SELECT row_number() OVER (ORDER BY geoVectorName, imageId) AS position, geoVectorName FROM chips) b USING (position)""")
def j7_paired_by_position(spark, sf_dir):
    """J7, SRC9: rasters and vectors paired by sorted position."""
    c = read(spark, sf_dir, "chips")
    return C.pair_by_position(c.select("chipName"), c.select("geoVectorName"), "chipName", "geoVectorName")


@query("""WITH r AS (SELECT imageId, row_number() OVER (ORDER BY md5('7' || imageId), imageId) - 1 AS k, (SELECT count(*) FROM chips) AS n FROM chips)
SELECT imageId, CASE WHEN k < floor(n * 0.6) THEN 'train' WHEN k < floor(n * 0.8) THEN 'test' ELSE 'val' END AS split FROM r""")
def o4_split(spark, sf_dir):
    """O2, O4, L12, SNK13, SNK15: a repeatable shuffle cut into 60, 20 and 20 percent."""
    return C.split_rows(read(spark, sf_dir, "chips").select("imageId"), "imageId", [("train", 0.6), ("test", 0.2), ("val", 0.2)], "7")


# labels and summaries


@query("""SELECT c.imageId AS ImageId, coalesce(f.BuildingId, -1) AS BuildingId, coalesce(f.PolygonWKT_Pix, 'POLYGON EMPTY') AS PolygonWKT_Pix, coalesce(f.PolygonWKT_Geo, 'POLYGON EMPTY') AS PolygonWKT_Geo
FROM chips c LEFT JOIN (SELECT * FROM footprints WHERE BuildingId <> -1) f ON f.ImageId = c.imageId""")
def snk3_summary_rows(spark, sf_dir):
    """SNK3, SNK5, SNK6, SNK7, Q4: summary rows with a sentinel for chips without buildings."""
    return L.summary_rows(read(spark, sf_dir, "chips"), read(spark, sf_dir, "footprints"))


_OBJECTS = f"""WITH {_PIX}, o AS (SELECT f_b.id, f_b.image, width, height, (xmin + xmax) / 2 AS mx, (ymin + ymax) / 2 AS my, (xmax - xmin) / 2 * 1.2 AS hx, (ymax - ymin) / 2 * 1.2 AS hy
  FROM f_b JOIN chips ON f_b.image = imageId)"""


@query(f"""{_OBJECTS} SELECT id AS footprint_id, image AS image_id, round(mx - hx, 3) AS xmin, round(my - hy, 3) AS ymin, round(mx + hx, 3) AS xmax, round(my + hy, 3) AS ymax,
  round(mx / width, 6) AS rel_x, round(my / height, 6) AS rel_y, round(2 * hx / width, 6) AS rel_w, round(2 * hy / height, 6) AS rel_h FROM o""")
def l1_object_boxes(spark, sf_dir):
    """objects' boxes, resized by 1.2, in pixels and as shares of the image."""
    o = L.objects(_pix(spark, sf_dir), read(spark, sf_dir, "chips"), 1.2)
    rel = geom.relative_box(F.col("bndbox"), F.col("width"), F.col("height"))
    o = o.withColumn("rel", rel)
    return o.select("footprint_id", "image_id", *[R(f"bndbox.{x}", 3).alias(x) for x in ("xmin", "ymin", "xmax", "ymax")], *[R(f"rel.{x}").alias(f"rel_{x}") for x in "xywh"])


@query(f"""{_OBJECTS} SELECT image AS image_id, string_agg(printf('0 %.6f %.6f %.6f %.6f', round(mx / width, 6), round(my / height, 6), round(2 * hx / width, 6), round(2 * hy / height, 6)), chr(10) ORDER BY id) AS label FROM o GROUP BY image""")
def snk9_darknet(spark, sf_dir):
    """SNK9, L6, AG12: one text a chip, class always 0."""
    return L.darknet_documents(L.objects(_pix(spark, sf_dir), read(spark, sf_dir, "chips"), 1.2), 6)


@query(f"""{_OBJECTS} SELECT image AS image_id, '<annotation><folder>chips</folder><filename>' || image || '.tif</filename><source><database>public</database><annotation>building</annotation></source><size><width>' || any_value(width) ||
  '</width><height>' || any_value(height) || '</height><depth>3</depth></size><segmented>1</segmented>' || string_agg('<object><name>building</name><pose>Left</pose><truncated>0</truncated><difficult>0</difficult><bndbox><xmin>' ||
  CAST(floor(mx - hx) AS INTEGER) || '</xmin><ymin>' || CAST(floor(my - hy) AS INTEGER) || '</ymin><xmax>' || CAST(floor(mx + hx) AS INTEGER) || '</xmax><ymax>' || CAST(floor(my + hy) AS INTEGER) || '</ymax></bndbox></object>', '' ORDER BY id) || '</annotation>' AS xml
FROM o GROUP BY image""")
def snk8_voc_xml(spark, sf_dir):
    """SNK8, L3, L5, AG12: one annotation document a chip."""
    return L.voc_documents(L.objects(_pix(spark, sf_dir), read(spark, sf_dir, "chips"), 1.2), "chips", "public", "building")


# tables


@query("""SELECT ImageId, count(origarea) AS n, round(sum(origarea), 6) AS area_sum, round(avg(origarea), 8) AS area_mean, round(stddev_samp(origarea), 8) AS area_std, round(min(origarea), 8) AS area_min,
  round(quantile_cont(origarea, 0.25), 8) AS area_p25, round(quantile_cont(origarea, 0.5), 8) AS area_p50, round(quantile_cont(origarea, 0.75), 8) AS area_p75, round(max(origarea), 8) AS area_max,
  round(avg(partialDec), 8) AS part_mean, round(stddev_samp(partialDec), 8) AS part_std, round(quantile_cont(partialDec, 0.5), 8) AS part_p50 FROM chip_features GROUP BY ImageId""")
def ag3_statistics(spark, sf_dir):
    """AG3, SNK19, Q5: per-image describe of areas and shares, exact quartiles."""
    d = T.describe(read(spark, sf_dir, "chip_features"), "ImageId", {"origarea": "area", "partialDec": "part"})
    return d.select("ImageId", F.col("area_count").alias("n"), R("area_sum", 6).alias("area_sum"), *[R(f"area_{s}", 8).alias(f"area_{s}") for s in ("mean", "std", "min", "p25", "p50", "p75", "max")], *[R(f"part_{s}", 8).alias(f"part_{s}") for s in ("mean", "std", "p50")])


@query("""WITH a AS (SELECT ImageId, CAST(count(*) AS DOUBLE) AS n FROM chip_features GROUP BY 1), b AS (SELECT ImageId, avg(Confidence) AS f FROM proposals WHERE Confidence >= 0 AND Confidence <= 1 AND NOT isnan(Confidence) GROUP BY 1),
j AS (SELECT coalesce(a.ImageId, b.ImageId) AS ImageId, n, f FROM a FULL OUTER JOIN b ON a.ImageId = b.ImageId),
k AS (SELECT aoi, n, f FROM j, (SELECT unnest(['Solvane', 'Kerrimoor', 'Tashivo']) AS aoi) WHERE contains(ImageId, aoi))
SELECT aoi, joined, slope, intercept, r2, n FROM (SELECT aoi, count(*) AS joined FROM k GROUP BY aoi) JOIN (SELECT aoi, round(regr_slope(f, n), 6) AS slope, round(regr_intercept(f, n), 4) AS intercept,
  round(regr_r2(f, n), 4) AS r2, CAST(count(*) AS BIGINT) AS n FROM k WHERE f IS NOT NULL AND n IS NOT NULL GROUP BY aoi) USING (aoi)""")
def ag6_scene_regression(spark, sf_dir):
    """J9, F9, AG6, Q6, SRC13: full outer join of scene statistics and results, then least squares by area."""
    a = read(spark, sf_dir, "chip_features").groupBy("ImageId").agg(F.count("*").cast("double").alias("n"))
    b = read(spark, sf_dir, "proposals").where("Confidence >= 0 and Confidence <= 1").groupBy("ImageId").agg(F.avg("Confidence").alias("f"))
    return T.regression_by_area(a.join(b, "ImageId", "full_outer"), "ImageId", ["Solvane", "Kerrimoor", "Tashivo"], "f", "n").select("aoi", "joined", R("slope").alias("slope"), R("intercept", 4).alias("intercept"), R("r2", 4).alias("r2"), "n")


@query("""SELECT source, aoi, '/data/' || aoi || '/' || source AS location, CASE aoi WHEN 'AOI_1' THEN '#ff0000' ELSE '#0000ff' END AS fill, 0.5 AS fill_opacity, count(*) AS n FROM (
SELECT 'footprints' AS source, substr(ImageId, 1, 5) AS aoi FROM footprints UNION ALL SELECT 'proposals', substr(ImageId, 1, 5) FROM proposals) GROUP BY ALL""")
def u1_union_with_style(spark, sf_dir):
    """Frames with different columns united, with constant style columns."""
    f, p = (read(spark, sf_dir, t).withColumn("source", F.lit(t)) for t in ("footprints", "proposals"))
    rows = f.unionByName(p, allowMissingColumns=True).select("source", F.substring("ImageId", 1, 5).alias("aoi"))
    return T.with_style(rows.groupBy("source", "aoi").agg(F.count("*").alias("n")), {"AOI_1": "#ff0000"}, "#0000ff", 0.5)


@query(r"""SELECT imageId, regexp_extract(chipName, '([^/]+?)(\.[^./]*)?$', 1) AS base, split_part(imageId, '_', 1) AS first_token, regexp_replace(imageId, '^[^_]*_', '') AS stripped,
  replace(coalesce(rasterSource, ''), '.vrt', '.tif') AS raster, replace(replace(chipName, '/srv', ''), 'RGB-PanSharpen', 'RGB') AS relative, 'AOI_' || split_part(imageId, '_', 2) || '_' || split_part(imageId, '_', 3) AS area FROM chips""")
def s1_names(spark, sf_dir):
    """Base names, stripped tokens, replaced parts."""
    i = F.col("imageId")
    return read(spark, sf_dir, "chips").select(
        "imageId", T.base_name(F.col("chipName")).alias("base"), F.substring_index(i, "_", 1).alias("first_token"), F.regexp_replace(i, "^[^_]*_", "").alias("stripped"),
        F.replace(F.coalesce("rasterSource", F.lit("")), F.lit(".vrt"), F.lit(".tif")).alias("raster"), F.replace(T.strip_all(F.col("chipName"), ["/srv"]), F.lit("RGB-PanSharpen"), F.lit("RGB")).alias("relative"),
        T.area_name(F.split(i, "_")[1], F.split(i, "_")[2]).alias("area"),
    )


_TIME = "CASE WHEN try_cast({v} AS DOUBLE) IS NOT NULL THEN CAST(CAST(floor(CAST({v} AS DOUBLE)) AS BIGINT) AS VARCHAR) ELSE {v} END AS {f}"
_FILLED = "CASE WHEN coalesce(json_extract_string(body, '$.{f}'), '') IN ('', '0', 'false') THEN '2020-01-01T00:00:00' ELSE json_extract_string(body, '$.{f}') END AS {f}"


@query(f"""SELECT row_id, {_TIME.format(v="ingest_tim", f="ingest_tim")}, {_TIME.format(v="edit_date", f="edit_date")}, n_left FROM (
SELECT row_id, {_FILLED.format(f="ingest_tim")}, {_FILLED.format(f="edit_date")},
  CAST(len(list_filter(json_keys(body), lambda k: k NOT IN ('BldgId', 'note', 'ingest_tim', 'ingest_time', 'edit_date'))) AS INTEGER) AS n_left FROM feed_rows)""")
def s12_time_fields(spark, sf_dir):
    """Id keys removed, missing or falsy time fields filled with a given time; numbers shown in whole seconds."""
    props = F.from_json("body", "map<string,string>")
    rows = read(spark, sf_dir, "feed_rows").select("row_id", G.fill_times(G.drop_keys(props, ["BldgId", "note"]), ["ingest_tim", "ingest_time", "edit_date"], F.lit("2020-01-01T00:00:00")).alias("m"))
    whole = lambda f: F.coalesce(F.floor(F.col("m")[f].try_cast("double")).cast("bigint").cast("string"), F.col("m")[f]).alias(f)
    return rows.select("row_id", whole("ingest_tim"), whole("edit_date"), (F.size("m") - 3).alias("n_left"))


@query("""WITH w AS (SELECT l_orderkey AS way_id, l_partkey AS node_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS pos FROM lineitem)
SELECT way_id, CASE WHEN count(*) > 1 AND arg_min(node_id, pos) = arg_max(node_id, pos) THEN 'Polygon' ELSE 'LineString' END AS kind, string_agg(node_id || ':' || CAST(floor(p_retailprice) AS BIGINT), ' ' ORDER BY pos) AS line
FROM w JOIN part ON p_partkey = node_id GROUP BY way_id""")
def j10_ways(spark, sf_dir):
    """J10, S15, SRC10: ordered node lists of ways joined to nodes, closed ones as polygons, in way order."""
    li = read(spark, sf_dir, "lineitem")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"]
    ways = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct(*order))), lambda s: s["l_partkey"]).alias("nodes"))
    nodes = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.floor("p_retailprice").alias("lon"), F.lit(0.0).alias("lat"))
    rows = G.way_geometries(ways, nodes)
    return rows.select(F.col("id").alias("way_id"), "kind", F.array_join(F.transform("line", lambda p: F.concat_ws(":", p["node_id"].cast("string"), p["x"].cast("long").cast("string"))), " ").alias("line"))


@query("""SELECT p.proposal_id, c.chipName FROM proposals p LEFT JOIN (SELECT imageId, min(chipName) AS chipName FROM chips GROUP BY imageId) c ON p.ImageId = c.imageId""")
def j8_raster_of_image(spark, sf_dir):
    """The first raster whose name holds the image's id as whole tokens, by an equi-join on the name's pieces."""
    p = read(spark, sf_dir, "proposals").select("proposal_id", "ImageId")
    asked = p.select("ImageId").distinct()
    pieces = read(spark, sf_dir, "chips").select("chipName", F.explode(T.name_pieces(F.col("chipName"))).alias("_id"))
    c = pieces.join(asked, F.col("_id") == F.col("ImageId"), "left_semi")
    first = c.groupBy("_id").agg(F.min("chipName").alias("chipName"))
    return p.join(first, p["ImageId"] == first["_id"], "left").select("proposal_id", "chipName")


@query(f"""WITH {_POINTS_SQL}, {_GEO}, {crs.circle_box_sql("o", "pt", "point_id", "lon", "lat", 20.0)},
met AS (SELECT point_id, count(*) AS n FROM o_box o JOIN f_b f ON o.xmin <= f.xmax AND f.xmin <= o.xmax AND o.ymin <= f.ymax AND f.ymin <= o.ymax GROUP BY point_id)
SELECT point_id, coalesce(replace(label, ' ', ''), 'unknown') AS folder, round(o.xmin, 6) AS "left", round(o.ymax, 6) AS top, coalesce(n, 0) AS n_features
FROM o_box o JOIN scene_points USING (point_id) LEFT JOIN met USING (point_id)""")
def l10_object_chips(spark, sf_dir):
    """Chips of 20 m around objects in folders of their class, with the number of footprints they meet."""
    p = positions(read_spread(spark, sf_dir, "scene_points"), "point_id", "geometry", ("label",))
    o = T.object_centred(p, "lon", "lat", 20.0, "label").select(F.col("id").alias("point_id"), "folder", F.col("box.xmin").alias("left"), F.col("box.ymin").alias("bottom"), F.col("box.xmax").alias("right"), F.col("box.ymax").alias("top"))
    f = M.polygon_table(read_spread(spark, sf_dir, "footprints"), "footprint_id", "ImageId", "PolygonWKT_Geo").select("id", "xmin", "ymin", "xmax", "ymax")
    met = C.box_join(o, f, ["left", "bottom", "right", "top"], ["xmin", "ymin", "xmax", "ymax"], 0.001).groupBy("point_id").agg(F.count("*").alias("n"))
    return o.join(met, "point_id", "left").select("point_id", "folder", R("left").alias("left"), R("top").alias("top"), F.coalesce("n", F.lit(0)).alias("n_features"))


@query(f"""WITH {_PIX} SELECT id AS footprint_id, round(area, 6) AS area FROM f_b""")
def f13_repaired_area(spark, sf_dir):
    """F13, AG4: area by even-odd decomposition, which equals the plain area for valid polygons."""
    rows = O.repair(read_spread(spark, sf_dir, "footprints").where(F.col("PolygonWKT_Pix").contains("((")), "footprint_id", "PolygonWKT_Pix")
    return rows.select("footprint_id", R("area", 6).alias("area"))


@query(f"""WITH {_PIX}, pe AS (SELECT image AS grp, (id, part) AS poly, x1, y1, x2, y2 FROM f_s), {union_sql("pe")},
b AS (SELECT id, image, CAST(floor(min(x) / 325) AS BIGINT) AS cx0, CAST(floor(max(x) / 325) AS BIGINT) AS cx1, CAST(floor(min(y) / 325) AS BIGINT) AS cy0, CAST(floor(max(y) / 325) AS BIGINT) AS cy1 FROM f_v GROUP BY ALL),
n AS (SELECT image, count(*) AS cells FROM (SELECT DISTINCT image, cx, unnest(range(cy0, cy1 + 1)) AS cy FROM (SELECT *, unnest(range(cx0, cx1 + 1)) AS cx FROM b)) GROUP BY image)
SELECT grp AS "ImageId", round(area, 6) AS area, cells, f.b AS "BuildingId" FROM un JOIN n ON n.image = grp JOIN (SELECT ImageId, arg_min(BuildingId, footprint_id) AS b FROM footprints GROUP BY 1) f ON f.ImageId = grp""")
def ag5_dissolved(spark, sf_dir):
    """AG4, AG5: the union of each image's footprints, cell by cell, summed up."""
    rows = O.dissolve(read_spread(spark, sf_dir, "footprints"), "ImageId", "PolygonWKT_Pix", 325.0, ["BuildingId"], "footprint_id")
    return rows.groupBy("ImageId").agg(R(F.sum("area"), 6).alias("area"), F.count("*").alias("cells"), F.first("BuildingId").alias("BuildingId"))


@query(f"""WITH {_PIX}, seg AS (SELECT id, row_number() OVER () AS poly, x1, y1, x2, y2, atan2(y2 - y1, x2 - x1) AS way FROM f_s),
v AS (SELECT id, poly, k, CASE WHEN k < 3 THEN x2 ELSE x1 END + 2 * cos(a) AS x, CASE WHEN k < 3 THEN y2 ELSE y1 END + 2 * sin(a) AS y FROM (SELECT *, way + CASE WHEN k < 3 THEN (k - 1) * pi() / 2 ELSE pi() + (k - 4) * pi() / 2 END AS a FROM seg, range(0, 6) ks(k))),
pe AS (SELECT id AS grp, poly, x AS x1, y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM v WINDOW w AS (PARTITION BY poly ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), {union_sql("pe")}
SELECT grp AS footprint_id, round(area, 7) AS area FROM un""")
def a19_line_buffers(spark, sf_dir):
    """Buffers of 2 pixels around the footprints' outlines, all rings of all parts."""
    rows = O.buffer_lines(_pix(spark, sf_dir).select("footprint_id", F.flatten("g").alias("rings")), "footprint_id", "rings", 2.0)
    return rows.select("footprint_id", R("area", 7).alias("area"))


# sinks and sources, written to the shared folder and read again


@query(f"""WITH {_PIX}, p AS (SELECT id, aoi, min(tr_a * x + tr_b * y + tr_c) AS xmin, max(tr_d * x + tr_e * y + tr_f) AS ymax, count(DISTINCT part) AS parts FROM f_v JOIN chips ON image = imageId GROUP BY ALL)
SELECT aoi, id AS footprint_id, CASE WHEN parts = 1 THEN 'Polygon' ELSE 'MultiPolygon' END AS kind, round(xmin, 9) AS xmin, round(ymax, 9) AS ymax FROM p""")
def snk14_area_geojson(spark, sf_dir):
    """SNK1, SNK14: pixel polygons written in degrees as GeoJSON of each area, and read again."""
    folder = temporary_folder(spark, "areas")
    written = S.write_areas(_pix(spark, sf_dir).select("footprint_id", "ImageId", "g"), read(spark, sf_dir, "chips"), folder, ["footprint_id"])
    files = spark.read.text([r.file for r in written.collect()], wholetext=True)  # a few files an area
    rows = G.features(files.select(F.regexp_extract(F.input_file_name(), r"/([^/]+)/part-", 1).alias("aoi"), F.col("value").alias("body")), "body", ["aoi"])
    b = geom.box(G.geometry_of(F.col("kind"), F.col("coordinates")))
    rows = rows.select("aoi", F.get_json_object("properties", "$.footprint_id").cast("long").alias("footprint_id"), "kind", b.alias("b"))
    return rows.select("aoi", "footprint_id", "kind", R("b.xmin", 9).alias("xmin"), R("b.ymax", 9).alias("ymax"))


@query("""SELECT aoi AS layer, c.imageId AS ImageId, coalesce(f.BuildingId, -1) AS BuildingId, coalesce(nullif(f.PolygonWKT_Pix, ''), CASE WHEN f.PolygonWKT_Pix IS NULL THEN 'POLYGON EMPTY' END) AS PolygonWKT_Pix
FROM chips c LEFT JOIN (SELECT * FROM footprints WHERE BuildingId <> -1) f ON f.ImageId = c.imageId""")
def snk7_layer_summaries(spark, sf_dir):
    """SNK6, SNK7: a summary CSV of each layer, written and read again; empty texts are read as null."""
    folder = temporary_folder(spark, "summaries")
    S.write_layer_summaries(read(spark, sf_dir, "chips"), read(spark, sf_dir, "footprints"), "aoi", folder)
    rows = spark.read.schema("ImageId string, BuildingId int, PolygonWKT_Pix string, PolygonWKT_Geo string, layer string").csv(folder, header=True, escape='"')
    return rows.select("layer", "ImageId", "BuildingId", F.when(F.col("PolygonWKT_Pix") != "", F.col("PolygonWKT_Pix")).alias("PolygonWKT_Pix"))


@query(f"""WITH {_PIX}, l AS (SELECT id, image, 'LINESTRING (' || string_agg(printf('%.2f %.2f', round_even(x, 2), round_even(y, 2)), ', ' ORDER BY k) || ')' AS t FROM f_v WHERE part = 1 AND ring = 1 GROUP BY ALL)
SELECT imageId AS ImageId, coalesce(t, 'LineString EMPTY') AS WKT_Pix FROM chips LEFT JOIN l ON image = imageId""")
def snk4_road_rows(spark, sf_dir):
    """SNK4, SNK5: summary rows of lines (the footprints' outer rings), with a sentinel for chips without any."""
    lines = _pix(spark, sf_dir).select("ImageId", F.get(F.get("g", F.lit(0)), F.lit(0)).alias("line"))
    return L.road_rows(read(spark, sf_dir, "chips"), lines)


@query("""WITH r AS (SELECT imageId, chipName, row_number() OVER (ORDER BY md5('7' || imageId), imageId) - 1 AS k, (SELECT count(*) FROM chips) AS n FROM chips)
SELECT CASE WHEN k < floor(n * 0.6) THEN 'train' WHEN k < floor(n * 0.8) THEN 'test' ELSE 'val' END AS split, imageId || ' ' || chipName AS value FROM r""")
def snk13_split_lists(spark, sf_dir):
    """SNK13, O4: one text list a split, written and read again."""
    folder = temporary_folder(spark, "lists")
    rows = C.split_rows(read(spark, sf_dir, "chips").select("imageId", "chipName"), "imageId", [("train", 0.6), ("test", 0.2), ("val", 0.2)], "7")
    L.write_split_lists(rows, folder, ["imageId", "chipName"])
    return spark.read.schema("value string, split string").text(folder).select("split", "value")


@query(f"""WITH {_PIX} SELECT id AS footprint_id, round(area, 6) AS area FROM f_b""")
def src3_wkt_csv(spark, sf_dir):
    """SRC3: footprints written as CSV with header and read with the first WKT column by priority."""
    folder = temporary_folder(spark, "wkt")
    _pix_rows(spark, sf_dir).select("footprint_id", "ImageId", "PolygonWKT_Pix").write.csv(folder, header=True, escape='"')
    rows = G.read_wkt_csv(spark, folder)
    return rows.select(F.col("footprint_id").cast("long").alias("footprint_id"), R(geom.area(F.col("geometry")), 6).alias("area"))


@query("""SELECT imageId AS path, chipName AS description FROM chips""")
def src5_list_csv(spark, sf_dir):
    """SRC5: a headerless list with comments and blanks, written and read again."""
    folder = temporary_folder(spark, "list")
    rows = read(spark, sf_dir, "chips").select(F.explode(F.array(F.lit("# a comment"), F.lit(""), F.concat_ws(" , ", "imageId", "chipName"))).alias("value"))
    rows.write.text(folder)
    return G.read_list_csv(spark, folder)


@query("""SELECT imageId, width, height FROM chips""")
def src13_results_after_lines(spark, sf_dir):
    """SRC13: results below 66 other lines and a header, one file a part, written and read again."""
    folder = temporary_folder(spark, "results")

    def lines(batches):
        import pandas as pd

        yield pd.DataFrame({"value": [f"note {i}, with, commas" for i in range(66)] + ["imageId,width,height"]})
        for batch in batches:
            yield pd.DataFrame({"value": [f"{i},{w},{h}" for i, w, h in zip(batch["imageId"], batch["width"], batch["height"])]})

    read_spread(spark, sf_dir, "chips").select("imageId", "width", "height").mapInPandas(lines, "value string").write.text(folder)
    return G.read_after_lines(spark, folder, 66, "imageId string, width int, height int")


@query("""SELECT 'depots' AS infrastructure, s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'depot' ELSE 'node' END AS type, CASE WHEN s_suppkey % 3 = 0 THEN s_name END AS name, CAST(s_nationkey AS DOUBLE) AS lon, NULL AS n_nodes FROM supplier
UNION ALL SELECT 'routes', s_nationkey + 1000000, 'way', NULL, NULL, count(*) FROM supplier GROUP BY s_nationkey""")
def src10_osm_frames(spark, sf_dir):
    """SRC10, S14, U2: responses of nodes and ways (suppliers and their nations), tags over the elements' own keys, frames united."""
    s = read(spark, sf_dir, "supplier")
    tags = F.when(F.col("s_suppkey") % 3 == 0, F.create_map(F.lit("name"), F.col("s_name"), F.lit("type"), F.lit("depot")))
    node = F.to_json(F.struct(F.lit("node").alias("type"), F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("double").alias("lon"), F.lit(1.0).alias("lat"), tags.alias("tags")))
    way = s.groupBy("s_nationkey").agg(F.sort_array(F.collect_list("s_suppkey")).alias("nodes"))  # a nation's suppliers
    ways = way.select(F.to_json(F.struct(F.lit("way").alias("type"), (F.col("s_nationkey") + 1000000).alias("id"), "nodes")).alias("e"))
    bodies = s.select(node.alias("e")).unionByName(ways).select(F.concat(F.lit('{"elements": ['), "e", F.lit("]}")).alias("body"))
    nodes, edges = G.read_osm(bodies, "body")
    both = G.united({"depots": nodes, "routes": edges.withColumn("n_nodes", F.size("nodes").cast("long"))})
    return both.select("infrastructure", "id", F.col("properties")["type"].alias("type"), F.col("properties")["name"].alias("name"), "lon", "n_nodes")


@query("""WITH e AS (SELECT min(tr_c) AS xmin, min(tr_e * height + tr_f) AS ymin, max(tr_a * width + tr_c) AS xmax, max(tr_f) AS ymax, aoi FROM chips GROUP BY aoi)
SELECT imageId, round(greatest(least(tr_c, xmax - 0.003), xmin), 9) AS "left", round(greatest(least(tr_e * height + tr_f, ymax - 0.003), ymin), 9) AS bottom FROM chips JOIN e USING (aoi)""")
def w5_shifted_chips(spark, sf_dir):
    """Chips of a fixed size moved back so that they don't reach past their area."""
    c = C.extent(read(spark, sf_dir, "chips"))
    e = c.groupBy("aoi").agg(F.min("left").alias("_x0"), F.min("bottom").alias("_y0"), F.max("right").alias("_x1"), F.max("top").alias("_y1"))
    rows = C.shift_inside(c.join(e, "aoi"), "left", "bottom", 0.003, ["_x0", "_y0", "_x1", "_y1"])
    return rows.select("imageId", R("left", 9).alias("left"), R("bottom", 9).alias("bottom"))


@query(f"""{_OBJECTS} SELECT id AS footprint_id, image AS image_id FROM o WHERE (id % 10) / 10.0 > 0.4""")
def f7_truncated_objects(spark, sf_dir):
    """objects whose truncation field lies above a share."""
    rows = _pix(spark, sf_dir).withColumn("partial", F.col("footprint_id") % 10 / 10.0)
    return L.objects(rows, read(spark, sf_dir, "chips"), 1.2, "partial", 0.4).select("footprint_id", "image_id")


@query(f"""WITH {_POINTS_SQL} SELECT point_id, 'utm' AS proj, 'GRS80' AS ellps, 'NAD83' AS datum, CAST(floor(1 + (lon + 180) / 6) AS INTEGER) AS zone, true AS no_defs FROM pt""")
def a15_utm_crs(spark, sf_dir):
    """The reference system of each position's zone, whatever its hemisphere."""
    p = positions(read(spark, sf_dir, "scene_points"), "point_id", "geometry")
    return p.select(F.col("id").alias("point_id"), crs.utm_crs(F.col("lon"), F.col("lat")).alias("c")).select("point_id", "c.proj", "c.ellps", "c.datum", "c.zone", "c.no_defs")


def queries() -> dict:
    return query.named


def oracle_sql() -> dict[str, str]:
    return query.sql
