"""Machine-learning labels: object structs, annotation documents, summary rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasieve.functions import geom


def objects(polygons: DataFrame, chips: DataFrame, resize: float = 1.0, truncated_field: str = "", most_truncated: float = 0.0) -> DataFrame:
    """(footprint_id, image_id, width, height, bndbox, geometry, ...) of the chips' features (footprint_id, ImageId, g).

    bndbox is the envelope resized about its centre. With most_truncated above 0 and a column
    truncated_field, only features above that share stay; without the column all do.
    """
    rows = polygons.withColumn("image_id", F.col("ImageId")).join(chips.select(F.col("imageId").alias("image_id"), "width", "height"), "image_id")
    if most_truncated > 0 and truncated_field in rows.columns:
        rows = rows.where(F.col(truncated_field) > most_truncated)
    rows = geom.once(rows, ["*"], _box=geom.box(F.col("g"))).where(F.col("_box").isNotNull())
    extra = [truncated_field] if truncated_field in rows.columns else []
    return rows.select("footprint_id", "image_id", "width", "height", geom.resize_box(F.col("_box"), resize).alias("bndbox"), F.col("g").alias("geometry"), *extra)


def _documents(rows: DataFrame, text: Column, separator: str) -> DataFrame:
    parts = F.transform(F.sort_array(F.collect_list(F.struct("footprint_id", text.alias("t")))), lambda x: x["t"])
    return rows.groupBy("image_id").agg(F.array_join(parts, separator).alias("text"), F.first("width").alias("width"), F.first("height").alias("height"))


def darknet_documents(rows: DataFrame, decimals: int = 6) -> DataFrame:
    """(image_id, label): a line 'class x y w h' an object, class always 0, in the order of footprint_id."""
    rel = geom.relative_box(F.col("bndbox"), F.col("width"), F.col("height"))
    rows = rows.withColumn("_r", rel)
    line = F.format_string("0 " + " ".join([f"%.{decimals}f"] * 4), *[F.round(F.col("_r")[x], 6) for x in "xywh"])
    return _documents(rows, line, "\n").select("image_id", F.col("text").alias("label"))


def escape_xml(text: Column) -> Column:
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def _tag(name: str, *inner) -> Column:
    return F.concat(F.lit(f"<{name}>"), *[x if isinstance(x, Column) else F.lit(x) for x in inner], F.lit(f"</{name}>"))


def voc_documents(rows: DataFrame, folder: str, database: str, label: str, depth: int = 3) -> DataFrame:
    """(image_id, xml): a Pascal VOC annotation a chip, objects in the order of footprint_id, boxes in whole pixels."""
    b = F.col("bndbox")
    number = lambda c: F.floor(c).cast("string")
    box = _tag("bndbox", *[_tag(x, number(b[x])) for x in ("xmin", "ymin", "xmax", "ymax")])
    item = _tag("object", _tag("name", label), _tag("pose", "Left"), _tag("truncated", "0"), _tag("difficult", "0"), box)
    docs = _documents(rows, item, "")
    size = _tag("size", _tag("width", F.col("width").cast("string")), _tag("height", F.col("height").cast("string")), _tag("depth", str(depth)))
    source = _tag("source", _tag("database", database), _tag("annotation", label))
    return docs.select("image_id", _tag("annotation", _tag("folder", folder), _tag("filename", escape_xml(F.col("image_id")), ".tif"), source, size, _tag("segmented", "1"), F.col("text")).alias("xml"))


def summary_rows(chips: DataFrame, footprints: DataFrame, empty: str = "POLYGON EMPTY") -> DataFrame:
    """(ImageId, BuildingId, PolygonWKT_Pix, PolygonWKT_Geo): every chip's features, or one row -1 with empty geometry."""
    real = footprints.where(F.col("BuildingId") != -1).select(F.col("ImageId").alias("_image"), "BuildingId", "PolygonWKT_Pix", "PolygonWKT_Geo")
    rows = chips.select(F.col("imageId").alias("ImageId")).join(real, F.col("ImageId") == F.col("_image"), "left")
    return rows.select("ImageId", F.coalesce("BuildingId", F.lit(-1)).alias("BuildingId"), *[F.coalesce(c, F.lit(empty)).alias(c) for c in ("PolygonWKT_Pix", "PolygonWKT_Geo")])


def road_rows(chips: DataFrame, lines: DataFrame, decimals: int = 2) -> DataFrame:
    """(ImageId, WKT_Pix): lines (ImageId, line) rounded, without height, or one row 'LINESTRING EMPTY'-like sentinel a chip."""
    text = F.concat(F.lit("LINESTRING "), geom.format_ring(F.col("line"), decimals))
    rows = chips.select(F.col("imageId").alias("ImageId")).join(lines.select(F.col("ImageId").alias("_image"), "line"), F.col("ImageId") == F.col("_image"), "left")
    return rows.select("ImageId", F.coalesce(text, F.lit("LineString EMPTY")).alias("WKT_Pix"))


def write_summary(chips: DataFrame, features: DataFrame, path: str, competition: str = "buildings") -> None:
    """The challenge's summary CSV for buildings, or for roads with any other name."""
    rows = summary_rows(chips, features) if competition == "buildings" else road_rows(chips, features)
    rows.write.mode("overwrite").csv(path, header=True)


def write_split_lists(rows: DataFrame, path: str, columns: list[str], split: str = "split") -> None:
    """One text list a split, the columns separated by blanks."""
    rows.select(split, F.concat_ws(" ", *columns).alias("value")).write.mode("overwrite").partitionBy(split).text(path)
