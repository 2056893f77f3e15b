"""GeoJSON, WKT tables, list files and OSM responses as DataFrames, and their writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasieve.functions import geom
from terrasieve.sources.files import write_grouped

COLLECTION = "struct<type:string, properties:string, geometry:string, features:array<struct<properties:string, geometry:string>>>"
#: WKT columns by falling priority.
GEOMETRY_PRIORITY = ["PolygonWKT_Geo", "PolygonWKT_Pix", "PolygonWKT"]


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, body) of GeoJSON files, one row a file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("body"))


def features(df: DataFrame, body_col: str, keep: list[str]) -> DataFrame:
    """keep, pos, properties (JSON text), kind and coordinates (JSON text) of each feature; empty or unreadable bodies give none."""
    rows = df.select(*keep, F.posexplode(F.from_json(body_col, COLLECTION)["features"]).alias("pos", "_f")).where(F.col("_f").isNotNull())
    return rows.select(*keep, "pos", F.col("_f.properties").alias("properties"), F.get_json_object("_f.geometry", "$.type").alias("kind"), F.get_json_object("_f.geometry", "$.coordinates").alias("coordinates"))


def without_placeholders(df: DataFrame, column: str = "BuildingId") -> DataFrame:
    """Rows whose id isn't -1; null ids stay."""
    return df.where(~F.col(column).eqNullSafe(-1))


def chip_features(df: DataFrame, body_col: str, path_col: str, keep: list[str], image_id: str = "") -> DataFrame:
    """features plus ImageId, given or the base name of the path, and BuildingId 1..n in file order."""
    rows = features(df, body_col, [*keep, path_col])
    name = F.lit(image_id) if image_id else F.regexp_extract(path_col, r"([^/]+?)(\.[^./]*)?$", 1)
    return rows.withColumns({"ImageId": name, "BuildingId": F.col("pos") + 1})


def classes_present(df: DataFrame, body_col: str) -> DataFrame:
    """df plus n_features and classes: [1] if there are features, else []."""
    n = F.coalesce(F.size(F.from_json(body_col, COLLECTION)["features"]), F.lit(0))
    rows = df.withColumn("n_features", F.greatest(n, F.lit(0)))
    return rows.withColumn("classes", F.when(F.col("n_features") > 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")))


def geometry_of(kind: Column, coordinates: Column) -> Column:
    """MULTI of Polygon and MultiPolygon coordinates; null for other kinds."""
    ring = lambda r: F.transform(r, lambda p: geom.point(p[0], p[1]))
    one = F.from_json(coordinates, "array<array<array<double>>>")
    many = F.from_json(coordinates, "array<array<array<array<double>>>>")
    return F.when(kind == "Polygon", F.array(F.transform(one, ring))).when(kind == "MultiPolygon", F.transform(many, lambda part: F.transform(part, ring)))


def write_geojson(df: DataFrame, path: str, geometry: str, kind: str, properties: list[str], partition: str | None = None) -> DataFrame:
    """Feature collections below path, one or more a value of partition, and the list of them (file, n_rows, bytes).

    geometry is the column of JSON coordinates text of the kind in column kind; features come in the order of
    the first property. Features are streamed to the files one by one; hot values get several
    complete collections, and so do tables without partition. See files.write_grouped.
    """
    props = F.to_json(F.struct(*properties), {"ignoreNullFields": "false"})
    feature = F.concat(F.lit('{"type": "Feature", "properties": '), props, F.lit(', "geometry": {"type": "'), F.col(kind), F.lit('", "coordinates": '), F.col(geometry), F.lit("}}"))
    rows = df.select((F.col(partition).cast("string") if partition else F.lit("all")).alias("_key"), F.col(properties[0]).alias("_order"), feature.alias("_feature"))
    return write_grouped(rows.where(F.col("_feature").isNotNull()), "_key", "_feature", ["_order"], path, '{"type": "FeatureCollection", "features": [\n', "\n]}\n", ",\n", ".geojson")


def coordinates_json(multi: Column) -> Column:
    """Coordinates text of a MULTI: a Polygon's if it has one part, else a MultiPolygon's."""
    part = lambda p: F.transform(p, lambda r: F.transform(r, lambda q: F.array(q["x"], q["y"])))
    return F.when(F.size(multi) == 1, F.to_json(part(F.get(multi, F.lit(0))))).otherwise(F.to_json(F.transform(multi, part)))


def read_wkt_csv(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """A CSV with header plus geometry, parsed from the first WKT column by priority; ValueError without one.

    multiline: quoted fields may hold line breaks, which keeps a file from being split; summary
    files of any size are read by the summary_csv source.
    """
    df = spark.read.csv(path, header=True, escape='"', multiLine=multiline)
    found = [c for c in GEOMETRY_PRIORITY if c in df.columns]
    if not found:
        raise ValueError(f"no geometry column in {df.columns}; expected one of {GEOMETRY_PRIORITY}")
    return df.withColumn("geometry", geom.parse_wkt(F.col(found[0])))


def read_list_csv(spark: SparkSession, path: str) -> DataFrame:
    """(path, description) of a headerless two-column list; comments and blank lines are skipped, cells trimmed."""
    df = spark.read.schema("path string, description string").csv(path, comment="#", mode="PERMISSIVE")
    rows = df.select(F.trim("path").alias("path"), F.trim("description").alias("description"))
    return rows.where((F.coalesce("path", F.lit("")) != "") | (F.coalesce("description", F.lit("")) != ""))


def read_after_lines(spark: SparkSession, path: str, skip: int, schema: str) -> DataFrame:
    """CSV files whose first skip lines precede their header.

    Files are split as usual: only the split at a file's start holds the lines to be left out, which are
    counted there as they pass (they must lie within the first split).
    """
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.input_file_block_start().alias("start"))

    def run(batches):
        passed: dict[str, int] = {}
        for batch in batches:
            keep = []
            for file, start in zip(batch["file"], batch["start"]):
                n = passed.get(file, 0)
                keep.append(start > 0 or n > skip)
                if start == 0:
                    passed[file] = n + 1
            yield batch.loc[keep, ["value"]]

    rest = lines.mapInPandas(run, "value string")
    return rest.where("value <> ''").select(F.from_csv("value", schema).alias("r")).select("r.*")


def load_tile_index(spark: SparkSession, folder: str, area: str) -> DataFrame:
    """(location, geometry) of a folder's <area>/<area>_SrcTindex.geojson, on any file system; ValueError for an unknown area."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    root = fs_path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    file = f"{folder.rstrip('/')}/{area}/{area}_SrcTindex.geojson"
    if not area or not fs.exists(fs_path(file)):
        known = sorted(s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory()) if fs.exists(root) else []
        raise ValueError(f"no tile index of {area}; known areas: {known}")
    rows = features(read_files(spark, file), "body", [])
    return rows.select(F.get_json_object("properties", "$.location").alias("location"), geometry_of(F.col("kind"), F.col("coordinates")).alias("geometry"))


def drop_keys(props: Column, keys: list[str]) -> Column:
    return F.map_filter(props, lambda k, _: ~k.isin(keys))


def fill_times(props: Column, fields: list[str], at: Column) -> Column:
    """The map with missing or falsy (null, '', 0, false) fields set to at."""
    value = lambda f: F.when(F.coalesce(props[f], F.lit("")).isin("", "0", "0.0", "false"), at).otherwise(props[f])
    rest = F.map_filter(props, lambda k, _: ~k.isin(fields))
    return F.map_concat(rest, F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*map(value, fields))))


def read_osm(df: DataFrame, body_col: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, ways) of OSM responses: tags are merged over the element's own keys."""
    schema = "struct<elements:array<struct<type:string, id:bigint, lon:double, lat:double, tags:map<string,string>, nodes:array<bigint>>>>"
    e = df.select(F.explode(F.from_json(body_col, schema)["elements"]).alias("e")).select("e.*")
    own = F.create_map(F.lit("type"), F.col("type"), F.lit("id"), F.col("id").cast("string"))
    tags = F.coalesce("tags", F.create_map().cast("map<string,string>"))
    kept = F.map_filter(own, lambda k, _: ~F.array_contains(F.map_keys(tags), k))
    flat = F.map_concat(kept, tags).alias("properties")
    nodes = e.where("type = 'node'").select("id", "lon", "lat", flat)
    return nodes, e.where("type = 'way'").select("id", "nodes", flat)


def united(frames: dict[str, DataFrame], name: str = "infrastructure") -> DataFrame:
    """The frames of several kinds of infrastructure as one table, each row with its kind; columns that a frame lacks are null."""
    out = None
    for kind, frame in frames.items():
        one = frame.withColumn(name, F.lit(kind))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def way_geometries(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, kind, line) of ways (id, nodes) with nodes (id, lon, lat): vertices in way order, Polygon if closed, else LineString.

    Nodes that aren't given drop out; ways without any known node don't come out.
    """
    long = ways.select("id", F.posexplode("nodes").alias("pos", "node_id"))
    placed = long.join(nodes.select(F.col("id").alias("node_id"), F.col("lon").alias("x"), F.col("lat").alias("y")), "node_id")
    line = F.transform(F.sort_array(F.collect_list(F.struct("pos", "node_id", "x", "y"))), lambda s: F.struct(s["node_id"].alias("node_id"), s["x"].alias("x"), s["y"].alias("y")))
    rows = placed.groupBy("id").agg(line.alias("line"))
    closed = (F.size("line") > 1) & (F.get("line", F.lit(0))["node_id"] == F.element_at("line", -1)["node_id"])
    return rows.select("id", F.when(closed, "Polygon").otherwise("LineString").alias("kind"), "line")
