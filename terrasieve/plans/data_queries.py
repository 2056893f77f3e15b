"""The pN_ queries of the core's data problems, each over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasieve.plans.registry import POINTS_SQL, vertices_sql
from terrasieve.session import cut_lineage, read, read_spread


#: Metres within which positions count as near.
NEAR_M = 10.0


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrasieve.operators.nearby import fit_splits, inside_pairs, near_pairs, places, positions, regions, with_members

    points = positions(read_spread(spark, sf_dir, "scene_points"), "point_id", "geometry")
    areas = cut_lineage(regions(read_spread(spark, sf_dir, "footprints"), "footprint_id", "PolygonWKT_Geo", "PolygonWKT_Pix", "ImageId", read(spark, sf_dir, "chips")))  # read several times
    spots, members = places(points)
    splits = fit_splits(spots, NEAR_M)
    near = near_pairs(points, NEAR_M, splits, (spots, members)).select(F.lit("near").alias("relation"), "point_id", "other_id")
    inside = with_members(inside_pairs(spots, areas, splits), "point_id", members, "_member_id")
    return near.unionByName(inside.select(F.lit("inside").alias("relation"), F.col("_member_id").alias("point_id"), "other_id"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrasieve.functions.timestamps import normalise_timestamps

    out = normalise_timestamps(read_spread(spark, sf_dir, "chip_features"), "feature_id", ["ingest_tim", "edit_date"], "provider", read(spark, sf_dir, "providers"))
    return out.where(F.col("instant_us").isNotNull()).select("feature_id", "field_name", "instant_us")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrasieve.sources.summary_csv import load_lines

    lines = load_lines(read_spread(spark, sf_dir, "raw_rows"), "line_id", "header_line", "line_text")
    return lines.where(F.col("reason").isNotNull()).select("line_id", "reason")


def p4_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid lines' typed records; others: columns of other names, and BuildingIds beyond BIGINT, as name=value."""
    from terrasieve.sources.summary_csv import load_lines

    lines = load_lines(read_spread(spark, sf_dir, "raw_rows"), "line_id", "header_line", "line_text")
    columns = [F.col("geometries")[g].alias(g) for g in ("PolygonWKT_Geo", "PolygonWKT_Pix", "PolygonWKT")]
    return lines.where(F.col("reason").isNull()).select("line_id", F.col("image_id").alias("ImageId"), F.col("building_id").alias("BuildingId"), *columns, F.col("confidence").alias("Confidence"), F.array_join(F.array_sort(F.transform(F.map_entries("others"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";").alias("others"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrasieve.operators.compaction import consolidate

    folder = consolidate(read(spark, sf_dir, "vector_files"), keep=False)
    return spark.read.schema("ImageId string, BuildingId int").parquet(f"{folder}/data").where(F.col("BuildingId").isNotNull())


def _matched(spark: SparkSession, sf_dir: str, catalog: DataFrame) -> DataFrame:
    from terrasieve.operators.schema_drift import profile, with_canonical_names

    return with_canonical_names(profile(read_spread(spark, sf_dir, "feed_rows"), "feed", "delivery_no", "body"), catalog)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrasieve.operators.schema_drift import changes

    return changes(_matched(spark, sf_dir, read(spark, sf_dir, "field_catalog"))).select("feed", "delivery_no", "field_name", "change")


def p6_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows in canonical names and types; values that don't fit their type are kept in unfit, as name=value."""
    from terrasieve.operators.schema_drift import unify

    rows, catalog = read_spread(spark, sf_dir, "feed_rows"), read(spark, sf_dir, "field_catalog")
    one = unify(rows, ["row_id", "feed", "delivery_no"], "body", _matched(spark, sf_dir, catalog), catalog)
    text = F.array_join(F.transform(F.map_entries("unfit"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return one.withColumn("unfit", text)


def p6_unlisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each field name of the deliveries with the canonical name that flooding finds from names and types alone.

    The catalog's other spellings are withheld, so that no name is listed but the canonical ones;
    a name of which no canonical one is like enough keeps its own.
    """
    bare = read(spark, sf_dir, "field_catalog").select(F.col("canonical_name").alias("field_name"), "canonical_name", "canonical_type").distinct()
    seen = _matched(spark, sf_dir, bare).where(F.col("field_name").isNotNull())
    return seen.groupBy("field_name", "canonical_name").agg(F.count("*").alias("deliveries"))


P1_SQL = f"""
WITH {POINTS_SQL}, fp AS (SELECT footprint_id, ImageId, coalesce(trim(PolygonWKT_Geo), '') = '' OR PolygonWKT_Geo ILIKE '%EMPTY%' AS pix, CASE WHEN pix THEN PolygonWKT_Pix ELSE PolygonWKT_Geo END AS wkt FROM footprints),
{vertices_sql("f", "fp", "footprint_id", "ImageId", "wkt", "true")},
deg AS (SELECT f_v.id, part, ring, k, x, y FROM f_v JOIN fp ON footprint_id = f_v.id WHERE NOT pix
  UNION ALL SELECT f_v.id, part, ring, k, tr_a * x + tr_b * y + tr_c, tr_d * x + tr_e * y + tr_f FROM f_v JOIN fp ON footprint_id = f_v.id JOIN chips ON chips.imageId = fp.ImageId WHERE pix),
flat AS (SELECT id, part, ring, k, x0 + (x - x0 + 180) - 360 * floor((x - x0 + 180) / 360) - 180 AS x, y FROM (SELECT *, first_value(x) OVER (PARTITION BY id, part ORDER BY ring, k) AS x0 FROM deg)),
seg AS (SELECT * FROM (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM flat WINDOW w AS (PARTITION BY id, part, ring ORDER BY k)) WHERE x2 IS NOT NULL),
box AS (SELECT id, part, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax FROM flat GROUP BY id, part),
lons AS (SELECT point_id, lat, lon + turn AS lon FROM pt, (VALUES (-720), (-360), (0), (360), (720)) t(turn)),
may AS (SELECT point_id, lon, lat, id, part FROM lons JOIN box ON lat BETWEEN ymin AND ymax AND lon BETWEEN xmin AND xmax),
hit AS (SELECT point_id, id FROM may JOIN seg USING (id, part) WHERE (y > lat) <> (y2 > lat) AND lon < x + (lat - y) * (x2 - x) / (y2 - y) GROUP BY point_id, lon, id, part HAVING count(*) % 2 = 1),
far AS (SELECT *, CAST(floor(lat * 1000) AS BIGINT) AS c FROM pt)
SELECT 'inside' AS relation, point_id, id AS other_id FROM (SELECT DISTINCT point_id, id FROM hit)
UNION ALL SELECT 'near', a.point_id, b.point_id FROM far a JOIN (SELECT *, c + unnest([-1, 0, 1]) AS d FROM far) b ON a.c = b.d AND a.point_id < b.point_id
  WHERE 2 * 6371008.8 * asin(least(1, sqrt(sin(radians(b.lat - a.lat) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lon - a.lon) / 2) ** 2))) <= {NEAR_M}
"""

# The alphabetic abbreviations of the providers' zones with their offset in seconds.
ABBREVIATIONS = [
    ("Europe/Berlin", "CET", 3600), ("Europe/Berlin", "CEST", 7200), ("America/New_York", "EST", -18000), ("America/New_York", "EDT", -14400), ("Asia/Kolkata", "IST", 19800), ("Australia/Sydney", "AEST", 36000), ("Australia/Sydney", "AEDT", 39600),
    ("Europe/Lisbon", "WET", 0), ("Europe/Lisbon", "WEST", 3600), ("Europe/Lisbon", "CET", 3600), ("Europe/Lisbon", "CEST", 7200), ("America/St_Johns", "NST", -12600), ("America/St_Johns", "NDT", -9000), ("America/St_Johns", "NDDT", -5400),
    ("Asia/Tokyo", "JST", 32400), ("Pacific/Auckland", "NZST", 43200), ("Pacific/Auckland", "NZDT", 46800), ("America/Denver", "MST", -25200), ("America/Denver", "MDT", -21600),
]


def _instants_sql() -> str:
    """By one form after the other, with the fields named; wall times go through the time zones of the SQL engine."""
    time = r"(?:(?:[Tt]|\s+)(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
    zone = r"\s*([A-Za-z]{1,5}|(?:UTC|GMT)?[+-]\d{2}(?::?\d{2})?|(?:UTC|GMT)[+-]\d(?::\d{2})?)?\s*(?:\[([A-Za-z_/+0-9-]+)\])?)?$"
    rest, tail = rf"{time}(?:\s*([AaPp])\.?[Mm]\.?)?{zone}", ["h", "mi", "se", "fr", "half", "z", "region"]
    forms = [
        (r"^(\d{4})([-/.])(\d{1,2})([-/.])(\d{1,2})" + rest, ["y", "s1", "m", "s2", "d", *tail], "f.s1 = f.s2", "ymd"),
        (r"^(\d{4})(\d{2})(\d{2})(?:[Tt ]?(\d{2})(\d{2})(\d{2})?(?:[.,](\d+))?" + zone, ["y", "m", "d", "h", "mi", "se", "fr", "z", "region"], "true", "ymd"),
        (r"^(\d{1,2})(/)(\d{1,2})/(\d{4})" + rest, ["d", "s1", "m", "y", *tail], "true", "?"),
        (r"^(\d{1,2})(\.)(\d{1,2})\.(\d{4})" + rest, ["d", "s1", "m", "y", *tail], "true", "dmy"),
        (r"^(?:[A-Za-z]{3,9},?\s+)?(\d{1,2})([-\s/])\s*([A-Za-z]{3,9})\.?([-\s/])\s*(\d{4})(?:,?" + rest[3:], ["d", "s1", "m", "s2", "y", *tail], "f.s1 = f.s2", "dmy"),
        (r"^(?:[A-Za-z]{3,9},?\s+)?([A-Za-z]{3,9})\.?\s+(\d{1,2}),?\s+(\d{4})(?:,?" + rest[3:], ["m", "d", "y", *tail], "true", "mdy"),
    ]
    one = " UNION ALL BY NAME ".join(
        f"SELECT feature_id, field_name, tz_name, date_order, {i} AS form, '{order}' AS ord, f.y, f.m, f.d, f.h, f.mi, f.se, f.fr, {'f.half' if 'half' in names else chr(39) * 2} AS half, upper(f.z) AS z, f.region"
        f" FROM (SELECT *, regexp_extract(s, '{pattern}', {names}) AS f FROM v WHERE NOT regexp_matches(s, '^[0-9]{{10}}([.][0-9]+)?$|^[0-9]{{13}}$|^[0-9]{{16}}$') AND regexp_matches(s, '{pattern}')) WHERE {only}"
        for i, (pattern, names, only, order) in enumerate(forms)
    )
    months = "['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec']"
    return f"""WITH v AS (SELECT feature_id, field_name, tz_name, date_order, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS s FROM (
  SELECT feature_id, provider, unnest(['ingest_tim', 'edit_date']) AS field_name, unnest([ingest_tim, edit_date]) AS raw FROM chip_features) LEFT JOIN providers USING (provider) WHERE raw IS NOT NULL),
p AS (SELECT * FROM ({one}) QUALIFY row_number() OVER (PARTITION BY feature_id, field_name ORDER BY form) = 1),
n AS (SELECT feature_id, field_name, tz_name, z, region, CAST(y AS INTEGER) AS y, coalesce(try_cast(mm AS INTEGER), list_position({months}, lower(left(mm, 3)))) AS m, CAST(dd AS INTEGER) AS d,
  CASE WHEN h = '' THEN 0 WHEN half = '' THEN CAST(h AS INTEGER) WHEN CAST(h AS INTEGER) BETWEEN 1 AND 12 THEN CAST(h AS INTEGER) % 12 + CASE WHEN lower(half) = 'p' THEN 12 ELSE 0 END ELSE 99 END AS h,
  CASE WHEN mi = '' THEN 0 ELSE CAST(mi AS INTEGER) END AS mi, CASE WHEN se = '' THEN 0 ELSE CAST(se AS INTEGER) END AS se, CAST(rpad(left(fr, 6), 6, '0') AS BIGINT) AS us
  FROM (SELECT *, CASE WHEN ord = '?' AND date_order = 'MDY' THEN d ELSE m END AS mm, CASE WHEN ord = '?' AND date_order = 'MDY' THEN m ELSE d END AS dd FROM p)),
w AS (SELECT feature_id, field_name, z, coalesce(nullif(region, ''), tz_name) AS tz, tz_name, us, try_cast(printf('%04d-%02d-%02d %02d:%02d:%02d', y, m, d, h, mi, se) AS TIMESTAMP) AS wall FROM n WHERE h < 24 AND mi < 60 AND se < 60 AND y > 0 AND m IS NOT NULL),
a(tz_name, abbr, secs) AS (VALUES {', '.join(map(repr, ABBREVIATIONS))}),
o AS (SELECT w.*, CASE WHEN z IN ('Z', 'UTC', 'GMT') THEN 0 WHEN regexp_matches(z, '[+-]') THEN (CASE WHEN contains(z, '-') THEN -1 ELSE 1 END) * (CAST(regexp_extract(z, '[+-]([0-9]{{1,2}})', 1) AS INTEGER) * 3600 + coalesce(try_cast(regexp_extract(z, '[+-][0-9]{{1,2}}:?([0-9]{{2}})', 1) AS INTEGER), 0) * 60) ELSE secs END AS off
  FROM w LEFT JOIN a ON a.tz_name = w.tz_name AND a.abbr = w.z WHERE wall IS NOT NULL),
c AS (SELECT *, timezone(tz, wall) AS t FROM o WHERE z = '' AND tz IS NOT NULL),
l AS (SELECT feature_id, field_name, us, min(e) AS e FROM (SELECT *, unnest([t - INTERVAL 3 HOUR, t - INTERVAL 2 HOUR, t - INTERVAL 1 HOUR, t - INTERVAL 30 MINUTE, t]) AS e FROM c) WHERE timezone(tz, e) = wall GROUP BY ALL)
SELECT feature_id, field_name, CAST(epoch_us(wall) + us - CAST(off AS BIGINT) * 1000000 AS BIGINT) AS instant_us FROM o WHERE z <> '' AND off IS NOT NULL AND abs(off) <= 64800
UNION ALL SELECT feature_id, field_name, CAST(epoch_us(e) + us AS BIGINT) FROM l
UNION ALL SELECT feature_id, field_name, CASE WHEN length(s) = 13 AND s NOT LIKE '%.%' THEN CAST(s AS BIGINT) * 1000 WHEN length(s) = 16 AND s NOT LIKE '%.%' THEN CAST(s AS BIGINT) ELSE CAST(left(s, 10) AS BIGINT) * 1000000 + CAST(rpad(left(substr(s, 12), 6), 6, '0') AS BIGINT) END
  FROM v WHERE regexp_matches(s, '^[0-9]{{10}}([.][0-9]+)?$|^[0-9]{{13}}$|^[0-9]{{16}}$')"""


def _lines_sql(select: str) -> str:
    """CTEs that end in checked (line_id, the fields by the header's names, reason)."""
    number = r"[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?"
    position = rf"{number}\s+{number}(\s+{number})?"
    ring = rf"\(\s*{position}(\s*,\s*{position}){{3,}}\s*\)"
    polygon = rf"\(\s*{ring}(\s*,\s*{ring})*\s*\)"
    geometry = rf"(?i)\s*(POLYGON(\s*Z)?\s*(EMPTY|{polygon})|MULTIPOLYGON(\s*Z)?\s*(EMPTY|\(\s*{polygon}(\s*,\s*{polygon})*\s*\)))\s*"
    field = '("([^"]|"")*"|[^",]*)'
    named = lambda n: f"w[list_position(names, '{n}')]"
    doubles = lambda p: f"list_transform(regexp_split_to_array(trim({p}, E' \\t\\r\\n'), '\\s+'), lambda x: try_cast(ltrim(x, '+') AS DOUBLE))"
    closed = f"{doubles('string_split(r, chr(44))[1]')} = {doubles('string_split(r, chr(44))[-1]')} AND list_bool_and(list_transform({doubles("replace(r, ',', ' ')")}, lambda v: coalesce(isfinite(v), false)))"
    wrong = lambda g: f"({g} IS NOT NULL AND NOT (regexp_full_match({g}, '{geometry}') AND coalesce(list_bool_and(list_transform(regexp_extract_all({g}, '\\(([^()]+)\\)', 1), lambda r: {closed})), true)))"
    geo = ["PolygonWKT_Geo", "PolygonWKT_Pix", "PolygonWKT"]
    return f"""WITH l AS (SELECT line_id, string_split(header_line, ',') AS names, coalesce(line_text, '') AS t, regexp_extract_all(',' || t, '(?s),{field}', 1) AS raw FROM raw_rows),
f AS (SELECT line_id, names, t, raw, list_transform(raw, lambda x: CASE WHEN x LIKE '"%' THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END) AS w FROM l),
n AS (SELECT *, {named("ImageId")} AS img, {named("BuildingId")} AS bid, {named("Confidence")} AS conf, {", ".join(f'{named(g)} AS "{g}"' for g in geo)} FROM f),
checked AS (SELECT *, CASE WHEN NOT regexp_full_match(t, '(?s){field}(,{field})*') THEN 'quoting' WHEN len(raw) <> len(names) THEN 'column_count'
  WHEN img = '' OR NOT regexp_full_match(bid, '-?[0-9]+') OR NOT coalesce(regexp_full_match(conf, '{number}') AND isfinite(try_cast(ltrim(conf, '+') AS DOUBLE)), conf IS NULL) OR {" OR ".join(wrong(f'"{g}"') for g in geo)} THEN 'value' END AS reason FROM n)
{select}"""


P4_SQL = _lines_sql("SELECT line_id, reason FROM checked WHERE reason IS NOT NULL")
P4_LOADED_SQL = _lines_sql("""SELECT line_id, img AS ImageId, try_cast(bid AS BIGINT) AS BuildingId, "PolygonWKT_Geo", "PolygonWKT_Pix", "PolygonWKT", CAST(ltrim(conf, '+') AS DOUBLE) AS Confidence,
  CASE WHEN try_cast(bid AS BIGINT) IS NULL THEN 'BuildingId=' || bid ELSE '' END AS others FROM checked WHERE reason IS NULL""")

P5_SQL = """
SELECT DISTINCT coalesce(json_extract_string(f, '$.properties.ImageId'), imageId) AS ImageId,
  CAST(json_extract_string(f, '$.properties.BuildingId') AS INTEGER) AS BuildingId
FROM (SELECT unnest(json_extract(body, '$.features[*]')) AS f, imageId FROM vector_files WHERE json_valid(body))
"""

P6_SQL = """
WITH kv AS (
  SELECT feed, delivery_no, k AS field_name, json_type(body, '$."' || k || '"') AS jt, json_extract(body, '$."' || k || '"')::VARCHAR AS v
  FROM (SELECT feed, delivery_no, body, unnest(json_keys(body)) AS k FROM feed_rows)),
prof AS (
  SELECT feed, delivery_no, field_name, canonical_name,
    max(CASE WHEN jt = 'NULL' THEN 0 WHEN jt = 'BOOLEAN' THEN 1 WHEN jt = 'VARCHAR' THEN 4 WHEN regexp_matches(v, '[.eE]') THEN 3 ELSE 2 END) AS t
  FROM kv JOIN field_catalog USING (field_name) GROUP BY ALL),
del AS (
  SELECT feed, delivery_no, row_number() OVER (PARTITION BY feed ORDER BY delivery_no) AS i,
    lead(delivery_no) OVER (PARTITION BY feed ORDER BY delivery_no) AS following
  FROM (SELECT DISTINCT feed, delivery_no FROM feed_rows)),
p AS (
  SELECT *, lag(i) OVER w AS pi, lag(field_name) OVER w AS pn, lead(i) OVER w AS ni
  FROM prof JOIN del USING (feed, delivery_no) WINDOW w AS (PARTITION BY feed, canonical_name ORDER BY i)),
r AS (
  SELECT *, sum(CASE WHEN pi = i - 1 THEN 0 ELSE 1 END) OVER (PARTITION BY feed, canonical_name ORDER BY i) AS run FROM p),
l AS (
  SELECT *, last_value(nullif(t, 0) IGNORE NULLS) OVER (PARTITION BY feed, canonical_name, run ORDER BY i
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM r)
SELECT feed, delivery_no, field_name, 'added' AS change FROM l WHERE i > 1 AND (pi IS NULL OR pi < i - 1)
UNION ALL SELECT feed, following, field_name, 'removed' FROM l WHERE following IS NOT NULL AND (ni IS NULL OR ni > i + 1)
UNION ALL SELECT feed, delivery_no, field_name, 'renamed' FROM l WHERE pi = i - 1 AND pn <> field_name
UNION ALL SELECT feed, delivery_no, field_name, 'retyped' FROM l WHERE pi = i - 1 AND t > 0 AND known <> t
"""


# Canonical fields with their type and the names that TESTDATA.md's catalog lists for them.
FIELDS = {
    "BuildingId": ("integer", ["BldgId", "BuildingId", "building_id"]), "Confidence": ("double", ["Confidence", "conf"]), "ImageId": ("string", ["ImageId", "image_id", "imageid"]),
    "PolygonWKT_Geo": ("string", ["PolygonWKT", "PolygonWKT_Geo", "polygonwkt_geo"]), "edit_date": ("string", ["edit_date", "edited"]), "ingest_tim": ("string", ["IngestTime", "ingest_tim", "ingest_time"]),
    "note": ("string", ["note"]), "partialDec": ("double", ["partialDec"]), "roof": ("string", ["roof"]), "storeys": ("integer", ["storeys"]), "truncated": ("integer", ["truncated"]),
}


def _unified_sql() -> str:
    value = {"integer": "CASE WHEN regexp_matches({t}, '^-?[0-9]+([.]0+)?$') THEN CAST(regexp_replace({t}, '[.]0+$', '') AS BIGINT) END", "double": "try_cast({t} AS DOUBLE)", "string": "{t}"}
    texts = ", ".join("coalesce(" + ", ".join(f"""json_extract_string(body, '$."{n}"')""" for n in names) + f') AS "t_{c}"' for c, (_, names) in FIELDS.items())
    values = ", ".join(value[kind].format(t=f'"t_{c}"') + f' AS "{c}"' for c, (kind, _) in FIELDS.items())
    odd = ", ".join(f"""CASE WHEN "t_{c}" IS NOT NULL AND {value[kind].format(t=f'"t_{c}"')} IS NULL THEN '{c}=' || "t_{c}" END""" for c, (kind, _) in FIELDS.items() if kind != "string")
    return f"SELECT row_id, feed, delivery_no, {values}, concat_ws(';', {odd}) AS unfit FROM (SELECT row_id, feed, delivery_no, {texts} FROM feed_rows)"


def queries() -> dict:
    named = (p1_found, p2_found, p4_found, p4_loaded, p5_found, p6_found, p6_unified, p6_unlisted)
    return {q.__name__: q for q in named}


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_SQL, "p2_found": _instants_sql(), "p4_found": P4_SQL, "p4_loaded": P4_LOADED_SQL, "p5_found": P5_SQL, "p6_found": P6_SQL, "p6_unified": _unified_sql()}
