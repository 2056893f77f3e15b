"""Queries with the SQL they are checked against."""

from __future__ import annotations


class Registry:
    def __init__(self):
        self.named, self.sql = {}, {}

    def __call__(self, sql: str | None = None):
        def add(query):
            self.named[query.__name__] = query
            if sql:
                self.sql[query.__name__] = sql
            return query

        return add


# Fixed SQL text: positions of scene_points as pt (point_id, lon, lat).
POINTS_SQL = r"""pt AS (SELECT point_id, x - 360 * floor((x + 180) / 360) AS lon, y AS lat FROM (
  SELECT point_id, try_cast(regexp_extract(geometry, '(?i)(?:point\s*z?\s*\(\s*|\[\s*)(-?[0-9.]+)[\s,]+(-?[0-9.]+)', 1) AS DOUBLE) AS x,
    try_cast(regexp_extract(geometry, '(?i)(?:point\s*z?\s*\(\s*|\[\s*)(-?[0-9.]+)[\s,]+(-?[0-9.]+)', 2) AS DOUBLE) AS y FROM scene_points) WHERE x IS NOT NULL AND y IS NOT NULL)"""


# Fixed SQL text: splitting of WKT into polygons, rings and positions.
def vertices_sql(name: str, table: str, key: str, image: str, wkt: str, where: str) -> str:
    """CTEs name_v (id, image, part, ring, k, x, y) and name_s (segments x1, y1, x2, y2) of a table's polygons."""
    return rf"""
{name}_p AS (SELECT id, image, unnest(ps) AS ptxt, generate_subscripts(ps, 1) AS part FROM (
  SELECT {key} AS id, {image} AS image, regexp_split_to_array({wkt}, '\)\s*\)\s*,\s*\(\s*\(') AS ps FROM {table} WHERE {where} AND {wkt} LIKE '%((%')),
{name}_r AS (SELECT id, image, part, unnest(rs) AS rtxt, generate_subscripts(rs, 1) AS ring FROM (
  SELECT *, regexp_split_to_array(ptxt, '\)\s*,\s*\(') AS rs FROM {name}_p)),
{name}_c AS (SELECT id, image, part, ring, unnest(cs) AS ctxt, generate_subscripts(cs, 1) AS k FROM (
  SELECT *, string_split(regexp_replace(rtxt, '[A-Za-z()]', '', 'g'), ',') AS cs FROM {name}_r)),
{name}_v AS (SELECT id, image, part, ring, k, CAST(split_part(trim(ctxt), ' ', 1) AS DOUBLE) AS x, CAST(split_part(trim(ctxt), ' ', 2) AS DOUBLE) AS y FROM {name}_c),
{name}_s AS (SELECT * FROM (SELECT id, image, part, ring, k, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM {name}_v
  WINDOW w AS (PARTITION BY id, part, ring ORDER BY k)) WHERE x2 IS NOT NULL),
{name}_o AS (SELECT id, image, part, ring, sum((x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0)) / 2 AS a FROM (
  SELECT *, first_value(x1) OVER w AS x0, first_value(y1) OVER w AS y0 FROM {name}_s WINDOW w AS (PARTITION BY id, part, ring ORDER BY k)) GROUP BY ALL),
{name}_a AS (SELECT id, image, sum(CASE WHEN ring = 1 THEN abs(a) ELSE -abs(a) END) AS area FROM {name}_o GROUP BY ALL),
{name}_b AS (SELECT id, image, area, xmin, ymin, xmax, ymax FROM {name}_a JOIN (SELECT id, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM {name}_v GROUP BY id) USING (id)),
{name}_e AS (SELECT id, image, least(x1, x2) AS x1, CASE WHEN x1 < x2 THEN y1 ELSE y2 END AS y1, greatest(x1, x2) AS x2, CASE WHEN x1 < x2 THEN y2 ELSE y1 END AS y2,
  (CASE WHEN x2 < x1 THEN 1 ELSE -1 END) * sign(a) * (CASE WHEN ring = 1 THEN 1 ELSE -1 END) AS s FROM {name}_s JOIN {name}_o USING (id, image, part, ring) WHERE x1 <> x2)"""


def overlap_sql(pairs: str, a: str, b: str) -> str:
    """SELECT of (pid, tid, shared): the exact overlap area of each (pid, tid) of pairs, over the edges of a and b."""
    return f"""SELECT pid, tid, sum(s * CASE WHEN (fl - gl) * (fr - gr) < 0
    THEN (least(fl, gl) + ym) / 2 * t * w + (ym + least(fr, gr)) / 2 * (1 - t) * w
    ELSE (least(fl, gl) + least(fr, gr)) / 2 * w END) AS shared FROM (
  SELECT *, fl + t * (fr - fl) AS ym FROM (
  SELECT *, CASE WHEN (fl - gl) * (fr - gr) < 0 THEN (fl - gl) / ((fl - gl) - (fr - gr)) ELSE 0 END AS t FROM (
  SELECT pid, tid, a.s * b.s AS s, r - l AS w,
    a.y1 + (l - a.x1) * (a.y2 - a.y1) / (a.x2 - a.x1) AS fl, a.y1 + (r - a.x1) * (a.y2 - a.y1) / (a.x2 - a.x1) AS fr,
    b.y1 + (l - b.x1) * (b.y2 - b.y1) / (b.x2 - b.x1) AS gl, b.y1 + (r - b.x1) * (b.y2 - b.y1) / (b.x2 - b.x1) AS gr
  FROM (SELECT pid, tid, a, b, greatest(a.x1, b.x1) AS l, least(a.x2, b.x2) AS r FROM {pairs} JOIN {a} a ON a.id = pid JOIN {b} b ON b.id = tid) WHERE l < r))) GROUP BY ALL"""


def union_sql(edges: str, name: str = "un") -> str:
    """CTEs that end in {name} (grp, area): the area of the union of the polygons (grp, poly) given by their edges x1, y1, x2, y2.

    The plane is cut into slabs at all vertices and crossings of a group; within a slab the union's
    length is linear, so that its length at the slab's middle times its width is its area. Polygons are taken by parity.
    """
    return f"""{name}_e AS (SELECT grp, poly, least(x1, x2) AS x1, CASE WHEN x1 < x2 THEN y1 ELSE y2 END AS y1, greatest(x1, x2) AS x2, CASE WHEN x1 < x2 THEN y2 ELSE y1 END AS y2, row_number() OVER () AS n FROM {edges} WHERE x1 <> x2),
{name}_m AS (SELECT *, (y2 - y1) / (x2 - x1) AS m FROM {name}_e),
{name}_x AS (SELECT grp, x1 AS x FROM {name}_e UNION SELECT grp, x2 FROM {name}_e UNION SELECT grp, x FROM (
  SELECT a.grp, (b.y1 - b.m * b.x1 - a.y1 + a.m * a.x1) / (a.m - b.m) AS x, greatest(a.x1, b.x1) AS l, least(a.x2, b.x2) AS r FROM {name}_m a JOIN {name}_m b ON a.grp = b.grp AND a.n < b.n AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.m <> b.m
    AND least(a.y1, a.y2) <= greatest(b.y1, b.y2) AND least(b.y1, b.y2) <= greatest(a.y1, a.y2)) WHERE x > l AND x < r),
{name}_s AS (SELECT grp, l, r, (l + r) / 2 AS c FROM (SELECT grp, x AS l, lead(x) OVER (PARTITION BY grp ORDER BY x) AS r FROM {name}_x) WHERE r > l),
{name}_y AS (SELECT s.grp, l, r, poly, y1 + (c - x1) * m AS y FROM {name}_s s JOIN {name}_m e ON e.grp = s.grp AND e.x1 <= l AND e.x2 >= r),
{name}_i AS (SELECT grp, l, r, y AS lo, hi FROM (SELECT *, lead(y) OVER w AS hi, row_number() OVER w AS k FROM {name}_y WINDOW w AS (PARTITION BY grp, l, poly ORDER BY y)) WHERE k % 2 = 1 AND hi IS NOT NULL),
{name} AS (SELECT grp, sum((r - l) * greatest(0, hi - greatest(lo, coalesce(before, lo)))) AS area FROM (SELECT *, max(hi) OVER (PARTITION BY grp, l ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {name}_i) GROUP BY grp)"""
