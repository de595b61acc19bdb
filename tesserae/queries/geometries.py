"""Queries for the geometry operations, over points, boxes and lines made from numeric columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..geo.codec import read_wkt, write_wkb
from ..operators import apply
from ..relation import ORD, with_order
from . import query, read


def points(spark: SparkSession, folder: str, geographic: bool = False) -> DataFrame:
    df = read(spark, folder, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 100).cast("double").alias("x"), F.floor(F.col("c_acctbal") / (200 if geographic else 100)).cast("double").alias("y"))
    return apply("geo.from_coords", with_order(df, "id"), crs="EPSG:4326" if geographic else "EPSG:3857")


BOX = "concat('POLYGON((', x, ' ', y, ',', x + {s}, ' ', y, ',', x + {s}, ' ', y + {s}, ',', x, ' ', y + {s}, ',', x, ' ', y, '))')"


def boxes(spark: SparkSession, folder: str, size: int = 10, step: int = 10, shift: int = 0) -> DataFrame:
    """25 boxes on a 5 by 5 grid; larger than the step, they overlap."""
    df = read(spark, folder, "nation").selectExpr("cast(n_nationkey as long) as id", f"cast(n_nationkey % 5 * {step} + {shift} as int) as x", f"cast(floor(n_nationkey / 5) * {step} + {shift} as int) as y")
    df = df.withColumn("wkt", F.expr(BOX.format(s=size))).select("id", "x", "y", "wkt")
    return apply("geo.from_wkt", with_order(df, "id"), wkt_column="wkt").drop("wkt")


def lines(spark: SparkSession, folder: str, geographic: bool = False) -> DataFrame:
    k = "cast(o_orderkey % 40 as int)"
    df = read(spark, folder, "orders").selectExpr("o_orderkey as id", f"concat('LINESTRING(', {k}, ' 0,', {k} + 3, ' 4,', {k} + 3, ' 10)') as wkt")
    return apply("geo.from_wkt", with_order(df, "id"), wkt_column="wkt", crs="EPSG:4326" if geographic else "EPSG:3857").drop("wkt")


def sized(spark: SparkSession, folder: str, table: str, key: str, text: str, crs: str = "EPSG:3857") -> DataFrame:
    """A geometry for each row of a table; text is SQL over k, which goes from 0 to 39, and w and h, which go with it."""
    df = read(spark, folder, table).selectExpr(f"cast({key} as long) as id", f"cast({key} % 40 as int) as k").selectExpr("id", "k", "1 + k % 7 as w", "2 + k % 5 as h")
    return apply("geo.from_wkt", with_order(df.withColumn("wkt", F.expr(text)), "id"), wkt_column="wkt", crs=crs).drop("wkt")


#: Boxes of w by h with their lower left corner at (k, 0); every third one has a hole in BLOCK, every fourth one crosses itself in BOW.
BOUND = "k, ' 0,', k + w, ' 0,', k + w, ' ', h, ',', k, ' ', h, ',', k, ' 0'"
HOLE = "if(k % 3 = 0, concat(',(', k + 0.25, ' 0.25,', k + 0.25, ' 0.5,', k + 0.5, ' 0.5,', k + 0.5, ' 0.25,', k + 0.25, ' 0.25)'), '')"
BLOCK = f"concat('POLYGON((', {BOUND}, ')', {HOLE}, ')')"
BOW = f"if(k % 4 = 1, concat('POLYGON((', k, ' 0,', k + w, ' ', h, ',', k + w, ' 0,', k, ' ', h, ',', k, ' 0))'), {BLOCK})"


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    return sized(spark, folder, "orders", "o_orderkey", BLOCK)


def bows(spark: SparkSession, folder: str) -> DataFrame:
    return sized(spark, folder, "customer", "c_custkey", BOW)


def crates(spark: SparkSession, folder: str) -> DataFrame:
    """Few boxes, for what is done in long loops."""
    return sized(spark, folder, "nation", "n_nationkey", f"concat('POLYGON((', {BOUND}, '))')")


def moved_crates(spark: SparkSession, folder: str) -> DataFrame:
    return apply("geo.translate", crates(spark, folder), x_offset=1, y_offset=1)


def flats(spark: SparkSession, folder: str) -> DataFrame:
    """Level lines of a length of k + 1."""
    return sized(spark, folder, "orders", "o_orderkey", "concat('LINESTRING(0 0,', k + 1, ' 0)')")


def corners(spark: SparkSession, folder: str) -> DataFrame:
    """Along the equator and then along a meridian, in degrees."""
    return sized(spark, folder, "orders", "o_orderkey", "concat('LINESTRING(0 0,', k + 1, ' 0,', k + 1, ' ', h * 10, ')')", "EPSG:4326")


def axes(spark: SparkSession, folder: str) -> DataFrame:
    """Points on the equator or on the meridian of 0, in degrees."""
    return sized(spark, folder, "customer", "c_custkey", "if(id % 2 = 0, concat('POINT(', k - 20, ' 0)'), concat('POINT(0 ', k - 20, ')'))", "EPSG:4326")


def slices(spark: SparkSession, folder: str) -> DataFrame:
    """Between the equator and two meridians up to the pole, in degrees."""
    return sized(spark, folder, "nation", "n_nationkey", "concat('POLYGON((0 0,', k + 1, ' 0,', k + 1, ' 90,0 90,0 0))')", "EPSG:4326")


def hexed(wkt: str) -> str:
    return write_wkb(read_wkt(wkt)).hex()


SOURCES = {f.__name__: f for f in (points, boxes, lines, blocks, bows, crates, flats, corners, axes, slices)}
#: The same as SQL: points p(id, x, y), boxes b(id, x, y) with lower left corners, lines l(id, k).
P = "(SELECT c_custkey AS id, CAST(c_custkey % 100 AS DOUBLE) AS x, floor(c_acctbal / 100) AS y FROM customer)"
B = "(SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_nationkey % 5 * 10 AS INTEGER) AS x, CAST(floor(n_nationkey / 5) * 10 AS INTEGER) AS y FROM nation)"
L = "(SELECT o_orderkey AS id, CAST(o_orderkey % 40 AS INTEGER) AS k FROM orders)"


def sized_sql(table: str, key: str) -> str:
    return f"(SELECT id, k, 1 + k % 7 AS w, 2 + k % 5 AS h FROM (SELECT CAST({key} AS BIGINT) AS id, CAST({key} % 40 AS INTEGER) AS k FROM {table}))"


SO, SC, SN = sized_sql("orders", "o_orderkey"), sized_sql("customer", "c_custkey"), sized_sql("nation", "n_nationkey")
HOLED = "CASE WHEN k % 3 = 0 THEN {} ELSE 0 END"
#: Metres from the equator to a latitude in degrees on WGS84, by the series of the meridian arc.
E2 = 6.69437999014e-3


def arc(degrees: str) -> str:
    c = (1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256, 3 * E2 / 8 + 3 * E2**2 / 32 + 45 * E2**3 / 1024, 15 * E2**2 / 256 + 45 * E2**3 / 1024, 35 * E2**3 / 3072)
    r = f"radians({degrees})"
    return f"6378137.0 * ({c[0]!r} * {r} - {c[1]!r} * sin(2 * {r}) + {c[2]!r} * sin(4 * {r}) - {c[3]!r} * sin(6 * {r}))"


def one(op: str, source: str, config: dict, columns: str, sql: str | None, extra: str = "", **how) -> None:
    """A query of one operation; geometries are shown as WKT. columns: what to keep, by SQL expressions; {wkt} is the text."""

    @query(op.replace(".", "_") + extra, sql)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        out = apply(op, SOURCES[source](spark, folder, **how), **config)
        return shown(out, columns)


def shown(out: DataFrame, columns: str) -> DataFrame:
    out = out.drop(ORD)
    if "wkt" in columns and "wkt" not in out.columns:
        out = apply("geo.to_wkt", out)
    return out.selectExpr(*[c.strip() for c in columns.split(";")])


one("geo.to_wkt", "points", {}, "id; wkt", f"SELECT id, 'POINT(' || CAST(x AS BIGINT) || ' ' || CAST(y AS BIGINT) || ')' AS wkt FROM {P}")
one("geo.centroid", "boxes", {}, "id; wkt", f"SELECT id, 'POINT(' || (x + 5) || ' ' || (y + 5) || ')' AS wkt FROM {B}")
one("geo.envelope", "lines", {}, "id; wkt", f"SELECT id, 'POLYGON((' || k || ' 0,' || (k + 3) || ' 0,' || (k + 3) || ' 10,' || k || ' 10,' || k || ' 0))' AS wkt FROM {L}")
one("geo.convex_hull", "lines", {}, "id; wkt", f"SELECT id, 'POLYGON((' || k || ' 0,' || (k + 3) || ' 4,' || (k + 3) || ' 10,' || k || ' 0))' AS wkt FROM {L}")
one("geo.boundary", "lines", {}, "id; wkt", f"SELECT id, 'MULTIPOINT((' || k || ' 0),(' || (k + 3) || ' 10))' AS wkt FROM {L}")


def ring(x: str, y: str, size: str, name: str = "POLYGON") -> str:
    """A box in the SQL of the oracle."""
    parts = [(x, y), (f"({x} + {size})", y), (f"({x} + {size})", f"({y} + {size})"), (x, f"({y} + {size})"), (x, y)]
    body = " || ',' || ".join(f"{a} || ' ' || {b}" for a, b in parts)
    o, c = ("(((", ")))") if name.startswith("MULTI") else ("((", "))")
    return f"'{name}{o}' || {body} || '{c}'"


one("geo.translate", "boxes", {"x_offset": 3, "y_offset": -1}, "id; wkt", f"SELECT id, {ring('(x + 3)', '(y - 1)', '10')} AS wkt FROM {B}")
one("geo.scale", "boxes", {"x_factor": 2, "y_factor": 2}, "id; wkt", f"SELECT id, {ring('(x * 2)', '(y * 2)', '20')} AS wkt FROM {B}")
one("geo.affine_transform", "boxes", {"coefficients": [1, 0, 7, 0, 1, 8]}, "id; wkt", f"SELECT id, {ring('(x + 7)', '(y + 8)', '10')} AS wkt FROM {B}")
one("geo.concave_hull", "boxes", {"concavity": 2.0}, "id; wkt", f"SELECT id, {ring('x', 'y', '10')} AS wkt FROM {B}")
one("geo.snap", "points", {"reference_wkb": hexed("POINT(50 0)"), "tolerance": 1.5}, "id; wkt", f"SELECT id, CASE WHEN sqrt((x - 50) ** 2 + y ** 2) <= 1.5 THEN 'POINT(50 0)' ELSE 'POINT(' || CAST(x AS BIGINT) || ' ' || CAST(y AS BIGINT) || ')' END AS wkt FROM {P}")
one("geo.line_substring", "lines", {"start_ratio": 0, "end_ratio": 5 / 11}, "id; wkt", f"SELECT id, 'LINESTRING(' || k || ' 0,' || (k + 3) || ' 4)' AS wkt FROM {L}")
one("geo.line_interpolate_point", "lines", {"ratio": 8 / 11}, "id; wkt", f"SELECT id, 'POINT(' || (k + 3) || ' 7)' AS wkt FROM {L}")
one("geo.simplify", "lines", {"tolerance": 5.0}, "id; wkt", f"SELECT id, 'LINESTRING(' || k || ' 0,' || (k + 3) || ' 10)' AS wkt FROM {L}")
one("geo.point_on_surface", "boxes", {}, "id; wkt", f"SELECT id, 'POINT(' || (x + 5) || ' ' || (y + 5) || ')' AS wkt FROM {B}")
for _op, _config, _columns, _sql in [
    ("geo.bounds_extractor", {}, "id; geometry_minx; geometry_miny; geometry_maxx; geometry_maxy", f"SELECT id, x::DOUBLE AS geometry_minx, y::DOUBLE AS geometry_miny, x + 10.0::DOUBLE AS geometry_maxx, y + 10.0::DOUBLE AS geometry_maxy FROM {B}"),
    ("geo.geometry_accessors", {"fields": ["geometry_type", "num_geometries", "num_interior_rings"]}, "id; geometry_type; num_geometries; num_interior_rings", f"SELECT id, 'Polygon' AS geometry_type, 1::BIGINT AS num_geometries, 0::BIGINT AS num_interior_rings FROM {B}"),
    ("geo.distance", {"other_wkb": hexed("POINT(0 100)")}, "id; round(distance, 6) as d", f"SELECT id, round(sqrt(x ** 2 + (100 - (y + 10)) ** 2), 6) AS d FROM {B}"),
    ("geo.hausdorff_distance", {"other_wkb": hexed("POINT(0 0)")}, "id; round(hausdorff_distance, 6) as d", f"SELECT id, round(sqrt((x + 10) ** 2 + (y + 10) ** 2), 6) AS d FROM {B}"),
]:
    one(_op, "boxes", _config, _columns, _sql)

def then(op: str, source: str, config: dict, after: str, columns: str, sql: str | None, after_config: dict | None = None, **how) -> None:
    """op, and a measure of what it makes."""

    @query(op.replace(".", "_"), sql)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        out = apply(after, apply(op, SOURCES[source](spark, folder, **how), **config), **(after_config or {}))
        return out.drop(ORD).selectExpr(*[c.strip() for c in columns.split(";")])


then("geo.rotate", "lines", {"degrees": 90}, "geo.bounds_extractor", "id; round(geometry_minx, 6) as a; round(geometry_maxy, 6) as b", f"SELECT id, -10.0::DOUBLE AS a, (k + 3)::DOUBLE AS b FROM {L}")
then("geo.reproject", "points", {"target_crs": "EPSG:3857"}, "geo.bounds_extractor", "id; round(geometry_minx, 3) as mx; round(geometry_miny, 3) + 0.0 as my", "SELECT id, round(6378137 * radians(x), 3) AS mx, round(6378137 * ln(tan(pi() / 4 + radians(y) / 2)), 3) + 0.0 AS my FROM (SELECT c_custkey AS id, CAST(c_custkey % 100 AS DOUBLE) AS x, floor(c_acctbal / 200) AS y FROM customer)", geographic=True)
one("geo.area", "blocks", {}, "id; round(area, 6) as area", f"SELECT id, round(w * h - {HOLED.format(0.0625)}, 6)::DOUBLE AS area FROM {SO}")
one("geo.perimeter", "blocks", {}, "id; round(perimeter, 6) as perimeter", f"SELECT id, round(2 * (w + h) + {HOLED.format(1.0)}, 6)::DOUBLE AS perimeter FROM {SO}")
one("geo.length", "flats", {}, "id; length", f"SELECT id, (k + 1)::DOUBLE AS length FROM {SO}")
one("geo.vertex_count", "blocks", {}, "id; vertex_count", f"SELECT id, (5 + {HOLED.format(5)})::BIGINT AS vertex_count FROM {SO}")
one("geo.geometry_diagnostics", "bows", {}, "id; is_valid; num_vertices; num_holes; minx; maxy", f"SELECT id, k % 4 <> 1 AS is_valid, (5 + CASE WHEN k % 4 <> 1 AND k % 3 = 0 THEN 5 ELSE 0 END)::BIGINT AS num_vertices, (CASE WHEN k % 4 <> 1 AND k % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS num_holes, k::DOUBLE AS minx, h::DOUBLE AS maxy FROM {SC}")
then("geo.make_valid", "bows", {}, "geo.area", "id; round(area, 6) as area", f"SELECT id, CASE WHEN k % 4 = 1 THEN w * h / 2.0 ELSE w * h - {HOLED.format(0.0625)} END::DOUBLE AS area FROM {SC}")
GRID = "floor(abs({0}) / 7.0 + 0.5) * 7 * sign({0})"
one("geo.snap_to_grid", "points", {"grid_size": 7}, "id; wkt", f"SELECT id, 'POINT(' || CAST({GRID.format('x')} AS BIGINT) || ' ' || CAST({GRID.format('y')} AS BIGINT) || ')' AS wkt FROM {P}")
one("geo.line_locate_point", "flats", {"point_wkb": hexed("POINT(10 3)")}, "id; round(location, 6) as location", f"SELECT id, round(least(1.0, 10.0 / (k + 1)), 6)::DOUBLE AS location FROM {SO}")
one("geo.frechet_distance", "flats", {"other_wkb": hexed("LINESTRING(0 2,20 2)")}, "id; round(frechet_distance, 6) as d", f"SELECT id, round(sqrt((k + 1 - 20) ** 2 + 4), 6) AS d FROM {SO}")
then("geo.densify", "flats", {"max_segment_length": 1.0}, "geo.vertex_count", "id; vertex_count", f"SELECT id, (k + 2)::BIGINT AS vertex_count FROM {SO}")
then("geo.buffer", "crates", {"distance": 1.0}, "geo.area", "id; round(area, 6) as area", f"SELECT id, round(w * h + 2 * (w + h) + 16 * sin(pi() / 16), 6) AS area FROM {SN}")
for _d, _extra in ((-0.25, "_inwards"),):

    @query(f"geo_buffer{_extra}", f"SELECT id, round((w - 0.5) * (h - 0.5), 6)::DOUBLE AS area FROM {SN}")
    def _inwards(spark: SparkSession, folder: str) -> DataFrame:
        return apply("geo.area", apply("geo.buffer", crates(spark, folder), distance=_d)).selectExpr("id", "round(area, 6) as area")


NEAR_X, NEAR_Y = "k % 40 - 20", "abs(k - 20)"
one("geo.geodesic_distance", "axes", {"other_wkb": hexed("POINT(0 0)")}, "id; round(geodesic_distance, 1) as d", f"SELECT id, round(CASE WHEN id % 2 = 0 THEN 6378137.0 * radians({NEAR_Y}) ELSE {arc(NEAR_Y)} END, 1)::DOUBLE AS d FROM {SC}", )
one("geo.bearing", "axes", {"other_wkb": hexed("POINT(0 0)")}, "id; round(bearing, 6) as bearing", f"SELECT id, (CASE WHEN k = 20 THEN 0 WHEN id % 2 = 0 AND k > 20 THEN 270 WHEN id % 2 = 0 THEN 90 WHEN k > 20 THEN 180 ELSE 0 END)::DOUBLE AS bearing FROM {SC}")
one("geo.geodesic_line_length", "corners", {}, "id; round(geodesic_length, 1) as d", f"SELECT id, round(6378137.0 * radians(k + 1) + {arc('h * 10')}, 1)::DOUBLE AS d FROM {SO}")
# half of the ellipsoid's surface has 2.55032810862e14 square metres
one("geo.geodesic_area", "slices", {}, "id; round(geodesic_area / 1e6, 0) as km2", f"SELECT id, round(2.5503281086204422e14 * (k + 1) / 360 / 1e6, 0)::DOUBLE AS km2 FROM {SN}")
G = "(SELECT c_custkey AS id, radians(CAST(c_custkey % 100 AS DOUBLE)) AS x, radians(floor(c_acctbal / 200)) AS y FROM customer)"
one("geo.haversine_distance", "points", {"other_wkb": hexed("POINT(10 20)")}, "id; round(haversine_distance, 2) as d", f"SELECT id, round(2 * 6371008.8 * asin(sqrt(sin((radians(20) - y) / 2) ** 2 + cos(y) * cos(radians(20)) * sin((radians(10) - x) / 2) ** 2)), 2) AS d FROM {G}", geographic=True)


#: Against the box from (10, 10) to (20, 20): conditions on a point and on a box's lower left corner.
POINT_TESTS = {"intersects": "{c}", "disjoint": "NOT ({c})", "within": "{o}", "covered_by": "{c}", "contains": "false", "covers": "false", "equals_topo": "false", "contains_properly": "false", "crosses": "false", "overlaps": "false", "touches": "({c}) AND NOT ({o})"}
CLOSED, OPEN = "x BETWEEN 10 AND 20 AND y BETWEEN 10 AND 20", "x > 10 AND x < 20 AND y > 10 AND y < 20"
for _name, _test in POINT_TESTS.items():
    one(f"geo.predicate_{_name}", "points", {"other_wkb": hexed("POLYGON((10 10,20 10,20 20,10 20,10 10))"), "output_column": "p"}, "id; p", f"SELECT id, {_test.format(c=CLOSED, o=OPEN)} AS p FROM {P}")
TOUCH = "abs(x - 10) <= 10 AND abs(y - 10) <= 10"
for _name, _test in {"intersects": TOUCH, "touches": f"({TOUCH}) AND NOT (x = 10 AND y = 10)", "equals_topo": "x = 10 AND y = 10", "overlaps": "false", "covers": "x = 10 AND y = 10", "disjoint": f"NOT ({TOUCH})"}.items():
    one(f"geo.predicate_{_name}", "boxes", {"other_wkb": hexed("POLYGON((10 10,20 10,20 20,10 20,10 10))"), "output_column": "p"}, "id; p", f"SELECT id, {_test} AS p FROM {B}", "_boxes")


#: Crates against a small box inside some of them, and against one that some of them cross.
FIT = "k < 3.25 AND k + w > 3.75 AND h > 0.75"
for _name, _wkt, _test in [("contains", "POLYGON((3.25 0.25,3.75 0.25,3.75 0.75,3.25 0.75,3.25 0.25))", FIT), ("contains_properly", "POLYGON((3.25 0.25,3.75 0.25,3.75 0.75,3.25 0.75,3.25 0.25))", FIT), ("overlaps", "POLYGON((5 -1,9 -1,9 1,5 1,5 -1))", "k < 9 AND k + w > 5"), ("covered_by", "POLYGON((4 0,12 0,12 5,4 5,4 0))", "k >= 4 AND k + w <= 12 AND h <= 5"), ("within", "POLYGON((4 0,12 0,12 5,4 5,4 0))", "k >= 4 AND k + w <= 12 AND h <= 5")]:
    one(f"geo.predicate_{_name}", "crates", {"other_wkb": hexed(_wkt), "output_column": "p"}, "id; p", f"SELECT id, {_test} AS p FROM {SN}", "_crates")
one("geo.predicate_crosses", "flats", {"other_wkb": hexed("POLYGON((5 -1,9 -1,9 1,5 1,5 -1))"), "output_column": "p"}, "id; p", f"SELECT id, k + 1 > 5 AS p FROM {SO}", "_flats")


def pair(op: str, left, right, config: dict, columns: str, sql: str | None, extra: str = "") -> None:
    @query(op.replace(".", "_") + extra, sql)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return shown(apply(op, left(spark, folder), right(spark, folder), **config), columns)


INSIDE = "p.x > b.x AND p.x < b.x + 10 AND p.y > b.y AND p.y < b.y + 10"
COVER = "p.x BETWEEN b.x AND b.x + 10 AND p.y BETWEEN b.y AND b.y + 10"
pair("geo.sjoin", points, boxes, {"predicate": "intersects"}, "id; __right_index as b", f"SELECT p.id, b.id AS b FROM {P} p JOIN {B} b ON {COVER}")
pair("geo.sjoin", points, boxes, {"predicate": "within"}, "id; __right_index as b", f"SELECT p.id, b.id AS b FROM {P} p JOIN {B} b ON {INSIDE}", "_within")
pair("geo.within", points, boxes, {}, "id; within", f"SELECT id, EXISTS (SELECT 1 FROM {B} b WHERE {INSIDE}) AS within FROM {P} p")
pair("geo.count_points_in_polygons", boxes, points, {}, "id; point_count", f"SELECT b.id, count(p.id) AS point_count FROM {B} b LEFT JOIN {P} p ON {INSIDE} GROUP BY b.id")
DIST = "sqrt(greatest(b.x - p.x, p.x - b.x - 10, 0) ** 2 + greatest(b.y - p.y, p.y - b.y - 10, 0) ** 2)"
pair("geo.nearest", points, boxes, {"max_distance": 30.0}, "id; __right_index as b; round(distance, 6) as d", f"WITH d AS (SELECT p.id, b.id AS b, round({DIST}, 6) AS d FROM {P} p, {B} b) SELECT id, b, d FROM d WHERE d <= 30 QUALIFY d = min(d) OVER (PARTITION BY id)")


def shifted(spark: SparkSession, folder: str) -> DataFrame:
    return boxes(spark, folder, shift=4)


SHARED = "greatest(w - 1, 0) * greatest(h - 1, 0)"
AREAS = {"intersection": SHARED, "union": f"2 * w * h - {SHARED}", "difference": f"w * h - {SHARED}", "symmetric_difference": f"2 * (w * h - {SHARED})"}
for _name, _area in AREAS.items():

    @query(f"geo_{_name}", f"SELECT id, ({_area})::DOUBLE AS area FROM {SN}")
    def _combined(spark: SparkSession, folder: str, name: str = _name) -> DataFrame:
        return apply("geo.area", apply(f"geo.{name}", crates(spark, folder), moved_crates(spark, folder))).selectExpr("id", "round(area, 6) as area")


@query("geo_clip", f"SELECT id, CASE WHEN x >= 10 AND y >= 10 THEN 100.0 WHEN x >= 10 OR y >= 10 THEN 60.0 ELSE 36.0 END::DOUBLE AS area FROM {B}")
def clip(spark: SparkSession, folder: str) -> DataFrame:
    return apply("geo.area", apply("geo.clip", boxes(spark, folder), shifted(spark, folder))).selectExpr("id", "round(area, 6) as area")


@query("geo_overlay", f"SELECT a.id AS l, b.id AS r, round((least(a.x, b.x + 4) + 10 - greatest(a.x, b.x + 4)) * (least(a.y, b.y + 4) + 10 - greatest(a.y, b.y + 4)), 6)::DOUBLE AS area FROM {B} a JOIN {B} b ON abs(a.x - b.x - 4) < 10 AND abs(a.y - b.y - 4) < 10")
def overlay(spark: SparkSession, folder: str) -> DataFrame:
    return apply("geo.area", apply("geo.overlay", boxes(spark, folder), shifted(spark, folder), mode="intersection")).selectExpr("__left_index as l", "__right_index as r", "round(area, 6) as area")


def _overlay_union(spark: SparkSession, folder: str) -> DataFrame:
    return apply("geo.area", apply("geo.overlay", boxes(spark, folder), shifted(spark, folder), mode="union")).selectExpr("round(sum(area), 6) as area")


query("geo_overlay_union", "SELECT 2500.0 + 2500.0 - 46.0 * 46.0 AS area")(_overlay_union)


@query("geo_dissolve", "SELECT 2500.0::DOUBLE AS area")
def dissolve(spark: SparkSession, folder: str) -> DataFrame:
    return apply("geo.area", apply("geo.dissolve", boxes(spark, folder))).selectExpr("round(area, 6) as area")


@query("geo_collect", f"SELECT x, count(*)::BIGINT AS n FROM {B} GROUP BY x")
def collect(spark: SparkSession, folder: str) -> DataFrame:
    return apply("geo.geometry_accessors", apply("geo.collect", boxes(spark, folder), group_by=["x"])).select("x", F.col("num_geometries").alias("n"))


def few(spark: SparkSession, folder: str) -> DataFrame:
    """The 25 lower left corners of the boxes."""
    df = read(spark, folder, "nation").selectExpr("cast(n_nationkey as long) as id", "cast(n_nationkey % 5 * 10 as double) as x", "cast(floor(n_nationkey / 5) * 10 as double) as y")
    return apply("geo.from_coords", with_order(df, "id"))


@query("geo_line_builder", f"SELECT 25::BIGINT AS vertex_count FROM {B} LIMIT 1")
def line_builder(spark: SparkSession, folder: str) -> DataFrame:
    return apply("geo.vertex_count", apply("geo.line_builder", few(spark, folder))).select("vertex_count")


@query("geo_polygon_builder", "SELECT 100.0::DOUBLE AS area")
def polygon_builder(spark: SparkSession, folder: str) -> DataFrame:
    corners = spark.createDataFrame([(0, 0.0, 0.0), (1, 10.0, 0.0), (2, 10.0, 10.0), (3, 0.0, 10.0)], "id long, x double, y double")
    return apply("geo.area", apply("geo.polygon_builder", apply("geo.from_coords", with_order(corners, "id")))).select("area")


def _line_merge(spark: SparkSession, folder: str) -> DataFrame:
    df = read(spark, folder, "nation").selectExpr("cast(n_nationkey as long) as id", "concat('LINESTRING(', n_nationkey, ' 0,', n_nationkey + 1, ' 0)') as wkt")
    return apply("geo.length", apply("geo.vertex_count", apply("geo.line_merge", apply("geo.from_wkt", with_order(df, "id"), wkt_column="wkt")))).select("vertex_count", "length")


query("geo_line_merge", "SELECT 26::BIGINT AS vertex_count, 25.0::DOUBLE AS length")(_line_merge)


@query("geo_polygonize", "SELECT 25::BIGINT AS n, 2500.0::DOUBLE AS area")
def polygonize(spark: SparkSession, folder: str) -> DataFrame:
    return apply("geo.area", apply("geo.polygonize", boxes(spark, folder))).where("__class = 'polygon'").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("area"), 6).alias("area"))


@query("geo_voronoi", f"SELECT id, 100.0::DOUBLE AS area FROM {B} WHERE x BETWEEN 10 AND 30 AND y BETWEEN 10 AND 30")
def voronoi(spark: SparkSession, folder: str) -> DataFrame:
    return apply("geo.area", apply("geo.voronoi", few(spark, folder))).where("x BETWEEN 10 AND 30 AND y BETWEEN 10 AND 30").selectExpr("id", "round(area, 6) as area")


@query("geo_delaunay", f"SELECT id, 2::BIGINT AS n, (w * h)::DOUBLE AS area FROM {SN}")
def delaunay(spark: SparkSession, folder: str) -> DataFrame:
    return apply("geo.area", apply("geo.delaunay", crates(spark, folder))).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("area"), 6).alias("area"))


@query("geo_clean_topology", f"SELECT id, (CASE WHEN x = 0 THEN 12 ELSE 10 END * CASE WHEN y = 0 THEN 12 ELSE 10 END)::DOUBLE AS area FROM {B}")
def clean_topology(spark: SparkSession, folder: str) -> DataFrame:
    return apply("geo.area", apply("geo.clean_topology", boxes(spark, folder, size=12), snap_tolerance=0.0)).selectExpr("id", "round(area, 6) as area")


@query("geo_cluster_dbscan", f"SELECT id, CASE WHEN id % 5 < 2 THEN 0 WHEN id % 5 > 2 THEN 1 END::BIGINT AS cluster_id FROM {B}")
def cluster_dbscan(spark: SparkSession, folder: str) -> DataFrame:
    gap = "cast(n_nationkey % 5 + if(n_nationkey % 5 > 2, 20, 0) + if(n_nationkey % 5 = 2, 100 + n_nationkey * 10, 0) as double) as x"
    df = read(spark, folder, "nation").selectExpr("cast(n_nationkey as long) as id", gap, "cast(floor(n_nationkey / 5) as double) as y")
    return apply("geo.cluster_dbscan", apply("geo.from_coords", with_order(df, "id")), eps=1.5, min_points=3).select("id", "cluster_id")


@query("geo_coverage_validate", f"SELECT a.id AS a, b.id AS b, ((12 - abs(a.x - b.x)) * (12 - abs(a.y - b.y)))::DOUBLE AS area FROM {B} a JOIN {B} b ON a.id < b.id AND abs(a.x - b.x) <= 10 AND abs(a.y - b.y) <= 10")
def coverage_validate(spark: SparkSession, folder: str) -> DataFrame:
    return apply("geo.coverage_validate", boxes(spark, folder, size=12)).selectExpr("index_a as a", "index_b as b", "round(area, 6) as area")


@query("geo_shared_paths", f"SELECT a.id AS a, b.id AS b, 10.0::DOUBLE AS n FROM {B} a JOIN {B} b ON a.id < b.id AND abs(a.x - b.x) + abs(a.y - b.y) = 10")
def shared_paths(spark: SparkSession, folder: str) -> DataFrame:
    return apply("geo.shared_paths", boxes(spark, folder)).selectExpr("index_a as a", "index_b as b", "round(shared_length, 6) as n")


@query("geo_explode", f"SELECT k % 5 AS g, (w * h)::DOUBLE AS area FROM {SN}")
def explode(spark: SparkSession, folder: str) -> DataFrame:
    grouped = apply("geo.collect", crates(spark, folder).withColumn("g", F.expr("k % 5")), group_by=["g"])
    return apply("geo.area", apply("geo.explode", grouped)).selectExpr("g", "round(area, 6) as area")


@query("geo_split", f"SELECT id, CASE WHEN x = 10 THEN 50.0 ELSE 100.0 END::DOUBLE AS area FROM {B} UNION ALL SELECT id, 50.0 FROM {B} WHERE x = 10")
def split(spark: SparkSession, folder: str) -> DataFrame:
    return apply("geo.area", apply("geo.split", boxes(spark, folder), other_wkb=hexed("LINESTRING(15 -10,15 100)"))).selectExpr("id", "round(area, 6) as area")


def _subdivide(spark: SparkSession, folder: str) -> DataFrame:
    ring = apply("geo.buffer", few(spark, folder), distance=3.0)
    whole = apply("geo.area", ring).agg(F.round(F.sum("area"), 6).alias("area"))
    parts = apply("geo.subdivide", ring, max_vertices=12)
    return apply("geo.vertex_count", apply("geo.area", parts)).agg(F.round(F.sum("area"), 6).alias("area"), F.max("vertex_count").alias("most")).crossJoin(whole.withColumnRenamed("area", "whole")).selectExpr("abs(area - whole) < 0.001 as same", "most <= 12 as small")


query("geo_subdivide", "SELECT true AS same, true AS small")(_subdivide)


@query("geo_generate_grid", "SELECT i AS cell_i, j AS cell_j, ((least(i * 10 + 10, 45) - i * 10) * 10)::DOUBLE AS area FROM range(5) a(i), range(3) b(j)")
def generate_grid(spark: SparkSession, folder: str) -> DataFrame:
    df = read(spark, folder, "region")
    grid = apply("geo.generate_grid", df, extent={"minx": 0, "miny": 0, "maxx": 45, "maxy": 30}, cell_size=10)
    return apply("geo.area", grid).selectExpr("cell_i", "cell_j", "round(area, 6) as area")



@query("geo_from_wkt", f"SELECT id, {ring('x', 'y', '10')} AS wkt FROM {B}")
def from_wkt(spark: SparkSession, folder: str) -> DataFrame:
    return shown(boxes(spark, folder), "id; wkt")


def _from_coords(spark: SparkSession, folder: str) -> DataFrame:
    return apply("geo.bounds_extractor", points(spark, folder)).selectExpr("id", "geometry_minx as x", "geometry_miny as y")


query("geo_from_coords", f"SELECT id, x, y FROM {P}")(_from_coords)
