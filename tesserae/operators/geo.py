"""Operations on a geometry column: WKB in a binary column marked by its metadata.

Cells are worked on in Arrow batches. Joins are equi-joins on the cells of a grid, with
each pair kept in one cell only, so that neither side is broadcast and no product of the
tables is formed. Operations on a whole table gather it only where their result is one
geometry.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..geo import codec, columns, planar, shapes
from ..geo.codec import Geometry, GeometryError, read_wkb, simple, write_wkb
from ..relation import ORD, PlanError, col, data, kind, need, new_name, durable, operation, refuse, steady, with_order
from .columns import numbered

PREDICATES = ["intersects", "disjoint", "contains", "within", "equals_topo", "covers", "covered_by", "contains_properly", "touches", "crosses", "overlaps"]


def with_geometry(df: DataFrame, column: str = "geometry", crs: str = "EPSG:3857") -> DataFrame:
    """Marks a binary column as the table's geometry."""
    if not isinstance(kind(df, column), T.BinaryType):
        raise PlanError(f"column {column!r} is not binary")
    return df.withMetadata(column, {"geometry": True, "crs": crs})


def geometry(df: DataFrame) -> str:
    names = [f.name for f in df.schema.fields if f.metadata.get("geometry")]
    if len(names) != 1:
        raise PlanError("the table needs exactly one geometry column")
    return names[0]


def crs(df: DataFrame) -> str:
    code = df.schema[geometry(df)].metadata.get("crs")
    if not code:
        raise PlanError("the coordinate system is not known")
    return code


def planar_only(df: DataFrame) -> DataFrame:
    if shapes.geographic(crs(df)):
        raise PlanError("a projected coordinate system is needed")
    return df


def degrees_only(df: DataFrame) -> DataFrame:
    if not shapes.geographic(crs(df)):
        raise PlanError("a geographic coordinate system is needed")
    return df


def same(left: DataFrame, right: DataFrame) -> None:
    if crs(left).upper() != crs(right).upper():
        raise PlanError("the coordinate systems differ")


ARROW = {"binary": pa.binary(), "double": pa.float64(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}


def arrow_type(t: T.DataType) -> pa.DataType:
    if isinstance(t, T.ArrayType):
        return pa.list_(arrow_type(t.elementType))
    if isinstance(t, T.StructType):
        return pa.struct([(f.name, arrow_type(f.dataType)) for f in t.fields])
    return {T.BinaryType(): pa.binary(), T.DoubleType(): pa.float64(), T.LongType(): pa.int64(), T.BooleanType(): pa.bool_(), T.StringType(): pa.string()}[t]


def each(f: Callable, out: str, *inputs: Column, fast: Callable | None = None) -> Column:
    """f of the geometries in the columns, null if one of them is. fast: the same of a whole batch, None where it can't."""
    spark_type = T._parse_datatype_string(out)
    kind_ = arrow_type(spark_type)

    def rows(*arrays: pa.Array) -> pa.Array:
        return pa.array([None if any(x is None for x in xs) else f(*map(read_wkb, xs)) for xs in zip(*[a.to_pylist() for a in arrays], strict=True)], kind_)

    if len(inputs) == 1:

        def one(a: pa.Array) -> pa.Array:
            if fast is not None and (c := columns.decode(a)) is not None and (made := fast(c)) is not None:
                return made
            return rows(a)

        return F.arrow_udf(one, spark_type)(inputs[0])

    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        if fast is not None and (c := columns.decode(a)) is not None and (d := columns.decode(b)) is not None and (made := fast(c, d)) is not None:
            return made
        return rows(a, b)

    return F.arrow_udf(two, spark_type)(*inputs)


def replaced(df: DataFrame, f: Callable[[Geometry], Geometry | None], code: str | None = None, fast: Callable | None = None) -> DataFrame:
    """df with each geometry g replaced by f(g)."""
    g = geometry(df)

    def run(x: Geometry) -> bytes | None:
        y = f(x)
        return None if y is None else write_wkb(y)

    return with_geometry(df.withColumn(g, each(run, "binary", col(g), fast=fast)), g, code or crs(df))


def measured(df: DataFrame, name: str, f: Callable, out: str, fast: Callable | None = None) -> DataFrame:
    return df.withColumn(new_name(name), each(f, out, col(geometry(df)), fast=fast))


def other(hexed: str) -> Geometry:
    try:
        return read_wkb(bytes.fromhex(hexed))
    except ValueError as e:
        raise PlanError(f"the geometry of the configuration can't be read: {e}") from None


def filled(f: Callable) -> Callable:
    """f, refusing empty geometries."""

    def run(g: Geometry):
        if planar.bounds(g) is None:
            raise GeometryError("the geometry is empty")
        return f(g)

    return run


def line(g: Geometry) -> list | None:
    return g[1] if g[0] == "LineString" and len(g[1]) > 1 else None


def need_line(g: Geometry) -> list:
    if line(g) is None:
        raise GeometryError("a LineString is needed")
    return g[1]


# --- transforms --------------------------------------------------------------------------


@operation("geo.centroid")
def centroid(df: DataFrame) -> DataFrame:
    return replaced(planar_only(df), filled(lambda g: ("Point", planar.centroid(g))), fast=columns.centroid)


@operation("geo.convex_hull")
def convex_hull(df: DataFrame) -> DataFrame:
    def one(raw: bytes) -> bytes:
        return write_wkb(("Polygon", [planar.hull(codec.coordinates(read_wkb(raw)))]))

    def hulls(c: columns.Columns) -> pa.Array:
        out, left = columns.convex_hull(c)
        if not left.any():
            return out
        rows = [c.buf[c.offsets[k] : c.offsets[k + 1]].tobytes() if left[k] else None for k in range(c.rows)]
        return pa.array([x if r is None else one(r) for x, r in zip(out.to_pylist(), rows, strict=True)], pa.binary())

    return replaced(planar_only(df), filled(lambda g: ("Polygon", [planar.hull(codec.coordinates(g))])), fast=hulls)


@operation("geo.envelope")
def envelope(df: DataFrame) -> DataFrame:
    return replaced(planar_only(df), planar.envelope, fast=columns.envelope)


@operation("geo.boundary")
def boundary(df: DataFrame) -> DataFrame:
    return replaced(planar_only(df), planar.boundary)


@operation("geo.buffer")
def buffer(df: DataFrame, distance: float, cap: str = "round") -> DataFrame:
    if cap not in ("round", "flat", "square") or not math.isfinite(distance):
        raise PlanError("a finite distance and a round, flat or square cap are needed")
    return replaced(planar_only(df), lambda g: shapes.buffer(g, distance, cap))


@operation("geo.simplify")
def simplify(df: DataFrame, tolerance: float, policy: str = "douglas_peucker") -> DataFrame:
    if tolerance < 0:
        raise PlanError("the tolerance is not negative")
    fast = (lambda c: columns.simplified(c, tolerance)) if policy == "douglas_peucker" else None
    return replaced(planar_only(df), lambda g: shapes.simplify(g, tolerance, policy), fast=fast)


@operation("geo.point_on_surface")
def point_on_surface(df: DataFrame) -> DataFrame:
    return replaced(planar_only(df), shapes.point_on_surface)


@operation("geo.make_valid")
def make_valid(df: DataFrame) -> DataFrame:
    crs(df)
    return replaced(df, planar.repaired)


@operation("geo.reproject")
def reproject(df: DataFrame, target_crs: str) -> DataFrame:
    source = crs(df)
    if source.upper() == target_crs.upper():
        return df
    for c in (source, target_crs):
        shapes.projection(c, False)
    return replaced(df, lambda g: shapes.reproject(g, source, target_crs), target_crs)


def affine(df: DataFrame, a: float, b: float, xoff: float, d: float, e: float, yoff: float) -> DataFrame:
    if not all(map(math.isfinite, (a, b, xoff, d, e, yoff))):
        raise PlanError("the coefficients are finite")
    return replaced(planar_only(df), lambda g: codec.mapped(g, lambda x, y: codec.finite((a * x + b * y + xoff, d * x + e * y + yoff))), fast=lambda g: columns.moved(g, lambda x, y: (a * x + b * y + xoff, d * x + e * y + yoff)))


@operation("geo.affine_transform")
def affine_transform(df: DataFrame, coefficients: list[float]) -> DataFrame:
    if len(coefficients) != 6:
        raise PlanError("six coefficients are needed")
    return affine(df, *coefficients)


@operation("geo.translate")
def translate(df: DataFrame, x_offset: float, y_offset: float) -> DataFrame:
    return affine(df, 1, 0, x_offset, 0, 1, y_offset)


@operation("geo.scale")
def scale(df: DataFrame, x_factor: float, y_factor: float, x_origin: float = 0.0, y_origin: float = 0.0) -> DataFrame:
    return affine(df, x_factor, 0, x_origin - x_factor * x_origin, 0, y_factor, y_origin - y_factor * y_origin)


@operation("geo.rotate")
def rotate(df: DataFrame, degrees: float, x_origin: float = 0.0, y_origin: float = 0.0) -> DataFrame:
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    turned = lambda x, y: (x_origin + c * (x - x_origin) - s * (y - y_origin), y_origin + s * (x - x_origin) + c * (y - y_origin))
    return replaced(planar_only(df), lambda g: codec.mapped(g, turned), fast=lambda g: columns.moved(g, turned))


@operation("geo.concave_hull")
def concave_hull(df: DataFrame, concavity: float, length_threshold: float = 0.0) -> DataFrame:
    if concavity <= 0 or length_threshold < 0:
        raise PlanError("concavity is above 0 and the threshold not below")
    return replaced(planar_only(df), filled(lambda g: shapes.concave_hull(g, concavity, length_threshold)))


@operation("geo.densify")
def densify(df: DataFrame, max_segment_length: float) -> DataFrame:
    return replaced(planar_only(df), lambda g: shapes.densify(g, max_segment_length), fast=(lambda c: columns.densified(c, max_segment_length)) if max_segment_length > 0 else None)


@operation("geo.snap_to_grid")
def snap_to_grid(df: DataFrame, grid_size: float) -> DataFrame:
    return replaced(planar_only(df), lambda g: shapes.snapped_to_grid(g, grid_size), fast=(lambda g: columns.snapped_to_grid(g, grid_size)) if grid_size > 0 else None)


@operation("geo.line_substring")
def line_substring(df: DataFrame, start_ratio: float, end_ratio: float) -> DataFrame:
    if not 0 <= start_ratio <= end_ratio <= 1:
        raise PlanError("ratios rise from 0 to 1")
    return replaced(planar_only(df), lambda g: shapes.substring(need_line(g), start_ratio, end_ratio))


@operation("geo.line_interpolate_point")
def line_interpolate_point(df: DataFrame, ratio: float) -> DataFrame:
    if not 0 <= ratio <= 1:
        raise PlanError("the ratio lies from 0 to 1")
    return replaced(planar_only(df), lambda g: ("Point", shapes.along(need_line(g), ratio)), fast=lambda c: columns.along(c, ratio))


@operation("geo.snap")
def snap(df: DataFrame, reference_wkb: str, tolerance: float) -> DataFrame:
    reference = other(reference_wkb)
    return replaced(planar_only(df), lambda g: shapes.snapped(g, reference, tolerance))


# --- measures ----------------------------------------------------------------------------


@operation("geo.area")
def area(df: DataFrame, output_column: str = "area") -> DataFrame:
    return measured(planar_only(df), output_column, planar.area, "double", fast=columns.area)


@operation("geo.length")
def length(df: DataFrame, output_column: str = "length") -> DataFrame:
    return measured(planar_only(df), output_column, lambda g: float(planar.length(g)), "double", fast=columns.length)


@operation("geo.perimeter")
def perimeter(df: DataFrame, output_column: str = "perimeter") -> DataFrame:
    return length(df, output_column)


@operation("geo.vertex_count")
def vertex_count(df: DataFrame, output_column: str = "vertex_count") -> DataFrame:
    return measured(df, output_column, lambda g: len(codec.coordinates(g)), "long", fast=columns.vertex_count)


@operation("geo.to_wkt")
def to_wkt(df: DataFrame, output_column: str = "wkt") -> DataFrame:
    return measured(df, output_column, codec.write_wkt, "string", fast=lambda c: columns.write_texts(c, codec.shown, codec.KINDS))


def spread(struct: Column, df: DataFrame, fields: list[str], names: list[str]) -> DataFrame:
    out = df.withColumn("__struct", struct)
    for f, n in zip(fields, names, strict=True):
        out = out.withColumn(new_name(n), F.col("__struct")[f])
    return out.drop("__struct")


BOX = "struct<minx: double, miny: double, maxx: double, maxy: double>"
CORNERS = ["minx", "miny", "maxx", "maxy"]


def box(g: Geometry) -> dict | None:
    b = planar.bounds(g)
    return None if b is None else dict(zip(CORNERS, map(float, b), strict=True))


@operation("geo.bounds_extractor")
def bounds_extractor(df: DataFrame) -> DataFrame:
    g = geometry(planar_only(df))
    return spread(each(box, BOX, col(g), fast=columns.box), df, CORNERS, [f"{g}_{c}" for c in CORNERS])


ACCESSORS = {"geometry_type": "string", "num_geometries": "long", "num_interior_rings": "long", "start_point": "binary", "end_point": "binary", "is_closed": "boolean"}


@operation("geo.geometry_accessors")
def geometry_accessors(df: DataFrame, fields: list[str] | None = None, output_prefix: str = "") -> DataFrame:
    fields = list(fields or ACCESSORS)
    if set(fields) - set(ACCESSORS):
        raise PlanError("there is no such accessor")

    def run(g: Geometry) -> dict:
        out = shapes.accessors(g)
        return {f: write_wkb(out[f]) if isinstance(out[f], tuple) else out[f] for f in fields}

    shape = "struct<" + ", ".join(f"{f}: {ACCESSORS[f]}" for f in fields) + ">"
    return spread(each(run, shape, col(geometry(df))), df, fields, [output_prefix + f for f in fields])


DIAGNOSIS = {"is_empty": "boolean", "is_valid": "boolean", "geometry_type": "string", "num_parts": "long", "num_vertices": "long", "num_holes": "long", "minx": "double", "miny": "double", "maxx": "double", "maxy": "double"}


@operation("geo.geometry_diagnostics")
def geometry_diagnostics(df: DataFrame) -> DataFrame:
    """The geometry column gives way to what is found about it; invalid geometries are not refused."""
    g = geometry(df)

    def run(x: Geometry) -> dict:
        b = planar.bounds(x)
        return {"is_empty": b is None, "is_valid": planar.valid(x), "geometry_type": x[0], "num_parts": len(simple(x)), "num_vertices": len(codec.coordinates(x)), "num_holes": sum(len(d) - 1 for k, d in simple(x) if k == "Polygon"), **dict(zip(CORNERS, b or [None] * 4, strict=True))}

    shape = "struct<" + ", ".join(f"{k}: {v}" for k, v in DIAGNOSIS.items()) + ">"
    return spread(each(run, shape, col(g)), df, list(DIAGNOSIS), list(DIAGNOSIS)).drop(g)


@operation("geo.line_locate_point")
def line_locate_point(df: DataFrame, point_wkb: str, output_column: str = "location") -> DataFrame:
    p = other(point_wkb)
    return measured(df, output_column, lambda g: shapes.located(g[1], p[1]) if line(g) else None, "double")


@operation("geo.geodesic_line_length")
def geodesic_line_length(df: DataFrame, output_column: str = "geodesic_length") -> DataFrame:
    return measured(degrees_only(df), output_column, lambda g: float(shapes.geodesic_length(g)), "double", fast=lambda c: columns.geodesic_length(c, shapes.WIDTH, shapes.FLAT))


@operation("geo.geodesic_area")
def geodesic_area(df: DataFrame, output_column: str = "geodesic_area") -> DataFrame:
    return measured(degrees_only(df), output_column, lambda g: float(shapes.geodesic_area(g)), "double")


# --- against one geometry ----------------------------------------------------------------


@operation("geo.distance")
def distance(df: DataFrame, other_wkb: str, output_column: str = "distance") -> DataFrame:
    h = other(other_wkb)
    return measured(planar_only(df), output_column, lambda g: planar.distance(g, h), "double", fast=(lambda c: columns.distance_to_point(c, *h[1])) if h[0] == "Point" and h[1] else None)


@operation("geo.hausdorff_distance")
def hausdorff_distance(df: DataFrame, other_wkb: str, output_column: str = "hausdorff_distance") -> DataFrame:
    h = other(other_wkb)
    return measured(planar_only(df), output_column, lambda g: planar.hausdorff(g, h), "double")


@operation("geo.frechet_distance")
def frechet_distance(df: DataFrame, other_wkb: str, output_column: str = "frechet_distance") -> DataFrame:
    h = need_line(other(other_wkb))
    return measured(planar_only(df), output_column, lambda g: planar.frechet(need_line(g), h), "double")


def point(g: Geometry):
    if g[0] != "Point":
        raise GeometryError("a Point is needed")
    return g[1]


def from_points(h: tuple | None, f: Callable) -> Callable | None:
    """Of a batch of points, f(x, y); not where the other point is empty or out of range, which the rows tell."""
    if h is None or not columns.on_earth(*map(np.array, h)):
        return None
    return lambda c: columns.from_points(c, f)


def settled(x: np.ndarray, y: np.ndarray, h: tuple, which: int) -> np.ndarray | None:
    made = columns.inverse(x, y, np.full(len(x), h[0]), np.full(len(x), h[1]), shapes.WIDTH, shapes.FLAT)
    return None if made[2].any() else made[which]


@operation("geo.haversine_distance")
def haversine_distance(df: DataFrame, other_wkb: str, output_column: str = "haversine_distance") -> DataFrame:
    h = point(other(other_wkb))
    return measured(degrees_only(df), output_column, lambda g: shapes.haversine(point(g), h) if point(g) else None, "double", fast=from_points(h, lambda x, y: columns.haversine(x, y, *h, shapes.RADIUS)))


@operation("geo.geodesic_distance")
def geodesic_distance(df: DataFrame, other_wkb: str, output_column: str = "geodesic_distance") -> DataFrame:
    h = point(other(other_wkb))
    return measured(degrees_only(df), output_column, lambda g: shapes.inverse(point(g), h)[0] if point(g) else None, "double", fast=from_points(h, lambda x, y: settled(x, y, h, 0)))


@operation("geo.bearing")
def bearing(df: DataFrame, other_wkb: str, output_column: str = "bearing") -> DataFrame:
    h = point(other(other_wkb))
    return measured(degrees_only(df), output_column, lambda g: shapes.inverse(point(g), h)[1] if point(g) else None, "double", fast=from_points(h, lambda x, y: settled(x, y, h, 1)))


def _predicate(name: str) -> None:
    @operation(f"geo.predicate_{name}")
    def run(df: DataFrame, other_wkb: str, output_column: str = name) -> DataFrame:
        h = other(other_wkb)
        raw = bytes.fromhex(other_wkb)

        area = columns.Area([d for _, d in simple(h)]) if h[0] in ("Polygon", "MultiPolygon") else None

        def fast(c: columns.Columns) -> pa.Array | None:
            kinds = set(c.kind[~c.null].tolist())
            if kinds == {2} and area is not None and area.box is not None:
                found, left = columns.lines_to_area(name, c, area)
                for k in np.flatnonzero(left):
                    found[k] = planar.predicate(name, read_wkb(c.buf[c.offsets[k] : c.offsets[k + 1]].tobytes()), h)
                return columns.masked(found, c.null)
            d = columns.decode(pa.array([raw], pa.binary()).take(pa.array(np.zeros(c.rows, np.int64)))) if kinds == {1} else None
            return None if d is None else columns.related(name, c, d)

        return measured(planar_only(df), output_column, lambda g: planar.predicate(name, g, h), "boolean", fast=fast)


for _name in PREDICATES:
    _predicate(_name)


# --- two tables --------------------------------------------------------------------------


def placed(df: DataFrame) -> DataFrame:
    """df with __n, the position of each row, which is the same however often the frame is computed."""
    return numbered(steady(df), "__n", 0)


def boxed(rows: DataFrame, g: str, p: str) -> DataFrame:
    """Position, geometry and box of the placed() rows that have one."""
    out = rows.select(F.col("__n").alias(p + "n"), col(g).alias(p + "g"), each(box, BOX, col(g), fast=columns.box).alias(p + "b"))
    return out.where(F.col(p + "b").isNotNull())


def extent(p: str, grow: float = 0.0) -> Column:
    b = F.col(p + "b")
    return F.greatest(b["maxx"] - b["minx"], b["maxy"] - b["miny"]) + 2 * grow


def exponent(size: Column) -> Column:
    """The least power of two that is not below a size."""
    return F.when(size > 0, F.ceil(F.log2(size))).otherwise(-1074).cast("int")


@dataclass
class Grid:
    """Cells of several sizes, all powers of two: least is the exponent of the smallest ones, levels those of larger boxes.

    A box belongs to the level of its own size, where it meets few cells, and is looked up on
    the larger levels that there are; so one huge box doesn't put all small ones together.
    """

    least: int
    levels: list[int]


def grid(*frames: tuple[DataFrame, str]) -> Grid:
    """From the middle extents of the boxes or, for points, the density of the bulk of the table."""
    sizes, levels = [], set()
    for df, p in frames:
        b = F.col(p + "b")
        ends = lambda c: F.percentile_approx(b[c], F.array(F.lit(0.05), F.lit(0.95)), 1000)  # noqa: B023, E731
        # at most one level for each exponent of a double
        n, w, x, y, own = df.agg(F.count(F.lit(1)), F.percentile_approx(extent(p), 0.5, 1000), ends("minx"), ends("miny"), F.collect_set(exponent(extent(p)))).first()
        if n:
            sizes.append(max(w, max(x[1] - x[0], y[1] - y[0]) / max(1.0, math.sqrt(n))))
            levels.update(own)
    least = math.ceil(math.log2(min([s for s in sizes if s > 0], default=1.0)))
    return Grid(least, sorted({max(k, least) for k in levels}))


def celled(df: DataFrame, p: str, on: Grid, grow: float = 0.0) -> DataFrame:
    least = max(on.least, math.ceil(math.log2(2 * grow))) if grow > 0 else on.least
    levels = sorted({max(k, least) + more for k in on.levels for more in ((0, 1) if grow > 0 else (0,))} | {least})
    out = df.withColumn(p + "v", F.greatest(exponent(extent(p, grow)), F.lit(least)))
    listed = F.array(*[F.lit(k) for k in levels])
    out = out.withColumn("level", F.explode(F.array_union(F.array(p + "v"), F.filter(listed, lambda k: k > F.col(p + "v")))))
    side = F.pow(F.lit(2.0), F.col("level"))
    lo = lambda c: F.floor((F.col(p + "b")[c] - grow) / side).cast("long")
    hi = lambda c: F.floor((F.col(p + "b")[c] + grow) / side).cast("long")
    return out.withColumn("cx", F.explode(F.sequence(lo("minx"), hi("maxx")))).withColumn("cy", F.explode(F.sequence(lo("miny"), hi("maxy"))))


def pairs(l: DataFrame, r: DataFrame, on: Grid, grow: float = 0.0) -> DataFrame:
    """Rows whose boxes, widened by grow / 2 each, meet: each pair once, on the level of the larger box, in the cell of the lower left corner of what they share."""
    both = celled(l, "l", on, grow / 2).join(celled(r, "r", on, grow / 2), ["level", "cx", "cy"]).where(F.col("level") == F.greatest("lv", "rv"))
    low = lambda c: F.greatest(F.col("lb")[c] - grow / 2, F.col("rb")[c] - grow / 2)
    high = lambda c: F.least(F.col("lb")[c] + grow / 2, F.col("rb")[c] + grow / 2)
    meet = (low("minx") <= high("maxx")) & (low("miny") <= high("maxy"))
    side = F.pow(F.lit(2.0), F.col("level"))
    own = (F.floor(low("minx") / side) == F.col("cx")) & (F.floor(low("miny") / side) == F.col("cy"))
    return both.where(meet & own).select("ln", "lg", "rn", "rg", "lb", "rb")


def sides(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The left rows with their positions, and both sides boxed."""
    same(left, right)
    rows = placed(planar_only(left))
    return rows, boxed(rows, geometry(left), "l"), boxed(placed(right), geometry(right), "r")


def joined(left: DataFrame, right: DataFrame, predicate: str) -> tuple[DataFrame, DataFrame]:
    """The left rows with their positions, and the positions of both sides of each hit."""
    rows, l, r = sides(left, right)
    p = pairs(l, r, grid((l, "l"), (r, "r")))
    holds = each(lambda g, h: planar.predicate(predicate, g, h), "boolean", F.col("lg"), F.col("rg"), fast=lambda c, d: columns.related(predicate, c, d))
    return rows, p.where(holds).select("ln", "rn")


@operation("geo.sjoin", "BB")
def sjoin(left: DataFrame, right: DataFrame, predicate: str = "intersects") -> DataFrame:
    if predicate not in ("intersects", "contains", "within", "crosses", "overlaps", "touches"):
        raise PlanError(f"there is no predicate {predicate!r}")
    rows, hits = joined(left, right, predicate)
    return rows.join(hits, F.col("__n") == F.col("ln")).select(*[col(c) for c in data(left)], F.col("rn").alias("__right_index"))


def distances(c: columns.Columns, d: columns.Columns) -> pa.Array | None:
    """planar.distance() of a batch; where hardly anything lies between two, its tolerances tell whether they meet."""
    found = columns.distance(c, d)
    if found is None:
        return None
    out = found.fill_null(0.0).to_numpy(zero_copy_only=False).copy()
    scale = np.maximum(*(np.abs(columns.bounds(x)[0]).max(axis=0) for x in (c, d)))
    for k in np.flatnonzero((out > 0) & (out <= 1e-10 * scale)):
        out[k] = planar.distance(*(read_wkb(x.buf[x.offsets[k] : x.offsets[k + 1]].tobytes()) for x in (c, d)))
    return columns.masked(out, c.null | d.null)


@operation("geo.nearest", "BB")
def nearest(left: DataFrame, right: DataFrame, max_distance: float | None = None) -> DataFrame:
    """All right geometries at the least distance. The search radius grows for rows that have found none; a row is done when its best lies within the radius.

    It begins at the right side's own distances, however many rows the left has. What a round
    has found is written once, so that later ones don't search again.
    """
    rows, l, r = sides(left, right)
    on = grid((l, "l"), (r, "r"))
    size = 2.0 ** grid((r, "r")).least
    found, todo, radius = None, l, size if max_distance is None else min(size, max_distance)
    b = l.agg(F.min(F.col("lb")["minx"]), F.max(F.col("lb")["maxx"]), F.min(F.col("lb")["miny"]), F.max(F.col("lb")["maxy"])).first()
    c = r.agg(F.min(F.col("rb")["minx"]), F.max(F.col("rb")["maxx"]), F.min(F.col("rb")["miny"]), F.max(F.col("rb")["maxy"])).first()
    far = 0.0 if b[0] is None or c[0] is None else max(abs(x - y) for x in b for y in c) * 2 + size
    if max_distance is not None:
        far = min(far, max_distance)
    while far:
        radius = min(radius, far)
        p = pairs(todo, r, on, radius)
        near = p.withColumn("distance", each(planar.distance, "double", F.col("lg"), F.col("rg"), fast=distances)).where(F.col("distance") <= radius).select("ln", "rn", "distance")
        # few rows for each of the left: those within the radius
        hit = near.withColumn("__best", F.min("distance").over(Window.partitionBy("ln"))).where("distance = __best").select("ln", "rn", "distance")
        hit = hit if radius >= far else durable(hit)
        found = hit if found is None else found.unionByName(hit)
        if radius >= far:
            break
        todo = todo.join(hit.select("ln"), "ln", "left_anti")
        radius *= 4
    if found is None:
        found = left.sparkSession.createDataFrame([], "ln long, rn long, distance double")
    return rows.join(found, F.col("__n") == F.col("ln")).select(*[col(c) for c in data(left)], F.col("rn").alias("__right_index"), "distance")


@operation("geo.within", "BB")
def within(left: DataFrame, right: DataFrame, output_column: str = "within") -> DataFrame:
    rows, hits = joined(left, right, "within")
    rows = rows.join(hits.select("ln").distinct().withColumn("__hit", F.lit(True)), F.col("__n") == F.col("ln"), "left")
    return rows.select(*[col(c) for c in data(left)], F.when(col(geometry(left)).isNotNull(), F.coalesce("__hit", F.lit(False))).alias(new_name(output_column)))


@operation("geo.count_points_in_polygons", "BB")
def count_points_in_polygons(left: DataFrame, right: DataFrame, output_column: str = "point_count") -> DataFrame:
    rows, hits = joined(left, right, "contains")
    rows = rows.join(hits.groupBy("ln").agg(F.count(F.lit(1)).alias("__count")), F.col("__n") == F.col("ln"), "left")
    return rows.select(*[col(c) for c in data(left)], F.coalesce("__count", F.lit(0)).cast("long").alias(new_name(output_column)))


def aligned(left: DataFrame, right: DataFrame, f: Callable) -> DataFrame:
    """Row n of the left with row n of the right."""
    same(left, right)
    g, h = geometry(planar_only(left)), geometry(right)
    l = placed(left)
    r = placed(right).select(F.col("__n").alias("__m"), col(h).alias("__h"))
    both = l.join(r, F.col("__n") == F.col("__m"))
    out = each(lambda a, b: write_wkb(f(a, b)), "binary", col(g), F.col("__h"))
    return with_geometry(both.withColumn(g, out).select(*[col(c) for c in left.columns]), g, crs(left))


def _boolean(name: str) -> None:
    @operation(f"geo.{name}", "BB")
    def run(left: DataFrame, right: DataFrame) -> DataFrame:
        return aligned(left, right, lambda a, b: planar.combine(name, a, b))


for _name in planar.MODES:
    _boolean(_name)


@operation("geo.clip", "BB")
def clip(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each left row cut by the union of the right geometries that it meets; rows without one become null."""
    g = geometry(left)
    rows, l, r = sides(left, right)
    masks = pairs(l, r, grid((l, "l"), (r, "r"))).groupBy("ln").agg(F.first("lg").alias("lg"), F.collect_list("rg").alias("rgs"))

    def cut(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, ys in zip(a.to_pylist(), b.to_pylist(), strict=True):
            found = planar.overlay([read_wkb(x), *map(read_wkb, ys)], lambda v: v[0] and any(v[1:]))
            out.append(write_wkb(("MultiPolygon", found)) if found else None)
        return pa.array(out, pa.binary())

    cuts = masks.select("ln", F.arrow_udf(cut, T.BinaryType())("lg", "rgs").alias("__cut"))
    rows = rows.join(cuts, F.col("__n") == F.col("ln"), "left")
    return with_geometry(rows.withColumn(g, F.col("__cut")).select(*[col(c) for c in left.columns]), g, crs(left))


@operation("geo.overlay", "BB")
def overlay(left: DataFrame, right: DataFrame, mode: str = "intersection") -> DataFrame:
    """Layers cut by each other: shared parts of each pair, and, as the mode asks, what is left of each side."""
    if mode not in ("intersection", "union", "identity", "symmetric_difference"):
        raise PlanError(f"there is no mode {mode!r}")
    code = crs(left)
    _, l, r = sides(left, right)
    p = pairs(l, r, grid((l, "l"), (r, "r")))
    parts = []
    if mode != "symmetric_difference":
        shared = each(lambda a, b: write_wkb(planar.combine("intersection", a, b)) if planar.combine("intersection", a, b)[1] else None, "binary", F.col("lg"), F.col("rg"))
        parts.append(p.select(shared.alias("geometry"), F.col("ln").alias("__left_index"), F.col("rn").alias("__right_index")).where("geometry IS NOT NULL"))

    def rest(side: DataFrame, n: str, g: str, others: str) -> DataFrame:
        masks = p.groupBy(n).agg(F.collect_list(others).alias("__others"))

        def cut(a: pa.Array, b: pa.Array) -> pa.Array:
            out = []
            for x, ys in zip(a.to_pylist(), b.to_pylist(), strict=True):
                found = planar.overlay([read_wkb(x), *map(read_wkb, ys or [])], lambda v: v[0] and not any(v[1:]))
                out.append(write_wkb(("MultiPolygon", found)) if found else None)
            return pa.array(out, pa.binary())

        both = side.join(masks, n, "left").select(n, F.arrow_udf(cut, T.BinaryType())(g, "__others").alias("geometry")).where("geometry IS NOT NULL")
        nothing = F.lit(None).cast("long")
        return both.select("geometry", *([F.col(n).alias("__left_index"), nothing.alias("__right_index")] if n == "ln" else [nothing.alias("__left_index"), F.col(n).alias("__right_index")]))

    if mode in ("union", "identity", "symmetric_difference"):
        parts.append(rest(l, "ln", "lg", "rg"))
    if mode in ("union", "symmetric_difference"):
        parts.append(rest(r, "rn", "rg", "lg"))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return with_geometry(out, "geometry", code)


# --- whole tables ------------------------------------------------------------------------


def in_order(df: DataFrame) -> DataFrame:
    """All geometries as one sorted array; only for operations whose result is one geometry of them all."""
    g = geometry(df)
    return with_order(df).where(col(g).isNotNull()).agg(F.transform(F.sort_array(F.collect_list(F.struct(ORD, col(g).alias("g")))), lambda s: s["g"]).alias("gs"))


def folded(df: DataFrame, f: Callable[[list[Geometry]], Geometry | None]) -> DataFrame:
    def run(a: pa.Array) -> pa.Array:
        out = [f([read_wkb(x) for x in xs]) for xs in a.to_pylist()]
        return pa.array([None if g is None else write_wkb(g) for g in out], pa.binary())

    return with_geometry(in_order(df).select(F.arrow_udf(run, T.BinaryType())("gs").alias("geometry")), "geometry", crs(df))


@operation("geo.dissolve", "B")
def dissolve(df: DataFrame) -> DataFrame:
    """The union of all polygons: parts are united in tasks first, by place, then their unions."""
    g = geometry(planar_only(df))
    code = crs(df)

    def union(batches):
        from pyspark import TaskContext

        gs = [read_wkb(x) for b in batches for x in b.column(0).to_pylist() if x is not None]
        gs = [x for x in gs if planar.dimension(x) == 2]
        if gs:
            yield pa.RecordBatch.from_pydict({"geometry": pa.array([write_wkb(planar.dissolve(gs))], pa.binary()), "place": pa.array([TaskContext.get().partitionId() // 8], pa.int32())})

    sides = df.select(col(g).alias("g"), each(box, BOX, col(g), fast=columns.box).alias("b")).where("b IS NOT NULL")
    parts = sides.repartitionByRange(F.col("b.minx"), F.col("b.miny")).select("g").mapInArrow(union, "geometry binary, place int")
    many = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while many > 8:  # eight unions of neighbours become one, until a task can take the rest
        many = -(-many // 8)
        parts = parts.repartition(many, "place").select("geometry").mapInArrow(union, "geometry binary, place int")
    one = parts.repartition(1).select("geometry").mapInArrow(union, "geometry binary, place int")
    # an empty input gives one row with null
    return with_geometry(one.agg(F.first("geometry").alias("geometry")), "geometry", code)


@operation("geo.collect", "B")
def collect(df: DataFrame, group_by: list[str] = ()) -> DataFrame:
    g = geometry(df)
    need(df, *group_by)
    code = crs(df)
    gs = F.transform(F.sort_array(F.collect_list(F.when(col(g).isNotNull(), F.struct(ORD, col(g).alias("g"))))), lambda s: s["g"])
    rows = with_order(df).groupBy(*[col(k) for k in group_by]).agg(gs.alias("__gs"))

    def run(a: pa.Array) -> pa.Array:
        out = [codec.gathered([read_wkb(x) for x in xs]) for xs in a.to_pylist()]
        return pa.array([None if x is None else write_wkb(x) for x in out], pa.binary())

    return with_geometry(rows.select(F.arrow_udf(run, T.BinaryType())("__gs").alias(g), *[col(k) for k in group_by]), g, code)


def points_of(gs: list[Geometry]) -> list:
    return [point(g) for g in gs if point(g)]


@operation("geo.line_builder", "B")
def line_builder(df: DataFrame) -> DataFrame:
    return folded(planar_only(df), lambda gs: ("LineString", points_of(gs)) if len(points_of(gs)) > 1 else None)


@operation("geo.polygon_builder", "B")
def polygon_builder(df: DataFrame) -> DataFrame:
    def build(gs: list[Geometry]) -> Geometry | None:
        ps = points_of(gs)
        if len(ps) < 3:
            return None
        g = ("Polygon", [[*ps, *([ps[0]] if ps[0] != ps[-1] else [])]])
        if not planar.valid(g):
            raise GeometryError("the points make no valid ring")
        return g

    return folded(planar_only(df), build)


@operation("geo.line_merge", "B")
def line_merge(df: DataFrame) -> DataFrame:
    def build(gs: list[Geometry]) -> Geometry | None:
        lines = [d for g in gs for k, d in simple(g) if k == "LineString" and len(d) > 1]
        return codec.gathered([("LineString", x) for x in shapes.merged(lines)])

    return folded(planar_only(df), build)


@operation("geo.polygonize", "B")
def polygonize(df: DataFrame, node_input: bool = True, require_complete: bool = False) -> DataFrame:
    code = crs(planar_only(df))

    def run(a: pa.Array) -> pa.Array:
        out = []
        for xs in a.to_pylist():
            lines = [d for x in xs for k, d in simple(read_wkb(x)) if k == "LineString"] + [r for x in xs for k, d in simple(read_wkb(x)) if k == "Polygon" for r in d]
            found = shapes.polygonized(lines, node_input)
            if require_complete and any(found[k] for k in found if k != "polygon"):
                raise GeometryError("lines are left over")
            rows = [{"geometry": write_wkb(("Polygon", p)), "__class": "polygon"} for p in found["polygon"]]
            out.append(rows + [{"geometry": write_wkb(("LineString", list(e))), "__class": k} for k in ("cut_edge", "dangle", "invalid_ring") for e in found[k]])
        return pa.array(out, pa.list_(pa.struct([("geometry", pa.binary()), ("__class", pa.string())])))

    t = T._parse_datatype_string("array<struct<geometry: binary, __class: string>>")
    return with_geometry(in_order(df).select(F.inline(F.arrow_udf(run, t)("gs"))), "geometry", code)


@operation("geo.voronoi", "B")
def voronoi(df: DataFrame, max_points: int = 100_000) -> DataFrame:
    """A cell for each row's point. Cells depend on all points, so their number is bounded by max_points and checked."""
    g, code = geometry(planar_only(df)), crs(df)
    found = df.where(col(g).isNotNull()).select(col(g).alias("g")).distinct().limit(max_points + 1).collect()
    if len(found) > max_points:
        raise PlanError(f"more than {max_points} points")
    cells = {bytes(r.g): None for r in found}
    by_point = shapes.voronoi(points_of([read_wkb(k) for k in cells]))
    sent = df.sparkSession.sparkContext.broadcast(by_point)
    return with_geometry(replaced(df, lambda x: ("Polygon", [sent.value[point(x)]])), g, code)


@operation("geo.clean_topology", "B")
def clean_topology(df: DataFrame, snap_tolerance: float, remove_overlaps: bool = True, fill_gaps: bool = True) -> DataFrame:
    """Gaps up to the tolerance are closed and earlier rows cut later ones; only rows that come near each other meet."""
    g, code = geometry(planar_only(df)), crs(df)
    rows = placed(df)

    def closed(x: Geometry) -> Geometry:
        if fill_gaps and snap_tolerance > 0 and planar.dimension(x) == 2:
            return shapes.buffer(shapes.buffer(x, snap_tolerance, "flat"), -snap_tolerance, "flat")
        return x

    shaped = rows.withColumn(g, each(lambda x: write_wkb(closed(x)), "binary", col(g)))
    if not remove_overlaps:
        return with_geometry(shaped.select(*[col(c) for c in df.columns]), g, code)
    side = lambda p: shaped.select(F.col("__n").alias(p + "n"), col(g).alias(p + "g"), each(box, BOX, col(g), fast=columns.box).alias(p + "b")).where(F.col(p + "b").isNotNull())
    l, r = side("l"), side("r")
    earlier = pairs(l, r, grid((l, "l"))).where("rn < ln").groupBy("ln").agg(F.collect_list("rg").alias("__others"))

    def cut(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, ys in zip(a.to_pylist(), b.to_pylist(), strict=True):
            found = None if x is None else planar.overlay([read_wkb(x), *map(read_wkb, ys or [])], lambda v: v[0] and not any(v[1:]))
            out.append(write_wkb(("MultiPolygon", found)) if found else None)
        return pa.array(out, pa.binary())

    both = shaped.join(earlier, F.col("__n") == F.col("ln"), "left")
    return with_geometry(both.withColumn(g, F.arrow_udf(cut, T.BinaryType())(col(g), "__others")).select(*[col(c) for c in df.columns]), g, code)


def rooted(edges: DataFrame) -> DataFrame:
    """(node, root) by hooking to the smallest neighbour and halving paths; each round is written to the shared folder."""
    labels = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node"))
    both = edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b").distinct()
    both = durable(both)
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("low"))
        hooked = labels.join(near, F.col("node") == F.col("a"), "left").select("node", "root", F.least("root", F.coalesce("low", "root")).alias("new"))
        jump = labels.select(F.col("node").alias("n2"), F.col("root").alias("r2"))
        nxt = durable(hooked.join(jump, F.col("new") == F.col("n2")).select("node", F.col("root").alias("old"), F.col("r2").alias("root")))
        if nxt.where("old <> root").isEmpty():
            return nxt.select("node", "root")
        labels = nxt.select("node", "root")


@operation("geo.cluster_dbscan", "B")
def cluster_dbscan(df: DataFrame, eps: float, min_points: int, output_column: str = "cluster_id") -> DataFrame:
    """Neighbours meet in grid cells; clusters are the components of core points, numbered by their first row."""
    g = geometry(planar_only(df))
    rows = placed(df)
    spots = rows.where(col(g).isNotNull()).select("__n", each(lambda x: dict(zip("xy", point(x), strict=True)), "struct<x: double, y: double>", col(g)).alias("p")).select("__n", "p.x", "p.y")
    cell = lambda c: F.floor(F.col(c) / eps).cast("long")
    a = spots.select(F.col("__n").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), cell("x").alias("cx"), cell("y").alias("cy"))
    b = spots.select(F.col("__n").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), F.explode(F.expr(f"transform(sequence(-1L, 1L), d -> cast(floor(x / {eps}) as long) + d)")).alias("cx"), "y")
    b = b.withColumn("cy", F.explode(F.expr(f"transform(sequence(-1L, 1L), d -> cast(floor(y / {eps}) as long) + d)"))).drop("y")
    close = a.join(b, ["cx", "cy"]).where(F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")) <= eps).select("a", "b")
    core = close.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_points).select(F.col("a").alias("core"))
    edges = close.join(core, F.col("a") == F.col("core"), "left_semi").join(core, F.col("b") == F.col("core"), "left_semi")
    roots = rooted(edges)
    numbers = roots.select("root").distinct()
    ids = numbered(numbers.withColumn(ORD, F.col("root")), "id", 0).select("root", "id")
    own = roots.join(ids, "root").select("node", "id")
    border = close.join(own, F.col("b") == F.col("node")).groupBy("a").agg(F.min("id").alias("id"))
    final = border.join(own.withColumnRenamed("id", "own"), F.col("a") == F.col("node"), "left").select("a", F.coalesce("own", "id").alias("__id"))
    return rows.join(final, F.col("__n") == F.col("a"), "left").select(*[col(c) for c in df.columns], F.col("__id").cast("long").alias(new_name(output_column)))


def neighbours(df: DataFrame) -> DataFrame:
    side = boxed(placed(df), geometry(df), "l")
    other_ = side.select(F.col("ln").alias("rn"), F.col("lg").alias("rg"), F.col("lb").alias("rb"))
    return pairs(side, other_, grid((side, "l"))).where("ln < rn")


@operation("geo.coverage_validate", "B")
def coverage_validate(df: DataFrame, tolerance: float = 0.0, max_issues: int = 1000) -> DataFrame:
    code = crs(planar_only(df))

    def run(a: Geometry, b: Geometry) -> dict | None:
        shared = planar.combine("intersection", a, b)
        size = planar.area(shared)
        return {"area": size, "geometry": write_wkb(shared)} if size > tolerance else None

    found = neighbours(df).withColumn("s", each(run, "struct<area: double, geometry: binary>", F.col("lg"), F.col("rg"))).where("s IS NOT NULL")
    out = found.select(F.lit("overlap").alias("issue_type"), F.col("ln").alias("index_a"), F.col("rn").alias("index_b"), "s.area", "s.geometry")
    total = out.agg(F.count(F.lit(1)).alias("__total"))
    out = out.crossJoin(F.broadcast(total)).where(refuse(F.col("__total") > max_issues, "geometry.too_many_issues", F.lit(True))).drop("__total")
    return with_geometry(out, "geometry", code)


@operation("geo.shared_paths", "B")
def shared_paths(df: DataFrame, tolerance: float = 0.0, min_length: float = 0.0) -> DataFrame:
    code = crs(planar_only(df))

    def run(a: Geometry, b: Geometry) -> dict | None:
        pieces = shapes.shared(a, b)
        size = sum(math.dist(*s) for s in pieces)
        lines = shapes.merged([list(s) for s in pieces])
        return {"shared_length": size, "geometry": write_wkb(("MultiLineString", lines))} if pieces and size > min_length else None

    found = neighbours(df).withColumn("s", each(run, "struct<shared_length: double, geometry: binary>", F.col("lg"), F.col("rg"))).where("s IS NOT NULL")
    return with_geometry(found.select(F.col("ln").alias("index_a"), F.col("rn").alias("index_b"), "s.shared_length", "s.geometry"), "geometry", code)


# --- one to many -------------------------------------------------------------------------


def many(df: DataFrame, f: Callable[[Geometry], list[Geometry]]) -> DataFrame:
    """A row for each geometry of f(g), with the position of its parent; null geometries give none."""
    g, code = geometry(df), crs(df)
    rows = numbered(with_order(df), "__parent_index", 0).where(col(g).isNotNull())
    parts = each(lambda x: [write_wkb(y) for y in f(x)], "array<binary>", col(g))
    out = rows.withColumn("__parts", parts).withColumn(g, F.explode("__parts"))
    return with_geometry(out.select(*[col(c) for c in data(df)], "__parent_index"), g, code)


@operation("geo.explode")
def explode(df: DataFrame) -> DataFrame:
    return many(df, simple)


@operation("geo.delaunay", "B")
def delaunay(df: DataFrame) -> DataFrame:
    return many(planar_only(df), lambda g: [("Polygon", [[*t, t[0]]]) for t in shapes.triangles(codec.coordinates(g))])


@operation("geo.split")
def split(df: DataFrame, other_wkb: str, tolerance: float = 0.0) -> DataFrame:
    h = other(other_wkb)

    def run(g: Geometry) -> list[Geometry]:
        if g[0] == "LineString":
            return [("LineString", x) for x in shapes.split_line(need_line(g), h, tolerance)]
        if g[0] == "Polygon":
            return [("Polygon", x) for x in shapes.split_polygon(g[1], h)]
        raise GeometryError("a LineString or Polygon is needed")

    return many(planar_only(df), run)


@operation("geo.subdivide")
def subdivide(df: DataFrame, max_vertices: int, output_column: str = "part") -> DataFrame:
    if max_vertices < 4:
        raise PlanError("at least four vertices are needed")
    crs(df)
    g = geometry(df)
    out = many(df, lambda x: shapes.subdivide(x, max_vertices))
    w = Window.partitionBy("__parent_index").orderBy(col(g))
    return out.withColumn(new_name(output_column), F.row_number().over(w).cast("long") - 1).drop("__parent_index")


@operation("geo.generate_grid", "B")
def generate_grid(df: DataFrame, extent: dict, cell_size: float, shape: str = "square", crs: str = "EPSG:3857", include_centroid: bool = False) -> DataFrame:
    """Cells of the extent; squares are cut at its edge, hexagons lie inside it. The rows come from range(), not from the driver."""
    x0, y0, x1, y1 = (float(extent[k]) for k in CORNERS)
    if not (x1 > x0 and y1 > y0 and cell_size > 0) or shape not in ("square", "hex", "hexagon"):
        raise PlanError("the extent, the size or the shape is not possible")
    hexed = shape != "square"
    dx, dy = (cell_size * math.sqrt(3), cell_size * 1.5) if hexed else (cell_size, cell_size)
    nx, ny = math.ceil((x1 - x0) / dx - 1e-9) + hexed, math.ceil((y1 - y0) / dy - 1e-9) + hexed
    if nx * ny > 1_000_000:
        raise PlanError("the grid has more than a million cells")
    cells = df.sparkSession.range(nx * ny).select((F.col("id") % nx).alias("cell_i"), F.floor(F.col("id") / nx).alias("cell_j"))

    def make(i: pa.Array, j: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(i.to_pylist(), j.to_pylist(), strict=True):
            if hexed:
                cx, cy = x0 + dx / 2 + a * dx + (dx / 2 if b % 2 else 0), y0 + cell_size + b * dy
                ring = [(cx + cell_size * math.cos(math.pi / 6 + k * math.pi / 3), cy + cell_size * math.sin(math.pi / 6 + k * math.pi / 3)) for k in range(6)]
                ok = all(x0 - 1e-9 <= x <= x1 + 1e-9 and y0 - 1e-9 <= y <= y1 + 1e-9 for x, y in ring)
                out.append(write_wkb(("Polygon", [[*ring, ring[0]]])) if ok else None)
            else:
                u, v = x0 + a * dx, y0 + b * dy
                s, t = min(u + dx, x1), min(v + dy, y1)
                out.append(write_wkb(("Polygon", [[(u, v), (s, v), (s, t), (u, t), (u, v)]])))
        return pa.array(out, pa.binary())

    out = cells.withColumn("geometry", F.arrow_udf(make, T.BinaryType())("cell_i", "cell_j")).where("geometry IS NOT NULL")
    if include_centroid:
        out = out.withColumn("centroid", each(lambda g: write_wkb(("Point", planar.centroid(g))), "binary", F.col("geometry")))
    return with_geometry(out, "geometry", crs)


@operation("geo.from_wkt")
def from_wkt(df: DataFrame, wkt_column: str, output_column: str = "geometry", on_error: str = "reject", crs: str = "EPSG:3857") -> DataFrame:
    need(df, wkt_column)

    def parse(a: pa.Array) -> pa.Array:
        return columns.read_texts(a.to_pylist(), lambda t: write_wkb(codec.read_wkt(t)))

    return with_geometry(df.withColumn(new_name(output_column), F.arrow_udf(parse, T.BinaryType())(col(wkt_column))), output_column, crs)


@operation("geo.from_coords")
def from_coords(df: DataFrame, x_column: str = "x", y_column: str = "y", geometry_column: str = "geometry", crs: str = "EPSG:3857") -> DataFrame:
    """Points from two numeric columns; null in either gives null."""
    for c in (x_column, y_column):
        if not isinstance(kind(df, c), (T.DoubleType, T.LongType, T.IntegerType, T.FloatType)):
            raise PlanError(f"column {c!r} is not a number")
    exact = F.lit(False)
    for c in (x_column, y_column):
        exact |= F.abs(col(c)) > 2**53 if isinstance(kind(df, c), T.LongType) else F.isnan(col(c).cast("double")) | (F.abs(col(c).cast("double")) == float("inf"))

    def make(x: pa.Array, y: pa.Array) -> pa.Array:
        null = np.asarray(x.is_null()) | np.asarray(y.is_null())
        return columns.points(*[a.fill_null(0.0).to_numpy(zero_copy_only=False) for a in (x, y)], null)

    points = F.arrow_udf(make, T.BinaryType())(refuse(exact, "geometry.non_finite_coordinate", col(x_column).cast("double")), col(y_column).cast("double"))
    return with_geometry(df.withColumn(new_name(geometry_column), points), geometry_column, crs)
