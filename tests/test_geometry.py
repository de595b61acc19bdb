"""Geometry on literals: encodings, relations, overlays and the operations' errors."""

import math
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesserae.geo import codec, columns, planar, shapes
from tesserae.operators import apply, geo
from tesserae.operators.geo import PREDICATES, with_geometry
from tesserae.relation import PlanError, with_order


def square(x, y, s):
    return "Polygon", [[(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]]


TEXTS = ["POINT(1 2)", "POINT EMPTY", "LINESTRING(0 0,1.5 -2)", "POLYGON((0 0,4 0,4 4,0 4,0 0),(1 1,1 2,2 2,2 1,1 1))", "MULTIPOINT((0 0),(1 1))", "MULTILINESTRING((0 0,1 1),(2 2,3 3))", "MULTIPOLYGON(((0 0,1 0,1 1,0 0)))", "GEOMETRYCOLLECTION(POINT(1 2),LINESTRING(0 0,1 1))"]


@pytest.mark.parametrize("text", TEXTS)
def test_encodings_round_trip(text):
    g = codec.read_wkt(text)
    assert codec.write_wkt(codec.read_wkb(codec.write_wkb(g))) == text


@pytest.mark.parametrize("text", ["POINT(1)", "POINT(1 2 3)", "POLYGON((0 0,1 1,0 0))", "LINESTRING(0 0)", "CIRCLE(1 2)", "POINT(1 2) x", "POINT(nan 1)", ""])
def test_bad_texts_are_refused(text):
    with pytest.raises(codec.GeometryError):
        codec.read_wkt(text)
    for cut in (b"", b"\x01", codec.write_wkb(("Point", (1.0, 2.0)))[:-1]):
        with pytest.raises(codec.GeometryError):
            codec.read_wkb(cut)


def test_relations():
    a = square(0, 0, 2)
    assert planar.relate(a, square(1, 1, 2)) == "212101212" and planar.relate(a, square(2, 0, 2)) == "FF2F11212"
    assert planar.predicate("crosses", ("LineString", [(0, 0), (2, 2)]), ("LineString", [(0, 2), (2, 0)]))
    assert planar.predicate("equals_topo", a, ("Polygon", [[(2, 2), (0, 2), (0, 0), (1, 0), (2, 0), (2, 2)]]))
    assert planar.predicate("contains_properly", square(0, 0, 9), a) is False and planar.predicate("covers", square(0, 0, 9), a)
    hole = planar.combine("difference", square(0, 0, 4), square(1, 1, 1))
    assert planar.predicate("disjoint", hole, ("Point", (1.5, 1.5))) and planar.predicate("touches", hole, square(1, 1, 1))


def test_overlays_have_the_right_areas():
    for dx in (0, 0.3, 1, 1.7, 2, 5):
        a, b = square(0, 0, 2), square(dx, dx / 2, 2)
        both = max(0, 2 - dx) * max(0, 2 - dx / 2)
        for mode, want in (("intersection", both), ("union", 8 - both), ("difference", 4 - both), ("symmetric_difference", 8 - 2 * both)):
            assert math.isclose(planar.area(planar.combine(mode, a, b)), want, abs_tol=1e-9), (mode, dx)
    ring = shapes.buffer(("Point", (0, 0)), 1)
    assert 3.1 < planar.area(ring) < math.pi
    assert planar.area(planar.dissolve([square(k, 0, 1) for k in range(7)])) == pytest.approx(7)


def test_repair_and_validity():
    bow = "Polygon", [[(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)]]
    assert not planar.valid(bow) and planar.valid(planar.repaired(bow)) and planar.area(planar.repaired(bow)) == pytest.approx(2)
    assert planar.repaired(square(0, 0, 1)) == square(0, 0, 1)


def test_earth():
    assert shapes.inverse((0, 0), (0, 1))[0] == pytest.approx(110574.3886, abs=1e-3)
    assert shapes.geodesic_area(square(0, 0, 1)) == pytest.approx(12308778361.5, rel=1e-6)
    for code in ("EPSG:3857", "EPSG:32633"):
        p = shapes.reproject(shapes.reproject(("Point", (12.5, 41.9)), "EPSG:4326", code), code, "EPSG:4326")
        assert p[1] == pytest.approx((12.5, 41.9), abs=1e-7)


def test_lines():
    assert shapes.substring([(0, 0), (10, 0)], 0.2, 0.5) == ("LineString", [(2, 0), (5, 0)])
    assert planar.frechet([(0, 0), (1, 0)], [(0, 2), (1, 2)]) == 2
    assert len(shapes.split_line([(0, 0), (2, 0)], ("Point", (1, 0)), 0)) == 2
    assert shapes.simplify(("LineString", [(0, 0), (1, 0.1), (2, 0)]), 0.5)[1] == [(0, 0), (2, 0)]
    assert shapes.simplify(("LineString", [(0, 0), (1, 0.1), (2, 0)]), 0.5, "visvalingam_preserve")[1] == [(0, 0), (2, 0)]


def table(spark, texts, crs="EPSG:3857"):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, wkt string")
    return apply("geo.from_wkt", with_order(df, "id"), wkt_column="wkt", crs=crs).drop("wkt")


def test_nulls_and_errors(spark):
    df = table(spark, ["POINT(1 1)", None, "POINT(5 5)"])
    assert [r.area for r in apply("geo.area", df).orderBy("id").collect()] == [0.0, None, 0.0]
    with pytest.raises(Exception):
        table(spark, ["POINT(1"]).collect()
    with pytest.raises(PlanError):
        apply("geo.area", table(spark, ["POINT(1 1)"], "EPSG:4326"))
    with pytest.raises(PlanError):
        apply("geo.haversine_distance", df, other_wkb=codec.write_wkb(("Point", (0.0, 0.0))).hex())
    with pytest.raises(PlanError):
        apply("geo.area", spark.range(1))
    with pytest.raises(PlanError):
        apply("geo.sjoin", df, with_geometry(df, "geometry", "EPSG:32633"))
    boxes = table(spark, ["POLYGON((0 0,2 0,2 2,0 2,0 0))", None])
    assert [(r.id, r['__right_index']) for r in apply("geo.sjoin", df, boxes).collect()] == [(0, 0)]
    assert sorted((r.id, r.distance) for r in apply("geo.nearest", df, boxes).collect()) == [(0, 0.0), (2, math.sqrt(18))]
    assert [r.within for r in apply("geo.within", df, boxes).orderBy("id").collect()] == [True, None, False]
    assert apply("geo.sjoin", df, boxes.limit(0)).count() == 0


def test_clusters_and_parts(spark):
    spots = table(spark, ["POINT(0 0)", "POINT(0 1)", "POINT(1 0)", "POINT(50 50)", "POINT(9 9)", "POINT(9 10)", "POINT(10 9)", None])
    out = [r.cluster_id for r in apply("geo.cluster_dbscan", spots, eps=1.5, min_points=3).orderBy("id").collect()]
    assert out == [0, 0, 0, None, 1, 1, 1, None]
    parts = apply("geo.explode", table(spark, ["MULTIPOINT((0 0),(1 1))", None, "POINT(2 2)"]))
    assert sorted((r.id, r['__parent_index']) for r in parts.collect()) == [(0, 0), (0, 0), (2, 2)]
    hexes = apply("geo.generate_grid", spark.range(1), extent={"minx": 0, "miny": 0, "maxx": 20, "maxy": 20}, cell_size=2, shape="hex")
    areas = apply("geo.area", hexes).agg(F.min("area"), F.max("area")).first()
    assert areas[0] == pytest.approx(areas[1]) == pytest.approx(6 * math.sqrt(3))


def shapes_of_all_kinds(seed, n):
    r = random.Random(seed)
    at = lambda: (round(r.uniform(-9, 9), r.randrange(4)), round(r.uniform(-9, 9), r.randrange(4)))
    line = lambda least=2: [at() for _ in range(r.randrange(least, 9))]
    ring = lambda: (lambda ps: [*ps, ps[0]])(line(3))
    rings = lambda: [ring() for _ in range(r.randrange(1, 4))]
    some = lambda f: [f() for _ in range(r.randrange(1, 4))]
    make = [lambda: ("Point", at()), lambda: ("LineString", line()), lambda: ("Polygon", rings()), lambda: ("MultiPoint", some(at)), lambda: ("MultiLineString", some(line)), lambda: ("MultiPolygon", some(rings)), lambda: ("Polygon", [[(1.0, 1.0), (2.0, 1.0), (1.0, 1.0), (1.0, 1.0)]]), lambda: ("LineString", [(2.0, 3.0), (2.0, 3.0)])]
    return [r.choice(make)() if r.random() < 0.9 else None for _ in range(n)]


def test_batches_agree_with_rows():
    for seed in range(30):
        gs = shapes_of_all_kinds(seed, 40)
        c = columns.decode(pa.array([b"pad", *[g and codec.write_wkb(g) for g in gs]], pa.binary())[1:])
        rows = lambda f: [None if g is None else f(g) for g in gs]
        close = lambda got, want: all((a is None) == (b is None) and (a is None or a == pytest.approx(b, abs=1e-9)) for a, b in zip(got, want, strict=True))
        read = lambda a: [x and codec.read_wkb(x) for x in a.to_pylist()]
        assert columns.vertex_count(c).to_pylist() == rows(lambda g: len(codec.coordinates(g)))
        assert close(columns.area(c).to_pylist(), rows(planar.area)) and close(columns.length(c).to_pylist(), rows(planar.length))
        assert [x and tuple(x.values()) for x in columns.box(c).to_pylist()] == rows(planar.bounds)
        assert close([g and g[1] for g in read(columns.centroid(c))], rows(planar.centroid))
        turn = lambda x, y: (2 * x - y, x + 3)
        assert read(columns.moved(c, turn)) == rows(lambda g: codec.mapped(g, turn))
        for tolerance in (0.0, 1.0, 50.0):
            assert read(columns.simplified(c, tolerance)) == rows(lambda g: shapes.simplify(g, tolerance))
        out, left = columns.convex_hull(c)
        assert [g for g, k in zip(read(out), left, strict=True) if not k] == [g and ("Polygon", [planar.hull(codec.coordinates(g))]) for g, k in zip(gs, left, strict=True) if not k]
        simple = [g if g and g[0] in ("Point", "LineString", "Polygon") else None for g in gs]
        lines = [g if g and g[0] == "LineString" else None for g in gs]
        at = lambda some: columns.decode(pa.array([g and codec.write_wkb(g) for g in some], pa.binary()))
        assert all((a is None) == (b is None) and (a is None or np.allclose(codec.coordinates(a), codec.coordinates(b), atol=1e-12)) for a, b in zip(read(columns.densified(at(simple), 1.5)), [g and shapes.densify(g, 1.5) for g in simple], strict=True))
        for ratio in (0.0, 0.3, 1.0):
            assert close([g and g[1] for g in read(columns.along(at(lines), ratio))], [g and shapes.along(g[1], ratio) for g in lines])
        plain = [g if g and g[0] not in ("MultiPolygon", "Polygon") else None for g in gs] + [square(0, 0, 4), square(3, 3, 1)]
        assert close(columns.distance_to_point(at(plain), 1.0, 2.0).to_pylist(), [g and planar.distance(g, ("Point", (1.0, 2.0))) for g in plain])
        earth = lambda some: [-1 if v is None else v for v in some]
        assert np.allclose(earth(columns.geodesic_length(c, shapes.WIDTH, shapes.FLAT).to_pylist()), earth(rows(shapes.geodesic_length)), atol=1e-4)
        tall = [g for g in gs if g is not None and len(set(x for x, _ in codec.coordinates(g))) > 1 and len(set(y for _, y in codec.coordinates(g))) > 1]
        assert read(columns.envelope(columns.decode(pa.array([codec.write_wkb(g) for g in tall], pa.binary())))) == [planar.envelope(g) for g in tall]


def test_geodesics_by_batches():
    r = random.Random(12)
    p, q = ([(r.uniform(-180, 180), r.uniform(-90, 90)) for _ in range(300)] for _ in range(2))
    p[:3], q[:3] = [(0.0, 0.0), (10.0, 90.0), (5.0, 5.0)], [(0.0, 0.0), (20.0, 90.0), (5.0, -5.0)]
    x, y, u, v = (np.array([z[k] for z in some]) for some in (p, q) for k in (0, 1))
    d, b, left = columns.inverse(x, y, u, v, shapes.WIDTH, shapes.FLAT)
    want = [shapes.inverse(s, t) for s, t in zip(p, q, strict=True)]
    assert left.mean() < 0.05
    for k in np.flatnonzero(~left):
        assert d[k] == pytest.approx(want[k][0], abs=1e-4) and (b[k] - want[k][1] + 180) % 360 - 180 == pytest.approx(0, abs=1e-6)
    assert columns.haversine(x, y, u, v, shapes.RADIUS) == pytest.approx([shapes.haversine(s, t) for s, t in zip(p, q, strict=True)])


def test_texts_by_batches():
    for seed in range(20):
        gs = shapes_of_all_kinds(seed + 100, 40)
        raw = [g and codec.write_wkb(g) for g in gs]
        texts = [g and codec.write_wkt(g) for g in gs]
        c = columns.decode(pa.array(raw, pa.binary()))
        assert columns.write_texts(c, codec.shown, codec.KINDS).to_pylist() == texts
        good = [t and t.replace(",", " , ").replace("POINT", "point ") for t in texts]
        for some in (texts, good):
            got = columns.read_texts(some, lambda t: codec.write_wkb(codec.read_wkt(t))).to_pylist()
            assert got == [t and codec.write_wkb(codec.read_wkt(t)) for t in texts]
    one = lambda t: codec.write_wkb(codec.read_wkt(t))
    assert columns.read_texts([*TEXTS, None], one).to_pylist() == [*map(one, TEXTS), None] and columns.read_texts([], one).to_pylist() == []
    for bad in ("POLYGON((0 0,1 1,0 0))", "POLYGON((0 0,1 0,1 1,0 1))", "LINESTRING(0 0)", "POINT(1e999 0)", "POINT(1 2) x", "POLYGON((0 0,1 0,1 1,0 0)"):
        with pytest.raises(codec.GeometryError):
            columns.read_texts(["POINT(1 2)", bad], one)


def test_unusual_batches_are_left_to_rows():
    good = codec.write_wkb(("LineString", [(0.0, 0.0), (1.0, 1.0)]))
    big = b"\x00" + struct.pack(">Idd", 1, 1.0, 2.0)
    for bad in (good[:-1], good + b"x", b"", big, codec.write_wkb(("GeometryCollection", [("Point", (0.0, 0.0))])), codec.write_wkb(("Point", (math.inf, 0.0))), struct.pack("<BII", 1, 2, 1 << 31), struct.pack("<BII", 1, 6, 1) + good):
        assert columns.decode(pa.array([good, bad], pa.binary())) is None
    c = columns.decode(pa.array([codec.write_wkb(("Point", None)), codec.write_wkb(("MultiPolygon", [])), None], pa.binary()))
    assert columns.vertex_count(c).to_pylist() == [0, 0, None] and columns.area(c).to_pylist() == [0, 0, None] and columns.box(c).to_pylist() == [None] * 3
    with pytest.raises(codec.GeometryError):
        columns.centroid(c)
    none = columns.decode(pa.array([None], pa.binary()))
    assert columns.centroid(none).to_pylist() == columns.convex_hull(none)[0].to_pylist() == columns.simplified(none, 1).to_pylist() == [None]


def test_points_and_polygons_by_batches():
    r = random.Random(2)
    polygons = [square(0, 0, 4), ("Polygon", [square(0, 0, 6)[1][0], square(1, 1, 2)[1][0]]), ("MultiPolygon", [square(0, 0, 2)[1], square(3, 3, 2)[1]]), ("Polygon", [[(0, 0), (5, 1), (2, 5), (0, 0)]])]
    rows = [(("Point", (float(r.randrange(-1, 8)), float(r.randrange(-1, 8)))), r.choice(polygons)) for _ in range(400)] + [(("Point", (2.5, 0.5)), polygons[3])]
    a, b = (columns.decode(pa.array([codec.write_wkb(x[k]) for x in rows], pa.binary())) for k in (0, 1))
    for name in PREDICATES:
        assert columns.related(name, a, b).to_pylist() == [planar.predicate(name, p, g) for p, g in rows]
        assert columns.related(name, b, a).to_pylist() == [planar.predicate(name, g, p) for p, g in rows]


def test_spatial_joins_with_one_huge_box_behind_a_shuffle(spark):
    r = random.Random(6)
    small = [(k, round(r.uniform(0, 50), 3), round(r.uniform(0, 50), 3), 0.4) for k in range(300)] + [(300, -50_000.0, -50_000.0, 100_000.0), (301, 20.0, 20.0, 9.0)]
    text = "concat('POLYGON((', x, ' ', y, ',', x + s, ' ', y, ',', x + s, ' ', y + s, ',', x, ' ', y + s, ',', x, ' ', y, '))')"
    rows = spark.createDataFrame(small, "id long, x double, y double, s double")
    shuffled = rows.repartition(3, "id").groupBy("id", "x", "y", "s").count().drop("count")
    boxes = apply("geo.from_wkt", shuffled.withColumn("wkt", F.expr(text)), wkt_column="wkt")
    named = apply("geo.from_wkt", rows.withColumn("wkt", F.expr(text)), wkt_column="wkt")
    got = apply("geo.sjoin", boxes, named)
    names = [x[0] for x in small]  # rows of the right side stand in this order
    pairs = {(x.id, names[x["__right_index"]]) for x in got.select("id", "__right_index").collect()}
    meets = lambda a, b: a[1] <= b[1] + b[3] and b[1] <= a[1] + a[3] and a[2] <= b[2] + b[3] and b[2] <= a[2] + a[3]
    assert pairs == {(a[0], b[0]) for a in small for b in small if meets(a, b)}


AREAS = ["POLYGON((5 -1,9 -1,9 1,5 1,5 -1))", "POLYGON((0 0,6 0,6 6,0 6,0 0),(1 1,1 3,3 3,3 1,1 1),(4 4,4 5,5 5,5 4,4 4))", "MULTIPOLYGON(((0 0,2 0,2 2,0 2,0 0)),((2 2,4 2,4 4,2 4,2 2)),((5 0,7 0.5,6 3,5 0)))"]


@pytest.mark.parametrize("text", AREAS)
def test_lines_against_an_area_as_planar_relates_them(text):
    h, r = codec.read_wkt(text), random.Random(text)
    place = lambda: (r.choice([r.randint(-1, 8), r.randint(-2, 16) / 2, r.uniform(-1, 8)]), r.choice([r.randint(-1, 7), r.randint(-2, 14) / 2, r.uniform(-1, 7)]))
    lines = [("LineString", [place() for _ in range(r.choice([2, 2, 3, 5]))]) for _ in range(400)]
    ring = h[1][0] if h[0] == "Polygon" else h[1][0][0]
    lines += [("LineString", [(0.0, 0.0), (float(k), 0.0)]) for k in range(1, 12)] + [("LineString", ring), ("LineString", ring[:3]), ("LineString", [(1.0, 1.0), (1.0, 1.0)]), ("LineString", [(50.0, 50.0), (51.0, 50.0)])]
    lines += [("LineString", [(a[0] + d, a[1]), (b[0], b[1] - d)]) for a in ring for b in ring for d in (1e-9, 1e-11, 1e-13) if a != b]
    c = columns.decode(pa.array([codec.write_wkb(g) for g in lines], pa.binary()))
    for name in PREDICATES:
        found, left = columns.lines_to_area(name, c, columns.Area([d for _, d in codec.simple(h)]))
        want = [planar.predicate(name, g, h) for g in lines]
        assert [k for k in range(len(lines)) if found[k] != want[k] and not left[k]] == [], name
    assert left.mean() < 0.2


def test_predicates_of_lines_take_the_batch(spark):
    texts = [f"LINESTRING(0 0,{k + 1} 0)" for k in range(40)] + ["LINESTRING(0 0,3 0,3 9)"]
    h = codec.read_wkt(AREAS[0])
    c = columns.decode(pa.array([codec.write_wkb(codec.read_wkt(t)) for t in texts], pa.binary()))
    found, left = columns.lines_to_area("crosses", c, columns.Area([h[1]]))
    assert not left.any() and found.tolist() == [k + 1 > 5 for k in range(40)] + [False]
    # lengths of nothing and near misses go to planar
    texts += [None, "LINESTRING(6 0,6 0)", "LINESTRING(5 -1,5.00000000001 1)"]
    df = apply("geo.from_wkt", spark.createDataFrame(list(enumerate(texts)), "id long, wkt string"), wkt_column="wkt")
    for name in ("crosses", "touches", "covered_by"):
        p = apply(f"geo.predicate_{name}", df, other_wkb=codec.write_wkb(h).hex(), output_column="p")
        assert [r.p for r in p.orderBy("id").collect()] == [None if t is None else planar.predicate(name, codec.read_wkt(t), h) for t in texts]


def test_distances_of_a_batch_are_those_of_planar():
    r = random.Random(6)
    place = lambda: (float(r.randint(-3, 9)), r.choice([float(r.randint(-3, 9)), r.uniform(-3, 9)]))
    hs = [codec.read_wkt(t) for t in (*AREAS, "LINESTRING(0 0,3 3,3 9)", "POINT(3 3)", "MULTIPOINT((0 0),(5 5))", "MULTILINESTRING((0 0,1 1),(2 2,3 3))")]
    pairs_ = [(("Point", place()), r.choice(hs)) for _ in range(2_000)] + [(("Point", (5 - 1e-13, 0.0)), hs[0]), (("Point", (3.0, 3.0 + 1e-14)), hs[3])]
    g, h = (columns.decode(pa.array([None, *map(codec.write_wkb, x)], pa.binary())) for x in zip(*pairs_, strict=True))
    want = [planar.distance(*p) for p in pairs_]
    for one, two in ((g, h), (h, g)):
        got = geo.distances(one, two).to_pylist()
        assert got[0] is None and got[1:] == pytest.approx(want, rel=1e-14, abs=0)
        assert [x == 0 for x in got[1:]] == [x == 0 for x in want]
    assert columns.distance(h, h) is None


@pytest.mark.parametrize("far", [100.0, 20.0, None])
def test_nearest_of_many_takes_as_few_rounds_as_of_few(spark, monkeypatch, far):
    rounds, own = [], geo.pairs
    monkeypatch.setattr(geo, "pairs", lambda *a: rounds.append(a[-1]) or own(*a))
    r = random.Random(3)
    points_ = [(r.uniform(0, 1), r.uniform(0, 1)) for _ in range(1_500)] + [(25.0, 5.0), (90.0, 5.0), (170.0, 3.0), (500.0, 0.0)]
    boxes = [square(x, y, 10) for x, y in ((10, 0), (30, 0), (30, 20), (100, 0))]
    frames = [with_geometry(spark.createDataFrame([(k, codec.write_wkb(g)) for k, g in enumerate(gs)], "id long, geometry binary")) for gs in ([("Point", p) for p in points_], boxes)]
    got = sorted((x.id, x.b, x.distance) for x in apply("geo.nearest", *frames, **({"max_distance": far} if far else {})).selectExpr("id", "__right_index as b", "distance").collect())
    want = []
    for k, p in enumerate(points_):
        d = [planar.distance(("Point", p), b) for b in boxes]
        want += [(k, n, x) for n, x in enumerate(d) if x == min(d) and x <= (far or 1e9)]
    assert [x[:2] for x in got] == [x[:2] for x in want] and [x[2] for x in got] == pytest.approx([x[2] for x in want])
    assert len(rounds) <= {100.0: 3, 20.0: 2}.get(far, 5)
