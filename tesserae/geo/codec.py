"""Well-known binary and text of two-dimensional geometries."""

from __future__ import annotations

import math
import re
import struct

KINDS = ["Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection"]
PARTS = {"MultiPoint": "Point", "MultiLineString": "LineString", "MultiPolygon": "Polygon"}
MOST_BYTES, MOST_PARTS, MOST_DEPTH = 64 << 20, 100_000, 64

Geometry = tuple


class GeometryError(ValueError):
    """A geometry that can't be read or used."""


def read_wkb(raw: bytes) -> Geometry:
    if len(raw) > MOST_BYTES:
        raise GeometryError("the geometry is too large")
    out, at = _read(raw, 0, 1)
    if at != len(raw):
        raise GeometryError("bytes are left behind the geometry")
    return out


def _read(raw: bytes, at: int, depth: int) -> tuple[Geometry, int]:
    if depth > MOST_DEPTH or at + 5 > len(raw):
        raise GeometryError("the geometry is cut off or nested too deeply")
    order = "<" if raw[at] == 1 else ">"
    (code,) = struct.unpack_from(order + "I", raw, at + 1)
    at += 5
    if not 1 <= code <= 7:
        raise GeometryError("only two-dimensional geometries are supported")
    kind = KINDS[code - 1]

    def number() -> int:
        nonlocal at
        if at + 4 > len(raw):
            raise GeometryError("the geometry is cut off")
        (n,) = struct.unpack_from(order + "I", raw, at)
        at += 4
        return n

    def points(n: int) -> list[tuple[float, float]]:
        nonlocal at
        if at + 16 * n > len(raw):
            raise GeometryError("the geometry is cut off")
        xs = struct.unpack_from(f"{order}{2 * n}d", raw, at)
        at += 16 * n
        return list(zip(xs[::2], xs[1::2], strict=True))

    if kind == "Point":
        (p,) = points(1)
        return (kind, None if math.isnan(p[0]) and math.isnan(p[1]) else finite(p)), at
    if kind == "LineString":
        return (kind, [finite(p) for p in points(number())]), at
    if kind == "Polygon":
        return (kind, [[finite(p) for p in points(number())] for _ in range(number())]), at
    n = number()
    if n > MOST_PARTS:
        raise GeometryError("the geometry has too many parts")
    parts = []
    for _ in range(n):
        g, at = _read(raw, at, depth + 1)
        if kind in PARTS and g[0] != PARTS[kind]:
            raise GeometryError(f"a {kind} has another kind of part")
        parts.append(g if kind == "GeometryCollection" else g[1])
    return (kind, parts), at


def finite(p: tuple[float, float]) -> tuple[float, float]:
    if not (math.isfinite(p[0]) and math.isfinite(p[1])):
        raise GeometryError("a coordinate is not finite")
    return p


def write_wkb(g: Geometry) -> bytes:
    kind, data = g
    head = struct.pack("<BI", 1, KINDS.index(kind) + 1)
    line = lambda ps: struct.pack("<I", len(ps)) + b"".join(struct.pack("<dd", *p) for p in ps)
    if kind == "Point":
        return head + struct.pack("<dd", *(data or (math.nan, math.nan)))
    if kind == "LineString":
        return head + line(data)
    if kind == "Polygon":
        return head + struct.pack("<I", len(data)) + b"".join(map(line, data))
    parts = data if kind == "GeometryCollection" else [(PARTS[kind], d) for d in data]
    return head + struct.pack("<I", len(parts)) + b"".join(map(write_wkb, parts))


def shown(x: float) -> str:
    if x == int(x) and abs(x) < 1e16:
        return str(int(x))
    s = repr(x)
    return f"{x:f}".rstrip("0") if "e" in s and 1e-6 < abs(x) < 1e16 else s


def write_wkt(g: Geometry) -> str:
    kind, data = g
    name = kind.upper()
    point = lambda p: f"{shown(p[0])} {shown(p[1])}"
    line = lambda ps: "(" + ",".join(map(point, ps)) + ")"
    rings = lambda rs: "(" + ",".join(map(line, rs)) + ")"
    if not data:
        return name + " EMPTY"
    if kind == "Point":
        return f"{name}({point(data)})"
    if kind == "LineString":
        return name + line(data)
    if kind == "MultiPoint":
        return name + "(" + ",".join(f"({point(p)})" for p in data) + ")"
    if kind in ("Polygon", "MultiLineString"):
        return name + rings(data)
    if kind == "MultiPolygon":
        return name + "(" + ",".join(map(rings, data)) + ")"
    return name + "(" + ",".join(map(write_wkt, data)) + ")"


WORD = re.compile(r"\s*([A-Za-z]+|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?|[(),])")


def read_wkt(text: str) -> Geometry:
    words, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = WORD.match(text, at)
        if not m:
            raise GeometryError("the text is not a geometry")
        words.append(m[1])
        at = m.end()
    words.append("")
    pos = 0

    def take(want: str | None = None) -> str:
        nonlocal pos
        w = words[pos]
        if want is not None and w.upper() != want or not w:
            raise GeometryError("the text is not a geometry")
        pos += 1
        return w

    def point() -> tuple[float, float]:
        p = []
        for _ in range(2):
            try:
                p.append(float(take()))
            except ValueError:
                raise GeometryError("a number is expected") from None
        return finite((p[0], p[1]))

    def listed(item) -> list:
        take("(")
        out = [item()]
        while words[pos] == ",":
            take(",")
            out.append(item())
        take(")")
        return out

    def bracketed() -> tuple[float, float]:
        if words[pos] != "(":
            return point()
        take("(")
        p = point()
        take(")")
        return p

    def geometry(depth: int) -> Geometry:
        name = take().upper()
        kind = next((k for k in KINDS if k.upper() == name), None)
        if kind is None or depth > MOST_DEPTH:
            raise GeometryError("the text is not a geometry")
        if words[pos].upper() == "EMPTY":
            take()
            return kind, None if kind == "Point" else []
        line = lambda: listed(point)
        rings = lambda: listed(line)
        if kind == "Point":
            return kind, listed(point)[0]
        return kind, listed({"LineString": point, "MultiPoint": bracketed, "Polygon": line, "MultiLineString": line, "MultiPolygon": rings, "GeometryCollection": lambda: geometry(depth + 1)}[kind])

    out = geometry(1)
    if words[pos]:
        raise GeometryError("something is left behind the geometry")
    check(out)
    return out


def check(g: Geometry) -> None:
    """Rings are closed and have four points, lines two."""
    for kind, data in simple(g):
        if kind == "LineString" and len(data) == 1:
            raise GeometryError("a line has at least two points")
        if kind == "Polygon":
            for ring in data:
                if len(ring) < 4 or ring[0] != ring[-1]:
                    raise GeometryError("a ring is closed and has at least four points")


def simple(g: Geometry) -> list[Geometry]:
    """The parts of a geometry that are not collections."""
    kind, data = g
    if kind in PARTS:
        return [(PARTS[kind], d) for d in data]
    if kind == "GeometryCollection":
        return [s for p in data for s in simple(p)]
    return [g] if data else []


def coordinates(g: Geometry) -> list[tuple[float, float]]:
    out = []
    for kind, data in simple(g):
        out += [data] if kind == "Point" else data if kind == "LineString" else [p for r in data for p in r]
    return out


def mapped(g: Geometry, f) -> Geometry:
    """g with each coordinate pair replaced by f(x, y)."""
    kind, data = g
    line = lambda ps: [f(*p) for p in ps]
    if not data:
        return g
    if kind == "Point":
        return kind, f(*data)
    if kind in ("LineString", "MultiPoint"):
        return kind, line(data)
    if kind in ("Polygon", "MultiLineString"):
        return kind, [line(r) for r in data]
    if kind == "MultiPolygon":
        return kind, [[line(r) for r in p] for p in data]
    return kind, [mapped(p, f) for p in data]


def gathered(parts: list[Geometry]) -> Geometry | None:
    """One geometry of several: the single one, a Multi of one kind, or a collection."""
    if not parts:
        return None
    if len(parts) == 1:
        return parts[0]
    kinds = {k for k, _ in parts}
    if len(kinds) == 1 and (kind := kinds.pop()) in PARTS.values():
        return "Multi" + kind, [d for _, d in parts]
    return "GeometryCollection", parts
