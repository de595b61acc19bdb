"""A batch of well-known binary as flat arrays, and the operations that work on all of it at once.

decode() finds every ring of every geometry by stepping through all rows together: once for
each part and ring number, not for each row. Coordinates are gathered through views of the
buffer at the eight alignments a double can have. Batches that hold anything unusual (other
byte orders, collections, damaged or not finite values, very many parts) give None, and the
caller goes through the rows, which also names what is wrong.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .codec import GeometryError

POINT, LINE, SHELL, HOLE = range(4)
MOST_STEPS = 256
WIDE = 64


def u4(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    return buf[at].astype(np.int64) | buf[at + 1].astype(np.int64) << 8 | buf[at + 2].astype(np.int64) << 16 | buf[at + 3].astype(np.int64) << 24


def put_u4(buf: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
    for k in range(4):
        buf[at + k] = (value >> 8 * k) & 255


def doubles(buf: np.ndarray, shift: int) -> np.ndarray:
    return buf[shift : shift + (len(buf) - shift) // 8 * 8].view("<f8")


@dataclass
class Columns:
    """offsets bound the rows of buf; a ring is a point, a line or a ring of a polygon; x and y have all coordinates, ring by ring."""

    buf: np.ndarray
    offsets: np.ndarray
    null: np.ndarray
    kind: np.ndarray
    row: np.ndarray
    type: np.ndarray
    size: np.ndarray
    at: np.ndarray
    x: np.ndarray
    y: np.ndarray
    ring: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.null)

    def coordinate_rows(self) -> np.ndarray:
        return self.row[self.ring]

    def places(self) -> np.ndarray:
        """Byte positions of the coordinates."""
        first = np.cumsum(self.size) - self.size
        return self.at[self.ring] + 16 * (np.arange(len(self.ring)) - first[self.ring])

    def steps(self) -> np.ndarray:
        """Coordinates that are followed by another one of their ring."""
        return np.flatnonzero(self.ring[1:] == self.ring[:-1]) if len(self.ring) else np.zeros(0, np.int64)


def decode(a: pa.Array) -> Columns | None:
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    if a.type != pa.binary():
        return None
    n = len(a)
    null = np.zeros(n, bool) if not a.null_count else np.asarray(a.is_null())
    _, offsets, data = a.buffers()
    offsets = np.frombuffer(offsets, np.int32)[a.offset : a.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    buf = whole[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    there = np.flatnonzero(~null)
    start, end = offsets[there], offsets[there + 1]
    if len(there) and (end - start < 9).any():
        return None
    rings: list[tuple[np.ndarray, int, np.ndarray, np.ndarray]] = []
    kind = np.zeros(n, np.int8)

    class Unusual(Exception):
        pass

    def head(at: np.ndarray, stop: np.ndarray) -> np.ndarray:
        if len(at) and ((at + 9 > stop).any() or (buf[at] != 1).any()):
            raise Unusual
        return u4(buf, at + 1)

    def count(at: np.ndarray, stop: np.ndarray) -> np.ndarray:
        if len(at) and (at + 4 > stop).any():
            raise Unusual
        return u4(buf, at)

    def single(code: int, own: np.ndarray, at: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Takes one simple geometry of each row, from behind its head; where it ends."""
        if code == 1:
            if (at + 16 > stop).any():
                raise Unusual
            rings.append((own, POINT, np.ones(len(own), np.int64), at))
            return at + 16
        many = count(at, stop)
        if code == 2:
            if (at + 4 + 16 * many > stop).any():
                raise Unusual
            rings.append((own, LINE, many, at + 4))
            return at + 4 + 16 * many
        at = at + 4
        most = int(many.max(initial=0))
        if most > MOST_STEPS:
            raise Unusual
        for k in range(most):
            on = np.flatnonzero(many > k)
            size = count(at[on], stop[on])
            if (at[on] + 4 + 16 * size > stop[on]).any():
                raise Unusual
            rings.append((own[on], SHELL if k == 0 else HOLE, size, at[on] + 4))
            at[on] += 4 + 16 * size
        return at

    try:
        codes = head(start, end)
        kind[there] = np.where(codes < 8, codes, 0)
        if ((codes < 1) | (codes > 6)).any():
            return None
        for code in range(1, 7):
            mine = np.flatnonzero(codes == code)
            if not len(mine):
                continue
            at, stop, own = start[mine] + 5, end[mine], there[mine]
            if code <= 3:
                at = single(code, own, at, stop)
            else:
                many = count(at, stop)
                at = at + 4
                most = int(many.max(initial=0))
                if most > MOST_STEPS:
                    return None
                for k in range(most):
                    on = np.flatnonzero(many > k)
                    if (head(at[on], stop[on]) != code - 3).any():
                        return None
                    at[on] = single(code - 3, own[on], at[on] + 5, stop[on])
            if (at != stop).any():
                return None
    except Unusual:
        return None
    row = np.concatenate([r[0] for r in rings]) if rings else np.zeros(0, np.int64)
    order = np.argsort(row, kind="stable")
    row = row[order]
    type_ = np.concatenate([np.full(len(r[0]), r[1], np.int8) for r in rings])[order] if rings else np.zeros(0, np.int8)
    size = np.concatenate([r[2] for r in rings])[order] if rings else row
    at = np.concatenate([r[3] for r in rings])[order] if rings else row
    out = Columns(buf, offsets, null, kind, row, type_, size, at, np.zeros(0), np.zeros(0), np.repeat(np.arange(len(row)), size))
    where = out.places()
    xy = np.empty((2, len(where)))
    for shift in range(8):
        on = np.flatnonzero(where % 8 == shift)
        if len(on):
            view, k = doubles(buf, shift), (where[on] - shift) // 8
            xy[0, on], xy[1, on] = view[k], view[k + 1]
    out.x, out.y = xy
    if not np.isfinite(xy).all():
        # an empty point is a pair that is not a number
        empty = np.isnan(xy).all(axis=0) & (type_ == POINT)[out.ring]
        if not (np.isfinite(xy).all(axis=0) | empty).all() or (kind[row[out.ring[empty]]] != 1).any():
            return None
        out.size = size.copy()
        out.size[out.ring[empty]] = 0
        out.x, out.y, out.ring = out.x[~empty], out.y[~empty], out.ring[~empty]
    return out


def masked(values: np.ndarray, null: np.ndarray) -> pa.Array:
    return pa.array(values, mask=null) if null.any() else pa.array(values)


def binary(data: np.ndarray, offsets: np.ndarray, null: np.ndarray) -> pa.Array:
    """A column of binary whose rows are cut out of data by offsets."""
    valid = pa.py_buffer(np.packbits(~null, bitorder="little").tobytes()) if null.any() else None
    return pa.Array.from_buffers(pa.binary(), len(null), [valid, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def fixed(records: np.ndarray, null: np.ndarray) -> pa.Array:
    """A column of binary from a record for each row; null rows take no bytes."""
    sizes = np.where(null, 0, records.itemsize)
    return binary(records[~null].view(np.uint8) if len(records) else np.zeros(0, np.uint8), np.concatenate([[0], np.cumsum(sizes)]), null)


def points(x: np.ndarray, y: np.ndarray, null: np.ndarray) -> pa.Array:
    out = np.zeros(len(x), np.dtype([("o", "u1"), ("t", "<u4"), ("x", "<f8"), ("y", "<f8")]))
    out["o"], out["t"], out["x"], out["y"] = 1, 1, x, y
    return fixed(out, null)


def add_up(c: Columns, ring_values: np.ndarray) -> np.ndarray:
    return np.bincount(c.row, weights=ring_values, minlength=c.rows)


def vertex_count(c: Columns) -> pa.Array:
    return masked(add_up(c, c.size).astype(np.int64), c.null)


def run_lengths(c: Columns) -> np.ndarray:
    k = c.steps()
    return np.bincount(c.ring[k], weights=np.hypot(c.x[k + 1] - c.x[k], c.y[k + 1] - c.y[k]), minlength=len(c.row))


def signed(c: Columns) -> np.ndarray:
    """Signed areas of all rings, of points and lines as if they were closed ones."""
    k = c.steps()
    first = np.minimum(np.cumsum(c.size) - c.size, max(0, len(c.x) - 1))[c.ring[k]]
    x0, y0 = c.x[first], c.y[first]
    return np.bincount(c.ring[k], weights=(c.x[k] - x0) * (c.y[k + 1] - y0) - (c.x[k + 1] - x0) * (c.y[k] - y0), minlength=len(c.row)) / 2


def areas(c: Columns) -> np.ndarray:
    return add_up(c, np.abs(signed(c)) * np.where(c.type == SHELL, 1, np.where(c.type == HOLE, -1, 0)))


def area(c: Columns) -> pa.Array:
    return masked(areas(c), c.null)


def length(c: Columns) -> pa.Array:
    return masked(add_up(c, run_lengths(c)), c.null)


def bounds(c: Columns) -> tuple[np.ndarray, np.ndarray]:
    """minx, miny, maxx, maxy of each row, and whether a row has none."""
    out = np.zeros((4, c.rows))
    own = c.coordinate_rows()
    none = np.bincount(own, minlength=c.rows) == 0
    if len(own):
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        for k, (f, v) in enumerate(((np.minimum, c.x), (np.minimum, c.y), (np.maximum, c.x), (np.maximum, c.y))):
            out[k, own[first]] = f.reduceat(v, first)
    return out, none


def box(c: Columns) -> pa.Array:
    b, none = bounds(c)
    missing = pa.array(none | c.null)
    return pa.StructArray.from_arrays([pa.array(v) for v in b], names=["minx", "miny", "maxx", "maxy"], mask=missing)


def envelope(c: Columns) -> pa.Array | None:
    (x0, y0, x1, y1), none = bounds(c)
    if (none & ~c.null).any():
        raise GeometryError("an empty geometry has no envelope")
    if ((x0 == x1) | (y0 == y1))[~c.null].any():
        return None  # a point or a line
    out = np.zeros(c.rows, np.dtype([("o", "u1"), ("t", "<u4"), ("rings", "<u4"), ("n", "<u4"), ("c", "<f8", (10,))]))
    out["o"], out["t"], out["rings"], out["n"] = 1, 3, 1, 5
    out["c"] = np.stack([x0, y0, x1, y0, x1, y1, x0, y1, x0, y0], axis=1)
    return fixed(out, c.null)


def centroid(c: Columns) -> pa.Array:
    """Of the parts of the highest dimension, or of the coordinates where these have no extent."""
    n = np.bincount(c.coordinate_rows(), minlength=c.rows)
    if ((n == 0) & ~c.null).any():
        raise GeometryError("the geometry is empty")
    k = c.steps()
    s, first = signed(c), np.minimum(np.cumsum(c.size) - c.size, max(0, len(c.x) - 1))
    ring = c.ring[k]
    x0, y0 = c.x[first[ring]], c.y[first[ring]]
    w = (c.x[k] - x0) * (c.y[k + 1] - y0) - (c.x[k + 1] - x0) * (c.y[k] - y0)
    per_ring = lambda v: np.bincount(ring, weights=v, minlength=len(c.row))
    sign = np.where(c.type == SHELL, 1.0, np.where(c.type == HOLE, -1.0, 0.0)) * np.abs(s)
    with np.errstate(divide="ignore", invalid="ignore"):
        inner = [np.where(s != 0, sign * (v[first] + per_ring((v[k] + v[k + 1] - 2 * v0) * w) / (6 * s)), 0.0) if len(c.x) else np.zeros(len(c.row)) for v, v0 in ((c.x, x0), (c.y, y0))]
        flat = add_up(c, np.where(s != 0, sign, 0.0))
        by_area = [add_up(c, v) / flat for v in inner]
        d = np.hypot(c.x[k + 1] - c.x[k], c.y[k + 1] - c.y[k])
        line = add_up(c, per_ring(d))
        by_length = [add_up(c, per_ring(d * (v[k] + v[k + 1]) / 2)) / line for v in (c.x, c.y)]
        mean = [np.bincount(c.coordinate_rows(), weights=v, minlength=c.rows) / n for v in (c.x, c.y)]
    out = [np.where(areas(c) != 0, a, np.where(line != 0, b, m)) for a, b, m in zip(by_area, by_length, mean, strict=True)]
    return points(*out, c.null)


def moved(c: Columns, f) -> pa.Array:
    """The same geometries with coordinates x, y = f(x, y)."""
    x, y = f(c.x, c.y)
    if not (np.isfinite(x).all() and np.isfinite(y).all()):
        raise GeometryError("a coordinate is not finite")
    out = c.buf.copy()
    scatter(out, c.places(), x, y)
    return binary(out, c.offsets, c.null)


def scatter(buf: np.ndarray, where: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    for shift in range(8):
        on = np.flatnonzero(where % 8 == shift)
        if len(on):
            view, k = doubles(buf, shift), (where[on] - shift) // 8
            view[k], view[k + 1] = x[on], y[on]


def snapped_to_grid(c: Columns, size: float) -> pa.Array:
    snap = lambda v: np.floor(np.abs(v) / size + 0.5) * size * np.copysign(1, v) + 0.0
    before = areas(c), add_up(c, run_lengths(c))
    x, y = c.x, c.y
    c.x, c.y = snap(x), snap(y)
    if ((before[0] != 0) & (areas(c) == 0) | (before[1] != 0) & (add_up(c, run_lengths(c)) == 0)).any():
        raise GeometryError("the geometry collapsed")
    return moved(c, lambda a, b: (a, b))


def simplified(c: Columns, tolerance: float) -> pa.Array:
    """Douglas-Peucker on all lines and rings together, a level of splits at a time."""
    keep = np.zeros(len(c.x), bool)
    first = np.cumsum(c.size) - c.size
    on = c.size > 0
    a, b = first[on], (first + c.size - 1)[on]
    keep[a] = keep[b] = True
    a, b = a[b - a > 1], b[b - a > 1]
    while len(a):
        inner = b - a - 1
        seg = np.repeat(np.arange(len(a)), inner)
        begins = np.cumsum(inner) - inner
        at = a[seg] + 1 + np.arange(len(seg)) - begins[seg]
        ax, ay = c.x[a][seg], c.y[a][seg]
        dx, dy = c.x[b][seg] - ax, c.y[b][seg] - ay
        n = dx * dx + dy * dy
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(n > 0, np.clip(((c.x[at] - ax) * dx + (c.y[at] - ay) * dy) / n, 0, 1), 0.0)
        d = np.hypot(c.x[at] - ax - t * dx, c.y[at] - ay - t * dy)
        far = np.maximum.reduceat(d, begins)
        k = np.minimum.reduceat(np.where(d == far[seg], at, len(c.x)), begins)
        split = far > tolerance
        keep[k[split]] = True
        a, b, k = a[split], b[split], k[split]
        a, b = np.concatenate([a, k]), np.concatenate([k, b])
        a, b = a[b - a > 1], b[b - a > 1]
    kept = np.bincount(c.ring[keep], minlength=len(c.row))
    whole = kept < np.where(c.type >= SHELL, 4, 2)
    keep |= (whole | (c.type == POINT))[c.ring]
    lost = c.places()[~keep]
    if not len(lost):
        return binary(c.buf, c.offsets, c.null)
    out, stay = c.buf.copy(), np.ones(len(c.buf), bool)
    lines = c.type != POINT
    put_u4(out, c.at[lines] - 4, np.bincount(c.ring[keep], minlength=len(c.row))[lines])
    stay[(lost[:, None] + np.arange(16)).ravel()] = False
    return binary(out[stay], np.concatenate([[0], np.cumsum(stay)])[c.offsets], c.null)


def convex_hull(c: Columns) -> tuple[pa.Array, np.ndarray]:
    """Closed counter-clockwise hulls, and the rows that are left out (as null): those of more than WIDE or fewer than three different points."""
    own = c.coordinate_rows()
    if ((np.bincount(own, minlength=c.rows) == 0) & ~c.null).any():
        raise GeometryError("the geometry is empty")
    order = np.lexsort((c.y, c.x, own))
    r, x, y = own[order], c.x[order], c.y[order]
    new = np.concatenate([[True], (r[1:] != r[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) if len(r) else np.zeros(0, bool)
    r, x, y = r[new], x[new], y[new]
    m = np.bincount(r, minlength=c.rows)
    left = ~c.null & ((m < 3) | (m > WIDE))
    rows = np.flatnonzero(~c.null & ~left)
    first = (np.cumsum(m) - m)[rows]
    m = m[rows]

    def half(step: int, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        stack = np.zeros((len(rows), int(m.max(initial=1)) + 1), np.int64)
        size = np.zeros(len(rows), np.int64)
        for j in range(int(m.max(initial=0))):
            on = np.flatnonzero(m > j)
            p = begin[on] + step * j
            left_ = np.arange(len(on))
            while len(left_):
                left_ = left_[size[on[left_]] > 1]
                o, q, e = stack[on[left_], size[on[left_]] - 2], stack[on[left_], size[on[left_]] - 1], p[left_]
                turn = (x[q] - x[o]) * (y[e] - y[o]) - (y[q] - y[o]) * (x[e] - x[o])
                left_ = left_[turn <= 0]
                size[on[left_]] -= 1
            stack[on, size[on]] = p
            size[on] += 1
        return stack, size - 1

    low, up = half(1, first), half(-1, first + m - 1)
    n = low[1] + up[1] + 1
    sizes = np.zeros(c.rows, np.int64)
    sizes[rows] = 13 + 16 * n
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(int(offsets[-1]), np.uint8)
    head = offsets[:-1][rows]
    out[head] = 1
    put_u4(out, head + 1, np.full(len(rows), 3))
    put_u4(out, head + 5, np.full(len(rows), 1))
    put_u4(out, head + 9, n)
    for stack, count, before in ((low[0], low[1], np.zeros(len(rows), np.int64)), (up[0], up[1] + 1, low[1])):
        if not len(rows):
            break
        used = np.arange(stack.shape[1]) < count[:, None]
        # the ring ends where it began, which is the last point of the upper half
        k = stack[used]
        at = (head + 13 + 16 * before)[:, None] + 16 * np.arange(stack.shape[1])
        scatter(out, at[used], x[k], y[k])
    return binary(out, offsets, c.null | left), left


def located(p: Columns, g: Columns) -> tuple[np.ndarray, np.ndarray]:
    """Whether the point of each row lies inside, and whether it lies on the boundary, of the polygons of that row."""
    k = g.steps()
    row = g.row[g.ring[k]]
    at = np.zeros(p.rows, np.int64)
    at[p.coordinate_rows()] = np.arange(len(p.x))
    px, py = p.x[at[row]], p.y[at[row]]
    ax, ay, bx, by = g.x[k], g.y[k], g.x[k + 1], g.y[k + 1]
    turn = (bx - ax) * (py - ay) - (by - ay) * (px - ax)
    on = (turn == 0) & (np.minimum(ax, bx) <= px) & (px <= np.maximum(ax, bx)) & (np.minimum(ay, by) <= py) & (py <= np.maximum(ay, by))
    over = ((ay <= py) & (py < by) & (turn > 0)) | ((by <= py) & (py < ay) & (turn < 0))
    touched = np.bincount(row, weights=on, minlength=g.rows) > 0
    return (np.bincount(row, weights=over, minlength=g.rows) % 2 == 1) & ~touched, touched


#: Relations of a point to a polygon by whether it is inside and on the boundary; others never hold.
OF_POINT = {"intersects": lambda i, b: i | b, "disjoint": lambda i, b: ~(i | b), "within": lambda i, b: i, "covered_by": lambda i, b: i | b, "touches": lambda i, b: b}
OF_POLYGON = {"intersects": lambda i, b: i | b, "disjoint": lambda i, b: ~(i | b), "contains": lambda i, b: i, "contains_properly": lambda i, b: i, "covers": lambda i, b: i | b, "touches": lambda i, b: b}


def related(name: str, a: Columns, b: Columns) -> pa.Array | None:
    """A relation of points to polygons, or of polygons to points; None for other kinds."""
    null = a.null | b.null
    kinds = [np.unique(c.kind[~null]).tolist() for c in (a, b)]
    flipped = kinds[0] != [1]
    p, g = (b, a) if flipped else (a, b)
    points_, polygons = kinds[::-1] if flipped else kinds
    some = ~null
    if points_ != [1] or not set(polygons) <= {3, 6} or (np.bincount(p.coordinate_rows(), minlength=p.rows)[some] != 1).any() or (np.bincount(g.coordinate_rows(), minlength=g.rows)[some] == 0).any() or not len(p.x):
        return None
    inside, on = located(p, g)
    f = (OF_POLYGON if flipped else OF_POINT).get(name)
    return masked(f(inside, on) if f else np.zeros(len(null), bool), null)


#: Relations of a line to areas by whether some of it is inside, some outside, and whether they meet; others never hold.
OF_LINE = {"intersects": lambda i, o, m: m, "disjoint": lambda i, o, m: ~m, "within": lambda i, o, m: i & ~o, "covered_by": lambda i, o, m: m & ~o, "touches": lambda i, o, m: m & ~i, "crosses": lambda i, o, m: i & o}
MOST_PAIRS = 200_000


class Area:
    """The polygons of one geometry, each a list of rings, against which points and lines are held as planar does, by the same formulas and tolerances."""

    def __init__(self, polygons: list[list[list[tuple[float, float]]]]):
        self.rings: list[list[int]] = []
        ends, own = [], []
        for p in polygons:
            self.rings.append(list(range(len(own), len(own) + len(p))))
            for r in p:
                edges = [(*a, *b) for a, b in zip(r, r[1:], strict=False) if a != b]
                own.append((len(ends), len(ends) + len(edges)))
                ends += edges
        self.own = own
        self.x, self.y, self.u, self.v = np.array(ends, float).reshape(-1, 4).T
        self.box = (min(self.x), min(self.y), max(self.x), max(self.y)) if ends else None

    def locate(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """1 inside, 0 on the boundary, -1 outside."""
        x, y = x[:, None], y[:, None]
        on = on_segment(x, y, self.x, self.y, self.u, self.v)
        with np.errstate(divide="ignore", invalid="ignore"):
            over = ((self.y > y) != (self.v > y)) & (x < (self.u - self.x) * (y - self.y) / (self.v - self.y) + self.x)
        best = np.full(len(x), -1)
        for rings in self.rings:
            at = np.full(len(x), -1)
            for k, r in enumerate(rings):
                a, b = self.own[r]
                ring = np.where(on[:, a:b].any(axis=1), 0, np.where(over[:, a:b].sum(axis=1) % 2 == 1, 1, -1))
                at = ring if k == 0 else np.where((at == 1) & (ring >= 0), -ring, at)
            best = np.maximum(best, at)
        return best


def on_segment(x: np.ndarray, y: np.ndarray, ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray) -> np.ndarray:
    """planar.on_segment() of segments that are no points."""
    scale = np.maximum.reduce(np.broadcast_arrays(*map(np.abs, (ax, ay, bx, by, x, y)), 1e-300))
    near = np.abs((bx - ax) * (y - ay) - (by - ay) * (x - ax)) <= 1e-11 * scale * np.hypot(bx - ax, by - ay)
    t = 1e-12 * scale
    return near & (np.minimum(ax, bx) - t <= x) & (x <= np.maximum(ax, bx) + t) & (np.minimum(ay, by) - t <= y) & (y <= np.maximum(ay, by) + t)


def touch(x: np.ndarray, y: np.ndarray, ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether points lie on segments to the last bit, and whether they lie so near that only planar's tolerances can tell."""
    scale = np.maximum.reduce(np.broadcast_arrays(*map(np.abs, (ax, ay, bx, by, x, y)), 1e-300)) * 1e-8
    x0, x1, y0, y1 = np.minimum(ax, bx), np.maximum(ax, bx), np.minimum(ay, by), np.maximum(ay, by)
    turn = np.abs((bx - ax) * (y - ay) - (by - ay) * (x - ax))
    on = (turn == 0) & (x0 <= x) & (x <= x1) & (y0 <= y) & (y <= y1)
    return on, ~on & (turn <= scale * np.hypot(bx - ax, by - ay)) & (x0 - scale <= x) & (x <= x1 + scale) & (y0 - scale <= y) & (y <= y1 + scale)


def lines_to_area(name: str, c: Columns, area: Area) -> tuple[np.ndarray, np.ndarray]:
    """A relation of the lines of a batch to one area, and the rows that have to be looked at by themselves: corners too near to tell, no length at all.

    Each segment is cut where it meets the area's boundary. What lies between two cuts is
    inside, on the boundary or outside as its middle is.
    """
    inside, outside, meets = (np.zeros(c.rows, bool) for _ in range(3))
    (x0, y0, x1, y1), none = bounds(c)
    apart = none | (x1 < area.box[0]) | (area.box[2] < x0) | (y1 < area.box[1]) | (area.box[3] < y0)
    k = c.steps()
    k = k[(c.x[k] != c.x[k + 1]) | (c.y[k] != c.y[k + 1])]
    row = c.row[c.ring[k]]
    left = ~apart & (np.bincount(row, minlength=c.rows) == 0)
    k = k[~apart[row]]
    edges = len(area.x)
    most = np.maximum.reduce([np.abs(v) for v in (x0, y0, x1, y1)])
    most = np.maximum(most, max(np.abs(v).max() for v in (area.x, area.y)))
    for at in range(0, len(k), max(1, MOST_PAIRS // edges)):
        some = k[at : at + max(1, MOST_PAIRS // edges)]
        own = c.row[c.ring[some]]
        ax, ay, bx, by = (v[:, None] for v in (c.x[some], c.y[some], c.x[some + 1], c.y[some + 1]))
        cx, cy, dx, dy = area.x, area.y, area.u, area.v
        close = (np.maximum(ax, bx) >= np.minimum(cx, dx)) & (np.maximum(cx, dx) >= np.minimum(ax, bx)) & (np.maximum(ay, by) >= np.minimum(cy, dy)) & (np.maximum(cy, dy) >= np.minimum(ay, by))
        (first, a), (second, b), (start, e), (stop, f) = (touch(*x) for x in ((cx, cy, ax, ay, bx, by), (dx, dy, ax, ay, bx, by), (ax, ay, cx, cy, dx, dy), (bx, by, cx, cy, dx, dy)))
        left[own[(a | b | e | f).any(axis=1)]] = True
        ends = start | stop
        rx, ry, sx, sy = bx - ax, by - ay, dx - cx, dy - cy
        n = rx * sy - ry * sx
        with np.errstate(divide="ignore", invalid="ignore"):
            t = ((cx - ax) * sy - (cy - ay) * sx) / n
            u = ((cx - ax) * ry - (cy - ay) * rx) / n
            cross = close & ~(first | second | ends) & (n != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
            px, py = ax + t * rx, ay + t * ry
        meets[own[(first | second | ends | cross).any(axis=1)]] = True
        # all cuts of each segment, from its beginning to its end
        shape = (len(some), edges)
        x = np.concatenate([ax, bx, *(np.where(hit, np.broadcast_to(v, shape), ax) for hit, v in ((first, cx), (second, dx), (cross, px)))], axis=1)
        y = np.concatenate([ay, by, *(np.where(hit, np.broadcast_to(v, shape), ay) for hit, v in ((first, cy), (second, dy), (cross, py)))], axis=1)
        order = np.argsort((x - ax) * rx + (y - ay) * ry, axis=1, kind="stable")
        x, y = (np.take_along_axis(v, order, axis=1) for v in (x, y))
        size = np.hypot(np.diff(x, axis=1), np.diff(y, axis=1))
        grid = most[own][:, None] * 1e-11  # nearer points are one
        left[own[((size > 0.9 * grid) & (size < 4 * grid)).any(axis=1)]] = True
        piece, place = np.nonzero(size >= 4 * grid)
        middle = area.locate((x[piece, place] + x[piece, place + 1]) / 2, (y[piece, place] + y[piece, place + 1]) / 2)
        inside[own[piece[middle == 1]]] = True
        outside[own[piece[middle == -1]]] = True
        meets[own[piece[middle >= 0]]] = True
    f = OF_LINE.get(name)
    return f(inside, outside, meets) if f else np.zeros(c.rows, bool), left & ~c.null


def encode(kind: np.ndarray, row: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray, null: np.ndarray) -> pa.Array:
    """Points, lines and polygons (kinds 1 to 3) as well-known binary, from their rings in order of rows."""
    rings = np.bincount(row, minlength=len(kind))
    head = np.where(null, 0, np.where(kind == 1, 5, 9))
    before = np.where(kind[row] == 3, 4, 0)
    length = head + np.bincount(row, weights=before + 16 * size, minlength=len(kind)).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(length)])
    out = np.zeros(int(offsets[-1]), np.uint8)
    some = np.flatnonzero(~null)
    at = offsets[:-1][some]
    out[at] = 1
    put_u4(out, at + 1, kind[some])
    many = some[kind[some] == 3]
    put_u4(out, offsets[many] + 5, rings[many])
    # where each ring begins: behind the head of its row and the rings before it
    taken = np.cumsum(before + 16 * size) - (before + 16 * size)
    first = np.cumsum(rings) - rings
    begin = offsets[:-1][row] + head[row] + taken - (taken[first[row]] if len(row) else taken)
    for k, shift in ((3, 0), (2, -4)):
        on = kind[row] == k
        put_u4(out, begin[on] + shift, size[on])
    ring = np.repeat(np.arange(len(row)), size)
    step = np.arange(len(ring)) - (np.cumsum(size) - size)[ring]
    scatter(out, (begin + before)[ring] + 16 * step, x, y)
    return binary(out, offsets, null)


NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
PAIR = rf"\s*{NUMBER}\s+{NUMBER}\s*"
PLAIN = re.compile(rf"\s*(?:(POINT)\s*\({PAIR}\)|(LINESTRING)\s*\({PAIR}(?:,{PAIR})+\)|(POLYGON)\s*\(\s*\({PAIR}(?:,{PAIR})*\)(?:\s*,\s*\({PAIR}(?:,{PAIR})*\))*\s*\))\s*", re.IGNORECASE)
TO_SPACES = str.maketrans("(),", "   ")


def read_texts(texts: list[str | None], one) -> pa.Array:
    """Well-known binary of texts; one() reads what is no plain point, line or polygon."""
    kind = np.zeros(len(texts), np.int64)
    rows, sizes, bodies = [], [], []
    for k, t in enumerate(texts):
        m = PLAIN.fullmatch(t) if t is not None else None
        if m is None:
            continue
        kind[k] = m.lastindex
        body = t[t.index("(") :]
        bodies.append(body)
        if m.lastindex < 3:
            rows.append(k)
            sizes.append(body.count(",") + 1)
        else:
            parts = body.split(")")[:-2]
            rows += [k] * len(parts)
            sizes += [p.count(",") + (j == 0) for j, p in enumerate(parts)]
    row, size = np.array(rows, np.int64), np.array(sizes, np.int64)
    numbers = np.array(" ".join(bodies).translate(TO_SPACES).split(), np.float64)
    x, y = numbers[::2], numbers[1::2]
    last = np.cumsum(size) - 1
    bad = (kind[row] == 3) & ((size < 4) | (x[last - size + 1] != x[last]) | (y[last - size + 1] != y[last])) if len(row) else np.zeros(0, bool)
    ring = np.repeat(np.arange(len(row)), size)
    bad |= np.bincount(ring, weights=~(np.isfinite(x) & np.isfinite(y)), minlength=len(row)) > 0
    if bad.any():
        for k in np.unique(row[bad]).tolist():
            one(texts[k])
        raise GeometryError("the text is not a geometry")
    made = encode(kind, row, size, x, y, kind == 0)
    rest = [k for k in np.flatnonzero(kind == 0).tolist() if texts[k] is not None]
    if not rest:
        return made
    out = made.to_pylist()
    for k in rest:
        out[k] = one(texts[k])
    return pa.array(out, pa.binary())


def write_texts(c: Columns, shown, names: list[str]) -> pa.Array:
    """Well-known text of all rows; shown() writes a number and names are those of the kinds."""
    values, at = np.unique(np.concatenate([c.x, c.y]), return_inverse=True)
    texts = [shown(v) for v in values.tolist()]
    n = len(c.x)
    pairs = [f"{texts[a]} {texts[b]}" for a, b in zip(at[:n].tolist(), at[n:].tolist(), strict=True)]
    ends = np.cumsum(c.size).tolist()
    rings = ["(" + ",".join(pairs[e - s : e]) + ")" for e, s in zip(ends, c.size.tolist(), strict=True)]
    count = np.bincount(c.row, minlength=c.rows)
    stop = np.cumsum(count).tolist()
    shells = (c.type == SHELL).tolist()
    out: list[str | None] = []
    for k, (code, e, m, null) in enumerate(zip(c.kind.tolist(), stop, count.tolist(), c.null.tolist(), strict=True)):
        if null:
            out.append(None)
            continue
        name, own = names[code - 1].upper(), rings[e - m : e]
        if not own or own == ["()"]:
            out.append(name + " EMPTY")
        elif code <= 2:
            out.append(name + own[0])
        elif code in (3, 4, 5):
            out.append(f"{name}({','.join(own)})")
        else:
            polygons: list[list[str]] = []
            for r, first in zip(own, shells[e - m : e], strict=True):
                polygons.append([r]) if first else polygons[-1].append(r)
            out.append(f"{name}({','.join('(' + ','.join(p) + ')' for p in polygons)})")
    return pa.array(out, pa.string())


def one_point(c: Columns) -> np.ndarray | None:
    """The coordinate of each row, -1 for null rows; None unless all other rows are points that are not empty."""
    n = np.bincount(c.coordinate_rows(), minlength=c.rows)
    if (c.kind[~c.null] != 1).any() or (n[~c.null] != 1).any():
        return None
    return np.where(c.null, -1, np.cumsum(n) - 1)


def on_earth(*pairs: np.ndarray) -> bool:
    return all((np.abs(x) <= 180).all() and (np.abs(y) <= 90).all() for x, y in zip(pairs[::2], pairs[1::2], strict=True))


def haversine(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray, radius: float) -> np.ndarray:
    x, y, u, v = map(np.radians, (x, y, u, v))
    return 2 * radius * np.arcsin(np.minimum(1.0, np.sqrt(np.sin((v - y) / 2) ** 2 + np.cos(y) * np.cos(v) * np.sin((u - x) / 2) ** 2)))


def inverse(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray, width: float, flat: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Metres and initial bearings between points on an ellipsoid (Vincenty), and which of them did not settle."""
    pole = width * (1 - flat)
    equal = (x == u) & (y == v)
    x, y, u, v = map(np.radians, (x, y, u, v))
    r1, r2 = np.arctan((1 - flat) * np.tan(y)), np.arctan((1 - flat) * np.tan(v))
    s1, c1, s2, c2 = np.sin(r1), np.cos(r1), np.sin(r2), np.cos(r2)
    turn = (u - x + np.pi) % (2 * np.pi) - np.pi
    lam, open_ = turn.copy(), ~equal
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(200):
            sl, cl = np.sin(lam), np.cos(lam)
            ss = np.hypot(c2 * sl, c1 * s2 - s1 * c2 * cl)
            equal |= ss == 0
            cs = s1 * s2 + c1 * c2 * cl
            sigma = np.arctan2(ss, cs)
            sa = np.where(ss > 0, c1 * c2 * sl / ss, 0.0)
            ca = 1 - sa * sa
            cm = np.where(ca != 0, cs - 2 * s1 * s2 / ca, 0.0)
            c = flat / 16 * ca * (4 + flat * (4 - 3 * ca))
            new = turn + (1 - c) * flat * sa * (sigma + c * ss * (cm + c * cs * (2 * cm * cm - 1)))
            settled = np.abs(new - lam) < 1e-13
            lam = np.where(open_, new, lam)
            open_ &= ~settled & ~equal
            if not open_.any():
                break
        w = ca * (width**2 - pole**2) / pole**2
        a = 1 + w / 16384 * (4096 + w * (-768 + w * (320 - 175 * w)))
        b = w / 1024 * (256 + w * (-128 + w * (74 - 47 * w)))
        d = b * ss * (cm + b / 4 * (cs * (2 * cm * cm - 1) - b / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))
        bearing = np.degrees(np.arctan2(c2 * np.sin(lam), c1 * s2 - s1 * c2 * np.cos(lam))) % 360
    return np.where(equal, 0.0, pole * a * (sigma - d)), np.where(equal, 0.0, bearing), open_


def from_points(c: Columns, f) -> pa.Array | None:
    """f(x, y) of the points of all rows; None where a row is no point or f gives None."""
    at = one_point(c)
    if at is None or not on_earth(c.x, c.y):
        return None
    made = f(c.x, c.y)
    if made is None:
        return None
    return masked(made[at] if len(made) else np.zeros(c.rows), c.null)


def geodesic_length(c: Columns, width: float, flat: float) -> pa.Array | None:
    if not on_earth(c.x, c.y):
        return None
    k = c.steps()
    d, _, left = inverse(c.x[k], c.y[k], c.x[k + 1], c.y[k + 1], width, flat)
    return None if left.any() else masked(np.bincount(c.row[c.ring[k]], weights=d, minlength=c.rows), c.null)


def along(c: Columns, ratio: float) -> pa.Array | None:
    """The point at a share of each line's length."""
    some = ~c.null
    if (c.kind[some] != 2).any() or (np.bincount(c.coordinate_rows(), minlength=c.rows)[some] < 2).any():
        return None
    k = c.steps()
    row = c.row[c.ring[k]]
    d = np.hypot(c.x[k + 1] - c.x[k], c.y[k + 1] - c.y[k])
    total = np.bincount(row, weights=d, minlength=c.rows)
    end = np.cumsum(d)
    end -= np.where(np.arange(len(row)) >= 0, (np.cumsum(total) - total)[row], 0.0)
    rest = (total * ratio)[row] - (end - d)
    hit = (rest <= d * (1 + 1e-12)) & (d > 0)
    last = np.bincount(c.row, weights=c.size, minlength=c.rows).astype(np.int64)
    last = np.cumsum(last) - 1
    out = np.stack([c.x[last], c.y[last]]) if len(c.x) else np.zeros((2, c.rows))
    on = np.flatnonzero(hit)
    _, first = np.unique(row[on], return_index=True)
    on = on[first]
    t = np.clip(rest[on] / d[on], 0, 1)
    out[0, row[on]] = c.x[k[on]] + t * (c.x[k[on] + 1] - c.x[k[on]])
    out[1, row[on]] = c.y[k[on]] + t * (c.y[k[on] + 1] - c.y[k[on]])
    return points(*out, c.null)


def densified(c: Columns, step: float) -> pa.Array | None:
    """Lines and polygons with points put in so that no segment is longer than step."""
    if (c.kind[~c.null] > 3).any():
        return None
    k = c.steps()
    n = np.ones(len(c.x), np.int64)
    n[k] = np.maximum(1, np.ceil(np.hypot(c.x[k + 1] - c.x[k], c.y[k + 1] - c.y[k]) / step - 1e-12)).astype(np.int64)
    at = np.repeat(np.arange(len(n)), n)
    t = (np.arange(len(at)) - (np.cumsum(n) - n)[at]) / n[at]
    to = np.minimum(at + 1, max(0, len(n) - 1))
    x, y = (np.where(t > 0, v[at] + (v[to] - v[at]) * t, v[at]) for v in (c.x, c.y))
    return encode(c.kind.astype(np.int64), c.row, np.bincount(c.ring, weights=n, minlength=len(c.row)).astype(np.int64), x, y, c.null)


def distance_to_point(c: Columns, px: float | np.ndarray, py: float | np.ndarray) -> pa.Array | None:
    """Of lines, points and polygons to one point, or to that of each row; 0 for polygons that cover it."""
    n = np.bincount(c.coordinate_rows(), minlength=c.rows)
    if (n[~c.null] == 0).any():
        return None
    px, py = (np.broadcast_to(np.asarray(v, float), c.rows) for v in (px, py))
    best = np.full(c.rows, np.inf)
    own = c.coordinate_rows()
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else own
    if len(own):
        best[own[first]] = np.minimum.reduceat(np.hypot(c.x - px[own], c.y - py[own]), first)
    k = c.steps()
    if len(k):
        row = c.row[c.ring[k]]
        dx, dy = c.x[k + 1] - c.x[k], c.y[k + 1] - c.y[k]
        m = dx * dx + dy * dy
        u, v = px[row] - c.x[k], py[row] - c.y[k]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(m > 0, np.clip((u * dx + v * dy) / m, 0, 1), 0.0)
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        best[row[first]] = np.minimum(best[row[first]], np.minimum.reduceat(np.hypot(u - t * dx, v - t * dy), first))
    areal = np.isin(c.kind, (3, 6))
    if areal.any():
        inside, on = located(decode(points(px, py, np.zeros(c.rows, bool))), c)
        best[areal & (inside | on)] = 0.0
    return masked(best, c.null)


def distance(a: Columns, b: Columns) -> pa.Array | None:
    """Of the geometries of two columns, one of which has points only; None for other kinds."""
    for p, g in ((a, b), (b, a)):
        there = ~(p.null | g.null)
        if (p.kind[there] == 1).all() and (np.bincount(p.coordinate_rows(), minlength=p.rows)[there] == 1).all():
            at = np.zeros((2, p.rows))
            at[:, p.coordinate_rows()] = p.x, p.y
            found = distance_to_point(g, *at)
            return found if found is None or not p.null.any() else masked(found.to_numpy(zero_copy_only=False), ~there)
    return None
