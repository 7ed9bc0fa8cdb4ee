"""Vectors, quaternions, boxes and cameras as column expressions; polygons, which need loops, as Pandas UDFs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def vec(x, y, z) -> Column:
    return F.array(*[v.cast("double") if isinstance(v, Column) else F.lit(float(v)) for v in (x, y, z)])


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def at(v: Column, i: int) -> Column:
    """Component i; what is missing counts as 0."""
    return F.coalesce(F.get(v, F.lit(i)), F.lit(0.0))


def sub(a: Column, b: Column) -> Column:
    return vec(*[at(a, i) - at(b, i) for i in range(3)])


def dot(a: Column, b: Column) -> Column:
    return sum((at(a, i) * at(b, i) for i in range(3)), F.lit(0.0))


def cross(a: Column, b: Column) -> Column:
    return vec(at(a, 1) * at(b, 2) - at(a, 2) * at(b, 1), at(a, 2) * at(b, 0) - at(a, 0) * at(b, 2), at(a, 0) * at(b, 1) - at(a, 1) * at(b, 0))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The direction of a vector; null components for the zero vector."""
    return let(a, lambda v: let(norm(v), lambda n: F.transform(v, lambda x: F.try_divide(x, n))))


def significant(x: Column, digits: int) -> Column:
    """Rounds to significant digits."""
    power = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * power) / power)


def dot4(a: Column, b: Column) -> Column:
    return sum((F.get(a, F.lit(i)) * F.get(b, F.lit(i)) for i in range(4)), F.lit(0.0))


def scale4(a: Column, k: Column) -> Column:
    return F.transform(a, lambda x: x * k)


def quat_conj(q: Column) -> Column:
    return F.array(*[-F.get(q, F.lit(i)) for i in range(3)], F.get(q, F.lit(3)))


def quat_mul(a: Column, b: Column) -> Column:
    """The product of quaternions (x, y, z, w)."""
    ax, ay, az, aw = (F.get(a, F.lit(i)) for i in range(4))
    bx, by, bz, bw = (F.get(b, F.lit(i)) for i in range(4))
    return F.array(aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw, aw * bw - ax * bx - ay * by - az * bz)


def rotation_vector(q: Column) -> Column:
    """Axis times angle of a unit quaternion, by the shorter way round."""
    sign = F.when(F.get(q, F.lit(3)) < 0, -1.0).otherwise(1.0)
    x, y, z, w = (F.get(q, F.lit(i)) * sign for i in range(4))
    s = F.sqrt(x * x + y * y + z * z)
    k = F.when(s < 1e-12, F.lit(2.0)).otherwise(2 * F.atan2(s, w) / F.when(s < 1e-12, F.lit(1.0)).otherwise(s))
    return F.array(x * k, y * k, z * k)


def axis_angle_quat(axis: Column, angle: Column) -> Column:
    u = unit(axis)
    return F.array(*[F.get(u, F.lit(i)) * F.sin(angle / 2) for i in range(3)], F.cos(angle / 2))


def euler_quat(rx: Column, ry: Column, rz: Column, order: str = "ZYX") -> Column:
    """The product of the rotations about the named axes (radians), the first one outermost: ZYX turns about x, then y, then z."""
    if sorted(order) != ["X", "Y", "Z"]:
        raise ValueError(f"no order of axes: {order}")
    q = lambda i, a: F.array(*[F.sin(a / 2) if k == i else F.lit(0.0) for k in range(3)], F.cos(a / 2))
    one, two, three = (q(i, (rx, ry, rz)[i]) for i in map("XYZ".index, order))
    return quat_mul(quat_mul(one, two), three)


def unit_quat(q: Column) -> Column:
    """A quaternion of length 1; the identity for one of length 0."""
    none = F.array(*map(F.lit, (0.0, 0.0, 0.0, 1.0)))
    size = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return let(q, lambda v: let(size(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(none)))


def matrix_quat(r: Column) -> Column:
    """The quaternion of a rotation matrix given as rows: the largest of four equivalent forms is taken."""
    m = lambda i, j: F.get(F.get(r, F.lit(i)), F.lit(j))
    trace = m(0, 0) + m(1, 1) + m(2, 2)
    root = lambda x: 2 * F.sqrt(F.greatest(x, F.lit(0.0)))
    s0, sx, sy, sz = root(trace + 1), root(1 + m(0, 0) - m(1, 1) - m(2, 2)), root(1 + m(1, 1) - m(0, 0) - m(2, 2)), root(1 + m(2, 2) - m(0, 0) - m(1, 1))
    d = lambda a, b: F.try_divide(a, b)
    by_w = F.array(d(m(2, 1) - m(1, 2), s0), d(m(0, 2) - m(2, 0), s0), d(m(1, 0) - m(0, 1), s0), s0 / 4)
    by_x = F.array(sx / 4, d(m(0, 1) + m(1, 0), sx), d(m(0, 2) + m(2, 0), sx), d(m(2, 1) - m(1, 2), sx))
    by_y = F.array(d(m(0, 1) + m(1, 0), sy), sy / 4, d(m(1, 2) + m(2, 1), sy), d(m(0, 2) - m(2, 0), sy))
    by_z = F.array(d(m(0, 2) + m(2, 0), sz), d(m(1, 2) + m(2, 1), sz), sz / 4, d(m(1, 0) - m(0, 1), sz))
    return F.when(trace > 0, by_w).when((m(0, 0) >= m(1, 1)) & (m(0, 0) >= m(2, 2)), by_x).when(m(1, 1) >= m(2, 2), by_y).otherwise(by_z)


def box_corners(center: Column, extents: Column, r: Column) -> Column:
    """The eight corners of an oriented box: centre plus signed half extents turned by the matrix rows r."""
    m = lambda i, j: F.get(F.get(r, F.lit(i)), F.lit(j))

    def corner(k: int) -> Column:
        half = [at(extents, j) * (0.5 if k >> j & 1 else -0.5) for j in range(3)]
        return vec(*[at(center, i) + sum((m(i, j) * half[j] for j in range(3)), F.lit(0.0)) for i in range(3)])

    return F.array(*[corner(k) for k in range(8)])


def box_heights(center: Column, extents: Column, r: Column) -> tuple[Column, Column]:
    """Least and largest height of a box, with whole extents on either side of the centre; the least is not under 0."""
    reach = sum((F.abs(F.get(F.get(r, F.lit(2)), F.lit(j))) * at(extents, j) for j in range(3)), F.lit(0.0))
    return F.greatest(at(center, 2) - reach, F.lit(0.0)), at(center, 2) + reach


def camera_coordinates(point: Column, eye: Column, target: Column, up: Column) -> Column:
    """Offsets (x right, y down, z forward) of a point from a camera."""

    def along(rel: Column, forward: Column, right: Column) -> Column:
        down = let(cross(right, forward), lambda c: -dot(c, rel))
        return F.struct(dot(right, rel).alias("x"), down.alias("y"), dot(forward, rel).alias("z"))

    def with_forward(rel: Column, forward: Column) -> Column:
        return let(unit(cross(forward, up)), lambda right: along(rel, forward, right))

    return let(sub(point, eye), lambda rel: let(unit(sub(target, eye)), lambda forward: with_forward(rel, forward)))


def camera_basis(eye: Column, target: Column, up: Column) -> tuple[Column, Column, Column]:
    """Right, down and forward of a camera that looks from eye at target."""
    forward = unit(sub(target, eye))
    right = unit(cross(forward, up))
    return right, F.transform(cross(right, forward), lambda x: -x), forward


def project(point: Column, eye: Column, target: Column, up: Column, fov: Column, width: Column, height: Column) -> Column:
    """Pixel (u, v) and depth of a point; fov is vertical, in radians. Points in the camera's plane have null pixels."""

    def seen(c: Column) -> Column:
        x, y, z = c["x"], c["y"], c["z"]
        f = height / 2 / F.tan(fov / 2)
        return F.struct((F.try_divide(f * x, z) + width / 2).alias("u"), (F.try_divide(f * y, z) + height / 2).alias("v"), z.alias("depth"))

    return let(camera_coordinates(point, eye, target, up), seen)


def radians_of(fov: Column) -> Column:
    """A field of view in radians: values above pi are taken for degrees."""
    return F.when(fov > np.pi, F.radians(fov)).otherwise(fov)


def horizontal_fov(fov: Column, width: Column, height: Column) -> Column:
    """Degrees across, from the vertical field of view."""
    return F.degrees(2 * F.atan(F.tan(radians_of(fov) / 2) * F.try_divide(width, height)))


def pitch(eye: Column, target: Column) -> Column:
    """Degrees that a camera looks up."""
    return F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), at(unit(sub(target, eye)), 2)))))


def plane_distance(point: Column, origin: Column, normal: Column) -> Column:
    return F.abs(dot(sub(point, origin), unit(normal)))


def zone(u: Column, v: Column, width: float, height: float) -> Column:
    """The ninth of an image that a pixel lies in; pixels outside count for the nearest."""
    cell = lambda x, size: F.least(F.greatest(F.floor(x / (size / 3)), F.lit(0)), F.lit(2)).cast("int")
    down = F.get(F.array(F.lit("top"), F.lit("middle"), F.lit("bottom")), cell(v, height))
    return F.concat_ws(" ", down, F.get(F.array(F.lit("left"), F.lit("center"), F.lit("right")), cell(u, width)))


def stress_colour(stress: Column, low: float, high: float) -> Column:
    """Blue over green to red."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (stress - low) / (high - low)))
    level = lambda x: F.round(255 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))).cast("int")
    return F.array(level(2 * t - 1), level(1 - F.abs(2 * t - 1)), level(1 - 2 * t))


def hull(points: np.ndarray) -> np.ndarray:
    """The convex hull of points in the plane, counter-clockwise."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def side(rows: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for q in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(side(p) + side(p[::-1]))


def area(polygon: np.ndarray) -> float:
    if len(polygon) < 3:
        return 0.0
    x, y = polygon.T
    return abs(float(x @ np.roll(y, -1) - y @ np.roll(x, -1))) / 2


def clip(subject: np.ndarray, window: np.ndarray) -> np.ndarray:
    """The part of a polygon inside a convex counter-clockwise one."""
    out = list(subject)
    for a, b in zip(window, np.roll(window, -1, axis=0)):
        rows, out = out, []
        inside = [(b[0] - a[0]) * (q[1] - a[1]) - (b[1] - a[1]) * (q[0] - a[0]) for q in rows]
        for i, q in enumerate(rows):
            d0, d1 = inside[i - 1], inside[i]
            if (d0 < 0) != (d1 < 0):
                out.append(rows[i - 1] + (q - rows[i - 1]) * (d0 / (d0 - d1)))
            if d1 >= 0:
                out.append(q)
        if not out:
            return np.zeros((0, 2))
    return np.array(out)


def _hull_iou(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for p, q in zip(a, b):
        x, y = (hull(np.array([list(map(float, r)) for r in s], np.float64).reshape(-1, 2)) for s in (p, q))
        both = area(clip(x, y)) if len(x) > 2 and len(y) > 2 else 0.0
        whole = area(x) + area(y) - both
        out.append(both / whole if whole > 0 else 0.0)
    return pd.Series(out, dtype="float64")


def _matrix_euler(m: pd.Series) -> pd.Series:
    out = pd.Series([None] * len(m), dtype=object)
    known = np.flatnonzero(m.notna().to_numpy())
    if len(known):
        u, _, v = np.linalg.svd(np.concatenate(m.iloc[known].to_list()).astype(np.float64).reshape(-1, 3, 3))
        u[:, :, 2] *= np.linalg.det(u @ v)[:, None]
        r = u @ v
        turns = np.stack([np.arctan2(r[:, 2, 1], r[:, 2, 2]), np.arcsin(np.clip(-r[:, 2, 0], -1, 1)), np.arctan2(r[:, 1, 0], r[:, 0, 0])], axis=1)
        held = np.empty(len(known), object)
        held[:] = np.degrees(turns).tolist()
        out.iloc[known] = held
    return out


def hull_iou(a: str | Column, b: str | Column) -> Column:
    """Intersection over union of the convex hulls of two lists of points (x, y); 0 if neither has an area.

    As no two plans that hold it are merged, its result may be used inside higher-order functions.
    """
    return F.pandas_udf(_hull_iou, "double").asNondeterministic()(a, b)


def matrix_euler(m: str | Column) -> Column:
    """Degrees about x, y and z of the rotation nearest to a matrix given as rows."""
    return F.pandas_udf(_matrix_euler, "array<double>").asNondeterministic()(F.flatten(m))


def relation(iou: Column, du: Column, dv: Column, ddepth: Column) -> Column:
    """How the first of two objects lies to the second: by depth if they overlap in the image, else by the larger offset."""
    return F.when(iou > 0, F.when(ddepth < 0, "in front of").otherwise("behind")).when(F.abs(du) >= F.abs(dv), F.when(du < 0, "left of").otherwise("right of")).otherwise(F.when(dv < 0, "above").otherwise("below"))
