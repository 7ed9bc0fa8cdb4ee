"""Poses of objects from semi-structured documents: whatever shape a state has, its place and its quaternion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry as G


def _numbers(state: Column, path: str, n: int) -> Column:
    """An array of n numbers at a path, else null: a missing part, another type or size is no error."""
    whole = lambda got: F.when((F.size(got) == n) & F.forall(got, lambda x: x.isNotNull()), got)
    return G.let(F.try_variant_get(state, path, "array<double>"), whole)


def _square(state: Column, path: str, n: int) -> Column:
    """An n x n matrix at a path, written as rows or flat, else null."""
    whole = lambda rows: F.when((F.size(rows) == n) & F.forall(rows, lambda r: (F.size(r) == n) & F.forall(r, lambda x: x.isNotNull())), rows)
    rows = G.let(F.try_variant_get(state, path, "array<array<double>>"), whole)
    cut = lambda flat: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.slice(flat, i * n + 1, F.lit(n)))
    return F.coalesce(rows, G.let(_numbers(state, path, n * n), lambda flat: F.when(flat.isNotNull(), cut(flat))))


def pose(state: Column, order: str = "XYZ") -> Column:
    """(shape, p, q) of a VARIANT state: the first shape of the ladder that is whole; null for one that has none.

    The ladder: a box with its matrix, a box's centre alone, a pose inside ``state``, a transform with p and q, with a
    pose, with position and rotation_quat, with a 4 x 4 matrix, of six numbers, with position and rotation_euler.
    Angles are radians, turned by ``order``; quaternions are (x, y, z, w) of length 1.
    """
    one = lambda path: _numbers(state, path, 3)
    four = lambda path: _numbers(state, path, 4)
    euler = lambda a, at=0: G.euler_quat(*[F.get(a, F.lit(at + i)) for i in range(3)], order)
    none = F.array(*map(F.lit, (0.0, 0.0, 0.0, 1.0)))
    plain = F.when(F.try_variant_get(state, "$.obb.R", "variant").isNull(), none)

    def found(name: str, p: Column, q: Column, place=lambda p: p, turn=lambda q: q) -> Column:
        both = F.struct(p.alias("p"), q.alias("q"))
        whole = lambda s: F.when(s["p"].isNotNull() & s["q"].isNotNull(), F.struct(F.lit(name).alias("shape"), place(s["p"]).alias("p"), G.unit_quat(turn(s["q"])).alias("q")))
        return G.let(both, whole)

    matrix, six = _square(state, "$.transform.matrix", 4), _numbers(state, "$.transform", 6)
    fourth = lambda m: F.transform(F.slice(m, 1, 3), lambda r: F.get(r, F.lit(3)))
    corner = lambda m: F.transform(F.slice(m, 1, 3), lambda r: F.slice(r, 1, 3))
    return F.coalesce(
        found("box", one("$.obb.center"), _square(state, "$.obb.R", 3), turn=G.matrix_quat),
        found("centre", one("$.obb.center"), plain),
        found("state", one("$.state.pose.p"), four("$.state.pose.q")),
        found("transform", one("$.transform.p"), four("$.transform.q")),
        found("transform pose", one("$.transform.pose.p"), four("$.transform.pose.q")),
        found("position", one("$.transform.position"), four("$.transform.rotation_quat")),
        found("matrix", matrix, matrix, place=fourth, turn=lambda m: G.let(corner(m), G.matrix_quat)),
        found("six", six, six, place=lambda a: F.slice(a, 1, 3), turn=lambda a: euler(a, 3)),
        found("euler", one("$.transform.position"), one("$.transform.rotation_euler"), turn=euler),
    )
