"""Ordered analytics: one sort of each entity's rows serves all derived columns of an operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seconds(ts: Column) -> Column:
    """A timestamp as seconds with microseconds."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def dealt(df: DataFrame, *keys: str, most: int = 50_000, rows: int | None = None) -> DataFrame:
    """The rows in as many partitions as it takes for about ``most`` of them in each, by keys if there are any.

    The number is fixed, so adaptive execution does not merge them: what a task holds does not grow with the table.
    ``rows`` spares the count where it is known.
    """
    n = max(1, -(-(df.count() if rows is None else rows) // most))
    return df.repartition(n, *keys)


def backward_difference(df: DataFrame, keys: list[str], t: str, values: list[str], prefix: tuple[str, str] = ("v_", "a_")) -> DataFrame:
    """Adds velocity and acceleration of each value: differences to the row before over the time between.

    The first row of an entity has neither, the second no acceleration; a step of no time gives null.
    """
    w = Window.partitionBy(*keys).orderBy(t)
    dt = F.col(t) - F.lag(t).over(w)
    df = df.withColumns({prefix[0] + c: F.try_divide(F.col(c) - F.lag(c).over(w), dt) for c in values})
    return df.withColumns({prefix[1] + c: F.try_divide(F.col(prefix[0] + c) - F.lag(prefix[0] + c).over(w), dt) for c in values})


def central_gradient(df: DataFrame, keys: list[str], t: str, value: str, out: str) -> DataFrame:
    """Second-order gradient on uneven steps, one-sided at both ends; null for entities of fewer than three rows."""
    w = Window.partitionBy(*keys).orderBy(t)
    f, x = F.col(value), F.col(t)
    f1, f2, g1, g2 = F.lag(value, 1).over(w), F.lag(value, 2).over(w), F.lead(value, 1).over(w), F.lead(value, 2).over(w)
    x1, x2, y1, y2 = F.lag(t, 1).over(w), F.lag(t, 2).over(w), F.lead(t, 1).over(w), F.lead(t, 2).over(w)
    hs, hd = x - x1, y1 - x
    inner = F.try_divide(hs * hs * g1 + (hd * hd - hs * hs) * f - hd * hd * f1, hs * hd * (hd + hs))
    d1, d2 = y1 - x, y2 - y1
    first = -F.try_divide(2 * d1 + d2, d1 * (d1 + d2)) * f + F.try_divide(d1 + d2, d1 * d2) * g1 - F.try_divide(d1, d2 * (d1 + d2)) * g2
    e1, e2 = x1 - x2, x - x1
    last = F.try_divide(e2, e1 * (e1 + e2)) * f2 - F.try_divide(e1 + e2, e1 * e2) * f1 + F.try_divide(2 * e2 + e1, e2 * (e1 + e2)) * f
    return df.withColumn(out, F.when(x1.isNull(), first).when(y1.isNull(), last).otherwise(inner))


def runs(df: DataFrame, keys: list[str], t: str, gap: float, min_length: int = 1, out: str = "run") -> DataFrame:
    """Numbers the maximal runs of rows at most ``gap`` apart; rows of runs shorter than ``min_length`` are dropped."""
    w = Window.partitionBy(*keys).orderBy(t)
    new = F.when((F.col(t) - F.lag(t).over(w)) <= gap, 0).otherwise(1)
    df = df.withColumn("__new", new).withColumn(out, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__new")
    if min_length > 1:
        df = df.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys, out))).where(F.col("__n") >= min_length).drop("__n")
    return df


def frames_before(df: DataFrame, keys: list[str], order: str, frame: str, n: int, stride: int, out: str = "frames") -> DataFrame:
    """Adds the ``n`` frames ending at a row, ``stride`` rows apart, oldest first; null where there are not enough rows."""
    w = Window.partitionBy(*keys).orderBy(order)
    got = F.array(*[F.lag(frame, (n - 1 - i) * stride).over(w) for i in range(n)])
    return df.withColumn(out, F.when(F.row_number().over(w) > (n - 1) * stride, got))


def change_counter(df: DataFrame, keys: list[str], order: list[str], value: str, out: str = "counter") -> DataFrame:
    """Counts from 1 within each key, one up whenever ``value`` differs from the row before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("__new", new).withColumn(out, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__new")


def moved(df: DataFrame, keys: list[str], t: str, values: list[str], threshold: float, steps: int, out: str = "moved", *, angles: list[str] | None = None, turn: float = 0.0) -> DataFrame:
    """Whether any of the last ``steps - 1`` moves from row to row, over all values, is longer than ``threshold``, or turns
    the ``angles`` by more than ``turn`` together; null without enough rows. Missing angles do not turn."""
    w = Window.partitionBy(*keys).orderBy(t)
    length = F.sqrt(sum(((F.col(c) - F.lag(c).over(w)) * (F.col(c) - F.lag(c).over(w)) for c in values), F.lit(0.0)))
    turned = sum((F.abs(F.col(c) - F.lag(c).over(w)) for c in angles or []), F.lit(0.0)) > turn
    df = df.withColumn("__far", F.coalesce(length > threshold, F.lit(False)) | F.coalesce(turned, F.lit(False)) if angles else length > threshold)
    any_far = F.max("__far").over(w.rowsBetween(-(steps - 2), 0))
    return df.withColumn(out, F.when(F.row_number().over(w) >= steps, F.coalesce(any_far, F.lit(False)))).drop("__far")


def still(df: DataFrame, keys: list[str], t: str, values: list[str], threshold: float, steps: int, out: str = "still", **turns) -> DataFrame:
    """The contrary of ``moved``, null in the same rows."""
    return moved(df, keys, t, values, threshold, steps, "__m", **turns).withColumn(out, ~F.col("__m")).drop("__m")


def net_displacement(df: DataFrame, keys: list[str], t: str, values: list[str], back: int, out: str = "displacement") -> DataFrame:
    """The distance to the place ``back`` rows before; null where there is none."""
    w = Window.partitionBy(*keys).orderBy(t)
    total = sum(((F.col(c) - F.lag(c, back).over(w)) * (F.col(c) - F.lag(c, back).over(w)) for c in values), F.lit(0.0))
    return df.withColumn(out, F.sqrt(total))


def ahead(df: DataFrame, keys: list[str], t: str, value: str, offsets: dict[str, int]) -> DataFrame:
    """Adds the value some rows ahead, for each (column, offset)."""
    w = Window.partitionBy(*keys).orderBy(t)
    return df.withColumns({name: F.lead(value, k).over(w) for name, k in offsets.items()})


def first_where(df: DataFrame, keys: list[str], order: list[str], condition: Column, columns: list[str]) -> DataFrame:
    """The first row of each key that meets the condition: a partial aggregate, not a sort. Keys without one have no row."""
    best = F.min(F.struct(*order, *[c for c in columns if c not in order])).alias("__first")
    kept = [*order, *[c for c in columns if c not in order]]
    return df.where(condition).groupBy(*keys).agg(best).select(*keys, *[F.col(f"__first.{c}").alias(c) for c in kept])


def angular_velocity(df: DataFrame, keys: list[str], t: str, q: str, out: str = "omega") -> DataFrame:
    """Rotation rate about the axis, from unit quaternions (x, y, z, w) of neighbouring rows; one-sided at the ends.

    Signs are first made continuous: a quaternion is negated where an odd number of neighbours before it oppose each other.
    """
    from ..functions import geometry as G

    w = Window.partitionBy(*keys).orderBy(t)
    dot = G.dot4(F.col(q), F.lag(q).over(w))
    df = df.withColumn("__flip", F.when(dot < 0, 1).otherwise(0))
    parity = F.sum("__flip").over(w.rowsBetween(Window.unboundedPreceding, 0)) % 2
    df = df.withColumn("__q", F.when(parity == 1, G.scale4(F.col(q), F.lit(-1.0))).otherwise(F.col(q)))
    before, after = F.coalesce(F.lag("__q").over(w), F.col("__q")), F.coalesce(F.lead("__q").over(w), F.col("__q"))
    dt = F.coalesce(F.lead(t).over(w), F.col(t)) - F.coalesce(F.lag(t).over(w), F.col(t))
    df = df.withColumn("__turn", G.quat_mul(G.quat_conj(before), after)).withColumn("__dt", dt)
    return df.withColumn(out, F.transform(G.rotation_vector(F.col("__turn")), lambda x: F.try_divide(x, F.col("__dt")))).drop("__flip", "__q", "__turn", "__dt")


def motion(df: DataFrame, keys: list[str], t: str, values: list[str], mass: Column) -> DataFrame:
    """Adds speed, tangential and normal acceleration (a_t, a_n), jerk, curvature, momentum and kinetic energy of a point.

    ``values`` are two or three coordinates. Velocity, acceleration and jerk are second-order gradients, each of the one
    before; a point at rest has no direction, so its a_t and curvature are zero.
    """
    source = list(values)
    for level in "vaj":
        for c, of in zip(values, source):
            df = central_gradient(df, keys, t, of, f"{level}_{c}")
        source = [f"{level}_{c}" for c in values]
    v, a, j = ([F.col(f"{level}_{c}") for c in values] for level in "vaj")
    dot = lambda x, y: sum((p * q for p, q in zip(x, y)), F.lit(0.0))
    df = df.withColumn("speed", F.sqrt(dot(v, v)))
    moves = F.col("speed") > 1e-12
    df = df.withColumn("a_t", F.when(moves, F.try_divide(dot(a, v), F.col("speed"))).when(F.col("speed").isNotNull(), 0.0))
    turns = [(p, q) for p in range(len(values)) for q in range(p + 1, len(values))]
    cross = F.sqrt(sum(((v[p] * a[q] - v[q] * a[p]) * (v[p] * a[q] - v[q] * a[p]) for p, q in turns), F.lit(0.0)))
    return df.withColumns({
        "a_n": F.sqrt(F.greatest(F.lit(0.0), dot(a, a) - F.col("a_t") * F.col("a_t"))), "jerk": F.sqrt(dot(j, j)),
        "curvature": F.when(moves, F.try_divide(cross, F.col("speed") * F.col("speed") * F.col("speed"))).when(F.col("speed").isNotNull(), 0.0),
        "momentum": mass * F.col("speed"), "kinetic": mass * F.col("speed") * F.col("speed") / 2,
    })


def three_samples(df: DataFrame, keys: list[str], t: str, value: str) -> DataFrame:
    """Adds v and a: central first and second differences over a row and its neighbours; null at the ends."""
    w = Window.partitionBy(*keys).orderBy(t)
    before, after, span = F.lag(value).over(w), F.lead(value).over(w), F.lead(t).over(w) - F.lag(t).over(w)
    return df.withColumns({"v": F.try_divide(after - before, span), "a": F.try_divide(after - 2 * F.col(value) + before, span / 2 * (span / 2))})
