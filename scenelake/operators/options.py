"""Multiple-choice options: every list holds the truth once, and its order is a hash, so no random state is needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import let
from ..functions.hashing import order_key, shuffle, uniform


def fixed(x: Column, decimals: int) -> Column:
    return F.format_string(f"%.{decimals}f", x)


def _with_truth(wrong: Column, truth: Column, need: int, seed, *key: Column) -> Column:
    """Shuffled labels of the truth and the first ``need`` wrong ones; null if there are too few or two look the same."""
    whole = lambda labels: F.when((F.size(labels) == need + 1) & (F.size(F.array_distinct(labels)) == need + 1), shuffle(labels, seed, *key))
    return let(truth, lambda t: let(F.concat(F.array(t), F.slice(F.filter(wrong, lambda x: x != t), 1, need)), whole))


def integer_options(truth: Column, low: int, high: int, seed, *key: Column, need: int = 3) -> Column:
    """Neighbours of an integer within bounds: those nearest to it, ``need`` + 2 of them, of which the first by hash are taken."""
    near = F.filter(F.sequence(F.lit(low), F.lit(high)), lambda x: x != truth)
    near = F.transform(F.array_sort(F.transform(near, lambda x: F.struct(F.abs(x - truth).alias("d"), x.alias("x")))), lambda s: s["x"].cast("string"))
    return _with_truth(shuffle(F.slice(near, 1, need + 2), seed, *key), truth.cast("string"), need, seed, *key)


def numeric_options(truth: Column, seed, *key: Column, decimals: int = 2, low: float | None = None, high: float | None = None, apart: float = 0.0, slope: tuple[float, float] = (1.5, 4.0), need: int = 3) -> Column:
    """Scaled copies (x + s) / s of a number for x in -3..3, x <> 0, with a slope s by hash (0.4 under 1); the first three in bounds.

    Near zero the wrong ones are 2.5, 5 and 10.
    """
    s = F.when(F.abs(truth) < 1, F.lit(0.4)).otherwise(uniform(seed, *key, low=slope[0], high=slope[1]))
    scaled = let(s, lambda s: F.transform(F.array(*[F.lit(float(x)) for x in (-3, -2, -1, 1, 2, 3)]), lambda x: (x + s) / s * truth))
    ok = lambda x: (F.abs(x - truth) > apart) & (x >= low if low is not None else F.lit(True)) & (x <= high if high is not None else F.lit(True))
    wrong = F.when(F.abs(truth) < 0.04, F.array(F.lit(2.5), F.lit(5.0), F.lit(10.0))).otherwise(F.filter(scaled, ok))
    return _with_truth(F.transform(wrong, lambda x: fixed(x, decimals)), fixed(truth, decimals), need, seed, *key)


def log_options(truth: Column, seed, *key: Column, least: float = 10_000.0, need: int = 3) -> Column:
    """Copies of a positive number a few powers of ten away, over ``least``; null for numbers that are not positive."""
    scaled = F.transform(F.array(*[F.lit(10.0**k) for k in (-5, -4, -3, -2, -1, 1, 2, 3, 4, 5)]), lambda x: x * truth)
    text = lambda x: F.format_string("%.2e", x)
    return F.when(truth > 0, _with_truth(F.transform(F.filter(scaled, lambda x: x > least), text), text(truth), need, seed, *key))


def ratio_options(truth: Column, seed, *key: Column, high: float = 0.5, need: int = 3) -> Column:
    """Options for a Poisson ratio: (x + 3) / 3 of it for x in -3..3, x <> 0, between 0 and ``high``."""
    scaled = F.transform(F.array(*[F.lit(float(x)) for x in (-3, -2, -1, 1, 2, 3)]), lambda x: (x + 3) / 3 * truth)
    return _with_truth(F.transform(F.filter(scaled, lambda x: (x >= 0) & (x <= high)), lambda x: fixed(x, 2)), fixed(truth, 2), need, seed, *key)


def listed_options(truth: Column, present: Column, catalogue: Column, seed, *key: Column, need: int = 3) -> Column:
    """Names for a name: those present first, then others of the catalogue, each in hash order."""
    others = F.array_except(F.array_distinct(catalogue), present)
    return _with_truth(F.concat(shuffle(F.array_distinct(present), seed, *key), shuffle(others, seed, *key)), truth, need, seed, *key)


def categorical_options(df: DataFrame, scene: list[str], truth: str, tier: str, name: str, seed: int = 42, need: int = 3) -> DataFrame:
    """The same over rows: of candidates (scene, truth, tier, name), the ``need`` of the lowest tier and then hash; short lists are dropped."""
    w = Window.partitionBy(*scene, truth).orderBy(tier, order_key(seed, F.col(name)), name)
    best = df.where(F.col(name) != F.col(truth)).groupBy(*scene, truth, name).agg(F.min(tier).alias(tier))
    best = best.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= need)
    out = best.groupBy(*scene, truth).agg(F.array_sort(F.collect_list(F.struct("__k", name))).alias("__w")).where(F.size("__w") == need)
    labels = F.concat(F.array(F.col(truth)), F.transform("__w", lambda s: s[name]))
    return out.select(*scene, truth, shuffle(labels, seed, *[F.col(c) for c in scene]).alias("labels"))


def uniform_labels(values: Column, digits: int = 3) -> Column:
    """Numbers with the same decimals: enough for ``digits`` significant ones of the largest, three at most, and up to six where two would look the same."""
    top = F.aggregate(values, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x.cast("double"))))
    at = lambda d: F.transform(values, lambda x: F.format_string(f"%.{d}f", x.cast("double")))
    own = F.when(top > 0, F.lit(digits - 1) - F.floor(F.log10(top))).otherwise(F.lit(digits - 1))
    least = F.least(F.lit(3), F.greatest(F.lit(0), own))
    apart = lambda d: F.size(F.array_distinct(at(d))) == F.size(values)
    first = F.coalesce(*[F.when(least == d, at(d)) for d in range(4)])
    wider = [F.when((least < d) & apart(d), at(d)) for d in range(1, 7)]
    return F.when(F.size(F.array_distinct(first)) == F.size(values), first).otherwise(F.coalesce(*wider, first))


def options_for(truth: Column, seed, *key: Column, integer: bool = False, low: float | None = None, high: float | None = None, decimals: int | None = None, need: int = 3) -> Column:
    """Labels for a number: neighbours of a whole number (0 to 9 unless bounded), else scaled copies, with given or fitting decimals."""
    if integer:
        return integer_options(F.round(truth).cast("int"), int(low if low is not None else 0), int(high if high is not None else 9), seed, *key, need=need)
    if decimals is not None:
        return numeric_options(truth, seed, *key, decimals=decimals, low=low, high=high, need=need)
    wide = numeric_options(truth, seed, *key, decimals=6, low=low, high=high, need=need)
    return F.when(wide.isNotNull(), uniform_labels(F.transform(wide, lambda x: x.cast("double"))))


def correct_index(labels: Column, truth: Column) -> Column:
    return (F.array_position(labels, truth) - 1).cast("int")
