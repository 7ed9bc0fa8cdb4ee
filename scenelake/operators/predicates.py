"""Named predicates and classes; the three visibility rules differ on purpose in how they treat the thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT


def visible(fraction: Column, pixels: Column, rule: str = "canonical", min_fraction: float = DEFAULT.min_visible_fraction, min_pixels: float = DEFAULT.min_pixels) -> Column:
    """``canonical``: fraction >, pixels >=; ``strict``: both >; ``mass``: fraction >=, pixels >."""
    if rule == "canonical":
        return (fraction > min_fraction) & (pixels >= min_pixels)
    if rule == "strict":
        return (fraction > min_fraction) & (pixels > min_pixels)
    if rule == "mass":
        return (fraction >= min_fraction) & (pixels > min_pixels)
    raise ValueError(rule)


def touches_ground(a: Column, b: Column) -> Column:
    """Id 0 is the static scene."""
    return (a == 0) | (b == 0)


def between_objects(a: Column, b: Column) -> Column:
    return (a != 0) & (b != 0)


def unique_in_scene(df: DataFrame, scene: list[str], model: str) -> DataFrame:
    """Rows whose model occurs once in their scene."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*scene, model))
    return df.withColumn("__n", n).where("__n = 1").drop("__n")


def every_step_has(df: DataFrame, scene: list[str], step: str, condition: Column, least: int) -> DataFrame:
    """For each scene whether every step has at least ``least`` rows that meet the condition."""
    per_step = df.groupBy(*scene, step).agg(F.count_if(condition).alias("__n"))
    return per_step.groupBy(*scene).agg(F.every(F.col("__n") >= least).alias("ok"))


def quarter_class(percent: Column) -> Column:
    """The visibility class of a percentage."""
    return F.when(percent < 25, "0-25").when(percent < 50, "25-50").when(percent < 75, "50-75").otherwise("75-100")


def angle_class(pitch: Column) -> Column:
    """The camera angle of a pitch in degrees."""
    return F.when(pitch <= -60, "top-down").when(pitch <= -15, "high angle").when(pitch < 15, "eye level").when(pitch < 60, "low angle").otherwise("bottom-up")


def focal_class(hfov: Column) -> Column:
    """The lens of a horizontal field of view in degrees."""
    return F.when(hfov >= 100, "ultra-wide").when(hfov >= 60, "wide").when(hfov >= 20, "standard").otherwise("telephoto")


def contains_any(col: Column, fragments: list[str]) -> Column:
    """Whether a string contains any of the fragments, taken literally."""
    out = F.lit(False)
    for f in fragments:
        out = out | col.contains(f)
    return out


def mode_of(*candidates: Column) -> Column:
    """The first non-blank candidate as ``image-only`` or ``general``; blank everywhere means image-only."""
    text = F.coalesce(*[F.nullif(F.lower(F.trim(c)), F.lit("")) for c in candidates])
    return F.when(text.isNull() | text.isin("i", "image", "image-only", "image_only"), "image-only").when(text.isin("g", "general", "video"), "general").otherwise(text)
