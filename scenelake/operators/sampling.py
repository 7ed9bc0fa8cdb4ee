"""Samples by hash order: allocation runs on counts of groups, and one ranked pass draws the rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import order_key
from . import allocation, ranks


def group_key(*cols: str) -> Column:
    """A composite key; null and empty parts are <MISSING>."""
    return F.concat_ws("|", *[F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("<MISSING>")) for c in cols])


def sizes(df: DataFrame, *cols: str) -> dict[str, int]:
    """Rows of each group; groups are few, so they come to the driver."""
    return {r["g"]: r["count"] for r in df.groupBy(group_key(*cols).alias("g")).count().collect()}


def draw(df: DataFrame, groups: list[str], takes: Mapping[str, int] | int, key: str, seed: int = 42) -> DataFrame:
    """The first rows of each group in hash order, as many as it takes; ties go by key."""
    if isinstance(takes, int):  # the limit is part of the plan, so tasks drop what is beyond it before the shuffle
        w = Window.partitionBy("__g").orderBy(order_key(seed, F.col(key)), key)
        return df.withColumn("__g", group_key(*groups)).withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= takes).drop("__g", "__k")
    limit = df.sparkSession.createDataFrame(list(takes.items()) or [("", 0)], "__t string, __take long")
    keyed = df.withColumn("__t", group_key(*groups)).join(limit.where("__take > 0"), "__t")
    ranked = ranks.ordinal(keyed, ["__t"], [order_key(seed, F.col(key)), key], "__k")
    return ranked.where("__k <= __take").select(*df.columns)


def even(df: DataFrame, groups: list[str], target: int, key: str, seed: int = 42) -> DataFrame:
    return draw(df, groups, allocation.even(target, sizes(df, *groups)), key, seed)


def percentage(df: DataFrame, groups: list[str], fractions: Mapping[str, float], target: int | None, key: str, seed: int = 42) -> DataFrame:
    return draw(df, groups, allocation.percentages(target, fractions, sizes(df, *groups)), key, seed)


def percentage_with_modes(df: DataFrame, group: str, mode: str, fractions: Mapping[str, float], ratio: Mapping[str, float], target: int, key: str, seed: int = 42) -> DataFrame:
    """Shares by group and a ratio of modes at once; raises where no assignment meets both."""
    counts = {(r[0], r[1]): r[2] for r in df.groupBy(group_key(mode), group_key(group)).count().collect()}  # modes times groups
    by_group: dict[str, int] = {}
    by_mode: dict[str, int] = {}
    for (m, g), n in counts.items():
        by_group[g] = by_group.get(g, 0) + n
        by_mode[m] = by_mode.get(m, 0) + n
    takes = allocation.percentages(target, fractions, by_group)
    modes = allocation.mode_targets(sum(takes.values()), ratio, by_mode)
    flow = allocation.assign_modes(takes, modes, {k: n for k, n in counts.items() if k[0] in modes})
    return draw(df, [mode, group], {f"{m}|{g}": n for (m, g), n in flow.items()}, key, seed)


def bundles(df: DataFrame, bundle: str, n: int, seed: int = 42) -> DataFrame:
    """All rows of ``n`` bundles chosen by hash."""
    chosen = df.select(bundle).distinct().orderBy(order_key(seed, F.col(bundle)), bundle).limit(n)
    return df.join(chosen, bundle, "left_semi")


def closure(df: DataFrame, sample: DataFrame, bundle: Column) -> DataFrame:
    """The sample with all rows of ``df`` that share a bundle with one of its rows."""
    return df.withColumn("__b", bundle).join(sample.select(bundle.alias("__b")).distinct(), "__b", "left_semi").drop("__b")


def closed_trim(df: DataFrame, sample: DataFrame, bundle: Column, group: str, target: int, seed: int = 42) -> DataFrame:
    """``closure`` cut back to at most ``target`` rows: whole bundles go, those of the groups furthest over their share first, then by hash."""
    full = closure(df, sample, bundle).withColumn("__b", bundle)
    takes = sizes(sample, group)
    per = full.groupBy("__b").agg(F.count(F.lit(1)).alias("n"), F.min(group_key(group)).alias("g"))
    over = {r["g"]: r["n"] - takes.get(r["g"], 0) for r in per.groupBy("g").agg(F.sum("n").alias("n")).collect()}
    rank = F.coalesce(*[F.when(F.col("g") == g, F.lit(x)) for g, x in over.items()], F.lit(0))
    # bundles in the order in which they stay, added up by ranges of that order
    stay = ranks.running(per.select("__b", "n", rank.alias("r")), [], ["r", order_key(seed, F.col("__b")), "__b"], F.col("n"), "s").where(F.col("s") <= target).select("__b")
    return full.join(stay, "__b", "left_semi").drop("__b")


def ratio_report(df: DataFrame, mode: str, targets: Mapping[str, int]) -> DataFrame:
    """For each mode its count, target, and whether they differ by at most one or one per cent."""
    want = df.sparkSession.createDataFrame(list(targets.items()), f"{mode} string, target long")
    got = df.groupBy(mode).agg(F.count(F.lit(1)).alias("n"))
    out = want.join(got, mode, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("ok", F.abs(F.col("n") - F.col("target")) <= F.greatest(F.lit(1.0), F.col("target") * 0.01))
