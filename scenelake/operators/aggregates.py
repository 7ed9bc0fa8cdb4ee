"""Evaluation marts: accuracies, hierarchies, pivots, histograms and correlations as partial aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def accuracy(df: DataFrame, by: list[str], correct: Column) -> DataFrame:
    """Rows, correct ones and their share for each group; null groups stay."""
    hits = F.sum(correct.cast("long"))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.coalesce(hits, F.lit(0)).alias("correct"), F.try_divide(F.coalesce(hits, F.lit(0)), F.count(F.lit(1))).alias("accuracy"))


def balanced_accuracy(df: DataFrame, by: list[str], levels: list[str], correct: Column) -> DataFrame:
    """The mean of means down ``levels``, so that each member of a level weighs the same."""
    out = df.groupBy(*by, *levels).agg(F.avg(correct.cast("double")).alias("accuracy"))
    for k in range(len(levels) - 1, -1, -1):
        out = out.groupBy(*by, *levels[:k]).agg(F.avg("accuracy").alias("accuracy"))
    return out


def margins(df: DataFrame, row: str, column: str, value: Column, total: str = "Total") -> DataFrame:
    """Means of a value by row and column, with totals over either and both, in one aggregate over grouping sets."""
    grouped = df.cube(row, column).agg(F.sum(value).alias("__s"), F.count(value).alias("__n"), F.grouping(row).alias("__r"), F.grouping(column).alias("__c"))
    named = lambda c, flag: F.when(F.col(flag) == 1, total).otherwise(F.coalesce(F.col(c).cast("string"), F.lit("<MISSING>"))).alias(c)
    return grouped.select(named(row, "__r"), named(column, "__c"), F.col("__n").alias("n"), F.try_divide(F.col("__s"), F.col("__n")).alias("mean"))


def confusion(df: DataFrame, by: list[str], truth: str, predicted: str, values: list[str]) -> DataFrame:
    """Counts of predictions, a column for each value."""
    return df.groupBy(*by, truth).pivot(predicted, values).agg(F.count(F.lit(1))).na.fill(0, values)


def histogram(df: DataFrame, by: list[str], value: str, width: int = 40) -> DataFrame:
    """Counts, shares and a bar for each value, within each group."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("__total")) if by else counts.agg(F.sum("n").alias("__total"))
    joined = counts.join(totals.withColumnsRenamed({b: f"__{b}" for b in by}), on=[counts[b].eqNullSafe(F.col(f"__{b}")) for b in by], how="inner") if by else counts.crossJoin(totals)  # a row for each group, or one
    share = F.try_divide(F.col("n"), F.col("__total"))
    return joined.select(*by, value, "n", share.alias("share"), F.repeat(F.lit("#"), F.floor(share * width).cast("int")).alias("bar"))


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.countDistinct(c).alias(c) for c in columns])


def best(df: DataFrame, by: list[str], metric: str, columns: list[str], ties: list[str], largest: bool = True) -> DataFrame:
    """The row with the largest or smallest metric of each group; the first by ``ties`` wins. Null metrics never do."""
    key = F.struct((-F.col(metric) if largest else F.col(metric)).alias("__k"), *ties)
    return df.where(F.col(metric).isNotNull()).groupBy(*by).agg(F.min_by(F.struct(metric, *columns), key).alias("__b")).select(*by, F.col(f"__b.{metric}").alias(metric), *[F.col(f"__b.{c}").alias(c) for c in columns])


def with_margin(df: DataFrame, by: list[str], metric: str, column: str, margin: float, largest: bool = True) -> DataFrame:
    """The extreme row of each group, if it leads the second by at least ``margin`` times the smaller of both; lone rows lead."""
    order = F.desc(metric) if largest else F.asc(metric)
    w = Window.partitionBy(*by).orderBy(order, column)
    top = df.where(F.col(metric).isNotNull()).withColumn("__k", F.row_number().over(w)).where("__k <= 2")
    out = top.groupBy(*by).agg(F.max(F.when(F.col("__k") == 1, F.col(metric))).alias("first"), F.max(F.when(F.col("__k") == 2, F.col(metric))).alias("second"), F.max(F.when(F.col("__k") == 1, F.col(column))).alias(column))
    lead = F.abs(F.col("first") - F.col("second"))
    return out.where(F.col("second").isNull() | (lead >= margin * F.least("first", "second"))).select(*by, column, "first", "second")


def pearson(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("r"))


def line(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """The least-squares line of y on x for each group."""
    return df.groupBy(*by).agg(F.regr_count(y, x).alias("n"), F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.regr_intercept(F.col(y), F.col(x)).alias("intercept"), F.regr_r2(F.col(y), F.col(x)).alias("r2"))


def residuals(df: DataFrame, by: list[str], x: str, y: str, out: str = "residual") -> DataFrame:
    """Adds each row's distance to its group's line; the lines are one row a group."""
    lines = line(df, by, x, y).select(*[F.col(b).alias(f"__{b}") for b in by], "slope", "intercept")
    joined = df.join(lines, [df[b].eqNullSafe(lines[f"__{b}"]) for b in by]) if by else df.crossJoin(lines)
    return joined.withColumn(out, F.col(y) - (F.col("slope") * F.col(x) + F.col("intercept"))).drop("slope", "intercept", *[f"__{b}" for b in by])


def percentiles(df: DataFrame, by: list[str], value: str, shares: list[float], accuracy: int = 10_000) -> DataFrame:
    """(by, n, quantiles): exact quantiles of the non-null values of each group, with linear interpolation.

    A first pass takes sketches of bounded size, whose ranks are off by n / ``accuracy`` at most. They bracket every
    quantile; a second pass counts what lies below a bracket and, by value, what lies in it. Only those counts are put
    in order, some 4 n / ``accuracy`` values a quantile, and equal values are one. A bracket that misses its quantile
    raises an error. Null is a group like others; groups without a value have no row.
    """
    keys = [f"__b{i}" for i in range(len(by))]
    rows = df.where(F.col(value).isNotNull()).select(*[F.col(b).alias(k) for b, k in zip(by, keys)], F.col(value).cast("double").alias("__v"))
    wide = 2.0 / accuracy
    edges = [min(1.0, max(0.0, x)) for p in shares for x in (p - wide, p + wide)]
    sketch = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("__v", edges, accuracy).alias("__e"), F.min("__v").alias("__min"), F.max("__v").alias("__max"))
    few = F.col("n") <= accuracy  # then a bracket is the whole group, which is no larger than a bracket of a large one
    low = lambda i, p: F.when(F.lit(p - wide <= 0) | few, F.col("__min")).otherwise(F.get("__e", F.lit(2 * i)))
    high = lambda i, p: F.when(F.lit(p + wide >= 1) | few, F.col("__max")).otherwise(F.get("__e", F.lit(2 * i + 1)))
    brackets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("p"), low(i, p).alias("lo"), high(i, p).alias("hi")) for i, p in enumerate(shares)])
    sketch = sketch.select(*[F.col(k).alias(f"r{k}") for k in keys], "n", brackets.alias("__b"))
    met = rows.join(sketch, [F.col(k).eqNullSafe(F.col(f"r{k}")) for k in keys]) if keys else rows.crossJoin(sketch)  # one row
    met = met.select(*keys, "n", "__v", F.explode("__b").alias("b")).where("__v <= b.hi")
    inside = F.when(F.col("__v") >= F.col("b.lo"), F.col("__v"))
    counts = met.groupBy(*keys, "n", "b.i", "b.p", inside.alias("v")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*keys, "i").orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("c").over(w)).withColumn("at", (F.col("n") - 1) * F.col("p"))
    held = lambda k: F.min(F.when((F.col("upto") > k) & (F.col("upto") - F.col("c") <= k), F.col("v")))
    k = F.floor(F.col("at") + 1e-9)
    two = ranked.groupBy(*keys, "n", "i", "p", "at").agg(held(k).alias("a"), held(F.least(k + 1, F.col("n") - 1)).alias("b"))
    share = F.col("at") - k
    lost = F.raise_error(F.lit("a bracket missed its quantile")).cast("double")
    q = F.when(F.col("a").isNull() | (F.col("b").isNull() & (share > 1e-9)), lost).when(share <= 1e-9, F.col("a")).otherwise(F.col("a") + share * (F.col("b") - F.col("a")))
    out = two.groupBy(*keys, "n").agg(F.array_sort(F.collect_list(F.struct("i", q.alias("q")))).alias("q"))
    return out.select(*[F.col(k).alias(b) for b, k in zip(by, keys)], "n", F.transform("q", lambda x: x["q"]).alias("quantiles"))


def describe(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles of each group; null is a group like others."""
    plain = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    q = percentiles(df, by, value, [0.25, 0.5, 0.75]).select(*[F.col(b).alias(f"__q{i}") for i, b in enumerate(by)], "quantiles")
    joined = plain.join(q, [F.col(b).eqNullSafe(F.col(f"__q{i}")) for i, b in enumerate(by)], "left") if by else plain.join(q, how="left")  # one row each
    at = lambda i: F.get("quantiles", F.lit(i))
    return joined.select(*by, "n", "mean", "std", "min", at(0).alias("q1"), at(1).alias("median"), at(2).alias("q3"), "max")


def two_level(df: DataFrame, by: list[str], inner: list[str], value: Column) -> DataFrame:
    """Mean, least and largest of the inner groups' means."""
    means = df.groupBy(*by, *inner).agg(F.avg(value).alias("__m"))
    return means.groupBy(*by).agg(F.avg("__m").alias("mean"), F.min("__m").alias("min"), F.max("__m").alias("max"), F.count(F.lit(1)).alias("groups"))


def duplicate_census(df: DataFrame, scene: str, name: str) -> DataFrame:
    """How many scenes hold some name more than once, out of how many."""
    per_scene = df.groupBy(scene, name).agg(F.count(F.lit(1)).alias("__n")).groupBy(scene).agg(F.max("__n").alias("__n"))
    return per_scene.agg(F.count(F.lit(1)).alias("scenes"), F.count_if(F.col("__n") > 1).alias("with_duplicates"), F.try_divide(F.count_if(F.col("__n") > 1), F.count(F.lit(1))).alias("share"))


def weighted_sums(df: DataFrame, group: str, member: str, weights: DataFrame, weight: str) -> DataFrame:
    """For each group the sum of the weights of its distinct members; ``weights`` is a small dimension keyed by ``member``."""
    return df.select(group, member).distinct().join(weights, member).groupBy(group).agg(F.sum(weight).alias("total"))
