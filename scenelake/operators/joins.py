"""Joins of the evaluation marts and of scene geometry. Sides are left to the optimiser, which broadcasts what is small."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordered


def star(facts: DataFrame, dimensions: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Left joins of a fact table to dimensions given as (table, key of the facts, key of the table)."""
    for table, own, other in dimensions:
        facts = facts.join(table, facts[own] == table[other], "left")
    return facts


def members(df: DataFrame, subset: DataFrame, key: str, other: str | None = None) -> DataFrame:
    """Rows whose key, as text, is in the subset."""
    return df.join(subset.select(F.col(other or key).cast("string").alias("__k")).distinct(), df[key].cast("string") == F.col("__k"), "left_semi")


def missing(df: DataFrame, found: DataFrame, key: str, other: str | None = None) -> DataFrame:
    """Rows whose key is not found."""
    return df.join(found.select(F.col(other or key).alias("__k")), df[key] == F.col("__k"), "left_anti")


def consistent(df: DataFrame, key: list[str], value: str, order: str) -> DataFrame:
    """One row a key with its first value, and whether all its rows agree."""
    return df.groupBy(*key).agg(F.min_by(value, F.struct(order, value)).alias(value), (F.count_distinct(value) <= 1).alias("agrees"))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays of numbers; what one of them lacks counts as 0."""
    d = F.zip_with(a, b, lambda x, y: F.pow(F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0)), F.lit(2.0)))
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x))


def pairs_within(df: DataFrame, scene: list[str], item: str, columns: list[str]) -> DataFrame:
    """Pairs of items of a scene, each once, with columns a_* and b_*. Scenes are small by nature: a step has few objects."""
    left = df.select(*scene, F.col(item).alias("a"), *[F.col(c).alias(f"a_{c}") for c in columns])
    right = df.select(*scene, F.col(item).alias("b"), *[F.col(c).alias(f"b_{c}") for c in columns])
    return left.join(right, scene).where("a < b")


def value_pairs(df: DataFrame, scene: list[str], item: str, value: str, measure: Callable[[Column, Column], Column], made: Callable[[Column], Column] = lambda x: x, *, most: int = 256, block: int = 2048, rows: int = 10_000_000) -> DataFrame:
    """(a, b, metric): every pair of items a < b of a scene with a symmetric measure of their values, which is worked out once for two values.

    ``measure`` takes what ``made`` has made of each distinct value of a scene. The items of a scene are cut in their
    order into blocks of about ``block``, and a block's items of one value are lists of at most ``most``. Any two blocks
    of a scene meet in one task, which writes out the pairs of their lists, so no task holds a scene or a value whole,
    and as blocks are in order a pair is written as it is met. There are as many tasks as ``rows`` pairs need, and as
    many before them as it takes for about 50,000 items each, however many blocks they go to.
    """
    named = [F.col(c).alias(f"__s{i}") for i, c in enumerate(scene)]
    places = [f"__s{i}" for i in range(len(scene))]
    items = df.where(F.col(item).isNotNull()).select(*named, F.col(item).alias("__i"), F.col(value).alias("__v")).dropna(subset=places)
    sizes = items.groupBy(*places).agg(F.count(F.lit(1)).alias("__n"))
    copies = F.col("__n") * F.ceil(F.col("__n") / block)
    pairs, sent = sizes.agg(F.sum(F.col("__n") * F.col("__n") / 2), F.sum(copies).cast("long")).first()
    tasks = max(1, math.ceil((pairs or 0) / rows))
    own = Window.partitionBy(*places)
    # equal items have one rank, so they are in one block and never taken for a pair
    dealt = ordered.dealt(items, *places, rows=sent or 0).withColumn("own", F.floor((F.rank().over(own.orderBy("__i")) - 1) / block).cast("int")).withColumn("__last", F.max("own").over(own))
    lists = dealt.groupBy(*places, "own", "__v").agg(F.collect_list("__i").alias("all"), F.first("__last").alias("__last"))
    lists = lists.select(*places, "own", "__last", "__v", made(F.col("__v")).alias("m"), "all", F.posexplode(F.sequence(F.lit(1), F.size("all"), F.lit(most))).alias("cut", "from"))
    lists = lists.select(*places, "own", "__last", F.struct("__v", "cut").alias("at"), "m", F.slice("all", F.col("from"), F.lit(most)).alias("items"))
    meet = [*places, "x", "y"]
    left = lists.withColumn("x", F.col("own")).withColumn("y", F.explode(F.sequence("own", "__last")))
    right = lists.withColumn("y", F.col("own")).withColumn("x", F.explode(F.sequence(F.lit(0), "own")))
    side = lambda t, k: t.select(*meet, *[F.col(c).alias(f"{c}_{k}") for c in ("at", "m", "items")]).repartition(tasks, *meet)
    met = side(left, 1).join(side(right, 2), meet).where("x < y or at_1 <= at_2")
    # measured in a step of its own, before the lists are written out; two lists of one block are written out both ways
    met = met.select("items_1", "items_2", (F.expr("x = y and at_1 < at_2")).alias("turn"), F.explode(F.array(measure(F.col("m_1"), F.col("m_2")))).alias("metric"))
    way = lambda p, q: F.struct(F.col(p).alias("p"), F.col(q).alias("q"))
    met = met.select("metric", F.inline(F.when(F.col("turn"), F.array(way("items_1", "items_2"), way("items_2", "items_1"))).otherwise(F.array(way("items_1", "items_2")))))
    met = met.select("q", "metric", F.explode("p").alias("a")).select("a", F.explode("q").alias("b"), "metric")
    return met.where("a < b")


def robust_distance(distances: Column) -> Column:
    """The distance to a point cloud from ascending neighbour distances: the median of the first five if the fifth is over
    three times the first, else the first."""
    m = F.least(F.lit(5), F.size(distances))
    first, last = F.get(distances, F.lit(0)), F.get(distances, m - 1)
    middle = (F.get(distances, F.floor((m - 1) / 2).cast("int")) + F.get(distances, F.floor(m / 2).cast("int"))) / 2
    return F.when(last > 3 * first, middle).otherwise(first)


def cloud_distance(points: DataFrame, cloud: DataFrame, scene: list[str], item: str, axes: tuple[str, str, str], cell: float, k: int = 20) -> DataFrame:
    """Robust distance of each item to the cloud of its scene from its ``k`` nearest cloud points.

    Both sides are keyed by a grid of ``cell`` metres, and items look into the 27 cells around their own, so the join
    is by equality. Items with fewer than ``k`` cloud points there are measured against their scene's whole cloud.
    """
    grid = [F.floor(F.col(a) / cell).cast("long") for a in axes]
    cells = cloud.select(*scene, *[g.alias(f"__g{i}") for i, g in enumerate(grid)], *[F.col(a).alias(f"__{a}") for a in axes])
    around = F.array(*[F.struct(*[F.lit(v).alias(f"d{i}") for i, v in enumerate((x, y, z))]) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)])
    asked = points.select(*scene, item, *axes, F.explode(around).alias("__d")).select(*scene, item, *axes, *[(g + F.col(f"__d.d{i}")).alias(f"__g{i}") for i, g in enumerate(grid)])
    gap = F.sqrt(sum(((F.col(a) - F.col(f"__{a}")) * (F.col(a) - F.col(f"__{a}")) for a in axes), F.lit(0.0)))
    w = Window.partitionBy(*scene, item).orderBy("__gap")

    def measured(joined: DataFrame) -> DataFrame:
        near = joined.withColumn("__gap", gap).withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= k)
        return near.groupBy(*scene, item).agg(F.array_sort(F.collect_list("__gap")).alias("__all"))

    quick = measured(asked.join(cells, [*scene, "__g0", "__g1", "__g2"])).where((F.size("__all") >= k) & (F.element_at("__all", -1) <= cell))
    rest = points.join(quick.select(*scene, item), [*scene, item], "left_anti")
    slow = measured(rest.select(*scene, item, *axes).join(cells, scene))
    return quick.unionByName(slow).select(*scene, item, robust_distance(F.col("__all")).alias("distance"))
