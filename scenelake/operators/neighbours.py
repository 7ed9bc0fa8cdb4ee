"""Exact nearest neighbours in any number of dimensions, with cells around pivots that the triangle inequality rules out."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import stage
from . import blocks


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of two matrices; what one lacks counts as 0."""
    x, y = np.nan_to_num(x), np.nan_to_num(y)
    return np.sqrt(((x[:, None, :] - y[None, :, :]) ** 2).sum(-1))


def near_first(k: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Distances of which each query's ``k`` + 1 smallest, and all ties of these, are exact; those that are surely larger are NaN.

    Squares come from one matrix product first; only rows within its rounding error of the last place are measured.
    One place more is kept, as a query may meet itself.
    """

    def kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        x, y = np.nan_to_num(x), np.nan_to_num(y)
        if y.shape[0] <= k + 1:
            return distances(x, y)
        xx, yy = (x * x).sum(1), (y * y).sum(1)
        both = xx[:, None] + yy[None, :]
        rough = both - 2 * (x @ y.T)
        both *= 4 * (x.shape[1] + 4) * np.finfo(float).eps  # what a product of this length, and the measured squares, may be off
        edge = np.partition(rough + both, k, axis=1)[:, k]
        if not np.isfinite(edge).all():  # too large to square, or no numbers: measured one by one
            return distances(x, y)
        i, j = np.nonzero(rough - both <= edge[:, None])
        out = np.full(rough.shape, np.nan)
        for at in range(0, len(i), 1 << 15):  # ties may be many
            p, q = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
            out[p, q] = np.sqrt(((x[p] - y[q]) ** 2).sum(-1))
        return out

    return kernel


def nearest(df: DataFrame, scene: list[str], item: str, vector: str, k: int = 1, *, pivots: int = 16, large: int = 4096, block: int = 2048) -> DataFrame:
    """(scene, a, b, distance, rank): the ``k`` nearest other items of the same scene; ties go by item.

    Items are long and unique in their scene. Scenes of up to ``large`` items are compared block by block. Larger ones
    are cut into cells around ``pivots`` of their items, chosen by hash: every item belongs to its nearest pivot. An
    item first asks its own cell; the k-th distance found there bounds the rest, since an item of a cell of radius r
    around a pivot at distance d is at least d - r away, and at least half of what d exceeds the own pivot's distance by.
    Only cells that may hold something nearer are asked. No task sees more than two blocks, and no pair is ever a row.
    """
    places = [f"__s{i}" for i in range(len(scene))]
    kind = {c: df.schema[c].dataType.simpleString() for c in scene}
    rows = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("<MISSING>")).alias(p) for c, p in zip(scene, places)], *scene, F.col(item).cast("long").alias("a"), F.col(vector).alias("va"))
    sizes = rows.groupBy(*places).agg(F.count(F.lit(1)).alias("__n"))
    sized = rows.join(sizes, places)
    small, big = sized.where(F.col("__n") <= large).drop("__n"), sized.where(F.col("__n") > large)
    answered = lambda got: got.select(*scene, "a", "b", F.col("metric").alias("distance"), "rank")
    plain = blocks.smallest(small.drop(*places), small.select(*scene, F.col("a").alias("b"), F.col("va").alias("vb")), scene, near_first(k), k, block, 1 << 27)
    if sizes.where(F.col("__n") > large).isEmpty():
        return answered(plain)

    # pivots: a bounded number of items for each large scene
    by_hash = Window.partitionBy(*places).orderBy(F.xxhash64("a"), "a")
    chosen = big.withColumn("__k", F.row_number().over(by_hash)).where(F.col("__k") <= pivots)
    chosen = chosen.groupBy(*places).agg(F.collect_list("va").alias("pv"), F.first("__n").alias("__n"))
    chosen = stage.staged(chosen)
    salts = chosen.withColumn("salt", F.explode(F.sequence(F.lit(0), F.ceil(F.col("__n") / block).cast("int") - 1))).drop("__n")
    salted = big.withColumn("salt", F.pmod(F.xxhash64("a"), F.ceil(F.col("__n") / block)).cast("int")).drop("__n")
    key = [*places, "salt"]
    schema = ", ".join([*(f"{p} string" for p in places), *(f"`{c}` {kind[c]}" for c in scene), "a long, va array<double>, cell int, away double, gaps array<double>"])

    def place(own: pd.DataFrame, pv: pd.DataFrame) -> pd.DataFrame:
        x, p = blocks.matrix(own["va"]), blocks.matrix(pd.Series(list(pv["pv"].iloc[0]) if len(pv) else []))
        width = max(x.shape[1], p.shape[1])
        x, p = (np.pad(z, ((0, 0), (0, width - z.shape[1])), constant_values=np.nan) for z in (x, p))
        gaps = np.concatenate([distances(x[i : i + 256], p) for i in range(0, len(x), 256)]) if len(x) else np.zeros((0, len(p)))
        cell = gaps.argmin(1) if len(x) else np.zeros(0, int)
        return own[[*places, *scene, "a", "va"]].assign(cell=cell.astype(np.int32), away=gaps[np.arange(len(x)), cell], gaps=list(gaps))

    celled = stage.staged(salted.groupBy(*key).cogroup(salts.groupBy(*key)).applyInPandas(place, schema))  # read by all that follows
    cells = celled.groupBy(*places, "cell").agg(F.max("away").alias("radius"))
    radii = cells.groupBy(*places).agg(F.map_from_entries(F.collect_list(F.struct("cell", "radius"))).alias("radii"))
    targets = celled.select(*places, "cell", F.col("a").alias("b"), F.col("va").alias("vb"))
    spot = [*places, "cell"]
    own = blocks.smallest(celled.select(*spot, "a", "va"), targets, spot, near_first(k), k, block, 1 << 27)
    bound = own.groupBy(*places, "a").agg(F.max("metric").alias("far"), F.count(F.lit(1)).alias("found"))
    asking = celled.join(bound, [*places, "a"], "left").join(radii, places)
    reach = F.when(F.col("found") >= k, F.col("far") * (1 + 1e-12)).otherwise(F.lit(float("inf")))
    other = F.filter(F.map_entries("radii"), lambda e: (e["key"] != F.col("cell")) & (F.greatest(F.get("gaps", e["key"]) - e["value"], (F.get("gaps", e["key"]) - F.col("away")) / 2) * (1 - 1e-12) <= reach))
    rest = asking.select(*places, "a", "va", F.explode(other).alias("e")).select(*places, F.col("e.key").alias("cell"), "a", "va")
    more = blocks.smallest(rest, targets, spot, near_first(k), k, block, 1 << 27)
    w = Window.partitionBy(*places, "a").orderBy("metric", "b")
    both = own.unionByName(more).select(*places, "a", "b", "metric").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    back = celled.select(*places, *scene, "a")
    return answered(plain.select(*scene, "a", "b", "metric", "rank")).unionByName(answered(both.join(back, [*places, "a"])))
