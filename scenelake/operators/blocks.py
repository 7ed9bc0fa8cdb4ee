"""A stated set of queries against all rows of their place, block by block: no pair of rows is ever a row of a table."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Values of queries (n, d) and rows (m, d), all of one length; null components are NaN. Returns (n, m).
Kernel = Callable[[np.ndarray, np.ndarray], np.ndarray]


def matrix(vectors: pd.Series) -> np.ndarray:
    """Vectors as the rows of a matrix, filled up with NaN; nulls in a vector are NaN."""
    width = max((len(v) for v in vectors if v is not None), default=0)
    out = np.full((len(vectors), width), np.nan)
    for i, v in enumerate(vectors):
        if v is not None:
            out[i, : len(v)] = np.asarray(v, dtype=float)
    return out


def first_of(metric: np.ndarray, asked: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The places (i, j) of each query's k smallest values, ties by the row's id; NaN and the query itself never count."""
    metric = np.where(np.isnan(metric) | (asked[:, None] == rows[None, :]), np.inf, metric)
    near = min(k, metric.shape[1]) - 1
    edge = np.partition(metric, near, axis=1)[:, near : near + 1]  # ties at the edge stay in until the ids decide
    i, j = np.nonzero((metric <= edge) & np.isfinite(metric))
    order = np.lexsort((rows[j], metric[i, j], i))
    i, j = i[order], j[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i, "left") < k
    return i[keep], j[keep]


def smallest(queries: DataFrame, rows: DataFrame, place: list[str], kernel: Kernel, k: int, block: int = 2048, part: int = 1 << 22) -> DataFrame:
    """(place, a, b, metric, rank): for each query ``a`` the ``k`` rows ``b`` of its place with the smallest metric.

    ``queries`` has the place, a long ``a`` and a vector ``va``, ``rows`` the place, ``b`` and ``vb``; equal ids never
    meet. Ties go by ``b``; rows whose metric is null do not count. A place of n rows and m queries is cut by hash into
    n / block and m / block blocks that meet in a task each and give back k rows a query, so a task holds two blocks
    however large the place is. Null parts of a place are one place.
    """
    cut = lambda df, item, n: df.withColumn("__n", F.greatest(F.lit(1), F.ceil(F.col(n) / block)).cast("int")).withColumn(f"__{item}", F.pmod(F.xxhash64(item), F.col("__n")).cast("int")).drop("__n")
    places = [f"__p{i}" for i in range(len(place))]
    named = lambda df: df.withColumns({p: F.coalesce(F.col(c).cast("string"), F.lit("<MISSING>")) for p, c in zip(places, place)})
    rows, queries = named(rows), named(queries)
    counts = rows.groupBy(*places).agg(F.count(F.lit(1)).alias("__rows"), F.lit(0).alias("__queries")).unionByName(queries.groupBy(*places).agg(F.lit(0).alias("__rows"), F.count(F.lit(1)).alias("__queries")))
    counts = counts.groupBy(*places).agg(F.sum("__rows").alias("__rows"), F.sum("__queries").alias("__queries")).where("__rows > 0 and __queries > 0")
    others = lambda n: F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.col(n) / block)).cast("int") - 1))
    left = cut(queries.join(counts, places), "a", "__queries").withColumn("__b", others("__rows")).select(*places, "__a", "__b", *place, "a", "va")
    right = cut(rows.join(counts, places), "b", "__rows").withColumn("__a", others("__queries")).select(*places, "__a", "__b", "b", "vb")
    key = [*places, "__a", "__b"]
    kinds = [(c, queries.schema[c].dataType.simpleString()) for c in place]
    schema = ", ".join([*(f"`{c}` {kind}" for c, kind in kinds), "a long, b long, metric double"])

    def meet(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(r):
            x, y = matrix(q["va"]), matrix(r["vb"])
            width = max(x.shape[1], y.shape[1])
            x, y = (np.pad(z, ((0, 0), (0, width - z.shape[1])), constant_values=np.nan) for z in (x, y))
            step = max(1, part // max(1, len(r) * max(1, width)))
            ids, rows_ = q["a"].to_numpy(), r["b"].to_numpy()
            for at in range(0, len(q), step):
                metric = kernel(x[at : at + step], y)
                i, j = first_of(metric, ids[at : at + step], rows_, k)
                out.append(q[place].iloc[i + at].assign(a=ids[i + at], b=rows_[j], metric=metric[i, j]))
        return pd.concat(out) if out else q[place].iloc[:0].assign(a=pd.Series(dtype="int64"), b=pd.Series(dtype="int64"), metric=pd.Series(dtype="float64"))

    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(meet, schema)
    w = Window.partitionBy(*place, "a").orderBy("metric", "b")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
