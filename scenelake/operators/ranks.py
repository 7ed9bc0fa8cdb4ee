"""Running sums and ranks down an order, by ranges of the order: no task holds a whole group, however few groups there are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import stage


def group_text(*keys: str) -> Column:
    """Keys as one text, of which null parts are told from all others."""
    parts = [F.when(F.col(k).isNull(), "n").otherwise(F.concat(F.lit("v"), F.length(F.col(k).cast("string")).cast("string"), F.lit(":"), F.col(k).cast("string"))) for k in keys]
    return F.concat(F.lit(""), *parts)


def running(df: DataFrame, keys: list[str], order: list[str | Column], weight: Column | None = None, out: str = "running") -> DataFrame:
    """Adds the sum of ``weight`` (long, not negative; 1 by default) over a row and all before it in its group.

    Rows are dealt by ranges of (group, order) and sorted there; each task adds up its own part, and a part that goes on
    from the ranges before gets their total. A range has at most one such group, so what is joined has a row a range at
    most. The ranged table is written before it is read twice, so both reads see the same ranges. ``order`` is
    ascending, nulls first; rows that it does not tell apart are numbered in any order.
    """
    named = [F.col(o).alias(f"__o{i}") if isinstance(o, str) else o.alias(f"__o{i}") for i, o in enumerate(order)]
    own = df.columns
    rows = df.select("*", group_text(*keys).alias("__g"), *named, (F.lit(1) if weight is None else F.coalesce(weight, F.lit(0))).cast("long").alias("__w"))
    place = ["__g", *[f"__o{i}" for i in range(len(order))]]
    rows = rows.withColumn("__tie", F.monotonically_increasing_id())  # so that equal rows can lie in several ranges
    rows = rows.repartitionByRange(*place, "__tie").sortWithinPartitions(*place, "__tie").drop("__tie", *place[1:])

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        p, last, total = TaskContext.get().partitionId(), None, 0
        for batch in parts:
            if not len(batch):
                continue
            g = batch.column("__g").dictionary_encode().indices.to_numpy()
            w = batch.column("__w").to_numpy()
            new = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            sums = np.cumsum(w)
            base = np.repeat(sums[new] - w[new], np.diff(np.append(new, len(g))))
            first = batch.column("__g")[0].as_py()
            run = sums - base
            if first == last:
                run[: new[1] if len(new) > 1 else len(g)] += total
            last, total = batch.column("__g")[-1].as_py(), int(run[-1])
            columns = [batch.column(c) for c in [*own, "__g"]] + [pa.array(np.full(len(g), p, np.int32)), pa.array(run)]
            yield pa.RecordBatch.from_arrays(columns, [*own, "__g", "__p", "__run"])

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in own), "__g string, __p int, __run long"])
    ranged = stage.staged(rows.mapInArrow(add, schema))
    totals = ranged.groupBy("__g", "__p").agg(F.max("__run").alias("__n"))
    w = Window.partitionBy("__g").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.withColumn("__before", F.sum("__n").over(w)).where("__before > 0").select("__g", "__p", "__before")
    joined = ranged.join(F.broadcast(before), ["__g", "__p"], "left")  # a row a range at most
    return joined.select(*own, (F.col("__run") + F.coalesce("__before", F.lit(0))).alias(out))


def ordinal(df: DataFrame, keys: list[str], order: list[str | Column], out: str = "ordinal") -> DataFrame:
    """Numbers the rows of each group from 1."""
    return running(df, keys, order, None, out)


def mean_ranks(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """(keys, value, out): the average rank of each distinct value of a group; equal values share the mean of their ranks."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    return running(counts, keys, [value], F.col("__c"), "__r").select(*keys, value, (F.col("__r") - (F.col("__c") - 1) / F.lit(2.0)).alias(out))


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, n, rho): Pearson's r of the average ranks of x and y in each group, over the rows that have both.

    Rows are first counted by value and by pair of values, so ties cost nothing; ranks come from ranges of the values.
    A group in which x or y is constant has a null rho; null is a group like others.
    """
    kept = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*[F.col(b).alias(f"__b{i}") for i, b in enumerate(by)], F.col(x).alias("__x"), F.col(y).alias("__y"))
    keys = [f"__b{i}" for i in range(len(by))]
    pairs = kept.groupBy(*keys, "__x", "__y").agg(F.count(F.lit(1)).alias("__n"))
    sizes = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))

    def joined(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        right = right.withColumnsRenamed({c: f"r{c}" for c in on})
        return left.join(right, [left[c].eqNullSafe(right[f"r{c}"]) for c in on]).drop(*[f"r{c}" for c in on]) if on else left.crossJoin(right)  # one row

    ranked = joined(joined(pairs, mean_ranks(kept, keys, "__x", "__rx"), [*keys, "__x"]), mean_ranks(kept, keys, "__y", "__ry"), [*keys, "__y"])
    ranked = joined(ranked, sizes, keys)
    mid = (F.col("n") + 1) / F.lit(2.0)
    dx, dy, w = F.col("__rx") - mid, F.col("__ry") - mid, F.col("__n")
    out = ranked.groupBy(*keys).agg(F.first("n").alias("n"), F.sum(w * dx * dy).alias("__xy"), F.sum(w * dx * dx).alias("__xx"), F.sum(w * dy * dy).alias("__yy"))
    return out.select(*[F.col(f"__b{i}").alias(b) for i, b in enumerate(by)], "n", F.try_divide(F.col("__xy"), F.sqrt(F.col("__xx") * F.col("__yy"))).alias("rho"))
