"""Velocities and runs over a stream of positions: an extension, with the batch operators' results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def runs(positions: DataFrame, key: str, ts: str, gap: str, delay: str) -> DataFrame:
    """Runs of rows at most ``gap`` apart as session windows, closed once the watermark has passed them."""
    return positions.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def velocities(positions: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """(key, t, value, v) with each key's last row kept as state between batches; rows of a batch are sorted by time."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values("t")
        last_t, last_x = state.get if state.exists else (None, None)
        out = []
        for t, x in zip(rows["t"], rows["x"]):
            v = (x - last_x) / (t - last_t) if last_t is not None and t != last_t else None
            out.append((k[0], t, x, v))
            last_t, last_x = t, x
        state.update((float(last_t), float(last_x)))
        yield pd.DataFrame(out, columns=["k", "t", "x", "v"])

    kind = positions.schema[key].dataType.simpleString()
    rows = positions.select(F.col(key).alias("k"), (F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1e6)).alias("t"), F.col(value).cast("double").alias("x"))
    return rows.groupBy("k").applyInPandasWithState(step, f"k {kind}, t double, x double, v double", "t double, x double", "append", "NoTimeout").select(F.col("k").alias(key), "t", F.col("x").alias(value), "v")
