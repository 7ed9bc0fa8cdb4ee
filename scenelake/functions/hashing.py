"""Choices by hash instead of by random numbers: the same on any partitioning, and expressible in SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(parts) -> Column:
    return F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def order_key(seed: int | str, *parts: Column) -> Column:
    """SHA-256 of "seed:part:part...": sorting by it is a fixed shuffle."""
    return F.sha2(_text([seed, *[p.cast("string") for p in parts]]), 256)


def seed_of(base: int | str, *parts: Column) -> Column:
    """The first eight bytes of the digest as an unsigned number, in a decimal(20,0)."""
    return F.conv(F.substring(order_key(base, *parts), 1, 16), 16, 10).cast("decimal(20,0)")


def uniform(seed: int | str, *parts: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """A number in [low, high) from the first 52 bits of the digest."""
    bits = F.conv(F.substring(order_key(seed, *parts), 1, 13), 16, 10).cast("double")
    return F.lit(low) + bits / F.lit(float(1 << 52)) * F.lit(high - low)


def pick(items: Column, seed: int | str, *parts: Column) -> Column:
    """One element of an array by hash; null if it is empty."""
    n = F.size(items)
    at = F.conv(F.substring(order_key(seed, *parts), 1, 13), 16, 10).cast("long")
    return F.when(n > 0, F.get(items, F.pmod(at, n).cast("int")))


def shuffle(items: Column, seed: int | str, *parts: Column) -> Column:
    """An array of strings in hash order; ties keep the array's order."""
    keyed = F.transform(items, lambda x, i: F.struct(order_key(seed, *parts, x).alias("k"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])
