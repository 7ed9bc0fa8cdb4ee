"""Structural similarity of frames, and the least similar frames of a set."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks

#: The shares of the range of values that keep quotients finite, and the Gaussian window's size and deviation.
K1, K2, GAUSS, SIGMA = 0.01, 0.03, 11, 1.5


def box_means(x: np.ndarray, size: int) -> np.ndarray:
    """Means over all whole windows of ``size`` x ``size`` of frames (..., h, w), by a summed-area table."""
    table = np.zeros((*x.shape[:-2], x.shape[-2] + 1, x.shape[-1] + 1))
    table[..., 1:, 1:] = x.cumsum(-2).cumsum(-1)
    s = size
    return (table[..., s:, s:] - table[..., :-s, s:] - table[..., s:, :-s] + table[..., :-s, :-s]) / (s * s)


def gauss_means(x: np.ndarray, size: int = GAUSS, sigma: float = SIGMA) -> np.ndarray:
    """Means under a Gaussian window around each pixel, one axis after the other; outside a frame there are zeros."""
    at = np.arange(size) - size // 2
    weight = np.exp(-at * at / (2 * sigma * sigma))
    weight /= weight.sum()
    for axis in (-2, -1):
        wide = np.pad(x, [(size // 2, size // 2) if a == x.ndim + axis else (0, 0) for a in range(x.ndim)])
        x = np.lib.stride_tricks.sliding_window_view(wide, size, axis=axis) @ weight
    return x


def ssim(a: np.ndarray, b: np.ndarray, means: Callable[[np.ndarray], np.ndarray], span: float = 1.0) -> np.ndarray:
    """Mean structural similarity of each of n frames with each of m: a (n, channels, h, w), b (m, channels, h, w)."""
    c1, c2 = (K1 * span) ** 2, (K2 * span) ** 2
    ma, mb = means(a), means(b)
    va, vb = means(a * a) - ma * ma, means(b * b) - mb * mb
    out = np.empty((len(a), len(b)))
    for i in range(len(a)):  # all b at once
        cov = means(a[i] * b) - ma[i] * mb
        s = (2 * ma[i] * mb + c1) * (2 * cov + c2) / ((ma[i] ** 2 + mb**2 + c1) * (va[i] + vb + c2))
        out[i] = s.mean(axis=(1, 2, 3))
    return out


def least_similar(queries: DataFrame, frames: DataFrame, place: list[str], shape: tuple[int, int, int], k: int = 3, window: int | None = None, span: float = 1.0) -> DataFrame:
    """(place, a, b, similarity, rank): the ``k`` frames of each query's place that are least similar to it.

    Frames are arrays of channels x height x width values, row by row; ``shape`` says how many. ``queries`` has the
    place, ``a`` and ``va``, ``frames`` the place, ``b`` and ``vb``. Windows are whole boxes of ``window`` pixels, or
    Gaussian ones if there is none. A frame of another length, or with null values, is like nothing and never chosen.
    Similarities are rounded to nine places before frames are ordered, then by ``b``.
    """
    channels, height, width = shape
    size = channels * height * width
    means = (lambda x: box_means(x, window)) if window else gauss_means

    def kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.full((len(x), len(y)), np.nan)
        sound = [np.flatnonzero(~np.isnan(z[:, :size]).any(1) & (np.isnan(z[:, size:]).all(1))) if z.shape[1] >= size else np.zeros(0, int) for z in (x, y)]
        if len(sound[0]) and len(sound[1]):
            p, q = (z[s, :size].reshape(-1, channels, height, width) for z, s in zip((x, y), sound))
            out[np.ix_(*sound)] = np.round(ssim(p, q, means, span), 9)
        return out

    found = blocks.smallest(queries, frames, place, kernel, k, block=max(16, min(1024, (1 << 21) // size)))
    return found.withColumnRenamed("metric", "similarity").withColumn("rank", F.col("rank").cast("long"))
