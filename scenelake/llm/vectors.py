"""Embedding near-duplicates by collision counting on one-dimensional projections, inside cells that similar vectors share."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, erf, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .graph import components


def calibrate(m: int, reach: float, recall: float) -> int:
    """The largest count that a pair at the threshold reaches on ``m`` projections with chance ``recall``, for windows of ``reach`` deviations."""
    p = erf(reach / sqrt(2))
    return max(k for k in range(m + 1) if sum(comb(m, i) * p**i * (1 - p) ** (m - i) for i in range(k, m + 1)) >= recall)


def runs(parts: Iterator[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """The runs of equal ``key`` of a sorted stream of frames, each whole."""
    held: list[pd.DataFrame] = []
    for part in parts:
        if not len(part):
            continue
        k = part[key].to_numpy()
        cuts = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
        if held and (held[-1][key].to_numpy()[-1] != k[0]).any():
            yield pd.concat(held)
            held = []
        if not len(cuts):
            held.append(part)
            continue
        yield pd.concat([*held, part.iloc[: cuts[0]]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b - a > 1:
                yield part.iloc[a:b]
        held = [part.iloc[cuts[-1] :]]
    if held:
        yield pd.concat(held)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest that the edges (a, b) connect it with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def colliding(proj: np.ndarray, side: np.ndarray, other: np.ndarray, width: float, least: int, chunk: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows, one of ``side`` and one of ``other`` (once each if these are the same), that collide on ``least`` projections.

    A query's window on a projection reaches ``width`` to both sides. Each projection is sorted, and the windows are
    found in it by bisection. Pairs come from the windows of the first projections, as many as a pair may miss and one
    more, and are told once, by the first that holds them; on the projections after that they are counted, and dropped
    when they cannot reach ``least`` any more.
    """
    m, same = proj.shape[1], side is other
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for j in range(m - least + 1):
        order = other[np.argsort(proj[other, j], kind="stable")]
        value = proj[order, j]
        start = np.searchsorted(value, proj[side, j] - np.float32(width), "left")
        sizes = np.searchsorted(value, proj[side, j] + np.float32(width), "right") - start
        ends = np.cumsum(sizes)
        at = 0
        while at < len(side):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + chunk, "right")))
            n = sizes[at:upto]
            a = np.repeat(side[at:upto], n)
            b = order[np.repeat(start[at:upto] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            keep = a < b if same else np.ones(len(a), bool)
            a, b = a[keep], b[keep]
            missed = np.zeros(len(a), np.int8)
            for i in range(m):
                if i == j:
                    continue
                miss = np.abs(proj[a, i] - proj[b, i]) > np.float32(width)
                missed += miss
                keep = missed <= m - least
                if i < j:  # a pair in an earlier window has been told there
                    keep &= miss
                a, b, missed = a[keep], b[keep], missed[keep]
            found.append((a, b))
            at = upto
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


class Hashing:
    """Gaussian directions for vectors of one dimension: ``tables`` times ``axes`` for cells, ``m`` for counting."""

    def __init__(self, dim: int, tables: int, axes: int, m: int, cell: float) -> None:
        rng = np.random.default_rng(dim)
        self.tables, self.axes, self.width = tables, axes, cell
        self.cells = rng.standard_normal((dim, tables * axes))
        self.shift = rng.random(tables * axes) * cell
        self.mult = rng.integers(1, 2**62, axes, dtype=np.int64) * 2 + 1
        self.count = rng.standard_normal((dim, m))

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """A 64-bit cell key for each row and table."""
        q = np.floor((unit @ self.cells + self.shift) / self.width).astype(np.int64).reshape(len(unit), self.tables, self.axes)
        with np.errstate(over="ignore"):
            h = np.zeros(q.shape[:2], np.int64)
            for k in range(self.axes):
                h = (h ^ (q[:, :, k] + 0x9E3779B9)) * self.mult[k]
                h ^= (h >> 29) & ((1 << 35) - 1)
        return h ^ np.arange(self.tables)


def near(vectors: DataFrame, *, cosine: float = 0.95, tables: int = 14, axes: int = 10, cell: float = 5.7, m: int = 12, reach: float = 2.5, recall: float = 0.999, block: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding", broadcast_rows: int = 100_000) -> DataFrame:
    """Links vectors of cosine similarity ``cosine`` or more, verified in double precision.

    One row per input row: the id, ``n_links`` (other vectors linked with it), ``component_id`` (smallest id that links
    reach) and ``kept``. Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing;
    vectors of different dimension do not link. Repeated rows count as vectors of their own; null ids count only where
    a class has no other. Other columns are ignored; an empty table gives an empty result.

    Equal vectors are one node with a multiplicity. Pairs are looked for in cells: ``axes`` projections cut into
    stretches of ``cell`` deviations of a pair at the threshold, for each of ``tables`` sets of projections. In a cell,
    a pair collides on a further projection if each lies in the window of ``reach`` deviations around the other; pairs
    with a count of collisions that pairs at the threshold reach with chance ``recall`` are verified. A pair counts in
    the first table whose cell it shares. Cells of more than ``block`` vectors are cut into blocks that meet in pairs,
    so no task holds a large cell, and blocks return sums and local classes, never pairs.
    """
    sigma = sqrt(2 - 2 * cosine)
    least = calibrate(m, reach, recall)
    kind = vectors.schema[vec_id].dataType.simpleString()
    e = F.col("e")
    sound = e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).alias("id"), F.col(embedding).cast("array<double>").alias("e"))
    rows = rows.withColumn("ok", F.coalesce(sound, F.lit(False))).withColumn("row", F.monotonically_increasing_id())
    rows = cut(rows.withColumn("h1", F.xxhash64("e")).withColumn("h2", F.hash("e")).withColumn("dim", F.size("e")))
    groups = cut(rows.where("ok").groupBy("h1", "h2", "dim").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("low")))
    nodes = rows.select(F.col("row").alias("node"), "e", "dim").join(groups.select("node", "copies"), "node")

    def hashing(dim: int, kept: dict = {}) -> Hashing:  # noqa: B006
        key = (dim, tables, axes, m, cell)
        if key not in kept:
            kept[key] = Hashing(dim, tables, axes, m, cell * sigma)
        return kept[key]

    def spread(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in parts:
            for dim, part in whole.groupby("dim"):
                for i in range(0, len(part), 500):
                    p = part.iloc[i : i + 500]
                    x = np.array(p["e"].tolist(), np.float64)
                    x /= np.abs(x).max(1, keepdims=True)
                    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
                    keys = hashing(int(dim)).keys(unit)
                    n = len(p)
                    yield pd.DataFrame({
                        "t": np.tile(np.arange(tables, dtype=np.int32), n), "key": keys.reshape(-1) ^ int(dim), "node": np.repeat(p["node"].to_numpy(), tables), "copies": np.repeat(p["copies"].to_numpy(), tables),
                        "x": np.repeat(np.array([r.tobytes() for r in unit], object), tables), "keys": np.repeat(np.array([r.tobytes() for r in keys], object), tables),
                    })

    spreaded = nodes.select("node", "copies", "e", "dim").mapInPandas(spread, "t int, key long, node long, copies long, x binary, keys binary")
    large = cut(spreaded.groupBy("t", "key").count().where(F.col("count") > block).select("t", "key", F.ceil(F.col("count") / block).cast("int").alias("blocks")))
    if large.count() <= broadcast_rows:  # at most one row for every 1024 of the other side
        large = F.broadcast(large)
    cells = spreaded.join(large, ["t", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cells = cells.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("t", "key", F.least("own", "with").alias("lo"), F.greatest("own", "with").alias("hi"), "own", "node", "copies", "x", "keys")
    place = ["t", "key", "lo", "hi"]

    def counted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = []
        for p in runs(parts, place):
            n = len(p)
            if n < 2:
                continue
            x = np.frombuffer(b"".join(p["x"]), np.float64).reshape(n, -1)
            own, lo, hi = p["own"].to_numpy(), p["lo"].iloc[0], p["hi"].iloc[0]
            side = np.arange(n) if lo == hi else np.flatnonzero(own == lo)
            other = side if lo == hi else np.flatnonzero(own == hi)
            if not len(side) or not len(other):
                continue
            proj = (x @ hashing(x.shape[1]).count).astype(np.float32)
            a, b = colliding(proj, side, other, reach * sigma, least)
            good = np.zeros(len(a), bool)
            for i in range(0, len(a), 20_000):
                good[i : i + 20_000] = np.einsum("ij,ij->i", x[a[i : i + 20_000]], x[b[i : i + 20_000]]) >= cosine
            a, b = a[good], b[good]
            if not len(a):
                continue
            keys = np.frombuffer(b"".join(p["keys"]), np.int64).reshape(n, -1)
            t = int(p["t"].iloc[0])
            first = np.ones(len(a), bool)
            for k in range(t):
                first &= keys[a, k] != keys[b, k]
            a, b = a[first], b[first]
            if not len(a):
                continue
            copies, node = p["copies"].to_numpy(), p["node"].to_numpy()
            links = np.bincount(a, weights=copies[b], minlength=n) + np.bincount(b, weights=copies[a], minlength=n)
            some = np.flatnonzero(links)
            found.append(pd.DataFrame({"node": node[some], "links": links[some].astype(np.int64), "root": node[roots(n, a, b)[some]]}))
            if sum(map(len, found)) > 10_000:
                yield pd.concat(found)
                found = []
        if found:
            yield pd.concat(found)

    parts = cells.repartition(*place).sortWithinPartitions(*place).mapInPandas(counted, "node long, links long, root long")
    parts = cut(parts)
    classes = components(parts.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = parts.groupBy("node").agg(F.sum("links").alias("links"))
    named = groups.join(links, "node", "left").join(classes, "node", "left").select("h1", "h2", "dim", "copies", "low", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root"))
    low = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.join(low, "root").select("h1", "h2", "dim", (F.col("links") + F.col("copies") - 1).alias("n"), "component_id")
    out = rows.select("id", "ok", "h1", "h2", "dim").join(named.withColumn("ok", F.lit(True)), ["ok", "h1", "h2", "dim"], "left")
    out = out.select(F.col("id").alias(vec_id), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col(vec_id).eqNullSafe(F.col("component_id")))


