"""Hard negatives for anchors: rotated one-bit codes with alignments bound every score, and scores inside the bounds are computed in integers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, delete

#: Bits to which a component of a rotated anchor is rounded.
PLANES = 8


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words, filled up with zeros."""
    b = np.packbits(bits, axis=-1, bitorder="little")
    fill = -b.shape[-1] % 8
    return np.ascontiguousarray(np.pad(b, [(0, 0)] * (b.ndim - 1) + [(0, fill)])).view(np.uint64)


class Rotations:
    """``levels`` orthogonal rotations for one dimension, each applied to the outcome of the one before."""

    def __init__(self, dim: int, levels: int) -> None:
        rng = np.random.default_rng([dim, levels])
        self.dim = dim
        self.turns = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(levels)]


@lru_cache
def rotations(dim: int, levels: int) -> Rotations:
    return Rotations(dim, levels)


@dataclass
class Codes:
    """One-bit codes of integer vectors: level by level the signs of what the levels before leave, rotated.

    ``bits`` (rows, levels, words); ``align`` (rows, levels), the cosine of a code with the vector it stands for;
    ``norm`` (rows, levels + 1), the length of what each level leaves, from the vector itself on.
    """

    bits: np.ndarray
    align: np.ndarray
    norm: np.ndarray

    @staticmethod
    def of(x: np.ndarray, turns: Rotations) -> Codes:
        bits, align, norm = [], [], [np.sqrt((x * x).sum(1))]
        left = x.astype(np.float64)
        for turn in turns.turns:
            left = left @ turn
            up = left >= 0
            scale = np.abs(left).sum(1) / turns.dim
            bits.append(packed(up))
            align.append(np.divide(scale * np.sqrt(turns.dim), norm[-1], out=np.zeros(len(x)), where=norm[-1] > 0))
            left = left - np.where(up, scale[:, None], -scale[:, None])
            norm.append(np.sqrt((left * left).sum(1)))
        return Codes(np.stack(bits, 1), np.stack(align, 1), np.stack(norm, 1))


class Questions:
    """Anchors, rotated as the codes are and rounded to bit planes, so that a product with a code is a sum of popcounts."""

    def __init__(self, q: np.ndarray, turns: Rotations) -> None:
        self.length = np.sqrt((q * q).sum(1))
        self.dim, self.planes, self.low, self.step, self.total, self.error = turns.dim, [], [], [], [], []
        u = q.astype(np.float64)
        for turn in turns.turns:
            u = u @ turn
            low = u.min(1, initial=0)
            step = np.maximum(u.max(1, initial=0) - low, 1e-30) / (2**PLANES - 1)
            z = np.rint((u - low[:, None]) / step[:, None]).astype(np.int64)
            off = u - (low[:, None] + step[:, None] * z)
            self.planes.append(np.stack([packed((z >> b) & 1 == 1) for b in range(PLANES)], 1))
            self.low.append(low)
            self.step.append(step)
            self.total.append(z.sum(1))
            self.error.append(np.sqrt((off * off).sum(1)))

    def bounds(self, codes: Codes, rows: slice, cols: slice) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the products of all rows with all anchors of two slices; certain, not likely.

        Popcounts give the product of code and rounded anchor. Cauchy-Schwarz bounds the rest: the rounding by its
        length, and what the last level leaves, at right angles to its code, by its length and the anchor's beside the code.
        """
        mid, off, root = 0.0, 0.0, np.sqrt(self.dim)
        for k in range(len(self.planes)):
            code = codes.bits[rows, k]
            ones = np.bitwise_count(code).sum(1, dtype=np.int64)[:, None]
            hits = np.zeros((len(code), len(self.length[cols])), np.int64)
            for b in range(PLANES):
                for w in range(code.shape[1]):
                    hits += np.bitwise_count(code[:, w, None] & self.planes[k][None, cols, b, w]).astype(np.int64) << b
            dot = (self.low[k][cols] * (2 * ones - self.dim) + self.step[k][cols] * (2 * hits - self.total[k][cols])) / root
            weight = (codes.norm[rows, k] * codes.align[rows, k])[:, None]
            mid = mid + weight * dot
            off = off + weight * self.error[k][cols]
        beside = np.maximum(np.abs(dot) - self.error[-1][cols], 0)
        rest = codes.norm[rows, -1][:, None] * np.sqrt(np.maximum(self.length[cols] ** 2 - beside**2, 0))
        slack = off + rest + 1e-9 * codes.norm[rows, 0][:, None] * self.length[cols] + 1e-6
        return mid - slack, mid + slack


def scored(x: np.ndarray, q: np.ndarray, r: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The integer products of rows r of x with rows a of q."""
    out = np.empty(len(r), np.int64)
    for i in range(0, len(r), 50_000):
        out[i : i + 50_000] = np.einsum("ij,ij->i", x[r[i : i + 50_000]], q[a[i : i + 50_000]])
    return out


def kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest value of each column; minus infinity where there are fewer."""
    if len(values) < k:
        return np.full(values.shape[1], -np.inf)
    return np.partition(values, len(values) - k, axis=0)[len(values) - k]


class Best:
    """The first ``k`` rows of each slot, by score, largest first, then by id, nulls last."""

    def __init__(self, k: int, slots: int) -> None:
        self.k, self.slots = k, slots
        self.slot, self.score, self.id, self.none = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool))

    def floor(self) -> np.ndarray:
        """The score of each slot's k-th row so far: no row under it can come in."""
        out = np.full(self.slots, -np.inf)
        full = np.flatnonzero(np.bincount(self.slot, minlength=self.slots) == self.k)
        last = np.searchsorted(self.slot, full, "right") - 1
        out[full] = self.score[last]
        return out

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score, ids, none = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.id, ids), (self.none, none)))
        order = np.lexsort((ids, none, -score, slot))
        s = slot[order]
        rank = np.arange(len(s)) - np.searchsorted(s, s, "left")
        keep = order[rank < self.k]
        self.slot, self.score, self.id, self.none = slot[keep], score[keep], ids[keep], none[keep]


def mine(
    rows: DataFrame, anchor: Column, *, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, levels: int = 4,
    vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", shard_bytes: int = 1 << 24, block: tuple[int, int] = (1024, 256),
) -> DataFrame:
    """For each anchor and each of its first positives, the first negatives whose score lies between two shares of the positive's.

    Components become floor(``scale`` x); a score is the integer product of two rows. An anchor's positives are its first
    ``positives`` other rows of its label; negatives are rows of other labels of ``low`` to ``high`` hundredths of the
    positive's score, the first ``negatives`` of them. Higher scores come first, then smaller ids, null ids last.
    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score; every anchor meets every row, and
    nothing is approximated: codes only spare products whose bounds rule them out.

    Rows with a null label or vector, a null or non-finite component, or a squared integer length of 2^62 or more (whose
    scores would not fit) take no part; vectors of different length (an empty one too) do not meet. Repeated rows are rows
    of their own, and an anchor that is repeated has its copy as another row. A row without an id is no anchor unless
    ``anchor`` says so. Other columns are ignored; an empty table gives an empty result.

    Anchors are the stated query set. They go to the tasks in shards of ``shard_bytes`` of vectors, one after the other;
    each task keeps the first rows of each anchor, so what is shuffled is ``positives`` (``negatives`` for each of
    them) rows an anchor and task, at most.
    """
    spark = rows.sparkSession
    sc = spark.sparkContext
    id_kind = rows.schema[vec_id].dataType.simpleString()
    e = F.col(embedding)
    sound = e.isNotNull() & F.col(label).isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    e = F.transform(e, lambda x: x.cast("double") * scale)
    length = F.aggregate(e, F.lit(0.0), lambda s, x: s + F.pow(F.floor(x).cast("double"), 2))
    short = F.forall(e, lambda x: F.abs(x) < 2.0**31) & (length < 2.0**62)
    source = rows.where(F.coalesce(sound, F.lit(False))).where(short).select(
        F.col(vec_id).cast("long").alias("id"), F.col(label).alias("label"), F.transform(e, lambda x: F.floor(x).cast("int")).alias("x"), F.coalesce(anchor, F.lit(False)).alias("anchor")
    ).withColumn("row", F.monotonically_increasing_id())
    if rows.schema[label].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        source = source.withColumn("label", F.xxhash64("label"))
    source = source.withColumn("label", F.col("label").cast("long"))

    def coded(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            x = batch.column("x")
            sizes = x.value_lengths().to_numpy()
            for dim in np.unique(sizes):
                p = batch.filter(pa.array(sizes == dim))
                n = len(p)
                values = p.column("x").flatten().to_numpy().reshape(n, dim)
                c = Codes.of(values.astype(np.float64), rotations(int(dim), levels)) if dim else Codes(np.zeros((n, levels, 0), np.uint64), np.zeros((n, levels)), np.zeros((n, levels + 1)))
                blobs = [pa.array([r.tobytes() for r in y], pa.binary()) for y in (values.astype(np.int32), c.bits, c.align, c.norm)]
                yield pa.RecordBatch.from_arrays([p.column("id"), p.column("label"), p.column("anchor"), p.column("row"), pa.array(np.full(n, dim, np.int32)), *blobs], ["id", "label", "anchor", "row", "dim", "x", "bits", "align", "norm"])

    table = cut(source.mapInArrow(coded, "id long, label long, anchor boolean, row long, dim int, x binary, bits binary, align binary, norm binary"))
    anchors = table.where("anchor").select("id", "label", "row", "dim", "x")
    size = anchors.agg(F.sum(F.col("dim").cast("long") * 8 + 64)).first()[0] or 0
    shards = ceil(size / shard_bytes)
    shard = F.pmod(F.xxhash64("row"), F.lit(max(1, shards)))

    def unpacked(p: pa.RecordBatch, dim: int) -> tuple[np.ndarray, Codes]:
        n = len(p)
        blob = lambda c, kind: np.frombuffer(b"".join(p.column(c).to_pylist()), kind)
        return blob("x", np.int32).astype(np.int64).reshape(n, dim), Codes(blob("bits", np.uint64).reshape(n, levels, -1 if dim else 0), blob("align", np.float64).reshape(n, levels), blob("norm", np.float64).reshape(n, levels + 1))

    def search(sent, k: int):
        """Tasks that keep the first k rows of each slot; a slot is a window of scores (lo, hi) of an anchor, or all rows of its label."""

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ask = sent.value
            state: dict[int, tuple[Questions, Best]] = {}
            for batch in parts:
                dims = batch.column("dim").to_numpy()
                for dim in np.unique(dims):
                    if int(dim) not in ask:
                        continue
                    p = batch.filter(pa.array(dims == dim))
                    q = ask[int(dim)]
                    if int(dim) not in state:
                        state[int(dim)] = (Questions(q["x"].astype(np.float64), rotations(int(dim), levels)) if dim else None, Best(k, q["slots"]))
                    questions, best = state[int(dim)]
                    x, codes = unpacked(p, int(dim))
                    ids, none = p.column("id").fill_null(0).to_numpy(), p.column("id").is_null().to_numpy(zero_copy_only=False)
                    label, row = p.column("label").to_numpy(), p.column("row").to_numpy()
                    for i in range(0, len(p), block[0]):
                        for j in range(0, len(q["x"]), block[1]):
                            rs, cs = slice(i, i + block[0]), slice(j, j + block[1])
                            lower, upper = questions.bounds(codes, rs, cs) if dim else (np.zeros((len(label[rs]), len(q["label"][cs]))),) * 2
                            same = label[rs, None] == q["label"][None, cs]
                            floor = best.floor()
                            # rows whose bounds let them in, for any slot of the anchor
                            if q["lo"] is None:
                                fits = same & (row[rs, None] != q["row"][None, cs])
                                need = np.maximum(floor[cs], kth(np.where(fits, lower, -np.inf), k))
                                r, a = np.nonzero(fits & (upper >= need))
                                score = scored(x, q["x"], r + i, a + j)
                                best.add(a + j, score, ids[r + i], none[r + i])
                                continue
                            lo, hi = q["lo"][cs], q["hi"][cs]
                            floor = floor.reshape(-1, lo.shape[1])[cs]
                            hit = np.zeros(lower.shape, bool)
                            for s in range(lo.shape[1]):
                                hit |= (upper >= np.maximum(lo[:, s], floor[:, s])) & (lower <= hi[:, s])
                            r, a = np.nonzero(hit & ~same)
                            score = scored(x, q["x"], r + i, a + j)
                            for s in range(lo.shape[1]):
                                inside = np.flatnonzero((score >= lo[a, s]) & (score <= hi[a, s]) & (score >= floor[a, s]))
                                best.add((a[inside] + j) * lo.shape[1] + s, score[inside], ids[r[inside] + i], none[r[inside] + i])
            for dim, (_, best) in state.items():
                per = 1 if ask[dim]["lo"] is None else ask[dim]["lo"].shape[1]
                yield pa.RecordBatch.from_arrays([
                    pa.array(ask[dim]["row"][best.slot // per]), pa.array((best.slot % per).astype(np.int32)), pa.array(best.id, mask=best.none), pa.array(best.score),
                ], ["anchor_row", "place", "id", "score"])

        return run

    wanted = "anchor_row long, place int, id long, score long"
    slot = Window.partitionBy("anchor_row", "place").orderBy(F.desc("score"), F.asc_nulls_last("id"))

    def first(found: DataFrame, k: int) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(slot)).where(F.col("rank") <= k)

    told: list[DataFrame] = []
    for s in range(shards):
        mine_rows = anchors.where(shard == s).toArrow()  # ``shard_bytes`` at most, by the hash of row numbers
        ask = {}
        for dim in mine_rows.column("dim").unique().to_pylist():
            p = mine_rows.filter(pc.equal(mine_rows.column("dim"), dim)).combine_chunks()
            ask[dim] = {"x": np.frombuffer(b"".join(p.column("x").to_pylist()), np.int32).astype(np.int64).reshape(len(p), dim), "label": p.column("label").to_numpy(), "row": p.column("row").to_numpy(), "lo": None, "hi": None, "slots": len(p)}
        sent = sc.broadcast(ask)
        best = cut(first(table.drop("anchor").mapInArrow(search(sent, positives), wanted), positives).select("anchor_row", F.col("rank").alias("place"), F.col("id").alias("positive"), F.col("score").alias("positive_score")))
        known: dict[int, list[tuple[int, int]]] = {}
        for r in best.select("anchor_row", "place", "positive_score").collect():  # ``positives`` rows an anchor of the shard
            known.setdefault(r.anchor_row, []).append((r.place - 1, r.positive_score))
        windows = {}
        for dim, q in ask.items():
            lo = np.full((q["slots"], positives), 1 << 62, np.int64)  # nothing fits until a positive is known
            hi = -lo
            for i, r in enumerate(q["row"].tolist()):
                for place, score in known.get(r, ()):
                    lo[i, place], hi[i, place] = -(-low * score // 100), high * score // 100
            windows[dim] = q | {"lo": lo, "hi": hi, "slots": q["slots"] * positives}
        sent = sc.broadcast(windows)
        found = first(table.drop("anchor").mapInArrow(search(sent, negatives), wanted), negatives).withColumn("place", F.col("place") + 1)
        named = best.join(anchors.where(shard == s).select(F.col("row").alias("anchor_row"), F.col("id").alias("anchor")), "anchor_row")
        told.append(cut(named.join(found, ["anchor_row", "place"]).select("anchor", "positive", "rank", F.col("id").alias("negative"), "positive_score", F.col("score").alias("negative_score"))))
        delete(best)
    kind = "anchor long, positive long, rank int, negative long, positive_score long, negative_score long"
    out = spark.createDataFrame([], kind)
    for t in told:
        out = out.unionByName(t)
    delete(table)
    back = lambda c, name: F.col(c).cast(id_kind).alias(name)
    return out.select(back("anchor", "anchor_id"), back("positive", "positive_id"), "rank", back("negative", "negative_id"), "positive_score", "negative_score")
