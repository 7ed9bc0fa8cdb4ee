"""Language ID: a byte convolutional network with filters of several widths, trained in numpy and run over all windows of a text."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a window, of an embedding, filter widths, filters of each width.
SPAN, EMBED, WIDTHS, FILTERS = 192, 6, (2, 3, 4, 5), 12
#: Windows of a batch, so that its arrays stay in the processor's cache; they are kept for the next one.
BATCH = 64
_kept: dict[int, tuple[np.ndarray, ...]] = {}


def _arrays(n: int) -> tuple[np.ndarray, ...]:
    if n not in _kept:
        if len(_kept) > 256:
            _kept.clear()
        size = n * SPAN
        _kept[n] = tuple(np.empty((k, size + more), np.float32) for k, more in ((EMBED, max(WIDTHS) - 1), (EMBED * max(WIDTHS), 0), (FILTERS * len(WIDTHS), 0)))
    return _kept[n]


def windows(text: str) -> np.ndarray:
    """All bytes of a text as rows of SPAN bytes, the last one filled with zeros; an empty text has one row of zeros."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    rows = max(1, -(-len(raw) // SPAN))
    out = np.zeros(rows * SPAN, np.uint8)
    out[: len(raw)] = raw
    return out.reshape(rows, SPAN)


@dataclass
class Model:
    langs: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def pooled(self, rows: np.ndarray, where: bool = False):
        """The maximum of each filter over each row's positions; with ``where`` also the positions."""
        n, deep, wide = len(rows), max(WIDTHS), FILTERS * len(WIDTHS)
        flat = np.append(rows.reshape(-1), np.zeros(deep - 1, np.uint8))
        x, cols, y = _arrays(n)
        np.take(np.ascontiguousarray(self.embed.T), flat, axis=1, out=x, mode="clip")  # a row for each dimension, so that shifts and maxima run along memory
        for k in range(deep):
            cols[k * EMBED : (k + 1) * EMBED] = x[:, k : k + n * SPAN]
        bank = np.zeros((wide, deep * EMBED), np.float32)
        for k, (width, kernel) in enumerate(zip(WIDTHS, self.filters)):
            bank[k * FILTERS : (k + 1) * FILTERS, : width * EMBED] = kernel.T
        y = np.matmul(bank, cols, out=y).reshape(wide, n, SPAN)
        best, at = [], []
        for k, width in enumerate(WIDTHS):
            part = y[k * FILTERS : (k + 1) * FILTERS, :, : SPAN - width + 1]
            if where:
                at.append(part.argmax(2).T)
            best.append(part.max(2).T)
        return np.concatenate(best, 1) + self.bias, at

    def logits(self, rows: np.ndarray) -> np.ndarray:
        return np.concatenate([np.maximum(self.pooled(rows[i : i + BATCH])[0], 0) @ self.out + self.out_bias for i in range(0, len(rows), BATCH)])

    def chances(self, rows: np.ndarray) -> np.ndarray:
        z = self.logits(rows)
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def train(rows: np.ndarray, labels: np.ndarray, langs: list[str], epochs: int = 5, batch: int = 64, rate: float = 3e-3, seed: int = 7) -> Model:
    """Softmax regression on pooled filters by Adam; each language weighs the same in the loss."""
    rng = np.random.default_rng(seed)
    total = FILTERS * len(WIDTHS)
    f32 = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    m = Model(langs, f32(256, EMBED, scale=0.5), [f32(w * EMBED, FILTERS, scale=(w * EMBED) ** -0.5) for w in WIDTHS], np.zeros(total, np.float32), f32(total, len(langs), scale=total**-0.5), np.zeros(len(langs), np.float32))
    share = np.bincount(labels, minlength=len(langs))
    weight = (len(labels) / len(langs) / np.maximum(share, 1)).astype(np.float32)
    params = [m.embed, *m.filters, m.bias, m.out, m.out_bias]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), batch):
            pick = order[i : i + batch]
            x, y = rows[pick], labels[pick]
            pool, at = m.pooled(x, where=True)
            h = np.maximum(pool, 0)
            z = h @ m.out + m.out_bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p *= weight[y][:, None] / len(y)
            dh = (p @ m.out.T) * (pool > 0)
            grads = [np.zeros_like(m.embed)]
            for k, width in enumerate(WIDTHS):
                d = dh[:, k * FILTERS : (k + 1) * FILTERS]
                byte = x[np.arange(len(y))[:, None, None], at[k][:, :, None] + np.arange(width)]
                seen = m.embed[byte].reshape(len(y), FILTERS, width * EMBED)
                grads.append(np.einsum("bf,bfk->kf", d, seen))
                back = (d[:, :, None] * m.filters[k].T[None]).reshape(-1, EMBED)
                np.add.at(grads[0], byte.reshape(-1), back)
            grads += [dh.sum(0), h.T @ p, p.sum(0)]
            t += 1
            for q, g, a, b in zip(params, grads, first, second):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                q -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    return m


def fit(docs: DataFrame, *, each: int = 1000, spans: int = 8, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Trains on at most ``each`` texts of every language, those whose ids hash lowest, and at most ``spans`` windows of each, evenly spaced.

    The bound is 8,000 windows of 192 bytes for every language, so one task trains. Rows with null language or id, and
    texts without a letter, are left out. Without any training text the model has no language.
    """
    fold = F.xxhash64(F.col("id"))
    known = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l")).where(F.col("id").isNotNull() & F.col("l").isNotNull() & F.col("t").rlike(r"\p{L}"))
    # a hash bound for each language that some more than ``each`` of its texts pass, so that no task ranks a whole language
    share = known.groupBy("l").count().select("l", (F.lit(each + 8 * each**0.5) / F.col("count")).alias("share"))
    low = known.select("id", "l").join(F.broadcast(share), "l").where(F.pmod(fold, F.lit(1 << 30)) < F.col("share") * (1 << 30)).drop("share")  # a row a language
    picked = low.withColumn("k", F.row_number().over(Window.partitionBy("l").orderBy(F.pmod(fold, F.lit(1 << 30)), "id"))).where(F.col("k") <= each).select("id", "l").distinct()
    texts = known.join(F.broadcast(picked), ["id", "l"])  # ``each`` rows a language

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            got = [(lang, row.tobytes()) for lang, t in zip(part["l"], part["t"]) for rows in [windows(t)] for row in rows[np.unique(np.linspace(0, len(rows) - 1, spans).astype(int))]]
            yield pd.DataFrame(got, columns=["l", "row"])

    def trained(part: pd.DataFrame) -> pd.DataFrame:
        langs = sorted(part["l"].unique())
        part = part.sort_values(["l", "row"])
        rows = np.frombuffer(b"".join(part["row"]), np.uint8).reshape(-1, SPAN)
        model = train(rows, part["l"].map({x: i for i, x in enumerate(langs)}).to_numpy(), langs)
        return pd.DataFrame({"m": [pickle.dumps(model)]})

    rows = texts.select("l", "t").mapInPandas(cut, "l string, row binary").groupBy(F.lit(0).alias("all")).applyInPandas(trained, "m binary").collect()
    if rows:
        return pickle.loads(rows[0]["m"])
    zero = np.zeros((0,), np.float32)
    return Model([], zero, [], zero, zero, zero)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: the id, ``lang_pred`` and ``score``, the mean chance of that language over all windows of the text.

    Windows that are mostly filling count by the share of their bytes. Null text, text without a letter, and any text
    under a model without languages give ``und`` with score 0.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # some 40 KB at any input

    def scored(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = held.value
        for part in parts:
            names, scores = [], []
            for t, letters in zip(part["t"], part["ok"]):
                if not letters or not own.langs:
                    names.append("und")
                    scores.append(0.0)
                    continue
                rows = windows(t)
                share = np.full(len(rows), SPAN, np.float64)
                share[-1] = max(1, np.count_nonzero(rows[-1]))
                mean = share @ own.chances(rows) / share.sum()
                k = int(mean.argmax())
                names.append(own.langs[k])
                scores.append(min(1.0, max(0.0, float(mean[k]))))
            yield pd.DataFrame({"id": part["id"], "l": names, "p": scores})

    kind = docs.schema[doc_id].dataType.simpleString()
    out = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t"), has_letter(F.col(text)).alias("ok")).mapInPandas(scored, f"id {kind}, l string, p double")
    return out.select(F.col("id").alias(doc_id), F.col("l").alias("lang_pred"), F.col("p").alias("score"))
