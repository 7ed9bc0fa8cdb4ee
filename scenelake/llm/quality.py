"""Quality classifier: cumulative-link regression on graded ratings over hashed words of whole texts."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 18
#: Texts by which a slot's log-odds shrink towards none.
SMOOTH = 20.0
_STRIP = ".,;:!?\"'()[]{}…«»¿¡*#$%&|"
_slots: dict[str, int] = {}


def _slot(word: str) -> int:
    """The hashed slot of a word; a bounded cache spares most of the hashing."""
    n = _slots.get(word)
    if n is None:
        if len(_slots) > 400_000:
            _slots.clear()
        n = _slots[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)
    return n


def slots(text: str) -> np.ndarray:
    """Distinct slots of a text: its words, their first four and five letters, and words for its shape (length, repeats, capitals, symbols, digits)."""
    words = text.split()
    n = len(words)
    seen = set(words)
    plain = {w.strip(_STRIP).lower() for w in seen}
    chars = max(1, len(text))
    rate = lambda x: min(10, int(10 * x))
    upper = sum(1 for w in seen if w.isupper() and len(w) > 1) / max(1, len(seen))
    marked = sum(1 for w in seen if w[-1] in "*#$%&|!") / max(1, len(seen))
    lead = sum(1 for w in seen if not w[0].isalnum()) / max(1, len(seen))
    bars = text.count("|") / max(1, n)
    digits = sum(map(text.count, "0123456789")) / chars
    shape = [f"\0n{n.bit_length()}", f"\0u{rate(len(seen) / max(1, n)) if n > 20 else 'x'}", f"\0c{rate(upper)}", f"\0m{rate(marked)}", f"\0l{rate(lead)}", f"\0b{rate(bars)}", f"\0d{rate(3 * digits)}", f"\0w{min(20, chars // max(1, n))}"]
    out = set(map(_slot, plain))
    out.update(map(_slot, {"\0p" + w[:5] for w in plain if len(w) > 5}), map(_slot, {"\0q" + w[:4] for w in plain if len(w) > 4}), map(_slot, shape))
    return np.fromiter(out, np.int32, len(out))


@dataclass
class Model:
    """Weights shared by all grades, and ascending thresholds: P(grade >= k) = sigmoid(w.x - threshold[k-1])."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, x: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... of one text's slots."""
        return 1.0 / (1.0 + np.exp(np.clip(self.thresholds - float(self.weights[x].sum(dtype=np.float64)), -40, 40)))


def train(grades: np.ndarray, rows: list[np.ndarray], levels: int, steps: int = 100, rate: float = 0.05, decay: float = 3e-3) -> Model:
    """Fits a model by Adam on the whole likelihood.

    A slot's value is its smoothed log-odds between the top grade and the others, so words that tell nothing about the
    grade weigh little from the start; slots in fewer than three texts stay zero.
    """
    ptr = np.cumsum([0, *(len(r) for r in rows)])
    idx = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    size = 1 << BITS
    top = np.repeat(grades == levels - 1, np.diff(ptr))
    inside, outside = np.bincount(idx[top], minlength=size), np.bincount(idx[~top], minlength=size)
    n_in, n_out = int((grades == levels - 1).sum()), int((grades != levels - 1).sum())
    odds = np.log((inside + SMOOTH * n_in / len(grades)) / (n_in + SMOOTH)) - np.log((outside + SMOOTH * n_out / len(grades)) / (n_out + SMOOTH)) if n_in and n_out else np.ones(size)
    scale = np.where(inside + outside >= 3, np.abs(odds), 0.0)
    w, b = np.zeros(size), np.linspace(-4, -2, levels - 1)  # b: first threshold, then logs of the gaps
    if levels > 2:
        b[1:] = 0.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), np.zeros(levels - 1), np.zeros(levels - 1)
    n, lens = max(1, len(rows)), np.diff(ptr)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, steps + 1):
        theta = np.cumsum([b[0], *np.exp(b[1:])])
        cum = np.concatenate([[0.0], np.cumsum((w * scale)[idx])])
        f = cum[ptr[1:]] - cum[ptr[:-1]]
        edge = np.concatenate([np.ones((len(f), 1)), sig(f[:, None] - theta), np.zeros((len(f), 1))], axis=1)
        at = np.arange(len(f))
        hi, lo = edge[at, grades], edge[at, grades + 1]
        p = np.maximum(hi - lo, 1e-9)
        g = -(1 - hi - lo) / n
        gt = np.zeros(levels - 1)
        for k in range(levels - 1):
            e = edge[:, k + 1] * (1 - edge[:, k + 1]) / p / n
            gt[k] = e[grades == k + 1].sum() - e[grades == k].sum()
        gb = np.array([gt.sum(), *(np.exp(b[j]) * gt[j:].sum() for j in range(1, levels - 1))])
        gw = np.bincount(idx, weights=np.repeat(g, lens), minlength=size) * scale + decay * w
        for x, gx, mx, vx in ((w, gw, m, v), (b, gb, mb, vb)):
            mx += 0.1 * (gx - mx)
            vx += 0.01 * (gx * gx - vx)
            x -= rate * (mx / (1 - 0.9**t)) / (np.sqrt(vx / (1 - 0.99**t)) + 1e-8)
    return Model((w * scale).astype(np.float32), np.cumsum([b[0], *np.exp(b[1:])]))


def fit(docs: DataFrame, grades: DataFrame, *, levels: int, sample: int = 16_000, doc_id: str = "doc_id", text: str = "text", grade: str = "grade") -> Model:
    """Trains on at most ``sample`` graded texts, those whose ids hash lowest; more rows change nothing but which these are.

    One task fits them jointly: the sample bounds it. A document graded twice counts with its lowest grade; repeated ids
    are texts of their own; rows with null id, null grade or a grade outside 0 to levels - 1 are left out; null text
    counts as empty. Without any graded text the model has zero weights and gives every grade the same odds for every text.
    """
    fold = F.crc32(F.col("id").cast("string").cast("binary"))
    rated = grades.select(F.col(doc_id).alias("id"), F.col(grade).cast("int").alias("y")).where(f"id is not null and y between 0 and {levels - 1}").groupBy("id").agg(F.min("y").alias("y"))
    # a hash bound that some more than ``sample`` rows pass, so that no task sorts or sends more than its share of them
    share = (sample + 8 * sample**0.5) / max(1, rated.count())
    rated = rated.where(fold <= int(min(1.0, share) * (1 << 32))).orderBy(fold, "id").limit(sample)
    texts = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(rated), "id")  # at most ``sample`` rows of two numbers

    def hashed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"y": part["y"], "x": [slots(t) for t in part["t"]]})

    def trained(part: pd.DataFrame) -> pd.DataFrame:
        got = train(part["y"].to_numpy(np.int64), [np.asarray(x, np.int32) for x in part["x"]], levels)
        return pd.DataFrame({"w": [got.weights.tobytes()], "b": [got.thresholds.tobytes()]})

    rows = texts.select("y", "t").mapInPandas(hashed, "y int, x array<int>").groupBy(F.lit(0).alias("all")).applyInPandas(trained, "w binary, b binary").collect()  # one row of 1 MB
    if not rows:
        return Model(np.zeros(1 << BITS, np.float32), np.arange(levels - 1, dtype=np.float64) - (levels - 2) / 2)
    return Model(np.frombuffer(rows[0]["w"], np.float32), np.frombuffer(rows[0]["b"], np.float64))


def score(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: the id, ``expected_grade`` and ``tail`` (the chance of the top grade).

    Null text counts as empty; repeated rows and ids are scored each by itself; other columns are ignored; an empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((model.weights, model.thresholds))  # 1 MB at any input

    def scored(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Model(*held.value)
        for part in parts:
            tails = [own.tails(slots(t)) for t in part["t"]]
            yield pd.DataFrame({"id": part["id"], "e": [float(x.sum()) for x in tails], "p": [float(x[-1]) for x in tails]})

    kind = docs.schema[doc_id].dataType.simpleString()
    out = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")).mapInPandas(scored, f"id {kind}, e double, p double")
    return out.select(F.col("id").alias(doc_id), F.col("e").alias("expected_grade"), F.col("p").alias("tail"))


def grades_of(labels: DataFrame) -> DataFrame:
    """The labels table as grades: 0 for poor quality, 1 for good but toxic, 2 for good."""
    good = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", good.alias("grade"))




def keep(docs: DataFrame, model: Model, *, tail: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, whose chance of the top grade is ``tail`` or more.

    Null text counts as empty; repeated rows are judged each by itself; all columns stay; an empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))
    at = docs.columns.index(text)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*held.value)
        for batch in batches:
            yield batch.filter(pa.array([bool(own.tails(slots(t or ""))[-1] >= tail) for t in batch.column(at).to_pylist()], pa.bool_()))
        _slots.clear()  # workers are used again by other steps

    return docs.mapInArrow(kept, docs.schema)
