"""Benchmark decontamination: every passage of every text queries a BM25 index of test items, and what it retrieves is verified."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

_TOKEN = re.compile(r"\w+")
#: Words of a passage and of the step to the next: any STEP words in a row lie in one passage. Items are indexed in pieces of PIECE words at most.
PASSAGE, STEP, PIECE = 128, 64, 48
BLOCK = 64
K1, B = 1.2, 0.75
REST = 0.7


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def _grams(words: list[str], width: int = 5) -> set[tuple[str, ...]]:
    n = min(width, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def split_item(text: str) -> tuple[list[str], list[str]]:
    """Question and answer of an item: cut after the last question mark or line break that has words on both sides, else at four fifths of the words."""
    at = max((m.end() for m in re.finditer(r"\?|\n", text) if tokens(text[: m.end()]) and tokens(text[m.end() :])), default=0)
    if at:
        return tokens(text[:at]), tokens(text[at:])
    words = tokens(text)
    k = len(words) - max(1, len(words) // 5)
    return words[:k], words[k:]


class Index:
    """Pieces of items under BM25, each piece's impacts divided by its score for itself, so a threshold is a share of a full match.

    Lists are kept by term; no block maxima are stored. For each piece its smallest
    impacts, up to REST of the threshold together, are inessential: no passage reaches the threshold without the
    remaining share from the essential ones, whose lists are short, as those are the rare terms.
    """

    def __init__(self, items: list[tuple[int, str]], threshold: float = 0.5) -> None:
        self.threshold = threshold
        self.names = [i for i, _ in items]  # rows with equal ids are items of their own
        self.items = [tuple(map(_grams, (tokens(t), *split_item(t)))) for _, t in items]
        self.owner, pieces = [], []
        for i, (_, t) in enumerate(items):
            words = tokens(t)
            parts = -(-len(words) // PIECE)
            for k in range(parts):
                pieces.append(Counter(words[k * len(words) // parts : (k + 1) * len(words) // parts]))
                self.owner.append(i)
        df = Counter(w for p in pieces for w in p)
        self.ids = {w: k for k, w in enumerate(sorted(df))}
        mean = sum(sum(p.values()) for p in pieces) / max(1, len(pieces))
        self.impacts: list[dict[int, float]] = []
        self.rest = np.zeros(len(pieces))
        lists: list[list[tuple[int, float]]] = [[] for _ in df]
        for n, p in enumerate(pieces):
            size = sum(p.values())
            raw = {self.ids[w]: math.log(1 + (len(pieces) - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * size / mean)) for w, c in p.items()}
            total = sum(raw.values())
            own = {w: x / total for w, x in raw.items()}
            self.impacts.append(own)
            for w, x in sorted(own.items(), key=lambda y: y[1]):
                if self.rest[n] + x <= threshold * REST:
                    self.rest[n] += x
                else:
                    lists[w].append((n, x))
        self.count = np.array([len(x) for x in lists], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.count)])[:-1]
        self.piece = np.array([n for x in lists for n, _ in x], np.int64)
        self.impact = np.array([y for x in lists for _, y in x])
        # the largest rest of each block of pieces
        self.rest_of_block = np.array([self.rest[i : i + BLOCK].max() for i in range(0, len(pieces), BLOCK)])

    def _sums(self, key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if key.max() < 200_000:
            total = np.bincount(key, weights=weight)
            keys = np.flatnonzero(total)
            return keys, total[keys]
        keys, at = np.unique(key, return_inverse=True)
        return keys, np.bincount(at, weights=weight)

    def retrieve(self, words: list[str]) -> dict[int, float]:
        """The items, by their place in the index, of which some passage of the text scores the threshold or more on a piece, with the best score."""
        term = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int64, len(words))
        where = np.flatnonzero(term >= 0)
        t = term[where]
        n = self.count[t]
        where, t, n = where[n > 0], t[n > 0], n[n > 0]
        if not len(t):
            return {}
        post = np.repeat(self.start[t] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        piece, impact, at = self.piece[post], self.impact[post], np.repeat(where // STEP, n)
        last = max(0, -(-len(words) // STEP) - 2)  # the last passage
        width = last + 3
        one, two = np.minimum(at, last), np.maximum(at - 1, 0)
        both = two < one
        # bounds of blocks of pieces first: the sum of a block's postings in a passage, and its largest rest
        block = piece // BLOCK
        passage, block, piece, impact = (np.concatenate(x) for x in ((one, two[both]), (block, block[both]), (piece, piece[both]), (impact, impact[both])))
        if len(self.rest_of_block) > 16:  # with fewer, bounding them costs more than it spares
            keys, total = self._sums(block * width + passage, impact)  # every posting counts, so the sum bounds each piece's
            alive = keys[total + self.rest_of_block[keys // width] >= self.threshold]
            keep = np.isin(block * width + passage, alive)
            passage, piece, impact = passage[keep], piece[keep], impact[keep]
            if not len(passage):
                return {}
        keys, total = self._sums(piece * width + passage, impact)
        found: dict[int, float] = {}
        for k in keys[total + self.rest[keys // width] >= self.threshold]:
            p, start = int(k // width), int(k % width) * STEP
            own = self.impacts[p]
            score = sum(own[w] for w in set(term[start : start + PASSAGE].tolist()) if w in own)
            if score >= self.threshold:
                item = self.owner[p]
                found[item] = max(score, found.get(item, 0.0))
        return found

    def verify(self, words: list[str], item: int) -> tuple[float, float, float]:
        """Shares of the five-word shingles of the item, of its question and of its answer that occur in the text."""
        seen: dict[int, set] = {}
        out = []
        for grams in self.items[item]:
            n = len(next(iter(grams))) if grams else 5
            if n not in seen:
                seen[n] = set(zip(*(words[i:] for i in range(n))))
            out.append(len(grams & seen[n]) / len(grams) if grams else 1.0)
        return tuple(out)


def _id_type(items: DataFrame, item_id: str) -> str:
    return "long" if items.schema[item_id].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else "string"


def _shards(items: DataFrame, shard: int, item_id: str, item_text: str) -> Iterator[tuple[list[tuple], bool]]:
    """The items that have a word, about ``shard`` at a time, and whether these are the last."""
    bare = items.select(F.col(item_id).cast(_id_type(items, item_id)).alias("i"), F.col(item_text).alias("t")).where(F.col("t").rlike(r"[\p{L}\p{N}_]"))
    n = max(1, -(-bare.count() // shard))
    for k in range(n):
        part = bare.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) if n > 1 else bare
        yield [(r["i"], r["t"]) for r in part.orderBy("i", "t").collect()], k == n - 1


class Judge:
    """Decides which items of an index a text leaks."""

    def __init__(self, items: list[tuple[int, str]], threshold: float, overlap: float, part: float) -> None:
        self.index, self.overlap, self.part = Index(items, threshold), overlap, part

    def __call__(self, text: str) -> tuple[list[int], float, float, bool]:
        """The ids of the leaked items, the best BM25 share and the best overlap of the retrieved ones, and whether any item is leaked."""
        words = tokens(text)
        good, score, most = [], 0.0, 0.0
        for item, s in self.index.retrieve(words).items():
            whole, question, answer = self.index.verify(words, item)
            score, most = max(score, s), max(most, whole)
            if whole >= self.overlap and question >= self.part and answer >= self.part:
                good.append(self.index.names[item])
        return sorted({i for i in good if i is not None}), score, most, bool(good)


def search(docs: DataFrame, items: DataFrame, *, threshold: float = 0.5, overlap: float = 0.8, part: float = 0.5, shard: int = 20_000, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per input row: the id, ``item_ids`` (sorted array of leaked items), ``best_score``, ``best_overlap`` and ``leaked``.

    An item is leaked into a text if one of its pieces reaches ``threshold`` of its own BM25 score in some passage of 128
    words, and at least ``overlap`` of its five-word shingles, and ``part`` of those of its question and of its answer,
    occur in the text. Items are indexed ``shard`` at a time, one after the other, which bounds what driver and tasks
    hold; with more of them the texts are read once for each shard. Null or empty texts leak nothing; items with a null
    id are left out; items that share an id are tested each by itself; other columns are ignored; an empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema[doc_id].dataType.simpleString(), _id_type(items, item_id)
    source = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    numbered = None
    parts_done = []
    for one, last in _shards(items.where(F.col(item_id).isNotNull()), shard, item_id, item_text):
        held = spark.sparkContext.broadcast(one)
        if not last and numbered is None:
            numbered = cut(source.withColumn("row", F.monotonically_increasing_id()))

        def matched(parts: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            judge = Judge(held.value, threshold, overlap, part)
            for p in parts:
                rows = [judge(t) for t in p["t"]]
                yield p.drop(columns="t").assign(**{c: [r[i] for r in rows] for i, c in enumerate(("item_ids", "best_score", "best_overlap"))})

        told = f"item_ids array<{item_kind}>, best_score double, best_overlap double"
        if numbered is None:
            out = source.mapInPandas(matched, f"id {kind}, {told}")
            return out.select(F.col("id").alias(doc_id), "item_ids", "best_score", "best_overlap", (F.size("item_ids") > 0).alias("leaked"))
        parts_done.append(cut(numbered.select("id", "row", "t").mapInPandas(matched, f"id {kind}, row long, {told}")))
        held.unpersist()
    every = parts_done[0]
    for one in parts_done[1:]:
        every = every.unionByName(one)
    ids = F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids")
    out = every.groupBy("row").agg(F.first("id").alias("id"), ids, F.max("best_score").alias("best_score"), F.max("best_overlap").alias("best_overlap"))
    return out.select(F.col("id").alias(doc_id), "item_ids", "best_score", "best_overlap", (F.size("item_ids") > 0).alias("leaked"))


def clean(docs: DataFrame, items: DataFrame, *, threshold: float = 0.5, overlap: float = 0.8, part: float = 0.5, shard: int = 20_000, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, into which no item is leaked by the rules of ``search``, items with a null id included; null and empty texts and repeated rows stay."""
    at, schema = docs.columns.index(text), docs.schema
    for one, last in _shards(items, shard, item_id, item_text):
        held = docs.sparkSession.sparkContext.broadcast(one)

        def kept(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            judge = Judge(held.value, threshold, overlap, part)
            for batch in batches:
                yield batch.filter(pa.array([not judge(t or "")[3] for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(kept, schema)
        if not last:  # so that the next shard comes when this one has gone
            docs = cut(docs)
            held.unpersist()
    return docs
