"""Packing: bounded-space online best fit of token pieces into windows of fixed length, in each partition, then a merge of what stays open."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Stretches kept by a worker: when one generation is full, the one before it goes.
_CACHE = 400_000
_MARKS = ".,;:!?"
_coders: dict[str, "Coder"] = {}


class Coder:
    """Token ids of texts, as bytes of little-endian unsigned 32-bit numbers.

    The tokenizer drops white space and lets no token reach across it, so a text is encoded stretch by stretch between
    spaces and line feeds, and the ids of frequent stretches are kept. A run of letters is one word of the tokenizer,
    whose last token is marked as a word's end, so new runs of letters are encoded many at a time and told apart by
    these marks; marks of punctuation after a run are a word of their own.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.kept: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}

    def _each(self, parts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _runs(self, runs: list[str]) -> dict[str, bytes]:
        """The ids of runs of letters."""
        out: dict[str, bytes] = {}
        groups = [runs[i : i + 500] for i in range(0, len(runs), 500)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(group):  # a letter that becomes several signs in lower case
                out.update(zip(group, self._each(group)))
                continue
            raw, at = ids.tobytes(), 0
            for w, end in zip(group, (4 * cuts).tolist()):
                out[w] = raw[at:end]
                at = end
        return out

    def _learn(self, new: set[str]) -> None:
        split, rest = [], []
        for w in new:
            core = w.rstrip(_MARKS)
            if core.isalpha():
                split.append((w, core.lower() if core.isascii() else core, w[len(core) :]))
            else:
                rest.append(w)
        runs = self._runs(list({c for _, c, _ in split}))
        for m in {m for _, _, m in split} - self.marks.keys():
            self.marks[m] = self._each([m])[0]
        for w, core, m in split:
            self.kept[w] = runs[core] + self.marks[m]
        if len(self.marks) > 10_000:
            self.marks = {"": b""}
        self.kept.update(zip(rest, self._each(rest)))

    def __call__(self, texts: list[str]) -> list[bytes]:
        parts = [t.replace("\n", " ").split(" ") for t in texts]
        seen = set().union(*parts)
        if len(self.kept) > _CACHE:
            self.kept, self.old = {}, self.kept
        new = seen - self.kept.keys()
        again = new & self.old.keys()
        self.kept.update((w, self.old[w]) for w in again)
        self._learn(new - again)
        get = self.kept.__getitem__
        return [b"".join(map(get, p)) for p in parts]


def coder(path: str) -> Coder:
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


class Windows:
    """At most ``open_windows`` windows; a piece goes where it leaves the least room, and if it fits nowhere the fullest window is emitted."""

    def __init__(self, size: int, open_windows: int) -> None:
        self.size, self.most, self.next = size, open_windows, 0
        self.room: list[tuple[int, int]] = []  # (room, window), ascending
        self.held: dict[int, list[tuple]] = {}

    def put(self, length: int, piece: tuple) -> list[tuple]:
        """Places a piece; the rows (window, offset, piece) of a window that this closes."""
        done: list[tuple] = []
        at = bisect.bisect_left(self.room, (length, -1))
        if at < len(self.room):
            room, window = self.room.pop(at)
        else:
            if len(self.room) >= self.most:
                done = self.held.pop(self.room.pop(0)[1])
            room, window = self.size, self.next
            self.next += 1
            self.held[window] = []
        self.held[window].append((window, self.size - room, piece))
        if room == length:
            return done + self.held.pop(window)
        bisect.insort(self.room, (room - length, window))
        return done


def pack(docs: DataFrame, *, tokenizer: str, size: int = 2048, open_windows: int = 64, end_id: int = 1, merge: int = 64, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Packs every token of every text, each followed by ``end_id``, into sequences of at most ``size`` tokens.

    One row per piece: the id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id`` and ``offset``. Texts
    longer than ``size`` are cut into full pieces and one rest. Null and empty texts are one token; repeated rows are
    packed each by itself; an empty table gives an empty result; other columns are ignored. A partition keeps no more
    than ``open_windows`` windows; those still open at its end are merged by best fit, largest first, with those of
    ``merge`` neighbouring partitions, so no task sees more than merge * open_windows of them.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def packed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code, own = coder(tokenizer), TaskContext.get().partitionId()
        end, windows = np.array([end_id], "<u4").tobytes(), Windows(size, open_windows)

        def frame(rows: list[tuple], left: bool) -> pd.DataFrame:
            flat = [(*piece, own, window, offset, left) for window, offset, piece in rows]
            return pd.DataFrame(flat, columns=["id", "start", "length", "ids_crc32", "doc_tokens", "part", "window", "offset", "left"])

        for part in parts:
            for i in range(0, len(part), 1000):
                ids, out = part["id"].iloc[i : i + 1000].tolist(), []
                for doc, raw in zip(ids, code(part["t"].iloc[i : i + 1000].tolist())):
                    raw += end
                    n = len(raw) // 4
                    for start in range(0, n, size):
                        piece = raw[4 * start : 4 * (start + size)]
                        out += windows.put(len(piece) // 4, (doc, start, len(piece) // 4, zlib.crc32(piece), n))
                yield frame(out, False)
        yield frame([r for rows in windows.held.values() for r in rows], True)

    source = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    columns = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, part int, window long, offset long, left boolean"
    pieces = cut(source.mapInPandas(packed, columns))

    def merged(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["fill", "part", "window"], ascending=[False, True, True])
        windows, rows = Windows(size, len(part) + 1), []
        for r in part.itertuples(index=False):
            rows += windows.put(int(r.fill), (int(r.part), int(r.window)))
        rows += [r for held in windows.held.values() for r in held]
        first: dict[int, tuple[int, int]] = {}  # a merged window goes by the name of its first part
        for w, _, p in rows:
            first[w] = min(first.get(w, p), p)
        return pd.DataFrame([(*p, *first[w], base) for w, base, p in rows], columns=["part", "window", "to_part", "to_window", "base"])

    left = pieces.where("left").groupBy("part", "window").agg(F.sum("length").alias("fill"))
    left = left.withColumn("group", F.floor(F.col("part") / merge)).groupBy("group").applyInPandas(merged, "part int, window long, to_part int, to_window long, base long")
    moved = pieces.where("left").join(left, ["part", "window"])
    number = lambda part, window: F.shiftleft(F.col(part).cast("long"), 36) + F.col(window)
    kept = pieces.where("not left").withColumn("sequence_id", number("part", "window"))
    moved = moved.withColumn("sequence_id", number("to_part", "to_window")).withColumn("offset", F.col("offset") + F.col("base"))
    names = [F.col("id").alias(doc_id), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return kept.select(names).unionByName(moved.select(names))
