"""Periodic runs of words: Lyndon arrays under both orders by Baier's grouping, roots extended to runs by common extensions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Primes under 2^31, so that products of residues fit in 63 bits.
PRIMES = (2_147_483_647, 2_147_483_629)


def lyndon(ranks: list[int]) -> list[int]:
    """The length of the longest Lyndon word that begins at each position, where the end of the text is smaller than any rank.

    Phase one of Baier's suffix sorting. Positions are grouped by what is known of their Lyndon words, at first one
    rank each (``ranks`` are dense, from 0). Groups are taken from the highest down. Every member looks for the
    nearest position before it whose group has not been taken; that position's word grows by the member's, once for
    each member that points at it, and it moves to a new group right above its old one. Linear in the text.
    """
    n, kinds = len(ranks), max(ranks, default=-1) + 1
    group = list(ranks)
    members: list[list[int]] = [[] for _ in range(kinds)]
    for i, g in enumerate(ranks):
        members[g].append(i)
    length = [1] * kinds
    lower, upper = list(range(-1, kinds - 1)), [*range(1, kinds), -1]
    before = [-2] * n  # -2 until the position's group is taken
    g = kinds - 1
    while g >= 0:
        targets: dict[tuple[int, int], list[int]] = {}
        at, times = -1, 0
        for s in members[g]:
            if group[s] != g:
                continue
            j = s - 1
            while j >= 0 and before[j] != -2:
                j = before[j]
            before[s] = j
            if j == at:
                times += 1
                continue
            if at >= 0:
                targets.setdefault((times, group[at]), []).append(at)
            at, times = j, 1
        if at >= 0:
            targets.setdefault((times, group[at]), []).append(at)
        members[g] = []
        for times, old in sorted(targets, reverse=True) if len(targets) > 1 else targets:
            moved, new = targets[times, old], len(length)
            for j in moved:
                group[j] = new
            members.append(moved)
            length.append(length[old] + times * length[g])
            over = upper[old]
            lower.append(old)
            upper.append(over)
            lower[over] = new  # over is never -1: group g lies above
            upper[old] = new
        g = lower[g]
    return [length[x] for x in group]


class Extensions:
    """Longest common extensions of two positions of one text, by prefix sums of powers under two primes."""

    def __init__(self, words: np.ndarray, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.n, self.sums, self.powers = len(words), [], []
        for p in PRIMES:
            value = rng.integers(1, p, int(words.max(initial=0)) + 1)[words]
            power = np.ones(self.n + 1, np.int64)
            step, have = int(rng.integers(2, p)), 1
            while have <= self.n:
                more = min(have, self.n + 1 - have)
                power[have : have + more] = power[:more] * step % p
                step, have = step * step % p, have + more
            self.powers.append(power)
            self.sums.append(np.concatenate([[0], np.cumsum(value * power[:-1] % p) % p]))

    def equal(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether stretches at i and at j, i < j, agree; never false for stretches that do."""
        good = np.ones(len(i), bool)
        for p, power, sums in zip(PRIMES, self.powers, self.sums):
            good &= (sums[i + length] - sums[i]) % p * power[j - i] % p == (sums[j + length] - sums[j]) % p
        return good

    def reach(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How far the text agrees from i and from j on, or before them, up to ``most``."""
        out = np.zeros(len(i), np.int64)
        for bit in reversed(range(int(most.max(initial=0)).bit_length())):
            step = out + (1 << bit)
            fits = np.flatnonzero(step <= most)
            shift = -step[fits] if back else out[fits]
            good = self.equal(i[fits] + shift, j[fits] + shift, step[fits] if back else np.full(len(fits), 1 << bit))
            out[fits[good]] += 1 << bit
        return out


def find(words: np.ndarray, least: int, times: int) -> list[tuple[int, int, int]]:
    """The runs (start, length, period) of at least ``least`` words and ``times`` periods (3 or more), by start, then period.

    A run of period q holds, under one of the two orders, its Lyndon root as the longest Lyndon word of a position in
    its first q words. So each position is a candidate with its two Lyndon lengths; those that begin a square are
    extended both ways. Every run is compared word by word in the end; if a sum has deceived, others are drawn.
    """
    n = len(words)
    kinds, ranks = np.unique(words, return_inverse=True)
    places = np.arange(n)
    lengths = [np.array(lyndon(r.tolist()), np.int64) for r in (ranks, len(kinds) - 1 - ranks)]
    seed = 0
    while True:
        ext, found, sound = Extensions(ranks, seed), set(), True
        for q in lengths:
            i = np.flatnonzero(places + 2 * q <= n)
            i = i[(ranks[i] == ranks[i + q[i]]) & (ranks[i + q[i] - 1] == ranks[i + 2 * q[i] - 1])]
            i = i[ext.equal(i, i + q[i], q[i])]
            square = np.zeros(n, bool)
            square[i] = True
            last = i - q[i]
            i = i[(last < 0) | ~square[last] | (q[last] != q[i])]  # else one root earlier tells the same run
            p = q[i]
            left = ext.reach(i, i + p, i, True)
            length = left + p + ext.reach(i, i + p, n - i - p, False)
            keep = length >= np.maximum(least, times * p)
            found.update(zip((i - left)[keep].tolist(), length[keep].tolist(), p[keep].tolist()))
        for s, m, p in found:
            e = s + m
            whole = bool((ranks[s : e - p] == ranks[s + p : e]).all())
            sound &= whole and (s == 0 or ranks[s - 1] != ranks[s - 1 + p]) and (e == n or ranks[e] != ranks[e - p])
        if sound:
            return sorted(found, key=lambda r: (r[0], r[2]))
        seed += 1


def stretches(words: np.ndarray, owner: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words that may lie in a run: (place in the input, word, number of the stretch), neighbours only within a stretch.

    Each word of a run occurs ``times`` times in it, so a word that is rarer in its stretch parts the stretch; nothing
    is lost, since such a word can't extend a run either. Stretches shorter than ``least`` go. Repeated until all stay.
    """
    place = np.arange(len(words))
    kinds = int(words.max(initial=0)) + 1
    while len(words):
        _, at, counts = np.unique(owner * kinds + words, return_inverse=True, return_counts=True)
        keep = np.flatnonzero(counts[at] >= times)
        if not len(keep):
            return place[:0], words[:0], owner[:0]
        p, o = place[keep], owner[keep]
        new = np.concatenate([[0], np.cumsum((p[1:] != p[:-1] + 1) | (o[1:] != o[:-1]))])
        long = np.bincount(new)[new] >= least
        done = len(keep) == len(words) and long.all()
        place, words, owner = p[long], words[keep][long], new[long]
        if done:
            break
    return place, words, owner


def runs(docs: DataFrame, *, least: int = 24, times: int = 3, doc_id: str = "doc_id", text: str = "text", part: int = 1 << 22) -> DataFrame:
    """The periodic runs of every whole text, and the text without their repeats.

    One row per input row: the id, ``n_words``, ``runs`` (array of start, length, period as long, by start, then period)
    and ``collapsed``. Words are what ASCII white space parts, numbered from 0. A run is a stretch of consecutive words
    with smallest period q that no neighbouring word extends, of at least ``least`` words and ``times`` periods (3 or
    more). ``collapsed`` joins by one space the words that no run holds after its first q words.

    A null or empty text has no words, no runs and an empty ``collapsed``. Repeated rows and rows without an id are rows
    of their own; other columns are ignored, whatever their names; an empty table gives an empty result. Texts stay where
    they are: nothing is shuffled, and a task holds texts of ``part`` bytes or one text, with some 200 bytes for each
    word that may lie in a run.
    """
    if times < 3:
        raise ValueError("times must be 3 or more")
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("binary").alias("text"))

    def search(texts: list[bytes | None]) -> tuple[list[int], list[list[tuple[int, int, int]]], list[bytes]]:
        split = [(t or b"").split() for t in texts]
        sizes = np.array([len(w) for w in split], np.int64)
        known: dict[bytes, int] = {}
        flat = np.fromiter((known.setdefault(x, len(known)) for w in split for x in w), np.int64, int(sizes.sum()))
        first = np.cumsum(sizes) - sizes
        place, words, owner = stretches(flat, np.repeat(np.arange(len(split)), sizes), least, times)
        found: list[list[tuple[int, int, int]]] = [[] for _ in split]
        cuts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1], [True]])) if len(owner) else np.zeros(1, int)
        for a, b in zip(cuts[:-1], cuts[1:]):
            doc = int(np.searchsorted(first, place[a], "right")) - 1
            shift = int(place[a] - first[doc])
            found[doc] += [(s + shift, m, p) for s, m, p in find(words[a:b], least, times)]
        out = []
        for w, r in zip(split, found):
            if r:
                level = np.zeros(len(w) + 1, np.int64)
                for s, m, p in r:
                    level[s + p] += 1
                    level[s + m] -= 1
                w = [w[k] for k in np.flatnonzero(np.cumsum(level[:-1]) == 0)]
            out.append(b" ".join(w))
        return sizes.tolist(), found, out

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in parts:
            texts = batch.column("text").to_pylist()
            at = 0
            while at < len(texts):
                upto, size = at, 0
                while upto < len(texts) and (upto == at or size + len(texts[upto] or b"") <= part):
                    size += len(texts[upto] or b"")
                    upto += 1
                n, found, out = search(texts[at:upto])
                told = [[{"start": s, "length": m, "period": p} for s, m, p in r] for r in found]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, upto - at), pa.array(n, pa.int64()), pa.array(told, run), pa.array(out, pa.binary())], ["id", "n_words", "runs", "collapsed"])
                at = upto

    kind = docs.schema[doc_id].dataType.simpleString()
    out = rows.mapInArrow(batches, f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
    return out.select(F.col("id").alias(doc_id), "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))
