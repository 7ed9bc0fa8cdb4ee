"""LM scoring with a class-based bigram model: exchange clustering on counts of the whole corpus, smoothed transitions, word emissions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, delete

#: The end of a text as a word: it holds a space, so it is none of a text's own.
END = " "
#: Lengths at which a rare word's shape class changes; each is split by whether the word ends in one of MARKS.
EDGES, MARKS = (3, 5, 7, 9, 12, 16), ".,;:!?"
SHAPES = 2 * (len(EDGES) + 1)


#: Twice the number of EDGES that a length reaches, for lengths up to the last of them.
_STEPS = [2 * sum(n >= e for e in EDGES) for n in range(EDGES[-1] + 1)]
_MARKS = frozenset(MARKS.encode())


def words(text: str) -> list[bytes]:
    """The words of a text in UTF-8; bytes lower only A-Z and split only at ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shape(w: str) -> int:
    return _shape(w.encode("utf-8", "surrogatepass"))


def _shape(w: bytes) -> int:
    n = len(w) if w.isascii() else len(w.decode("utf-8", "replace"))
    return _STEPS[min(n, EDGES[-1])] + (w[-1] in _MARKS)


def utf8(batch: pa.RecordBatch) -> list[bytes]:
    """The texts of column t as they lie in the batch, without decoding them."""
    return batch.column(batch.schema.get_field_index("t")).cast(pa.large_binary()).to_pylist()


def shape_column(w: Column) -> Column:
    n = F.length(w)
    return 2 * sum((F.when(n >= e, 1).otherwise(0) for e in EDGES), F.lit(0)) + F.when(F.substr(w, n).isin(*MARKS), 1).otherwise(0)


def counts(texts: DataFrame, limit: int = 300_000) -> DataFrame:
    """(word, c) over all texts of column t, ends included: each task sums what it reads before anything is shuffled."""

    def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frame = lambda: pa.record_batch({"word": pa.array(list(got), pa.binary()), "c": pa.array(list(got.values()), pa.int64())})
        got: Counter[bytes] = Counter()
        for part in parts:
            for t in utf8(part):
                got.update(t.lower().split())
                if len(got) > limit:
                    yield frame()
                    got = Counter()
            got[END.encode()] += part.num_rows
        if got:
            yield frame()

    return texts.mapInArrow(counted, "word binary, c long").groupBy(F.col("word").cast("string").alias("word")).agg(F.sum("c").alias("c"))


#: Two-byte numbers that stand for a word of the lexicon with a larger one, told in ``more``, and for a word outside it, told in ``f`` and ``s``.
MORE, FAR = 65534, 65535


def encode(docs: DataFrame, lexicon: list[str]) -> DataFrame:
    """The rows of ``docs`` with the numbers of their words instead of the text t, so that later passes need not split texts again.

    ``codes`` has two bytes a word, the place in ``lexicon``, of which END is 0; words outside it are told by fingerprint in
    ``f`` and by shape in ``s``.
    """
    held = docs.sparkSession.sparkContext.broadcast(lexicon)  # a parameter's worth of words
    rest = [c for c in docs.columns if c != "t"]

    def coded(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {w.encode("utf-8", "surrogatepass"): i for i, w in enumerate(held.value)}
        for part in parts:
            rows = []
            for t in utf8(part):
                ws = t.lower().split()
                i = np.fromiter(map(at.get, ws, repeat(-1)), np.int32, len(ws))
                far = [ws[k] for k in np.flatnonzero(i < 0).tolist()]
                more = i[i >= MORE]
                i[i >= MORE], i[i < 0] = MORE, FAR
                f, s = np.array([xxhash.xxh64_intdigest(w, 42) for w in far], np.uint64), np.array([_shape(w) for w in far], np.int8)
                rows.append([x.tobytes() for x in (i.astype(np.uint16), more, f, s)])
            kept = {c: part.column(part.schema.get_field_index(c)) for c in rest}
            yield pa.record_batch(kept | {c: pa.array([r[i] for r in rows], pa.binary()) for i, c in enumerate(("codes", "more", "f", "s"))})

    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in rest)
    return docs.mapInArrow(coded, schema + "codes binary, more binary, f binary, s binary")


def _flat(batch: pa.RecordBatch, column: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column, and how many each row has."""
    values = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
    _, ends, data = values.buffers()
    ends = np.frombuffer(ends, np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]
    return np.frombuffer(data.tobytes(), kind), np.diff(ends) // np.dtype(kind).itemsize


def opened(parts: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(batch, x, n, f, s) by stretches of ``rows`` texts that ``encode`` made.

    x: the numbers of all words, -1 outside the lexicon, with an end before the first text and after each; n: words of
    each text; f and s: fingerprints and shapes of the words outside.
    """
    for part in parts:
        for i in range(0, part.num_rows, rows):
            batch = part.slice(i, rows)
            codes, n = _flat(batch, "codes", np.uint16)
            own = codes.astype(np.int32)
            own[codes == MORE] = _flat(batch, "more", np.int32)[0]
            own[codes == FAR] = -1
            x = np.zeros(len(own) + len(n) + 1, np.int32)
            x[np.arange(len(own)) + np.repeat(np.arange(1, len(n) + 1), n)] = own
            yield batch, x, n, _flat(batch, "f", np.int64)[0], _flat(batch, "s", np.int8)[0].astype(np.int32)


def bigrams(coded: DataFrame, lexicon: list[str], clustered: int) -> DataFrame:
    """(a, b, n): how often number b follows number a in all texts; the first ``clustered`` words have their own, others that of their shape."""
    size = clustered + SHAPES
    number = np.array([i if i < clustered else clustered + shape(w) for i, w in enumerate(lexicon)], np.int32)
    held = coded.sparkSession.sparkContext.broadcast(number)  # a number for each word of the lexicon

    def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for _, x, _, _, s in opened(parts):
            y = held.value[x].astype(np.int64)
            y[x < 0] = clustered + s
            total += np.bincount(y[:-1] * size + y[1:], minlength=size * size)
        keys = np.flatnonzero(total)
        yield pa.record_batch({"a": (keys // size).astype(np.int32), "b": (keys % size).astype(np.int32), "n": total[keys]})

    return coded.select("codes", "more", "f", "s").mapInArrow(counted, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def links(coded: DataFrame, classes: np.ndarray, k: int) -> DataFrame:
    """(a, b, n): how often class b follows class a where both words are of the lexicon; each task sums all its texts."""
    held = coded.sparkSession.sparkContext.broadcast(classes)  # a class for each word of the lexicon

    def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        for _, x, _, _, _ in opened(parts):
            near = (x[:-1] >= 0) & (x[1:] >= 0)
            c = held.value[x]
            total += np.bincount(c[:-1][near] * k + c[1:][near], minlength=k * k)
        keys = np.flatnonzero(total)
        yield pa.record_batch({"a": (keys // k).astype(np.int32), "b": (keys % k).astype(np.int32), "n": total[keys]})

    return coded.select("codes", "more", "f", "s").mapInArrow(counted, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def outside(coded: DataFrame, table: DataFrame, classes: np.ndarray, first: int) -> DataFrame:
    """(row, train, s, c, h, learned, l, r): every word of the texts that the lexicon lacks, once for each time it occurs.

    ``c`` is its count, ``h`` its class, ``l`` the class of what precedes it and ``r`` that of what follows, or -1 if the
    lexicon lacks that one too: it tells the two as its own l.
    """
    held = coded.sparkSession.sparkContext.broadcast(classes)  # a class for each word of the lexicon

    def listed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x, n, f, s in opened(parts):
            at = np.flatnonzero(x < 0)
            c = np.where(x < 0, -1, held.value[x]).astype(np.int32)
            text = np.repeat(np.arange(len(n)), n + 1)[at - 1]
            own = {name: batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)[text] for name in ("row", "train")}
            yield pa.record_batch(own | {"i": at.astype(np.int32), "f": f, "s": s, "l": c[at - 1], "r": c[at + 1]})

    rows = coded.select("row", "train", "codes", "more", "f", "s").mapInArrow(listed, "row long, train boolean, i int, f long, s int, l int, r int")
    rows = rows.join(table.select("f", "c", "h"), "f", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    rows = rows.withColumn("learned", F.col("h").isNotNull()).withColumn("h", F.coalesce("h", F.col("s") + first))
    before = F.lag("h").over(Window.partitionBy("row").orderBy("i"))
    return rows.withColumn("l", F.when(F.col("l") < 0, before).otherwise(F.col("l"))).select("row", "train", "s", "c", "h", "learned", "l", "r")


def frequent_bits(table: DataFrame, least: int, bits: int = 23) -> np.ndarray:
    """A bitmap of 2 ** ``bits`` places where the fingerprints of words that occur ``least`` times or more are marked.

    It only spares rows of rarer words: what passes by chance, in a large vocabulary all, is dropped by its count later.
    """
    at = table.where(F.col("c") >= least).select(F.xxhash64("word").bitwiseAND(F.lit((1 << bits) - 1)).alias("at"))
    marked = at.groupBy(F.shiftright("at", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 31 as int))")).alias("m"))
    out = np.zeros(1 << bits >> 5, np.int64)
    for r in marked.collect():  # at most 2 ** (bits - 5) rows
        out[r["w"]] = r["m"]
    return (out[:, None] >> np.arange(32) & 1).astype(bool).reshape(-1)


def contexts(coded: DataFrame, lexicon: list[tuple[str, int, int]], core: int, first: int, least: int, marked: np.ndarray) -> DataFrame:
    """(f, d, n): how often the word with fingerprint f, none of the first ``core``, is followed by class d or, for d from ``first`` + SHAPES on, preceded by class d less that.

    ``lexicon`` has a word, its count and, in the core, its class; all other words count by shape as neighbours. Rows are
    made for words that occur ``least`` times or more, outside the lexicon for those that ``marked`` has.
    """
    width = 2 * (first + SHAPES)
    cls = np.array([h if i < core else first + shape(w) for i, (w, _, h) in enumerate(lexicon)], np.int32)
    told = np.array([i >= core and c >= least for i, (_, c, _) in enumerate(lexicon)], bool)
    code = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 42) for w, _, _ in lexicon], np.uint64).view(np.int64)
    known = coded.sparkSession.sparkContext.broadcast((cls, told, code, np.packbits(marked)))  # some numbers for each word of the lexicon, and the bitmap

    def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, told, code, bits = known.value
        bits = np.unpackbits(bits).astype(bool)

        def frame(near, far):
            k, n = np.unique(np.concatenate(near), return_counts=True)
            yield pa.record_batch({"f": code[k // width], "d": k % width, "n": n.astype(np.int64)})
            f, d = (np.concatenate(x) for x in zip(*far))
            f, at = np.unique(f, return_inverse=True)
            k, n = np.unique(at * width + d, return_counts=True)
            yield pa.record_batch({"f": f[k // width], "d": (k % width).astype(np.int32), "n": n.astype(np.int64)})

        near, far, size = [], [], 0
        for _, x, _, f, s in opened(parts):
            c = cls[x]
            c[x < 0] = first + s
            after, before = c[1:], c[:-1] + width // 2
            own = told[x] & (x >= 0)
            y, z = own[:-1], own[1:]
            near += [x[:-1][y] * width + after[y], x[1:][z] * width + before[z]]  # below 2 ** 31 for a lexicon of ten millions
            at = np.flatnonzero(x < 0)
            some = bits[(f.view(np.uint64) & np.uint64(len(bits) - 1)).astype(np.int64)]
            at, f = at[some], f[some]
            far += [(f, after[at]), (f, before[at - 1])]  # a text's words lie between ends
            size += 2 * len(x)
            if size > 8_000_000:
                yield from frame(near, far)
                near, far, size = [], [], 0
        if near:
            yield from frame(near, far)

    return coded.select("codes", "more", "f", "s").mapInArrow(counted, "f long, d int, n long")


def assign(contexts: DataFrame, g: np.ndarray, classes: int, least: int, rounds: int = 3) -> DataFrame:
    """(f, h, c): the class and count of every word of the table ``contexts`` that occurs ``least`` times or more.

    ``g`` holds the bigrams of the clustered core, to which each word is added: in each round every word moves to the class
    that raises the likelihood of the words' neighbours by class most, given the classes of all words after the last round.
    """
    k = len(g)
    sums = contexts.groupBy("f", "d").agg(F.sum("n").alias("n")).groupBy("f").agg(F.collect_list("d").alias("d"), F.collect_list("n").alias("n"), F.sum(F.when(F.col("d") < k, F.col("n"))).alias("c"))
    at = cut(sums.where(F.col("c") >= least).withColumn("h", F.lit(0)))
    core = np.concatenate([g[1 : classes + 1], g[:, 1 : classes + 1].T], axis=1)
    d, total = core, core[:, :k].sum(1)
    for _ in range(rounds):

        def moved(parts: Iterator[pd.DataFrame], d=d, total=total) -> Iterator[pd.DataFrame]:
            fd, ft, got = _f(d), _f(total), np.zeros((classes, 2 * k))
            for part in parts:
                best = []
                for i in range(0, len(part), 500):
                    some = part[i : i + 500]
                    sizes = some["d"].map(len).to_numpy()
                    e, n = np.concatenate(some["d"].to_list()), np.concatenate(some["n"].to_list()).astype(np.float64)
                    c, old = some["c"].to_numpy(np.float64), some["h"].to_numpy(np.int64) - 1
                    gain = _f(d.T[e] + n[:, None]) - fd.T[e]
                    base = _f(total + c[:, None]) - ft
                    of = np.repeat(old, sizes)
                    own, mine = np.flatnonzero(of >= 0), np.flatnonzero(old >= 0)
                    gain[own, of[own]] = fd[of[own], e[own]] - _f(d[of[own], e[own]] - n[own])
                    base[mine, old[mine]] = ft[old[mine]] - _f(total[old[mine]] - c[mine])
                    new = (np.add.reduceat(gain, np.cumsum(sizes) - sizes, axis=0) - 2 * base).argmax(1)
                    np.add.at(got, (np.repeat(new, sizes), e), n)
                    best.append(new + 1)
                if best:
                    yield part.assign(h=np.concatenate(best))
            h, e = np.nonzero(got)
            if len(h):
                yield pd.DataFrame({"f": pd.array([None], "Int64"), "d": [(h * 2 * k + e).tolist()], "n": [got[h, e].astype(np.int64).tolist()], "c": [0], "h": [0]})

        out = cut(at.mapInPandas(moved, "f long, d array<int>, n array<long>, c long, h int"))
        d = core.copy()
        for r in out.where("f is null").select(F.explode(F.arrays_zip("d", "n")).alias("z")).groupBy("z.d").agg(F.sum("z.n").alias("n")).collect():  # at most classes x 2 k rows
            d[r["d"] // (2 * k), r["d"] % (2 * k)] += r["n"]
        total = d[:, :k].sum(1)
        delete(at)
        at = out.where("f is not null")
    return at.select("f", "h", "c")


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-12))


def exchange(n: np.ndarray, clustered: int, classes: int, rounds: int = 12) -> np.ndarray:
    """Classes of the numbers of a bigram matrix: END is 0, clustered words 1 to ``classes``, each shape one of its own.

    Words begin in classes by rank; then each in turn moves to the class that raises the likelihood of the class
    bigrams most, until a round moves none or ``rounds`` are done.
    """
    size = len(n)
    label = np.zeros(size, np.int64)
    label[1:clustered] = 1 + np.arange(clustered - 1) % classes
    label[clustered:] = classes + 1 + np.arange(size - clustered)
    k = classes + 1 + size - clustered
    onehot = np.zeros((size, k))
    onehot[np.arange(size), label] = 1
    g = onehot.T @ n @ onehot
    right, left = n @ onehot, n.T @ onehot  # a word's followers and predecessors by class
    own, out, come = np.diag(n), n.sum(1), n.sum(0)
    open_to = np.arange(1, classes + 1)
    for _ in range(rounds):
        moved = 0
        for w in range(1, clustered):
            old = label[w]
            r, c, s = right[w].copy(), left[w].copy(), own[w]
            r[old] -= s
            c[old] -= s
            g[old] -= r
            g[:, old] -= c
            g[old, old] -= s
            row, col = g.sum(1), g.sum(0)
            gain = (_f(g + r) - _f(g)).sum(1) + (_f(g + c[:, None]) - _f(g)).sum(0)
            d = np.diag(g)
            gain += _f(d + r + c + s) - _f(d + r) - _f(d + c) + _f(d)
            gain -= _f(row + out[w]) - _f(row) + _f(col + come[w]) - _f(col)
            new = int(open_to[gain[open_to].argmax()])
            g[new] += r
            g[:, new] += c
            g[new, new] += s
            if new != old:
                label[w], moved = new, moved + 1
                right[:, old] -= n[:, w]
                right[:, new] += n[:, w]
                left[:, old] -= n[w]
                left[:, new] += n[w]
        if not moved:
            break
    return label


@dataclass
class Model:
    """``lexicon``: the most frequent words with counts and classes; ``logt``: log10 of transitions; shapes are for words without a learned class."""

    lexicon: list[tuple[str, int, int]]  # word, count, class; END is first
    logt: np.ndarray
    class_total: np.ndarray
    shape_total: np.ndarray
    shape_types: np.ndarray
    first_shape: int
    tokens: int
    types: int
    discount: float = 0.6


def fit(texts: DataFrame, **options) -> tuple[Model, DataFrame]:
    """Learns from all texts of column t, with the options of ``fit_score``: the model, and the table (word, c, f, h) of all counts, fingerprints and learned classes."""
    model, table, coded, far = _learned(texts.select("t", F.lit(True).alias("train")), **options)
    delete(coded)
    delete(far)
    return model, table


def fit_score(docs: DataFrame, train: Column, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``score`` of all rows by the model that the rows with ``train`` give, each text being split into words twice only.

    ``clustered`` words are clustered into ``classes`` by exchange. Every other word that occurs ``least_count`` times or
    more then moves to the class that suits its neighbours best; rarer ones have one class for each shape. The most
    frequent words, at most ``lexicon``, travel with the model. These are the model's size; every count behind it covers all of the training rows.
    """
    model, _, coded, far = _learned(_source(docs, doc_id, text, train), **options)
    return _scored(coded, far, model, doc_id)


def _source(docs: DataFrame, doc_id: str, text: str, train: Column) -> DataFrame:
    return docs.select(F.col(doc_id).alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.coalesce(F.col(text), F.lit("")).alias("t"))


def _learned(source: DataFrame, *, classes: int = 60, clustered: int = 1000, lexicon: int = 150_000, least_count: int = 10) -> tuple[Model, DataFrame, DataFrame, DataFrame]:
    """The model of the rows with ``train``, its table of words, and the texts of all rows in numbers, with the words outside the lexicon."""
    texts = source.where("train").select("t")
    table = cut(counts(texts))
    tokens, types = table.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # the most frequent words by levels of 1/32 of a doubling, so no task sorts or sends more than its part of them
    level = F.floor(F.log2(F.col("c")) * 32).cast("int")
    least, room, part = 1 << 30, lexicon, 1.0
    for r in sorted(table.where(F.col("word") != END).groupBy(level.alias("level")).count().collect(), reverse=True):  # at most 2,016 rows
        room -= r["count"]
        least = r["level"]
        if room < 0:  # of this level the words that hash lowest, some hundredths fewer than there is room for
            part = max(0.0, (room + r["count"]) / r["count"] - 4 * (r["count"] ** -0.5))
            break
    low = F.pmod(F.xxhash64("word", F.lit(7)), F.lit(1 << 20)) < int(part * (1 << 20))
    frequent = table.where((F.col("word") != END) & ((level > least) | (level == least) & low)).collect()  # about ``lexicon`` rows
    top = sorted(((r["word"], r["c"]) for r in frequent), key=lambda x: (-x[1], x[0]))
    ends = table.where(F.col("word") == END).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    own = [END, *(w for w, _ in top[: clustered - 1])]
    named = [END, *(w for w, _ in top)]
    size = len(own) + SHAPES
    coded = cut(encode(source, named).withColumn("row", F.monotonically_increasing_id()))
    training = coded.where("train")

    def assigned(part: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros((size, size))
        n[part["a"], part["b"]] = part["n"]
        label = exchange(n, len(own), classes)
        onehot = np.zeros((size, classes + 1 + SHAPES))
        onehot[np.arange(size), label] = 1
        g = onehot.T @ n @ onehot
        return pd.DataFrame({"label": [label.tolist()], "g": [g.reshape(-1).tolist()]})

    # at most (clustered + SHAPES) squared rows, whatever the input
    got = bigrams(training, named, len(own)).groupBy(F.lit(0).alias("all")).applyInPandas(assigned, "label array<int>, g array<double>").collect()
    k = classes + 1 + SHAPES
    label = np.array(got[0]["label"]) if got else np.concatenate([[0], 1 + np.arange(len(own) - 1) % classes, classes + 1 + np.arange(SHAPES)])
    g = np.array(got[0]["g"]).reshape(k, k) if got else np.zeros((k, k))
    core = {w: int(label[i]) for i, w in enumerate(own)}
    words_ = [(END, int(ends), 0), *((w, int(c), core.get(w, -1)) for w, c in top)]
    learned = assign(contexts(training, words_, len(own), classes + 1, least_count, frequent_bits(table, least_count)), g, classes, least_count)
    code = lambda w: int(np.uint64(xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 42)).view(np.int64))
    others = {code(w): w for w, _ in top[len(own) - 1 :]}
    wanted = F.broadcast(texts.sparkSession.createDataFrame(pa.table({"f": pa.array(list(others), pa.int64())})))  # at most ``lexicon`` words
    class_of = core | {others[r["f"]]: r["h"] for r in learned.join(wanted, "f").select("f", "h").collect()}
    words_ = [(END, int(ends), 0)]
    words_ += [(w, int(c), class_of.get(w, classes + 1 + shape(w))) for w, c in top]
    # transitions between the classes of all words: those outside the lexicon are joined by fingerprint, once for these and for the scores
    of = np.array([h for _, _, h in words_], np.int64)
    counted = table.withColumn("f", F.xxhash64("word")).join(learned.select("f", "h"), "f", "left").select("word", "c", "f", "h")
    far = cut(outside(coded, counted, of, classes + 1))
    met = far.where("train")
    g = np.zeros((k, k))
    for side in (links(training, of, k), met.groupBy(F.col("l").alias("a"), F.col("h").alias("b")).agg(F.count(F.lit(1)).alias("n")), met.where("r >= 0").groupBy(F.col("h").alias("a"), F.col("r").alias("b")).agg(F.count(F.lit(1)).alias("n"))):
        for r in side.collect():  # at most k squared rows
            g[r["a"], r["b"]] += r["n"]
    # Witten-Bell interpolation with the unigram of classes
    follow, kinds = g.sum(1), (g > 0).sum(1)
    unigram = (g.sum(0) + 1) / (g.sum() + k)
    part = np.divide(follow, follow + kinds, out=np.zeros(k), where=follow + kinds > 0)
    logt = np.log10(part[:, None] * np.divide(g, follow[:, None], out=np.zeros_like(g), where=follow[:, None] > 0) + (1 - part[:, None]) * unigram)
    class_total = np.zeros(classes + 1)
    for _, c, h in words_[: len(own)]:
        class_total[h] += c
    for r in learned.groupBy("h").agg(F.sum("c").alias("c")).collect():  # ``classes`` rows
        class_total[r["h"]] += r["c"]
    rare = table.where(F.col("c") < least_count).join(F.broadcast(texts.sparkSession.createDataFrame(pa.table({"word": pa.array(own, pa.string())}))), "word", "left_anti")  # ``clustered`` words
    shape_total, shape_types = np.zeros(SHAPES), np.zeros(SHAPES)
    for r in rare.groupBy(shape_column(F.col("word")).alias("s")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect():  # SHAPES rows
        shape_total[r["s"]], shape_types[r["s"]] = r["c"], r["v"]
    return Model(words_, logt, class_total, shape_total, shape_types, classes + 1, int(tokens), int(types)), counted, coded, far


def _rare(model: Model, c: np.ndarray, s: np.ndarray) -> np.ndarray:
    """log10 of the emission of words with counts c and shapes s: known ones give up a discount, which the unknown word of the shape gets."""
    total, types = model.shape_total[s], model.shape_types[s]
    p = np.where(c > 0, c - model.discount, np.where(types > 0, model.discount * types, 1.0)) / np.where(total > 0, total, 1.0)
    return np.log10(p)


def score(docs: DataFrame, model: Model, table: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: the id, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` and ``perplexity``.

    Null text counts as empty, which is one end. Repeated rows and ids are scored each by itself; other columns are
    ignored. Counts and classes of words outside the lexicon are looked up in ``table`` by a join on 64-bit fingerprints, so the
    vocabulary is never broadcast. The model is a distribution over words with one unknown word for each shape.
    """
    coded = cut(encode(_source(docs, doc_id, text, F.lit(True)), [w for w, _, _ in model.lexicon]).withColumn("row", F.monotonically_increasing_id()))
    far = cut(outside(coded, table, np.array([h for _, _, h in model.lexicon], np.int64), model.first_shape))
    return _scored(coded, far, model, doc_id)


def _scored(coded: DataFrame, far: DataFrame, model: Model, doc_id: str) -> DataFrame:
    held = coded.sparkSession.sparkContext.broadcast(model)  # bounded by the model's parameters

    def local(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        c = np.array([x[1] for x in m.lexicon], np.float64)
        h = np.array([x[2] for x in m.lexicon], np.int64)
        base = np.log10((c + 1) / (m.tokens + m.types + 1))
        closed = h < m.first_shape
        emit = np.zeros(len(c))
        emit[closed] = np.log10(np.where(c[closed] > 0, c[closed], 1) / np.where(m.class_total[h[closed]] > 0, m.class_total[h[closed]], 1))
        emit[~closed] = _rare(m, c[~closed], h[~closed] - m.first_shape)
        logt = m.logt.reshape(-1)
        for batch, x, n, _, _ in opened(parts):
            one, two = x[:-1], x[1:]
            text = np.repeat(np.arange(len(n)), n + 1)  # of each word and its end
            near = two >= 0
            both = near & (one >= 0)
            value = np.where(near, emit[two], 0.0)
            value[both] += logt[h[one[both]] * len(m.logt) + h[two[both]]]
            sums = [np.bincount(text, weights=w, minlength=len(n)) for w in (near & (c[two] > 0), np.where(near, base[two], 0.0), value)]
            own = {name: batch.column(batch.schema.get_field_index(name)) for name in ("row", "id")}
            yield pa.record_batch(own | {"n": n + 1, "known": sums[0].astype(np.int64), "base": sums[1], "score": sums[2]})

    kind = coded.schema["id"].dataType.simpleString()
    scored = coded.select("row", "id", "codes", "more", "f", "s").mapInArrow(local, f"row long, id {kind}, n long, known long, base double, score double")
    look = lambda x, at: F.element_at(F.split(F.lit(",".join(repr(float(v)) for v in x)), ",").cast("array<double>"), (at + 1).cast("int"))
    hop = lambda a, b: look(model.logt.reshape(-1), a * len(model.logt) + b)
    total, types = look(model.shape_total, F.col("s")), look(model.shape_types, F.col("s"))
    p = F.when(F.col("learned"), F.col("c") / look(model.class_total, F.col("h"))).otherwise(F.when(F.col("c") > 0, F.col("c") - model.discount).otherwise(F.when(types > 0, types * model.discount).otherwise(1.0)) / F.when(total > 0, total).otherwise(1.0))
    hops = hop(F.col("l"), F.col("h")) + F.when(F.col("r") >= 0, hop(F.col("h"), F.col("r"))).otherwise(0.0)
    sums = far.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, 1).otherwise(0)).alias("known2"),
        F.sum(F.log10((F.col("c") + 1) / F.lit(float(model.tokens + model.types + 1)))).alias("base2"),
        F.sum(F.log10(p) + hops).alias("score2"),
    )
    out = scored.select("row", "id", "n", "known", "base", "score").join(sums, "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return out.select(
        F.col("id").alias(doc_id), F.col("n").alias("n_tokens"), plus("known", "known2").cast("long").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        plus("base", "base2").alias("base_score"), plus("score", "score2").alias("score"), F.pow(F.lit(10.0), -plus("score", "score2") / F.col("n")).alias("perplexity"),
    )
