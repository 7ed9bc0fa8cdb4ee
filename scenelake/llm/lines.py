"""Line deduplication: once-seen and twice-seen Bloom filters of line hashes; only suspected repeats are shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, delete

#: Bits that a key sets in a filter.
BITS = 4


def key(line: bytes) -> bytes:
    """A line without ASCII white space at its ends, A-Z in lower case."""
    return line.strip().lower()


def counted(found: bytes, least: int) -> bool:
    """Whether a key has at least ``least`` code points."""
    return len(found) >= least and (len(found) >= 4 * least or len(found.decode()) >= least)


def keys(text: bytes | None, least: int) -> list[bytes]:
    """The distinct keys of a text that count."""
    return [k for k in {key(x) for x in (text or b"").split(b"\n")} if counted(k, least)]


def hashed(found: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in found), np.uint64, len(found))


def places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each hash, a row each, in a filter of ``bits`` bits, a power of two. Halving a filter halves the places."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return (hashes[:, None] + np.arange(BITS, dtype=np.uint64) * step[:, None]) & np.uint64(bits - 1)


def put(words: np.ndarray, hashes: np.ndarray) -> None:
    at = places(hashes, len(words) * 64).ravel()
    np.bitwise_or.at(words, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))


def holds(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = places(hashes, len(words) * 64)
    return ((words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(1)


def folded(words: np.ndarray, bits: int) -> np.ndarray:
    """The filter cut to ``bits`` bits; what it holds stays in it."""
    while len(words) * 64 > bits:
        words = words[: len(words) // 2] | words[len(words) // 2 :]
    return words


def power(n: float) -> int:
    """The smallest power of two from n on, 64 at least."""
    return max(64, 1 << max(0, ceil(n) - 1).bit_length())


def twice_seen(docs: DataFrame, text: str, least: int, per_piece: int, bound: int) -> Callable[[Column], Column]:
    """An expression that gives the keys of a text which documents before may hold too; keys of two rows are never missed.

    Hashes, distinct for each batch, go to the piece of the hash space they belong to. A piece holds a once-seen filter
    of 16 bits a key and adds what it has seen before to a twice-seen filter. The pieces of that filter are folded to
    16 bits for each repeated key, all together at most ``bound`` bits, and joined to one filter that goes to all tasks.
    With more repeated keys than ``bound`` is made for, more keys are suspected in vain; no repeat is lost.
    """
    spark = docs.sparkSession

    def told(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            found = [hashed(keys(t, least)) for t in batch.column(0).to_pylist()]
            h, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, int))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n > 1)], ["h", "again"])

    hashes = cut(docs.select(F.col(text).cast("binary")).mapInArrow(told, "h long, again boolean"))
    total = hashes.count()
    pieces = max(1, ceil(total / per_piece))
    size = power(16 * total / pieces)
    piece = F.pmod(F.shiftright("h", 40), F.lit(pieces).cast("long"))

    def build(table: pa.Table) -> pa.Table:
        once, twice = np.zeros(size // 64, np.uint64), np.zeros(size // 64, np.uint64)
        for batch in table.to_batches(max_chunksize=1 << 16):
            h = batch.column("h").to_numpy().view(np.uint64)
            again = batch.column("again").to_numpy(zero_copy_only=False)
            alone, at, n = np.unique(h, return_index=True, return_counts=True)
            put(twice, alone[(n > 1) | holds(once, alone)])
            put(twice, h[again])
            put(once, alone)
        n = int(np.bitwise_count(twice).sum())
        return pa.table({"piece": table.column("piece").slice(0, 1), "set": [n], "words": [twice.tobytes()]})

    built = cut(hashes.withColumn("piece", piece).groupBy("piece").applyInArrow(build, "piece long, set long, words binary"))
    repeats = (built.agg(F.sum("set")).first()[0] or 0) / BITS
    most = bound // pieces
    bits = min(power(16 * repeats / pieces), size, max(64, 1 << (most.bit_length() - 1)) if most else 64)

    def fold(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            cutted = [folded(np.frombuffer(w.as_buffer(), np.uint64), bits).tobytes() for w in batch.column("words")]
            yield pa.RecordBatch.from_arrays([batch.column("piece"), pa.array(cutted, pa.binary())], ["piece", "words"])

    words = np.zeros((pieces, bits // 64), np.uint64)
    for p, w in built.select("piece", "words").mapInArrow(fold, "piece long, words binary").collect():  # at most ``bound`` bits
        words[p] = np.frombuffer(w, np.uint64)
    delete(hashes)
    delete(built)
    sent = spark.sparkContext.broadcast(words)

    @F.pandas_udf("array<string>")
    def suspects(texts: pd.Series) -> pd.Series:
        filters = sent.value
        found = [keys(t, least) for t in texts]
        flat = [k for ks in found for k in ks]
        h = hashed(flat)
        own = ((h.view(np.int64) >> 40) % pieces).astype(np.int64)
        at = places(h, bits)
        good = ((filters[own[:, None], (at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(1)
        ends = np.cumsum([0, *map(len, found)])
        return pd.Series([[flat[i].decode() for i in range(a, b) if good[i]] for a, b in zip(ends[:-1], ends[1:])], dtype=object)

    return lambda c: suspects(c.cast("binary"))


def dedupe(docs: DataFrame, *, least: int = 10, doc_id: str = "doc_id", text: str = "text", per_piece: int = 1 << 22, bound: int = 1 << 28) -> DataFrame:
    """Drops lines whose key stands in a document of a smaller id.

    One row per input row: the id, ``n_lines``, ``n_dropped`` and ``kept``, the lines that stay. Lines are parted by \\n; a
    line's key is the line without ASCII white space at its ends, A-Z in lower case. Keys of at least ``least`` code
    points that two documents hold keep their lines, repeats too, only in the document of the smallest id.

    A null or empty text is one empty line. Rows that share an id are one document; rows without an id are one document
    that comes after all others. Other columns are ignored, whatever their names; an empty table gives an empty result.
    Only lines that the twice-seen filter holds are shuffled, to be compared as text, and only texts that hold such a
    line meet their dropped keys by a shuffle join on id and digests of the text; all other texts stay where they are.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    suspects = twice_seen(rows, "text", least, per_piece, bound)
    rows = rows.withColumn("suspects", suspects(F.col("text")))
    place = ["r1", "r2"]
    marked = rows.where(F.size("suspects") > 0).withColumn("r1", F.xxhash64("text")).withColumn("r2", F.hash("text"))
    lines = cut(marked.select("id", *place, F.explode("suspects").alias("key")))
    low, high, none = F.min("id").alias("low"), F.max("id").alias("high"), F.max(F.col("id").isNull()).alias("none")
    first = lines.groupBy("key").agg(low, high, none).where((F.col("low") < F.col("high")) | (F.col("none") & F.col("low").isNotNull())).select("key", "low")
    first = cut(first)  # so that both sides of the join are plain shuffles, and a line that very many documents hold can be split
    drops = lines.join(first, "key").where(~F.col("id").eqNullSafe(F.col("low")))
    drops = drops.groupBy("id", *place).agg(F.collect_set("key").alias("dropped")).select(F.col("id").alias("of"), *[F.col(c).alias(f"d{c}") for c in place], "dropped")

    @F.pandas_udf("n_dropped long, kept binary")
    def without(texts: pd.Series, dropped: pd.Series) -> pd.DataFrame:
        out = []
        for t, d in zip(texts, dropped):
            gone = set() if d is None else {x.encode() for x in d}
            lines = t.split(b"\n")
            kept = [x for x in lines if key(x) not in gone]
            out.append((len(lines) - len(kept), b"\n".join(kept)))
        return pd.DataFrame(out, columns=["n_dropped", "kept"])

    met = marked.join(drops, F.col("id").eqNullSafe(F.col("of")) & (F.col("r1") == F.col("dr1")) & (F.col("r2") == F.col("dr2")), "left")
    changed = met.withColumn("new", F.when(F.col("dropped").isNotNull(), without(F.col("text").cast("binary"), "dropped")))
    changed = changed.select("id", "text", F.coalesce("new.n_dropped", F.lit(0)).cast("long").alias("n_dropped"), F.coalesce(F.col("new.kept").cast("string"), "text").alias("kept"))
    same = rows.where(F.size("suspects") == 0).select("id", "text", F.lit(0).cast("long").alias("n_dropped"), F.col("text").alias("kept"))
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1
    return same.unionByName(changed).select(F.col("id").alias(doc_id), n_lines.cast("long").alias("n_lines"), "n_dropped", "kept")
