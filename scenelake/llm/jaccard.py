"""Exact n-gram Jaccard join by set relations: index lists keyed by blocks of positions, and answers taken over from similar sets."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, delete
from .graph import components

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class Words(dict):
    """64-bit fingerprints of words; a bounded cache spares most of the hashing."""

    def __missing__(self, w: bytes) -> int:
        n = self[w] = xxhash.xxh3_64_intdigest(w)
        return n


_words = Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, width: int) -> np.ndarray:
    """The set of a text as sorted 64-bit fingerprints: all runs of ``width`` words, or the whole sequence if it is shorter."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    if len(_words) > 300_000:
        _words.clear()
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(width, len(h))
    with np.errstate(over="ignore"):
        acc = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            acc = _mix(acc * _A + h[k : len(h) - n + 1 + k] + _B)
    return np.unique(acc)


@lru_cache(maxsize=64)
def levels(num: int, den: int, top: int) -> tuple[int, ...]:
    """First sizes of levels such that sets which can link lie in the same or in neighbouring ones."""
    out = [1]
    while out[-1] <= top:
        out.append(out[-1] * den // num + 1)
    out.append(out[-1] * den // num + 1)
    return tuple(out)


@lru_cache(maxsize=4096)
def blocks(num: int, den: int, least: int, most: int) -> tuple[int, int]:
    """How many elements sets of at most ``most`` elements that link differ in, and how many blocks more than that a level has.

    With s of these, a set with fewer than s empty blocks shares one that is not empty with any set it links with. So s
    is four deviations over the empty blocks that the smallest sets of the level, of ``least`` elements, may have.
    """
    differ, spare = 2 * most * (den - num) // (den + num), 2
    for _ in range(4):
        m = differ + spare
        empty = m * math.exp(-least / m)
        spare = max(2, min(differ + 1, math.ceil(1 + empty + 4 * math.sqrt(empty))))
    return differ, spare


def block_keys(s: np.ndarray, num: int, den: int) -> tuple[np.ndarray, int]:
    """Keys of a set's blocks, and how many of them it shares at least with any set that it links with.

    Fingerprints in order fill m blocks of equal ranges. Two sets of a level differ in at most D elements; with
    m = D + s blocks s of them agree, of which a set with fewer than s empty blocks has one that is not empty. So empty
    blocks are left out, but for the very few sets with more of them. A set enters its own size level and the next.
    What a set shares with one that it links with is at least s blocks less its own empty ones.
    """
    n = len(s)
    top = 1 << max(8, n.bit_length())
    first = levels(num, den, top)
    own = int(np.searchsorted(first, n, side="right")) - 1
    out, need = [], n + 1
    with np.errstate(over="ignore"):
        mixed = _mix(s * _C + _A)
        for level in (own, own + 1):
            differ, spare = blocks(num, den, first[max(0, level - 1)], first[level + 1] - 1)
            if not differ:
                continue
            m = differ + spare
            block = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            sums = np.add.reduceat(mixed, starts)
            which = block[starts]
            need = min(need, max(1, spare - (m - len(starts))))
            if m - len(starts) >= spare:
                full, which = np.zeros(m, np.uint64), np.arange(m, dtype=np.uint64)
                full[block[starts]] = sums
                sums = full
            out.append(_mix(_mix(sums + np.uint64(level) * _A) + which * _B))
    return (np.concatenate(out), need) if out else (np.zeros(0, np.uint64), 1)


def _digest(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _lists(rows: DataFrame, *rank: str) -> DataFrame:
    """The rows (key, node, root) of lists with several roots, with ``lead``, the smallest of them by ``rank`` and itself, and ``size``; hot lists are summed before they are joined."""
    several = rows.groupBy("key").agg(F.min(F.struct(*rank, "root"))["root"].alias("lead"), F.min("root").alias("one"), F.max("root").alias("other"), F.count(F.lit(1)).alias("size"))
    several = several.where("one <> other").select("key", "lead", "size")
    return rows.join(several, "key")


def _enough(lists: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of nodes that are in as many lists as a link implies; any other node has no link left."""
    kept = lists.groupBy("node").count().join(groups.select("node", "need"), "node").where("count >= need").select("node")
    return lists.select("key", "node", "root").join(kept, "node", "left_semi")


def _first(lists: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of each node's lists but the last ``need`` - 1, small lists first.

    Nodes that link share as many lists as either needs. The first of these in the order of all lists has need - 1 shared
    ones after it on both sides, so both keep it. Nodes in fewer lists than a link implies keep none.
    """
    own = Window.partitionBy("node")
    told = lists.join(groups.select("node", "need"), "node").withColumn("n", F.count(F.lit(1)).over(own)).withColumn("k", F.row_number().over(own.orderBy("size", "key")))
    return told.where("k <= n - need + 1").select("key", "node", "root", "few")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) with den * intersection >= num * union."""

    def judged(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            ok = []
            for x, y in zip(part["x"], part["y"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = 0
                if den * min(len(x), len(y)) >= num * max(len(x), len(y)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(den * both >= num * (len(x) + len(y) - both))
            yield part.loc[ok, ["a", "b"]]

    left = sets.select(F.col("node").alias("a"), F.col("s").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("s").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInPandas(judged, "a long, b long")


def _apart(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """The members (lead, node) of those lists whose nodes are of several classes by ``roots``."""
    named = lists.select("key", "lead", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = named.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    return named.join(several, "key", "left_semi").select("lead", "node").distinct()


def _derived(lists: DataFrame, members: DataFrame, sets: DataFrame, links: DataFrame, num: int, den: int) -> DataFrame:
    """All links (a, b) once the members (lead, node) of lists with several classes are compared; ``links`` are those found so far.

    A node's difference to its lead tells its relation to any other node of that lead: the symmetric difference of two
    nodes is that of their differences. As linked sets differ in at most D elements, nodes with differences of a and b
    elements share c = (a + b - D) / 2 of them, so with the rarest elements first they share one of the first a - c + 1
    and b - c + 1, the earlier of these two places being at most D / 2. Only such pairs of different classes are tested:
    first each node with the one nearest to the lead among those that share an element, which joins most classes by as
    many tests as there are elements, then what is still apart.
    """
    left, right = sets.select(F.col("node").alias("lead"), F.col("s").alias("x")), sets.select("node", F.col("s").alias("y"))

    def differed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for i in range(0, len(part), 500):
                rows, some = [], part.iloc[i : i + 500]
                for x, y in zip(some["x"], some["y"]):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    d = np.setxor1d(x, y, assume_unique=True)
                    both = (len(x) + len(y) - len(d)) // 2
                    rows.append((den * both >= num * (both + len(d)), len(y), d.view(np.int64)))
                yield some.drop(columns=["x", "y"]).assign(**{c: [r[i] for r in rows] for i, c in enumerate(("ok", "size", "d"))})

    joined = members.join(left, "lead").join(right, "node").select("lead", "node", "x", "y")
    rows = cut(joined.mapInPandas(differed, "lead long, node long, ok boolean, size int, d array<long>"))
    links = links.unionByName(rows.where("ok").select(F.col("lead").alias("a"), F.col("node").alias("b")))
    # lists that the links to leads have made one class are done, so only differences of the others are opened
    roots = components(links)
    rows = cut(rows.join(_apart(lists, roots), ["lead", "node"], "left_semi"))
    each = rows.select("lead", "node", F.explode("d").alias("e")).withColumn("count", F.count(F.lit(1)).over(Window.partitionBy("lead", "e"))).where("count > 1")
    ranked = each.groupBy("lead", "node").agg(F.array_sort(F.collect_list(F.struct("count", "e"))).alias("common"))
    # elements of no other difference come first and are never shared, so they only shift the places of the others
    place = ranked.join(rows.select("lead", "node", "size", F.size("d").alias("n")), ["lead", "node"])
    place = place.select("lead", "node", "size", "n", (F.col("n") - F.size("common")).alias("own"), F.posexplode("common").alias("i", "z"))
    bound = F.floor(F.col("size") * (1 + den / num) * (den - num) / (den + num))
    place = cut(place.select("lead", F.col("z.e").alias("e"), "node", "size", "n", (F.col("own") + F.col("i")).alias("i")).where(F.col("i") <= bound))
    side = ("node", "root", "size", "n", "i")

    def rooted(roots: DataFrame) -> DataFrame:
        """Places of elements that nodes of several classes share."""
        named = place.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        hub = named.groupBy("lead", "e").agg(F.min_by(F.struct(*side), F.struct("n", "node")).alias("hub"), F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y")
        return named.join(hub.drop("x", "y"), ["lead", "e"])

    def apart(pairs: DataFrame) -> DataFrame:
        """The links among pairs with columns *_a and *_b that may link and are of different classes, each tested once."""
        most = F.floor((F.col("size_a") + F.col("size_b")) * (den - num) / (den + num))
        need = F.greatest(F.lit(1), F.ceil((F.col("n_a") + F.col("n_b") - most) / 2))
        fits = (F.col("root_a") != F.col("root_b")) & (F.col("n_a") - F.col("i_a") >= need) & (F.col("n_b") - F.col("i_b") >= need)
        new = pairs.where(fits).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()
        return cut(_verified(new, sets, num, den))

    star = apart(rooted(roots).select(*[F.col(f"hub.{c}").alias(f"{c}_a") for c in side], *[F.col(c).alias(f"{c}_b") for c in side]))
    links = links.unionByName(star)
    named = cut(rooted(components(links)).drop("hub"))
    if named.isEmpty():
        return links
    early = named.where(F.col("i") <= bound / 2).select("lead", "e", *[F.col(c).alias(f"{c}_a") for c in side])
    late = named.select("lead", "e", *[F.col(c).alias(f"{c}_b") for c in side])
    return links.unionByName(apart(early.join(late, ["lead", "e"])))


def join(docs: DataFrame, *, width: int = 5, num: int = 8, den: int = 10, doc_id: str = "doc_id", text: str = "text", short_list: int = 4, often: int = 8, broadcast_rows: int = 500_000) -> DataFrame:
    """Links texts whose word-shingle sets have Jaccard similarity num / den or more; exact up to 64-bit fingerprints
    of shingles and sets.

    One row per input row: the id, ``n_shingles`` and ``component_id``, the smallest id in its class of linked texts.
    A text without words, and null text, has no shingles and is linked with nothing; a text with fewer than ``width``
    words has its whole sequence as one. Repeated rows and ids are rows of their own; null ids count only where a class
    has no other. Other columns are ignored; an empty table gives an empty result.

    Equal sets are one node, whatever their number. Index lists are keyed by blocks of positions, so a probe skips all
    of a list but the sets that agree with it in a whole block, and a passage that many texts share makes no long list.
    Nodes in fewer lists than a link implies leave them. Each node is then compared with the two leads (smallest nodes
    of lists) with which it shares most blocks, and what these have linked is taken over. In lists that still hold
    several classes, of which a node keeps the smallest that no link can miss, pairs of different classes are tested, where the list has more than ``short_list`` nodes by way of
    the nodes' differences to the list's lead.
    Keys that ``often`` or more of one in 64 nodes hold are summed before they are joined, so no task sees a whole hot list.
    """
    if not 0 < num <= den:
        raise ValueError("the similarity must be over 0 and at most 1")
    kind = docs.schema[doc_id].dataType.simpleString()

    def named(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()  # equal sets that one task meets have keys once, so copies do not swell a list
        for part in parts:
            for i in range(0, len(part), 500):
                sizes, nodes, keys, needs = [], [], [], []
                for t in part["t"].iloc[i : i + 500]:
                    s = shingles(t, width)
                    node = _digest(s)
                    sizes.append(len(s))
                    nodes.append(node)
                    if len(s) and node not in seen:
                        if len(seen) > 500_000:
                            seen.clear()
                        seen.add(node)
                        k, need = block_keys(s, num, den)
                        keys.append(k.view(np.int64))
                        needs.append(need)
                    else:
                        keys.append(None)
                        needs.append(0)
                yield pd.DataFrame({"id": part["id"].iloc[i : i + 500].to_numpy(), "h": part["h"].iloc[i : i + 500].to_numpy(), "n": sizes, "node": nodes, "need": needs, "keys": keys})
        _words.clear()  # workers are used again by other steps

    source = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    keyed = cut(source.mapInPandas(named, f"id {kind}, h long, n long, node long, need int, keys array<long>"))
    keys = keyed.select("node", F.explode("keys").alias("key"))
    rows = cut(keyed.select("id", "n", "node"))
    first = F.min(F.struct(F.col("id").isNull(), "id", "h")).alias("first")
    groups = keyed.where("n > 0").groupBy("node").agg(first, F.max("need").alias("need"))
    groups = cut(groups.select("node", F.col("first.id").alias("low"), F.col("first.h").alias("h"), "need"))
    hot = cut(keys.where("node % 64 = 0").groupBy("key").count().where(F.col("count") >= often).select("key"))
    if hot.count() <= broadcast_rows:  # 8 bytes a row
        hot = F.broadcast(hot)
    by_key = Window.partitionBy("key")
    cold = keys.join(hot, "key", "left_anti").withColumn("lead", F.min("node").over(by_key)).withColumn("last", F.max("node").over(by_key)).where("lead <> last")
    hot = _lists(keys.join(hot, "key", "left_semi").withColumn("root", F.col("node")))
    shared = cut(cold.select("key", "node", F.col("node").alias("root")).unionByName(hot.select("key", "node", "root")))
    delete(keyed)
    lists = cut(_lists(_enough(shared, groups)))
    delete(shared)

    # the sets of nodes in shared blocks, found again from the texts, by id and digest: ids may be null or stand on many texts
    wanted = cut(lists.select("node").distinct().join(groups, "node"))
    if wanted.count() <= broadcast_rows:  # 24 bytes a row
        wanted = F.broadcast(wanted)

    def again(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = [(node, s.tobytes()) for node, t in zip(part["node"], part["t"]) for s in [shingles(t, width)] if _digest(s) == node]
            yield pd.DataFrame(out, columns=["node", "s"])
        _words.clear()

    found = source.join(wanted, source["id"].eqNullSafe(wanted["low"]) & (source["h"] == wanted["h"])).select("node", "t").mapInPandas(again, "node long, s binary")
    sets = cut(found)
    if sets.groupBy("node").count().where("count > 1").limit(1).count():  # rows with equal ids and texts
        sets = sets.dropDuplicates(["node"])

    pairs = lists.where("node <> lead").groupBy("lead", "node").count()
    best = Window.partitionBy("node").orderBy(F.desc("count"), "lead")
    pairs = pairs.withColumn("k", F.row_number().over(best)).where("k <= 2").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    links = cut(_verified(pairs, sets, num, den))
    roots = components(links)
    # roots of large classes lead, so that the lists of a node have few leads
    roots = roots.join(roots.groupBy("root").agg((-F.count(F.lit(1))).alias("few")), "root")
    rooted = lists.select("key", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).fillna(-1, ["few"])
    lists = cut(_lists(_first(_lists(rooted, "few"), groups), "few"))
    short = lists.where(F.col("size") <= short_list)
    pairs = short.select("key", F.col("node").alias("a"), F.col("root").alias("x")).join(short.select("key", F.col("node").alias("b"), F.col("root").alias("y")), "key").where("a < b and x <> y")
    more = cut(_verified(pairs.select("a", "b").distinct(), sets, num, den))
    links = links.unionByName(more)
    long = lists.where(F.col("size") > short_list)
    members = cut(long.where(F.col("node") != F.col("lead")).select("lead", "node").distinct())
    if not members.isEmpty():
        links = _derived(long, members, sets, links, num, den)
    roots = components(links)
    linked = groups.join(roots, "node").select("node", "low", "root")
    least = cut(linked.groupBy("root").agg(F.min("low").alias("component_id")))  # written, so that the join by a large class's root can be split
    classes = groups.join(linked.join(least, "root").select("node", "component_id"), "node", "left").select("node", F.coalesce("component_id", "low").alias("component_id"))
    out = rows.join(classes, "node", "left")
    alone = F.when(F.col("n") > 0, F.coalesce("component_id", "id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), alone.alias("component_id"))


def dedupe(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", broadcast_rows: int = 500_000, **options) -> DataFrame:
    """The rows of ``docs``, whole, with one row of each class of ``join``: that with the smallest id.

    Where ids repeat or are null, rows are numbered first and the first row of a class stays.
    """
    repeated = docs.groupBy(doc_id).count().where((F.col("count") > 1) | F.col(doc_id).isNull())
    if repeated.isEmpty():
        own, key = docs, doc_id
    else:
        key = next(k for i in range(len(docs.columns) + 1) if (k := f"row_{i}") not in {c.lower() for c in docs.columns})
        own = cut(docs.withColumn(key, F.monotonically_increasing_id()))
    gone = cut(join(own, doc_id=key, text=text, broadcast_rows=broadcast_rows, **options).where(F.col("component_id") != F.col(key)).select(key))
    if gone.count() <= broadcast_rows:  # 8 bytes a row
        gone = F.broadcast(gone)
    return own.join(gone, key, "left_anti").select(*docs.columns)
