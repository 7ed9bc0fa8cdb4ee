"""Line dedup, hard negatives and periodic runs against brute force, with the hard rows of the contracts."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenelake.llm import lines, negatives, periodic, queries

from .test_llm import HARD, make

WHITE = " \t\n\x0b\x0c\r"


# 11


def plain_key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def plain_lines(rows, least):
    """For each row (lines, dropped, kept), by the definition."""
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(plain_key(x)) >= least:
                held[plain_key(x)].add(i)
    order = lambda i: (i is None, i if i is not None else 0)
    low = {k: min(v, key=order) for k, v in held.items() if len(v) > 1}
    out = []
    for i, t in rows:
        parts = (t or "").split("\n")
        kept = [x for x in parts if plain_key(x) not in low or low[plain_key(x)] == i]
        out.append((i, len(parts), len(parts) - len(kept), "\n".join(kept)))
    return out


def same_rows(got, want):
    text = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert text(got) == text(want)


@pytest.mark.parametrize("per_piece, bound", [(1 << 22, 1 << 28), (50, 1 << 12)])
def test_lines_as_defined(spark, per_piece, bound):
    rng = random.Random(3)
    stock = [f" Line number {i} of the stock\t" for i in range(60)] + ["short", "ÄÖÜ ten é", "exactly10!", "LINE NUMBER 7 of the stock", "\x1cline number 7 of the stock\x1f", "日本語の十文字の行です", "日本語の九文字の行"]
    rows = [(i, "\n".join(rng.choices(stock, k=rng.randint(1, 9)) + [f"a line of document {i} alone"] * rng.randint(0, 2))) for i in range(150)]
    rows += HARD + [(None, stock[0]), (None, stock[1] + "\n" + stock[1]), (5, stock[2]), (-9, "\r\n" + stock[3] + "\n\n"), (400, "x" * 200_000 + "\n" + stock[4]), (401, "x" * 200_000), (402, "only null shares this")]
    rows += [(None, "only null shares this"), (None, "nothing but nulls hold this"), (None, "nothing but nulls hold this")]
    got = lines.dedupe(make(spark, rows).repartition(5), least=10, per_piece=per_piece, bound=bound)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept"]
    same_rows(got.collect(), plain_lines(rows, 10))


def test_lines_of_a_hot_line_of_copies_and_of_nothing(spark):
    rows = [(i, "the line that all of them hold") for i in range(900)] + [(3, "the line that all of them hold")] * 300
    same_rows(lines.dedupe(make(spark, rows)).collect(), plain_lines(rows, 10))
    assert lines.dedupe(make(spark, [])).count() == 0


def test_a_full_filter_only_costs_work():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 4000).astype(np.uint64)
    words = np.zeros(1024, np.uint64)
    lines.put(words, h)
    for bits in (65536, 4096, 64):
        assert lines.holds(lines.folded(words, bits), h).all()
    assert not lines.holds(words, rng.integers(0, 2**63, 4000).astype(np.uint64)).mean() > 0.05


# 12


def plain_negatives(rows, is_anchor, positives=5, negatives_=3, low=50, high=95):
    sound = []
    for r, (i, e, label) in enumerate(rows):
        if e is None or label is None or any(x is None or not np.isfinite(x) for x in e):
            continue
        v = [int(np.floor(256 * float(np.float32(x)))) for x in e]
        if sum(x * x for x in v) < 2**62 and all(abs(x) < 2**31 for x in v):
            sound.append((r, i, v, label))
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for r, i, v, label in sound:
        if not is_anchor(i):
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, k == label) for s, j, w, k in sound if s != r and len(w) == len(v)]
        for ps, pid, _ in sorted((x for x in scored if x[2]), key=order)[:positives]:
            inside = sorted((x for x in scored if not x[2] and low * ps <= 100 * x[0] <= high * ps), key=order)[:negatives_]
            out += [(i, pid, k + 1, n[1], ps, n[0]) for k, n in enumerate(inside)]
    return out


@pytest.mark.parametrize("dim", [1, 7, 64, 96])
def test_negatives_as_defined(spark, dim):
    rng = np.random.default_rng(dim)
    centres = rng.standard_normal((4, dim))
    rows = [(int(i), [float(np.float32(x)) for x in centres[rng.integers(4)] * 0.4 + rng.standard_normal(dim) * 0.3], int(rng.integers(3))) for i in range(400)]
    rows += [(i, [float(np.float32(x)) for x in -np.abs(rng.standard_normal(dim))], 1) for i in range(400, 420)] + [rows[0]] * 3 + [rows[50]] * 4
    rows += [(None, rows[3][1], 1), (None, rows[3][1], 2), (450, None, 1), (500, [None] * dim, 1), (550, [float("nan")] * dim, 1), (600, [float("inf")] * dim, 1), (650, rows[1][1], None), (700, [0.0] * dim, 1), (701, [0.0] * dim, 2), (750, [1e30] * dim, 1)]
    rows += [(800, [], 1), (801, [], 1), (802, [], 2), (850, [0.5] * (dim + 1), 1), (851, [0.5] * (dim + 1), 1), (852, [0.4] * (dim + 1), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("row", F.lit("x")).withColumn("id", F.lit("y")).repartition(3)
    got = negatives.mine(df, F.col("vec_id") % 50 == 0, shard_bytes=1 << 12, block=(64, 5))
    same_rows(got.collect(), plain_negatives(rows, lambda i: i is not None and i % 50 == 0))


def test_negatives_of_ties_of_text_labels_and_of_nothing(spark):
    rows = [(i, [1.0, 0.0], "a") for i in range(8)] + [(100 + i, [0.9, 0.1 * i], "b") for i in range(6)] * 2
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = negatives.mine(df, F.col("vec_id") == 0)
    same_rows(got.collect(), plain_negatives(rows, lambda i: i == 0))
    assert negatives.mine(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert negatives.mine(df, F.lit(None).cast("boolean")).count() == 0


def test_bounds_hold_and_narrow_with_levels():
    rng = np.random.default_rng(5)
    x, q = rng.integers(-200, 200, (300, 64)), rng.integers(-200, 200, (40, 64))
    x[0] = 0
    exact, width = x @ q.T, []
    for levels in (1, 2, 4):
        turns = negatives.Rotations(64, levels)
        low, high = negatives.Questions(q.astype(float), turns).bounds(negatives.Codes.of(x.astype(float), turns), slice(None), slice(None))
        assert (low <= exact).all() and (exact <= high).all()
        width.append((high - low).mean())
    assert width[0] > 1.4 * width[1] > 2 * width[2]


# 13


def plain_runs(w, least=24, times=3):
    found = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            e = i + q
            if e - s >= max(least, times * q) and not any(all(w[k] == w[k + d] for k in range(s, e - d)) for d in range(1, q)):
                found.append((s, e - s, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def test_lyndon_words_and_runs_of_random_texts():
    rng = random.Random(1)
    for _ in range(600):
        kinds, n = rng.choice([1, 2, 2, 3, 4]), rng.randint(0, 40)
        w = [rng.randrange(kinds) for _ in range(n)]
        if n and rng.random() < 0.5:
            w = w[: rng.randint(0, 10)] + (w[: rng.randint(1, 6)] * 20)[: rng.randint(1, 40)] + w[10:]
        ranks = np.unique(w, return_inverse=True)[1].tolist()
        longest = []
        for i in range(len(ranks)):
            j = i + 1
            while j < len(ranks) and ranks[j:] > ranks[i:]:
                j += 1
            longest.append(j - i)
        assert periodic.lyndon(ranks) == longest
        for least in (1, 6):
            assert periodic.find(np.array(w, np.int64), least, 3) == plain_runs(w, least)


def test_a_deceiving_sum_is_found_out(monkeypatch):
    drawn = []

    class Weak(periodic.Extensions):
        def equal(self, i, j, length):
            good = super().equal(i, j, length)
            return good | (length < 9) if self.seed < 2 else good

        def __init__(self, words, seed):
            self.seed = seed
            drawn.append(seed)
            super().__init__(words, seed)

    monkeypatch.setattr(periodic, "Extensions", Weak)
    w = [5, 6, *[1, 2, 3] * 12, 7, 8]
    assert periodic.find(np.array(w), 24, 3) == plain_runs(w) and drawn == [0, 1, 2]


def test_runs_of_documents(spark):
    rng = random.Random(2)
    rows = HARD + [(None, None), (900, "x " * 50_000), (901, "a b c d " * 6 + "a b"), (902, "\x1fz " * 30), (903, "é É é É " * 8), (904, " ".join(["u"] * 23)), (905, " ".join(["u"] * 24)), (906, "p q r s t u v w " * 3), (907, ("p q r s t u v w " * 3)[2:])]
    for i in range(80):
        some = [rng.choice("abcdefghij") for _ in range(rng.randint(1, 12))]
        mixed = [rng.choice("abcdefghijk") for _ in range(rng.randint(0, 60))]
        rows.append((i + 10, " \n".join(mixed[:20] + (some * 40)[: rng.randint(1, 90)] + mixed[10:] + (some * 9)[:30])))
    got = periodic.runs(make(spark, rows).repartition(3), part=1 << 12)
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"]
    want = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        r = plain_runs(w) if len(w) < 2000 else [(0, len(w), 1)]
        want.append((i, len(w), r, collapsed(w, r) if len(w) < 2000 else w[0]))
    same_rows([(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect()], want)
    assert periodic.runs(make(spark, [])).count() == 0
    with pytest.raises(ValueError):
        periodic.runs(make(spark, []), times=2)


def test_the_periodic_query_on_its_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.op13_periodic(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    told = Counter()
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h = zlib.crc32(str(i).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        if n > 3000:  # too long for the plain way; the words are checked all the same when there is no run
            told["long"] += 1
            continue
        r = plain_runs(w)
        top = max(r, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None, None, None))
        told["runs"] += len(r)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want = (i, len(r), *top, 1000 * top[1] // top[2] if r else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in r)), sha(collapsed(w, r)))
        assert tuple(got[i]) == want
    assert told["runs"] > 5 and told["long"] < 20
