"""Secret scans with DataFrame functions only: fixed patterns, and a battery of randomness tests for what they miss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, matches, running, tail

#: The patterns of the three kinds, as the contract states them; letters in either case in the first.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

#: Strings that the battery tests: whole, and their parts of LEAST_PART signs or more between separators. It judges LEAST letters and digits or more.
CANDIDATE, SEPARATOR = r"[A-Za-z0-9+/_-]{20,}={0,2}", "[/_-]"
LEAST_PART, LEAST = 20, 16

#: The sums of squares and cubes of the frequencies of letters in English.
SQUARES, CUBES = 0.0655, 0.0054
#: How structured text is assumed to be: the share of neighbours in different classes (with letters of both cases, where
#: names are run together as capitalised words, and else), and the serial correlation of codes.
CHANGES_BOTH, CHANGES, SERIAL = 0.2, 0.08, 0.2
#: The correlation that is assumed of any two of the three tests on structured text.
SHARED = 0.3


def later(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def sooner(a: Column, b: Column) -> Column:
    return F.least(a, b)


def _square(x: Column) -> Column:
    return x * x


def statistics(m: Column) -> Column:
    """Struct of what the battery tells of a string: n, classed, and z values of three tests under two hypotheses.

    Encoding: hexadecimal, base 32, one case of letters, both cases, base 62 or base 36, by the letters that occur.
    ``chi``, ``runs`` and ``serial`` take randomness as given: chi-squared uniformity over the encoding's alphabet, runs
    of character classes, and lag-one serial correlation of codes. ``flat``, ``mixed`` and ``free`` are the same three
    under structured text, and grow as the string is more uniform, changes class more often and is less correlated.
    """
    core = F.regexp_replace(m, "[=+/_-]", "")

    def told(core):
        n = F.length(core).cast("double")
        low, high, digit = core.rlike("[a-z]"), core.rlike("[A-Z]"), core.rlike("[0-9]")
        is_hex, is_32 = core.rlike("^[0-9a-f]+$") | core.rlike("^[0-9A-F]+$"), core.rlike("^[A-Z2-7]+$") & digit
        both, single = low & high, ~digit & ~(low & high)
        k = F.when(is_hex, 16.0).when(is_32, 32.0).when(single, 26.0).when(both & digit, 62.0).when(both, 52.0).otherwise(36.0)
        # chance that two neighbours differ in class: lower, upper, digit
        q = F.when(is_hex, 0.46875).when(is_32, 0.3046875).when(both & digit, 0.6222685).when(both, 0.5).otherwise(0.4012346)
        chars = F.split(core, "")
        squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a + _square((F.length(core) - F.length(F.replace(core, c, F.lit("")))).cast("double")))
        classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(core, "[0-9]+", "#"), "[a-z]+", "a"), "[A-Z]+", "A")
        changes = (F.length(classes) - 1).cast("double")
        codes = F.transform(chars, lambda c: F.instr(F.lit("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), c).cast("double"))
        mean = F.aggregate(codes, F.lit(0.0), lambda a, x: a + x) / n
        spread = F.aggregate(codes, F.lit(0.0), lambda a, x: a + x * x) / n - mean * mean
        lagged = F.aggregate(F.zip_with(F.slice(codes, F.lit(1), F.length(core) - 1), F.slice(codes, F.lit(2), F.length(core) - 1), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x) / (n - 1) - mean * mean
        r = F.coalesce(F.try_divide(lagged, spread), F.lit(1.0))
        pairs = n * (n - 1) / 2
        chi = (squares * k / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        flat = (pairs * SQUARES - (squares - n) / 2) / F.sqrt(pairs * (SQUARES - SQUARES**2) + n * (n - 1) * (n - 2) * (CUBES - SQUARES**2))
        away = lambda share: (changes - (n - 1) * share) / F.sqrt((n - 1) * share * (F.lit(1.0) - share))
        return F.struct(
            n.alias("n"), (low | high).alias("letters"), (~single).alias("classed"), chi.alias("chi"), F.when(single, 0.0).otherwise(away(q)).alias("runs"), (r * F.sqrt(n)).alias("serial"),
            flat.alias("flat"), away(F.when(both, CHANGES_BOTH).otherwise(CHANGES)).alias("mixed"), ((F.lit(SERIAL) - r) * F.sqrt(n)).alias("free"),
        )

    return F.when(F.length(core) >= LEAST, let(core, told))


def battery(m: Column) -> Column:
    """The p-value of a string under "structured text", from all three tests; 1 where they reject it as random.

    Randomness must stand: the Bonferroni p of the three tests is 0.003 or more. The evidence against structure is
    Stouffer's sum of the three z values under structured text, whose variance counts any two as correlated by SHARED; a
    string of one class of letters has only its uniformity. Strings under LEAST letters and digits, or without a letter, have 1.
    """

    def joined(s):
        stands = 3 * F.least(tail(s["chi"]), 2 * tail(F.abs(s["runs"])), 2 * tail(F.abs(s["serial"]))) >= 0.003
        z = F.when(s["classed"], (s["flat"] + s["mixed"] + s["free"]) / (3 + 6 * SHARED) ** 0.5).otherwise(s["flat"])
        return F.when(s["letters"] & stands, tail(z)).otherwise(1.0)

    return F.coalesce(let(statistics(m), joined), F.lit(1.0))


def _candidates(cand: Column) -> Column:
    """The strings to be tested: each match, followed by its parts between separators, as (start, until, no, m); ``until`` is the end, negative."""
    span = lambda start, m: F.struct(start.alias("start"), (-(start + F.length(m).cast("long"))).alias("until"), F.lit(1).alias("no"), m.alias("m"))

    def split(c):
        pieces = F.split(c["m"], SEPARATOR, -1)
        at = running(F.transform(pieces, lambda p: F.length(p).cast("long") + 1), F.lit(0).cast("long"), lambda a, n: a + n)
        parts = F.filter(F.zip_with(pieces, at, lambda p, b: span(c["start"] + b, p)), lambda x: F.length(x["m"]) >= LEAST_PART)
        return F.when(c["m"].rlike(SEPARATOR), F.concat(F.array(span(c["start"], c["m"])), parts)).otherwise(F.array(span(c["start"], c["m"])))

    return F.flatten(F.transform(cand, split))


def _apart(cand: Column, base: Column) -> Column:
    """The candidates that overlap no span of ``base``: in order of start, none that began before reaches into them and none begins inside."""
    fixed = F.transform(base, lambda b: F.struct(b["start"].alias("start"), (-b["end"]).alias("until"), F.lit(0).alias("no"), b["m"].alias("m")))

    def swept(every):
        ends = running(F.transform(every, lambda x: F.when(x["no"] == 0, -x["until"]).otherwise(F.lit(0))), F.lit(0).cast("long"), later)
        far = F.lit((1 << 62)).cast("long")
        starts = F.reverse(running(F.reverse(F.transform(every, lambda x: F.when(x["no"] == 0, x["start"]).otherwise(far))), far, sooner))
        marked = F.zip_with(every, F.arrays_zip(ends.alias("e"), starts.alias("s")), lambda x, y: F.struct(x.alias("x"), ((x["no"] == 1) & (y["e"] <= x["start"]) & (y["s"] >= -x["until"])).alias("ok")))
        return F.transform(F.filter(marked, lambda z: z["ok"]), lambda z: z["x"])

    return let(F.array_sort(F.concat(cand, fixed)), swept)


def _columns(df: DataFrame, text: str) -> DataFrame:
    """Adds ``__base``, the spans of the fixed patterns, and ``__free``, the other candidates with their weighted p-values."""
    df = df.withColumn("__t", F.coalesce(F.col(text), F.lit("")))
    df = matches(df, "__t", ASSIGN, "__assign")
    df = matches(df, "__t", ACCESS, "__access")
    df = matches(df, "__t", HEX[:-1] + "{%d,}" % LEAST_HEX, "__hex")  # a run of at least so many: the same as all runs, then filtered
    df = matches(df, "__t", CANDIDATE, "__cand")
    kind = lambda name, no, keep: F.transform(F.filter(F.col(f"__{name}"), keep), lambda x: F.struct(x["start"].alias("start"), F.lit(no).alias("kind_no"), x["end"].alias("end"), F.lit(name).alias("kind"), x["m"].alias("m")))
    base = F.concat(
        kind("assign", 0, lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= LEAST_ASSIGN),
        kind("access", 1, lambda x: F.length(x["m"]) >= LEAST_ACCESS),
        kind("hex", 2, lambda x: F.length(x["m"]) >= LEAST_HEX),
    )
    df = df.withColumn("__base", base)
    df = df.withColumn("__apart", F.when(F.size("__cand") > 0, _apart(_candidates(F.col("__cand")), F.col("__base"))).otherwise(F.array()))
    tested = F.transform("__apart", lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind_no"), (-c["until"]).alias("end"), F.lit("random").alias("kind"), c["m"].alias("m"), F.least(F.lit(1.0), battery(c["m"]) / _weight(c["m"])).alias("p")))
    return df.withColumn("__free", tested).drop("__t", "__assign", "__access", "__hex", "__cand", "__apart")


def _weight(m: Column) -> Column:
    """By length: longer strings get the larger share of the false discoveries."""
    return F.least(F.greatest(F.length(m) / 32.0, F.lit(0.5)), F.lit(2.0))


def _level(p: Column) -> Column:
    return F.floor(F.log10(F.greatest(p, F.lit(1e-300))) * 50).cast("long")


def _limit(tested: DataFrame, fdr: float) -> int | None:
    """The highest level of weighted p-values that passes the Benjamini-Hochberg procedure over all candidates, or None; weights are scaled to a mean of 1."""
    each = tested.select(F.explode("__free").alias("c"))
    counts = each.groupBy(_level(F.col("c.p")).alias("level")).agg(F.count(F.lit(1)).alias("count"), F.sum(_weight(F.col("c.m"))).alias("weight")).collect()  # at most 15,001 rows
    total, seen, limit = sum(r["count"] for r in counts), 0, None
    mean = sum(r["weight"] for r in counts) / max(1, total)
    for r in sorted(counts, key=lambda r: r["level"]):
        seen += r["count"]
        if mean * 10 ** ((r["level"] + 1) / 50) <= fdr * seen / total:
            limit = r["level"]
    return limit


def _found(limit: int | None) -> Column:
    passed = F.filter(F.col("__free"), lambda c: F.lit(False) if limit is None else _level(c["p"]) <= limit)
    # parts inside a string that passed whole go; each string comes before its parts
    reach = lambda p: running(F.transform(p, lambda c: c["end"]), F.lit(-1).cast("long"), later)
    outer = let(passed, lambda p: F.filter(F.zip_with(p, reach(p), lambda c, e: F.when(e < c["end"], c)), lambda c: c.isNotNull()))
    plain = F.transform(outer, lambda c: F.struct(c["start"].alias("start"), c["kind_no"].alias("kind_no"), c["end"].alias("end"), c["kind"].alias("kind"), c["m"].alias("m")))
    return F.array_sort(F.concat("__base", plain))


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", fdr: float = 0.01) -> DataFrame:
    """One row per input row: the id and ``found``, an array of (start, kind_no, end, kind, m) sorted by start and kind.

    Null text counts as empty; an empty table gives an empty result; repeated ids stay separate rows; other columns are
    ignored. The fixed patterns decide alone about their spans. A candidate string that overlaps none of them, or a part
    of one between separators, is added as kind ``random`` if the battery's p-value, weighted by length, passes the Benjamini-Hochberg threshold at ``fdr``
    over all candidates of the table. The threshold comes from a histogram of p-values in steps of 1/50 of a decade,
    so it needs no global sort.
    """
    kept = cut(_columns(docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")), "__text").select("__id", "__base", "__free"))
    return kept.select(F.col("__id").alias(doc_id), _found(_limit(kept, fdr)).alias("found"))


def _line(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(found: DataFrame, *, doc_id: str = "doc_id") -> DataFrame:
    """Counts and digests of ``scan``'s spans: a row for each of its rows, repeats and null ids too; no spans give zeros and the digest of nothing."""
    base = F.filter(F.col("found"), lambda x: x["kind_no"] < 3)
    number = lambda no: F.size(F.filter(F.col("found"), lambda x: x["kind_no"] == no)).cast("long")
    return found.select(
        doc_id,
        number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"), number(3).alias("n_random"),
        F.sha2(_line(base), 256).alias("base_sha256"), _line(F.col("found")).alias("spans"),
    )


def redact(docs: DataFrame, *, mark: str = "[SECRET]", text: str = "text", fdr: float = 0.01) -> DataFrame:
    """``docs`` with every span that ``scan`` finds replaced by ``mark``; overlapping spans count as one. All rows and columns stay.

    The texts are read twice, once for the threshold and once to be rewritten in place, so no text is shuffled.
    Null text stays null, empty text empty; repeated rows are rewritten each by itself; an empty table gives an empty result.
    The rows travel as one column beside the text, so other columns may have any names.
    """
    limit = _limit(cut(_columns(docs.select(F.col(text).alias("text")), "text").select("__free")), fdr)
    whole = F.col("text")
    df = _columns(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text")), "text").withColumn("__found", _found(limit))
    # what is kept before each span: from the furthest end so far to its start, nothing where it begins inside
    ends = running(F.transform("__found", lambda x: x["end"]), F.lit(0).cast("long"), later)
    df = df.withColumn("__cuts", F.zip_with("__found", ends, lambda x, e: F.struct(e.alias("low"), x["start"].alias("high"))))
    step = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size("__cuts")))).cast("int")
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size("__cuts") - 1) / step).cast("int")), lambda i: F.slice("__cuts", i * step + 1, step))
    part = lambda t, low, high: F.substr(t, (low + 1).cast("int"), (high - low).cast("int"))

    def shown(group):  # each group of spans cuts its own stretch of the text, so the whole text is searched once a group
        low, high = F.element_at(group, 1)["low"], F.array_max(F.transform(group, lambda x: x["high"]))
        piece = lambda t: F.array_join(F.transform(group, lambda x: F.when(x["high"] >= x["low"], F.concat(part(t, x["low"] - low, x["high"] - low), F.lit(mark))).otherwise("")), "")
        return let(part(whole, low, high), piece)

    rest = F.substr(whole, (F.array_max(F.transform("__found", lambda x: x["end"])) + 1).cast("int"))
    clean = F.concat(F.array_join(F.transform(groups, shown), ""), rest)
    new = F.when(F.size("__found") > 0, clean).otherwise(whole)
    return df.select(*[(new if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns])
