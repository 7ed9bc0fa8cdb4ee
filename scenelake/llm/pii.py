"""Format-preserving pseudonyms with DataFrame functions only: a keyed Feistel network permutes numbers and dates within their format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

EMAIL = r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"(?<![0-9])(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
#: A run of at least 13 digits, in groups with one space or hyphen between, up to a group that begins another kind: cards are searched inside it.
CARD = r"(?<![0-9])[0-9](?:(?:[ -](?!%s))?[0-9]){12,}+" % "|".join(f"(?:{p})" for p in (EMAIL, IP, DATE, SSN, PHONE))
#: Digits of a card, how cards are printed, and how the numbers of issuers begin, with their lengths.
CARD_DIGITS = (13, 19)
PRINTED = r"^(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?:\1[0-9]{3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}|[0-9]{4}([ -])[0-9]{3}\2[0-9]{3}\2[0-9]{3})$"
ISSUED = r"^(?:4[0-9]{12}(?:[0-9]{3}){0,2}|5[1-5][0-9]{14}|2(?:22[1-9]|2[3-9][0-9]|[3-6][0-9]{2}|7[01][0-9]|720)[0-9]{12}|3[47][0-9]{13}|3(?:0[0-5]|[689][0-9])[0-9]{11,16}|35[0-9]{14}|(?:50|5[6-9]|6[0-9])[0-9]{11,17})$"
#: In this order a string is taken for the first kind that it is a whole match of.
KINDS = {"email": EMAIL, "ip": IP, "date": DATE, "ssn": SSN, "phone": PHONE, "card": CARD}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
ROUNDS = 10
#: Days that dates are permuted among: 271 * 271 from this day on.
FIRST_DAY, SIDE = "1900-01-01", 271


def feistel(kind: str, key: str, a: Column, b: Column, size_a: Column, size_b: Column) -> Column:
    """A keyed permutation of pairs (a, b) with 0 <= a < size_a and 0 <= b < size_b, as a struct (a, b).

    Ten rounds add to one half, modulo its size, the first 60 bits of SHA-256 of the key, kind, sizes, round and other half.
    """
    size_a, size_b = size_a.cast("long"), size_b.cast("long")

    def mixed(i, x):
        return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), size_a.cast("string"), size_b.cast("string"), i.cast("string"), x.cast("string")), 256), 1, 15), 16, 10).cast("long")

    def step(s, i):
        even = i % 2 == 0
        one = F.when(even, F.pmod(s["a"] + F.pmod(mixed(i, s["b"]), size_a), size_a)).otherwise(s["a"])
        two = F.when(even, s["b"]).otherwise(F.pmod(s["b"] + F.pmod(mixed(i, s["a"]), size_b), size_b))
        return F.struct(one.alias("a"), two.alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def _pad(x: Column, width: Column) -> Column:
    return F.lpad(x.cast("string"), width.cast("int"), F.lit("0"))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def permute_digits(kind: str, key: str, d: Column) -> Column:
    """A string of 2 to 36 digits as another of the same length."""
    n = F.length(d)
    u = F.floor(n / 2).cast("int")
    p10 = lambda k: F.rpad(F.lit("1"), (k + 1).cast("int"), F.lit("0")).cast("long")
    halves = feistel(kind, key, F.substr(d, F.lit(1), u).cast("long"), F.substr(d, u + 1).cast("long"), p10(u), p10(n - u))
    return let(halves, lambda h: F.concat(_pad(h["a"], u), _pad(h["b"], n - u)))


def refill(m: Column, digits: Column) -> Column:
    """``m`` with its digits replaced, in order, by ``digits``."""
    one = lambda d: F.transform(F.split(m, ""), lambda ch, i: F.when(ch.rlike("[0-9]"), F.substr(d, F.length(_digits(F.substr(m, F.lit(1), i + 1))), F.lit(1))).otherwise(ch))
    return let(digits, lambda d: F.array_join(one(d), ""))


def luhn(d: Column) -> Column:
    """The Luhn sum of a string of digits."""
    n = F.length(d)

    def weight(i, c):
        x = c.cast("int") * F.when((n - i) % 2 == 0, 2).otherwise(1)
        return F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.transform(F.split(d, ""), lambda c, i: weight(i, c)), F.lit(0), lambda a, x: a + x)


def valid(kind: str, m: Column) -> Column:
    """Whether a match is a number or date of its kind: octets up to 255, a day of the calendar, a Luhn sum, an area that exists."""
    d = _digits(m)
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda x: x.cast("int") <= 255)
    if kind == "date":
        return F.coalesce(F.datediff(F.try_to_date(m, "yyyy-MM-dd"), F.lit(FIRST_DAY).cast("date")).between(0, SIDE * SIDE - 1), F.lit(False))
    if kind == "ssn":
        return ~d.rlike("^(000|666|9)") & ~d.rlike("^...00") & ~d.rlike("0000$")
    if kind == "card":
        return (luhn(d) % 10 == 0) & ~d.rlike("^0+$")
    return F.lit(True)


def _joined(groups: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(groups, (start + 1).cast("int"), size.cast("int")), "")


def _bare(s: Column) -> Column:
    return F.regexp_replace(s, "[ -]$", "")


def _places(m: Column, groups: Column) -> Column:
    """Where a run of digits holds cards: array of (start, size) in groups, in order and without overlap.

    The whole run comes first if it is a card. Else all stretches of whole groups are tested, and those that are valid are
    taken by rank, those printed as cards are and of a known issuer before others, then from the left, the longest first.
    """
    low, high = CARD_DIGITS
    n = F.size(groups)

    def candidate(s, start, size):
        def judged(d):
            printed, issued = _bare(s).rlike(PRINTED), d.rlike(ISSUED)
            rank = F.when(printed & issued, 0).when(printed, 1).when(issued, 2).otherwise(3)
            return F.when(F.length(d).between(low, high) & valid("card", d), F.struct(rank.alias("rank"), start.alias("start"), (-size).alias("less")))

        return let(_digits(s), judged)

    def from_(start):
        sizes = F.sequence(F.lit(1), F.least(F.lit(high), n - start))
        return F.filter(F.transform(sizes, lambda size: let(_joined(groups, start, size), lambda s: candidate(s, start, size))), lambda c: c.isNotNull())

    def search():
        found = F.array_sort(F.flatten(F.transform(F.sequence(F.lit(0), n - 1), from_)))
        apart = lambda acc, c: F.forall(acc, lambda x: (x["start"] + x["size"] <= c["start"]) | (c["start"] - c["less"] <= x["start"]))
        taken = lambda acc, c: F.when(apart(acc, c), F.concat(acc, F.array(F.struct(c["start"].alias("start"), (-c["less"]).alias("size"))))).otherwise(acc)
        return F.array_sort(F.aggregate(found, F.array().cast("array<struct<start:int,size:int>>"), taken))

    whole = let(_digits(m), lambda d: F.length(d).between(low, high) & valid("card", d))
    return F.when(whole, F.array(F.struct(F.lit(0).alias("start"), n.alias("size")))).otherwise(search())


def cards(key: str, m: Column) -> Column:
    """A run of digits as a struct (new, found): with every card in it replaced, and the array of (kind, old, new) of those."""

    def replaced(groups, places):
        def one(x, i):
            end = F.when(i > 0, F.get(places, i - 1)["start"] + F.get(places, i - 1)["size"]).otherwise(0)
            part = _joined(groups, x["start"], x["size"])
            return let(part, lambda s: F.struct(_joined(groups, end, x["start"] - end).alias("gap"), _bare(s).alias("old"), pseudonym("card", key, _bare(s)).alias("new"), F.regexp_extract(s, "[ -]$", 0).alias("mark")))

        last = F.coalesce(F.try_element_at(places, F.lit(-1))["start"] + F.try_element_at(places, F.lit(-1))["size"], F.lit(0))
        rest = _joined(groups, last, F.size(groups) - last)

        def put(pieces):
            text = F.concat(F.array_join(F.transform(pieces, lambda x: F.concat(x["gap"], x["new"], x["mark"])), ""), rest)
            return F.struct(text.alias("new"), F.transform(pieces, lambda x: F.struct(F.lit("card").alias("kind"), x["old"].alias("old"), x["new"].alias("new"))).alias("found"))

        return let(F.transform(places, one), put)

    return let(F.split(m, "(?<=[ -])", -1), lambda groups: let(_places(m, groups), lambda places: replaced(groups, places)))


def _letters(key: str, m: Column) -> Column:
    """Permutes the letters a mailbox has, 24 at a time, as numbers to base 26; case and place stay."""
    value = lambda s: F.aggregate(F.split(s, ""), F.lit(0).cast("long"), lambda a, c: F.when(c == "", a).otherwise(a * 26 + F.ascii(c) - 97))
    power = lambda k: F.aggregate(F.array_repeat(F.lit(26), k), F.lit(1).cast("long"), lambda a, x: a * x)

    def text(v, width):
        back = F.aggregate(F.array_repeat(F.lit(0), width), F.struct(v.alias("v"), F.lit("").alias("s")), lambda a, _: F.struct(F.floor(a["v"] / 26).cast("long").alias("v"), F.concat(F.char(97 + a["v"] % 26), a["s"]).alias("s")))
        return back["s"]

    def fresh(low):
        n = F.length(low)
        u = F.floor(n / 2).cast("int")
        halves = feistel("mail", key, value(F.substr(low, F.lit(1), u)), value(F.substr(low, u + 1)), power(u), power(n - u))
        return let(halves, lambda h: F.concat(text(h["a"], u), text(h["b"], n - u)))

    def placed(new):
        def place(ch, i):
            k = F.length(F.regexp_replace(F.substr(m, F.lit(1), i + 1), "[^A-Za-z]", ""))
            c = F.when(k <= F.length(new), F.substr(new, k, F.lit(1))).otherwise(F.lower(ch))
            return F.when(ch.rlike("[a-z]"), c).when(ch.rlike("[A-Z]"), F.upper(c)).otherwise(ch)

        return F.array_join(F.transform(F.split(m, ""), place), "")

    def every(low):
        parts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(low) / 24), F.lit(1)).cast("int") - 1), lambda i: F.substr(low, i * 24 + 1, F.lit(24)))
        return F.array_join(F.transform(parts, fresh), "")

    return let(let(F.lower(F.regexp_replace(m, "[^A-Za-z]", "")), every), placed)


def pseudonym(kind: str, key: str, m: Column) -> Column:
    """The keyed stand-in for a valid match of a kind: equal matches have equal ones, and the format is the same."""
    if kind == "ip":
        part = lambda x: F.concat_ws(".", F.floor(x / 256).cast("string"), (x % 256).cast("string"))
        at = lambda o, i: F.get(o, F.lit(i))
        halves = lambda o: feistel(kind, key, at(o, 0) * 256 + at(o, 1), at(o, 2) * 256 + at(o, 3), F.lit(65536), F.lit(65536))
        octets = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
        return let(let(octets, halves), lambda h: F.concat_ws(".", part(h["a"]), part(h["b"])))
    if kind == "date":
        day = F.datediff(F.try_to_date(m, "yyyy-MM-dd"), F.lit(FIRST_DAY).cast("date"))
        halves = feistel(kind, key, F.floor(day / SIDE), day % SIDE, F.lit(SIDE), F.lit(SIDE))
        return let(halves, lambda h: F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (h["a"] * SIDE + h["b"]).cast("int")), "yyyy-MM-dd"))
    if kind == "email":
        box = F.substring_index(m, "@", 1)

        def numbered(named):
            return let(_digits(box), lambda d: F.when(F.length(d).between(2, 36), refill(named, permute_digits(kind, key, d))).otherwise(named))

        return F.concat(let(_letters(key, box), numbered), F.lit("@"), F.substring_index(m, "@", -1))

    def by_digits(d):
        if kind == "ssn":
            # areas 001 to 665 with groups 01 to 99, against serials 0001 to 9999; areas 667 to 899 map among themselves
            area = F.substr(d, F.lit(1), F.lit(3)).cast("long")
            first = F.when(area < 666, 1).otherwise(667)
            count = F.when(area < 666, 665).otherwise(233)
            halves = feistel(kind, key, (area - first) * 99 + F.substr(d, F.lit(4), F.lit(2)).cast("long") - 1, F.substr(d, F.lit(6)).cast("long") - 1, count * 99, F.lit(9999))
            return let(halves, lambda h: F.concat_ws("-", _pad(first + F.floor(h["a"] / 99), F.lit(3)), _pad(h["a"] % 99 + 1, F.lit(2)), _pad(h["b"] + 1, F.lit(4))))
        if kind == "phone":
            # the last ten digits: area codes begin with 2 to 9
            last = F.substr(d, F.length(d) - 9)
            halves = feistel(kind, key, F.substr(last, F.lit(1), F.lit(5)).cast("long") - 20000, F.substr(last, F.lit(6)).cast("long"), F.lit(80000), F.lit(100000))
            return refill(m, let(halves, lambda h: F.concat(F.substr(d, F.lit(1), F.length(d) - 10), (h["a"] + 20000).cast("string"), _pad(h["b"], F.lit(5)))))
        if kind == "card":
            check = lambda body: F.pmod(F.lit(10) - luhn(F.concat(body, F.lit("0"))) % 10, F.lit(10))
            return refill(m, let(permute_digits(kind, key, F.substr(d, F.lit(1), F.length(d) - 1)), lambda body: F.concat(body, check(body).cast("string"))))
        raise ValueError(kind)

    return let(_digits(m), by_digits)


def pseudonymise(docs: DataFrame, *, key: str, text: str = "text", out: str = "text", found: str = "pii") -> DataFrame:
    """``docs`` with validated personal numbers, dates and mailboxes replaced in ``out``, and ``found``: array of (kind, old, new).

    All rows and other columns stay as they are, in any order; where ``docs`` has a column ``found`` already, underscores
    are added to the new one's name. Null text stays null with an empty array; repeated rows are rewritten each by itself;
    an empty table gives an empty result. Matches are leftmost and do not overlap; those that fail validation stay. Cards
    are searched in whole runs of digits, so one beside an expiry, a security code or a count is found; about one stretch
    in ten of 13 to 19 other digits passes as a card. Dates are yyyy-MM-dd from 1900 on, phones North American, mailboxes
    of at most 64 ASCII signs; a single digit in a mailbox stays. The key is a secret of the caller: with it equal values
    have equal pseudonyms in all documents and runs, and the permutation can be inverted.
    """
    while found.lower() in {c.lower() for c in docs.columns}:
        found += "_"
    t = F.col("t")
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("t"))
    df = df.withColumn("some", F.coalesce(t.rlike("[0-9@]") & t.rlike(ANY), F.lit(False)))  # the first search is cheap, and most texts end there
    df = df.withColumn("hits", F.when(F.col("some"), F.regexp_extract_all(t, F.lit(ANY), F.lit(0)))).withColumn("gaps", F.when(F.col("some"), F.split(t, ANY, -1)))

    def kind_of(m):
        found = F.lit("card")  # a hit that is no whole match of another kind
        for kind, pattern in reversed([x for x in KINDS.items() if x[0] != "card"]):
            found = F.when(m.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(found)
        return found

    df = df.withColumn("kinds", F.transform("hits", kind_of))

    def swap(m, kind):
        new = m
        for k in KINDS:
            if k != "card":
                new = F.when((kind == k), F.when(valid(k, m), pseudonym(k, key, m)).otherwise(m)).otherwise(new)
        one = let(new, lambda x: F.struct(x.alias("new"), F.array(F.struct(kind.alias("kind"), m.alias("old"), x.alias("new"))).alias("found")))
        return F.when(kind == "card", cards(key, m)).otherwise(one)

    df = df.withColumn("swaps", F.zip_with("hits", "kinds", swap))
    glued = F.array_join(F.zip_with("gaps", "swaps", lambda g, s: F.concat(g, F.coalesce(s["new"], F.lit("")))), "")
    new = F.when(F.col("some"), glued).otherwise(t)
    empty = F.array().cast("array<struct<kind:string,old:string,new:string>>")
    told = F.when(F.col("some"), F.filter(F.flatten(F.transform("swaps", lambda s: s["found"])), lambda s: s["old"] != s["new"])).otherwise(empty)
    names = docs.columns if out in docs.columns else [*docs.columns, out]
    return df.select(*[(new if c == out else F.col("row").getField(c)).alias(c) for c in names], told.alias(found))
