"""String functions of question and answer records, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units of placeholders.
UNITS = {"MASS": "kg", "DENSITY": "kg/m^3", "DISTANCE": "meters", "SPEED": "m/s", "VOLUME": "cm^3", "STRESS": "Pa", "TIME": "seconds"}


def placeholders(q: Column) -> Column:
    """The names in angle brackets, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(q, F.lit(r"<([^<>]*)>"), F.lit(1)))


def fill(q: Column, values: Column) -> Column:
    """Replaces each <NAME> by the value of a map; names that the map lacks stay."""
    return F.aggregate(F.map_entries(values), q, lambda acc, e: F.replace(acc, F.concat(F.lit("<"), e["key"], F.lit(">")), e["value"]))


def with_unit(name: Column, value: Column) -> Column:
    """A value with the unit of the placeholder's first part."""
    kind = F.element_at(F.split(name, "_"), 1)
    unit = F.coalesce(*[F.when(kind == k, F.lit(u)) for k, u in UNITS.items()], F.lit(""))
    return F.trim(F.concat_ws(" ", value.cast("string"), unit))


def blank_to_null(x: Column) -> Column:
    return F.nullif(F.lower(F.trim(x)), F.lit(""))


def title(x: Column, special: dict[str, str]) -> Column:
    """Title case with underscores as spaces; ``special`` has labels of their own."""
    plain = F.initcap(F.replace(x, F.lit("_"), F.lit(" ")))
    return F.coalesce(*[F.when(F.lower(x) == k, F.lit(v)) for k, v in special.items()], plain)


def normal_template(x: Column) -> Column:
    """Lower case, single spaces, numbered objects as one placeholder."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), r"<object_[0-9]+>", "<object>"), r"[ \t\r\n]+", " "))


def normal_question(x: Column) -> Column:
    """A question without image and option lines, its underscored names as placeholders."""
    lines = F.filter(F.split(x, "\n"), lambda s: ~F.startswith(F.trim(s), F.lit("<image>")) & ~s.rlike(r"^[A-Z]\. "))
    return F.trim(F.regexp_replace(F.array_join(lines, " "), r"\b[a-zA-Z]+_[A-Za-z0-9_]+\b", "<OBJECT>"))


def question_text(x: Column) -> Column:
    """The lines that are no options, joined by line feeds."""
    return F.array_join(F.filter(F.split(x, "\n"), lambda s: ~s.rlike(r"^[A-Za-z]\.")), "\n")


def options(x: Column) -> Column:
    """The option lines as (letter, text)."""
    found = F.filter(F.split(x, "\n"), lambda s: s.rlike(r"^[A-Za-z]\."))
    return F.transform(found, lambda s: F.struct(F.substring(s, 1, 1).alias("letter"), F.trim(F.substr(s, F.lit(3))).alias("text")))


def choice(x: Column) -> Column:
    """The evaluated choice: the first letter if it is A to D, else Wrong; null stays null and blank is Wrong."""
    first = F.upper(F.substring(F.trim(x), 1, 1))
    return F.when(x.isNull(), F.lit(None)).when(first.isin("A", "B", "C", "D"), first).otherwise("Wrong")


def letter(x: Column) -> Column:
    """The viewer's choice: the first letter anywhere, or the empty string.

    Characters are raised one by one: of those beyond ASCII only dotless i and long s become letters, and a sharp s is no S.
    """
    return F.coalesce(F.upper(F.regexp_extract(x, "[A-Za-z\u0131\u017f]", 0)), F.lit(""))


def base_id(x: Column) -> Column:
    """An id without its _g or _i ending."""
    return F.regexp_replace(x, "(?<=.)_[gi]$", "")


def parameters(x: Column) -> Column:
    """The first number of a text such as 7B."""
    return F.nullif(F.regexp_extract(x, r"[0-9]+(?:\.[0-9]+)?", 0), F.lit("")).try_cast("double")


def natural_key(x: Column) -> Column:
    """A key under which texts sort with their numbers as numbers."""
    parts = F.regexp_extract_all(F.lower(x), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, 20, "0")).otherwise(p)), "")


def image_marks(q: Column) -> Column:
    return F.floor((F.length(q) - F.length(F.replace(q, F.lit("<image>"), F.lit("")))) / 7).cast("long")


def assemble(q: Column, images: Column, labels: Column) -> Column:
    """Image marks, the question, and a line for each option."""
    lines = F.transform(labels, lambda x, i: F.concat(F.char(F.lit(65) + i), F.lit(". "), x))
    return F.concat(F.repeat(F.lit("<image>"), images), q, F.lit("\n"), F.array_join(lines, "\n"))


def group_label(*keys: Column) -> Column:
    """Keys joined by a bar, or <all>."""
    return F.concat_ws("|", *[F.coalesce(F.nullif(k.cast("string"), F.lit("")), F.lit("<MISSING>")) for k in keys]) if keys else F.lit("<all>")


def answer_letter(index: Column) -> Column:
    return F.when(index.between(0, 25), F.char(index + 65))


def order_letters(values: Column) -> Column:
    """The letters of the elements in ascending order of value, such as B-D-A-C."""
    keyed = F.transform(values, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.char(s["i"] + 65)), "-")


def bigrams(x: Column) -> Column:
    """The distinct pairs of neighbouring characters."""
    n = F.length(x)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substr(x, i, F.lit(2)))))


def jaccard(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def set_jaccard(a: Column, b: Column) -> Column:
    """The same of arrays without repeated elements."""
    both = F.size(F.array_intersect(a, b))
    return F.try_divide(both, F.size(a) + F.size(b) - both)


def word_count(x: Column) -> Column:
    """Tokens of letters, of digits, and single other marks."""
    return F.size(F.regexp_extract_all(x, F.lit(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]"), F.lit(0))).cast("long")


def stiffness(question: Column, sim: Column, names: Column) -> Column:
    """The stiffness part of a simulation's name, if the question names exactly one known object."""
    hits = F.size(F.filter(names, lambda n: F.contains(question, n)))
    return F.when(hits == 1, F.substr(F.get(F.split(sim, "_"), F.lit(1)), F.lit(5)))
