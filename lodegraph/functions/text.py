"""Text expressions shared by the operators. Every function takes and returns a Column."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that stand for a missing value, in any case.
MISSING_WORDS = ("nan", "none", "null")

# White space of any kind: Unicode spaces, separators, control separators and the byte order mark.
_SPACE = r"[\s\p{Z}\x1c-\x1f\x85\ufeff]"

# Thai vowels and marks that take no width of their own.
_THAI_MARKS = "[\u0e31\u0e34-\u0e3a\u0e47-\u0e4e]"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utrim(c: str | Column) -> Column:
    """Strips white space of any kind on both sides; Spark's trim() strips blanks only."""
    return F.regexp_replace(col(c), f"^{_SPACE}+|{_SPACE}+$", "")


def clean(c: str | Column) -> Column:
    """The trimmed value, or NULL where it is null, blank or a word for a missing value."""
    t = utrim(c)
    return F.when((t != "") & ~F.lower(t).isin(*MISSING_WORDS), t)


def first_of(*cs: str | Column) -> Column:
    """The first of the columns that is not missing."""
    return F.coalesce(*(clean(c) for c in cs))


def code_key(c: str | Column) -> Column:
    """A code's ASCII letters (case ignored) and digits; NULL where the code is missing."""
    return F.upper(F.regexp_replace(clean(c), "[^A-Za-z0-9]", ""))


def thai_len(c: str | Column) -> Column:
    """Length without marks above and below the line."""
    return F.length(F.regexp_replace(col(c), _THAI_MARKS, ""))


def dice(span: Column, name: Column) -> Column:
    """2*span/(span+name) of two lengths; 0 where both are 0."""
    return F.when(span + name > 0, 2.0 * span / (span + name)).otherwise(F.lit(0.0))


def normalise_answer(c: str | Column) -> Column:
    """Lower case without white space and punctuation, as the answer metrics compare."""
    return F.regexp_replace(F.lower(F.trim(col(c))), r"[\p{P}\p{S}\s]", "")


def split_values(c: str | Column, delimiter: str, cap: int | None = None) -> Column:
    """Array of the distinct, trimmed, lower-cased non-empty values of a delimited field, at most ``cap`` of them."""
    parts = F.transform(F.split(F.coalesce(col(c), F.lit("")), delimiter), lambda x: F.lower(F.trim(x)))
    out = F.array_distinct(F.filter(parts, lambda x: x != ""))
    return F.slice(out, 1, cap) if cap else out


def ngrams(c: str | Column, least: int, most: int) -> Column:
    """Distinct character n-grams: longer ones first, then by position."""
    s = col(c)
    n = F.length(s)

    def of(size: int) -> Column:
        return F.when(n >= size, F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(reduce(lambda a, b: F.concat(a, b), [of(k) for k in range(most, least - 1, -1)]))


def candidate_spans(c: str | Column, stopwords: tuple[str, ...], least: int = 3, most: int = 12) -> Column:
    """What of a question may be a name, the most promising first: its words, then its runs of ``most`` down to ``least``
    letters; stop words and blanks at the ends are left out."""
    q = F.trim(col(c))
    words = F.filter(F.transform(F.split(q, r"\s+"), lambda w: F.trim(w)), lambda w: F.length(w) >= least)
    runs = F.filter(F.transform(ngrams(q, least, most), lambda x: F.trim(x)), lambda x: x != "")
    # trimmed runs are shorter than their place tells: longest first, stably
    by_length = F.array_sort(F.transform(F.array_distinct(runs), lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("x"))))
    return F.filter(F.array_distinct(F.concat(words, F.transform(by_length, lambda x: x["x"]))), lambda x: ~x.isin(*stopwords))


def longest_common_substring(a: str | Column, b: str | Column) -> Column:
    """Length of the longest common substring by bisection-free enumeration of the shorter side's substrings.
    Meant for names; the cost is quadratic in the length of ``a``."""
    x, y = col(a), col(b)
    n = F.length(x)
    subs = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
            lambda i: F.transform(F.sequence(F.lit(1), F.greatest(n - i + 1, F.lit(1))), lambda k: F.when(F.contains(y, F.substring(x, i, k)), F.length(F.substring(x, i, k))).otherwise(0)),
        )
    )
    return F.when((n > 0) & (F.length(y) > 0), F.array_max(subs)).when(x.isNotNull() & y.isNotNull(), 0)


def multiset_overlap(a: str | Column, b: str | Column) -> Column:
    """Number of characters that two strings share, counted with multiplicity."""
    x, y = F.split(col(a), ""), F.split(col(b), "")
    return F.aggregate(
        F.array_distinct(x),
        F.lit(0),
        lambda acc, ch: acc + F.least(F.size(F.filter(x, lambda v: v == ch)), F.size(F.filter(y, lambda v: v == ch))),
    )


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once a row, however often ``f`` names it: within a lambda every mention of an
    expression is computed anew, and the plan holds it as often."""
    return F.transform(F.array(value), f)[0]


def normalised_f1(p: Column, g: Column) -> Column:
    """F1 of the characters of two answers that are normalised already."""
    count = lambda c, ch: F.length(c) - F.length(F.replace(c, ch, F.lit("")))
    # a character that either lacks counts as nothing
    both = F.aggregate(F.array_intersect(F.split(p, ""), F.split(g, "")), F.lit(0), lambda acc, ch: acc + F.least(count(p, ch), count(g, ch))).cast("double")
    return F.when((F.length(p) == 0) | (F.length(g) == 0), F.lit(0.0)).otherwise(2.0 * both / (F.length(p) + F.length(g)))


def char_f1(pred: str | Column, gold: str | Column) -> Column:
    """F1 of the characters of two normalised answers."""
    return once(F.struct(normalise_answer(pred).alias("p"), normalise_answer(gold).alias("g")), lambda x: normalised_f1(x["p"], x["g"]))


def display_name(c: str | Column, names: dict[str, str]) -> Column:
    """The name that a label or relation is shown by; itself where there is none."""
    if not names:
        return col(c)
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.element_at(table, col(c)), col(c))


def name_phrase(c: str | Column, word: str) -> Column:
    """A name after the word for its kind: not repeated where the name begins with it; Thai is written without a blank
    between them, other scripts with one."""
    n = F.trim(col(c))
    thai = n.rlike("^[\u0e00-\u0e7f]")
    return F.when(F.startswith(F.lower(n), F.lit(word.lower())), n).when(thai, F.concat(F.lit(word), n)).otherwise(F.concat(F.lit(word + " "), n))


def grade_digit(c: str | Column) -> Column:
    """The first 0 or 1 of a grader's answer; NULL where it has none."""
    return F.regexp_extract(col(c), "[01]", 0).try_cast("double")


def bare_name(c: str | Column, prefixes: tuple[str, ...], suffixes: tuple[str, ...] = ()) -> Column:
    """A name in lower case without the prefixes, taken off once each in order, and the suffixes; NULL where missing."""
    # each step names its argument once, so the expression stays as long as the lists
    x = F.lower(clean(c))
    for p in prefixes:
        x = F.regexp_replace(x, rf"^\Q{p}\E\s*", "")
    for p in suffixes:
        x = F.regexp_replace(x, rf"\s*\Q{p}\E$", "")
    return x
