"""Fields that hold several values: one row per value, with its position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.functions.text import _SPACE, utrim

# The marks that part values.
DELIMITERS = r"|;,/、，；｜\t\n\r"

# Noncharacters stand for marks while a field is taken apart; they never occur in interchanged text.
_CUT, _COMMA, _SLASH = "\ufdd0", "\ufdd1", "\ufdd2"
_SP = _SPACE

# A quoted value starts where a value may start and ends where one may end: any other quote is a letter. All repetitions
# are possessive: they need no stack, however long a value is.
_DOUBLE = r'"((?:[^"\\]++|\\.|"")*+)"'
_CURLY = "“([^“”]*)”"
_SINGLE = r"'((?:[^'\\]++|\\.)*+)'"
_ANGLE = "«([^«»]*)»"
_CURLY1 = "‘([^‘]*?)’"
_QUOTED = f"(?s)(^|[{DELIMITERS}])({_SP}*)(?:{_DOUBLE}|{_CURLY}|{_SINGLE}|{_ANGLE}|{_CURLY1})(?={_SP}*(?:$|[{DELIMITERS}]))"

# What an unquoted stretch consists of: bracketed groups (four levels in one token), brackets that are part of no such
# group, delimiters, runs of letters.
_GROUP = r"\([^()]*+\)"
for _ in range(3):
    _GROUP = rf"\((?:[^()]++|{_GROUP})*+\)"
_OUTSIDE = rf"(?s){_GROUP}|[(){DELIMITERS}]|[^(){DELIMITERS}]++"
_IS_DELIMITER = f"^[{DELIMITERS}]$"


def _unescape(literal: Column) -> Column:
    """Resolves doubled quotes and backslash escapes (backslash-u included) of a quoted value."""
    plain = F.regexp_replace(literal, '(?<!\\\\)""', '"')
    quoted = F.regexp_replace(F.regexp_replace(plain, r"\\'", "'"), r'(?<!\\)"', r'\\\\"')
    as_json = F.from_json(F.concat(F.lit('["'), quoted, F.lit('"]')), "array<string>", {"allowUnquotedControlChars": "true", "allowBackslashEscapingAnyCharacter": "true"})
    return F.when(F.contains(literal, F.lit("\\")), F.coalesce(F.element_at(as_json, 1), plain)).otherwise(plain)


def _kinds(tokens: Column) -> Column:
    """Kinds of the tokens of an unquoted stretch with deeper nesting: 'd' a delimiter, 'o' a bracket that opens, 'c' one that closes, 't' all
    else. An opening bracket that nothing closes is a letter; this is told from the end, where the closing ones are."""
    start = F.struct(F.lit(0).alias("closing"), F.array().cast("array<string>").alias("kinds"))

    def step(acc: Column, s: Column) -> Column:
        opens = (s == "(") & (acc["closing"] > 0)
        kind = F.when(s == ")", "c").when(opens, "o").when(s.rlike(_IS_DELIMITER), "d").otherwise("t")
        left = acc["closing"] + F.when(s == ")", 1).when(opens, -1).otherwise(0)
        return F.struct(left.alias("closing"), F.concat(acc["kinds"], F.array(kind)).alias("kinds"))

    return F.reverse(F.aggregate(F.reverse(tokens), start, step, lambda acc: acc["kinds"]))


def _tokens(piece: Column, i: Column) -> Column:
    """Tokens of a piece: a literal is one token of kind 'v'; the kinds outside are those of _kinds."""
    inside = F.array(F.struct(F.lit("v").alias("k"), _unescape(piece).alias("s")))
    held = F.regexp_replace(F.regexp_replace(piece, r"(?<=\p{Nd}),(?=\p{Nd})", _COMMA), r"(?<=\p{Nd})/(?=\p{Nd})", _SLASH)
    tokens = F.regexp_extract_all(held, F.lit(_OUTSIDE), F.lit(0))
    simple = F.transform(tokens, lambda s: F.when(s.rlike(_IS_DELIMITER), "d").otherwise("t"))
    deep = F.array_contains(tokens, "(") & F.array_contains(tokens, ")")
    kinds = F.when(deep, _kinds(tokens)).otherwise(simple)
    outside = F.zip_with(tokens, kinds, lambda s, k: F.struct(k.alias("k"), F.translate(s, _COMMA + _SLASH, ",/").alias("s")))
    return F.when(i % 2 == 1, inside).otherwise(outside)


def packed_values(field: str | Column) -> Column:
    """Array of the values packed in a field, in order.

    A list's square brackets are dropped, then the field is split at the quotes that enclose values: odd pieces are
    literal values, even pieces are split at delimiters, and a fold puts the values together again. Values are trimmed
    of white space of any kind; empty ones are left out; repeated ones stay. Inside enclosing quotes and round
    brackets, nested to any depth, and directly between two digits (comma, slash), a delimiter belongs to the value. NULL and blank fields
    give an empty array.
    """
    c = F.col(field) if isinstance(field, str) else field
    t = utrim(F.coalesce(c, F.lit("")))
    t = F.when(t.rlike(r"(?s)^\[.*\]$"), F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)
    marked = F.regexp_replace(t, _QUOTED, f"$1$2{_CUT}$3$4$5$6$7{_CUT}")
    pieces = F.split(marked, _CUT)
    tokens = F.flatten(F.transform(pieces, _tokens))
    # fold: a delimiter outside brackets closes the open value, anything else is added to it
    step = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("depth"))
    deeper = lambda acc, x: F.greatest(F.lit(0), acc["depth"] + F.when(x["k"] == "o", 1).when(x["k"] == "c", -1).otherwise(0))
    values = F.aggregate(
        tokens,
        step,
        lambda acc, x: F.when(
            (x["k"] == "d") & (acc["depth"] == 0),
            F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), F.lit("").alias("open"), F.lit(0).alias("depth")),
        ).otherwise(F.struct(acc["done"].alias("done"), F.concat(acc["open"], x["s"]).alias("open"), deeper(acc, x).alias("depth"))),
        lambda acc: F.concat(acc["done"], F.array(acc["open"])),
    )
    return F.filter(F.transform(values, utrim), lambda v: v != "")


def explode_packed(df: DataFrame, field: str, keep: list[str | Column], pos: str = "pos", val: str = "val") -> DataFrame:
    """One row per value of ``field``: the kept columns, the position from 1 and the value. Rows whose field is null,
    blank or holds only empty pieces give none. A narrow plan: no shuffle, whatever the input's size."""
    p = F.posexplode(packed_values(field)).alias("__p", "__v")
    out = df.select(*keep, p)
    return out.select(*[c for c in out.columns if c not in ("__p", "__v")], (F.col("__p") + 1).cast("long").alias(pos), F.col("__v").alias(val))
