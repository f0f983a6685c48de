"""One form for texts that look the same but differ in their characters."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodegraph.llm.invisible import INVISIBLE
from lodegraph.session import cut

# Letters of other scripts that show like the Latin letter under them.
_GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳ"
_GREEK_AS = "ABEZHIKMNOPTYXocj"
_CYRILLIC = "АВЕЅІЈКМНОРСТУХҮԌԚԜаеорсухѕіјһԁԛԝӏѵ"
_CYRILLIC_AS = "ABESIJKMHOPCTYXYGQWaeopcyxsijhdqwlv"
_OTHER = "օⅠⅤⅩⅬⅭⅮⅯⅰⅴⅹⅼⅽⅾⅿ‐‑﹣"
_OTHER_AS = "oIVXLCDMivxlcdm---"
LOOK_ALIKES = dict(zip(_GREEK + _CYRILLIC + _OTHER, _GREEK_AS + _CYRILLIC_AS + _OTHER_AS))

# Thai marks in one order: below the line, above it, tones and silencers, then the ring that sara am has.
THAI_MARKS = "ฺุูัิีึื็๎่้๊๋์ํ"

# Compatibility decompositions that do not change what shows.
_SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<isolated>", "<initial>", "<medial>", "<final>")
_LIGATURES = range(0xFB00, 0xFB07)

# Sequences that show like one character: overprinted pairs within a cluster, and doubled characters in a row.
_OVERPRINT = {"ิํ": "ึ"}
_IN_A_ROW = {"เเ": "แ", "\u0e4d\u0e32": "\u0e33"}


def _parts(cp: int) -> list[int]:
    """The code points that a code point stands for: nothing, a blank, its decomposition, or itself."""
    ch = chr(cp)
    cat = unicodedata.category(ch)
    if cat in ("Cf", "Cc") and ch not in "\t\n\r\x0b\x0c\x85\x1c\x1d\x1e\x1f" or cp in INVISIBLE:
        return []
    if cat in ("Zs", "Zl", "Zp", "Cc"):
        return [0x20]
    if ch in LOOK_ALIKES:
        return [ord(LOOK_ALIKES[ch])]
    d = unicodedata.decomposition(ch)
    if d and (d[0] != "<" or d.split()[0] in _SAME_LOOK or cp in _LIGATURES or ch in "ำຳ"):
        return [p for x in d.split() if x[0] != "<" for p in _parts(int(x, 16))]
    return [cp]


def _mark_class(cp: int) -> int:
    """0 for a base character; else the rank of a combining mark in its cluster."""
    ch = chr(cp)
    if ch in THAI_MARKS:
        return 300 + THAI_MARKS.index(ch)
    return unicodedata.combining(ch) or (255 if unicodedata.category(ch) == "Mn" else 0)


@lru_cache(maxsize=1)
def mapping_rows() -> list[tuple[str, list[str], list[int]]]:
    """(character, characters it stands for, their mark classes) of every character that is not simply a base character
    standing for itself. Derived from the Unicode tables of the running Python: about 6,000 rows, whatever the input."""
    rows = []
    for cp in [*range(0x0, 0xAC00), *range(0xF900, 0x1F000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE0200)]:
        if 0xD800 <= cp < 0xE000:
            continue
        p = _parts(cp)
        k = [_mark_class(x) for x in p]
        if p != [cp] or any(k):
            rows.append((chr(cp), [chr(x) for x in p], k))
    return rows


@lru_cache(maxsize=1)
def composition_rows() -> list[tuple[str, str]]:
    """(base and marks in order, the character that shows like them) of every canonical composition, and overprints."""
    rows = dict(_OVERPRINT)
    # Hangul syllables are taken apart by a rule of their own and stay so
    for cp in [*range(0xA0, 0xAC00), *range(0xF900, 0x2FA20)]:
        ch = chr(cp)
        full = unicodedata.normalize("NFD", ch)
        if full != ch and unicodedata.normalize("NFC", full) == ch and len(full) > 1:
            rows[full] = ch
    return sorted(rows.items())


def _is_own_form() -> str:
    """Matches every text that the mappings would not change: printable ASCII, composed Latin letters and Thai, where each
    mark stands alone, or a vowel before a tone, on a consonant, and no blank is at an end or doubled. It is one pass of
    possessive repetitions, so a text costs its length and no stack."""
    mark, tone, vowel = f"[{THAI_MARKS}]", "[\u0e48-\u0e4b]", "[\u0e38\u0e39\u0e31\u0e34-\u0e37]"
    syllable = f"[\u0e01-\u0e2e](?:{tone}?\u0e33|{vowel}?{tone}|[\u0e38\u0e39\u0e31\u0e34-\u0e37\u0e47\u0e4c])?+(?!{mark})"
    single = "[\\x21-\\x7e\u00c0-\u017f\u0e2f\u0e30\u0e32\u0e3b-\u0e3f\u0e41-\u0e46\u0e4f-\u0e5b]++"
    return f"^(?!\\x20)(?:{single}|{syllable}|\u0e40(?!\u0e40)|\\x20(?!\\x20|\\z))*+\\z"


# The jamo of Hangul syllables, in the order of the syllables' numbers.
_LEADING, _VOWELS, _TRAILING = ([chr(c) for c in r] for r in (range(0x1100, 0x1113), range(0x1161, 0x1176), range(0x11A8, 0x11C3)))


def _jamo(c: Column) -> Column:
    """The two or three jamo of a Hangul syllable, by arithmetic."""
    n = F.ascii(c) - 0xAC00
    of = lambda jamo, i: F.element_at(F.array(*map(F.lit, jamo)), i + 1)
    parts = F.array(of(_LEADING, F.floor(n / 588).cast("int")), of(_VOWELS, F.floor(n % 588 / 28).cast("int")), of(["", *_TRAILING], (n % 28).cast("int")))
    return F.transform(F.filter(parts, lambda x: x != ""), lambda x, i: F.struct(i.alias("sub"), x.alias("ch"), F.lit(0).alias("cls")))


def canonical_forms(texts: DataFrame, text: str = "text") -> DataFrame:
    """(text, form) for every distinct non-null text: texts that look the same have the same form.

    Width, encoding, composition, order and repetition of marks, invisible characters and look-alike letters leave no
    trace in the form; Hangul syllables are taken apart; kinds and runs of white space become one blank and outer white
    space is dropped; letter case, digit script and every other visible mark stay. A text of nothing visible has the empty
    form; null has no row.
    """
    return add_forms(texts.select(F.col(text).alias("text")).filter(F.col("text").isNotNull()).distinct())


def add_forms(distinct: DataFrame) -> DataFrame:
    """The rows, one per ``text``, with the text's ``form``.

    Texts that are their own form are told by a regular expression and pass by. The others are exploded to positioned
    code points, under a digest and not with the whole text, which meet the decompositions and look-alikes by a broadcast
    join (tables derived from Unicode, a few thousand rows at any input size). A running count of base characters numbers
    the clusters; each cluster's marks are put in order of their class and repeated ones dropped, the cluster is recomposed
    by a second broadcast join, and the string is rebuilt. The rows are spread once, by digest and by number of tasks;
    every step up to the rebuilt string keeps that partitioning.
    """
    spark = distinct.sparkSession
    rows = cut(distinct.withColumn("__odd", ~F.col("text").rlike(_is_own_form())))
    plain = rows.filter("NOT __odd").drop("__odd").withColumn("form", F.col("text"))
    odd = rows.filter("__odd").drop("__odd").withColumn("__id", F.md5("text"))
    maps = F.broadcast(_local(spark, mapping_rows(), "c string, parts array<string>, classes array<int>"))
    compositions = F.broadcast(_local(spark, composition_rows(), "cluster_text string, composed string"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # every text begins with an empty base character: marks without a base stand on it, and no text vanishes
    chars = odd.select("__id", "text").repartition(tasks, "__id").select("__id", F.posexplode(F.concat(F.array(F.lit("")), F.filter(F.split("text", ""), lambda x: x != ""))).alias("pos", "c"))
    itself = F.array(F.struct(F.lit(0).alias("sub"), F.col("c").alias("ch"), F.lit(0).alias("cls")))
    mapped = F.transform(F.arrays_zip("parts", "classes"), lambda x, i: F.struct(i.alias("sub"), x["parts"].alias("ch"), x["classes"].alias("cls")))
    one = F.when(F.col("parts").isNotNull(), mapped).when(F.col("c").between("\uac00", "\ud7a3"), _jamo(F.col("c"))).otherwise(itself)
    points = chars.join(maps, "c", "left").select("__id", "pos", F.explode(one).alias("p")).select("__id", "pos", "p.*")
    number = F.sum((F.col("cls") == 0).cast("int")).over(Window.partitionBy("__id").orderBy("pos", "sub").rowsBetween(Window.unboundedPreceding, 0))
    ordered = F.array_sort(F.collect_list(F.struct("cls", "pos", "sub", "ch")))
    clusters = points.withColumn("cluster", number).groupBy("__id", "cluster").agg(F.array_join(F.array_distinct(F.transform(ordered, lambda x: x["ch"])), "").alias("cluster_text"))
    whole = clusters.join(compositions, "cluster_text", "left").select("__id", "cluster", F.coalesce("composed", "cluster_text").alias("s"))
    built = whole.groupBy("__id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cluster", "s"))), lambda x: x["s"]), "").alias("s"))
    form = F.trim(F.regexp_replace("s", "\\x20+", " "))
    for pair, single in _IN_A_ROW.items():
        form = F.replace(form, F.lit(pair), F.lit(single))
    return plain.unionByName(odd.join(built.select("__id", form.alias("form")), "__id").drop("__id"))


def _local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


#: Bytes of the texts of the cases up to which they are broadcast to their rows; beyond that rows and texts are joined.
MOST_BROADCAST = 32 << 20
#: Rows of one text from which its rows are met by a broadcast of their own: at most one such text for so many rows.
HOT_ROWS = 1_000_000


def look_alike_rows(df: DataFrame, row_id: str, text: str, most_broadcast: int = MOST_BROADCAST, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id_a, id_b): per form the row with the smallest id, and every later row whose text differs from that row's.

    Rows without a text are in no pair. A text or a form that a third of all rows share is one pre-aggregated row. The
    forms are computed once and written; what is grouped by form are digests. Only texts that differ from their form's
    first meet the rows again: by broadcast while they are small, else by a join that leaves texts of very many rows to a
    broadcast.
    """
    rows = df.select(F.col(row_id).alias("row_id"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    per_text = rows.groupBy("text").agg(F.min("row_id").alias("first_row"), F.count("*").alias("n"))
    forms = cut(add_forms(per_text).select("text", "first_row", "n", F.md5("form").alias("look")))
    heads = forms.groupBy("look").agg(F.min("first_row").alias("id_a"), F.count("*").alias("texts")).filter("texts > 1").select("look", "id_a")
    others = cut(forms.join(heads, "look").filter("first_row <> id_a").select("text", "id_a", "n"))
    size = others.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.count("*").alias("texts"), F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()
    if size["bytes"] + 100 * size["texts"] <= most_broadcast:
        return rows.join(F.broadcast(others), "text").select("id_a", F.col("row_id").alias("id_b"))
    if size["n"] < hot_rows:
        return rows.join(others, "text").select("id_a", F.col("row_id").alias("id_b"))
    hot = others.filter(F.col("n") >= hot_rows)
    met = rows.join(F.broadcast(hot), "text")
    rest = rows.join(F.broadcast(hot.select("text")), "text", "left_anti").join(others.filter(F.col("n") < hot_rows), "text")
    return met.unionByName(rest).select("id_a", F.col("row_id").alias("id_b"))
