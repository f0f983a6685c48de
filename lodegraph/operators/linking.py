"""Questions linked to graph nodes: names found in the text, names that share a run of letters with what is left of it,
and a fallback by containment, merged to a few seeds per question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.functions.text import candidate_spans, dice, thai_len
from lodegraph.operators.rulings import find_terms, runs_of
from lodegraph.session import cut

# Punctuation that separates words of a question.
_PUNCTUATION = r"[\s.,!?;:()\[\]\"'`‘’“”]+"

# Words that never name anything on their own.
STOPWORDS = (
    "ฮาลาล", "ร้าน", "ร้านอาหาร", "ใกล้", "ใน", "ที่", "มี", "ไหน", "อะไร", "จังหวัด", "อยู่", "คือ", "ของ", "และ", "หรือ", "กับ", "ให้", "ได้", "เป็น", "ไม่", "จาก", "แห่ง", "บ้าง", "ใด", "กี่", "ชื่อ", "ประเภท", "แบบ", "ทั้งหมด", "เดียวกัน",
    "อะไรบ้าง", "ที่ไหน", "เท่าไหร่", "อย่างไร", "ทำไม", "ภาค", "อำเภอ", "เขต",
)
# Names too general to be meant.
GENERIC_NAMES = ("อื่นๆ", "อื่น ๆ", "other", "others", "ทั่วไป", "regional", "yes", "no", "only", "เมือง", "ทารก", "อาหาร", "นม", "ปลา", "ไข่", "แป้ง")
# Shared words that prove nothing.
WEAK_OVERLAPS = (
    "จังหวัด", "อำเภอ", "ตำบล", "ที่พัก", "ร้านอาหาร", "สถานที่", "ประเทศไทย", "แห่งประเทศไทย", "กลางจังหวัด", "ในจังหวัด", "มัสยิด", "โรงแรม", "ห้องพัก", "ร้านค้า", "ร้าน", "ตลาด", "วัด", "โรงเรียน", "น้ำตก", "สินค้า", "ผลิตภัณฑ์", "อาหาร",
)
# What must stand before the names of a label, and before names shorter than SHORT_NAME of any other.
REQUIRED_PREFIX = {"Region": ("ภาค",), "District": ("อำเภอ", "เขต", "อ.")}
SHORT_PREFIX = ("จังหวัด", "ภาค", "อำเภอ", "เขต", "ประเภท", "แบรนด์", "ยี่ห้อ")
SHORT_NAME = 4
# The least score of a similar name, the share of the best score that a seed must have.
LEAST_SCORE, FLOOR = 0.45, 0.75

#: The shortest run of letters by which names are similar. A shared run is measured on a ladder of lengths: every length up
#: to twelve, then steps of a fifth.
LEAST_RUN = 4


def ladder(longest: int) -> list[int]:
    """The lengths of runs up to a name's."""
    out = list(range(LEAST_RUN, 13))
    while out[-1] < longest:
        out.append(out[-1] * 6 // 5)
    return [n for n in out if n <= longest]


# runs within a word that proves nothing are left out of the measure
_WEAK_RUNS = sorted({w[i:j] for w in (*STOPWORDS, *WEAK_OVERLAPS) for i in range(len(w)) for j in range(i + LEAST_RUN, len(w) + 1)})


def clean_question(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), _PUNCTUATION, " "))


def without_shadowed(found: DataFrame) -> DataFrame:
    """Hits (question_id, node_id, name) without those whose name lies inside a longer name found in the same question.
    A question has few hits, so the self-join by question stays small."""
    a, b = found.alias("a"), found.select("question_id", F.col("name").alias("longer")).distinct().alias("b")
    inside = (F.col("a.question_id") == F.col("b.question_id")) & (F.lower("a.name") != F.lower("b.longer")) & F.contains(F.lower("b.longer"), F.lower("a.name"))
    return a.join(b, inside, "left_anti")


def _one_per_name(nodes: DataFrame, *by: str) -> DataFrame:
    """The node of the least id of every name: a question has one seed per name."""
    low = F.lower("name").alias("low")
    return nodes.filter("name IS NOT NULL").groupBy(*by, low).agg(F.min("node_id").alias("node_id"), F.min_by("name", "node_id").alias("name"), *([] if by else [F.min_by("label", "node_id").alias("label")]))


def required_terms(name: Column, label: Column) -> Column:
    """What must stand in a question for a name to be meant: the name; for labels whose names are ordinary words, and for
    short names, the name after one of their prefixes."""
    after = lambda prefixes: F.array(*(F.concat(F.lit(p), name) for p in prefixes))
    out = F.when(thai_len(name) < SHORT_NAME, after(SHORT_PREFIX)).otherwise(F.array(name))
    for k, prefixes in REQUIRED_PREFIX.items():
        out = F.when(label == k, after(prefixes)).otherwise(out)
    return out


def gazetteer_hits(questions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Names of nodes that stand in a question as they are, where required after a prefix; a score of 1."""
    names = _one_per_name(nodes, "label").filter((F.length("name") >= 2) & ~F.col("name").isin(*STOPWORDS) & ~F.trim("low").isin(*GENERIC_NAMES))
    terms = names.select("node_id", F.explode(required_terms(F.col("name"), F.col("label"))).alias("term"))
    hits = find_terms(questions, terms, "question_id", "question", "node_id", "term").select(F.col("text_id").alias("question_id"), F.col("term_id").alias("node_id")).distinct()
    named = hits.join(names, "node_id")
    return without_shadowed(named).select("question_id", "node_id", "label", "name", F.lit(1.0).alias("score"), F.lit("name").alias("matched_by"))


def _without_names(questions: DataFrame, exact: DataFrame) -> DataFrame:
    """Questions in lower case with the names found in them blanked out, longer ones first."""
    names = exact.select("question_id", F.lower("name").alias("low")).distinct().groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct(F.length("low").alias("n"), "low")), False).alias("names"))
    left = F.aggregate(F.coalesce("names", F.array().cast("array<struct<n:int,low:string>>")), F.lower("question"), lambda q, x: F.replace(q, x["low"], F.lit("\n")))
    return questions.join(names, "question_id", "left").select("question_id", left.alias("q"))


def _named(nodes: DataFrame) -> DataFrame:
    """The names that may be similar to a part of a question: none too general, too short or only valid after a prefix."""
    weak = {*STOPWORDS, *WEAK_OVERLAPS, *GENERIC_NAMES}
    return _one_per_name(nodes.filter(~F.col("label").isin(*REQUIRED_PREFIX))).filter(~F.trim("low").isin(*sorted(weak)) & (F.length("low") >= LEAST_RUN))


def _runs(df: DataFrame, c: str) -> DataFrame:
    """Every run of n letters as a hash with its length: what is shuffled and sorted is narrow."""
    cut_up = df.withColumn("run", F.explode(F.regexp_extract_all(F.col(c), F.format_string("(?s)(?=(.{%d}))", "n"), F.lit(1)))).drop(c)
    return cut_up.filter(~F.trim("run").isin(_WEAK_RUNS)).withColumn("h", F.xxhash64("run")).drop("run")


def _sizes(names: DataFrame) -> list[int]:
    return ladder(names.agg(F.max(F.length("low")).alias("n")).first()["n"] or 0)


def run_index(nodes: DataFrame, limit: int = 5, least_score: float = LEAST_SCORE) -> DataFrame:
    """The inverted index of names (h, n, node_id, m): of every run of n letters the ``limit`` shortest names, of m letters,
    that hold it. It can be stored as a table and handed to similar_hits for as long as the nodes stay."""
    names = _named(nodes)
    return _run_index(names, _sizes(names), limit, least_score)


def _run_index(names: DataFrame, sizes: list[int], limit: int, least_score: float) -> DataFrame:
    # a run of n letters in a name of m scores 2n / (n + m)
    sized = names.select("node_id", "low", F.length("low").alias("m"), F.explode(F.array(*map(F.lit, sizes)).cast("array<int>")).alias("n")).filter(F.col("n") <= F.col("m")).filter(F.round(dice(F.col("n"), F.col("m")), 4) >= least_score)
    short = Window.partitionBy("h", "n").orderBy("m", "node_id")
    return _runs(sized, "low").distinct().withColumn("i", F.row_number().over(short)).filter(F.col("i") <= limit).select("h", "n", "node_id", "m")


def similar_hits(questions: DataFrame, nodes: DataFrame, limit: int = 5, least_score: float = LEAST_SCORE, index: DataFrame | None = None) -> DataFrame:
    """The ``limit`` best names per question by the Dice measure of the longest run of letters that they share with it, none
    below ``least_score``. ``questions`` has question_id and q, in lower case.

    An inverted index of runs: of every run only the ``limit`` shortest names that hold it are kept, whatever their number.
    A longer name that shares the run scores less than all of those, so none of the best is lost, and a run that a third of
    all names have is a short list. Runs too short to lift a name over ``least_score`` are not in the index.
    """
    names = cut(_named(nodes))
    # the lengths of runs are those of the ladder up to the longest name
    sizes = _sizes(names) if index is None else sorted(r["n"] for r in index.select("n").distinct().collect())
    index = _run_index(names, sizes, limit, least_score) if index is None else index
    asked = questions.select("question_id", "q", F.explode(F.array(*map(F.lit, sizes)).cast("array<int>")).alias("n")).filter(F.length("q") >= F.col("n"))
    # runs are counted as if they were the questions that they come from: without the hint millions of them may be broadcast
    longest_run = _runs(asked, "q").hint("merge").join(index, ["h", "n"]).groupBy("question_id", "node_id").agg(F.max("n").alias("n"), F.first("m").alias("m"))
    scored = longest_run.withColumn("score", F.round(dice(F.col("n"), F.col("m")), 4))
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), "m", "node_id")
    best = scored.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= limit).join(names, "node_id")
    return best.select("question_id", "node_id", "label", "name", "score", F.lit("similar").alias("matched_by"))


def contained_hits(questions: DataFrame, nodes: DataFrame, limit: int = 5) -> DataFrame:
    """Names that hold a candidate span of a question, whatever the number of its spans; of every span the ``limit`` names
    that come first in the order of seeds.

    No seed is lost by that: a name that ``limit`` others precede within its best span is preceded by them among all names
    of the question, as each of those scores no less than within that span."""
    spans = cut(questions.select("question_id", F.explode(candidate_spans(F.col("question"), STOPWORDS)).alias("span")).select("question_id", F.lower("span").alias("span")).distinct())
    names = _one_per_name(nodes)
    held = find_terms(names, spans.select("span").distinct().select("span", F.col("span").alias("term")), "node_id", "low", "span", "term").select(F.col("text_id").alias("node_id"), F.col("term_id").alias("span"))
    scored = held.join(names, "node_id").withColumn("score", F.round(dice(F.length("span"), F.length("low")), 4))
    w = Window.partitionBy("span").orderBy(F.desc("score"), F.length("name"), "node_id")
    first = cut(scored.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= limit))
    # as with the runs, the estimate of the spans is that of the questions
    return spans.hint("merge").join(first, "span").groupBy("question_id", "node_id", "label", "name").agg(F.max("score").alias("score")).withColumn("matched_by", F.lit("contains"))


def seeds(questions: DataFrame, nodes: DataFrame, limit: int = 5, floor: float = FLOOR) -> DataFrame:
    """(question_id, node_id, label, name, score, matched_by, rank): per question at most ``limit`` nodes, one per name,
    none below ``floor`` of the best score. Exact names are sought in every question, similar ones in what exact names leave
    of it, names that only hold a part of it where neither is found. Null and blank questions have no seed."""
    nodes, questions = cut(nodes.select("node_id", "label", "name")), cut(questions.select("question_id", "question"))
    exact = cut(gazetteer_hits(questions, nodes))
    hits = cut(exact.unionByName(similar_hits(_without_names(questions, exact), nodes, limit)))
    rest = cut(questions.join(hits.select("question_id").distinct(), "question_id", "left_anti"))
    every = hits.unionByName(contained_hits(rest, nodes, limit))
    by_name = Window.partitionBy("question_id", F.lower("name")).orderBy(F.desc("score"), "node_id", "matched_by")
    one = every.withColumn("i", F.row_number().over(by_name)).filter("i = 1").drop("i")
    best = F.max("score").over(Window.partitionBy("question_id"))
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), F.length("name"), "node_id")
    return one.withColumn("best", best).filter(F.col("score") >= floor * F.col("best")).drop("best").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
