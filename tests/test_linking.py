"""Links of questions to names: guards, all names count, all passes run; against brute force."""

import random

from lodegraph.operators import linking as L
from lodegraph.operators.rulings import find_terms

Q = "question_id string, question string"
N = "node_id string, label string, name string"


def _lower(q):
    from pyspark.sql import functions as F

    return q.select("question_id", F.lower("question").alias("q"))


def test_runs_in_many_names_count(spark):
    nodes = spark.createDataFrame([(f"n{i:03}", "Place", f"central hotel {i:03}") for i in range(300)], N)
    q = spark.createDataFrame([("1", "which central hotel is it")], Q)
    got = [r["node_id"] for r in L.similar_hits(_lower(q), nodes).orderBy("node_id").collect()]
    assert got == [f"n{i:03}" for i in range(5)]
    # repeated names, and ten times as many of them, change nothing
    more = nodes.unionByName(spark.createDataFrame([(f"z{i:04}", "Place", f"central hotel {i:03}") for i in range(3000)], N))
    assert [r["node_id"] for r in L.similar_hits(_lower(q), more).orderBy("node_id").collect()] == got


def test_second_name_in_another_spelling(spark):
    nodes = spark.createDataFrame([("a", "Place", "Golden Temple"), ("b", "Place", "Riverside Gardens"), ("c", "Place", "Temple")], N)
    q = spark.createDataFrame([("1", "from golden temple to riverside garden")], Q)
    got = {r["node_id"]: r["matched_by"] for r in L.seeds(q, nodes).collect()}
    assert got == {"a": "name", "b": "similar"}


def test_part_of_a_name_is_the_last_resort(spark):
    nodes = spark.createDataFrame([("a", "Place", "Mooz International Restaurant"), ("b", "Place", "Harbour")], N)
    q = spark.createDataFrame([("1", "what of mooz"), ("2", "qqqq"), ("3", "harbour"), ("4", None), ("5", "")], Q)
    got = {(r["question_id"], r["node_id"]): r["matched_by"] for r in L.seeds(q, nodes).collect()}
    assert got == {("1", "a"): "contains", ("3", "b"): "name"}
    assert L.seeds(q.limit(0), nodes).count() == 0 and L.seeds(q, nodes.limit(0)).count() == 0


def test_every_span_is_looked_for(spark):
    """A part of a name that stands behind a dozen other words; of the names that hold it the first ones."""
    nodes = spark.createDataFrame([("a", "Place", "Mooz International Restaurant"), ("b", "Place", "Harbour")] + [(f"n{i:02}", "Place", f"{'z' * (30 - i)}kjjk{'y' * i}{'w' * (i + 12)}") for i in range(30)], N)
    q = spark.createDataFrame([("1", " ".join(f"q{i}q" for i in range(14)) + " mooz"), ("2", " ".join(f"q{i}q" for i in range(14)) + " kjjk")], Q)
    got = sorted((r["question_id"], r["node_id"], r["matched_by"]) for r in L.seeds(q, nodes).collect())
    assert got == [("1", "a", "contains"), *(("2", f"n{i:02}", "contains") for i in range(5))]


def test_guards(spark):
    """Names that are ordinary words, short, general or only part of one need more than their letters."""
    nodes = spark.createDataFrame([("r", "Region", "กลาง"), ("d", "District", "เมือง"), ("s", "Province", "เลย"), ("g", "Category", "อาหาร"), ("w", "Place", "มัสยิด"), ("p", "Place", "มัสยิดกลางปัตตานี"), ("t", "Province", "ปัตตานี")], N)
    asked = {"1": "มัสยิดอยู่กลางทุ่ง", "2": "ที่ภาคกลางมี", "3": "ไปอำเภอเมืองเลยไหม", "4": "จังหวัดเลยมีอาหาร", "5": "ปัตตานีมีมัสยิดไหม"}
    got = {}
    for r in L.gazetteer_hits(spark.createDataFrame(list(asked.items()), Q), nodes).collect():
        got.setdefault(r["question_id"], set()).add(r["node_id"])
    assert got == {"1": {"w"}, "2": {"r"}, "4": {"s"}, "5": {"t", "w"}}
    weak = L.similar_hits(_lower(spark.createDataFrame([("1", "มีมัสยิดไหม")], Q)), nodes)
    assert weak.count() == 0


def _brute_similar(q, names, limit=5):
    best = {}
    for k, _, n in names:
        low = n.lower()
        sizes = [s for s in L.ladder(len(low)) if any(low[a : a + s] in q and low[a : a + s].strip() not in L._WEAK_RUNS for a in range(len(low) - s + 1))]
        if sizes and len(low) >= L.LEAST_RUN:
            score = round(2 * max(sizes) / (max(sizes) + len(low)), 4)
            if score >= L.LEAST_SCORE and (low not in best or best[low][2] > k):
                best[low] = (-score, len(low), k)
    return {x[2] for x in sorted(best.values())[:limit]}


def test_similar_names_against_brute_force(spark):
    r = random.Random(3)
    word = lambda n: "".join(r.choice("abc ") for _ in range(n)).strip() or "a"
    names = [(f"n{i:03}", "X", word(r.randrange(3, 26))) for i in range(200)]
    asked = [(str(i), word(r.randrange(3, 40))) for i in range(30)]
    nodes, q = spark.createDataFrame(names, N), spark.createDataFrame(asked, Q)
    got = {}
    for x in L.similar_hits(_lower(q), nodes).collect():
        got.setdefault(x["question_id"], set()).add(x["node_id"])
    want = {i: s for i, t in asked if (s := _brute_similar(t, names))}
    assert got == want
    stored = {}
    for x in L.similar_hits(_lower(q), nodes, index=L.run_index(nodes)).collect():
        stored.setdefault(x["question_id"], set()).add(x["node_id"])
    assert stored == want


def test_spans_in_order(spark):
    from pyspark.sql import functions as F

    from lodegraph.functions.text import candidate_spans

    def brute(q):
        out = [t for t in q.split() if len(t) >= 3 and t not in L.STOPWORDS]
        spans = []
        for n in range(12, 2, -1):
            for i in range(len(q) - n + 1):
                x = q[i : i + n].strip()
                if x and x not in L.STOPWORDS and x not in spans:
                    spans.append(x)
        for x in sorted(spans, key=lambda x: -len(x)):
            if x not in out:
                out.append(x)
        return out

    texts = ["Mooz ที่ไหน", "abcd", "ร้าน Mooz อยู่จังหวัดใด", "a b", "", "aaaaaaaaaaaaaa"]
    got = [r["s"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", candidate_spans(F.col("t"), L.STOPWORDS).alias("s")).orderBy("i").collect()]
    assert [sorted(set(g)) for g in got] == [sorted(set(brute(t))) for t in texts]
    assert "Mooz" in got[0][:4] and [g[:12] for g in got][1] == brute("abcd")[:12]


def test_terms_against_brute_force(spark):
    r = random.Random(4)
    word = lambda n: "".join(r.choice("abกข ") for _ in range(n))
    texts = [(i, word(r.randrange(0, 60))) for i in range(60)] + [(90, None), (91, "ab" * 5000)]
    terms = [(j, word(r.randrange(0, 20))) for j in range(150)] + [(900, None), (901, "A" * 70), (902, "ab" * 40)]
    t, w = spark.createDataFrame(texts, "i int, t string"), spark.createDataFrame(terms, "j int, w string")
    want = {(i, j, x.lower()) for i, y in texts for j, x in terms if y and x and x.lower() in y.lower()}
    for most in (0, 1000):
        rows = [tuple(x) for x in find_terms(t, w, "i", "t", "j", "w", most).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want
        assert find_terms(t, w.limit(0), "i", "t", "j", "w", most).count() == 0
