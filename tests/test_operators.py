import pytest
from pyspark.sql import functions as F

from lodegraph.functions import metrics as M
from lodegraph.functions import text as T
from lodegraph.functions import vector as V
from lodegraph.functions.dates import as_of_year, be_year
from lodegraph.operators import evaluation as E
from lodegraph.operators import graph as G
from lodegraph.operators import linking as L
from lodegraph.operators import retrieval as R
from lodegraph.operators import rulings as U


def one(spark, **cols):
    return spark.range(1).select(*[v.alias(k) for k, v in cols.items()]).first()


def test_text_functions(spark):
    r = one(
        spark, clean=T.clean(F.lit("\t nan ")), kept=T.clean(F.lit("\xa0x ")), n=T.thai_len(F.lit("ที่นี่")), lcs=T.longest_common_substring(F.lit("abcdef"), F.lit("zcdey")), none=T.longest_common_substring(F.lit(""), F.lit("x")),
        f1=T.char_f1(F.lit("ab"), F.lit("abc")), zero=T.char_f1(F.lit(""), F.lit("a")), key=T.code_key(F.lit(" hq-1/ก2 ")), d=T.dice(F.lit(3), F.lit(5)), parts=T.split_values(F.lit("A; b;a;;c;d;e"), ";", 4), grams=T.ngrams(F.lit("abcd"), 3, 4), short=T.ngrams(F.lit("a"), 3, 4),
    )
    assert (r["clean"], r["kept"], r["n"], r["lcs"], r["none"], r["f1"], r["zero"], r["key"], r["d"]) == (None, "x", 2, 3, 0, 0.8, 0.0, "HQ12", 0.75)
    assert (r["parts"], r["grams"], r["short"]) == (["a", "b", "c", "d"], ["abcd", "abc", "bcd"], [])


def test_metrics(spark):
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    r = one(
        spark, em=M.exact_match(F.lit("A-b."), arr("x", "ab")), c1=M.containment(F.lit("the answer is ab"), arr("ab")), c2=M.containment(F.lit("a"), arr("xay")), c3=M.containment(F.lit(""), arr("x")), best=M.best_f1(F.lit("ab"), arr("zz", "ab")), hit=M.hit_at_k(arr("a", "b"), arr("a", "c")),
        nohit=M.hit_at_k(arr("a"), F.array().cast("array<string>")), p1=M.path_validity(arr("a", "b", "c"), arr("a", "c")), p2=M.path_validity(arr("c", "b", "a"), arr("a", "b", "c")), p3=M.path_validity(arr("x", "a", "q", "c"), arr("a", "b", "c")), p4=M.path_validity(F.array().cast("array<string>"), arr("a")),
        era=M.wrong_era(F.lit("old"), arr("new"), F.lit("old"), F.lit(2560)), noera=M.wrong_era(F.lit("old"), arr("new"), F.lit(None).cast("string"), F.lit(2560)), dur=M.duration_seconds(F.lit("1m30s")), ms=M.duration_seconds(F.lit("150ms")), bad=M.duration_seconds(F.lit("soon")),
    )
    assert (r["em"], r["c1"], r["c2"], r["c3"], r["best"], r["hit"], r["nohit"]) == (1.0, 1.0, 1.0, 0.0, 1.0, 0.5, None)
    assert (r["p1"], r["p2"], round(r["p3"], 3), r["p4"]) == (1.0, pytest.approx(1 / 3), 0.667, 0.0)
    assert (r["era"], r["noera"], r["dur"], r["ms"], r["bad"]) == (1.0, None, 90.0, 0.15, None)


def test_dates(spark):
    r = one(spark, a=be_year(F.lit("02/02/2567")), b=be_year(F.lit("2/2/1999")), c=be_year(F.lit("x")), d=as_of_year(F.lit("ปี2570 และ 2571")), e=as_of_year(F.lit("125701")))
    assert tuple(r) == (2567, None, None, 2570, None)


NODES = [("P:1", "Place", "1", "Blue Mosque Hall", "Place | Blue Mosque Hall"), ("P:2", "Place", "2", "Blue Mosque", "Place | Blue Mosque"), ("D:a", "District", "a", "Alpha District", "District | Alpha"), ("P:3", "Place", "3", "Other Hotel", "Place | Other Hotel")]
EDGES = [("P:1", "IN", "D:a", 2550, 2560), ("P:2", "IN", "D:a", None, None), ("P:3", "IN", "D:a", 2561, None), ("P:1", "NEAR", "P:1", None, None)]


@pytest.fixture(scope="module")
def small(spark):
    n = spark.createDataFrame(NODES, "node_id string, label string, key string, name string, text string")
    e = spark.createDataFrame(EDGES, "src_id string, rel string, dst_id string, valid_from int, valid_to int")
    r = spark.createDataFrame([("gelatin powder", "pig", "haram"), ("gelatin powder", "cow", "halal"), ("plain water", "well", "halal")], "ingredient string, source string, ruling string")
    return R.Graph(n, e, r)


def test_neighbourhood_and_paths(spark, small):
    got = {(r["node_id"], r["rel"], r["outgoing"]): r["n"] for r in G.neighbourhood(small.nodes, small.edges).collect()}
    assert got == {("P:1", "IN", True): 1, ("P:2", "IN", True): 1, ("P:3", "IN", True): 1, ("D:a", "IN", False): 3, ("P:1", "NEAR", True): 1}
    at = {r["node_id"]: r["n"] for r in G.neighbourhood(small.nodes, small.edges, small.nodes.filter("label = 'District'"), as_of=F.lit(2560)).collect()}
    assert at == {"D:a": 2}
    pairs = spark.createDataFrame([("P:1", "P:2"), ("P:1", "P:1"), ("P:1", "nowhere")], "src_id string, dst_id string")
    found = G.shortest_paths(small.edges, pairs)
    assert sorted((r["src_id"], r["dst_id"], r["hops"], r["path"]) for r in found.collect()) == [("P:1", "P:1", 0, ["P:1"]), ("P:1", "P:2", 2, ["P:1", "D:a", "P:2"])]
    lines = {r["hops"]: (r["line"], r["labels"], r["rels"]) for r in G.path_details(found, small.nodes, small.edges).collect()}
    assert lines[2] == ("Blue Mosque Hall -[IN]-> Alpha District -[IN]-> Blue Mosque", ["Place", "District", "Place"], ["IN", "IN"])
    assert G.neighbourhood(small.nodes, small.edges.limit(0)).count() == 0


def test_upserts(spark):
    s = "node_id string, name string, props map<string,string>"
    old, new = spark.createDataFrame([("1", "a", {"x": "1", "y": "1"}), ("2", "b", None)], s), spark.createDataFrame([("1", None, {"y": "2"}), ("3", "c", {})], s)
    assert {r["node_id"]: (r["name"], r["props"]) for r in G.upsert_nodes(old, new).collect()} == {"1": ("a", {"x": "1", "y": "2"}), "2": ("b", None), "3": ("c", {})}
    e = "src_id string, rel string, dst_id string, p int"
    assert G.upsert_edges(spark.createDataFrame([("a", "r", "b", 1)], e), spark.createDataFrame([("a", "r", "b", 2), ("a", "r", "c", 3), ("a", "r", "c", 3)], e)).count() == 2


def test_spec_tolerates_missing_columns(spark):
    df = spark.createDataFrame([(" k1 ", "N", "a;B;a"), ("k1", "later", "z"), ("", "x", "y"), (None, "x", None)], "id string, nm string, kinds string")
    spec = G.SourceSpec("S", "id", ("title", "nm"), keep=("absent", "kinds"), text=("kinds",), edges=(G.EdgeSpec("kinds", "IS", "Kind", ";"), G.EdgeSpec("absent", "X", "Y")))
    n = G.build_nodes(df, spec).collect()
    # both rows have the key "k1": the tie goes to the row whose text comes first
    assert [(r["node_id"], r["text"]) for r in n] == [("S:k1", "S | N | a;B;a")]
    assert {tuple(r)[2] for r in G.build_edges(df, spec).collect()} == {"Kind:a", "Kind:b", "Kind:z"}
    assert G.build_nodes(df, G.SourceSpec("S", "none", ("nm",))).count() == 0


def test_linking_and_retrievers(spark, small):
    q = spark.createDataFrame([("1", "where is Blue Mosque Hall", None), ("2", "is gelatin powder fine", None), ("3", "Other Hotel in 2560", None), ("4", "zzzz", None), ("5", "visit blue mosqe hall today", 2555)], "question_id string, question string, as_of int")
    s = {(r["question_id"], r["node_id"]): r["matched_by"] for r in L.seeds(q, small.nodes).collect()}
    assert s[("1", "P:1")] == "name" and ("1", "P:2") not in s and ("3", "P:3") in s and not any(k[0] == "4" for k in s)
    assert s.get(("5", "P:1")) == "similar"
    for name in R.available_retrievers():
        a = {r["question_id"]: r for r in R.answer(q, small, name).collect()}
        assert len(a) == 5
        if name == "graph":
            assert "IN" in a["1"]["answer"] and a["4"]["answer"] == R.NO_CONTEXT
        if name == "ingredient":
            assert a["2"]["answer"].split("\n") == ["gelatin powder depends on the source; at worst haram", "gelatin powder -> pig -> haram", "gelatin powder -> cow -> halal"]
            assert a["2"]["chain"][:3] == ["gelatin powder", "pig", "haram"] and a["2"]["complete"] and not a["1"]["complete"]
        if name == "temporal":
            # P:1 lies in D:a from 2550 to 2560
            assert "-[IN]-> District: Alpha District" in a["5"]["context"] and "Blue Mosque Hall -[IN]->" in a["1"]["context"]
    assert R.get_retriever("dense") is R.get_retriever("vector")
    with pytest.raises(ValueError, match="unknown retriever"):
        R.get_retriever("nope")
    done = spark.createDataFrame([("1", "graph")], "question_id string, retriever string")
    assert R.remaining(q, ["graph", "vector"], done).count() == 9


def test_score_and_summary(spark, small):
    items = spark.createDataFrame([("1", "Blue Mosque Hall", "Alpha District", ["alpha"], ["P:1"], "single", None, None)], "id string, question string, answer string, aliases array<string>, gold_nodes array<string>, hop_type string, as_of int, stale_answer string")
    s = {(r["retriever"], r["hop_type"]): r for r in E.summarise(E.score(items, small, ["graph"])).collect()}
    assert s[("graph", "ALL")]["n"] == 1 and s[("graph", "single")]["context_recall"] == 1.0 and s[("graph", "single")]["hit_at_k"] == 1.0
    bad = items.unionByName(items.withColumn("hop_type", F.lit("odd")).withColumn("answer", F.lit(" ")))
    assert {r["problem"] for r in E.problems(bad).collect()} == {"no answer", "unknown kind", "repeated id"}


def test_rulings(spark, small):
    v = {r["ingredient"]: (r["verdict"], r["conflict"]) for r in U.verdicts(small.rulings, "ingredient", "ruling").collect()}
    assert v == {"gelatin powder": ("haram", True), "plain water": ("halal", False)}
    t = spark.createDataFrame([(1, "Red Apple pie"), (2, None), (3, ""), (4, "pineapple apple")], "i long, t string")
    w = spark.createDataFrame([(1, "apple"), (1, "red apple"), (2, "pie"), (3, ""), (4, None)], "k long, w string")
    found = U.find_terms(t, w, "i", "t", "k", "w")
    assert sorted(map(tuple, found.collect())) == [(1, 1, "apple"), (1, 1, "red apple"), (1, 2, "pie"), (4, 1, "apple")]
    assert {(r["text_id"], r["term"]) for r in U.longest_term(found).collect()} == {(1, "red apple"), (1, "pie"), (4, "apple")}
    assert U.find_terms(t, w.limit(0), "i", "t", "k", "w").count() == 0


def test_vectors(spark):
    e = spark.createDataFrame([(i, v) for i, v in enumerate([[1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [0.0, 0.0], None, [1.0, 1.0]])], "i long, v array<float>")
    got = [(r["query_id"], r["id"], round(r["score"], 3)) for r in V.top_k(e, e.filter("i IN (0, 3)"), "i", "v", 3).orderBy("rank").collect()]
    assert got == [(0, 0, 1.0), (0, 1, 1.0), (0, 5, 0.707)]
    assert V.top_k(e, e.limit(0), "i", "v", 3).count() == 0
    assert V.top_k(e, e.filter("i < 3"), "i", "v", 2, max_queries=1).count() == 6
    r = e.select(V.cosine(F.col("v"), F.col("v")).alias("c")).collect()
    assert [x["c"] for x in r[2:5]] == [1.0, None, None]


def test_plans(spark):
    """Filters and columns reach the scan, small sides are broadcast, top-k per group is cut before the shuffle."""
    import contextlib
    import io

    from lodegraph.plans import registry

    def plan(name):
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            registry.QUERIES[name](spark, "/root/testdata/sf0.001").explain("formatted")
        return out.getvalue()

    p = plan("semi_join_codes")
    assert "EqualTo(l_returnflag,R)" in p and "l_comment" not in p
    assert "BroadcastHashJoin" in plan("chain_join")
    assert "WindowGroupLimit" in plan("fact_cap")
    assert "CartesianProduct" not in plan("term_link") and "NestedLoop" not in plan("term_link")
