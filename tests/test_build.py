"""Graphs built from curated tables, clients with retry, suites: small fixtures with nulls, ties and repeated rows."""

import pytest
from pyspark.sql import functions as F

from lodegraph.operators import build as B
from lodegraph.operators import clients as C
from lodegraph.operators import evaluation as E
from lodegraph.operators import graph as G
from lodegraph.operators import retrieval as R

RULINGS = "row_id long, ingredient_th string, ingredient_en string, e_number string, source_th string, source_en string, source_type string, ruling string, basis_th string, note_th string, label string"
TIMELINE = "row_id long, reg_id string, name_th string, name_en string, kind string, valid_from string, valid_to string, issuer_th string, supersedes string, topic_th string, deleted_at timestamp"


def test_rulings_graph(spark):
    rows = [
        (1, "gel", None, None, "cow", "Cow", "animal", "halal", "b1", None, "x"), (2, "gel", "Gel", "E1", "pig", None, None, "HARAM", "b2", "n", "x"), (3, "gel", "Gel two", None, "pig", None, "animal", "haram", "b3", None, "x"),
        (4, "oil", None, None, "cow", None, None, "haram", None, None, "x"), (5, None, None, None, "cow", None, None, "halal", None, None, "x"), (6, "salt", None, None, None, None, None, "halal", None, None, "x"), (7, "tea", None, None, "leaf", None, None, "odd", None, None, "x"),
    ]
    nodes, edges = B.rulings_graph(spark.createDataFrame(rows, RULINGS))
    assert {r["node_id"]: r["text"] for r in nodes.collect()} == {
        "Ingredient:gel": "ingredient: gel (Gel) code E1", "Ingredient:oil": "ingredient: oil", "Source:cow": "source: cow (kind animal)", "Source:pig": "source: pig (kind animal)", "Ruling:halal": "ruling: halal", "Ruling:haram": "ruling: haram",
    }
    got = {(r["src_id"], r["rel"], r["dst_id"], r["via_source"]): r["note"] for r in edges.collect()}
    assert got[("Ingredient:gel", "HAS_RULING", "Ruling:haram", "pig")] == "b3" and ("Source:pig", "TYPICAL_RULING", "Ruling:haram", None) in got
    assert ("Source:cow", "TYPICAL_RULING", "Ruling:halal", None) not in got and len(got) == 3 + 3 + 1
    assert all(x.count() == 0 for x in B.rulings_graph(spark.createDataFrame([], RULINGS)))


def test_timeline_graph(spark):
    rows = [
        (1, "R-1", "one", None, "act", "2540", "2550", "body", None, "t", None), (2, "r1", "one again", None, "act", "2541", None, "body", "R 9", None, None), (3, "R2", "two", None, "act", "x", None, None, "r-1", None, None), (4, None, "body", "Body", "organisation", "2500", None, None, None, "top", None),
        (5, "R3", "self", None, "act", None, None, "new body", "R3", None, None), (6, None, None, None, "organisation", None, None, None, None, None, None),
    ]
    nodes, edges = B.timeline_graph(spark.createDataFrame(rows, TIMELINE))
    assert {r["node_id"]: r["text"] for r in nodes.collect()} == {"Regulation:R1": "one again | from 2541 to the present", "Regulation:R2": "two | to the present", "Regulation:R3": "self | to the present", "Organisation:body": "body | since 2500 | top", "Organisation:new body": "body: new body"}
    assert {(r["src_id"], r["rel"], r["dst_id"], r["valid_from"]) for r in edges.collect()} == {("Regulation:R1", "ISSUED_BY", "Organisation:body", 2541), ("Regulation:R3", "ISSUED_BY", "Organisation:new body", None), ("Regulation:R2", "SUPERSEDES", "Regulation:R1", None)}
    assert all(x.count() == 0 for x in B.timeline_graph(spark.createDataFrame([], TIMELINE)))


def test_equal_districts_of_two_provinces(spark):
    spec = G.SourceSpec("P", "id", ("id",), edges=(G.EdgeSpec("d", "IN_DISTRICT", "District", within="p", within_rel="IN_PROVINCE", within_label="Province"),))
    df = spark.createDataFrame([("1", "mid", "A"), ("2", "mid", "B"), ("3", "mid", None), ("4", None, "A"), ("5", "mid", "A")], "id string, d string, p string")
    e = G.build_edges(df, spec)
    assert {(r["src_id"], r["rel"], r["dst_id"]) for r in e.collect()} == {("P:1", "IN_DISTRICT", "District:mid|A"), ("P:2", "IN_DISTRICT", "District:mid|B"), ("P:5", "IN_DISTRICT", "District:mid|A"), ("District:mid|A", "IN_PROVINCE", "Province:A"), ("District:mid|B", "IN_PROVINCE", "Province:B")}
    assert {(r["node_id"], r["name"]) for r in G.attribute_nodes(e).collect()} == {("District:mid|A", "mid"), ("District:mid|B", "mid"), ("Province:A", "A"), ("Province:B", "B")}


def test_paths_against_brute_force(spark):
    import random
    from itertools import product

    r = random.Random(7)
    ids = [f"n{i:02}" for i in range(24)]
    pairs = {tuple(sorted(r.sample(ids, 2))) for _ in range(26)} | {("n00", x) for x in ids[1:9]} | {("n01", "n01")}
    near = {i: sorted({b for a, b in pairs if a == i} | {a for a, b in pairs if b == i} - {i}) for i in ids}

    def least(a, b, most):
        level = [(a,)]
        for _ in range(most + 1):
            done = sorted(p for p in level if p[-1] == b)
            if done:
                return list(done[0])
            level = [p + (x,) for p in level for x in near[p[-1]] if x not in p]
        return None

    edges = spark.createDataFrame([(a, "R", b) for a, b in pairs], "src_id string, rel string, dst_id string")
    wanted = spark.createDataFrame(list(product(ids[:8], ids)), "src_id string, dst_id string")
    for most in (1, 2, 3, 4):
        got = {(x["src_id"], x["dst_id"]): x["path"] for x in G.shortest_paths(edges, wanted, most).collect()}
        want = {(a, b): p for a, b in product(ids[:8], ids) if (p := least(a, b, most)) and len(p) <= most + 1}
        assert got == want


def test_clients():
    waits, calls = [], []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise RuntimeError("busy")
        return x.upper()

    assert C.with_retry(flaky, "a", sleep=waits.append) == "A" and waits == [1.0, 2.0]
    with pytest.raises(ZeroDivisionError):
        C.with_retry(lambda: 1 / 0, tries=2, sleep=waits.append)

    def embed(texts):
        if len(texts) > 2:
            raise C.TooLarge
        return [[float(len(t))] for t in texts]

    assert C.embed_in_batches(embed, ["aaa", "", None, "bb", " c "], batch=5) == [[3.0], [1.0], [1.0], [2.0], [1.0]]


@pytest.fixture(scope="module")
def tiny(spark):
    n = spark.createDataFrame([("P:1", "Place", "Blue Mosque Hall", "Place | Blue Mosque Hall"), ("P:2", "Place", "Red Harbour", "Place | Red Harbour"), ("D:a", "District", "Alpha", "District | Alpha"), ("D:b", "Province", "Beta land", "Province | Beta land")], "node_id string, label string, name string, text string")
    e = spark.createDataFrame([("P:1", "IN", "D:a", None, None), ("P:2", "IN", "D:a", 2540, 2550), ("D:a", "WITHIN", "D:b", None, None)], "src_id string, rel string, dst_id string, valid_from int, valid_to int")
    r = spark.createDataFrame([("gelatin", "pig", "haram", "rule 1", "E441"), ("gelatin", "cow", "halal", "rule 2", "E441")], "ingredient string, source string, ruling string, basis string, e_number string")
    t = spark.createDataFrame([("R:1", "Food act", 2540, None, "Board"), ("R:2", "Old act", 2500, 2530, None)], "node_id string, name string, valid_from int, valid_to int, issuer string")
    c = spark.createDataFrame([("Product:1", "Jelly cup deluxe", "H1", "gelatin", "gelatine")], "node_id string, product string, code string, ingredient string, term string")
    return R.Graph(n, e, r, {"timeline": t, "contains": c, "relations": {"IN": "lies in"}})


def test_blocks_of_contexts(spark, tiny):
    q = spark.createDataFrame([("1", "from blue mosque hall to red harbour", None), ("2", "red harbour in 2560", None), ("3", "is Jelly cup deluxe fine", None)], "question_id string, question string, as_of int")
    graph = {r["question_id"]: r for r in R.answer(q, tiny, "graph").collect()}
    lines = graph["1"]["context"].split("\n")
    assert "(2 hop) Red Harbour -[IN]-> Alpha -[IN]-> Blue Mosque Hall" in lines and "Alpha -[WITHIN]-> Province: Beta land" in lines and "Red Harbour -[lies in]-> District: Alpha" in lines
    assert graph["1"]["n_seeds"] == 2 and graph["1"]["n_triples"] == len(lines)
    dated = {r["question_id"]: r["context"] for r in R.answer(q, tiny, "temporal").collect()}
    assert "Red Harbour: lies in of Alpha ended in 2550, before 2560" in dated["2"] and "Food act in force from 2540 to the present, issued by Board" in dated["2"] and "Old act" not in dated["2"] and "lies in]->" not in dated["2"]
    said = {r["question_id"]: r for r in R.answer(q, tiny, "ingredient").collect()}
    assert said["3"]["context"].split("\n") == ["gelatin (code E441) depends on the source; at worst haram", "gelatin -> pig -> haram: rule 1", "gelatin -> cow -> halal: rule 2", "contained in Jelly cup deluxe (code H1): 'gelatine'"]


def test_suites_write_and_resume(spark, tiny, tmp_path):
    items = spark.createDataFrame([("1", "where is blue mosque hall", "Alpha", ["alpha"], ["Alpha"], "single", None, None, ["x"]), ("2", "zzzz", "b", None, None, None, None, None, None)], "id string, question string, answer string, aliases array<string>, gold_nodes array<string>, hop_type string, as_of int, stale_answer string, gold_path array<string>")
    judged = E.score(items, tiny, ["graph"], ground=C.ground_with(lambda prompt: "it lies in Alpha"), judge=lambda prompt: "grade 1")
    rows = {r["id"]: r for r in judged.collect()}
    assert tuple(judged.columns) == E.DETAIL and rows["1"]["faithfulness"] == 1.0 and rows["2"]["faithfulness"] is None and rows["1"]["hit_at_k"] == 1.0 and rows["1"]["path_validity"] == 0.0 and rows["1"]["llm_calls"] == 1
    suites, folder = {"core": E.Suite(items, ("graph",)), "rulings": E.Suite(items, ("ingredient",))}, str(tmp_path / "run")
    assert E.run_suites(suites, tiny, folder) and E.run_suites(suites, tiny, folder)
    assert E.read_detail(spark, folder).groupBy("suite").count().count() == 2 and E.read_detail(spark, folder).count() == 4
    assert spark.read.option("header", True).csv(f"{folder}/summary").filter("hop_type = 'ALL'").count() == 2 and spark.read.json(f"{folder}/meta").first()["rows"] == 4
    failing = E.score(items, tiny, ["graph"], ground=C.ground_with(lambda prompt: 1 / 0, tries=1))
    assert {r["id"]: r["llm_error"] for r in failing.collect()} == {"1": "no answer", "2": ""}
