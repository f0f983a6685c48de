"""Retrievers leave the driver small plans, link every question once and give the heap of planning back."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from lodegraph import session
from lodegraph.functions import metrics as M
from lodegraph.operators import evaluation as E
from lodegraph.operators import linking as L
from lodegraph.operators import retrieval as R


@pytest.fixture()
def small(spark):
    nodes = spark.createDataFrame([("Place:a", "Place", "Golden Temple", "a temple"), ("Place:b", "Place", "Riverside Gardens", "gardens"), ("Province:p", "Province", "Northland", "a province")], "node_id string, label string, name string, text string")
    edges = spark.createDataFrame([("Place:a", "IN", "Province:p", 2500, 2510), ("Place:b", "IN", "Province:p", None, None)], "src_id string, rel string, dst_id string, valid_from int, valid_to int")
    rulings = spark.createDataFrame([("salt", "sea", "halal", "b"), ("salt", "lab", "haram", "b")], "ingredient string, source string, ruling string, basis string")
    return R.Graph(nodes, edges, rulings.withColumn("basis", F.md5("basis")))


def _questions(spark):
    return spark.createDataFrame([("1", "golden temple and riverside gardens", None), ("2", "golden temple", 2520), ("3", "salt", None)], "question_id string, question string, as_of int")


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


@pytest.fixture()
def linkings(monkeypatch):
    calls = []
    monkeypatch.setattr(R, "seeds", lambda questions, *a, **k: calls.append(questions.count()) or L.seeds(questions, *a, **k))
    return calls


def test_scored_retrievers_link_once(spark, small, linkings):
    items = _questions(spark).select(F.col("question_id").alias("id"), "question", F.lit("x").alias("answer"), F.array().cast("array<string>").alias("aliases"), F.array().cast("array<string>").alias("gold_nodes"), F.lit("single").alias("hop_type"), "as_of", F.lit(None).cast("string").alias("stale_answer"))
    got = {(r["retriever"], r["id"]): r["n_seeds"] for r in E.score(items, small, ["graph", "temporal"]).collect()}
    assert got == {(k, i): n for k in ("graph", "temporal") for i, n in (("1", 2), ("2", 1), ("3", 0))} and linkings == [3]


def test_temporal_links_once(spark, small, linkings):
    got = {r["question_id"]: r["text"] for r in R.temporal_retriever(_questions(spark), small).collect()}
    assert linkings == [3] and set(got) == {"1", "2"}
    assert "ended in 2510, before 2520" in got["2"] and "(2 hop) Golden Temple -[IN]-> Northland -[IN]-> Riverside Gardens" in got["1"]


def test_graph_retriever_leaves_no_paths_to_its_last_plan(spark, small):
    assert "posexplode" not in _plan(R.graph_retriever(_questions(spark), small))


def test_ingredient_retriever_reads_rulings_once(spark, small):
    found = R.ingredient_retriever(_questions(spark), small)
    assert "md5" not in _plan(found)
    assert [r["text"].split("\n")[0] for r in found.collect()] == ["salt depends on the source; at worst haram"]


def test_terms_are_found_before_the_last_plan_of_linking(spark, small):
    assert "mapinarrow" not in _plan(L.contained_hits(_questions(spark), small.nodes))


@pytest.mark.parametrize("total,calls", [(375, 0), (376, 1)])
def test_a_grown_heap_is_given_back(total, calls):
    done = []
    runtime = SimpleNamespace(totalMemory=lambda: total, maxMemory=lambda: 750)
    lang = SimpleNamespace(Runtime=SimpleNamespace(getRuntime=lambda: runtime), System=SimpleNamespace(gc=lambda: done.append(1)))
    session.release(SimpleNamespace(sparkContext=SimpleNamespace(_jvm=SimpleNamespace(java=SimpleNamespace(lang=lang)))))
    assert len(done) == calls


def _physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_runs_and_spans_of_questions_are_not_broadcast(spark, small):
    # of known size, as a file is
    asked = L.cut(spark.sql("SELECT '1' AS question_id, 'golden temple and riverside gardens' AS question, 'golden temple and riverside gardens' AS q"))
    assert "BroadcastHashJoin [h" not in _physical(L.similar_hits(asked, small.nodes))
    assert "BroadcastHashJoin [span" not in _physical(L.contained_hits(asked, small.nodes))


def test_metrics_normalise_a_text_once(spark, monkeypatch):
    row = spark.createDataFrame([("a b", ["AB", None])], "p string, g array<string>")
    calls, normalise = [], M.normalise_answer
    monkeypatch.setattr(M, "normalise_answer", lambda c: calls.append(1) or normalise(c))
    for metric in (M.best_f1, M.exact_match, M.containment, M.context_recall):
        calls.clear()
        assert row.select(metric(F.col("p"), F.col("g")).alias("x")).first()["x"] == 1.0
        # the prediction or context, and an answer
        assert len(calls) == 2


def test_the_native_heap_is_given_back_after_each_cut(spark, monkeypatch):
    calls, trim = [], session.trim
    monkeypatch.setattr(session, "trim", lambda s: calls.append(trim(s)))
    session.cut(spark.range(3))
    assert len(calls) == 1
