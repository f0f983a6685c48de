"""Evaluation: items made from the graph itself, retrievers scored on them, scores summarised."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.functions import metrics as M
from lodegraph.functions.text import clean
from lodegraph.operators.clients import faithfulness
from lodegraph.operators.graph import first_per_key
from lodegraph.operators.retrieval import Graph, answer, get_retriever, graph_retriever, held, linked, remaining, temporal_retriever
from lodegraph.session import cut
from lodegraph.sources.readers import read_checkpoint
from lodegraph.sources.writers import append_progress, write_json_lines, write_or_quarantine, write_table

# Kinds of questions.
KINDS = ("single", "multi", "relational")
METRICS = ("f1", "em", "containment", "faithfulness", "context_recall", "hit_at_k", "path_validity", "has_complete_path", "wrong_era", "latency_s", "retrieve_s", "total_tokens", "context_chars")
# The columns of a scored item, in order.
DETAIL = (
    "suite", "id", "question", "hop_type", "retriever", "answer", "gold", "f1", "em", "containment", "faithfulness", "context_recall", "hit_at_k", "path_validity", "has_complete_path", "wrong_era", "as_of", "latency_s", "retrieve_s", "total_tokens",
    "llm_calls", "context_chars", "n_seeds", "n_triples", "llm_error",
)


def shuffled(df: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """The first ``n`` rows in an order that only the seed decides: a sampling operator."""
    return df.withColumn("__h", F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)))).orderBy("__h", key).limit(n).drop("__h")


def unique_named(nodes: DataFrame, least: int = 4, across_labels: bool = True) -> DataFrame:
    """Nodes whose name no other node has, of ``least`` letters or more; among all nodes or within a label."""
    by = ["name"] if across_labels else ["label", "name"]
    named = nodes.filter(clean("name").isNotNull() & (F.length("name") >= least))
    one = named.groupBy(*by).agg(F.count("*").alias("__n"), F.min("node_id").alias("node_id")).filter("__n = 1")
    return named.join(one.select("node_id"), "node_id", "left_semi")


def _items(df: DataFrame, kind: str, prefix: str, question: Column, answer_col: Column, gold: Column, provenance: str, as_of: Column | None = None, stale: Column | None = None) -> DataFrame:
    """Items numbered without gaps; the first of equal questions stays."""
    none = F.lit(None).cast("string")
    rows = df.select(question.alias("question"), answer_col.cast("string").alias("answer"), gold.alias("gold_nodes"), F.lit(kind).alias("hop_type"), F.lit(provenance).alias("provenance"), (as_of.cast("string") if as_of is not None else none).alias("as_of"), (stale.cast("string") if stale is not None else none).alias("stale_answer"))
    rows = first_per_key(rows.filter("question IS NOT NULL AND answer IS NOT NULL"), F.col("question"), F.col("answer"))
    # one row per question of a bounded sample: the only place where all items are numbered in one task
    w = Window.orderBy("question")
    return rows.withColumn("id", F.concat(F.lit(prefix), F.lpad(F.row_number().over(w).cast("string"), 5, "0")))


def generate_single(nodes: DataFrame, edges: DataFrame, rel: str, n: int, seed: str = "42") -> DataFrame:
    """Where a uniquely named node is: the name of its only neighbour by one relation."""
    starts = unique_named(nodes)
    only = edges.filter(F.col("rel") == rel).groupBy("src_id").agg(F.count("*").alias("k"), F.min("dst_id").alias("dst_id")).filter("k = 1")
    ends = nodes.select(F.col("node_id").alias("dst_id"), F.col("name").alias("dst_name"))
    j = shuffled(starts.join(only, F.col("node_id") == F.col("src_id")).join(ends, "dst_id"), "node_id", seed, n)
    return _items(j, "single", "s", F.concat(F.col("name"), F.lit(f" {rel.lower()}?")), F.col("dst_name"), F.array("node_id", "dst_id"), f"generated:{rel}")


def generate_single_attr(nodes: DataFrame, edges: DataFrame, label: str, rel: str, n: int, least: int = 5, seed: str = "42") -> DataFrame:
    """Which attribute a node has: names of a label, ``least`` letters or more, whose nodes all lead to one attribute value
    by a relation and that only one node has."""
    named = nodes.filter((F.col("label") == label) & clean("name").isNotNull() & (F.length("name") >= least)).select("node_id", "name")
    ends = nodes.select(F.col("node_id").alias("dst_id"), F.col("name").alias("value"))
    j = named.join(edges.filter(F.col("rel") == rel).select(F.col("src_id").alias("node_id"), "dst_id"), "node_id").join(ends, "dst_id")
    only = j.groupBy("name").agg(F.countDistinct("value").alias("k"), F.countDistinct("node_id").alias("dup"), F.min("value").alias("value"), F.min("node_id").alias("node_id")).filter("k = 1 AND dup = 1")
    return _items(shuffled(only, "node_id", seed, n), "single", "sa", F.concat(F.col("name"), F.lit(f" {rel.lower()} which?")), F.col("value"), F.array("name", "value"), f"({label})-[:{rel}]->")


def generate_knowledge(table: DataFrame) -> DataFrame:
    """Items from a table of stable knowledge (question, answer, hop_type, aliases) that needs no graph."""
    w = Window.orderBy("question", "answer")
    rows = table.filter(clean("question").isNotNull() & clean("answer").isNotNull())
    return rows.select(F.concat(F.lit("k"), F.lpad(F.row_number().over(w).cast("string"), 5, "0")).alias("id"), "question", "answer", "hop_type", "aliases", F.lit("knowledge").alias("provenance"))


def tally(items: DataFrame) -> DataFrame:
    """Items per kind."""
    return items.groupBy("hop_type").agg(F.count("*").alias("n"))


def generate_multi(nodes: DataFrame, edges: DataFrame, first: str, second: str, n: int, seed: str = "42") -> DataFrame:
    """What a node reaches over two relations."""
    a = edges.filter(F.col("rel") == first).select("src_id", F.col("dst_id").alias("mid_id"))
    b = edges.filter(F.col("rel") == second).select(F.col("src_id").alias("mid_id"), "dst_id")
    ends = nodes.select(F.col("node_id").alias("dst_id"), F.col("name").alias("dst_name"))
    j = a.join(b, "mid_id").join(unique_named(nodes), F.col("src_id") == F.col("node_id")).join(ends, "dst_id")
    j = shuffled(first_per_key(j, F.col("node_id"), F.col("dst_id")), "node_id", seed, n)
    return _items(j, "multi", "m", F.concat(F.col("name"), F.lit(f" {first.lower()} {second.lower()}?")), F.col("dst_name"), F.array("node_id", "mid_id", "dst_id"), f"generated:{first}>{second}")


def generate_relational(nodes: DataFrame, edges: DataFrame, rel: str, n: int, least: int = 3, seed: str = "42") -> DataFrame:
    """How many nodes share a neighbour by one relation, ``least`` or more."""
    counts = edges.filter(F.col("rel") == rel).groupBy(F.col("dst_id").alias("node_id")).agg(F.countDistinct("src_id").alias("k")).filter(F.col("k") >= least)
    j = shuffled(counts.join(nodes, "node_id"), "node_id", seed, n)
    return _items(j, "relational", "r", F.concat(F.lit(f"how many {rel.lower()} "), F.col("name"), F.lit("?")), F.col("k"), F.array("node_id"), f"generated:{rel}:count")


def generate_temporal(nodes: DataFrame, edges: DataFrame, rel: str, n: int, seed: str = "42") -> DataFrame:
    """Whether a timed edge still holds in the year before its end or after it, by the last digit of the MD5 of its node."""
    timed = edges.filter((F.col("rel") == rel) & F.col("valid_to").isNotNull())
    j = shuffled(timed.join(unique_named(nodes), F.col("src_id") == F.col("node_id")), "node_id", seed, n)
    after = F.right(F.md5("node_id"), F.lit(1)).isin("0", "2", "4", "6", "8", "a", "c", "e")
    year = F.when(after, F.col("valid_to") + 1).otherwise(F.col("valid_to") - 1)
    return _items(j, "single", "t", F.concat(F.col("name"), F.lit(f" {rel.lower()} in "), year.cast("string"), F.lit("?")), F.when(after, "ended").otherwise("in force"), F.array("node_id"), f"generated:{rel}:time", year, F.when(after, "in force").otherwise("ended"))


def generate_ingredient(rulings: DataFrame, n: int, seed: str = "42") -> DataFrame:
    """What a source says on an ingredient on which sources differ."""
    r = rulings.filter("ingredient IS NOT NULL AND source IS NOT NULL AND ruling IS NOT NULL")
    split = r.groupBy("ingredient").agg(F.countDistinct("ruling").alias("k")).filter("k > 1").select("ingredient")
    j = shuffled(first_per_key(r.join(split, "ingredient", "left_semi"), F.col("ingredient"), F.col("source"), F.col("ruling")), "ingredient", seed, n)
    return _items(j, "relational", "i", F.concat_ws(" ", "ingredient", F.lit("by"), "source"), F.col("ruling"), F.array("ingredient", "source"), "generated:ruling")


def problems(items: DataFrame) -> DataFrame:
    """(id, problem): items without id, question or answer, of an unknown kind, or with an id used again."""
    # ids are counted in part before they meet; items without one are looked at all the same
    n = items.filter("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("__uses"))
    rules = F.array(
        F.when(clean("id").isNull(), F.lit("no id")), F.when(clean("question").isNull(), F.lit("no question")), F.when(clean("answer").isNull(), F.lit("no answer")), F.when(~F.coalesce(F.col("hop_type"), F.lit("")).isin(*KINDS), F.lit("unknown kind")),
        F.when(F.col("__uses") > 1, F.lit("repeated id")),
    )
    return items.join(n, "id", "left").select("id", *(["row_id"] if "row_id" in items.columns else []), F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("problem"))


def score(items: DataFrame, graph: Graph, retrievers: list[str], done: DataFrame | None = None, ground=None, judge=None, suite: str = "core", latency: dict[str, float] | None = None) -> DataFrame:
    """The DETAIL columns, one row per item and retriever not scored yet. ``items`` has id, question, answer, aliases (array),
    gold_nodes, hop_type, as_of (int), stale_answer and, where chains are judged, gold_path; only the temporal retriever
    reads as_of. ``latency`` gives measured seconds a question per retriever; without a model tokens and calls are 0."""
    asked = items.select(F.col("id").alias("question_id"), "question", "as_of")
    graph, out = held(graph), None
    if "seeds" not in graph.options and sum(get_retriever(name) in (graph_retriever, temporal_retriever) for name in retrievers) > 1:
        # linked once for all retrievers that link to the same nodes
        graph = Graph(graph.nodes, graph.edges, graph.rulings, graph.options | {"seeds": linked(asked, graph)})
    for name in retrievers:
        todo = asked if done is None else remaining(asked, [name], done).drop("retriever")
        # written retriever by retriever: the plan of all of them at once is more than a driver should hold
        part = cut(answer(todo if name.startswith("temporal") else todo.withColumn("as_of", F.lit(None).cast("int")), graph, name, ground))
        part = part.withColumn("retrieve_s", F.lit(float((latency or {}).get(name, 0.0))))
        out = part if out is None else out.unionByName(part)
    path = F.col("gold_path") if "gold_path" in items.columns else F.array().cast("array<string>")
    j = out.join(items.withColumn("gold_path", path).select(F.col("id").alias("question_id"), "question", F.col("answer").alias("gold"), "aliases", "gold_nodes", "hop_type", "as_of", "stale_answer", "gold_path"), "question_id")
    gold, pred, context = M.golds(F.col("gold"), F.col("aliases")), F.col("answer"), F.coalesce("context", F.lit(""))
    called = F.col("context").isNotNull() if ground else F.lit(False)
    tokens = F.when(called, M.token_estimate(F.concat(context, F.col("question"), F.coalesce(pred, F.lit(""))))).otherwise(0)
    rows = j.select(
        F.lit(suite).alias("suite"), F.col("question_id").alias("id"), "question", F.coalesce("hop_type", F.lit("unknown")).alias("hop_type"), "retriever", "answer", "gold", M.best_f1(pred, gold).alias("f1"), M.exact_match(pred, gold).alias("em"), M.containment(pred, gold).alias("containment"),
        faithfulness(judge, pred, F.col("context")).alias("faithfulness"), M.context_recall(context, gold).alias("context_recall"), M.hit_at_k(F.concat(F.array(context), "seed_names", "provenance"), F.col("gold_nodes")).alias("hit_at_k"),
        M.path_validity(F.col("chain"), F.col("gold_path")).alias("path_validity"), M.has_complete_path(F.col("complete")).alias("has_complete_path"), M.wrong_era(pred, gold, F.col("stale_answer"), F.col("as_of")).alias("wrong_era"), "as_of", F.col("retrieve_s").alias("latency_s"), "retrieve_s",
        tokens.cast("double").alias("total_tokens"), called.cast("int").alias("llm_calls"), F.length(context).cast("double").alias("context_chars"), "n_seeds", "n_triples", F.when(called & (F.coalesce(pred, F.lit("")) == ""), "no answer").otherwise("").alias("llm_error"),
    )
    return rows.select(*DETAIL)


@dataclass(frozen=True)
class Suite:
    """A set of items and the retrievers that are scored on it."""

    items: DataFrame
    retrievers: tuple[str, ...]


def run_suites(suites: dict[str, Suite], graph: Graph, folder: str, ground=None, judge=None, most_errors: float = 0.02) -> bool:
    """Scores all suites and writes detail, summary and a row of metadata to the folder; where more than ``most_errors`` of
    the rows carry an error only the detail is written, as detail_FAILED. True when the summary was written. What a folder's
    progress log holds is not scored again."""
    spark = graph.nodes.sparkSession
    began, log = time.time(), f"{folder}/progress"
    for name, suite in suites.items():
        # the log has the written rows only; a retriever is timed over all its questions
        for retriever in suite.retrievers:
            done = read_checkpoint(spark, log, "suite string, id string, retriever string").filter(F.col("suite") == name).select(F.col("id").alias("question_id"), "retriever")
            start = time.time()
            rows = cut(score(suite.items, graph, [retriever], done, ground, judge, name))
            n = rows.count()
            took = (time.time() - start) / max(1, n)
            append_progress(rows.withColumns({"retrieve_s": F.lit(took), "latency_s": F.lit(took)}), log)
    schema = ", ".join(f"{c} {'double' if c in METRICS else 'int' if c in ('as_of', 'llm_calls', 'n_seeds', 'n_triples') else 'string'}" for c in DETAIL)
    detail = read_checkpoint(spark, log, schema)
    if not write_or_quarantine(detail, f"{folder}/detail", most=most_errors):
        return False
    summary = summarise(detail)
    write_table(summary, f"{folder}/summary", kind="csv", header=True)
    totals = detail.agg(F.countDistinct("id").alias("questions"), F.count("*").alias("rows"), F.sum("llm_calls").alias("llm_calls"), F.sum("total_tokens").alias("tokens"))
    about = totals.withColumns({"generated_at": F.current_timestamp().cast("string"), "elapsed_s": F.lit(round(time.time() - began, 1)), "suites": F.array(*map(F.lit, suites))})
    write_json_lines(about, f"{folder}/meta")
    return True


def read_detail(spark, folder: str) -> DataFrame:
    """The scored rows that a run wrote."""
    return spark.read.parquet(f"{folder}/detail")


def summarise(detail: DataFrame) -> DataFrame:
    """Means of all metrics per suite, retriever and kind, and per suite and retriever over ALL kinds, with counts; NULL does not count."""
    means = [F.round(F.avg(M.skip_nan(F.col(m))), 4).alias(m) for m in METRICS]
    g = detail.groupingSets([["suite", "retriever", "hop_type"], ["suite", "retriever"]], "suite", "retriever", "hop_type").agg(*means, F.count("*").alias("n"), F.grouping("hop_type").alias("__g"))
    return g.withColumn("hop_type", F.when(F.col("__g") == 1, "ALL").otherwise(F.col("hop_type"))).drop("__g")
