"""Retrieval for many questions at once, and answers grounded in what was retrieved.

A retriever is a function (questions, graph) -> contexts with questions (question_id, question, as_of) and contexts
(question_id, text, provenance). Retrievers are registered by name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.functions import vector as V
from lodegraph.functions.dates import as_of_year
from lodegraph.functions.text import display_name
from lodegraph.operators import graph as G
from lodegraph.operators.build import period_text
from lodegraph.operators.linking import seeds
from lodegraph.operators.rulings import severity, verdicts
from lodegraph.session import cut


@dataclass
class Graph:
    """What the retrievers read: nodes with text, edges (valid_from and valid_to, null where not timed) and rulings. Options:
    embedder, vectors (node_id, text, v), labels and relations (names to show), leaves (labels that are not expanded), timeline,
    contains, seeds (of all questions that will be asked)."""

    nodes: DataFrame
    edges: DataFrame
    rulings: DataFrame | None = None
    options: dict = field(default_factory=dict)


def held(graph: Graph) -> Graph:
    """The graph with its nodes and edges written once: a retriever reads them many times."""
    if graph.options.get("held"):
        return graph
    return Graph(cut(graph.nodes), cut(graph.edges), graph.rulings, graph.options | {"held": True})


def linked(questions: DataFrame, graph: Graph) -> DataFrame:
    """The seeds of the questions in the graph's nodes; those of the option ``seeds`` are taken where it has been given, which
    must hold the seeds of all questions asked. A question's seeds do not depend on the others."""
    known = graph.options.get("seeds")
    return cut(seeds(questions, graph.nodes) if known is None else known.join(questions.select("question_id").distinct(), "question_id", "left_semi"))


Retriever = Callable[[DataFrame, Graph], DataFrame]
_REGISTRY: dict[str, Retriever] = {}
_ALIASES: dict[str, str] = {}


def register(name: str, *aliases: str) -> Callable[[Retriever], Retriever]:
    def add(f: Retriever) -> Retriever:
        _REGISTRY[name] = f
        _ALIASES.update({a: name for a in aliases})
        return f

    return add


def get_retriever(name: str) -> Retriever:
    key = _ALIASES.get(name.lower(), name.lower())
    if key not in _REGISTRY:
        raise ValueError(f"unknown retriever {name!r}; there are {', '.join(available_retrievers())}")
    return _REGISTRY[key]


def available_retrievers() -> list[str]:
    return sorted(_REGISTRY)


def hashing_embedder(dim: int = 64, gram: int = 3):
    """An offline embedding: signed counts of hashed character runs, scaled to length one; a blank text counts as '-'."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        import zlib

        out = []
        for t in texts:
            t = (t or "").strip() or "-"
            v = np.zeros(dim, np.float32)
            for i in range(max(1, len(t) - gram + 1)):
                h = zlib.crc32(t[i : i + gram].encode("utf-8", "surrogatepass"))
                v[h % dim] += 1 if h & 0x10000 else -1
            n = float(np.linalg.norm(v))
            out.append(v / n if n else v)
        return pd.Series(out)

    return embed


@register("vector", "vanilla", "dense")
def vector_retriever(questions: DataFrame, graph: Graph, k: int = 5) -> DataFrame:
    """The texts of the k nodes nearest to the question; vectors stored by clients.index_labels are read, not made again."""
    embed = graph.options.get("embedder") or hashing_embedder()
    stored = graph.options.get("vectors")
    corpus = stored if stored is not None else graph.nodes.filter("text IS NOT NULL").select("node_id", "text", embed("text").alias("v"))
    asked = questions.select(F.col("question_id").alias("node_id"), embed("question").alias("v"))
    best = V.top_k(corpus, asked, "node_id", "v", k).withColumnRenamed("id", "node_id").join(graph.nodes.select("node_id", "text"), "node_id")
    return _contexts(best.select(F.col("query_id").alias("question_id"), F.col("rank").alias("line_no"), "text", "node_id"))


CONTEXT = ("question_id", "text", "provenance", "seed_names", "n_seeds", "n_triples", "chain", "complete")


def _contexts(lines: DataFrame, found: DataFrame | None = None, chains: DataFrame | None = None) -> DataFrame:
    """Lines (question_id, line_no, text, node_id) put together per question in order, with the seeds' names and the chain
    of evidence; a question has no more lines than its fact cap."""
    rows = F.array_sort(F.collect_list(F.struct("line_no", "text", "node_id")))
    g = lines.groupBy("question_id").agg(rows.alias("rows"))
    g = g.select("question_id", F.array_join(F.transform("rows", lambda r: r["text"]), "\n").alias("text"), F.array_distinct(F.filter(F.transform("rows", lambda r: r["node_id"]), lambda x: x.isNotNull())).alias("provenance"), F.size("rows").alias("n_triples"))
    none = F.array().cast("array<string>")
    if found is not None:
        names = found.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]).alias("seed_names"))
        g = g.join(names, "question_id", "left")
    else:
        g = g.withColumn("seed_names", none)
    g = g.join(chains, "question_id", "left") if chains is not None else g.withColumns({"chain": none, "complete": F.lit(False)})
    return g.select("question_id", "text", "provenance", F.coalesce("seed_names", none).alias("seed_names"), F.size(F.coalesce("seed_names", none)).alias("n_seeds"), "n_triples", F.coalesce("chain", none).alias("chain"), F.coalesce("complete", F.lit(False)).alias("complete"))


# Lines of a context come in blocks: cards of the seeds, what is around them, what lies a step further, the rest.
_BLOCK = 1_000_000

# Groups shown of a node, nodes expanded to a second step, members of a group that may be, pairs of seeds that
# are connected, facts of a context.
MOST_GROUPS, MOST_EXPANDED, SMALL_GROUP, MOST_PAIRS, MOST_FACTS = 10, 4, 3, 6, 60


def _group_line(graph: Graph) -> Column:
    rel, label = display_name("rel", graph.options.get("relations", {})), display_name("mlabel", graph.options.get("labels", {}))
    arrow = F.when(F.col("outgoing"), F.concat(F.lit("-["), rel, F.lit("]-> "))).otherwise(F.concat(F.lit("<-["), rel, F.lit("]- ")))
    shown = F.array_join(F.transform("samples", lambda x: F.left(x, F.lit(60))), ", ")
    more = F.when(F.col("n") > F.size("samples"), F.concat(F.lit(" (of "), F.format_number("n", 0), F.lit(")"))).otherwise(F.lit(""))
    return F.concat(arrow, label, F.lit(": "), shown, more)


def _groups(near: DataFrame, *by: str) -> DataFrame:
    """The largest groups of every node, numbered."""
    w = Window.partitionBy("node_id", *by).orderBy(F.desc("n"), "rel", "mlabel", "outgoing")
    return near.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= MOST_GROUPS)


def _fact_lines(found: DataFrame, groups: DataFrame, graph: Graph, block: int, *by: str) -> DataFrame:
    facts = groups.select("node_id", *by, "r", _group_line(graph).alias("fact"))
    return found.select("question_id", "node_id", *by, "rank", "name").join(facts, ["node_id", *by]).select("question_id", "node_id", (F.lit(block * _BLOCK) + F.col("rank") * 1000 + F.col("r")).alias("line_no"), F.concat_ws(" ", "name", "fact").alias("text"))


def _cards(found: DataFrame, graph: Graph) -> DataFrame:
    return found.select("question_id", "node_id", "rank").join(graph.nodes.select("node_id", "text"), "node_id").select("question_id", "node_id", (F.col("rank") * 1000).alias("line_no"), "text").filter("text <> ''")


def _capped(lines: DataFrame, most: int) -> DataFrame:
    w = Window.partitionBy("question_id").orderBy("line_no", "node_id", "text")
    return lines.withColumn("line_no", F.row_number().over(w)).filter(F.col("line_no") <= most)


def second_step(found: DataFrame, groups: DataFrame, leaves: tuple[str, ...]) -> DataFrame:
    """(question_id, node_id, rank): the first few attribute nodes of small groups around a question's seeds, in the order of
    seeds and groups, none of them a seed."""
    small = groups.filter((F.col("n") <= SMALL_GROUP) & ~F.col("mlabel").isin(*leaves)).select("node_id", "r", F.posexplode("sample_ids").alias("i", "member"))
    met = found.select("question_id", "node_id", "rank").join(small, "node_id").groupBy("question_id", "member").agg(F.min(F.struct("rank", "r", "i")).alias("at"))
    fresh = met.withColumnRenamed("member", "node_id").join(found.select("question_id", "node_id"), ["question_id", "node_id"], "left_anti")
    w = Window.partitionBy("question_id").orderBy("at", "node_id")
    return fresh.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= MOST_EXPANDED).select("question_id", "node_id", "rank")


@register("graph", "graph-retrieval")
def graph_retriever(questions: DataFrame, graph: Graph, most_facts: int = MOST_FACTS) -> DataFrame:
    """Cards and aggregated neighbourhoods of the linked nodes, the neighbourhoods of the attribute nodes a step further, and
    the least paths that connect linked nodes; at most ``most_facts`` lines."""
    graph = held(graph)
    found = linked(questions, graph)
    near = cut(_groups(G.neighbourhood(graph.nodes, graph.edges, found)))
    further = cut(second_step(found, near, graph.options.get("leaves", ("Place", "Product"))))
    # what is put together at last is written part by part: one plan of all of it is more than a driver should hold
    beyond = cut(_groups(G.neighbourhood(graph.nodes, graph.edges, further)))
    named = further.join(graph.nodes.select("node_id", F.coalesce("name", "label").alias("name")), "node_id")
    a = found.select("question_id", F.col("node_id").alias("src_id"), F.col("rank").alias("ra"))
    b = found.select("question_id", F.col("node_id").alias("dst_id"), F.col("rank").alias("rb"))
    w = Window.partitionBy("question_id").orderBy("ra", "rb")
    pairs = cut(a.join(b, "question_id").filter("ra < rb").withColumn("i", F.row_number().over(w)).filter(F.col("i") <= MOST_PAIRS))
    paths = cut(G.path_details(G.shortest_paths(graph.edges, pairs, 4), graph.nodes, graph.edges))
    hop = F.concat(F.lit("("), F.col("hops").cast("string"), F.lit(" hop) "), F.col("line"))
    bridges = pairs.join(paths, ["src_id", "dst_id"]).select("question_id", F.lit(None).cast("string").alias("node_id"), (F.lit(3 * _BLOCK) + F.col("i")).alias("line_no"), hop.alias("text"))
    lines = _cards(found, graph).unionByName(_fact_lines(found, near, graph, 1)).unionByName(_fact_lines(named, beyond, graph, 2)).unionByName(bridges)
    return _contexts(cut(_capped(lines, most_facts)), found)


# Fixed value: what is listed at most as run out, and as in force, in a year.
MOST_LISTED = 20


def in_force(timeline: DataFrame, years: DataFrame) -> DataFrame:
    """(year, i, node_id, text) for the asked ``years`` (a column year): the first regulations in force, the earliest first.

    ``timeline`` has node_id, name, valid_from, valid_to and issuer. A validity is cut to the span of the asked years and
    taken apart into years, of which there are no more than four digits tell, so years meet by equality."""
    asked = F.broadcast(years.select("year").distinct())
    span = years.agg(F.min("year").alias("lo"), F.max("year").alias("hi"))
    rows = timeline.join(F.broadcast(span), F.lit(True)).withColumns({"a": F.greatest(F.coalesce("valid_from", "lo"), "lo"), "b": F.least(F.coalesce("valid_to", "hi"), "hi")}).filter("a <= b")
    live = rows.select("node_id", "name", "valid_from", "valid_to", "issuer", F.explode(F.sequence("a", "b")).alias("year")).join(asked, "year")
    w = Window.partitionBy("year").orderBy("valid_from", "node_id")
    first = live.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= MOST_LISTED)
    text = F.concat_ws(", ", F.concat(F.col("name"), F.lit(" in force "), period_text(F.col("valid_from"), F.col("valid_to"))), F.concat(F.lit("issued by "), F.col("issuer")))
    return first.select("year", "i", "node_id", text.alias("text"))


@register("temporal", "temporal-graph")
def temporal_retriever(questions: DataFrame, graph: Graph, most_facts: int = MOST_FACTS) -> DataFrame:
    """For questions with a year, stated or mentioned: cards, the aggregated neighbourhoods at that year, what had run out by
    then, and the regulations in force. Questions without a year go to the graph retriever."""
    graph = held(graph)
    asked = cut(questions.withColumn("year", F.coalesce("as_of", as_of_year(F.col("question")))))
    dated, undated = asked.filter("year IS NOT NULL"), asked.filter("year IS NULL")
    # questions with and without a year are linked together
    every = linked(asked, graph)
    graph = Graph(graph.nodes, graph.edges, graph.rulings, graph.options | {"seeds": every})
    found = cut(every.join(dated.select("question_id", "year").distinct(), "question_id"))
    near = cut(_groups(G.neighbourhood(graph.nodes, graph.edges, found, at="year"), "year"))
    timed = G.both_ways(graph.edges.filter("valid_to IS NOT NULL").select("src_id", "dst_id", "rel", "valid_to"), "valid_to").filter("outgoing")
    names = graph.nodes.select(F.col("node_id").alias("other_id"), F.col("name").alias("other"))
    gone = found.select("question_id", "node_id", "rank", "name", "year").join(timed, "node_id").filter("valid_to < year").join(names, "other_id", "left")
    w = Window.partitionBy("question_id").orderBy("rank", "valid_to", "rel", "other_id")
    ended = F.format_string("%s: %s of %s ended in %d, before %d", "name", display_name("rel", graph.options.get("relations", {})), F.coalesce("other", "other_id"), "valid_to", "year")
    lapsed = cut(gone.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= MOST_LISTED).select("question_id", "node_id", (F.lit(2 * _BLOCK) + F.col("i")).alias("line_no"), ended.alias("text")))
    lines = _cards(found, graph).unionByName(_fact_lines(found, near, graph, 1, "year")).unionByName(lapsed)
    timeline = graph.options.get("timeline")
    if timeline is not None:
        listed = in_force(timeline, found.select("year"))
        law = found.select("question_id", "year").distinct().join(cut(listed), "year").select("question_id", F.lit(None).cast("string").alias("node_id"), (F.lit(3 * _BLOCK) + F.col("i")).alias("line_no"), "text")
        lines = lines.unionByName(law)
    return _contexts(cut(_capped(lines, most_facts)), found).unionByName(graph_retriever(undated.drop("year"), graph, most_facts))


# Seeds and ingredients of an explanation, its paths and products.
MOST_SEEDS, MOST_INGREDIENTS, MOST_PATHS, MOST_PRODUCTS = 6, 8, 60, 5


@register("ingredient", "explain", "path")
def ingredient_retriever(questions: DataFrame, graph: Graph, most_paths: int = MOST_PATHS) -> DataFrame:
    """Ruling paths of the ingredients named in a question or contained in a product named in it: per ingredient its verdict,
    the worst, or that its sources differ, then the paths with their basis, the most severe first; then products that
    contain the ingredients. ``graph.options['contains']`` has node_id, product, code, ingredient and term."""
    # read four times
    r = cut(graph.rulings.filter("ingredient IS NOT NULL AND source IS NOT NULL").filter(severity(F.col("ruling")).isNotNull()))
    contains = graph.options.get("contains")
    names = r.select(F.col("ingredient").alias("node_id"), F.lit("Ingredient").alias("label"), F.col("ingredient").alias("name")).distinct()
    if contains is not None:
        contains = cut(contains)
        names = names.unionByName(contains.select("node_id", F.lit("Product").alias("label"), F.col("product").alias("name")).distinct())
    found = cut(seeds(questions, names, limit=MOST_SEEDS))
    meant = found.select("question_id", "rank", F.col("node_id").alias("ingredient")).filter("label = 'Ingredient'")
    if contains is not None:
        inside = found.filter("label = 'Product'").select("question_id", "rank", "node_id").join(contains.select("node_id", "ingredient"), "node_id").select("question_id", "rank", "ingredient")
        meant = meant.unionByName(inside)
    w = Window.partitionBy("question_id").orderBy("rank", "ingredient")
    meant = meant.groupBy("question_id", "ingredient").agg(F.min("rank").alias("rank")).withColumn("k", F.row_number().over(w)).filter(F.col("k") <= MOST_INGREDIENTS)
    meant = cut(meant.select("question_id", "ingredient", "k"))
    verdict = verdicts(r, "ingredient", "ruling")
    code = r.groupBy("ingredient").agg(F.min("e_number").alias("e_number")) if "e_number" in r.columns else r.select("ingredient", F.lit(None).cast("string").alias("e_number")).distinct()
    says = F.when(F.col("conflict"), F.concat(F.lit(" depends on the source; at worst "), F.col("verdict"))).otherwise(F.concat(F.lit(" -> "), F.col("verdict")))
    head = F.concat(F.col("ingredient"), F.coalesce(F.concat(F.lit(" (code "), F.col("e_number"), F.lit(")")), F.lit("")), says)
    heads = meant.join(verdict, "ingredient").join(code, "ingredient").select("question_id", F.col("ingredient").alias("node_id"), (F.col("k") * _BLOCK).alias("line_no"), head.alias("text"))
    basis = F.col("basis") if "basis" in r.columns else F.lit(None).cast("string")
    paths = r.groupBy("ingredient", "source", "ruling").agg(F.min(basis).alias("basis"))
    p = Window.partitionBy("question_id", "k").orderBy(severity(F.col("ruling")), "source")
    all_paths = Window.partitionBy("question_id").orderBy("k", "i")
    lined = cut(meant.join(paths, "ingredient").withColumn("i", F.row_number().over(p)).withColumn("j", F.row_number().over(all_paths)).filter(F.col("j") <= most_paths))
    text = F.concat_ws(": ", F.concat_ws(" -> ", "ingredient", "source", "ruling"), "basis")
    lines = heads.unionByName(lined.select("question_id", F.col("ingredient").alias("node_id"), (F.col("k") * _BLOCK + F.col("i")).alias("line_no"), text.alias("text")))
    if contains is not None:
        few = Window.partitionBy("ingredient").orderBy("node_id")
        some = contains.withColumn("i", F.row_number().over(few)).filter(F.col("i") <= MOST_PRODUCTS)
        of = Window.partitionBy("question_id").orderBy("k", "i")
        sold = meant.join(some, "ingredient").withColumn("j", F.row_number().over(of)).filter(F.col("j") <= MOST_PRODUCTS)
        says = F.concat(F.lit("contained in "), F.col("product"), F.coalesce(F.concat(F.lit(" (code "), F.col("code"), F.lit(")")), F.lit("")), F.lit(": '"), F.col("term"), F.lit("'"))
        lines = lines.unionByName(sold.select("question_id", "node_id", (F.lit((MOST_INGREDIENTS + 1) * _BLOCK) + F.col("j")).alias("line_no"), says.alias("text")))
    steps = F.array_sort(F.collect_list(F.struct("j", F.array("ingredient", "source", "ruling").alias("chain"))))
    chains = lined.groupBy("question_id").agg(F.flatten(F.transform(steps, lambda x: x["chain"])).alias("chain"), F.lit(True).alias("complete"))
    return _contexts(lines, found, chains)


# Fixed value: the answer where nothing was retrieved.
NO_CONTEXT = "no evidence found"


def answer(questions: DataFrame, graph: Graph, retriever: str, ground=None) -> DataFrame:
    """(question_id, retriever, answer, context, provenance, seed_names, n_seeds, n_triples, chain, complete). ``ground`` is a
    Column function (question, context) for a language model, see clients.ground_with; without one the answer is the
    beginning of the context. No context, no call."""
    contexts = get_retriever(retriever)(questions, graph)
    j = questions.join(contexts, "question_id", "left")
    said = F.when(F.col("text").isNotNull(), ground(F.col("question"), F.col("text"))) if ground else F.left(F.col("text"), F.lit(500))
    none, zero = F.array().cast("array<string>"), F.lit(0)
    return j.select(
        "question_id", F.lit(retriever).alias("retriever"), F.when(F.col("text").isNull(), NO_CONTEXT).otherwise(said).alias("answer"), F.col("text").alias("context"), F.coalesce("provenance", none).alias("provenance"), F.coalesce("seed_names", none).alias("seed_names"),
        F.coalesce("n_seeds", zero).alias("n_seeds"), F.coalesce("n_triples", zero).alias("n_triples"), F.coalesce("chain", none).alias("chain"), F.coalesce("complete", F.lit(False)).alias("complete"),
    )


def remaining(questions: DataFrame, retrievers: list[str], done: DataFrame) -> DataFrame:
    """Questions by retriever that have no score yet."""
    grid = questions.withColumn("retriever", F.explode(F.array(*[F.lit(r) for r in retrievers])))
    return grid.join(done.select("question_id", "retriever").distinct(), ["question_id", "retriever"], "left_anti")
