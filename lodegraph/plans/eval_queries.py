"""Evaluation items made from the graph, and retrievers scored on evaluation items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions.text import clean
from lodegraph.operators import evaluation as E
from lodegraph.operators.build import timeline_graph
from lodegraph.operators.intervals import buddhist_year
from lodegraph.operators.packed import packed_values
from lodegraph.operators.retrieval import held
from lodegraph.operators.rulings import clean_rulings
from lodegraph.plans.ask_queries import domain_graph
from lodegraph.plans.build_queries import _T
from lodegraph.plans.graph_queries import EDGES_SQL, NODES_SQL, trade_edges, trade_nodes
from lodegraph.session import cut, table

_COLUMNS = ("id", "question", "answer", "hop_type")


def generate_single(spark: SparkSession, d: str) -> DataFrame:
    return E.generate_single(trade_nodes(spark, d), trade_edges(spark, d), "IN_NATION", 40).select(*_COLUMNS)


def generate_multi(spark: SparkSession, d: str) -> DataFrame:
    return E.generate_multi(trade_nodes(spark, d), trade_edges(spark, d), "IN_NATION", "IN_REGION", 40).select(*_COLUMNS)


def generate_relational(spark: SparkSession, d: str) -> DataFrame:
    return E.generate_relational(trade_nodes(spark, d), trade_edges(spark, d), "IN_NATION", 15).select(*_COLUMNS)


def generate_ingredient(spark: SparkSession, d: str) -> DataFrame:
    return E.generate_ingredient(clean_rulings(table(spark, d, "ingredient_rulings")), 30).select(*_COLUMNS)


def generate_temporal(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = timeline_graph(table(spark, d, "regulation_timeline"))
    return E.generate_temporal(nodes, edges, "ISSUED_BY", 30).select(*_COLUMNS, "as_of", "stale_answer")


def generate_single_attr(spark: SparkSession, d: str) -> DataFrame:
    return E.generate_single_attr(trade_nodes(spark, d), trade_edges(spark, d), "Supplier", "IN_NATION", 30).select(*_COLUMNS)


def generate_knowledge(spark: SparkSession, d: str) -> DataFrame:
    """Items from the regions, as a table of stable knowledge."""
    r = table(spark, d, "region").select(F.concat(F.lit("region "), F.col("r_regionkey").cast("string"), F.lit("?")).alias("question"), F.col("r_name").alias("answer"), F.lit("single").alias("hop_type"), F.array().cast("array<string>").alias("aliases"))
    return E.generate_knowledge(r).select(*_COLUMNS)


def generated_tally(spark: SparkSession, d: str) -> DataFrame:
    """Items per kind of a generated set."""
    return E.tally(generate_single(spark, d).unionByName(generate_multi(spark, d)).unionByName(generate_relational(spark, d)))


def unique_nodes(spark: SparkSession, d: str) -> DataFrame:
    return E.unique_named(trade_nodes(spark, d)).groupBy("label").agg(F.count("*").alias("n"))


def score_detail(spark: SparkSession, d: str) -> DataFrame:
    """Means of all metrics of the ruling-path, graph and temporal retrievers on all evaluation items, and of the vector
    retriever on every hundredth."""
    e = table(spark, d, "thai_eval").filter("question IS NOT NULL AND answer IS NOT NULL")
    columns = [F.col("row_id").cast("string").alias("id"), "question", "answer", packed_values("aliases").alias("aliases"), "gold_nodes", clean("hop_type").alias("hop_type"), buddhist_year("as_of").alias("as_of"), "stale_answer"]
    items, some, g = e.select(*columns), e.filter("row_id % 100 = 0").select(*columns), held(domain_graph(spark, d))
    return E.summarise(cut(E.score(items, g, ["ingredient", "graph", "temporal"])).unionByName(cut(E.score(some, g, ["vector"]))))


QUERIES = {f.__name__: f for f in (generate_single, generate_multi, generate_relational, generate_ingredient, generate_temporal, generate_single_attr, generate_knowledge, generated_tally, unique_nodes, score_detail)}

_UNIQUE = "uniq AS (SELECT name, min(node_id) AS node_id FROM nodes WHERE length(name) >= 4 GROUP BY name HAVING count(*) = 1)"
_NUMBERED = "SELECT '{p}' || lpad((row_number() OVER (ORDER BY question))::VARCHAR, 5, '0') AS id, question, answer, '{k}' AS hop_type FROM q"
_CL = "(CASE WHEN lower(trim({0}, ' \t\n\r ')) NOT IN ('', 'nan', 'none', 'null') THEN trim({0}, ' \t\n\r ') END)"

ORACLES = {
    "generate_single": f"""WITH {NODES_SQL}, {EDGES_SQL}, {_UNIQUE}, one AS (SELECT src_id, min(dst_id) AS dst_id FROM edges WHERE rel = 'IN_NATION' GROUP BY 1 HAVING count(*) = 1),
 j AS (SELECT u.name, n.name AS dst_name FROM uniq u JOIN one ON u.node_id = one.src_id JOIN nodes n ON one.dst_id = n.node_id ORDER BY md5(u.node_id || '42'), u.node_id LIMIT 40),
 q AS (SELECT name || ' in_nation?' AS question, dst_name AS answer FROM j) {_NUMBERED.format(p='s', k='single')}""",
    "generate_multi": f"""WITH {NODES_SQL}, {EDGES_SQL}, {_UNIQUE}, j AS (SELECT u.name, n.name AS dst_name FROM uniq u JOIN edges a ON u.node_id = a.src_id AND a.rel = 'IN_NATION' JOIN edges b ON a.dst_id = b.src_id AND b.rel = 'IN_REGION' JOIN nodes n ON b.dst_id = n.node_id
 ORDER BY md5(u.node_id || '42'), u.node_id LIMIT 40), q AS (SELECT name || ' in_nation in_region?' AS question, dst_name AS answer FROM j) {_NUMBERED.format(p='m', k='multi')}""",
    "generate_relational": f"""WITH {NODES_SQL}, {EDGES_SQL}, c AS (SELECT dst_id, count(DISTINCT src_id) AS k FROM edges WHERE rel = 'IN_NATION' GROUP BY 1 HAVING count(DISTINCT src_id) >= 3),
 j AS (SELECT n.name, c.k FROM c JOIN nodes n ON c.dst_id = n.node_id ORDER BY md5(n.node_id || '42'), n.node_id LIMIT 15), q AS (SELECT 'how many in_nation ' || name || '?' AS question, k::VARCHAR AS answer FROM j) {_NUMBERED.format(p='r', k='relational')}""",
    "generate_ingredient": f"""WITH r AS (SELECT {_CL.format('ingredient_th')} AS i, {_CL.format('source_th')} AS s, lower({_CL.format('ruling')}) AS v FROM ingredient_rulings), ok AS (SELECT * FROM r WHERE i IS NOT NULL AND s IS NOT NULL AND v IS NOT NULL),
 f AS (SELECT i, s, v, row_number() OVER (PARTITION BY i ORDER BY s, v) AS rn FROM ok WHERE i IN (SELECT i FROM ok GROUP BY i HAVING count(DISTINCT v) > 1)),
 j AS (SELECT * FROM f WHERE rn = 1 ORDER BY md5(i || '42'), i LIMIT 30), q AS (SELECT i || ' by ' || s AS question, v AS answer FROM j) {_NUMBERED.format(p='i', k='relational')}""",
    "generate_temporal": f"""WITH {_T}, n AS (SELECT 'Regulation:' || k AS node_id, name FROM rg UNION ALL SELECT 'Organisation:' || name, name FROM og UNION ALL SELECT DISTINCT 'Organisation:' || issuer, issuer FROM rg WHERE issuer IS NOT NULL AND issuer NOT IN (SELECT name FROM og)),
 u AS (SELECT name, min(node_id) AS node_id FROM n WHERE length(name) >= 4 GROUP BY 1 HAVING count(*) = 1),
 j AS (SELECT u.name, u.node_id, rg.vt, right(md5(u.node_id), 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') AS after FROM rg JOIN u ON u.node_id = 'Regulation:' || rg.k WHERE rg.issuer IS NOT NULL AND rg.vt IS NOT NULL ORDER BY md5(u.node_id || '42'), u.node_id LIMIT 30),
 q AS (SELECT CASE WHEN after THEN vt + 1 ELSE vt - 1 END AS y, name, CASE WHEN after THEN 'ended' ELSE 'in force' END AS answer, CASE WHEN after THEN 'in force' ELSE 'ended' END AS stale_answer FROM j)
 SELECT 't' || lpad((row_number() OVER (ORDER BY name || ' issued_by in ' || y || '?'))::VARCHAR, 5, '0') AS id, name || ' issued_by in ' || y || '?' AS question, answer, 'single' AS hop_type, y::VARCHAR AS as_of, stale_answer FROM q""",
    "generate_single_attr": f"""WITH {NODES_SQL}, {EDGES_SQL}, j AS (SELECT n.name, min(n.node_id) AS node_id, min(t.name) AS value FROM nodes n JOIN edges e ON e.src_id = n.node_id AND e.rel = 'IN_NATION' JOIN nodes t ON e.dst_id = t.node_id WHERE n.label = 'Supplier' AND length(n.name) >= 5
 GROUP BY 1 HAVING count(DISTINCT t.name) = 1 AND count(DISTINCT n.node_id) = 1 ORDER BY md5(min(n.node_id) || '42'), min(n.node_id) LIMIT 30), q AS (SELECT name || ' in_nation which?' AS question, value AS answer FROM j) {_NUMBERED.format(p='sa', k='single')}""",
    "generate_knowledge": "WITH q AS (SELECT 'region ' || r_regionkey || '?' AS question, r_name AS answer FROM region) " + _NUMBERED.format(p='k', k='single'),
    "generated_tally": f"WITH {NODES_SQL}, {EDGES_SQL}, {_UNIQUE}, one AS (SELECT src_id FROM edges WHERE rel = 'IN_NATION' GROUP BY 1 HAVING count(*) = 1), c AS (SELECT dst_id FROM edges WHERE rel = 'IN_NATION' GROUP BY 1 HAVING count(DISTINCT src_id) >= 3) SELECT 'single' AS hop_type, least(40, count(*)) AS n FROM uniq JOIN one ON node_id = src_id UNION ALL SELECT 'multi', least(40, count(DISTINCT u.node_id)) FROM uniq u JOIN edges a ON u.node_id = a.src_id AND a.rel = 'IN_NATION' UNION ALL SELECT 'relational', least(15, count(*)) FROM c",
    "unique_nodes": f"WITH {NODES_SQL}, {_UNIQUE} SELECT label, count(*) AS n FROM nodes WHERE node_id IN (SELECT node_id FROM uniq) GROUP BY 1",
}
