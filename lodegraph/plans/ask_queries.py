"""Questions linked and answered end to end over the places, provinces, regulations and rulings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions.text import clean
from lodegraph.operators import build as B
from lodegraph.operators import graph as G
from lodegraph.operators import linking as L
from lodegraph.operators import retrieval as R
from lodegraph.operators.intervals import buddhist_year
from lodegraph.operators.rulings import clean_rulings
from lodegraph.plans.domain_queries import term_link
from lodegraph.plans.build_queries import _T
from lodegraph.plans.graph_queries import _CL, _PLACES_SQL, PLACE_SPEC
from lodegraph.session import table


def domain_graph(spark: SparkSession, d: str, contains: bool = False) -> R.Graph:
    """Places, their districts and provinces, and regulations with their issuers and what they replace, the latter edges
    timed; with ``contains`` also which products hold which ingredients."""
    places, rulings, timeline = table(spark, d, "places"), table(spark, d, "ingredient_rulings"), table(spark, d, "regulation_timeline")
    pn = G.build_nodes(places, PLACE_SPEC).select("node_id", "label", "name", "text")
    pe = G.build_edges(places, PLACE_SPEC)
    attrs = G.attribute_nodes(pe).select("node_id", "label", "name", F.concat_ws(" | ", "label", "key").alias("text"))
    rn, re = B.timeline_graph(timeline)
    none = F.lit(None).cast("int")
    edges = pe.select("src_id", "rel", "dst_id", none.alias("valid_from"), none.alias("valid_to")).unionByName(re.select("src_id", "rel", "dst_id", "valid_from", "valid_to"))
    nodes = pn.unionByName(attrs).unionByName(rn.select("node_id", "label", "name", "text"))
    issuer = re.filter("rel = 'ISSUED_BY'").select(F.col("src_id").alias("node_id"), "valid_from", "valid_to", F.substr("dst_id", F.lit(len("Organisation:") + 1)).alias("issuer"))
    in_time = rn.filter("label = 'Regulation'").select("node_id", "name").join(issuer, "node_id")
    options = {"timeline": in_time}
    if contains:
        links = term_link(spark, d).select("row_id", "ingredient", "term")
        products = table(spark, d, "product_processed").select("row_id", clean("product_name").alias("product"), clean("halal_code").alias("code"))
        options["contains"] = links.join(products, "row_id").select(F.concat(F.lit("Product:"), F.col("row_id").cast("string")).alias("node_id"), "product", "code", "ingredient", "term")
    known = clean_rulings(rulings).join(rulings.select("row_id", clean("e_number").alias("e_number")), "row_id")
    return R.Graph(nodes, edges, known, options)


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "thai_eval").filter("question IS NOT NULL").select(F.col("row_id").cast("string").alias("question_id"), L.clean_question(F.col("question")).alias("question"), buddhist_year("as_of").alias("as_of"))


def link_entities(spark: SparkSession, d: str) -> DataFrame:
    return L.seeds(_questions(spark, d), domain_graph(spark, d).nodes).select("question_id", "node_id", "score", "matched_by", "rank")


def _ask(spark: SparkSession, d: str, retriever: str) -> DataFrame:
    return R.answer(_questions(spark, d), domain_graph(spark, d), retriever).select("question_id", "retriever", "answer", F.size("provenance").alias("n_sources"))


def ask_vector(spark: SparkSession, d: str) -> DataFrame:
    """Exact nearest texts for every hundredth question, against all nodes."""
    g = domain_graph(spark, d)
    asked = _questions(spark, d).filter(F.col("question_id").cast("long") % 100 == 0)
    return R.answer(asked, g, "vector").select("question_id", "retriever", "answer", F.size("provenance").alias("n_sources"))


def ask_graph(spark: SparkSession, d: str) -> DataFrame:
    return _ask(spark, d, "graph")


def ask_temporal(spark: SparkSession, d: str) -> DataFrame:
    return _ask(spark, d, "temporal")


def ask_ingredient(spark: SparkSession, d: str) -> DataFrame:
    g = domain_graph(spark, d, contains=True)
    return R.answer(_questions(spark, d), g, "ingredient").select("question_id", "retriever", "answer", F.size("provenance").alias("n_sources"))


QUERIES = {f.__name__: f for f in (link_entities, ask_vector, ask_graph, ask_temporal, ask_ingredient)}


def _in(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


_DOMAIN_NODES = f"""{_PLACES_SQL}, {_T}, dn AS (SELECT 'Place:' || k AS node_id, 'Place' AS label, {_CL.format('name')} AS name FROM pl WHERE rn = 1 AND k IS NOT NULL
 UNION ALL SELECT DISTINCT 'District:' || {_CL.format('district')} || '|' || {_CL.format('province')}, 'District', {_CL.format('district')} FROM pl WHERE k IS NOT NULL AND {_CL.format('district')} IS NOT NULL AND {_CL.format('province')} IS NOT NULL
 UNION ALL SELECT DISTINCT 'Province:' || {_CL.format('province')}, 'Province', {_CL.format('province')} FROM pl WHERE k IS NOT NULL AND {_CL.format('province')} IS NOT NULL
 UNION ALL SELECT 'Regulation:' || k, 'Regulation', name FROM rg UNION ALL SELECT 'Organisation:' || name, 'Organisation', name FROM og
 UNION ALL SELECT DISTINCT 'Organisation:' || issuer, 'Organisation', issuer FROM rg WHERE issuer IS NOT NULL AND issuer NOT IN (SELECT name FROM og))"""
_PREFIXED = " ".join(f"WHEN label = '{k}' THEN list_transform([{', '.join(repr(x) for x in v)}], lambda x: x || name)" for k, v in L.REQUIRED_PREFIX.items())
_LINKED = f"""{_DOMAIN_NODES},
q AS (SELECT row_id::VARCHAR AS question_id, trim(regexp_replace(question, '[\\s.,!?;:()\\[\\]"''`‘’“”]+', ' ', 'g')) AS question FROM thai_eval WHERE question IS NOT NULL),
gn AS (SELECT label, lower(name) AS low, min(node_id) AS node_id, min_by(name, node_id) AS name FROM dn WHERE name IS NOT NULL GROUP BY 1, 2),
gt AS (SELECT node_id, label, name, unnest(CASE {_PREFIXED} WHEN length(regexp_replace(name, '[ัิ-ฺ็-๎]', '', 'g')) < {L.SHORT_NAME} THEN list_transform([{', '.join(repr(x) for x in L.SHORT_PREFIX)}], lambda x: x || name) ELSE [name] END) AS term
 FROM gn WHERE length(name) >= 2 AND name NOT IN {_in(L.STOPWORDS)} AND trim(low) NOT IN {_in(L.GENERIC_NAMES)}),
gh AS (SELECT DISTINCT q.question_id, node_id, label, name FROM q JOIN gt ON contains(lower(q.question), lower(term))),
ex AS (SELECT * FROM gh a WHERE NOT EXISTS (SELECT 1 FROM gh b WHERE a.question_id = b.question_id AND lower(a.name) <> lower(b.name) AND contains(lower(b.name), lower(a.name)))),
bl AS (SELECT question_id, list(low ORDER BY length(low) DESC, low DESC) AS names FROM (SELECT DISTINCT question_id, lower(name) AS low FROM ex) GROUP BY 1),
qr AS (SELECT q.question_id, list_reduce(list_prepend(lower(question), coalesce(names, [])), lambda x, y: replace(x, y, chr(10))) AS q FROM q LEFT JOIN bl USING (question_id)),
nn AS (SELECT lower(name) AS low, min(node_id) AS node_id, min_by(name, node_id) AS name, min_by(label, node_id) AS label FROM dn WHERE name IS NOT NULL GROUP BY 1),
sn AS (SELECT lower(name) AS low, min(node_id) AS node_id, min_by(name, node_id) AS name, min_by(label, node_id) AS label FROM dn WHERE name IS NOT NULL AND label NOT IN {_in(L.REQUIRED_PREFIX)} GROUP BY 1
 HAVING trim(lower(name)) NOT IN {_in(sorted({*L.STOPWORDS, *L.WEAK_OVERLAPS, *L.GENERIC_NAMES}))} AND length(lower(name)) >= {L.LEAST_RUN}),
sz AS (SELECT unnest({L.ladder(10_000)}) AS n),
sr AS (SELECT DISTINCT low, n, substring(low, i::INTEGER, n::INTEGER) AS run FROM (SELECT low, n, unnest(range(1, length(low) - n + 2)) AS i FROM sn, sz WHERE n <= length(low) AND round(2.0::DOUBLE * n / (n + length(low)), 4) >= {L.LEAST_SCORE})),
qu AS (SELECT DISTINCT question_id, substring(q, i::INTEGER, n::INTEGER) AS run FROM (SELECT question_id, q, n, unnest(range(1, length(q) - n + 2)) AS i FROM qr, sz WHERE n <= length(q) AND n <= (SELECT max(length(low)) FROM sn))),
sb AS (SELECT question_id, low, max(n) AS n FROM qu JOIN sr USING (run) WHERE trim(run) NOT IN {_in(L._WEAK_RUNS)} GROUP BY 1, 2),
sim AS (SELECT * FROM (SELECT question_id, node_id, label, name, round(2.0::DOUBLE * n / (n + length(low)), 4) AS score, row_number() OVER (PARTITION BY question_id ORDER BY round(2.0::DOUBLE * n / (n + length(low)), 4) DESC, length(low), node_id) AS i FROM sb JOIN sn USING (low)) WHERE i <= 5),
h AS (SELECT question_id, node_id, label, name, 1.0::DOUBLE AS score, 'name' AS matched_by FROM ex UNION ALL SELECT question_id, node_id, label, name, score, 'similar' FROM sim),
rest AS (SELECT * FROM q WHERE question_id NOT IN (SELECT question_id FROM h)),
cs AS (SELECT question_id, trim(w) AS x, 0 AS p, 0 AS l, i FROM (SELECT question_id, unnest(regexp_split_to_array(question, '\\s+')) AS w, generate_subscripts(regexp_split_to_array(question, '\\s+'), 1) AS i FROM rest) WHERE length(w) >= 3
 UNION ALL SELECT question_id, trim(substring(question, i::INTEGER, n::INTEGER)), 1, -length(trim(substring(question, i::INTEGER, n::INTEGER))), (12 - n) * 100000 + i FROM (SELECT question_id, question, n, unnest(range(1, length(question) - n + 2)) AS i FROM rest, (SELECT unnest(range(3, 13)) AS n) WHERE n <= length(question))),
sp AS (SELECT DISTINCT question_id, lower(x) AS span FROM cs WHERE x <> '' AND x NOT IN {_in(L.STOPWORDS)}),
hs AS (SELECT span, node_id, label, name, low FROM (SELECT DISTINCT span FROM sp) JOIN nn ON contains(low, span)),
con AS (SELECT question_id, node_id, label, name, max(round(2.0::DOUBLE * length(span) / (length(span) + length(low)), 4)) AS score, 'contains' AS matched_by FROM sp JOIN hs USING (span) GROUP BY 1, 2, 3, 4),
al AS (SELECT * FROM h UNION ALL SELECT * FROM con),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, lower(name) ORDER BY score DESC, node_id, matched_by) AS i FROM al) WHERE i = 1),
f AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, length(name), node_id) AS rank FROM (SELECT *, max(score) OVER (PARTITION BY question_id) AS best FROM o) WHERE score >= {L.FLOOR} * best)"""

ORACLES = {"link_entities": f"WITH {_LINKED} SELECT question_id, node_id, score, matched_by, rank FROM f WHERE rank <= 5"}
