"""Queries over the graphs built from rulings, regulations and certifications, and over single operators of the build."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions.text import clean
from lodegraph.operators import build as B
from lodegraph.operators import graph as G
from lodegraph.plans.domain_queries import _BE, _CL, _CODE, _YEAR
from lodegraph.session import table

# The certifying body of the synthetic register.
CERTIFIER = "Central Council"


def _rulings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return B.rulings_graph(table(spark, d, "ingredient_rulings"))


def _timeline(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return B.timeline_graph(table(spark, d, "regulation_timeline"))


def rulings_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _rulings(spark, d)[0].select("node_id", "name_en", "text")


def rulings_edges(spark: SparkSession, d: str) -> DataFrame:
    return _rulings(spark, d)[1].select("src_id", "rel", "dst_id", "via_source", "note")


def timeline_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _timeline(spark, d)[0].select("node_id", "name", "text")


def timeline_edges(spark: SparkSession, d: str) -> DataFrame:
    return _timeline(spark, d)[1].select("src_id", "rel", "dst_id", "valid_from", "valid_to")


def certifier_edges(spark: SparkSession, d: str) -> DataFrame:
    edges = B.certification_graph(table(spark, d, "product_processed"), table(spark, d, "certified_halal"), CERTIFIER)[1]
    return edges.select("src_id", "rel", "dst_id", "valid_to", F.col("note").alias("stated"))


def timed_relations(spark: SparkSession, d: str) -> DataFrame:
    """Per relation of all curated graphs its edges and how many are timed."""
    certified = B.certification_graph(table(spark, d, "product_processed"), table(spark, d, "certified_halal"), CERTIFIER)[1]
    return B.timed_coverage(_rulings(spark, d)[1].unionByName(_timeline(spark, d)[1]).unionByName(certified))


def edges_by_property(spark: SparkSession, d: str) -> DataFrame:
    """HAS_RULING edges upserted by source, ingredient, ruling and the source that gives it: how many a ruling has."""
    e = _rulings(spark, d)[1].filter("rel = 'HAS_RULING'").select("src_id", "rel", "dst_id", "via_source")
    half = F.ascii("via_source") % 2 == 0
    merged = G.upsert_edges(e.filter(half), e, "src_id", "rel", "dst_id", "via_source")
    return merged.groupBy("dst_id").agg(F.count("*").alias("n"))


def upsert_keep_first(spark: SparkSession, d: str) -> DataFrame:
    """Place nodes of two halves of the loads merged: names replaced by later ones, the first text and all properties kept."""
    p = table(spark, d, "places").select(clean("key").alias("node_id"), clean("name").alias("name"), clean("addr_full").alias("text"), "props", "loaded_at", "row_id").filter("node_id IS NOT NULL")
    early, late = p.filter("loaded_at < '2024-07-01'"), p.filter("loaded_at >= '2024-07-01'")
    first = lambda df: G.first_per_key(df, F.col("node_id"), F.col("row_id")).select("node_id", "name", "text", "props")
    merged = G.upsert_nodes(first(early), first(late), keep=("text",))
    return merged.select("node_id", "name", "text", F.array_join(F.array_sort(F.transform(F.map_entries("props"), lambda x: F.concat_ws("=", x["key"], x["value"]))), ";").alias("props"))


def expired_by_seed(spark: SparkSession, d: str) -> DataFrame:
    """Per product code the certification that had run out by 2567."""
    e = B.certification_graph(table(spark, d, "product_processed"), table(spark, d, "certified_halal"), CERTIFIER)[1]
    return e.filter("valid_to < 2567").select(F.col("src_id").alias("node_id"), F.col("dst_id").alias("certifier_id"), "valid_to")


def regulations_and_bodies(spark: SparkSession, d: str) -> DataFrame:
    """The timeline's rows split by kind into regulations and bodies."""
    r = table(spark, d, "regulation_timeline").select(F.coalesce(F.lower(clean("kind")), F.lit("")).alias("kind"))
    regs, bodies = r.filter(F.col("kind") != B.ORGANISATION), r.filter(F.col("kind") == B.ORGANISATION)
    return regs.agg(F.lit("regulation").alias("part"), F.count("*").alias("n")).unionByName(bodies.agg(F.lit("organisation").alias("part"), F.count("*").alias("n")))


def period_texts(spark: SparkSession, d: str) -> DataFrame:
    """The validity of every regulation in words: bounded, or to the present."""
    from lodegraph.operators.intervals import buddhist_year

    return table(spark, d, "regulation_timeline").select("row_id", B.period_text(buddhist_year("valid_from"), buddhist_year("valid_to")).alias("period"))


def prohibited_sources(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of source by ruling: the table that the rule 'a prohibited animal is never allowed' is read from."""
    r = table(spark, d, "ingredient_rulings").select(clean("source_type").alias("source_type"), F.lower(clean("ruling")).alias("ruling"))
    return r.filter("source_type IS NOT NULL AND ruling IS NOT NULL").groupBy("source_type", "ruling").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (rulings_nodes, rulings_edges, timeline_nodes, timeline_edges, certifier_edges, timed_relations, edges_by_property, upsert_keep_first, expired_by_seed, regulations_and_bodies, period_texts, prohibited_sources)
}

_R = f"""r AS (SELECT * FROM (SELECT row_id, {_CL.format('ingredient_th')} AS ingredient, {_CL.format('ingredient_en')} AS ien, {_CL.format('e_number')} AS e, {_CL.format('source_th')} AS source, {_CL.format('source_en')} AS sen, {_CL.format('source_type')} AS stype,
 lower({_CL.format('ruling')}) AS ruling, concat_ws(' | ', {_CL.format('basis_th')}, {_CL.format('note_th')}) AS note FROM ingredient_rulings) WHERE ruling IN ('haram', 'mashbooh', 'halal') AND ingredient IS NOT NULL AND source IS NOT NULL)"""
_RE = f"""{_R}, re AS (SELECT DISTINCT 'Ingredient:' || ingredient AS src_id, 'DERIVED_FROM' AS rel, 'Source:' || source AS dst_id, NULL AS via_source, NULL AS note FROM r
 UNION ALL SELECT 'Ingredient:' || ingredient, 'HAS_RULING', 'Ruling:' || ruling, source, max_by(note, row_id) FROM r GROUP BY ingredient, ruling, source
 UNION ALL SELECT 'Source:' || source, 'TYPICAL_RULING', 'Ruling:' || min(ruling), NULL, NULL FROM r GROUP BY source HAVING count(DISTINCT ruling) = 1)"""
_T = f"""t AS (SELECT row_id, {_CODE.format('reg_id')} AS k, {_CL.format('name_th')} AS name, coalesce(lower({_CL.format('kind')}), '') AS kind, {_YEAR.format('valid_from')} AS vf, {_YEAR.format('valid_to')} AS vt, {_CL.format('issuer_th')} AS issuer, {_CODE.format('supersedes')} AS old, {_CL.format('topic_th')} AS topic
 FROM regulation_timeline WHERE deleted_at IS NULL),
 rg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY row_id DESC) AS rn FROM t WHERE kind <> 'organisation' AND k IS NOT NULL) WHERE rn = 1),
 og AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY row_id DESC) AS rn FROM t WHERE kind = 'organisation' AND name IS NOT NULL) WHERE rn = 1)"""
_PERIOD = "concat_ws(' ', 'from ' || vf, coalesce('to ' || vt, 'to the present'))"
_TE = f"""{_T}, te AS (SELECT 'Regulation:' || k AS src_id, 'ISSUED_BY' AS rel, 'Organisation:' || issuer AS dst_id, vf AS valid_from, vt AS valid_to FROM rg WHERE issuer IS NOT NULL
 UNION ALL SELECT 'Regulation:' || k, 'SUPERSEDES', 'Regulation:' || old, vf, NULL FROM rg WHERE old <> k AND old IN (SELECT k FROM rg))"""
_C = f"""ce AS (SELECT * FROM (SELECT {_CODE.format('halal_code')} AS k, {_BE.format('expire_date')} AS vt, {_CL.format('expire_date')} AS stated, row_number() OVER (PARTITION BY {_CODE.format('halal_code')} ORDER BY row_id) AS rn FROM product_processed)
 WHERE rn = 1 AND k IS NOT NULL AND vt IS NOT NULL AND k IN (SELECT {_CODE.format('halal_code')} FROM certified_halal))"""
_PL = f"p AS (SELECT {_CL.format('key')} AS node_id, {_CL.format('name')} AS name, {_CL.format('addr_full')} AS text, props, loaded_at < '2024-07-01' AS early, row_id FROM places)"

ORACLES = {
    "rulings_nodes": f"""WITH {_R} SELECT 'Ingredient:' || ingredient AS node_id, min_by(ien, row_id) FILTER (ien IS NOT NULL) AS name_en,
  'ingredient: ' || ingredient || coalesce(' (' || min_by(ien, row_id) FILTER (ien IS NOT NULL) || ')', '') || coalesce(' code ' || min_by(e, row_id) FILTER (e IS NOT NULL), '') AS text FROM r GROUP BY ingredient
 UNION ALL SELECT 'Source:' || source, min_by(sen, row_id) FILTER (sen IS NOT NULL), 'source: ' || source || coalesce(' (kind ' || min_by(stype, row_id) FILTER (stype IS NOT NULL) || ')', '') FROM r GROUP BY source
 UNION ALL SELECT DISTINCT 'Ruling:' || ruling, NULL, 'ruling: ' || ruling FROM r""",
    "rulings_edges": f"WITH {_RE} SELECT * FROM re",
    "timeline_nodes": f"""WITH {_T} SELECT 'Regulation:' || k AS node_id, name, concat_ws(' | ', name, {_PERIOD}, topic) AS text FROM rg
 UNION ALL SELECT 'Organisation:' || name, name, concat_ws(' | ', name, 'since ' || vf, topic) FROM og UNION ALL SELECT DISTINCT 'Organisation:' || issuer, issuer, 'body: ' || issuer FROM rg WHERE issuer IS NOT NULL AND issuer NOT IN (SELECT name FROM og)""",
    "timeline_edges": f"WITH {_TE} SELECT * FROM te",
    "certifier_edges": f"WITH {_C} SELECT 'Product:' || k AS src_id, 'CERTIFIED_HALAL' AS rel, 'Certifier:{CERTIFIER}' AS dst_id, vt AS valid_to, stated FROM ce",
    "timed_relations": f"""WITH {_TE}, {_C} SELECT rel, count(*) AS total, count(*) FILTER (valid_from IS NOT NULL OR valid_to IS NOT NULL) AS timed FROM te GROUP BY 1 HAVING count(*) FILTER (valid_from IS NOT NULL OR valid_to IS NOT NULL) > 0
 UNION ALL SELECT 'CERTIFIED_HALAL', count(*), count(*) FROM ce HAVING count(*) > 0""",
    "edges_by_property": f"WITH {_RE} SELECT dst_id, count(*) AS n FROM re WHERE rel = 'HAS_RULING' GROUP BY 1",
    "upsert_keep_first": f"""WITH {_PL}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id, early ORDER BY row_id) AS rn FROM p WHERE node_id IS NOT NULL) WHERE rn = 1), o AS (SELECT * FROM f WHERE early), n AS (SELECT * FROM f WHERE NOT early),
 m AS (SELECT coalesce(n.node_id, o.node_id) AS node_id, coalesce(n.name, o.name) AS name, coalesce(o.text, n.text) AS text, o.props AS op, n.props AS np FROM o FULL JOIN n ON o.node_id = n.node_id),
 kv AS (SELECT node_id, unnest(map_entries(np)) AS x FROM m UNION ALL SELECT node_id, x FROM (SELECT node_id, np, unnest(map_entries(op)) AS x FROM m) WHERE np IS NULL OR NOT list_contains(map_keys(np), x.key)),
 g AS (SELECT node_id, string_agg(s, ';' ORDER BY s) AS props FROM (SELECT node_id, concat_ws('=', x.key, x.value) AS s FROM kv) GROUP BY 1)
 SELECT node_id, name, text, CASE WHEN op IS NULL AND np IS NULL THEN NULL ELSE coalesce(g.props, '') END AS props FROM m LEFT JOIN g USING (node_id)""",
    "expired_by_seed": f"WITH {_C} SELECT 'Product:' || k AS node_id, 'Certifier:{CERTIFIER}' AS certifier_id, vt AS valid_to FROM ce WHERE vt < 2567",
    "regulations_and_bodies": " UNION ALL ".join(f"SELECT '{part}' AS part, count(*) AS n FROM regulation_timeline WHERE coalesce(lower({_CL.format('kind')}), '') {op} 'organisation'" for part, op in (("regulation", "<>"), ("organisation", "="))),
    "period_texts": f"SELECT row_id, {_PERIOD} AS period FROM (SELECT row_id, {_YEAR.format('valid_from')} AS vf, {_YEAR.format('valid_to')} AS vt FROM regulation_timeline)",
    "prohibited_sources": f"SELECT {_CL.format('source_type')} AS source_type, lower({_CL.format('ruling')}) AS ruling, count(*) AS n FROM ingredient_rulings WHERE {_CL.format('source_type')} IS NOT NULL AND {_CL.format('ruling')} IS NOT NULL GROUP BY 1, 2",
}
