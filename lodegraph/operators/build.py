"""Curated tables as graph: rulings, the timeline of regulations, certifications; nodes and timed edges for upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.functions.dates import be_year
from lodegraph.functions.text import clean, code_key
from lodegraph.operators.graph import first_per_key, functional_edges, node_id
from lodegraph.operators.intervals import buddhist_year
from lodegraph.operators.rulings import SEVERITY

NODE_COLUMNS = ("node_id", "label", "key", "name", "name_en", "text")
EDGE_COLUMNS = ("src_id", "rel", "dst_id", "valid_from", "valid_to", "via_source", "note")


def period_text(valid_from: Column, valid_to: Column) -> Column:
    """A validity as text: from a year to a year, or to the present; a missing start is left out."""
    start = F.concat(F.lit("from "), valid_from.cast("string"))
    end = F.coalesce(F.concat(F.lit("to "), valid_to.cast("string")), F.lit("to the present"))
    return F.concat_ws(" ", start, end)


def _nodes(df: DataFrame, label: str, key: Column, name: Column, name_en: Column, text: Column) -> DataFrame:
    return df.select(node_id(label, key).alias("node_id"), F.lit(label).alias("label"), key.alias("key"), name.alias("name"), name_en.alias("name_en"), text.alias("text"))


def _edges(df: DataFrame, src: Column, rel: str, dst: Column, valid_from: Column | None = None, valid_to: Column | None = None, via: Column | None = None, note: Column | None = None) -> DataFrame:
    year, text = F.lit(None).cast("int"), F.lit(None).cast("string")
    of = lambda c, none: none if c is None else c
    return df.select(src.alias("src_id"), F.lit(rel).alias("rel"), dst.alias("dst_id"), of(valid_from, year).alias("valid_from"), of(valid_to, year).alias("valid_to"), of(via, text).alias("via_source"), of(note, text).alias("note"))


def _first(column: str, order: str = "row_id") -> Column:
    """A group's first value that is not missing, in row order."""
    return F.min_by(column, F.when(F.col(column).isNotNull(), F.col(order)))


def rulings_graph(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of ingredients, sources and rulings; edges DERIVED_FROM (ingredient to source), HAS_RULING (ingredient to
    ruling, one per source that it is given by) and TYPICAL_RULING (source to ruling, where all its rulings agree).

    Rows without ingredient, source or a known ruling make no edge. Of repeated rows the first values that are not missing
    name a node; of repeated HAS_RULING edges of one source the last row's basis and note stay."""
    r = df.select(
        "row_id", clean("ingredient_th").alias("ingredient"), clean("ingredient_en").alias("ingredient_en"), clean("e_number").alias("e_number"), clean("source_th").alias("source"), clean("source_en").alias("source_en"),
        clean("source_type").alias("source_type"), F.lower(clean("ruling")).alias("ruling"), F.concat_ws(" | ", clean("basis_th"), clean("note_th")).alias("note"),
    ).filter(F.col("ruling").isin(*SEVERITY) & F.col("ingredient").isNotNull() & F.col("source").isNotNull())
    i = r.groupBy("ingredient").agg(_first("ingredient_en").alias("en"), _first("e_number").alias("e"))
    # the code stands in the text only where there is one
    i_text = F.concat(F.lit("ingredient: "), F.col("ingredient"), F.coalesce(F.concat(F.lit(" ("), F.col("en"), F.lit(")")), F.lit("")), F.coalesce(F.concat(F.lit(" code "), F.col("e")), F.lit("")))
    s = r.groupBy("source").agg(_first("source_en").alias("en"), _first("source_type").alias("type"))
    s_text = F.concat(F.lit("source: "), F.col("source"), F.coalesce(F.concat(F.lit(" (kind "), F.col("type"), F.lit(")")), F.lit("")))
    none = F.lit(None).cast("string")
    v = r.select("ruling").distinct()
    nodes = (
        _nodes(i, "Ingredient", F.col("ingredient"), F.col("ingredient"), F.col("en"), i_text)
        .unionByName(_nodes(s, "Source", F.col("source"), F.col("source"), F.col("en"), s_text))
        .unionByName(_nodes(v, "Ruling", F.col("ruling"), F.col("ruling"), none, F.concat(F.lit("ruling: "), F.col("ruling"))))
    )
    ing, src, rul = node_id("Ingredient", F.col("ingredient")), node_id("Source", F.col("source")), node_id("Ruling", F.col("ruling"))
    last = r.groupBy("ingredient", "source", "ruling").agg(F.max_by("note", "row_id").alias("note"))
    edges = (
        _edges(r.select("ingredient", "source").distinct(), ing, "DERIVED_FROM", src)
        .unionByName(_edges(last, ing, "HAS_RULING", rul, via=F.col("source"), note=F.col("note")))
        .unionByName(_edges(functional_edges(r, "source", "ruling"), src, "TYPICAL_RULING", rul))
    )
    return nodes, edges


# Fixed value: the kind of a row that is a body and no regulation.
ORGANISATION = "organisation"


def timeline_graph(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of regulations and bodies; edges ISSUED_BY and SUPERSEDES that carry the regulation's validity.

    Withdrawn rows are left out; of repeated rows of one key the last stays. A body that is only named as an issuer becomes
    a node; one that has a row of its own keeps that row's text. References are equal when their letters and digits are;
    those that lead nowhere, and to the regulation itself, make no edge."""
    rows = df.filter("deleted_at IS NULL").select(
        "row_id", code_key("reg_id").alias("k"), clean("name_th").alias("name"), clean("name_en").alias("name_en"), F.lower(clean("kind")).alias("kind"), buddhist_year("valid_from").alias("vf"), buddhist_year("valid_to").alias("vt"),
        clean("issuer_th").alias("issuer"), code_key("supersedes").alias("old"), clean("topic_th").alias("topic"),
    )
    is_body = F.coalesce(F.col("kind"), F.lit("")) == ORGANISATION
    regs, bodies = first_per_key(rows.filter(~is_body), F.col("k"), F.desc("row_id")), first_per_key(rows.filter(is_body), F.col("name"), F.desc("row_id"))
    reg_text = F.concat_ws(" | ", "name", period_text(F.col("vf"), F.col("vt")), "topic")
    own = _nodes(bodies, "Organisation", F.col("name"), F.col("name"), F.col("name_en"), F.concat_ws(" | ", "name", F.concat(F.lit("since "), F.col("vf").cast("string")), "topic"))
    issued = regs.filter("issuer IS NOT NULL")
    named = issued.select("issuer").distinct().join(own.select(F.col("key").alias("issuer")), "issuer", "left_anti")
    made = _nodes(named, "Organisation", F.col("issuer"), F.col("issuer"), F.lit(None).cast("string"), F.concat(F.lit("body: "), F.col("issuer")))
    nodes = _nodes(regs, "Regulation", F.col("k"), F.col("name"), F.col("name_en"), reg_text).unionByName(own).unionByName(made)
    reg = node_id("Regulation", F.col("k"))
    known = regs.select(F.col("k").alias("old"))
    replaced = regs.filter("old IS NOT NULL AND old <> k").join(known, "old", "left_semi")
    edges = _edges(issued, reg, "ISSUED_BY", node_id("Organisation", F.col("issuer")), F.col("vf"), F.col("vt")).unionByName(_edges(replaced, reg, "SUPERSEDES", node_id("Regulation", F.col("old")), F.col("vf")))
    return nodes, edges


def certification_graph(products: DataFrame, register: DataFrame, certifier: str) -> tuple[DataFrame, DataFrame]:
    """The certifying body as a node, and an edge CERTIFIED_HALAL to it from every registered product code with a readable
    expiry, valid until then; of repeated codes the first row counts."""
    p = products.select(code_key("halal_code").alias("k"), be_year(F.col("expire_date")).alias("vt"), clean("expire_date").alias("stated"), "row_id")
    first = first_per_key(p, F.col("k"), F.col("row_id")).join(register.select(code_key("halal_code").alias("k")), "k", "left_semi").filter("vt IS NOT NULL")
    edges = _edges(first, node_id("Product", F.col("k")), "CERTIFIED_HALAL", F.lit(f"Certifier:{certifier}"), valid_to=F.col("vt"), note=F.col("stated"))
    one = products.sparkSession.range(1)
    name = F.lit(certifier)
    return _nodes(one, "Certifier", name, name, F.lit(None).cast("string"), F.concat(F.lit("certifying body: "), name)), edges


def containment_edges(links: DataFrame) -> DataFrame:
    """CONTAINS edges (product row to ingredient, with the term found as a note) of product links (row_id, ingredient, term)."""
    return _edges(links, node_id("Product", F.col("row_id").cast("string")), "CONTAINS", node_id("Ingredient", F.col("ingredient")), note=F.col("term"))


def timed_coverage(edges: DataFrame) -> DataFrame:
    """(rel, total, timed) of the relations that have a timed edge."""
    timed = F.col("valid_from").isNotNull() | F.col("valid_to").isNotNull()
    return edges.groupBy("rel").agg(F.count("*").alias("total"), F.sum(timed.cast("long")).alias("timed")).filter("timed > 0")
