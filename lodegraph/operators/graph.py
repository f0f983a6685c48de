"""Typed property graphs as DataFrames of nodes and edges, and set-based operators over them.

nodes: (node_id, label, key, name, ...), edges: (src_id, rel, dst_id, ...). All operators take many start nodes at once;
every truncated list has a total order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.functions.text import clean, first_of, split_values
from lodegraph.operators.intervals import valid_at
from lodegraph.session import cut


@dataclass(frozen=True)
class EdgeSpec:
    """An edge from each row to the attribute node named in a column; with a delimiter the column holds several.

    Where names repeat, ``within`` is the column that tells equal ones apart: the attribute node is keyed by both, rows that
    lack either have no edge, and ``within_rel`` leads from the attribute node to the node of ``within_label`` it lies in."""

    column: str
    rel: str
    target_label: str
    delimiter: str | None = None
    cap: int = 4
    within: str | None = None
    within_rel: str | None = None
    within_label: str | None = None


@dataclass(frozen=True)
class SourceSpec:
    """How a table becomes nodes and edges. Columns that the table lacks count as empty; without its key column it gives
    no rows."""

    label: str
    key: str
    names: tuple[str, ...]
    names_en: tuple[str, ...] = ()
    order: str | None = None
    keep: tuple[str, ...] = ()
    text: tuple[str, ...] = ()
    edges: tuple[EdgeSpec, ...] = ()


def _have(df: DataFrame, cols: tuple[str, ...]) -> list[str]:
    return [c for c in cols if c in df.columns]


def node_id(label: str | Column, key: Column) -> Column:
    return F.concat(F.lit(label) if isinstance(label, str) else label, F.lit(":"), key)


def first_per_key(df: DataFrame, key: Column, *order: Column) -> DataFrame:
    """The first row of every key in the given order; ties are broken by the whole row's text, so the partitioning never
    decides, and rows equal in everything are one. Null keys have no row."""
    # to_json takes rows of any columns, maps included
    w = Window.partitionBy(key).orderBy(*order, F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))
    return df.filter(key.isNotNull()).withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def build_nodes(df: DataFrame, spec: SourceSpec) -> DataFrame:
    """One node per non-missing key (trimmed), from the first row in the spec's order: node_id, label, key, name,
    name_en, a linearised text and the kept properties that are not empty."""
    if spec.key not in df.columns:
        return df.sparkSession.createDataFrame([], "node_id string, label string, key string, name string, name_en string, text string, props map<string,string>")
    rows = first_per_key(df.withColumn("__key", clean(F.col(spec.key).cast("string"))), F.col("__key"), F.col(spec.order or spec.key))
    name = first_of(*(F.col(c).cast("string") for c in _have(df, spec.names))) if _have(df, spec.names) else F.lit(None).cast("string")
    name_en = first_of(*_have(df, spec.names_en)) if _have(df, spec.names_en) else F.lit(None).cast("string")
    kept = [x for c in _have(df, spec.keep) for x in (F.lit(c), clean(F.col(c).cast("string")))]
    props = F.map_filter(F.create_map(*kept), lambda _, v: v.isNotNull()) if kept else F.create_map().cast("map<string,string>")
    return rows.select(
        node_id(spec.label, F.col("__key")).alias("node_id"), F.lit(spec.label).alias("label"), F.col("__key").alias("key"), name.alias("name"), name_en.alias("name_en"), node_text(spec.label, name, *(F.col(c) for c in _have(df, spec.text))).alias("text"), props.alias("props")
    )


def node_text(label: str, name: Column, *parts: Column) -> Column:
    """A node as one line: label, name and whatever else is present."""
    return F.concat_ws(" | ", F.lit(label), name, *(clean(p.cast("string")) for p in parts))


def build_edges(df: DataFrame, spec: SourceSpec) -> DataFrame:
    """Distinct edges of all of a source's edge columns: (src_id, rel, dst_id, dst_label, value), value being the name of
    the node that an edge points to."""
    out = None
    rows = df.withColumn("__key", clean(F.col(spec.key).cast("string"))).filter("__key IS NOT NULL")
    for e in spec.edges:
        if e.column not in df.columns or (e.within and e.within not in df.columns):
            continue
        values = split_values(e.column, e.delimiter, e.cap) if e.delimiter else F.array(clean(F.col(e.column).cast("string")))
        inside = clean(F.col(e.within).cast("string")) if e.within else F.lit("")
        part = rows.select(node_id(spec.label, F.col("__key")).alias("src_id"), F.lit(e.rel).alias("rel"), F.lit(e.target_label).alias("dst_label"), F.explode(values).alias("value"), inside.alias("inside")).filter("value IS NOT NULL AND inside IS NOT NULL")
        key = F.concat_ws("|", "value", "inside") if e.within else F.col("value")
        part = part.withColumn("dst_id", node_id(F.col("dst_label"), key))
        if e.within_rel:
            up = part.select(F.col("dst_id").alias("src_id"), F.lit(e.within_rel).alias("rel"), F.lit(e.within_label).alias("dst_label"), F.col("inside").alias("value"), node_id(e.within_label, F.col("inside")).alias("dst_id"))
            part = part.drop("inside").unionByName(up)
        part = part.select("src_id", "rel", "dst_id", "dst_label", "value")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return df.sparkSession.createDataFrame([], "src_id string, rel string, dst_id string, dst_label string, value string")
    return out.distinct()


def attribute_nodes(edges: DataFrame) -> DataFrame:
    """The nodes that edges point to, created as needed; a node's key is its id without the label."""
    return edges.select(F.col("dst_id").alias("node_id"), F.col("dst_label").alias("label"), F.substr("dst_id", F.length("dst_label") + 2).alias("key"), F.col("value").alias("name")).distinct()


def upsert_nodes(old: DataFrame, new: DataFrame, key: str = "node_id", props: str | None = "props", keep: tuple[str, ...] = ()) -> DataFrame:
    """The old nodes with the new ones merged in: a new value replaces an old one unless it is null, but for the columns of
    ``keep``, where the first value stays; properties are united, the new ones winning. The new side must have one row per
    key."""
    cols = [c for c in old.columns if c not in (key, props)]
    o, n = old.alias("o"), new.alias("n")
    merged = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    out = [F.coalesce(f"n.{key}", f"o.{key}").alias(key), *((F.coalesce(f"o.{c}", f"n.{c}") if c in keep else F.coalesce(f"n.{c}", f"o.{c}")).alias(c) for c in cols)]
    if props:
        left, right = F.col(f"o.{props}"), F.col(f"n.{props}")
        rest = F.map_filter(left, lambda k, _: ~F.coalesce(F.map_contains_key(right, k), F.lit(False)))
        out.append(F.when(left.isNull(), right).when(right.isNull(), left).otherwise(F.map_concat(rest, right)).alias(props))
    return merged.select(*out)


def upsert_edges(old: DataFrame, new: DataFrame, *identity: str) -> DataFrame:
    """The old edges and those new ones whose identity none of them has; repeated new ones once."""
    ids = list(identity or ("src_id", "rel", "dst_id"))
    return old.unionByName(new.dropDuplicates(ids).join(old.select(*ids).distinct(), ids, "left_anti"))


def annotate_edges(edges: DataFrame, rel: str, valid_from: Column, valid_to: Column) -> DataFrame:
    """The edges with the validity of one relation set; others keep theirs."""
    mine = F.col("rel") == rel
    return edges.withColumns({"valid_from": F.when(mine, valid_from).otherwise(F.col("valid_from")), "valid_to": F.when(mine, valid_to).otherwise(F.col("valid_to"))})


def both_ways(edges: DataFrame, *extra: str) -> DataFrame:
    """Every edge seen from either end: (node_id, other_id, rel, outgoing). A self-loop is seen once."""
    out = edges.select(F.col("src_id").alias("node_id"), F.col("dst_id").alias("other_id"), "rel", F.lit(True).alias("outgoing"), *extra)
    back = edges.filter("src_id <> dst_id").select(F.col("dst_id").alias("node_id"), F.col("src_id").alias("other_id"), "rel", F.lit(False).alias("outgoing"), *extra)
    return out.unionByName(back)


def neighbourhood(nodes: DataFrame, edges: DataFrame, starts: DataFrame | None = None, samples: int = 5, as_of: Column | None = None, at: str | None = None) -> DataFrame:
    """Aggregated one-hop neighbourhood: per start node, relation, neighbour label and direction the number of distinct
    neighbours and the first few names and ids in order. With ``as_of``, only edges valid then (null bounds are open); NULL
    does not filter. With ``at``, a column of the starts, every start has a year of its own, which is part of the result.

    Edges meet the starts before anything is grouped. A hub's neighbours are never in one task: counts are aggregated in
    part on the map side, and every task hands on only its first few names and ids. Labels and relations are not null.
    """
    e = edges if as_of is None else edges.filter(as_of.isNull() | valid_at(F.col("valid_from"), F.col("valid_to"), as_of))
    bounds = ["valid_from", "valid_to"] if at else []
    seen = both_ways(e.select("src_id", "dst_id", "rel", *bounds), *bounds)
    if at:
        seen = seen.join(starts.select("node_id", at).distinct(), "node_id").filter(valid_at(F.col("valid_from"), F.col("valid_to"), F.col(at)))
    elif starts is not None:
        seen = seen.join(starts.select("node_id").distinct(), "node_id", "left_semi")
    others = nodes.select(F.col("node_id").alias("other_id"), F.col("label").alias("mlabel"), F.col("name").alias("mname"))
    group = ["node_id", *([at] if at else []), "rel", "mlabel", "outgoing"]
    distinct = seen.join(others, "other_id").select(*group, "other_id", F.coalesce("mname", "other_id").alias("mname")).distinct()
    counts = distinct.groupBy(*group).agg(F.count("*").alias("n"))
    # names and ids in long form share one ranking; every task cuts it to the first few before the shuffle
    kinds = F.explode(F.array(F.struct(F.lit("name").alias("kind"), F.col("mname").alias("v")), F.struct(F.lit("id").alias("kind"), F.col("other_id").alias("v")))).alias("x")
    w = Window.partitionBy(*group, "kind").orderBy("v")
    firsts = distinct.select(*group, kinds).select(*group, "x.*").distinct().withColumn("r", F.row_number().over(w)).filter(F.col("r") <= samples)
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("v"))))
    return counts.join(firsts.groupBy(*group).agg(of("name").alias("samples"), of("id").alias("sample_ids")), group)


def second_hop(nodes: DataFrame, edges: DataFrame, starts: DataFrame, through: list[str], most_members: int = 3, most_nodes: int = 4, samples: int = 5) -> DataFrame:
    """Neighbourhoods of the nodes reached through small attribute groups of the starts: groups of the given labels with
    at most ``most_members`` members; per start the first ``most_nodes`` members by id, none of them a start."""
    first = neighbourhood(nodes, edges, starts, samples).filter(F.col("mlabel").isin(through) & (F.col("n") <= most_members))
    reached = first.select(F.col("node_id").alias("start_id"), F.explode("sample_ids").alias("node_id")).distinct()
    fresh = reached.join(starts.select("node_id").distinct(), "node_id", "left_anti")
    w = Window.partitionBy("start_id").orderBy("node_id")
    picked = cut(fresh.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most_nodes).drop("r"))
    return picked.join(neighbourhood(nodes, edges, picked.select("node_id"), samples), "node_id").select("start_id", "node_id", "rel", "mlabel", "outgoing", "n")


def shortest_paths(edges: DataFrame, pairs: DataFrame, most_hops: int = 4) -> DataFrame:
    """(src_id, dst_id, hops, path) for the pairs at most ``most_hops`` undirected edges apart: of the shortest paths the
    least one, as an array of node ids. Equal ends have 0 hops; pairs with no such path have no row.

    Pairs are peeled, not sources expanded: a pair that shares no neighbour becomes the pairs of its other end with each
    neighbour of the end that has fewer. Peeled pairs are pooled, so a hub is met once for all pairs that lead to it, and
    its neighbours are listed only to find those that it shares with another node. One table of pairs per level, written.
    """
    links = cut(both_ways(edges.select("src_id", "dst_id", "rel")).select("node_id", "other_id").filter("node_id <> other_id").distinct())
    degree = cut(links.groupBy("node_id").agg(F.count("*").alias("degree")))
    wanted = cut(pairs.select("src_id", "dst_id").filter("src_id IS NOT NULL AND dst_id IS NOT NULL").distinct())
    return cut(_peeled(wanted, links, degree, most_hops)).select("src_id", "dst_id", (F.size("path") - 1).alias("hops"), "path")


def _peeled(wanted: DataFrame, links: DataFrame, degree: DataFrame, most: int) -> DataFrame:
    """(src_id, dst_id, path) of the least shortest path of at most ``most`` edges."""
    same = wanted.filter("src_id = dst_id").select("src_id", "dst_id", F.array("src_id").alias("path"))
    if most < 1:
        return same
    apart = wanted.filter("src_id <> dst_id")
    edge = apart.join(links.select(F.col("node_id").alias("src_id"), F.col("other_id").alias("dst_id")), ["src_id", "dst_id"], "left_semi")
    found = same.unionByName(edge.select("src_id", "dst_id", F.array("src_id", "dst_id").alias("path")))
    if most < 2:
        return found
    # the end with fewer neighbours is looked at
    of = lambda end: degree.select(F.col("node_id").alias(end), F.col("degree").alias(f"{end}_degree"))
    open_ = apart.join(edge, ["src_id", "dst_id"], "left_anti").join(of("src_id"), "src_id").join(of("dst_id"), "dst_id")
    from_src = F.col("src_id_degree") <= F.col("dst_id_degree")
    open_ = cut(open_.select("src_id", "dst_id", F.when(from_src, F.col("src_id")).otherwise(F.col("dst_id")).alias("near"), F.when(from_src, F.col("dst_id")).otherwise(F.col("src_id")).alias("far")))
    steps = open_.select("near", "far").distinct().join(links.withColumnRenamed("node_id", "near"), "near")
    middle = steps.join(links.select(F.col("node_id").alias("other_id"), F.col("other_id").alias("far")), ["other_id", "far"], "left_semi").groupBy("near", "far").agg(F.min("other_id").alias("mid"))
    looked = cut(open_.join(middle, ["near", "far"], "left"))
    found = found.unionByName(looked.filter("mid IS NOT NULL").select("src_id", "dst_id", F.array("src_id", "mid", "dst_id").alias("path")))
    rest = looked.filter("mid IS NULL")
    if most < 3 or rest.isEmpty():
        return found
    peeled = rest.join(links.withColumnRenamed("node_id", "near"), "near")
    forward = F.col("near") == F.col("src_id")
    inner_src, inner_dst = F.when(forward, F.col("other_id")).otherwise(F.col("src_id")), F.when(forward, F.col("dst_id")).otherwise(F.col("other_id"))
    peeled = cut(peeled.select("src_id", "dst_id", forward.alias("forward"), inner_src.alias("a"), inner_dst.alias("b")))
    inner = _peeled(peeled.select(F.col("a").alias("src_id"), F.col("b").alias("dst_id")).distinct(), links, degree, most - 1)
    whole = peeled.join(inner.select(F.col("src_id").alias("a"), F.col("dst_id").alias("b"), "path"), ["a", "b"])
    whole = whole.select("src_id", "dst_id", F.when(F.col("forward"), F.concat(F.array("src_id"), "path")).otherwise(F.concat("path", F.array("dst_id"))).alias("path"))
    least = whole.groupBy("src_id", "dst_id").agg(F.min(F.struct(F.size("path").alias("n"), "path"))["path"].alias("path"))
    return found.unionByName(least)


def path_details(paths: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Paths (src_id, dst_id, hops, path) with names, labels and rels as arrays and as one line, a -[rel]-> b: of several
    edges between two nodes the least relation, in either direction. A node without a name is called by its label."""
    step = paths.select("src_id", "dst_id", F.posexplode("path").alias("i", "node_id"), "path")
    step = step.withColumn("next_id", F.when(F.col("i") + 1 < F.size("path"), F.element_at("path", F.col("i") + 2)))
    rel = both_ways(edges.select("src_id", "dst_id", "rel")).groupBy(F.col("node_id"), F.col("other_id").alias("next_id")).agg(F.min("rel").alias("rel"))
    named = nodes.groupBy("node_id").agg(F.min("label").alias("label"), F.min("name").alias("name"))
    full = step.join(named, "node_id", "left").join(rel, ["node_id", "next_id"], "left")
    row = F.array_sort(F.collect_list(F.struct("i", F.coalesce("name", "label", "node_id").alias("name"), F.coalesce("label", F.lit("")).alias("label"), "rel")))
    g = full.groupBy("src_id", "dst_id").agg(row.alias("r"))
    of = lambda c: F.transform("r", lambda x: x[c])
    names, labels, rels = of("name"), of("label"), of("rel")
    line = F.array_join(F.transform("r", lambda x: F.concat(x["name"], F.coalesce(F.concat(F.lit(" -["), x["rel"], F.lit("]-> ")), F.lit("")))), "")
    return paths.join(g.select("src_id", "dst_id", names.alias("names"), labels.alias("labels"), F.filter(rels, lambda x: x.isNotNull()).alias("rels"), line.alias("line")), ["src_id", "dst_id"])


def subgraph(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Distinct edges on any trail of one or two undirected hops from the starts."""
    ids = starts.select("node_id").distinct()
    tagged = both_ways(edges.select("src_id", "dst_id", "rel"))
    first = tagged.join(ids, "node_id", "left_semi")
    hop1 = first.select(*_directed())
    reached = first.select(F.col("other_id").alias("node_id")).distinct()
    hop2 = tagged.join(reached, "node_id", "left_semi").select(*_directed())
    return hop1.unionByName(hop2).distinct()


def _directed() -> list[Column]:
    out = F.col("outgoing")
    return [F.when(out, F.col("node_id")).otherwise(F.col("other_id")).alias("src_id"), F.col("rel"), F.when(out, F.col("other_id")).otherwise(F.col("node_id")).alias("dst_id")]


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges.select("src_id", "dst_id", "rel")).groupBy("node_id").agg(F.count("*").alias("degree"))


def search(nodes: DataFrame, edges: DataFrame, needle: str, label: str | None = None, limit: int = 20) -> DataFrame:
    """Nodes whose name or key holds the needle (case ignored), the best connected first; a top-k, ties by node_id.
    Missing arguments do not filter."""
    found = nodes
    if needle:
        low = needle.lower()
        found = found.filter(F.lower("name").contains(low) | F.lower("key").contains(low))
    if label:
        found = found.filter(F.col("label") == label)
    mine = both_ways(edges.select("src_id", "dst_id", "rel")).join(found.select("node_id"), "node_id", "left_semi").groupBy("node_id").agg(F.count("*").alias("degree"))
    return found.join(mine, "node_id", "left").select("node_id", "label", "name", F.coalesce("degree", F.lit(0)).alias("degree")).orderBy(F.desc("degree"), "node_id").limit(limit)


def key_violations(df: DataFrame, *key: str) -> DataFrame:
    """The keys that more than one row has, with their number: what a uniqueness constraint would refuse. Null keys are
    none."""
    held = df
    for k in key:
        held = held.filter(F.col(k).isNotNull())
    return held.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def census(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def functional_edges(df: DataFrame, left: str, right: str) -> DataFrame:
    """(left, right) where the left value has exactly one distinct right value."""
    return df.filter(F.col(left).isNotNull() & F.col(right).isNotNull()).groupBy(left).agg(F.min(right).alias(right), F.max(right).alias("__max")).filter(F.col(right) == F.col("__max")).drop("__max")


def cap_facts(lines: DataFrame, group: str, most: int, *order: str) -> DataFrame:
    """The first ``most`` lines of every group in order."""
    w = Window.partitionBy(group).orderBy(*order)
    return lines.withColumn("line_no", F.row_number().over(w)).filter(F.col("line_no") <= most)


def stratified_sample(df: DataFrame, stratum: str, key: str, total: int, least: int = 1, seed: str = "42") -> DataFrame:
    """About ``total`` rows, each stratum in proportion to its size and with at least ``least`` rows, then cut to
    ``total``: a sampling operator. Rows are ordered by the MD5 of their key and the seed, so every run and engine picks
    the same ones."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("__n"))
    n_all = sizes.agg(F.sum("__n").alias("__all"))
    share = F.bround(F.lit(float(total)) * F.col("__n") / F.col("__all")).cast("int")
    quota = sizes.join(F.broadcast(n_all), F.lit(True)).select(stratum, F.greatest(F.lit(least), share).alias("__quota"))
    hashed = df.withColumn("__h", F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)))).join(quota, stratum)
    # first within salted parts of a stratum, then among what is left of them: no task ranks a whole large stratum
    part = Window.partitionBy(stratum, F.substring("__h", 1, 2)).orderBy("__h", key)
    few = hashed.withColumn("__r", F.row_number().over(part)).filter("__r <= __quota")
    whole = Window.partitionBy(stratum).orderBy("__h", key)
    picked = few.withColumn("__r", F.row_number().over(whole)).filter("__r <= __quota")
    return picked.orderBy("__h", key).limit(total).drop("__h", "__r", "__quota")


def trailing_sum(df: DataFrame, row_id: str, key: str, ts: str, value: str, seconds: int, bucket: int = 600) -> DataFrame:
    """(row_id, total, n): per row the sum and number of the key's rows in the ``seconds`` up to it, ties included.

    Time is cut into buckets and rows are repeated in the next bucket while they still count there, so a task orders one
    key's bucket, not all of a key's rows. Null keys, times and values: rows without a key or time have no row; null
    values count as nothing in the sum.
    """
    if bucket < seconds:
        raise ValueError("a bucket must be at least as long as the span")
    at = F.col(ts).cast("timestamp").cast("decimal(20,6)").cast("double")
    rows = df.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(row_id).alias("row_id"), F.col(key).alias("key"), at.alias("at"), F.col(value).alias("value"))
    own = F.floor(F.col("at") / bucket)
    both = rows.withColumn("own", own).withColumn("b", F.explode(F.array_distinct(F.array(own, F.floor((F.col("at") + seconds) / bucket)))))
    w = Window.partitionBy("key", "b").orderBy("at").rangeBetween(-seconds, 0)
    return both.withColumn("total", F.sum("value").over(w)).withColumn("n", F.count("*").over(w)).filter("b = own").select("row_id", "total", "n")
