"""Graph queries: the trade tables as a graph of regions, nations, customers and suppliers; the places as one of
provinces and districts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions.text import clean, code_key
from lodegraph.operators import graph as G
from lodegraph.session import table

# Names of the relations and labels of the trade graph.
_NODES = (("region", "Region", "r_regionkey", "r_name"), ("nation", "Nation", "n_nationkey", "n_name"), ("customer", "Customer", "c_custkey", "c_name"), ("supplier", "Supplier", "s_suppkey", "s_name"))
_EDGES = (("nation", "Nation", "n_nationkey", "IN_REGION", "Region", "n_regionkey"), ("customer", "Customer", "c_custkey", "IN_NATION", "Nation", "c_nationkey"), ("supplier", "Supplier", "s_suppkey", "IN_NATION", "Nation", "s_nationkey"))


def trade_nodes(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for t, label, key, name in _NODES:
        part = table(spark, d, t).select(F.concat(F.lit(label + ":"), F.col(key).cast("string")).alias("node_id"), F.lit(label).alias("label"), F.col(key).cast("string").alias("key"), F.col(name).alias("name"))
        out = part if out is None else out.unionByName(part)
    return out


def trade_edges(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for t, label, key, rel, target, ref in _EDGES:
        part = table(spark, d, t).select(F.concat(F.lit(label + ":"), F.col(key).cast("string")).alias("src_id"), F.lit(rel).alias("rel"), F.concat(F.lit(target + ":"), F.col(ref).cast("string")).alias("dst_id"))
        out = part if out is None else out.unionByName(part)
    return out


NODES_SQL = "nodes AS (" + " UNION ALL ".join(f"SELECT '{lab}:' || {k} AS node_id, '{lab}' AS label, {k}::VARCHAR AS key, {n} AS name FROM {t}" for t, lab, k, n in _NODES) + ")"
EDGES_SQL = "edges AS (" + " UNION ALL ".join(f"SELECT '{lab}:' || {k} AS src_id, '{r}' AS rel, '{tl}:' || {f} AS dst_id FROM {t}" for t, lab, k, r, tl, f in _EDGES) + ")"
BOTH_SQL = "seen AS (SELECT src_id AS node_id, dst_id AS other_id, rel, true AS outgoing FROM edges UNION ALL SELECT dst_id, src_id, rel, false FROM edges WHERE src_id <> dst_id)"
GRAPH_SQL = f"{NODES_SQL}, {EDGES_SQL}, {BOTH_SQL}"


def _joined(df: DataFrame, *cols: str) -> DataFrame:
    """Arrays as text, for comparison with other engines."""
    return df.withColumns({c: F.array_join(c, ",") for c in cols})


def node_census(spark: SparkSession, d: str) -> DataFrame:
    return G.census(trade_nodes(spark, d), "label")


def edge_census(spark: SparkSession, d: str) -> DataFrame:
    return G.census(trade_edges(spark, d), "rel")


def neighbourhood_summary(spark: SparkSession, d: str) -> DataFrame:
    starts = trade_nodes(spark, d).filter(F.col("label").isin("Region", "Nation"))
    return _joined(G.neighbourhood(trade_nodes(spark, d), trade_edges(spark, d), starts), "samples", "sample_ids")


_NEIGHBOURHOOD_SQL = """n1 AS (SELECT DISTINCT s.node_id, s.rel, o.label AS mlabel, s.outgoing, s.other_id, o.name AS mname FROM seen s JOIN nodes o ON s.other_id = o.node_id{where}),
summary AS (SELECT node_id, rel, mlabel, outgoing, count(*) AS n, array_to_string(list_slice(list_sort(list(DISTINCT mname)), 1, 5), ',') AS samples, array_to_string(list_slice(list_sort(list(DISTINCT other_id)), 1, 5), ',') AS sample_ids
 FROM n1 GROUP BY 1, 2, 3, 4)"""


def _order_edges(spark: SparkSession, d: str) -> DataFrame:
    """Customer to order status, valid from the order's year; open orders have no end."""
    o = table(spark, d, "orders")
    y = F.year("o_orderdate")
    return o.select(
        F.concat(F.lit("Customer:"), F.col("o_custkey")).alias("src_id"), F.lit("ORDERED").alias("rel"), F.concat(F.lit("Priority:"), F.col("o_orderpriority")).alias("dst_id"),
        y.alias("valid_from"), F.when(F.col("o_orderstatus") != "O", y + 1).alias("valid_to"),
    )


def neighbourhood_asof(spark: SparkSession, d: str) -> DataFrame:
    edges = _order_edges(spark, d)
    priorities = edges.select(F.col("dst_id").alias("node_id")).distinct().select("node_id", F.lit("Priority").alias("label"), F.substring("node_id", 10, 99).alias("name"))
    customers = trade_nodes(spark, d).filter("label = 'Customer'").select("node_id", "label", "name")
    return _joined(G.neighbourhood(customers.unionByName(priorities), edges, priorities, as_of=F.lit(1996)), "samples", "sample_ids")


def hop2_expand(spark: SparkSession, d: str) -> DataFrame:
    """The second hop of every supplier."""
    starts = trade_nodes(spark, d).filter("label = 'Supplier'")
    return G.second_hop(trade_nodes(spark, d), trade_edges(spark, d), starts, ["Nation", "Region"])


def shortest_path(spark: SparkSession, d: str) -> DataFrame:
    s = trade_nodes(spark, d).filter("label = 'Supplier'").select(F.col("node_id").alias("src_id"), F.col("key").cast("long").alias("k"))
    n = trade_nodes(spark, d).filter("label = 'Nation'").select(F.col("node_id").alias("dst_id"), F.col("key").cast("long").alias("m"))
    pairs = s.join(n, F.pmod(F.col("k"), F.lit(25)) == F.col("m")).select("src_id", "dst_id")
    up = trade_edges(spark, d).filter("src_id NOT LIKE 'Customer%'")
    return _joined(G.shortest_paths(up, pairs, 4), "path")


def path_lines(spark: SparkSession, d: str) -> DataFrame:
    """Names, labels and relations along the least paths between suppliers and the nations of other regions."""
    found = shortest_path(spark, d).withColumn("path", F.split("path", ","))
    return G.path_details(found, trade_nodes(spark, d), trade_edges(spark, d)).select("src_id", "dst_id", "hops", F.array_join("labels", ",").alias("labels"), F.array_join("rels", ",").alias("rels"), "line")


def subgraph_edges(spark: SparkSession, d: str) -> DataFrame:
    starts = trade_nodes(spark, d).filter("label = 'Region' AND key IN ('0', '1')")
    return G.subgraph(trade_edges(spark, d), starts)


def search_by_degree(spark: SparkSession, d: str) -> DataFrame:
    return G.search(trade_nodes(spark, d), trade_edges(spark, d), "nation_1", "Nation", 10)


def node_detail(spark: SparkSession, d: str) -> DataFrame:
    """One node's card with all its relations."""
    n, seen = trade_nodes(spark, d), G.both_ways(trade_edges(spark, d))
    others = n.select(F.col("node_id").alias("other_id"), F.col("label").alias("mlabel"), F.col("name").alias("mname"))
    return n.filter("node_id = 'Nation:3'").join(seen, "node_id").join(others, "other_id").orderBy("rel", "other_id").limit(60).select("node_id", "name", "rel", "outgoing", "mlabel", "mname")


def shared_node_join(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers with the number of customers of the same nation, three or more."""
    e = trade_edges(spark, d).filter("rel = 'IN_NATION'")
    per = e.filter("src_id LIKE 'Customer:%'").groupBy("dst_id").agg(F.count("*").alias("n")).filter("n >= 3")
    return e.filter("src_id LIKE 'Supplier:%'").join(per, "dst_id").select(F.col("src_id").alias("supplier_id"), F.col("dst_id").alias("nation_id"), "n")


def chain_join(spark: SparkSession, d: str) -> DataFrame:
    e = trade_edges(spark, d)
    a, b = e.filter("rel = 'IN_NATION'").alias("a"), e.filter("rel = 'IN_REGION'").alias("b")
    return a.join(b, F.col("a.dst_id") == F.col("b.src_id")).select(F.col("a.src_id").alias("node_id"), F.col("a.dst_id").alias("nation_id"), F.col("b.dst_id").alias("region_id"))


def region_customers(spark: SparkSession, d: str) -> DataFrame:
    """Per supplier the number of customers of its region."""
    c = chain_join(spark, d)
    per = c.filter("node_id LIKE 'Customer:%'").groupBy("region_id").agg(F.count("*").alias("n_customers"))
    return c.filter("node_id LIKE 'Supplier:%'").join(per, "region_id").select(F.col("node_id").alias("supplier_id"), "region_id", "n_customers")


def pair_join(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers met with all customers of the same nation.

    Nations are few and all pairs are written, so a nation's customers are dealt out to several tasks, each of which has its
    suppliers. The tasks are of a stated number: the small inputs do not tell how much comes out."""
    tasks = 4 * spark.sparkContext.defaultParallelism
    parts = max(1, tasks // 3)
    c = table(spark, d, "customer").select("c_name", F.col("c_nationkey").alias("nationkey"), F.pmod(F.xxhash64("c_name", "c_custkey"), F.lit(parts)).cast("int").alias("part"))
    s = table(spark, d, "supplier").select("s_name", F.col("s_nationkey").alias("nationkey"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    return c.repartition(tasks, "nationkey", "part").join(s.repartition(tasks, "nationkey", "part"), ["nationkey", "part"]).select("s_name", "c_name", "nationkey")


def two_edge_join(spark: SparkSession, d: str) -> DataFrame:
    """Two edges of one node joined on it: districts whose places all have one label, with the label and their number."""
    p = table(spark, d, "places").select(clean("key").alias("src_id"), clean("district").alias("district"), clean("label").alias("label")).filter("src_id IS NOT NULL")
    in_district, is_type = p.filter("district IS NOT NULL").select("src_id", "district").distinct(), p.filter("label IS NOT NULL").select("src_id", "label").distinct()
    both = in_district.join(is_type, "src_id").groupBy("district").agg(F.countDistinct("label").alias("types"), F.min("label").alias("label"), F.count("*").alias("n"))
    return both.filter("types = 1 AND n >= 2").select("district", "label", "n")


def edge_property_join(spark: SparkSession, d: str) -> DataFrame:
    """Parts with a ruling (the return flag) by a source (the supplier) that is also the part's source of origin."""
    li = table(spark, d, "lineitem")
    rulings = li.select("l_partkey", "l_suppkey", "l_returnflag").distinct()
    origin = li.groupBy("l_partkey").agg(F.min("l_suppkey").alias("l_suppkey"))
    return rulings.join(origin, ["l_partkey", "l_suppkey"]).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.countDistinct("l_partkey").alias("n_parts"))


def left_issuer(spark: SparkSession, d: str) -> DataFrame:
    """Customers with their number of orders, none included."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.countDistinct("o_orderkey").alias("n"))
    return table(spark, d, "customer").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


def semi_join_codes(spark: SparkSession, d: str) -> DataFrame:
    """Orders with a returned line."""
    r = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(r, "o_orderkey", "left_semi").select("o_orderkey", "o_custkey")


def anti_join_done(spark: SparkSession, d: str) -> DataFrame:
    """Customers without an urgent order."""
    o = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(o, "c_custkey", "left_anti").select("c_custkey", "c_name")


def self_join_supersedes(spark: SparkSession, d: str) -> DataFrame:
    """Regulations with the regulation that they supersede, by key."""
    r = table(spark, d, "regulation_timeline")
    new, old = r.select(F.col("row_id").alias("new_id"), code_key("supersedes").alias("k")), r.select(F.col("row_id").alias("old_id"), code_key("reg_id").alias("k"))
    return new.join(old, "k").select("new_id", "old_id")


PLACE_SPEC = G.SourceSpec(
    "Place", "key", ("name",), ("name_en",), order="row_id", keep=("district", "addr_full"), text=("name_en", "district", "province"),
    edges=(G.EdgeSpec("district", "IN_DISTRICT", "District", within="province", within_rel="IN_PROVINCE", within_label="Province"), G.EdgeSpec("province", "LOCATED_IN", "Province")),
)


def place_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Places as nodes, the first row of every key."""
    return G.build_nodes(table(spark, d, "places"), PLACE_SPEC).select("node_id", "label", "key", "name", "name_en", "text", F.element_at("props", "district").alias("district"))


def place_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.build_edges(table(spark, d, "places"), PLACE_SPEC).select("src_id", "rel", "dst_id")


def attribute_node_census(spark: SparkSession, d: str) -> DataFrame:
    return G.census(G.attribute_nodes(G.build_edges(table(spark, d, "places"), PLACE_SPEC)), "label")


def province_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Provinces and regions with their edges."""
    p = table(spark, d, "provinces")
    return p.select(F.concat(F.lit("Province:"), F.col("name_th")).alias("src_id"), F.lit("IN_REGION").alias("rel"), F.concat(F.lit("Region:"), F.col("region_th")).alias("dst_id")).distinct()


def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """Place nodes of the first half of the loads with the later rows merged in."""
    p = table(spark, d, "places").filter("key IS NOT NULL AND trim(key) <> ''")
    cut_off = "2024-07-01"
    first = lambda df, order: G.first_per_key(df, F.col("key"), order, F.col("row_id"))
    cols = [F.col("key").alias("node_id"), "name", "name_en", "district"]
    old, new = first(p.filter(f"loaded_at < '{cut_off}'"), F.col("loaded_at")).select(*cols), first(p.filter(f"loaded_at >= '{cut_off}'"), F.desc("loaded_at")).select(*cols)
    return G.upsert_nodes(old, new, props=None)


def upsert_edges(spark: SparkSession, d: str) -> DataFrame:
    """Old edges plus those later ones that are new."""
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src_id"), F.lit("SUPPLIES").alias("rel"), F.col("l_partkey").alias("dst_id"), "l_shipdate")
    cut_off = "l_shipdate < '1995-01-01'"
    merged = G.upsert_edges(e.filter(cut_off).drop("l_shipdate").distinct(), e.filter(f"NOT {cut_off}").drop("l_shipdate"))
    return merged.groupBy("src_id").agg(F.count("*").alias("n"))


def annotate_relation(spark: SparkSession, d: str) -> DataFrame:
    e = _order_edges(spark, d)
    done = G.annotate_edges(e, "ORDERED", F.col("valid_from") - 2, F.coalesce("valid_to", F.lit(9999)))
    return done.groupBy("valid_from", "valid_to").agg(F.count("*").alias("n"))


def graph_probe(spark: SparkSession, d: str) -> DataFrame:
    """Whether the graph has more than a hundred nodes."""
    return trade_nodes(spark, d).limit(101).agg((F.count("*") > 100).alias("filled"))


def key_violations(spark: SparkSession, d: str) -> DataFrame:
    """Keys that several places have."""
    return G.key_violations(table(spark, d, "places").select(clean("key").alias("key")), "key")


QUERIES = {
    f.__name__: f
    for f in (
        node_census, edge_census, neighbourhood_summary, neighbourhood_asof, hop2_expand, shortest_path, path_lines, subgraph_edges, search_by_degree, node_detail, shared_node_join, chain_join, region_customers, pair_join, two_edge_join,
        edge_property_join, left_issuer, semi_join_codes, anti_join_done, self_join_supersedes, place_nodes, place_edges, attribute_node_census, province_hierarchy, upsert_latest, upsert_edges, annotate_relation, graph_probe, key_violations,
    )
}

_CL = "CASE WHEN lower(trim({0}, ' \t\n\r')) NOT IN ('', 'nan', 'none', 'null') THEN trim({0}, ' \t\n\r ') END"
_CODE = "upper(regexp_replace(CASE WHEN lower(trim({0}, ' \t\n\r')) NOT IN ('', 'nan', 'none', 'null') THEN {0} END, '[^A-Za-z0-9]', '', 'g'))"
_PLACES_SQL = f"pl AS (SELECT *, {_CL.format('key')} AS k, row_number() OVER (PARTITION BY {_CL.format('key')} ORDER BY row_id) AS rn FROM places)"
_ORDERS_SQL = """oe AS (SELECT 'Customer:' || o_custkey AS src_id, 'ORDERED' AS rel, 'Priority:' || o_orderpriority AS dst_id, year(o_orderdate) AS valid_from, CASE WHEN o_orderstatus <> 'O' THEN year(o_orderdate) + 1 END AS valid_to FROM orders)"""

_PATHS_SQL = f"""{EDGES_SQL}, {BOTH_SQL}, up AS (SELECT DISTINCT node_id, other_id FROM seen WHERE node_id NOT LIKE 'Customer%' AND other_id NOT LIKE 'Customer%'),
 want AS (SELECT 'Supplier:' || s_suppkey AS src_id, 'Nation:' || n_nationkey AS dst_id FROM supplier JOIN nation ON s_suppkey % 25 = n_nationkey),
 walk AS (SELECT src_id, src_id AS node_id, [src_id] AS path FROM (SELECT DISTINCT src_id FROM want) UNION ALL SELECT w.src_id, u.other_id, list_append(w.path, u.other_id) FROM walk w JOIN up u USING (node_id)
  WHERE len(w.path) < 5 AND NOT list_contains(w.path, u.other_id) AND (u.other_id NOT LIKE 'Supplier%')),
 least AS (SELECT want.src_id, want.dst_id, min(len(path))::INTEGER - 1 AS hops, arg_min(path, (len(path), path)) AS path FROM want JOIN walk ON want.src_id = walk.src_id AND want.dst_id = walk.node_id GROUP BY 1, 2)"""

ORACLES = {
    "node_census": f"WITH {NODES_SQL} SELECT label, count(*) AS n FROM nodes GROUP BY 1",
    "edge_census": f"WITH {EDGES_SQL} SELECT rel, count(*) AS n FROM edges GROUP BY 1",
    "neighbourhood_summary": f"WITH {GRAPH_SQL}, {_NEIGHBOURHOOD_SQL.format(where='')} SELECT * FROM summary WHERE node_id LIKE 'Region:%' OR node_id LIKE 'Nation:%'",
    "neighbourhood_asof": f"""WITH {_ORDERS_SQL}, live AS (SELECT DISTINCT dst_id AS node_id, src_id AS other_id FROM oe WHERE valid_from <= 1996 AND (valid_to IS NULL OR valid_to >= 1996)),
 n1 AS (SELECT l.node_id, l.other_id, c_name AS mname FROM live l JOIN customer ON l.other_id = 'Customer:' || c_custkey)
 SELECT node_id, 'ORDERED' AS rel, 'Customer' AS mlabel, false AS outgoing, count(*) AS n, array_to_string(list_slice(list_sort(list(DISTINCT mname)), 1, 5), ',') AS samples, array_to_string(list_slice(list_sort(list(DISTINCT other_id)), 1, 5), ',') AS sample_ids FROM n1 GROUP BY 1""",
    "hop2_expand": f"""WITH {GRAPH_SQL}, {_NEIGHBOURHOOD_SQL.format(where='')}, starts AS (SELECT node_id FROM nodes WHERE label = 'Supplier'),
 reached AS (SELECT DISTINCT s.node_id AS start_id, unnest(string_split(s.sample_ids, ',')) AS node_id FROM summary s JOIN starts USING (node_id) WHERE s.mlabel IN ('Nation', 'Region') AND s.n <= 3),
 fresh AS (SELECT *, row_number() OVER (PARTITION BY start_id ORDER BY node_id) AS r FROM reached WHERE node_id NOT IN (SELECT node_id FROM starts))
 SELECT f.start_id, f.node_id, s.rel, s.mlabel, s.outgoing, s.n FROM fresh f JOIN summary s USING (node_id) WHERE f.r <= 4""",
    "shortest_path": f"WITH RECURSIVE {_PATHS_SQL} SELECT src_id, dst_id, hops, array_to_string(path, ',') AS path FROM least",
    "path_lines": f"""WITH RECURSIVE {_PATHS_SQL}, {NODES_SQL}, st AS (SELECT src_id, dst_id, hops, path, unnest(range(1, hops + 2)) AS i FROM least),
 f AS (SELECT st.src_id, st.dst_id, st.hops, st.i, n.name, n.label, (SELECT min(rel) FROM seen WHERE seen.node_id = st.path[i] AND seen.other_id = st.path[i + 1]) AS rel FROM st JOIN nodes n ON n.node_id = st.path[i])
 SELECT src_id, dst_id, hops, string_agg(label, ',' ORDER BY i) AS labels, coalesce(string_agg(rel, ',' ORDER BY i), '') AS rels, string_agg(name || coalesce(' -[' || rel || ']-> ', ''), '' ORDER BY i) AS line FROM f GROUP BY 1, 2, 3""",
    "subgraph_edges": f"""WITH {EDGES_SQL}, h1 AS (SELECT * FROM edges WHERE src_id IN ('Region:0', 'Region:1') OR dst_id IN ('Region:0', 'Region:1')),
 mid AS (SELECT src_id AS id FROM h1 UNION SELECT dst_id FROM h1) SELECT DISTINCT src_id, rel, dst_id FROM edges WHERE src_id IN (SELECT id FROM mid) OR dst_id IN (SELECT id FROM mid)""",
    "search_by_degree": f"""WITH {GRAPH_SQL} SELECT n.node_id, n.label, n.name, count(s.node_id) AS degree FROM nodes n LEFT JOIN seen s ON n.node_id = s.node_id
 WHERE n.label = 'Nation' AND (contains(lower(n.name), 'nation_1') OR contains(lower(n.key), 'nation_1')) GROUP BY 1, 2, 3 ORDER BY degree DESC, n.node_id LIMIT 10""",
    "node_detail": f"WITH {GRAPH_SQL} SELECT n.node_id, n.name, s.rel, s.outgoing, o.label AS mlabel, o.name AS mname FROM nodes n JOIN seen s USING (node_id) JOIN nodes o ON s.other_id = o.node_id WHERE n.node_id = 'Nation:3' ORDER BY s.rel, s.other_id LIMIT 60",
    "shared_node_join": "SELECT 'Supplier:' || s_suppkey AS supplier_id, 'Nation:' || s_nationkey AS nation_id, n FROM supplier JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) >= 3) ON s_nationkey = c_nationkey",
    "chain_join": f"WITH {EDGES_SQL} SELECT a.src_id AS node_id, a.dst_id AS nation_id, b.dst_id AS region_id FROM edges a JOIN edges b ON a.dst_id = b.src_id WHERE a.rel = 'IN_NATION' AND b.rel = 'IN_REGION'",
    "region_customers": """WITH c AS (SELECT n_regionkey AS r, count(*) AS n_customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
 SELECT 'Supplier:' || s_suppkey AS supplier_id, 'Region:' || n_regionkey AS region_id, n_customers FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN c ON c.r = n_regionkey""",
    "pair_join": "SELECT s_name, c_name, s_nationkey AS nationkey FROM supplier JOIN customer ON s_nationkey = c_nationkey",
    "two_edge_join": f"""WITH p AS (SELECT {_CL.format('key')} AS k, {_CL.format('district')} AS district, {_CL.format('label')} AS label FROM places), a AS (SELECT DISTINCT k, district FROM p WHERE k IS NOT NULL AND district IS NOT NULL), b AS (SELECT DISTINCT k, label FROM p WHERE k IS NOT NULL AND label IS NOT NULL)
 SELECT district, min(label) AS label, count(*) AS n FROM a JOIN b USING (k) GROUP BY 1 HAVING count(DISTINCT label) = 1 AND count(*) >= 2""",
    "edge_property_join": """SELECT l_returnflag, count(*) AS n, count(DISTINCT l_partkey) AS n_parts FROM (SELECT DISTINCT l_partkey, l_suppkey, l_returnflag FROM lineitem) JOIN (SELECT l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1) USING (l_partkey, l_suppkey) GROUP BY 1""",
    "left_issuer": "SELECT c_custkey, count(DISTINCT o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1",
    "semi_join_codes": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    "anti_join_done": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "self_join_supersedes": f"SELECT a.row_id AS new_id, b.row_id AS old_id FROM regulation_timeline a JOIN regulation_timeline b ON {_CODE.format('a.supersedes')} = {_CODE.format('b.reg_id')}",
    "place_nodes": f"""WITH {_PLACES_SQL} SELECT 'Place:' || k AS node_id, 'Place' AS label, k AS key, {_CL.format('name')} AS name, {_CL.format('name_en')} AS name_en,
 concat_ws(' | ', 'Place', {_CL.format('name')}, {_CL.format('name_en')}, {_CL.format('district')}, regexp_replace({_CL.format('province')}, '^[\\s]+|[\\s]+$', '', 'g')) AS text, {_CL.format('district')} AS district FROM pl WHERE rn = 1 AND k IS NOT NULL""",
    "place_edges": f"""WITH {_PLACES_SQL} SELECT DISTINCT 'Place:' || k AS src_id, 'IN_DISTRICT' AS rel, 'District:' || {_CL.format('district')} || '|' || {_CL.format('province')} AS dst_id FROM pl WHERE k IS NOT NULL AND {_CL.format('district')} IS NOT NULL AND {_CL.format('province')} IS NOT NULL
 UNION SELECT DISTINCT 'Place:' || k, 'LOCATED_IN', 'Province:' || {_CL.format('province')} FROM pl WHERE k IS NOT NULL AND {_CL.format('province')} IS NOT NULL
 UNION SELECT DISTINCT 'District:' || {_CL.format('district')} || '|' || {_CL.format('province')}, 'IN_PROVINCE', 'Province:' || {_CL.format('province')} FROM pl WHERE k IS NOT NULL AND {_CL.format('district')} IS NOT NULL AND {_CL.format('province')} IS NOT NULL""",
    "attribute_node_census": f"""SELECT 'District' AS label, count(DISTINCT {_CL.format('district')} || '|' || {_CL.format('province')}) AS n FROM places WHERE {_CL.format('key')} IS NOT NULL UNION ALL SELECT 'Province', count(DISTINCT {_CL.format('province')}) FROM places WHERE {_CL.format('key')} IS NOT NULL""",
    "province_hierarchy": "SELECT DISTINCT 'Province:' || name_th AS src_id, 'IN_REGION' AS rel, 'Region:' || region_th AS dst_id FROM provinces",
    "upsert_latest": """WITH p AS (SELECT * FROM places WHERE key IS NOT NULL AND trim(key) <> ''),
 o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY loaded_at, row_id) AS rn FROM p WHERE loaded_at < '2024-07-01'), n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY loaded_at DESC, row_id) AS rn FROM p WHERE loaded_at >= '2024-07-01')
 SELECT coalesce(n.key, o.key) AS node_id, coalesce(n.name, o.name) AS name, coalesce(n.name_en, o.name_en) AS name_en, coalesce(n.district, o.district) AS district
 FROM (SELECT * FROM o WHERE rn = 1) o FULL JOIN (SELECT * FROM n WHERE rn = 1) n ON o.key = n.key""",
    "upsert_edges": "SELECT l_suppkey AS src_id, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1",
    "annotate_relation": f"WITH {_ORDERS_SQL} SELECT valid_from - 2 AS valid_from, coalesce(valid_to, 9999) AS valid_to, count(*) AS n FROM oe GROUP BY 1, 2",
    "key_violations": f"SELECT {_CL.format('key')} AS key, count(*) AS n FROM places WHERE {_CL.format('key')} IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "graph_probe": f"WITH {NODES_SQL} SELECT count(*) > 100 AS filled FROM nodes",
}
