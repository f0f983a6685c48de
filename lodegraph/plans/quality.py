"""The general data-quality queries (p2 to p5) over the project's tables, and their SQL twins where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions.text import code_key
from lodegraph.operators.intervals import buddhist_year, lineages, periods_and_gaps
from lodegraph.operators.packed import explode_packed
from lodegraph.operators.references import orphan_references, orphan_report, reference_rows, target_rows
from lodegraph.operators.spatial import Box, locate, near_pairs, regions_of_points
from lodegraph.session import cut, table

# The envelope of usable coordinates, the distance that counts as near, open bounds of a validity.
THAILAND = Box(5.0, 21.0, 96.0, 106.0)
NEAR_M = 60.0
FIRST_YEAR, LAST_YEAR = 0, 9999


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values packed in aliases, one per row with its position."""
    parts = [explode_packed(table(spark, sf_dir, t), "aliases", [F.lit(t).alias("src_table"), "row_id"]) for t in ("ingredient_rulings", "thai_eval")]
    return parts[0].unionByName(parts[1])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References whose target is not present when the referring row is loaded."""
    products, register, regs = (table(spark, sf_dir, t) for t in ("product_processed", "certified_halal", "regulation_timeline"))
    children = reference_rows(products, "product_processed", "row_id", code_key("halal_code"), "loaded_at").unionByName(reference_rows(regs, "regulation_timeline", "row_id", code_key("supersedes"), "loaded_at"))
    parents = target_rows(register, "product_processed", code_key("halal_code"), "registered_at", "deleted_at").unionByName(target_rows(regs, "regulation_timeline", code_key("reg_id"), "loaded_at", "deleted_at"))
    return orphan_references(children, parents)


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans per referring table, month and reason."""
    return orphan_report(p3_found(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged validity periods and gaps per lineage of regulations."""
    live = table(spark, sf_dir, "regulation_timeline").filter("deleted_at IS NULL")
    years = live.select("row_id", F.coalesce(buddhist_year("valid_from"), F.lit(FIRST_YEAR)).alias("s"), F.coalesce(buddhist_year("valid_to"), F.lit(LAST_YEAR)).alias("e"))
    rows = cut(lineages(live).join(years, "row_id").select("lineage", "s", "e"))
    return periods_and_gaps(rows, "lineage", "s", "e").withColumnRenamed("entity", "lineage")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of places close by, and the province that contains each place."""
    places, rings = table(spark, sf_dir, "places"), table(spark, sf_dir, "province_rings")
    located = locate(places, "lat", "lon", THAILAND, NEAR_M / 2, "key")
    near = near_pairs(places, "row_id", "key", "lat", "lon", NEAR_M, THAILAND, located=located)
    inside = regions_of_points(places, "row_id", "lat", "lon", THAILAND, rings, "province_id", "ring_no", "seq", "lat", "lon", located=located)
    return near.select(F.lit("near").alias("kind"), "id_a", "id_b").unionByName(inside.select(F.lit("in").alias("kind"), F.col("region").alias("id_a"), F.col("row_id").alias("id_b")))


def p5_province_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Located places whose stated province is a canonical name other than that of the boundary they lie in."""
    places, rings, provinces = (table(spark, sf_dir, t) for t in ("places", "province_rings", "provinces"))
    inside = regions_of_points(places, "row_id", "lat", "lon", THAILAND, rings, "province_id", "ring_no", "seq", "lat", "lon")
    names = provinces.select("province_id", "name_th")
    stated = places.join(F.broadcast(names.withColumnRenamed("province_id", "stated_id")), F.col("province") == F.col("name_th")).select("row_id", "stated_id")
    return stated.join(inside, "row_id").filter("stated_id <> region").select("row_id", "stated_id", F.col("region").alias("found_id"))


QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p3_report": p3_report, "p4_found": p4_found, "p5_found": p5_found, "p5_province_check": p5_province_check}

_CLEAN = "CASE WHEN lower(trim({0}, ' \t\n\r')) NOT IN ('', 'nan', 'none', 'null') THEN {0} END"
_KEY = "upper(regexp_replace(" + _CLEAN + ", '[^A-Za-z0-9]', '', 'g'))"

_P3 = f"""
c AS (SELECT 'product_processed' AS ref_table, row_id, {_KEY.format('halal_code')} AS key, loaded_at AS t FROM product_processed
      UNION ALL SELECT 'regulation_timeline', row_id, {_KEY.format('supersedes')}, loaded_at FROM regulation_timeline),
p AS (SELECT 'product_processed' AS ref_table, {_KEY.format('halal_code')} AS key, registered_at AS s, deleted_at AS e FROM certified_halal
      UNION ALL SELECT 'regulation_timeline', {_KEY.format('reg_id')}, loaded_at, deleted_at FROM regulation_timeline),
j AS (SELECT c.ref_table, c.row_id, any_value(c.t) AS t, count(p.key) AS n, min(p.s) AS s,
             coalesce(bool_or(p.s <= c.t AND (p.e IS NULL OR c.t < p.e)), false) AS present
      FROM c LEFT JOIN p ON c.ref_table = p.ref_table AND c.key = p.key WHERE c.key IS NOT NULL GROUP BY 1, 2),
o AS (SELECT ref_table, row_id, strftime(t, '%Y-%m') AS period, CASE WHEN n = 0 THEN 'missing' WHEN s <= t THEN 'deleted' ELSE 'late' END AS reason FROM j WHERE NOT present)
"""

_YEAR = "(SELECT CASE WHEN y < 2400 THEN y + 543 ELSE y END FROM (SELECT try_cast(nullif(regexp_extract(translate({0}, '๐๑๒๓๔๕๖๗๘๙', '0123456789'), '(^|[^0-9])([0-9]{{4}})([^0-9]|$)', 2), '') AS INTEGER) AS y))"

_P4 = f"""
WITH RECURSIVE live AS (SELECT row_id, coalesce({_KEY.format('reg_id')}, '#' || row_id) AS k, {_KEY.format('supersedes')} AS sup, coalesce({_YEAR.format('valid_from')}, 0) AS s, coalesce({_YEAR.format('valid_to')}, 9999) AS e
              FROM regulation_timeline WHERE deleted_at IS NULL),
link AS (SELECT DISTINCT a.k AS a, b.k AS b FROM live a JOIN live b ON a.sup = b.k), both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT DISTINCT k AS k, k AS r FROM live UNION SELECT reach.k, both_ways.b FROM reach JOIN both_ways ON reach.r = both_ways.a),
lin AS (SELECT reach.k, min(live.row_id) AS lineage FROM reach JOIN live ON reach.r = live.k GROUP BY 1),
rows_ AS (SELECT lineage, s, e FROM live JOIN lin USING (k) WHERE s <= e),
run AS (SELECT *, max(e) OVER (PARTITION BY lineage ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM rows_),
grp AS (SELECT *, sum(CASE WHEN top IS NULL OR s > top + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY lineage ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM run),
per AS (SELECT lineage, g, min(s) AS y_from, max(e) AS y_to FROM grp GROUP BY 1, 2)
SELECT lineage, 'period' AS kind, y_from::BIGINT AS y_from, y_to::BIGINT AS y_to FROM per
UNION ALL SELECT a.lineage, 'gap', (a.y_to + 1)::BIGINT, (b.y_from - 1)::BIGINT FROM per a JOIN per b ON a.lineage = b.lineage AND b.g = a.g + 1
"""

_IN = """
loc AS (SELECT row_id, key, lat, lon FROM places WHERE lat BETWEEN 5 AND 21 AND lon BETWEEN 96 AND 106),
edge AS (SELECT province_id, lon AS x1, lat AS y1, coalesce(lead(lon) OVER w, first(lon) OVER w) AS x2, coalesce(lead(lat) OVER w, first(lat) OVER w) AS y2
         FROM province_rings WINDOW w AS (PARTITION BY province_id, ring_no ORDER BY seq)),
inside AS (SELECT province_id, row_id FROM loc JOIN edge ON (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY 1, 2 HAVING count(*) % 2 = 1)
"""

ORACLES = {
    "p3_found": f"WITH {_P3} SELECT * FROM o",
    "p3_report": f"WITH {_P3} SELECT ref_table, period, reason, count(*) AS n FROM o GROUP BY 1, 2, 3",
    "p4_found": _P4,
    "p5_found": f"""WITH {_IN}
SELECT 'near' AS kind, a.row_id AS id_a, b.row_id AS id_b FROM loc a JOIN loc b ON a.row_id < b.row_id AND a.key IS DISTINCT FROM b.key AND abs(a.lat - b.lat) < 0.001
 AND 2 * 6371000 * asin(sqrt(least(1, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 60
UNION ALL SELECT 'in', province_id, row_id FROM inside""",
    "p5_province_check": f"WITH {_IN} SELECT i.row_id, p.province_id AS stated_id, i.province_id AS found_id FROM inside i JOIN places s ON i.row_id = s.row_id JOIN provinces p ON s.province = p.name_th WHERE p.province_id <> i.province_id",
}
