"""Queries over rulings, products, regulations and places: evidence paths, validity in time, provinces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodegraph.functions.dates import as_of_year, be_year
from lodegraph.functions.text import bare_name, clean, code_key
from lodegraph.operators import graph as G
from lodegraph.operators import rulings as R
from lodegraph.operators.intervals import buddhist_year, valid_at
from lodegraph.operators.packed import packed_values
from lodegraph.operators.spatial import regions_of_points
from lodegraph.plans.quality import THAILAND
from lodegraph.session import table

# What is written before and after a province's name to say that it is one, taken off in order.
PROVINCE_PREFIXES = ("จังหวัด", "จ.", "province of ", "changwat ")
PROVINCE_SUFFIXES = (" province",)


def _rulings(spark: SparkSession, d: str) -> DataFrame:
    return R.clean_rulings(table(spark, d, "ingredient_rulings"))


def worst_verdict(spark: SparkSession, d: str) -> DataFrame:
    return R.verdicts(_rulings(spark, d), "ingredient", "ruling").select("ingredient", "verdict", "n_rulings")


def conflicts(spark: SparkSession, d: str) -> DataFrame:
    return R.verdicts(_rulings(spark, d), "ingredient", "ruling").filter("conflict").select("ingredient", "n_rulings")


def ruling_paths(spark: SparkSession, d: str) -> DataFrame:
    return R.ruling_paths(_rulings(spark, d)).select("ingredient", "source", "source_type", "ruling", "chain")


def fd_edges(spark: SparkSession, d: str) -> DataFrame:
    """Sources that always give the same ruling."""
    return G.functional_edges(_rulings(spark, d), "source", "ruling")


def rulings_invalid(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the curated rulings that lack a name, an English name, a code or a source, or have an unknown ruling."""
    return R.invalid_rulings(table(spark, d, "ingredient_rulings"), ("ingredient_th", "ingredient_en", "e_number", "source_th", "ruling"))


def ingredient_summary(spark: SparkSession, d: str) -> DataFrame:
    r = _rulings(spark, d).filter("ruling IS NOT NULL")
    totals = r.agg(F.countDistinct("ingredient").alias("all_ingredients"), F.countDistinct("source").alias("all_sources"))
    return r.groupBy("ruling").agg(F.countDistinct("ingredient").alias("n_ingredients"), F.count("*").alias("n_facts")).join(F.broadcast(totals), F.lit(True))


def _product_terms(spark: SparkSession, d: str) -> DataFrame:
    products = table(spark, d, "product_processed").select("row_id", "product_name")
    terms = R.ingredient_terms(table(spark, d, "ingredient_rulings"))
    return R.longest_term(R.find_terms(products, terms, "row_id", "product_name", "ingredient", "alias"))


def term_link(spark: SparkSession, d: str) -> DataFrame:
    """Products whose name holds an ingredient's name, English name, E number or alias; per ingredient the longest."""
    return _product_terms(spark, d).select(F.col("text_id").alias("row_id"), F.col("term_id").alias("ingredient"), "term")


def products_for(spark: SparkSession, d: str) -> DataFrame:
    """Per ingredient the first five products linked to it, by row."""
    w = Window.partitionBy("ingredient").orderBy("row_id")
    return term_link(spark, d).select("ingredient", "row_id").withColumn("r", F.row_number().over(w)).filter("r <= 5")


def ingredient_list(spark: SparkSession, d: str) -> DataFrame:
    """Ingredients with their verdict and the number of products linked."""
    n = term_link(spark, d).groupBy("ingredient").agg(F.countDistinct("row_id").alias("n"))
    return worst_verdict(spark, d).join(n, "ingredient", "left").select("ingredient", "verdict", F.coalesce("n", F.lit(0)).alias("n_products"))


def alias_index(spark: SparkSession, d: str) -> DataFrame:
    """Distinct aliases of three letters or more per ingredient, of all its rows."""
    return R.ingredient_aliases(table(spark, d, "ingredient_rulings"))


def be_year_parse(spark: SparkSession, d: str) -> DataFrame:
    """Expiry years of products, and how many dates are no such year."""
    y = be_year(F.col("expire_date"))
    return table(spark, d, "product_processed").groupBy(y.alias("year")).agg(F.count("*").alias("n"))


def as_of_parse(spark: SparkSession, d: str) -> DataFrame:
    """The year a question is about: stated, else mentioned."""
    e = table(spark, d, "thai_eval")
    return e.select("row_id", F.coalesce(buddhist_year("as_of"), as_of_year(F.col("question"))).alias("year"))


def _regs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "regulation_timeline").filter("deleted_at IS NULL").select("row_id", "reg_id", clean("kind").alias("kind"), clean("issuer_th").alias("issuer"), buddhist_year("valid_from").alias("vf"), buddhist_year("valid_to").alias("vt"))


def timeline_in_force(spark: SparkSession, d: str) -> DataFrame:
    """Regulations in force in 2560, the latest first; the first twenty."""
    r = _regs(spark, d).filter(valid_at(F.col("vf"), F.col("vt"), F.lit(2560)))
    return r.orderBy(F.desc_nulls_last("vf"), "row_id").limit(20).select("row_id", "reg_id", "kind", "issuer", "vf", "vt")


def in_force_by_year(spark: SparkSession, d: str) -> DataFrame:
    """Per year from 2540 to 2570 the regulations in force, by kind."""
    years = spark.range(2540, 2571).select(F.col("id").cast("int").alias("year"))
    spans = _regs(spark, d).select("kind", F.greatest(F.coalesce("vf", F.lit(0)), F.lit(2540)).alias("a"), F.least(F.coalesce("vt", F.lit(9999)), F.lit(2570)).alias("b")).filter("a <= b")
    return spans.select("kind", F.explode(F.sequence("a", "b")).alias("year")).join(F.broadcast(years), "year").groupBy("year", "kind").agg(F.count("*").alias("n"))


def expired(spark: SparkSession, d: str) -> DataFrame:
    """Certificates that have run out by 2567, per certifier and year."""
    return table(spark, d, "certified_halal").filter("valid_to < 2567").groupBy("certifier", "valid_to").agg(F.count("*").alias("n"))


def timed_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per kind of regulation how many rows have a validity."""
    timed = F.col("vf").isNotNull() | F.col("vt").isNotNull()
    return _regs(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.sum(timed.cast("int")).alias("n_timed")).filter("n_timed > 0")


def certification_edges(spark: SparkSession, d: str) -> DataFrame:
    """Products with a code in the register and a readable expiry: edges to the certifier, valid until then; per year."""
    p = table(spark, d, "product_processed").select(code_key("halal_code").alias("k"), be_year(F.col("expire_date")).alias("valid_to"), "row_id").filter("k IS NOT NULL")
    first = G.first_per_key(p, F.col("k"), F.col("row_id"))
    register = table(spark, d, "certified_halal").select(code_key("halal_code").alias("k"))
    return first.join(register, "k", "left_semi").filter("valid_to IS NOT NULL").groupBy("valid_to").agg(F.count("*").alias("n"))


def point_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    """Places per province that contains them."""
    inside = regions_of_points(table(spark, d, "places"), "row_id", "lat", "lon", THAILAND, table(spark, d, "province_rings"), "province_id", "ring_no", "seq", "lat", "lon")
    return inside.groupBy(F.col("region").alias("province_id")).agg(F.count("*").alias("n"))


def _vocabularies(spark: SparkSession, d: str) -> DataFrame:
    """(province_id, tier, term): Thai names, then English names, then other names."""
    p = table(spark, d, "provinces")
    of = lambda tier, c: p.select("province_id", F.lit(tier).alias("tier"), c.alias("term"))
    return of(1, F.col("name_th")).unionByName(of(2, F.col("name_en"))).unionByName(of(3, F.explode("alt_names")))


def _address_hits(spark: SparkSession, d: str, places: DataFrame) -> DataFrame:
    terms = _vocabularies(spark, d).select(F.struct("tier", "province_id").alias("owner"), "term").select(F.to_json("owner").alias("owner"), "term")
    found = R.find_terms(places, terms, "row_id", "addr_full", "owner", "term").select("text_id", "term", F.from_json("term_id", "tier int, province_id long").alias("o"))
    w = Window.partitionBy("text_id").orderBy("o.tier", F.desc(F.length("term")), "term", "o.province_id")
    return found.withColumn("r", F.row_number().over(w)).filter("r = 1").select(F.col("text_id").alias("row_id"), F.col("o.province_id").alias("province_id"))


def address_match(spark: SparkSession, d: str) -> DataFrame:
    """The province that an address names: by Thai names, else English ones, else others; longer names first."""
    return _address_hits(spark, d, table(spark, d, "places"))


def province_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Provinces by stated name, else by address, else by position; how many places each tier settles. A tier looks only at
    what the tiers before it have left."""
    places = table(spark, d, "places").select("row_id", "province", "addr_full", "lat", "lon")
    names = table(spark, d, "provinces").select(F.col("name_th").alias("stated"), F.lit("explicit").alias("tier"))
    first = places.withColumn("stated", clean("province")).join(F.broadcast(names), "stated", "left")
    rest = first.filter("tier IS NULL").drop("tier")
    t2 = _address_hits(spark, d, rest).select("row_id", F.lit("address").alias("tier"))
    left = rest.join(t2, "row_id", "left_anti")
    t3 = regions_of_points(left, "row_id", "lat", "lon", THAILAND, table(spark, d, "province_rings"), "province_id", "ring_no", "seq", "lat", "lon").select("row_id", F.lit("geo").alias("tier")).distinct()
    settled = first.filter("tier IS NOT NULL").select("row_id", "tier").unionByName(t2).unionByName(t3)
    return places.select("row_id").join(settled, "row_id", "left").groupBy(F.coalesce("tier", F.lit("none")).alias("tier")).agg(F.count("*").alias("n"))


def alias_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Stated provinces brought to the province that one spelling of it names: case, what says that it is a province, and
    blanks or hyphens of English names do not count."""
    key = lambda c: F.lower(F.trim(c))
    v = _vocabularies(spark, d)
    joined = v.filter("tier = 2")
    spellings = v.select("province_id", key("term").alias("bare")).unionByName(joined.select("province_id", F.replace(key("term"), F.lit(" "), F.lit("")).alias("bare"))).unionByName(joined.select("province_id", F.replace(key("term"), F.lit(" "), F.lit("-")).alias("bare")))
    one = spellings.groupBy("bare").agg(F.min("province_id").alias("province_id"))
    stated = table(spark, d, "places").select("row_id", bare_name("province", PROVINCE_PREFIXES, PROVINCE_SUFFIXES).alias("bare"))
    return stated.join(one, "bare").groupBy("province_id").agg(F.count("*").alias("n"))


def term_link_words(spark: SparkSession, d: str) -> DataFrame:
    """Questions that hold the second word of a product's name; per question and product category the longest such word."""
    terms = table(spark, d, "product_processed").select("category", F.element_at(F.split("product_name", " "), 2).alias("word")).filter(F.length("word") >= 4)
    found = R.longest_term(R.find_terms(table(spark, d, "thai_eval"), terms, "row_id", "question", "category", "word"))
    return found.select(F.col("text_id").alias("row_id"), F.col("term_id").alias("category"), "term")


def attribute_split(spark: SparkSession, d: str) -> DataFrame:
    """Edges of a column that holds several values: the types of parts, taken apart at blanks; parts per value."""
    spec = G.SourceSpec("Part", "p_partkey", ("p_name",), edges=(G.EdgeSpec("p_name", "HAS_WORD", "Word", " "),))
    return G.build_edges(table(spark, d, "part"), spec).groupBy("dst_id").agg(F.count("*").alias("n"))


def dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    """The first document of every distinct text."""
    docs = table(spark, d, "documents").filter("text IS NOT NULL")
    first = docs.groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    return first.select("doc_id", F.length("text").alias("n"))


def clean_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Language codes brought to one spelling."""
    lang = F.lower(clean("lang"))
    code = F.when(lang.isin("th", "tha"), "th").when(lang.isin("en", "eng"), "en").otherwise(lang)
    return table(spark, d, "documents").groupBy(code.alias("lang")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        worst_verdict, conflicts, ruling_paths, fd_edges, rulings_invalid, ingredient_summary, term_link, products_for, ingredient_list, alias_index, be_year_parse, as_of_parse, timeline_in_force, in_force_by_year, expired, timed_coverage,
        certification_edges, point_in_polygon, address_match, province_cascade, alias_normalise, term_link_words, attribute_split, dedupe_first, clean_tokens,
    )
}

_CL = "(CASE WHEN lower(trim({0}, ' \t\n\r ')) NOT IN ('', 'nan', 'none', 'null') THEN trim({0}, ' \t\n\r ') END)"
_CODE = "upper(regexp_replace(" + _CL + ", '[^A-Za-z0-9]', '', 'g'))"
_R = f"r AS (SELECT row_id, {_CL.format('ingredient_th')} AS ingredient, {_CL.format('source_th')} AS source, {_CL.format('source_type')} AS source_type, lower({_CL.format('ruling')}) AS ruling FROM ingredient_rulings)"
_V = "v AS (SELECT ingredient, min_by(ruling, CASE ruling WHEN 'haram' THEN 0 WHEN 'mashbooh' THEN 1 ELSE 2 END) AS verdict, count(DISTINCT ruling) AS n_rulings FROM r WHERE ingredient IS NOT NULL AND ruling IN ('haram', 'mashbooh', 'halal') GROUP BY 1)"
_YEAR = "(SELECT CASE WHEN y < 2400 THEN y + 543 ELSE y END FROM (SELECT try_cast(nullif(regexp_extract(translate({0}, '๐๑๒๓๔๕๖๗๘๙', '0123456789'), '(^|[^0-9])([0-9]{{4}})([^0-9]|$)', 2), '') AS INTEGER) AS y))"
_G = f"g AS (SELECT row_id, reg_id, {_CL.format('kind')} AS kind, {_CL.format('issuer_th')} AS issuer, {_YEAR.format('valid_from')} AS vf, {_YEAR.format('valid_to')} AS vt FROM regulation_timeline WHERE deleted_at IS NULL)"
_BE = "(CASE WHEN try_cast(nullif(regexp_extract({0}, '^\\s*[0-9]{{1,2}}/[0-9]{{1,2}}/([0-9]{{4}})\\s*$', 1), '') AS INTEGER) BETWEEN 2500 AND 2600 THEN try_cast(regexp_extract({0}, '^\\s*[0-9]{{1,2}}/[0-9]{{1,2}}/([0-9]{{4}})\\s*$', 1) AS INTEGER) END)"
_INSIDE = """loc AS (SELECT row_id, lat, lon FROM places WHERE lat BETWEEN 5 AND 21 AND lon BETWEEN 96 AND 106),
edge AS (SELECT province_id, lon AS x1, lat AS y1, coalesce(lead(lon) OVER w, first(lon) OVER w) AS x2, coalesce(lead(lat) OVER w, first(lat) OVER w) AS y2 FROM province_rings WINDOW w AS (PARTITION BY province_id, ring_no ORDER BY seq)),
inside AS (SELECT province_id, row_id FROM loc JOIN edge ON (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY 1, 2 HAVING count(*) % 2 = 1)"""
_VOC = "voc AS (SELECT province_id, 1 AS tier, lower(name_th) AS term FROM provinces UNION ALL SELECT province_id, 2, lower(name_en) FROM provinces UNION ALL SELECT province_id, 3, lower(unnest(alt_names)) FROM provinces)"
_ADDR = _VOC + ", a AS (SELECT row_id, province_id FROM (SELECT p.row_id, v.province_id, row_number() OVER (PARTITION BY p.row_id ORDER BY v.tier, length(v.term) DESC, v.term, v.province_id) AS rn FROM places p JOIN voc v ON v.term <> '' AND contains(lower(p.addr_full), v.term)) WHERE rn = 1)"
_BARE = "lower(" + _CL.format("province") + ")"
for _p in PROVINCE_PREFIXES:
    _BARE = f"(SELECT CASE WHEN starts_with(x, '{_p}') THEN trim(substr(x, {len(_p) + 1})) ELSE x END FROM (SELECT {_BARE} AS x))"
for _s in PROVINCE_SUFFIXES:
    _BARE = f"(SELECT CASE WHEN ends_with(x, '{_s}') THEN trim(left(x, length(x) - {len(_s)})) ELSE x END FROM (SELECT {_BARE} AS x))"

ORACLES = {
    "worst_verdict": f"WITH {_R}, {_V} SELECT * FROM v",
    "conflicts": f"WITH {_R}, {_V} SELECT ingredient, n_rulings FROM v WHERE n_rulings > 1",
    "ruling_paths": f"WITH {_R} SELECT DISTINCT ingredient, source, source_type, ruling, ingredient || ' -> ' || source || ' -> ' || ruling AS chain FROM r WHERE ingredient IS NOT NULL AND source IS NOT NULL AND ruling IS NOT NULL ORDER BY ingredient, source, ruling, source_type LIMIT 60",
    "fd_edges": f"WITH {_R} SELECT source, min(ruling) AS ruling FROM r WHERE source IS NOT NULL AND ruling IS NOT NULL GROUP BY 1 HAVING count(DISTINCT ruling) = 1",
    "rulings_invalid": " UNION ALL ".join(f"SELECT row_id, 'missing {c}' AS problem FROM ingredient_rulings WHERE {_CL.format(c)} IS NULL" for c in ("ingredient_th", "ingredient_en", "e_number", "source_th", "ruling"))
    + f" UNION ALL SELECT row_id, 'unknown ruling' FROM ingredient_rulings WHERE lower({_CL.format('ruling')}) NOT IN ('haram', 'mashbooh', 'halal')",
    "ingredient_summary": f"WITH {_R} SELECT ruling, count(DISTINCT ingredient) AS n_ingredients, count(*) AS n_facts, (SELECT count(DISTINCT ingredient) FROM r WHERE ruling IS NOT NULL) AS all_ingredients, (SELECT count(DISTINCT source) FROM r WHERE ruling IS NOT NULL) AS all_sources FROM r WHERE ruling IS NOT NULL GROUP BY 1",
    "term_link_words": """WITH t AS (SELECT DISTINCT category, lower(string_split(product_name, ' ')[2]) AS term FROM product_processed WHERE length(string_split(product_name, ' ')[2]) >= 4),
 h AS (SELECT q.row_id, t.category, t.term, row_number() OVER (PARTITION BY q.row_id, t.category ORDER BY length(t.term) DESC, t.term) AS rn FROM thai_eval q JOIN t ON contains(lower(q.question), t.term)) SELECT row_id, category, term FROM h WHERE rn = 1""",
    "attribute_split": "WITH w AS (SELECT p_partkey, lower(trim(x)) AS w, min(i) AS i FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS x, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part) WHERE trim(x) <> '' GROUP BY 1, 2) SELECT 'Word:' || w AS dst_id, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY i) AS r FROM w) WHERE r <= 4 GROUP BY 1",
    "be_year_parse": f"SELECT {_BE.format('expire_date')} AS year, count(*) AS n FROM product_processed GROUP BY 1",
    "as_of_parse": f"SELECT row_id, coalesce({_YEAR.format('as_of')}, try_cast(nullif(regexp_extract(question, '(^|[^0-9])(25[0-9]{{2}})([^0-9]|$)', 2), '') AS INTEGER)) AS year FROM thai_eval",
    "timeline_in_force": f"WITH {_G} SELECT * FROM g WHERE (vf IS NULL OR vf <= 2560) AND (vt IS NULL OR vt >= 2560) ORDER BY vf DESC NULLS LAST, row_id LIMIT 20",
    "in_force_by_year": f"WITH {_G} SELECT y::INTEGER AS year, kind, count(*) AS n FROM g JOIN (SELECT unnest(range(2540, 2571)) AS y) ON coalesce(vf, 0) <= y AND coalesce(vt, 9999) >= y GROUP BY 1, 2",
    "expired": "SELECT certifier, valid_to, count(*) AS n FROM certified_halal WHERE valid_to < 2567 GROUP BY 1, 2",
    "timed_coverage": f"WITH {_G} SELECT kind, count(*) AS n, count(*) FILTER (vf IS NOT NULL OR vt IS NOT NULL) AS n_timed FROM g GROUP BY 1 HAVING count(*) FILTER (vf IS NOT NULL OR vt IS NOT NULL) > 0",
    "certification_edges": f"""WITH p AS (SELECT {_CODE.format('halal_code')} AS k, {_BE.format('expire_date')} AS valid_to, row_id FROM product_processed), f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY row_id) AS rn FROM p WHERE k IS NOT NULL)
 SELECT valid_to, count(*) AS n FROM f WHERE rn = 1 AND valid_to IS NOT NULL AND k IN (SELECT {_CODE.format('halal_code')} FROM certified_halal) GROUP BY 1""",
    "point_in_polygon": f"WITH {_INSIDE} SELECT province_id, count(*) AS n FROM inside GROUP BY 1",
    "address_match": f"WITH {_ADDR} SELECT * FROM a",
    "province_cascade": f"""WITH {_INSIDE}, {_ADDR} SELECT CASE WHEN {_CL.format('p.province')} IN (SELECT name_th FROM provinces) THEN 'explicit' WHEN p.row_id IN (SELECT row_id FROM a) THEN 'address' WHEN p.row_id IN (SELECT row_id FROM inside) THEN 'geo' ELSE 'none' END AS tier, count(*) AS n FROM places p GROUP BY 1""",
    "alias_normalise": f"""WITH {_VOC}, sp AS (SELECT province_id, trim(term) AS b FROM voc UNION ALL SELECT province_id, replace(trim(term), ' ', '') FROM voc WHERE tier = 2 UNION ALL SELECT province_id, replace(trim(term), ' ', '-') FROM voc WHERE tier = 2),
 o AS (SELECT b, min(province_id) AS province_id FROM sp GROUP BY 1) SELECT province_id, count(*) AS n FROM (SELECT {_BARE} AS b FROM places) JOIN o USING (b) GROUP BY 1""",
    "dedupe_first": "SELECT min(doc_id) AS doc_id, any_value(length(text))::INTEGER AS n FROM documents WHERE text IS NOT NULL GROUP BY text",
    "clean_tokens": f"SELECT CASE WHEN lower({_CL.format('lang')}) IN ('th', 'tha') THEN 'th' WHEN lower({_CL.format('lang')}) IN ('en', 'eng') THEN 'en' ELSE lower({_CL.format('lang')}) END AS lang, count(*) AS n FROM documents GROUP BY 1",
}
