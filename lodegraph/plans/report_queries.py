"""Scalar, vector, sampling, metric and reporting queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodegraph.functions import metrics as M
from lodegraph.functions import text as T
from lodegraph.functions import vector as V
from lodegraph.operators import graph as G
from lodegraph.operators.packed import packed_values
from lodegraph.session import table


def node_text(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    line = G.node_text("Part", F.col("p_name"), F.concat(F.lit("brand: "), F.col("p_brand")), F.concat(F.lit("size: "), F.col("p_size")))
    return p.select("p_partkey", line.alias("text"))


def fact_lines(spark: SparkSession, d: str) -> DataFrame:
    """One line per nation: its only supplier's name, or how many there are."""
    s = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"), F.min("s_name").alias("first"))
    line = F.when(F.col("n") == 1, F.concat(F.lit("<- IN_NATION: "), F.col("first"))).otherwise(F.concat(F.lit("<- IN_NATION: "), F.format_number("n", 0), F.lit(" such as "), F.col("first")))
    return s.select("s_nationkey", line.alias("line"))


def fact_cap(spark: SparkSession, d: str) -> DataFrame:
    """At most ten order lines per customer, in order."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return G.cap_facts(o, "o_custkey", 10, "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "line_no")


def hash_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.md5(F.concat_ws(":", F.lit("Part"), F.col("p_partkey").cast("string"))).alias("point_id"))


def thai_length(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ingredient_rulings").select("row_id", T.thai_len("ingredient_th").alias("n"))


def dice(spark: SparkSession, d: str) -> DataFrame:
    """How far a place's English name covers its name's length."""
    p = table(spark, d, "places").filter("name IS NOT NULL AND name_en IS NOT NULL")
    return p.select("row_id", F.round(T.dice(T.thai_len("name_en"), T.thai_len("name")), 4).alias("score"))


def lcs_len(spark: SparkSession, d: str) -> DataFrame:
    """Longest common substring of every two nations' names in a region."""
    n = table(spark, d, "nation")
    a, b = n.select(F.col("n_regionkey"), F.col("n_name").alias("a")), n.select("n_regionkey", F.col("n_name").alias("b"))
    return a.join(b, "n_regionkey").filter("a < b").select("a", "b", T.longest_common_substring("a", "b").alias("n"))


def ngrams(spark: SparkSession, d: str) -> DataFrame:
    """Character n-grams of part names and the number of parts that hold them."""
    g = table(spark, d, "part").select("p_partkey", F.explode(T.ngrams(F.lower("p_name"), 3, 12)).alias("gram"))
    return g.groupBy("gram").agg(F.count("*").alias("n"))


def char_f1(spark: SparkSession, d: str) -> DataFrame:
    """Character F1 of questions' stale and right answers."""
    e = table(spark, d, "thai_eval").filter("answer IS NOT NULL AND stale_answer IS NOT NULL")
    return e.select("row_id", F.round(T.char_f1("stale_answer", "answer"), 4).alias("f1"))


def shadow_removal(spark: SparkSession, d: str) -> DataFrame:
    """Province names found in documents, without those inside longer names that were also found."""
    from lodegraph.operators.rulings import find_terms

    p = table(spark, d, "provinces").select("province_id", F.col("name_en").alias("term"))
    short = p.select((F.col("province_id") + 1000).alias("province_id"), F.element_at(F.split("term", " "), -1).alias("term"))
    docs = table(spark, d, "documents")
    found = find_terms(docs, p.unionByName(short), "doc_id", "text", "province_id", "term").select("text_id", "term").distinct()
    longer = found.select(F.col("text_id").alias("t2"), F.col("term").alias("longer"))
    shadowed = found.join(longer, (F.col("text_id") == F.col("t2")) & (F.col("term") != F.col("longer")) & F.contains("longer", "term"), "left_semi")
    return found.join(shadowed, ["text_id", "term"], "left_anti").groupBy("term").agg(F.count("*").alias("n"))


def seed_topk(spark: SparkSession, d: str) -> DataFrame:
    """Per question the best three place names found in it: score over the name's own length, one per name, and at
    least three quarters of the best score."""
    q = table(spark, d, "thai_eval").filter("question IS NOT NULL").select("row_id", F.lower("question").alias("q"))
    # names meet questions by their words: no pair is looked at that shares none
    words = q.select("row_id", "q", F.explode(F.array_distinct(F.split("q", r"\s+"))).alias("w")).filter(F.length("w") >= 4)
    names = table(spark, d, "provinces").select(F.lower("name_th").alias("name")).unionByName(table(spark, d, "product_processed").select(F.lower(F.element_at(F.split("product_name", " "), 2)).alias("name"))).filter(F.length("name") >= 4).distinct()
    hits = words.join(names, F.col("w") == F.col("name")).select("row_id", "name", F.round(T.dice(F.length("name"), F.length("q")), 4).alias("score")).distinct()
    best = F.max("score").over(Window.partitionBy("row_id"))
    ranked = hits.withColumn("best", best).filter(F.col("score") >= 0.75 * F.col("best")).withColumn("rank", F.row_number().over(Window.partitionBy("row_id").orderBy(F.desc("score"), "name")))
    return ranked.filter("rank <= 3").select("row_id", "name", "score", "rank")


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return V.top_k(e, e.filter("vec_id = 0"), "vec_id", "embedding", 10).select("id", F.round("score", 4).alias("score"), "rank")


def vector_topk_multi(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return V.top_k(e, e.filter("vec_id % 100 = 0"), "vec_id", "embedding", 5).select("query_id", "id", F.round("score", 4).alias("score"))


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return G.stratified_sample(table(spark, d, "part"), "p_brand", "p_partkey", 100, 2).select("p_partkey", "p_brand")


def deterministic_shuffle(spark: SparkSession, d: str) -> DataFrame:
    """The first fifty evaluation items in an order that only the seed decides."""
    e = table(spark, d, "thai_eval")
    return e.orderBy(F.md5(F.concat(F.col("row_id").cast("string"), F.lit("42"))), "row_id").limit(50).select("row_id", "id")


def summary_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    """Mean value per event type and user group, and per event type with ALL, with counts; NaN does not count."""
    e = table(spark, d, "events").select("event_type", (F.col("user_id") % 3).cast("string").alias("grp"), M.skip_nan(F.col("value")).alias("value"))
    g = e.groupingSets([["event_type", "grp"], ["event_type"]], "event_type", "grp").agg(F.round(F.avg("value"), 4).alias("mean"), F.count("*").alias("n"), F.grouping("grp").alias("all_"))
    return g.select("event_type", F.when(F.col("all_") == 1, "ALL").otherwise(F.col("grp")).alias("grp"), "mean", "n")


def integrity_gate(spark: SparkSession, d: str) -> DataFrame:
    """The share of errors among the events and whether it passes two in a hundred."""
    e = table(spark, d, "events").agg(F.round(F.avg((F.col("event_type") == "error").cast("double")), 6).alias("error_rate"), F.count("*").alias("n"))
    return e.withColumn("passed", F.col("error_rate") <= 0.02)


def pivot_metric(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)


def melt_metric(spark: SparkSession, d: str) -> DataFrame:
    wide = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.sum("l_quantity").cast("long").alias("quantity"), F.count("*").alias("lines"))
    return wide.unpivot("l_returnflag", ["quantity", "lines"], "metric", "value")


def usage_totals(spark: SparkSession, d: str) -> DataFrame:
    """Estimated tokens of the documents per source."""
    docs = table(spark, d, "documents")
    return docs.groupBy("source").agg(F.sum(M.token_estimate(F.coalesce("text", F.lit("")))).alias("tokens"), F.count("*").alias("n"))


def rate_window(spark: SparkSession, d: str) -> DataFrame:
    """Per user the sum of the last sixty seconds at every event."""
    r = G.trailing_sum(table(spark, d, "events"), "event_id", "user_id", "ts", "value", 60)
    return r.select(F.col("row_id").alias("event_id"), F.round("total", 3).alias("spent"), "n")


def validate_items(spark: SparkSession, d: str) -> DataFrame:
    """Broken rules of the evaluation items: no id, no question, no answer, an unknown kind, an id used again."""
    from lodegraph.operators.evaluation import problems

    return problems(table(spark, d, "thai_eval")).select("row_id", "problem")


def eval_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation items per provenance, by kind."""
    e = table(spark, d, "thai_eval").select(F.coalesce(T.clean("provenance"), F.lit("none")).alias("provenance"), "hop_type")
    return e.groupBy("provenance").pivot("hop_type", ["single", "multi", "relational"]).agg(F.count(F.lit(1))).na.fill(0)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation items with a prediction: the outdated answer where there is one, else the answer of the next item."""
    e = table(spark, d, "thai_eval").filter("answer IS NOT NULL")
    nxt = e.groupBy((F.col("row_id") - 1).alias("row_id")).agg(F.min("answer").alias("next_answer"))
    j = e.join(nxt, "row_id", "left").withColumn("pred", F.coalesce("stale_answer", "next_answer", F.lit("")))
    return j.withColumn("gold", M.golds(F.col("answer"), packed_values("aliases")))


def exact_match(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "thai_eval").filter("answer IS NOT NULL AND stale_answer IS NOT NULL")
    return e.select("row_id", M.exact_match(F.col("stale_answer"), F.array("answer")).alias("em"))


def containment(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "thai_eval").filter("answer IS NOT NULL AND question IS NOT NULL")
    return e.select("row_id", M.containment(F.col("question"), F.array("answer")).alias("hit"))


def context_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether the place names of an evaluation item's gold nodes hold its answer."""
    e = table(spark, d, "thai_eval").select("row_id", "answer", F.explode("gold_nodes").alias("node_id"))
    names = table(spark, d, "places").select("node_id", F.coalesce("name_en", F.lit("")).alias("nm")).groupBy("node_id").agg(F.min("nm").alias("nm"))
    ctx = e.join(names, "node_id").groupBy("row_id", "answer").agg(F.array_join(F.array_sort(F.collect_set("nm")), " ").alias("ctx"))
    return ctx.filter("answer IS NOT NULL").select("row_id", M.context_recall(F.col("ctx"), F.array("answer")).alias("recall"))


def hit_at_k(spark: SparkSession, d: str) -> DataFrame:
    """Share of the gold nodes that exist among the places; NULL where none are given."""
    e = table(spark, d, "thai_eval").select("row_id", F.array_distinct("gold_nodes").alias("g"))
    x = e.select("row_id", F.explode("g").alias("node_id"))
    have = table(spark, d, "places").select("node_id").distinct()
    found = x.join(have, "node_id", "left_semi").groupBy("row_id").agg(F.collect_set("node_id").alias("found"))
    return e.join(found, "row_id", "left").select("row_id", F.round(M.hit_at_k(F.coalesce("found", F.array().cast("array<string>")), F.col("g")), 4).alias("hit"))


def path_validity(spark: SparkSession, d: str) -> DataFrame:
    """How far all of an ingredient's chains, in row order, follow source then ruling of its first row."""
    from lodegraph.operators.rulings import clean_rulings

    r = clean_rulings(table(spark, d, "ingredient_rulings")).filter("ingredient IS NOT NULL AND source IS NOT NULL")
    chain = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("row_id", "source", "ruling"))), lambda x: F.array(x["source"], x["ruling"])))
    g = r.groupBy("ingredient").agg(chain.alias("chain"), F.min_by("source", "row_id").alias("s"), F.min_by("ruling", "row_id").alias("v"))
    return g.select("ingredient", F.round(M.path_validity(F.filter("chain", lambda x: x.isNotNull()), F.array("s", "v")), 4).alias("validity"))


def wrong_era(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d)
    return s.select("row_id", M.wrong_era(F.col("pred"), F.array("answer"), F.col("stale_answer"), T.clean("as_of")).alias("wrong"))


def score_summary(spark: SparkSession, d: str) -> DataFrame:
    """All answer metrics of the predictions, averaged per kind and over all."""
    s = _scored(spark, d).select("hop_type", M.exact_match(F.col("pred"), F.col("gold")).alias("em"), M.containment(F.col("pred"), F.col("gold")).alias("cont"), M.best_f1(F.col("pred"), F.col("gold")).alias("f1"))
    g = s.groupingSets([["hop_type"], []], "hop_type").agg(F.round(F.avg("em"), 4).alias("em"), F.round(F.avg("cont"), 4).alias("containment"), F.round(F.avg("f1"), 4).alias("f1"), F.count("*").alias("n"), F.grouping("hop_type").alias("g"))
    return g.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("hop_type")).alias("hop_type"), "em", "containment", "f1", "n")


def question_retriever_grid(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation items by retriever, without those already scored."""
    e = table(spark, d, "thai_eval").select("id").distinct()
    grid = e.select("id", F.explode(F.array(F.lit("vector"), F.lit("graph"), F.lit("temporal"))).alias("retriever"))
    done = table(spark, d, "eval_passages").select(F.col("eval_id").alias("id"), F.lit("vector").alias("retriever"))
    return grid.join(done, ["id", "retriever"], "left_anti")


def term_durations(spark: SparkSession, d: str) -> DataFrame:
    """Waiting times as a server states them, in seconds, one per event."""
    e = table(spark, d, "events").select("event_id", F.concat((F.col("event_id") % 3).cast("string"), F.lit("m"), (F.col("event_id") % 60).cast("string"), F.lit("s")).alias("stated"))
    return e.select("event_id", M.duration_seconds(F.col("stated")).alias("seconds"))


def display_names(spark: SparkSession, d: str) -> DataFrame:
    """Event types by the names that they are shown by, itself where there is none."""
    e = table(spark, d, "events").select(T.display_name("event_type", {"click": "Click", "view": "Page view"}).alias("shown"))
    return e.groupBy("shown").agg(F.count("*").alias("n"))


def name_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Hotels' names after the word for a hotel, which is not repeated."""
    p = table(spark, d, "places").filter("label = 'Hotel' AND name IS NOT NULL")
    return p.select("row_id", T.name_phrase("name", "โรงแรม").alias("phrase"))


def grade_digits(spark: SparkSession, d: str) -> DataFrame:
    """The first 0 or 1 in a text, as a grader's verdict is read."""
    return table(spark, d, "events").select("event_id", T.grade_digit(F.concat(F.lit("grade: "), F.col("event_id").cast("string"))).alias("grade"))


def candidate_spans(spark: SparkSession, d: str) -> DataFrame:
    """The words of every question that may name something, before its runs of letters; stop words left out."""
    from lodegraph.operators.linking import STOPWORDS

    q = table(spark, d, "thai_eval").filter("question IS NOT NULL").select("row_id", F.size(T.candidate_spans(F.col("question"), STOPWORDS)).alias("n"))
    return q.select("row_id", (F.col("n") > 0).alias("any"))


def unique_names(spark: SparkSession, d: str) -> DataFrame:
    """Place names used once among all places, eight letters or more."""
    p = table(spark, d, "places").filter("name IS NOT NULL").groupBy("name").agg(F.count("*").alias("n"), F.min("row_id").alias("row_id"))
    return p.filter((F.col("n") == 1) & (F.length("name") >= 8)).select("row_id", "name")


QUERIES = {
    f.__name__: f
    for f in (
        node_text, fact_lines, fact_cap, hash_ids, thai_length, dice, lcs_len, ngrams, char_f1, shadow_removal, seed_topk, vector_topk, vector_topk_multi, stratified_sample, deterministic_shuffle, summary_grouping_sets, integrity_gate, pivot_metric, melt_metric,
        usage_totals, rate_window, validate_items, eval_catalogue, exact_match, containment, context_recall, hit_at_k, path_validity, wrong_era, score_summary, question_retriever_grid, term_durations, display_names, name_phrases, grade_digits, candidate_spans, unique_names,
    )
}

_CL = "(CASE WHEN lower(trim({0}, ' \t\n\r ')) NOT IN ('', 'nan', 'none', 'null') THEN trim({0}, ' \t\n\r ') END)"
_N = "regexp_replace(lower(trim({0})), '[\\p{{P}}\\p{{S}}\\s]', '', 'g')"
_CONT = "CASE WHEN {p} <> '' AND {g} <> '' AND (contains({p}, {g}) OR contains({g}, {p})) THEN 1.0 ELSE 0.0 END"
_TL = "length(regexp_replace({0}, '[ัิ-ฺ็-๎]', '', 'g'))"

ORACLES = {
    "node_text": "SELECT p_partkey, concat_ws(' | ', 'Part', p_name, 'brand: ' || p_brand, 'size: ' || p_size) AS text FROM part",
    "fact_lines": "SELECT s_nationkey, CASE WHEN n = 1 THEN '<- IN_NATION: ' || f ELSE '<- IN_NATION: ' || format('{:,}', n) || ' such as ' || f END AS line FROM (SELECT s_nationkey, count(*) AS n, min(s_name) AS f FROM supplier GROUP BY 1)",
    "fact_cap": "SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS line_no FROM orders) WHERE line_no <= 10",
    "hash_ids": "SELECT p_partkey, md5('Part:' || p_partkey) AS point_id FROM part",
    "thai_length": f"SELECT row_id, {_TL.format('ingredient_th')} AS n FROM ingredient_rulings",
    "dice": f"SELECT row_id, round(2.0::DOUBLE * {_TL.format('name_en')} / ({_TL.format('name')} + {_TL.format('name_en')}), 4) AS score FROM places WHERE name IS NOT NULL AND name_en IS NOT NULL",
    "lcs_len": """SELECT a.n_name AS a, b.n_name AS b, coalesce((SELECT max(k) FROM (SELECT unnest(range(1, length(a.n_name) + 1)) AS i), (SELECT unnest(range(1, length(a.n_name) + 1)) AS k) WHERE i + k - 1 <= length(a.n_name) AND contains(b.n_name, substring(a.n_name, i, k))), 0) AS n
 FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name""",
    "ngrams": "SELECT gram, count(*) AS n FROM (SELECT DISTINCT p_partkey, substring(lower(p_name), i::INTEGER, k::INTEGER) AS gram FROM part, (SELECT unnest(range(3, 13)) AS k), (SELECT unnest(range(1, 200)) AS i) WHERE i + k - 1 <= length(p_name)) GROUP BY 1",
    "char_f1": f"""WITH e AS (SELECT row_id, {_N.format('stale_answer')} AS p, {_N.format('answer')} AS g FROM thai_eval WHERE answer IS NOT NULL AND stale_answer IS NOT NULL),
 c AS (SELECT row_id, s, ch, count(*) AS n FROM (SELECT row_id, 'p' AS s, unnest(string_split(p, '')) AS ch FROM e UNION ALL SELECT row_id, 'g', unnest(string_split(g, '')) FROM e) GROUP BY 1, 2, 3),
 o AS (SELECT a.row_id, sum(least(a.n, b.n)) AS n FROM c a JOIN c b ON a.row_id = b.row_id AND a.ch = b.ch AND a.s = 'p' AND b.s = 'g' WHERE a.ch <> '' GROUP BY 1)
 SELECT e.row_id, round(CASE WHEN p = '' OR g = '' THEN 0.0 ELSE 2.0::DOUBLE * coalesce(n, 0) / (length(p) + length(g)) END, 4) AS f1 FROM e LEFT JOIN o USING (row_id)""",
    "shadow_removal": """WITH v AS (SELECT DISTINCT lower(name_en) AS term FROM provinces UNION SELECT DISTINCT lower(string_split(name_en, ' ')[-1]) FROM provinces), f AS (SELECT DISTINCT doc_id, term FROM documents JOIN v ON contains(lower(text), term))
 SELECT term, count(*) AS n FROM f WHERE NOT EXISTS (SELECT 1 FROM f x WHERE x.doc_id = f.doc_id AND x.term <> f.term AND contains(x.term, f.term)) GROUP BY 1""",
    "vector_topk": """WITH s AS (SELECT e.vec_id AS id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)
 SELECT id, round(score, 4) AS score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM s ORDER BY score DESC, id LIMIT 10""",
    "vector_topk_multi": """WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings e, (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0) q)
 SELECT query_id, id, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM s) WHERE r <= 5""",
    "stratified_sample": """WITH n AS (SELECT p_brand, greatest(2, round_even(100.0::DOUBLE * count(*) / (SELECT count(*) FROM part), 0))::INTEGER AS q FROM part GROUP BY 1), h AS (SELECT p_partkey, p_brand, md5(p_partkey || '42') AS h FROM part),
 r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY h, p_partkey) AS r FROM h) SELECT p_partkey, r.p_brand FROM r JOIN n ON r.p_brand = n.p_brand AND r <= q ORDER BY h, p_partkey LIMIT 100""",
    "deterministic_shuffle": "SELECT row_id, id FROM thai_eval ORDER BY md5(row_id || '42'), row_id LIMIT 50",
    "summary_grouping_sets": """SELECT event_type, CASE WHEN grouping(grp) = 1 THEN 'ALL' ELSE grp END AS grp, round(avg(value) FILTER (NOT isnan(value)), 4) AS mean, count(*) AS n FROM (SELECT event_type, (user_id % 3)::VARCHAR AS grp, value FROM events) GROUP BY GROUPING SETS ((event_type, grp), (event_type))""",
    "integrity_gate": "SELECT round(avg((event_type = 'error')::INT::DOUBLE), 6) AS error_rate, count(*) AS n, round(avg((event_type = 'error')::INT::DOUBLE), 6) <= 0.02 AS passed FROM events",
    "pivot_metric": "SELECT o_orderpriority, " + ", ".join(f"count(*) FILTER (o_orderstatus = '{s}') AS {s}" for s in "FOP") + " FROM orders GROUP BY 1",
    "melt_metric": "WITH w AS (SELECT l_returnflag, sum(l_quantity)::BIGINT AS quantity, count(*) AS lines FROM lineitem GROUP BY 1) SELECT l_returnflag, 'quantity' AS metric, quantity AS value FROM w UNION ALL SELECT l_returnflag, 'lines', lines FROM w",
    "usage_totals": "SELECT source, sum(ceil(length(coalesce(text, '')) / 2.5))::BIGINT AS tokens, count(*) AS n FROM documents GROUP BY 1",
    "rate_window": "SELECT event_id, round(sum(value) OVER w, 3) AS spent, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW)",
    "validate_items": f"""WITH e AS (SELECT *, CASE WHEN id IS NOT NULL THEN count(*) OVER (PARTITION BY id) END AS uses FROM thai_eval) SELECT row_id, 'no id' AS problem FROM e WHERE {_CL.format('id')} IS NULL UNION ALL SELECT row_id, 'no question' AS problem FROM e WHERE {_CL.format('question')} IS NULL UNION ALL SELECT row_id, 'no answer' FROM e WHERE {_CL.format('answer')} IS NULL
 UNION ALL SELECT row_id, 'unknown kind' FROM e WHERE coalesce(hop_type, '') NOT IN ('single', 'multi', 'relational') UNION ALL SELECT row_id, 'repeated id' FROM e WHERE uses > 1""",
    "eval_catalogue": f"SELECT coalesce({_CL.format('provenance')}, 'none') AS provenance, " + ", ".join(f"count(*) FILTER (hop_type = '{h}') AS {h}" for h in ("single", "multi", "relational")) + " FROM thai_eval GROUP BY 1",
    "exact_match": f"SELECT row_id, CASE WHEN {_N.format('stale_answer')} = {_N.format('answer')} THEN 1.0 ELSE 0.0 END::DOUBLE AS em FROM thai_eval WHERE answer IS NOT NULL AND stale_answer IS NOT NULL",
    "containment": f"SELECT row_id, ({_CONT.format(p=_N.format('question'), g=_N.format('answer'))})::DOUBLE AS hit FROM thai_eval WHERE answer IS NOT NULL AND question IS NOT NULL",
    "context_recall": f"""WITH x AS (SELECT row_id, answer, unnest(gold_nodes) AS node_id FROM thai_eval), n AS (SELECT node_id, min(coalesce(name_en, '')) AS nm FROM places GROUP BY 1), c AS (SELECT row_id, answer, array_to_string(list_sort(list(DISTINCT nm)), ' ') AS ctx FROM x JOIN n USING (node_id) GROUP BY 1, 2)
 SELECT row_id, CASE WHEN {_N.format('answer')} <> '' AND contains({_N.format('ctx')}, {_N.format('answer')}) THEN 1.0 ELSE 0.0 END::DOUBLE AS recall FROM c WHERE answer IS NOT NULL""",
    "hit_at_k": """WITH e AS (SELECT row_id, list_distinct(gold_nodes) AS g FROM thai_eval), x AS (SELECT row_id, unnest(g) AS node_id FROM e), f AS (SELECT row_id, count(*) AS n FROM x WHERE node_id IN (SELECT node_id FROM places) GROUP BY 1)
 SELECT e.row_id, CASE WHEN len(g) > 0 THEN round(coalesce(n, 0)::DOUBLE / len(g), 4) END AS hit FROM e LEFT JOIN f USING (row_id)""",
    "wrong_era": f"""WITH s AS (SELECT row_id, {_N.format('stale_answer')} AS p, {_N.format('answer')} AS g, {_CL.format('as_of')} AS y, stale_answer FROM thai_eval WHERE answer IS NOT NULL)
 SELECT row_id, CASE WHEN y IS NOT NULL AND stale_answer IS NOT NULL THEN CASE WHEN p <> '' AND NOT (g <> '' AND (contains(p, g) OR contains(g, p))) THEN 1.0 ELSE 0.0 END END::DOUBLE AS wrong FROM s""",
    "seed_topk": """WITH q AS (SELECT row_id, lower(question) AS q FROM thai_eval WHERE question IS NOT NULL), w AS (SELECT DISTINCT row_id, q, unnest(regexp_split_to_array(q, '\\s+')) AS w FROM q),
 n AS (SELECT lower(name_th) AS name FROM provinces UNION SELECT lower(string_split(product_name, ' ')[2]) FROM product_processed), h AS (SELECT DISTINCT row_id, name, round(2.0::DOUBLE * length(name) / (length(name) + length(q)), 4) AS score FROM w JOIN n ON w = name WHERE length(name) >= 4),
 b AS (SELECT *, max(score) OVER (PARTITION BY row_id) AS best FROM h), r AS (SELECT row_id, name, score, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, name) AS rank FROM b WHERE score >= 0.75 * best) SELECT * FROM r WHERE rank <= 3""",
    "question_retriever_grid": "SELECT DISTINCT id, r AS retriever FROM thai_eval, (SELECT unnest(['vector', 'graph', 'temporal']) AS r) WHERE NOT (r = 'vector' AND id IN (SELECT eval_id FROM eval_passages WHERE eval_id IS NOT NULL))",
    "term_durations": "SELECT event_id, ((event_id % 3) * 60 + event_id % 60)::DOUBLE AS seconds FROM events",
    "display_names": "SELECT CASE event_type WHEN 'click' THEN 'Click' WHEN 'view' THEN 'Page view' ELSE event_type END AS shown, count(*) AS n FROM events GROUP BY 1",
    "name_phrases": "SELECT row_id, CASE WHEN starts_with(trim(name), 'โรงแรม') THEN trim(name) WHEN regexp_matches(trim(name), '^[\u0e00-\u0e7f]') THEN 'โรงแรม' || trim(name) ELSE 'โรงแรม ' || trim(name) END AS phrase FROM places WHERE label = 'Hotel' AND name IS NOT NULL",
    "grade_digits": "SELECT event_id, try_cast(nullif(regexp_extract(event_id::VARCHAR, '[01]'), '') AS DOUBLE) AS grade FROM events",
    "unique_names": "SELECT min(row_id) AS row_id, name FROM places WHERE name IS NOT NULL GROUP BY name HAVING count(*) = 1 AND length(name) >= 8",
}
