"""The training-text queries (p1, p6 to p9) over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm.canonical import PROVINCE_AFFIXES, THAI_SOUNDS, map_column
from lodegraph.llm.leakage import leaks
from lodegraph.llm.lookalike import look_alike_rows
from lodegraph.llm.packing import fill_report, pack
from lodegraph.llm.reading import level_profile, reading_levels
from lodegraph.session import table

LOOK_ALIKE_FIELDS = (("thai_eval", "question"), ("ingredient_rulings", "ingredient_th"), ("product_processed", "product_name"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical entry of every province and province_source that is not canonical yet."""
    places, provinces, sources = (table(spark, sf_dir, t) for t in ("places", "provinces", "province_sources"))
    a = map_column(places, "row_id", "province", provinces, "province_id", "name_th", ["name_en", "alt_names"], PROVINCE_AFFIXES, THAI_SOUNDS)
    b = map_column(places, "row_id", "province_source", sources, "source_id", "code", ["alt_names"], sounds=THAI_SOUNDS)
    return a.unionByName(b)


def p1_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that resemble no entry, with their number of rows."""
    places = table(spark, sf_dir, "places")
    long = places.select("row_id", F.explode(F.create_map(F.lit("province"), F.col("province"), F.lit("province_source"), F.col("province_source"))).alias("field", "value"))
    return p1_found(spark, sf_dir).filter("canon_id = -1").join(long, ["row_id", "field"]).groupBy("field", "value").agg(F.count("*").alias("n"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose text looks like an earlier row's but differs in its characters."""
    out = None
    for name, field in LOOK_ALIKE_FIELDS:
        df = table(spark, sf_dir, name)
        part = look_alike_rows(df, "row_id", field).select(F.lit(name).alias("src_table"), "id_a", "id_b")
        out = part if out is None else out.unionByName(part)
    return out


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into containers of 2,048 tokens."""
    return pack(table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fill of all containers."""
    return fill_report(p7_containers(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold evaluation passages."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_passages")).select("doc_id", "passage_id")


def p8_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation items with a leaked passage: how many passages and documents."""
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_passages"))
    items = table(spark, sf_dir, "eval_passages").select("passage_id", "eval_id")
    return found.join(items, "passage_id").groupBy("eval_id").agg(F.countDistinct("passage_id").alias("n_passages"), F.countDistinct("doc_id").alias("n_docs"), F.max("share").alias("most"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reading level of every document."""
    return reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


def p9_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per reading level."""
    return level_profile(p9_found(spark, sf_dir))


QUERIES = {f.__name__: f for f in (p1_found, p1_misses, p6_found, p7_containers, p7_fill, p8_found, p8_leaked_items, p9_found, p9_profile)}
ORACLES: dict[str, str] = {}
