"""Scans. A missing file gives an empty DataFrame with the asked columns; missing columns come out as NULL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodegraph.functions.text import clean
from lodegraph.operators.graph import first_per_key


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob is there, on whatever file system it names."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def _strings(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def resolve(spark: SparkSession, name: str, folder: str) -> str:
    """A path as given where it is absolute, names a file system or is there, else the file of that name in the folder."""
    if "://" in name or os.path.isabs(name) or exists(spark, name):
        return name
    return f"{folder.rstrip('/')}/{name}"


def read_csv(spark: SparkSession, path: str, columns: list[str], multi_line: bool = True) -> DataFrame:
    """All-string CSV with a header and quotes; a byte order mark before the first column is dropped. Only the asked columns
    are parsed (column pruning). Line breaks within quotes need ``multi_line``, which reads every file in one task; large
    files without them are read in splits with ``multi_line=False``."""
    if not exists(spark, path):
        return spark.createDataFrame([], _strings(columns))
    df = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)
    for c in df.columns:
        if c.lstrip("﻿") != c:
            df = df.withColumnRenamed(c, c.lstrip("﻿"))
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def load_rows(spark: SparkSession, path: str, columns: list[str], key: str, limit: int | None = None) -> DataFrame:
    """A source's rows with missing values as NULL, the first row of every key in file order.

    File order is the order of file names, then of the blocks of a file, then of the rows in a block.
    """
    if not exists(spark, path):
        return read_csv(spark, path, columns)
    raw = read_csv(spark, path, columns)
    # ids of the scan grow within a block only: the block comes first
    df = raw.select(*[clean(c).alias(c) for c in columns], F.input_file_name().alias("__file"), F.input_file_block_start().alias("__block"), F.monotonically_increasing_id().alias("__row"))
    first = first_per_key(df, F.col(key), F.col("__file"), F.col("__block"), F.col("__row")).drop("__file", "__block", "__row")
    return first.orderBy(key).limit(limit) if limit else first


# The fields of an evaluation item.
EVAL_SCHEMA = "id string, question string, answer string, hop_type string, aliases array<string>, gold_nodes array<string>, gold_path array<string>, provenance string, as_of string, stale_answer string, _corrupt_record string"


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation items of JSON lines with their file's name; broken lines are kept apart in _corrupt_record."""
    if not exists(spark, path):
        return spark.createDataFrame([], EVAL_SCHEMA + ", file string")
    return spark.read.schema(EVAL_SCHEMA).option("mode", "PERMISSIVE").json(path).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def broken_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line): the lines of evaluation files that are no JSON object, numbered from 1. A file of evaluation
    items is curated and small, and is numbered in one task."""
    if not exists(spark, path):
        return spark.createDataFrame([], "file string, line_no long, line string")
    whole = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.posexplode(F.split("value", "\n")).alias("i", "line"))
    parsed = F.from_json("line", "map<string,string>", {"mode": "PERMISSIVE"})
    return whole.filter((F.trim("line") != "") & parsed.isNull()).select("file", (F.col("i") + 1).cast("long").alias("line_no"), "line")


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Per file of evaluation items how many it has, in all and of each kind."""
    q = read_questions(spark, path).withColumn("__ok", F.col("_corrupt_record").isNull()).filter("__ok")
    per = [F.count(F.when(F.col("hop_type") == k, 1)).alias(k) for k in ("single", "multi", "relational")]
    return q.groupBy("file").agg(F.count("question").alias("n"), *per)


def load_rulings(spark: SparkSession, path: str) -> DataFrame:
    """The curated rulings; a missing column or a ruling outside its domain is an error."""
    required = ["ingredient_th", "source_th", "ruling"]
    have = spark.read.option("header", True).csv(path).columns
    if missing := [c for c in required if c not in [h.lstrip("﻿") for h in have]]:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    df = read_csv(spark, path, [*required, "ingredient_en", "aliases", "e_number", "source_en", "source_type", "basis_th", "note_th"])
    bad = df.select(F.lower(clean("ruling")).alias("r")).filter("r IS NULL OR r NOT IN ('haram', 'mashbooh', 'halal')").distinct().limit(5).collect()
    if bad:
        raise ValueError(f"unknown rulings: {', '.join(str(b['r']) for b in bad)}")
    return df


def read_checkpoint(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The whole lines of an append-only log; a torn last line is dropped."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    df = spark.read.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    # the column of broken lines cannot be filtered on alone without a parsed one
    return df.withColumn("__bad", F.col("_corrupt_record").isNotNull()).filter("NOT __bad").drop("_corrupt_record", "__bad")


def read_geojson(spark: SparkSession, path: str, name: str = "name") -> DataFrame:
    """Rings of a feature collection: (name, ring_no, seq, lon, lat), polygons and parts of multipolygons alike."""
    schema = f"features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    parts = F.when(kind == "Polygon", F.array(F.from_json(text, "array<array<array<double>>>"))).otherwise(F.from_json(text, "array<array<array<array<double>>>>"))
    rings = raw.select(F.col("f.properties").getItem(name).alias("name"), F.posexplode(F.flatten(parts)).alias("ring_no", "ring"))
    return rings.select("name", "ring_no", F.posexplode("ring").alias("seq", "p")).select("name", (F.col("ring_no") + 1).alias("ring_no"), "seq", F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat"))


def run_sql(spark: SparkSession, query: str, **params) -> DataFrame:
    """A parameterised query: values go in as arguments, never as text."""
    return spark.sql(query, args=params)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int) -> DataFrame:
    """A table of a database in ``parts`` ranges of a numeric column; the driver's jar must be on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts).load()
