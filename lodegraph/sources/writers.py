"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.operators.graph import node_id


def write_json_lines(df: DataFrame, path: str) -> None:
    """JSON lines without null fields, one file per partition."""
    df.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def append_progress(df: DataFrame, path: str) -> None:
    """Rows added to an append-only log."""
    df.write.mode("append").json(path)


def write_table(df: DataFrame, path: str, by: list[str] | None = None, kind: str = "parquet", header: bool | None = None) -> None:
    """A whole table replaced, partitioned by the given columns; CSV with a header where asked."""
    w = df.write.mode("overwrite").format(kind)
    w = w.option("header", header) if header is not None else w
    (w.partitionBy(*by) if by else w).save(path)


def create_collection(spark: SparkSession, name: str, size: int, metric: str = "cosine") -> bool:
    """A table of vectors (id, vector, key, label, name, text) with its size and metric as properties, made only where it is
    absent; one that is there must agree. True if it was made."""
    have = spark.catalog.tableExists(name)
    if have:
        props = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
        if (props.get("size"), props.get("metric")) != (str(size), metric):
            raise ValueError(f"{name} holds vectors of size {props.get('size')} by {props.get('metric')}")
        return False
    spark.sql(f"CREATE TABLE {name} (id STRING, vector ARRAY<FLOAT>, key STRING, label STRING, name STRING, text STRING) USING parquet TBLPROPERTIES ('size' = '{int(size)}', 'metric' = '{metric}')")
    return True


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> None:
    """A table bucketed and sorted by its key, so that later joins on it need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def vector_rows(nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    """Nodes with their vectors, keyed by the MD5 of label and key, as a vector store holds them."""
    return nodes.join(vectors, "node_id").select(F.md5(node_id(F.col("label"), F.col("key"))).alias("id"), "vector", "key", "label", "name", "text")


def write_or_quarantine(df: DataFrame, path: str, error: str = "llm_error", most: float = 0.02) -> bool:
    """Writes the rows, to ``path``_FAILED instead where more than ``most`` of them carry an error. True if written to
    ``path``. The rows are aggregated for the gate, never gathered."""
    bad = df.agg(F.avg(F.when(F.trim(F.coalesce(F.col(error), F.lit(""))) != "", 1.0).otherwise(0.0)).alias("r")).first()["r"] or 0.0
    ok = bad <= most
    df.write.mode("overwrite").parquet(path if ok else f"{path}_FAILED")
    return ok
