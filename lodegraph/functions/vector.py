"""Vector expressions over arrays of numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; NULL where a vector is null or has no length."""
    return F.when((norm(a) > 0) & (norm(b) > 0), dot(a, b) / (norm(a) * norm(b)))


def top_k(corpus: DataFrame, queries: DataFrame, id_col: str, vector: str, k: int, max_queries: int = 10_000) -> DataFrame:
    """(query_id, id, score, rank): exact k nearest corpus vectors by cosine of every query, ties by id.

    A stated set of queries against all rows: at most ``max_queries`` at a time (a larger set is taken in blocks by
    hash) are brought together as one matrix and broadcast; each task multiplies its Arrow batches by it and keeps the
    best k per query, so only k rows per query and task are moved, never the corpus. Null vectors and vectors of length
    zero are left out, as queries and in the corpus; empty inputs give no rows.
    """
    q = queries.select(F.col(id_col).alias("query_id"), F.col(vector).alias("v")).filter("query_id IS NOT NULL AND v IS NOT NULL")
    c = corpus.select(F.col(id_col).alias("id"), F.col(vector).alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    blocks = max(1, -(-q.count() // max_queries))
    id_type = c.schema["id"].dataType.simpleString()
    q_type = q.schema["query_id"].dataType.simpleString()
    out = None
    for b in range(blocks):
        part = q if blocks == 1 else q.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        best = c.mapInPandas(_nearest(part, k), f"query_id {q_type}, id {id_type}, score double")
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        ranked = best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        out = ranked if out is None else out.unionByName(ranked)
    return out


def _unit(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Vectors scaled to length one, and which of them have a length."""
    m = np.array([np.asarray(r, dtype=np.float64) for r in rows], dtype=np.float64).reshape(len(rows), -1)
    n = np.sqrt((m * m).sum(axis=1))
    return m / np.where(n > 0, n, 1.0)[:, None], n > 0


def _nearest(queries: DataFrame, k: int):
    rows = queries.collect()
    ids = np.array([r["query_id"] for r in rows], dtype=object)
    if len(rows):
        m, ok = _unit([r["v"] for r in rows])
        ids, m = ids[ok], m[ok]
    else:
        m = np.empty((0, 1))
    shared = queries.sparkSession.sparkContext.broadcast((ids, m))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked, qm = shared.value
        held: list[list[tuple[float, object]]] = [[] for _ in asked]
        for batch in batches:
            if not len(asked) or not len(batch):
                continue
            cm, ok = _unit(batch["v"].to_list())
            own, cm = batch["id"].to_numpy()[ok], cm[ok]
            # in a fixed order the k best of equal scores are those of the least ids
            order = np.argsort(own, kind="stable")
            own, cm = own[order], cm[order]
            for at in range(0, len(asked), 256):
                scores = qm[at : at + 256] @ cm.T
                for i, row in enumerate(scores):
                    # all rows that reach the k-th best score, so that ties are settled by id afterwards
                    top = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k]) if len(row) > k else np.arange(len(row))
                    best = held[at + i] + [(float(row[j]), own[j]) for j in top]
                    held[at + i] = sorted(best, key=lambda x: (-x[0], x[1]))[:k]
        out = [(asked[i], own, s) for i, best in enumerate(held) for s, own in best]
        if out:
            yield pd.DataFrame(out, columns=["query_id", "id", "score"])

    return search
