"""Language and embedding models as optional hooks: calls with retry, batches that shrink, graders. Nothing here is needed
offline, and no call fails a job: a call that keeps failing gives an error with its row."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.functions.text import grade_digit


class TooLarge(Exception):
    """Raised by an embedding client for a batch that is too large; the batch is halved."""


def with_retry(call: Callable, *args, tries: int = 4, wait: float = 1.0, sleep: Callable = time.sleep):
    """The result of a call, tried again after growing waits; TooLarge is passed on at once."""
    for k in range(tries):
        try:
            return call(*args)
        except TooLarge:
            raise
        except Exception:
            if k + 1 == tries:
                raise
            sleep(wait * 2**k)


def ground_with(chat: Callable[[str], str], tries: int = 4, wait: float = 1.0) -> Callable[[Column, Column], Column]:
    """The ``ground`` argument of retrieval.answer for a chat client (prompt -> text). An empty answer stands for a call
    that failed."""

    @F.pandas_udf("string")
    def said(questions: pd.Series, contexts: pd.Series) -> pd.Series:
        def one(q: str, c: str | None) -> str | None:
            if c is None:
                return None
            try:
                return with_retry(chat, f"{c}\n\n{q}", tries=tries, wait=wait)
            except Exception:
                return ""

        return pd.Series([one(q, c) for q, c in zip(questions, contexts)], dtype=object)

    return lambda question, context: said(question, context)


def faithfulness(judge: Callable[[str], str] | None, answer: Column, context: Column) -> Column:
    """Whether a grader finds an answer borne out by its context, by the digit that it gives; NULL without a grader, a
    context or a digit."""
    if judge is None:
        return F.lit(None).cast("double")

    @F.pandas_udf("string")
    def graded(answers: pd.Series, contexts: pd.Series) -> pd.Series:
        def one(a: str | None, c: str | None) -> str | None:
            try:
                return None if a is None or not c else with_retry(judge, f"{c}\n\n{a}")
            except Exception:
                return None

        return pd.Series([one(a, c) for a, c in zip(answers, contexts)], dtype=object)

    return grade_digit(graded(answer, context))


def embed_in_batches(embed: Callable[[list[str]], list[list[float]]], texts: list[str], batch: int = 64, tries: int = 4, wait: float = 1.0) -> list[list[float]]:
    """Vectors in the order of the texts; blank texts count as '-', a batch that is too large is halved until it is one text."""
    texts = [(t or "").strip() or "-" for t in texts]
    out, todo = [], [texts[i : i + batch] for i in range(0, len(texts), batch)][::-1]
    while todo:
        part = todo.pop()
        try:
            out += with_retry(embed, part, tries=tries, wait=wait)
        except TooLarge:
            if len(part) == 1:
                raise
            todo += [part[len(part) // 2 :], part[: len(part) // 2]]
    return out


def embedder(embed: Callable[[list[str]], list[list[float]]], batch: int = 64) -> Callable[[str], Column]:
    """The ``embedder`` option of a graph for an embedding client; partitions call it side by side."""

    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        return pd.Series(embed_in_batches(embed, texts.tolist(), batch), dtype=object)

    return vectors


def index_labels(nodes: DataFrame, labels: list[str], embed: Callable, path: str) -> None:
    """The vectors of all nodes of some labels, each embedded once and stored as a table (node_id, text, v) that the vector
    retriever reads instead of embedding the corpus again."""
    kept = nodes.filter(F.col("label").isin(*labels) & F.col("text").isNotNull()).select("node_id", "text", embed("text").alias("v"))
    kept.write.mode("overwrite").parquet(path)


