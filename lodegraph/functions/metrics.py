"""Answer and retrieval metrics as expressions: NULL where an item is not annotated, never NaN."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodegraph.functions.text import normalise_answer, normalised_f1, once


def golds(answer: Column, aliases: Column) -> Column:
    """Everything that counts as the right answer."""
    return F.filter(F.concat(F.array(answer), F.coalesce(aliases, F.array().cast("array<string>"))), lambda g: g.isNotNull())


def _both(pred: Column, gold: Column, f: Callable[[Column, Column], Column]) -> Column:
    """``f`` of the normalised prediction and the array of normalised answers, each normalised once."""
    return once(F.struct(normalise_answer(pred).alias("p"), F.transform(gold, normalise_answer).alias("g")), lambda x: f(x["p"], x["g"]))


def exact_match(pred: Column, gold: Column) -> Column:
    return _both(pred, gold, lambda p, golds: F.exists(golds, lambda g: g == p)).cast("double")


def containment(pred: Column, gold: Column) -> Column:
    """1 where the prediction holds an answer or is held by one, both not empty."""
    return _both(pred, gold, lambda p, golds: F.exists(golds, lambda g: (g != "") & (p != "") & (F.contains(p, g) | F.contains(g, p)))).cast("double")


def best_f1(pred: Column, gold: Column) -> Column:
    return _both(pred, gold, lambda p, golds: F.array_max(F.transform(golds, lambda g: normalised_f1(p, g))))


def context_recall(context: Column, gold: Column) -> Column:
    """1 where the context holds an answer."""
    return _both(context, gold, lambda c, golds: F.exists(golds, lambda g: (g != "") & F.contains(c, g))).cast("double")


def hit_at_k(retrieved: Column, gold_nodes: Column) -> Column:
    """Share of the gold nodes named in any of the retrieved texts, names and ids, all normalised; NULL without gold nodes.
    A blank gold node is never found and counts."""
    texts = F.array_join(F.transform(retrieved, lambda x: normalise_answer(F.coalesce(x, F.lit("")))), "\n")
    found = once(F.struct(texts.alias("t"), F.transform(gold_nodes, normalise_answer).alias("g")), lambda x: F.size(F.filter(x["g"], lambda g: (g != "") & F.contains(x["t"], g))))
    return F.when(F.size(gold_nodes) > 0, found / F.size(gold_nodes))


def has_complete_path(complete: Column) -> Column:
    """1 where a retriever gave a whole chain, 0 where it gave none."""
    return F.coalesce(complete, F.lit(False)).cast("double")


def path_validity(chain: Column, gold_path: Column) -> Column:
    """Share of the gold path's elements met in order along the chain, greedily; either may hold the other. Empty
    elements are dropped; NULL without a gold path."""
    kept = lambda values: F.filter(F.transform(values, normalise_answer), lambda x: x != "")

    def met(c: Column, g: Column) -> Column:
        def step(acc: Column, want: Column) -> Column:
            places = F.when(acc["at"] < F.size(c), F.sequence(acc["at"] + 1, F.greatest(F.size(c), acc["at"] + 1))).otherwise(F.array().cast("array<int>"))
            hit = F.array_min(F.filter(places, lambda i: F.contains(F.element_at(c, i), want) | F.contains(want, F.element_at(c, i))))
            return F.struct(F.coalesce(hit, acc["at"]).alias("at"), (acc["hits"] + F.when(hit.isNotNull(), 1).otherwise(0)).alias("hits"))

        hits = F.aggregate(g, F.struct(F.lit(0).alias("at"), F.lit(0).alias("hits")), step, lambda acc: acc["hits"])
        return F.when(F.size(g) > 0, hits / F.size(g))

    return once(F.struct(kept(chain).alias("c"), kept(gold_path).alias("g")), lambda x: met(x["c"], x["g"]))


def wrong_era(pred: Column, gold: Column, stale: Column, as_of: Column) -> Column:
    """1 where the outdated answer is given and the right one is not; NULL without a year or an outdated answer."""
    said = containment(pred, F.array(stale))
    return F.when(as_of.isNotNull() & stale.isNotNull(), ((said == 1) & (containment(pred, gold) == 0)).cast("double"))


def skip_nan(c: Column) -> Column:
    """NULL for NaN, so that means skip it."""
    return F.nullif(c, F.lit(float("nan")))


def token_estimate(text: Column, reserve: int = 0, chars_per_token: float = 2.5) -> Column:
    return F.ceil(F.length(text) / F.lit(chars_per_token)).cast("long") + F.lit(reserve)


def duration_seconds(c: Column) -> Column:
    """Seconds of a text like 1m30s, 2.5s or 150ms; NULL where it is none."""
    part = lambda p: F.coalesce(F.regexp_extract(c, p, 1).try_cast("double"), F.lit(0.0))
    total = part(r"(\d+(?:\.\d+)?)h") * 3600 + part(r"(\d+(?:\.\d+)?)m(?!s)") * 60 + part(r"(\d+(?:\.\d+)?)s") + part(r"(\d+(?:\.\d+)?)ms") / 1000
    return F.when(c.rlike(r"^(\d+(\.\d+)?(ms|h|m|s))+$"), total)
