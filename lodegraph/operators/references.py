"""References to records that do not exist at the time of the referring row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reference_rows(df: DataFrame, ref_table: str, row_id: str, key: Column, at: str) -> DataFrame:
    """Referring rows in long form: (ref_table, row_id, key, at). Rows without a reference (null key) are left out."""
    return df.select(F.lit(ref_table).alias("ref_table"), F.col(row_id).alias("row_id"), key.alias("key"), F.col(at).alias("at")).filter(F.col("key").isNotNull())


def target_rows(df: DataFrame, ref_table: str, key: Column, start: str, end: str | None = None) -> DataFrame:
    """Target rows in long form: (ref_table, key, start, end)."""
    e = F.col(end) if end else F.lit(None)
    return df.select(F.lit(ref_table).alias("ref_table"), key.alias("key"), F.col(start).cast("timestamp").alias("start"), e.cast("timestamp").alias("end")).filter(F.col("key").isNotNull())


def orphan_references(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Referring rows with no target present at their time: (ref_table, row_id, period, reason).

    A target is present from its start, inclusive, until its end, exclusive; one that ends at or before its start never
    is, and one without a start never starts. ``reason`` is 'missing' when no target row has the key, 'deleted' when
    some target had started by then, else 'late' (also where the referring row has no time). ``period`` is the
    referring row's month, NULL without a time. Empty inputs give empty results; repeated rows are reported each.

    Plan: starts, ends and reference times are tagged, united in long form and grouped by (table, key, time), so a key
    that holds a third of all rows shrinks to its distinct times before anything is ordered. Presence is a running sum
    of starts less ends; it is taken per (table, key, day) on top of the days' own running sum, so that not even a hot
    key's times meet in one task. Only orphaned (key, time) points are joined back to the rows.
    """
    k = ["ref_table", "key"]
    stats = parents.groupBy(*k).agg(F.min("start").alias("first_start"), F.lit(True).alias("has_parent"))
    valid = parents.filter(F.col("start").isNotNull() & (F.col("end").isNull() | (F.col("end") > F.col("start"))))
    zero, no = F.lit(0).cast("long"), F.lit(False)
    refs = children.groupBy(*k, F.col("at").alias("t")).agg(F.lit(True).alias("ref"))
    tagged = (
        valid.select(*k, F.col("start").alias("t"), F.lit(1).cast("long").alias("d"), no.alias("ref"))
        .unionByName(valid.filter(F.col("end").isNotNull()).select(*k, F.col("end").alias("t"), F.lit(-1).cast("long").alias("d"), no.alias("ref")))
        .unionByName(refs.select(*k, "t", zero.alias("d"), "ref"))
    )
    points = tagged.groupBy(*k, "t").agg(F.sum("d").alias("d"), F.max("ref").alias("ref")).withColumn("day", F.to_date("t"))
    by_day = points.groupBy(*k, "day").agg(F.sum("d").alias("d_day"))
    before = by_day.select(*k, "day", F.coalesce(F.sum("d_day").over(Window.partitionBy(*k).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), zero).alias("carried"))
    running = F.sum("d").over(Window.partitionBy(*k, "day").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    p, b = points.withColumn("run", running).alias("p"), before.alias("b")
    present = p.join(b, (F.col("p.ref_table") == F.col("b.ref_table")) & (F.col("p.key") == F.col("b.key")) & F.col("p.day").eqNullSafe(F.col("b.day"))).select(
        *(F.col(f"p.{x}").alias(x) for x in (*k, "t", "ref")), (F.col("p.run") + F.col("b.carried")).alias("n")
    )
    orphan_points = present.filter(F.col("ref") & (F.col("t").isNull() | (F.col("n") <= 0))).select(*k, "t")
    reasons = orphan_points.join(stats, k, "left").select(
        *k,
        "t",
        F.when(F.col("has_parent").isNull(), "missing").when(F.col("first_start") <= F.col("t"), "deleted").otherwise("late").alias("reason"),
    )
    c, r = children.alias("c"), reasons.alias("r")
    return c.join(r, (F.col("c.ref_table") == F.col("r.ref_table")) & (F.col("c.key") == F.col("r.key")) & F.col("c.at").eqNullSafe(F.col("r.t"))).select(
        F.col("c.ref_table").alias("ref_table"), F.col("c.row_id").alias("row_id"), F.date_format("c.at", "yyyy-MM").alias("period"), F.col("r.reason").alias("reason")
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans counted per referring table, month and reason."""
    return orphans.groupBy("ref_table", "period", "reason").agg(F.count("*").alias("n"))
