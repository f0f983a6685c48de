"""Intervals per entity: continuous periods and the gaps between them, and validity at a point in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.functions.text import clean, code_key, col
from lodegraph.operators.components import connected_components

_THAI_DIGITS = "๐๑๒๓๔๕๖๗๘๙"


def buddhist_year(c: str | Column) -> Column:
    """The four-digit year in a free text, in ASCII or Thai digits; years below 2400 are Common Era and get 543 added.
    NULL where the text is missing or has no run of exactly four digits."""
    digits = F.translate(clean(c), _THAI_DIGITS, "0123456789")
    y = F.regexp_extract(digits, r"(?<!\d)(\d{4})(?!\d)", 1)
    n = F.when(y != "", y.cast("int"))
    return F.when(n < 2400, n + 543).otherwise(n)


def periods_and_gaps(df: DataFrame, entity: str, start: str | Column, end: str | Column) -> DataFrame:
    """Continuous periods and the gaps between them: (entity, kind, y_from, y_to), kind 'period' or 'gap'.

    ``start`` and ``end`` are whole numbers, both included; adjoining intervals (end + 1 = next start) run together.
    Rows with a null bound or that end before they start cover nothing. Repeated rows change nothing.

    Starts and ends are ranked independently per entity: there is a gap exactly where the (k+1)-th start exceeds the
    k-th end by more than one. Ranks are running counts over the entity's distinct years, which are pre-aggregated:
    an entity with a third of all rows is a few partial counts per task, then at most one row per year.
    """
    s, e = col(start).cast("long"), col(end).cast("long")
    rows = df.select(F.col(entity).alias("entity"), s.alias("s"), e.alias("e")).filter(F.col("s") <= F.col("e"))
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    marks = rows.select("entity", F.explode(F.array(F.struct(F.col("s").alias("y"), one.alias("ns"), zero.alias("ne")), F.struct(F.col("e").alias("y"), zero.alias("ns"), one.alias("ne")))).alias("x")).select("entity", "x.*")
    per_year = marks.groupBy("entity", "y").agg(F.sum("ns").alias("ns"), F.sum("ne").alias("ne"))
    w = Window.partitionBy("entity").orderBy("y")
    cum = w.rowsBetween(Window.unboundedPreceding, 0)
    # After year y all of the first k intervals have ended when k starts and k ends are counted; the next start is the
    # next year with a mark, since an end cannot come before its start.
    ranked = per_year.select("entity", "y", "ns", "ne", F.sum("ns").over(cum).alias("ks"), F.sum("ne").over(cum).alias("ke"), F.lead("y").over(w).alias("next"))
    closed = F.col("ks") == F.col("ke")
    cuts = ranked.filter(closed & (F.col("next").isNull() | (F.col("next") > F.col("y") + 1)))
    firsts = per_year.groupBy("entity").agg(F.min("y").alias("first"))
    prev = F.lag("next").over(w)
    periods = cuts.withColumn("prev", prev).join(firsts, "entity").select("entity", F.lit("period").alias("kind"), F.coalesce("prev", "first").alias("y_from"), F.col("y").alias("y_to"))
    gaps = cuts.filter(F.col("next").isNotNull()).select("entity", F.lit("gap").alias("kind"), (F.col("y") + 1).alias("y_from"), (F.col("next") - 1).alias("y_to"))
    return periods.unionByName(gaps)


def lineages(regs: DataFrame, row_id: str = "row_id", reg_id: str = "reg_id", supersedes: str = "supersedes") -> DataFrame:
    """(row_id, lineage): rows of one reg_id, or linked by ``supersedes`` over any number of steps, share the smallest
    row_id. Keys are compared by their ASCII letters and digits. A row without a reg_id has only its own link; a link
    to no row, or to the row's own key, joins nothing."""
    rows = regs.select(F.col(row_id).alias("row_id"), F.coalesce(code_key(reg_id), F.concat(F.lit("#"), F.col(row_id).cast("string"))).alias("k"), code_key(supersedes).alias("sup"))
    nodes = rows.groupBy("k").agg(F.min("row_id").alias("node"))
    refs = rows.filter(F.col("sup").isNotNull() & (F.col("sup") != F.col("k"))).select("k", "sup").distinct()
    links = refs.join(nodes, "k").withColumnRenamed("node", "a").join(nodes.select(F.col("k").alias("sup"), F.col("node").alias("b")), "sup").select("a", "b")
    comp = connected_components(links)
    tops = nodes.join(comp, "node", "left").select("k", F.coalesce("component", "node").alias("lineage"))
    return rows.join(tops, "k").select("row_id", "lineage")


def valid_at(valid_from: Column, valid_to: Column, at: Column) -> Column:
    """Interval validity with NULL as unbounded, both ends included."""
    return (valid_from.isNull() | (valid_from <= at)) & (valid_to.isNull() | (valid_to >= at))
