"""Buddhist Era years in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def be_year(date: Column) -> Column:
    """The year of a DD/MM/YYYY text in the Buddhist Era, between 2500 and 2600; NULL otherwise."""
    y = F.regexp_extract(date, r"^\s*\d{1,2}/\d{1,2}/(\d{4})\s*$", 1).try_cast("int")
    return F.when(y.between(2500, 2600), y)


def as_of_year(text: Column) -> Column:
    """The first year 25xx that a text mentions, not part of a longer number."""
    return F.regexp_extract(text, r"(^|[^0-9])(25[0-9]{2})([^0-9]|$)", 2).try_cast("int")
