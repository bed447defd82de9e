"""Column expressions for counts, shares, ranks and windows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Order of the domain's labels.
CONFIDENCE = {"HIGH": 1, "MED": 2, "LOW": 3}
PROVENANCE = {"EXPLICIT": 1, "MANUAL": 2, "INFERRED": 3}
PRIORITY = {"Highest": 1, "High": 2, "Medium": 3, "Low": 4, "Lowest": 5}
RELIABLE = ("HIGH", "MED")


def rank_of(col: str, ranks: dict[str, int], other: int | None = None) -> Column:
    """The rank of a label; other labels (and null) get `other`, or null."""
    out = F.lit(other).cast("int")
    for label, rank in ranks.items():
        out = F.when(F.col(col) == label, F.lit(rank)).otherwise(out)
    return out


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole to one place, half up; null if whole is 0."""
    return F.floor((2000 * part + whole) / F.nullif(2 * whole, F.lit(0))).cast("double") / 10


def n_where(cond: Column | str) -> Column:
    return F.count_if(F.expr(cond) if isinstance(cond, str) else cond)


def moment(as_of: dt.datetime) -> Column:
    """as_of as a timestamp without zone, as the tables have them."""
    return F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def since(col: str, as_of: dt.datetime, days: int) -> Column:
    """Within `days` days before as_of or later; null is not."""
    return F.col(col) >= moment(as_of - dt.timedelta(days=days))
