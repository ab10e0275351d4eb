"""Column expressions over time limits ``HH:MM:SS`` (hours may exceed 24) and ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LIMIT = r"^[0-9]+:[0-9]{1,2}:[0-9]{1,2}$"


def _part(limit: Column, k: int) -> Column:
    return F.when(limit.rlike(_LIMIT), F.get(F.split(limit, ":"), F.lit(k)).try_cast("long"))


def minutes(limit: Column) -> Column:
    """Whole minutes; seconds are left out.  Null for other formats, days included."""
    return _part(limit, 0) * 60 + _part(limit, 1)


def seconds(limit: Column) -> Column:
    return minutes(limit) * 60 + _part(limit, 2)


def scale(limit: Column) -> Column:
    """Partition scale by minutes: up to 60 small, 120 medium, 240 large, else x-large."""
    m = minutes(limit)
    return F.when(m <= 60, "small").when(m <= 120, "medium").when(m <= 240, "large").when(m.isNotNull(), "x-large")


def margin(limit: Column) -> Column:
    """Seconds before the limit at which to warn: a hundredth of it, 30 at least."""
    return F.greatest(F.floor(seconds(limit) / 100), F.lit(30)).cast("long")


def warning_at(start: Column, limit: Column) -> Column:
    return F.timestamp_add("SECOND", (seconds(limit) - margin(limit)), start)


def older_than(moment: Column, as_of: Column, hours: int = 24) -> Column:
    return moment < as_of - F.expr(f"INTERVAL {hours} HOURS")


def clock(moment: Column) -> Column:
    """Time of day as ``HH:MM:SS``."""
    return F.date_format(moment, "HH:mm:ss")
