"""Value semantics that several operators share: null-aware exclusion, two clocks, elapsed days, blanks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The instant that event-based and order-based queries take for now.
AS_OF = "2024-01-31 00:00:00"
AS_OF_ORDERS = "2001-08-01"
LOCAL_ZONE = "America/New_York"


def is_not(c: str | Column, *values) -> Column:
    """Exclusion that keeps nulls: neither of ``values``."""
    c = F.col(c) if isinstance(c, str) else c
    return reduce(lambda a, b: a & b, (~c.eqNullSafe(F.lit(v)) for v in values))


def icontains(c: str | Column, part: str | Column) -> Column:
    return F.lower(c).contains(F.lower(F.lit(part) if isinstance(part, str) else part))


def iequals(c: str | Column, value: str) -> Column:
    return F.lower(c) == value.lower()


def iendswith(c: str | Column, end: str) -> Column:
    return F.lower(c).endswith(end.lower())


def blank_to_null(c: str | Column) -> Column:
    """NULL for null, empty and white-space strings."""
    return F.nullif(F.trim(c), F.lit(""))


def local_date(ts: str | Column, zone: str = LOCAL_ZONE) -> Column:
    """Calendar date of an instant in a zone; the session's zone is UTC."""
    return F.to_date(F.from_utc_timestamp(ts, zone))


def elapsed_days(since: str | Column, as_of: Column) -> Column:
    """Whole periods of 24 hours, not a difference of calendar days."""
    since = F.col(since) if isinstance(since, str) else since
    return F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(since)) / 86400)


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")
