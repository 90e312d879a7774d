"""Time as integers: microseconds since 1970-01-01, free of any session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND, MINUTE, HOUR, DAY = 1_000_000, 60_000_000, 3_600_000_000, 86_400_000_000
FIVE_MINUTES = 5 * MINUTE


def micros(ts: str) -> Column:
    """Microseconds of a TIMESTAMP_NTZ column."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")


def floor_to(t: Column | str, size: int) -> Column:
    """Start of the bucket of ``size`` microseconds that holds ``t``."""
    c = F.col(t) if isinstance(t, str) else t
    return c - F.pmod(c, F.lit(size))


def day_number(t: Column | str) -> Column:
    c = F.col(t) if isinstance(t, str) else t
    return F.floor((c - F.pmod(c, F.lit(DAY))) / DAY).cast("long")
