"""Date/time helpers as Column expressions (session time zone is UTC).

Canonical timestamps in this library are TIMESTAMP_NTZ holding UTC wall time.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from airseries.functions.constants import DAY_EN_TO_FR, DAY_ORDER_FR, NOTEBOOK_WEEKEND_LABELS, WEEKEND_LABELS


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_ntz(c) -> Column:
    return _col(c).cast("timestamp_ntz")


def floor_hour(c) -> Column:
    """date_trunc('hour') kept as TIMESTAMP_NTZ."""
    return F.date_trunc("hour", _col(c)).cast("timestamp_ntz")


def floor_day(c) -> Column:
    return F.date_trunc("day", _col(c)).cast("timestamp_ntz")


def floor_month(c) -> Column:
    return F.date_trunc("month", _col(c)).cast("timestamp_ntz")


def week_ending_monday(c) -> Column:
    """Label of the W-MON bucket: Tuesday 00:00 .. Monday 23:59 -> that Monday (DATE)."""
    return F.next_day(F.date_sub(F.to_date(_col(c)), 1), "MON")


def parse_iso(c, tolerant: bool = True) -> Column:
    """ISO-8601 text with optional fraction and offset -> UTC TIMESTAMP_NTZ."""
    fn = F.try_to_timestamp if tolerant else F.to_timestamp
    return fn(_col(c)).cast("timestamp_ntz")


def from_unix_seconds(c) -> Column:
    return F.timestamp_seconds(_col(c)).cast("timestamp_ntz")


def hour_of_day(c) -> Column:
    return F.hour(_col(c))


def day_name(c) -> Column:
    """Full English day name (Monday..Sunday)."""
    return F.date_format(_col(c), "EEEE")


def weekday_mon0(c) -> Column:
    """Day of week with Monday = 0."""
    return F.weekday(_col(c))


def period_label(c, vocabulary: str = "series") -> Column:
    """X25: 'weekend' / 'semaine' (series) or 'Week-end' / 'Semaine' (notebook)."""
    weekend, weekday = WEEKEND_LABELS if vocabulary == "series" else NOTEBOOK_WEEKEND_LABELS
    return F.when(F.weekday(_col(c)) >= 5, F.lit(weekend)).otherwise(F.lit(weekday))


def is_weekend(c) -> Column:
    return F.weekday(_col(c)) >= 5


def day_fr(day_name_col) -> Column:
    """English day name -> short French label (unmatched -> NULL)."""
    pairs = []
    for k, v in DAY_EN_TO_FR.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.element_at(F.create_map(*pairs), _col(day_name_col))


def day_rank_fr(day_fr_col) -> Column:
    """1-based position in the Monday-first order (0 when absent)."""
    return F.array_position(F.array(*[F.lit(d) for d in DAY_ORDER_FR]), _col(day_fr_col))


def midpoint(a, b) -> Column:
    """Midpoint of two timestamps at microsecond precision (floor)."""
    ma = F.unix_micros(_col(a).cast("timestamp"))
    mb = F.unix_micros(_col(b).cast("timestamp"))
    return F.timestamp_micros(F.floor((ma + mb) / F.lit(2)).cast("bigint")).cast("timestamp_ntz")


def day_month_label(c) -> Column:
    return F.date_format(_col(c), "dd/MM")


def day_month_year_label(c) -> Column:
    return F.date_format(_col(c), "dd/MM/yyyy")
