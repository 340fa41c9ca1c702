"""Calendar column expressions: anchored weeks, months, period fractions and ticks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _anchor(a) -> Column:
    return F.lit(a) if isinstance(a, int) else _c(a)


def week_start(d, anchor=3) -> Column:
    """Start of the week containing d; weeks begin on weekday `anchor` (Monday = 0)."""
    return F.date_sub(_c(d), F.pmod(F.weekday(_c(d)) - _anchor(anchor), F.lit(7)))


def first_full_week(start, anchor=3) -> Column:
    """First week start on or after `start` (the first complete week of a period)."""
    return F.date_add(_c(start), F.pmod(_anchor(anchor) - F.weekday(_c(start)), F.lit(7)))


def month_start(d) -> Column:
    return F.trunc(_c(d), "MM")


def month_end(d) -> Column:
    return F.last_day(_c(d))


def seconds_between(a, b) -> Column:
    """Whole seconds from a to b (works on TIMESTAMP_NTZ, independent of the session zone)."""
    return F.timestamp_diff("SECOND", _c(a), _c(b))


def hours_between_dates(a, b) -> Column:
    return (F.datediff(_c(b), _c(a)) * 24).cast("double")


def time_fraction(ts, start, end) -> Column:
    """Position of ts in [start, end] as 0..1 (clamped); NULL for an empty period."""
    span = seconds_between(start, end).cast("double")
    f = seconds_between(start, ts).cast("double") / F.when(span > 0, span)
    return F.least(F.greatest(f, F.lit(0.0)), F.lit(1.0))


def colour_class(fraction, stops: int = 5) -> Column:
    """Index of the colour stop at or below the fraction (0 .. stops-1)."""
    return F.floor(_c(fraction) * F.lit(stops - 1)).cast("int")


def period_ticks(start, end, n: int = 6) -> Column:
    """Array of n evenly spaced timestamps from start to end (both included)."""
    span = seconds_between(start, end).cast("double")
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: F.timestamp_add(
            "SECOND", F.floor(span * i / F.lit(float(n - 1))).cast("bigint"), _c(start)
        ),
    )


def day_label(d) -> Column:
    return F.date_format(_c(d), "dd/MM/yyyy")


def month_label(d) -> Column:
    return F.date_format(_c(d), "MMMM yyyy")
