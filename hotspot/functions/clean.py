"""Column expressions for typing and cleaning raw detections (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_DATE_RE = r"^\d{4}-\d{2}-\d{2}$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def coerce_numeric(c) -> Column:
    """Text or number -> double; blank, text and NaN become NULL (never fails under ANSI)."""
    d =F.trim(_c(c).cast("string")).try_cast("double")
    return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)


def nan_to_null(c) -> Column:
    c = _c(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def pad_time(c) -> Column:
    """'639' -> '0639' (text or integer input); anything but 1-4 digits -> NULL."""
    t = F.trim(_c(c).cast("string"))
    return F.when(t.rlike(r"^\d{1,4}$"), F.lpad(t, 4, "0"))


def parse_date(c) -> Column:
    """Row-wise date parser: ISO (optional time part), day-first 4-digit year, day-first
    2-digit year. Two-digit years pivot at 2070 (70..99 -> 19xx). Anything else -> NULL."""
    s = F.trim(_c(c).cast("string"))
    iso = F.try_to_date(s, "yyyy-MM-dd[ HH:mm:ss]")
    dmy4 = F.when(s.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(s, "d/M/yyyy"))
    dmy2 = F.when(s.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$"), F.try_to_date(s, "d/M/yy"))
    dmy2 = F.when(F.year(dmy2) >= 2070, F.add_months(dmy2, -1200)).otherwise(dmy2)
    return F.coalesce(F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), iso), dmy4, dmy2)


def build_obs_ts(date_col, time_col) -> Column:
    """acq_date (date) + acq_time ('HHMM') -> TIMESTAMP_NTZ; invalid time -> NULL."""
    v = pad_time(time_col).cast("int")
    hh, mm = F.floor(v / 100), F.pmod(v, F.lit(100))
    ok = v.isNotNull() & (hh < 24) & (mm < 60)
    return F.when(ok, F.timestamp_add("MINUTE", hh * 60 + mm, _c(date_col).cast("timestamp_ntz")))


def iso_date(c) -> Column:
    return F.date_format(_c(c), "yyyy-MM-dd")


def round_key(c, places: int = 4) -> Column:
    """Half-to-even rounding on the scaled value (matches numpy/pandas, not Spark round)."""
    scale = float(10**places)
    return F.rint(_c(c) * F.lit(scale)) / F.lit(scale)


def is_iso_text(c) -> Column:
    return F.trim(_c(c).cast("string")).rlike(ISO_DATE_RE)
