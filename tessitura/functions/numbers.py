"""Rounding and time helpers whose results do not depend on decimal print forms or the session time zone."""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def fixed(value: Column, digits: int) -> Column:
    """A number as text with fixed decimals, rounded half-even from its exact binary value."""
    pattern = "0." + "0" * digits if digits else "0"
    return F.call_function("format_number", value.cast("double"), F.lit(pattern))


def round_exact(value, digits: int) -> Column:
    """Nearest decimal of the exact binary value, ties to even (``bround`` rounds the shortest decimal form instead)."""
    value = F.col(value) if isinstance(value, str) else value
    finite = value.isNotNull() & ~F.isnan(value.cast("double")) & (F.abs(value.cast("double")) < 1e300)
    return F.when(finite, fixed(value, digits).cast("double")).otherwise(value.cast("double"))


def utc_micros(stamp: Column) -> Column:
    """Microseconds since the epoch of a time without zone, read as UTC."""
    return F.unix_micros(F.concat(stamp.cast("timestamp_ntz").cast("string"), F.lit("+00:00")).cast("timestamp"))


def seconds_of(samples: Column, rate: Column, cap: float | None = None, digits: int = 4) -> Column:
    """Seconds of a number of samples, at most ``cap``, rounded half-even; no samples or rate gives null."""
    seconds = F.try_divide(samples.cast("double"), rate.cast("double"))
    return round_exact(seconds if cap is None else F.when(seconds.isNotNull(), F.least(seconds, F.lit(float(cap)))), digits)
