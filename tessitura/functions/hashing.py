"""Deterministic pseudo-random draws: every draw is a hash of its key, so results never depend on partitioning."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

TWO_64 = float(2**64)


def _joined(parts) -> Column:
    return F.concat_ws(":", *[(p if isinstance(p, Column) else F.lit(str(p))).cast("string") for p in parts])


def unit_hash(*parts) -> Column:
    """SHA-256 of the ``:``-joined parts, first 8 bytes over 2^64: uniform in [0, 1]."""
    return F.conv(F.substring(F.sha2(_joined(parts), 256), 1, 16), 16, 10).cast("double") / F.lit(TWO_64)


def int_hash(*parts) -> Column:
    """First 4 bytes of the same digest as a non-negative integer."""
    return F.conv(F.substring(F.sha2(_joined(parts), 256), 1, 8), 16, 10).cast("bigint")


def hex_hash(*parts) -> Column:
    """The digest itself: sorting by it is sorting by ``unit_hash`` without its rounding to 53 bits."""
    return F.sha2(_joined(parts), 256)


def hash_bucket(digest: Column, digits: int = 4) -> Column:
    """Leading hex digits: a monotone, evenly filled bucket of the digest order (16^digits buckets)."""
    return F.substring(digest, 1, digits)
