"""Labelled rows drawn at random for a model that is fitted on the driver."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F


def share(count: int, size: int, rows: int, most: int) -> Fraction:
    """Share of ``count`` rows of ``size`` bytes in all at which ``rows`` rows and ``most`` bytes are expected at most."""
    return min(Fraction(1), Fraction(rows, max(1, count)), Fraction(most, max(1, size)))


def threshold(part: Fraction) -> int:
    """The signed 64-bit hash below which a share of all hashes lies; at any share above 2^-64 some hashes do."""
    return min(2**63 - 1, int(part * 2**64) - 2**63)


def admitted(key: str, salt: str, part: Fraction) -> Column:
    """Is a row among a share of all rows, by a hash of its key and no other chance?"""
    return F.lit(True) if part >= 1 else F.xxhash64(key, F.lit(salt)) < F.lit(threshold(part))
