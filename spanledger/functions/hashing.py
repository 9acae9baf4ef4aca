"""Deterministic sampling by hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucket(salt: str, id_: Column) -> Column:
    """The first four bytes of sha256(salt, NUL, id) as a number from 0 to below 1."""
    digest = F.sha2(F.concat(F.lit(salt), F.lit("\0"), id_.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(float(2**32))


def head_sampled(trace_id: Column, rate: float) -> Column:
    """By the first eight hex digits of the trace's id."""
    return F.conv(F.substring(trace_id, 1, 8), 16, 10).cast("long") / F.lit(float(0xFFFFFFFF)) < rate
