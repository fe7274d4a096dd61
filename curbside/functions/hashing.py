"""Hashes which other engines can compute as well."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def seeded_digest(key: Column, seed: int) -> Column:
    """Hex text: a fixed pseudo-random order of the rows for a given seed."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))


def hash_bucket(key: Column, buckets: int, seed: int) -> Column:
    """Bucket 0..buckets-1, the same on every run, retry and engine."""
    head = F.conv(F.substring(seeded_digest(key, seed), 1, 8), 16, 10).cast("bigint")
    return (head % buckets).cast("int")
