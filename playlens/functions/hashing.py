"""Reproducible pseudo-random numbers.

A row's draw depends on its key and the seed only: it is the same after a retry, on any
partitioning and on any cluster, which `rand()` cannot promise.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HASH_BITS = 60


def draw(key: Column, seed: int | str) -> Column:
    """Integer in [0, 2^60) from the leading 15 hex digits of md5("key:seed")."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
