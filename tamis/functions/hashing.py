"""Stable identifiers, hash splits and hash-ordered sampling; the same on every run and partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent_bucket(key: Column) -> Column:
    """The 128-bit md5 of the key modulo 100, from its four 32-bit quarters (2**32 is 96 modulo 100, and so on)."""
    h = F.md5(key)
    quarter = lambda i: F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long")
    return ((quarter(0) * 36 + quarter(1) * 16 + quarter(2) * 96 + quarter(3)) % 100).cast("int")


def hash_split(key: Column, train: float = 0.8, val: float = 0.1) -> Column:
    """train, val or test by the key's bucket; the cuts are whole percents."""
    if train <= 0 or val < 0 or train + val > 1:
        raise ValueError("shares must be positive and add up to 1 at most")
    b, first, second = percent_bucket(key), int(train * 100), int((train + val) * 100)
    return F.when(b < first, "train").when(b < second, "val").otherwise("test")


def stable_id(prefix: Column, path: Column) -> Column:
    return F.concat(prefix, F.lit("_"), F.substring(F.sha1(path), 1, 12))


def output_name(path: Column) -> Column:
    """A file's stem and eight characters of its path's md5: distinct for equal stems in different folders."""
    return F.concat(F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1), F.lit("_"), F.substring(F.md5(path), 1, 8))


def sample_order(seed: int, key: Column) -> Column:
    """Sort key of a seeded shuffle."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
