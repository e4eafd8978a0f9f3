"""Reproducible splits and samples by key hash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import col


def bucket(key: Column | str) -> Column:
    """The MD5 of a text as a 128-bit number, modulo 10,000.  Halves of 64 bits are taken apart: 2^64 leaves 1616."""
    md5 = F.md5(col(key).cast("binary"))
    half = lambda at: F.pmod(F.conv(F.substring(md5, at, 16), 16, 10).cast("decimal(20,0)"), F.lit(10_000)).cast("int")
    return F.pmod(half(1) * 1616 + half(17), F.lit(10_000))


def split_of(key: Column | str, val_frac: float = 0.2) -> Column:
    return F.when(bucket(key) < int(val_frac * 10_000), "val").otherwise("train")


def sampled(key: Column | str, frac: float, seed: int = 0) -> Column:
    """Whether a key belongs to a sample of about ``frac``; by key, so the order of rows doesn't matter.  Each seed has
    a sample of its own."""
    return bucket(F.concat(F.lit(f"sample#{seed}#" if seed else "sample#"), col(key))) < int(frac * 10_000)
