"""Equality and differences of two versions of a table by digests of buckets.

Rows are dealt to buckets by a hash of their key; a bucket's digest is a count and sums of row hashes, which do not depend on
the order of rows, so it is added up before the shuffle and each version is read once. Versions are compared by their
digests, a row a bucket; only the rows of buckets that differ are read again and joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets; what a comparison hands to the driver is at most as many numbers.
BUCKETS = 1024
_SEEDS = (11, 20240229)


def bucket_of(keys: Sequence[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _row_hashes(columns: Sequence[str]) -> list[Column]:
    """Four numbers of 32 bits of a row; a null and its place count."""
    marks = F.concat(*(F.when(F.col(c).isNull(), "1").otherwise("0") for c in columns))
    whole = [F.xxhash64(F.lit(seed), marks, *columns) for seed in _SEEDS]
    return [x for h in whole for x in (F.shiftrightunsigned(h, 32), h.bitwiseAND(0xFFFFFFFF))]


def digests(rows: DataFrame, keys: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """bucket, n, d0 to d3 of the buckets that have rows."""
    columns = sorted(rows.columns)
    named = rows.select(bucket_of(keys, buckets).alias("bucket"), *(h.alias(f"d{i}") for i, h in enumerate(_row_hashes(columns))))
    return named.groupBy("bucket").agg(F.count("*").alias("n"), *(F.sum(F.col(f"d{i}").cast("decimal(38,0)")).alias(f"d{i}") for i in range(4)))


def changed_buckets(a: DataFrame, b: DataFrame, keys: Sequence[str], buckets: int = BUCKETS) -> list[int]:
    """Buckets in which two versions of the same columns differ."""
    if sorted(a.columns) != sorted(b.columns):
        raise ValueError(f"versions have other columns: {sorted(set(a.columns) ^ set(b.columns))}")
    told = digests(a, keys, buckets).unionByName(digests(b.select(*a.columns), keys, buckets))
    parts = [c for c in told.columns if c != "bucket"]
    same = F.count("*") == 2
    for c in parts:
        same = same & (F.min(c) == F.max(c))
    return sorted(r["bucket"] for r in told.groupBy("bucket").agg(same.alias("same")).where(~F.col("same")).collect())  # BUCKETS numbers at most


def narrowed(a: DataFrame, b: DataFrame, keys: Sequence[str], buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame] | None:
    """The rows of both versions in buckets that differ; None where none does."""
    found = changed_buckets(a, b, keys, buckets)
    if not found:
        return None
    here = bucket_of(keys, buckets).isin(found) if len(found) < buckets else F.lit(True)
    return a.where(here), b.select(*a.columns).where(here)


def same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> bool:
    """Whether two versions have equal rows, each as often; one pass over each."""
    return not changed_buckets(a, b, keys)


def differing(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that one version has more often than the other, as often as that, with ``side``: a or b."""
    few = narrowed(a, b, keys)
    if few is None:
        return a.limit(0).withColumn("side", F.lit("a"))
    x, y = few
    return x.exceptAll(y).withColumn("side", F.lit("a")).unionByName(y.exceptAll(x).withColumn("side", F.lit("b")))
