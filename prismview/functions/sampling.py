"""Samples of fixed size without replacement that do not depend on partitioning.

The order of rows is that of a digest of (seed, query, phase, stratum, row), so each
query and phase draws anew, a recomputed task draws the same rows, and the sample is
independent of the plan that it audits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sample_key(seed: int, query: int, phase: str, stratum: Column, row: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(query)), F.lit(phase), stratum.cast("string"), row.cast("string")))


def sample_pool(rows: DataFrame, size: int, seed: int, query: int, phase: str) -> DataFrame:
    """``size`` rows of the whole pool: a top-k without a full sort. ``rows``: ``row_id, stratum``."""
    keyed = rows.withColumn("sample_key", sample_key(seed, query, phase, F.lit(""), F.col("row_id")))
    return keyed.orderBy("sample_key", "row_id").limit(size).drop("sample_key")


def sample_strata(rows: DataFrame, sizes: dict[str, int], seed: int, query: int, phase: str) -> DataFrame:
    """A sample of its own size from each stratum, in one job.

    The first ranking is by salted part of a stratum, so that one that holds most rows
    leaves its tasks as candidates only; at most ``size`` of each part can be drawn.
    """
    if not sizes:
        return rows.limit(0)
    size = F.coalesce(F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])[F.col("stratum")], F.lit(0))
    keyed = rows.withColumn("sample_key", sample_key(seed, query, phase, F.col("stratum"), F.col("row_id"))).withColumn("size", size)
    part = F.pmod(F.xxhash64("row_id"), F.lit(64))
    first = F.row_number().over(Window.partitionBy("stratum", part).orderBy("sample_key", "row_id"))
    last = F.row_number().over(Window.partitionBy("stratum").orderBy("sample_key", "row_id"))
    some = keyed.filter(F.col("stratum").isin(list(sizes))).withColumn("first", first).filter(F.col("first") <= F.col("size"))
    return some.withColumn("last", last).filter(F.col("last") <= F.col("size")).drop("sample_key", "size", "first", "last")
