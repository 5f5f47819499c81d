"""Deterministic range shards: the same rows are cut at the same keys in every run."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys of a sample, chosen by their hash, from which the cuts are taken: so many for each shard, at least `LEAST` in all, and no more
#: than `MOST` unless that leaves less than two a shard. A sampled key is 16 bytes on the driver, and a cut 8.
PER_SHARD, LEAST, MOST = 16, 20_000, 2_000_000


def sample_size(shards: int) -> int:
    return max(LEAST, min(PER_SHARD * shards, MOST), 2 * shards)


def cuts(rows: DataFrame, key: str, weight: Column, target: int) -> list[int]:
    """Ascending keys at which shards of about `target` weight begin; the first shard has no cut. A key is never split."""
    n, total = rows.agg(F.count(F.lit(1)), F.sum(weight.cast("long"))).first()
    shards = math.ceil((total or 0) / target)
    if shards < 2:
        return []
    sample = rows.where(F.col(key).isNotNull())
    size = sample_size(shards)
    if n > size:
        sample = sample.where(F.pmod(F.xxhash64(key), F.lit(n // size + 1)) == 0)
    summed = F.coalesce(F.sum(weight.cast("long")), F.lit(0)).alias("weight")
    found = sample.groupBy(F.col(key).cast("long").alias("key")).agg(summed).toArrow()
    if not found.num_rows:
        return []
    order = np.argsort(found["key"].to_numpy())
    keys, weights = (found[name].to_numpy()[order] for name in ("key", "weight"))
    before = np.cumsum(weights) - weights
    at = np.searchsorted(before, np.arange(1, shards) * (int(weights.sum()) / shards))
    return sorted({int(keys[k]) for k in at if 0 < k < len(keys)})


def shard(key: Column, bounds: list[int]) -> Column:
    """The number of the shard of a key: how many cuts are not above it; 0 without a key."""
    edges = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def number(keys: pd.Series, null: pd.Series) -> pd.Series:
        found = np.searchsorted(edges, keys.to_numpy(np.int64), side="right")
        return pd.Series(np.where(null.to_numpy(bool), 0, found).astype(np.int32))

    return number(F.coalesce(key.cast("long"), F.lit(0)), key.isNull())


def by_shard(rows: DataFrame, key: str, weight: Column, target: int, order: list) -> DataFrame:
    """The rows with `_shard`, one partition per shard, sorted by `order` inside it."""
    bounds = cuts(rows, key, weight, target)
    return (
        rows.withColumn("_shard", shard(F.col(key), bounds))
        .repartitionById(len(bounds) + 1, F.col("_shard")).sortWithinPartitions("_shard", *order)
    )
