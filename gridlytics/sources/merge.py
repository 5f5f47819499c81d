"""Merges expressed as joins and unions: the result is a new DataFrame to be written by the caller.

Keys are joined with plain equality, so NULL keys never match, as in SQL ``MERGE``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlytics.functions.columns import all_of, any_of


def _assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fail the job, inside the plan, when a non-NULL key occurs twice in the updates."""
    known = all_of(F.col(k).isNotNull() for k in keys)
    packed = F.struct(*[F.col(c) for c in df.columns])
    grouped = df.filter(known).groupBy(*keys).agg(F.any_value(packed).alias("_row"), F.count("*").alias("_n"))
    message = F.concat(F.lit("several update rows for key "), F.to_json(F.struct(*keys)))
    checked = grouped.withColumn("_row", F.when(F.col("_n") > 1, F.raise_error(message)).otherwise(F.col("_row")))
    return checked.select("_row.*").unionByName(df.filter(~known))


def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Replace matched rows, insert the others.

    ``columns`` limits which columns an update may change; the rest keep the target's value on a match.
    """
    updates = _assert_unique(updates, keys)
    if columns is None:
        return target.join(updates.select(*keys), list(keys), "left_anti").unionByName(updates)
    t, u = target.alias("t"), updates.withColumn("_hit", F.lit(True)).alias("u")
    same = all_of(F.col(f"t.{k}") == F.col(f"u.{k}") for k in keys)
    kept = t.join(u, same, "left").select(
        *[
            (F.when(F.col("u._hit"), F.col(f"u.{c}")).otherwise(F.col(f"t.{c}")) if c in columns else F.col(f"t.{c}")).alias(c)
            for c in target.columns
        ]
    )
    fresh = updates.join(target.select(*keys), list(keys), "left_anti")
    return kept.unionByName(fresh.select(*target.columns))


def insert_new(target: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Append only the rows whose key the target does not hold yet."""
    return target.unionByName(rows.join(target.select(*keys), list(keys), "left_anti"))


def scd2_merge(
    dim: DataFrame,
    snapshot: DataFrame,
    key: str,
    tracked: Sequence[str],
    as_of: Column,
    registered: str = "registered_at",
    current: str = "is_current",
) -> DataFrame:
    """Close the current row of a changed key, open a new one, open first-seen keys; running it twice changes nothing.

    The comparison is null-safe, so a value turning NULL also counts as a change.
    """
    snapshot = _assert_unique(snapshot, [key])
    open_rows = dim.filter(F.col(current))
    now = snapshot.select(key, *[F.col(c).alias(f"_new_{c}") for c in tracked], F.lit(True).alias("_seen"))
    changed = any_of(~F.col(c).eqNullSafe(F.col(f"_new_{c}")) for c in tracked)
    kept = (
        open_rows.join(now, key, "left")
        .withColumn(current, ~(F.coalesce(F.col("_seen"), F.lit(False)) & changed))
        .select(*dim.columns)
    )
    before = open_rows.select(key, *[F.col(c).alias(f"_old_{c}") for c in tracked], F.lit(True).alias("_known"))
    moved = F.col("_known").isNull() | any_of(~F.col(c).eqNullSafe(F.col(f"_old_{c}")) for c in tracked)
    opened = (
        snapshot.join(before, key, "left")
        .filter(moved)
        .withColumn(registered, as_of)
        .withColumn(current, F.lit(True))
        .select(*dim.columns)
    )
    return dim.filter(~F.coalesce(F.col(current), F.lit(False))).unionByName(kept).unionByName(opened)


def append_version(history: DataFrame, new: DataFrame, as_of: Column, registered: str = "registered_at", current: str = "is_current") -> DataFrame:
    """Mark the whole history as superseded and append a new current set."""
    old = history.withColumn(current, F.lit(False))
    fresh = new.withColumn(registered, as_of).withColumn(current, F.lit(True))
    return old.unionByName(fresh.select(*old.columns))
