"""Changes of stored tables as functions from old to new rows; the caller writes the result in place of the old table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def replace_subset(table: DataFrame, stale: Column, fresh: DataFrame) -> DataFrame:
    """The table without its stale rows (a null verdict keeps a row), with the fresh ones."""
    return table.where(~F.coalesce(stale, F.lit(False))).unionByName(fresh)


def flag_outside(table: DataFrame, listed: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """Set ``flag`` of every row to whether its key is not listed."""
    on = listed.select(*keys).distinct().withColumn("_listed", F.lit(True))
    return table.drop(flag).join(on, keys, "left").withColumn(flag, F.col("_listed").isNull()).drop("_listed")


def without(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not among those gone: of a parent, or of its children by the parent's key."""
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")


def patch(table: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with the values of their change; a null change leaves a value, an empty list is a value. One change a key."""
    new = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    out = table.join(new, key, "left")
    return out.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in table.columns])


def upsert(table: DataFrame, incoming: DataFrame, key: list[str], order: str) -> DataFrame:
    """The newest incoming row of a key in place of the stored one; other stored rows stay."""
    newest = F.row_number().over(Window.partitionBy(*key).orderBy(F.col(order).desc()))
    fresh = incoming.withColumn("_r", newest).where("_r = 1").select(*table.columns)
    return table.join(fresh.select(*key), key, "left_anti").select(*table.columns).unionByName(fresh)


def better_measured(stored: DataFrame, incoming: DataFrame, key: str, samples: str) -> DataFrame:
    """Per key the row with more samples; the stored one on ties."""
    rows = stored.withColumn("_held", F.lit(1)).unionByName(incoming.withColumn("_held", F.lit(0)))
    best = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in stored.columns if c != key]), F.struct(samples, "_held")).alias("_b"))
    return best.select(key, "_b.*").select(*stored.columns)


def loss_card(focus: DataFrame, reference: DataFrame, keys: list[str], corner: str, time: str) -> DataFrame:
    """Corners with ``lost`` against the reference's corner and ``place``: largest loss first, those without one last, by corner."""
    base = reference.select(*keys, corner, F.col(time).alias("_base"))
    rows = focus.join(base, [*keys, corner], "left").withColumn("lost", F.col(time) - F.col("_base")).drop("_base")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("lost").desc_nulls_last(), corner)))
