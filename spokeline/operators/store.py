"""Keyed stores as tables: upsert, delete, newest first, cached routes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table after `rows` replaced or joined those of the same key."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The table without these keys; absent keys are no error."""
    return table.join(keys.select(key), key, "left_anti")


def newest_first(saved: DataFrame) -> DataFrame:
    """Saved routes by creation, newest first; rows without it are not in the index. Ties: id descending."""
    return saved.where("created_at is not null").orderBy(F.desc("created_at"), F.desc("id"))


def savable(drafts: DataFrame) -> DataFrame:
    """Drafts that may be saved: two waypoints or more, a route, a name that is not blank (which is trimmed)."""
    return drafts.where((F.size("waypoints") >= 2) & F.col("route").isNotNull() & (F.trim("name") != "")).withColumn("name", F.trim("name"))


def refreshed(saved: DataFrame, fresh: DataFrame) -> DataFrame:
    """id, distance and status: a fresh result replaces the cached one, else the cache serves. saved: id, cached; fresh: id, fresh."""
    status = F.when(F.col("fresh").isNotNull(), "fresh").when(F.col("cached").isNotNull(), "cached").otherwise("unavailable")
    return saved.join(fresh, "id", "left").select("id", F.coalesce("fresh", "cached").alias("distance"), status.alias("status"))
