"""Keyed upsert, delete, replace and conditional update, shared by every stored table.

Tables are immutable files, so each mutation is a DataFrame of the new state:
the kept rows of the base (anti join) plus the new rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(batch: DataFrame, keys: Sequence[str], order: str | Column) -> DataFrame:
    """Last row of each key by ``order``.

    ``row_number() = 1`` is planned with a group limit before the shuffle: a
    map task sends at most one row per key, so a hot key costs one row per task.
    """
    order = F.col(order) if isinstance(order, str) else order
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order.desc()))
    return batch.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def upsert(base: DataFrame, batch: DataFrame, keys: Sequence[str], order: str | Column | None = None) -> DataFrame:
    """Insert or replace whole rows by key; within one batch the last row by ``order`` wins."""
    latest = batch if order is None else latest_per_key(batch, keys, order)
    latest = latest.select(*base.columns)
    return delete(base, latest, keys).unionByName(latest)


def upsert_keeping(base: DataFrame, batch: DataFrame, keys: Sequence[str], keep_on_update: Sequence[str]) -> DataFrame:
    """Upsert in which the ``keep_on_update`` columns keep the stored value of an existing row.

    ``batch`` holds one row per key.
    """
    keys = list(keys)
    old = base.select(*keys, F.struct(*[F.col(c) for c in base.columns if c not in keys]).alias("_old"))
    new = batch.select(*keys, F.struct(*[F.col(c) for c in base.columns if c not in keys]).alias("_new"))
    joined = old.join(new, keys, "full_outer")

    def chosen(c: str) -> Column:
        first, second = ("_old", "_new") if c in keep_on_update else ("_new", "_old")
        return F.when(F.col(first).isNotNull(), F.col(first)[c]).otherwise(F.col(second)[c]).alias(c)

    return joined.select(*[F.col(c) if c in keys else chosen(c) for c in base.columns])


def delete(base: DataFrame, ids: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not listed; unknown keys are ignored."""
    return base.join(ids.select(*keys).distinct(), list(keys), "left_anti").select(*base.columns)


def delete_flags(base: DataFrame, ids: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct listed keys with ``deleted`` = the key was stored."""
    keys = list(keys)
    asked = ids.select(*keys).distinct()
    stored = base.select(*keys).distinct().withColumn("deleted", F.lit(True))
    return asked.join(stored, keys, "left").withColumn("deleted", F.coalesce("deleted", F.lit(False)))


def replace_groups(base: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Replace all rows of the groups that occur in ``batch`` (a session's files, say)."""
    return delete(base, batch, keys).unionByName(batch.select(*base.columns))


def lookup(stored: DataFrame, ids: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per distinct asked key with the stored columns (NULL when absent) and ``found``."""
    keys = list(keys)
    marked = stored.withColumn("found", F.lit(True))
    asked = ids.select(*keys).distinct()
    return asked.join(marked, keys, "left").withColumn("found", F.coalesce("found", F.lit(False)))
