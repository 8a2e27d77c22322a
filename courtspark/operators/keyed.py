"""Keyed picks and keyed writes: latest/first by key, upserts, anti-set prunes, pair keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per key under `order`.

    row_number() = 1 lets Spark limit each group before the shuffle (WindowGroupLimit), so a key that holds a third of
    all rows sends one row per input partition, not all of them. Null keys form a group of their own.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def top_n_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank_in_group", F.row_number().over(w)).where(F.col("rank_in_group") <= n)


def append_first_wins(target: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Insert-or-ignore: stored rows stay, of several incoming rows with one key the first under `order` enters.

    Rows with a null in a key never conflict, as with a SQL unique constraint.
    """
    has_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    fresh = latest_by_key(incoming.where(~has_null), keys, order).join(target.select(*keys).distinct(), list(keys), "left_anti")
    return target.unionByName(fresh.select(*target.columns)).unionByName(incoming.where(has_null).select(*target.columns))


def upsert_last_wins(target: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[Column], update: Sequence[str] | None = None) -> DataFrame:
    """Insert-or-update: the newest row per key wins; with `update` only those columns are replaced.

    `order` ranks incoming rows of one key. One shuffle on the key; the full outer join keeps untouched rows.
    """
    newest = latest_by_key(incoming, keys, order)
    both = target.withColumn("_t", F.lit(True)).alias("t").join(newest.withColumn("_i", F.lit(True)).alias("i"), list(keys), "full_outer")
    replaced = set(update if update is not None else [c for c in target.columns if c not in keys])
    cols = [F.col(k) for k in keys]
    for c in target.columns:
        if c not in keys:
            pick = F.col("i._i").isNotNull() if c in replaced else F.col("t._t").isNull()
            cols.append(F.when(pick, F.col(f"i.{c}")).otherwise(F.col(f"t.{c}")).alias(c))
    return both.select(*cols).select(*target.columns)


def prune_unseen(stored: DataFrame, seen: DataFrame, keys: Sequence[str], in_scope: Column) -> DataFrame:
    """Drop stored rows inside `in_scope` whose key was not seen; a run that saw nothing prunes nothing."""
    if seen.isEmpty():
        return stored
    kept = stored.where(in_scope).join(seen.select(*keys).distinct(), list(keys), "left_semi")
    return stored.where(~F.coalesce(in_scope, F.lit(False))).unionByName(kept)


def pair_key(a: Column, b: Column) -> list[Column]:
    """Order-free key of two ids."""
    return [F.least(a, b).alias("pair_low"), F.greatest(a, b).alias("pair_high")]


def anti_on(df: DataFrame, other: DataFrame, on: Sequence[str], null_safe: Sequence[str] = ()) -> DataFrame:
    return df.join(other, _condition(df, other, on, null_safe), "left_anti")


def semi_on(df: DataFrame, other: DataFrame, on: Sequence[str], null_safe: Sequence[str] = ()) -> DataFrame:
    return df.join(other, _condition(df, other, on, null_safe), "left_semi")


def _condition(df: DataFrame, other: DataFrame, on: Sequence[str], null_safe: Sequence[str]) -> Column:
    cond = None
    for c in on:
        one = df[c].eqNullSafe(other[c]) if c in null_safe else df[c] == other[c]
        cond = one if cond is None else cond & one
    return cond
