"""As-of and interval joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtspark.operators.keyed import latest_by_key

SHARD_DAYS = 64


def latest_before(left: DataFrame, right: DataFrame, key: str, left_day: str, right_day: str, values: Sequence[str], order: Sequence[str] = (), shard_days: int = SHARD_DAYS) -> DataFrame:
    """`left` with the `values` of the latest right row on or before its day (null where none), in a struct `asof`.

    Both sides are laid in one order per (key, shard) and the last right row is carried down; earlier shards contribute
    one pre-aggregated row. No join on an inequality, and no key has to fit in one task. Several right rows on one day:
    the greatest by `order`, then by the values. Rows with a null key or day get null.
    """
    cols = left.columns
    version = F.struct(F.col(right_day), *[F.col(c) for c in [*order, *[v for v in values if v not in order]] if c != right_day])
    day = lambda c: F.unix_date(F.col(c).cast("date"))
    l0 = left.select(F.struct(*cols).alias("_l"), F.col(key).alias("_k"), day(left_day).alias("_d"))
    r0 = right.where(F.col(key).isNotNull() & F.col(right_day).isNotNull()).select(F.col(key).alias("_k"), day(right_day).alias("_d"), version.alias("_r"))
    shard = F.floor(F.col("_d") / shard_days).cast("int").alias("_s")
    ok = l0.where("_k is not null and _d is not null")
    per = r0.select("_k", shard, "_r").unionByName(ok.select("_k", shard).distinct(), allowMissingColumns=True).groupBy("_k", "_s").agg(F.max("_r").alias("_r"))
    w = Window.partitionBy("_k").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    carried = per.select("_k", "_s", F.max("_r").over(w).alias("_r")).where("_r is not null").withColumn("_d", F.lit(-(2**31)).cast("int"))
    laid = carried.withColumn("_side", F.lit(0)).unionByName(r0.select("_k", shard, "_r", "_d", F.lit(0).alias("_side"))).unionByName(ok.select("_k", shard, "_d", F.lit(1).alias("_side"), "_l"), allowMissingColumns=True)
    upto = Window.partitionBy("_k", "_s").orderBy("_d", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = laid.select("_l", "_side", F.max("_r").over(upto).alias("asof")).where("_side = 1")
    out = out.unionByName(l0.where("_k is null or _d is null").select("_l", F.lit(1).alias("_side")), allowMissingColumns=True)
    return out.select(*[F.col("_l").getField(c).alias(c) for c in cols], "asof")


def interval_pick_one(left: DataFrame, right: DataFrame, on: Sequence[str], within: Column, left_key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Left join on equal keys with a band condition, one right row per left row by `order`; left rows without one stay."""
    return latest_by_key(left.join(right, [left[c] == right[f"r_{c}"] for c in on] + [within], "left"), left_key, order)
