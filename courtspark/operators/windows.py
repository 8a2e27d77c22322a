"""Ordered state without leaks: running, last-N and calendar windows that end before the current row.

Groups are split by time shards: totals per (group, shard) are pre-aggregated and carried forward, the rest is a window
inside a shard. A player who holds a third of all rows is spread over as many tasks as there are shards.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_DAYS = 32
_KINDS = {"sum": F.sum, "max": F.max, "count": F.count}


def _shard(day: str, width: int) -> Column:
    return F.floor(F.unix_date(F.col(day)) / width).cast("int")


def running(df: DataFrame, keys: Sequence[str], day: str, order: Sequence[Column], values: Mapping[str, tuple[str, Column]], shard_days: int = SHARD_DAYS) -> DataFrame:
    """`df` with each value (kind sum, max or count) over all rows of the group before this one under (day, order).

    Sums and counts of nothing are 0, a max of nothing is null. Rows with a null key or day are left out. `order` must
    make the order within a day total. One shuffle of the rows by (keys, shard).
    """
    rows = df.where(" and ".join(f"`{c}` is not null" for c in [*keys, day])).withColumn("_shard", _shard(day, shard_days))
    rows = rows.withColumns({f"_v_{n}": c for n, (_, c) in values.items()})
    totals = rows.groupBy(*keys, "_shard").agg(*[_KINDS[k](f"_v_{n}").alias(f"_v_{n}") for n, (k, _) in values.items()])
    earlier = Window.partitionBy(*keys).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    over = {"sum": F.sum, "count": F.sum, "max": F.max}
    carried = totals.select(*keys, "_shard", *[over[k](f"_v_{n}").over(earlier).alias(f"_c_{n}") for n, (k, _) in values.items()])
    before = Window.partitionBy(*keys, "_shard").orderBy(day, *order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"_w_{n}": _KINDS[k](f"_v_{n}").over(before) for n, (k, _) in values.items()})
    rows = rows.join(carried, [*keys, "_shard"])
    zero = F.lit(0)
    out = {n: F.greatest(f"_w_{n}", f"_c_{n}") if k == "max" else F.coalesce(f"_w_{n}", zero) + F.coalesce(f"_c_{n}", zero) for n, (k, _) in values.items()}
    return rows.withColumns(out).select(*df.columns, *values)


def last_n(df: DataFrame, keys: Sequence[str], day: str, order: Sequence[Column], n: int, sums: Mapping[str, Column], member: Column | None = None, count: str = "n_last") -> DataFrame:
    """`df` with the sums over the last `n` member rows before this one, and how many there were (`count`).

    Rows that are no member (`member` false or null) get their values but never enter a window.
    """
    inside = F.coalesce(member, F.lit(False)) if member is not None else F.lit(True)
    own = df.withColumns({f"_p_{c}": F.when(inside, F.coalesce(v, F.lit(0))).otherwise(0) for c, v in sums.items()}).withColumn("_in", inside.cast("int"))
    run = running(own, keys, day, order, {"_k": ("sum", F.col("_in")), **{f"_s_{c}": ("sum", F.col(f"_p_{c}")) for c in sums}})
    run = less_earlier(run, keys, "_k", "_in", n, {c: (f"_s_{c}", f"_p_{c}") for c in sums})
    return run.withColumn(count, F.least(F.col("_k"), F.lit(n)).cast("long")).select(*df.columns, count, *sums)


def less_earlier(run: DataFrame, keys: Sequence[str], position: str, member: str, n: int, sums: Mapping[str, tuple[str, str]]) -> DataFrame:
    """`run` with the running sums over the last `n` members only: name -> (running sum, own value).

    From each running sum the one `n` members earlier is taken off. The join key holds the position, so no group is
    ever in one task.
    """
    marks = run.where(f"`{member}` = 1").select(*keys, (F.col(position) + 1 + n).alias("_at"), *[(F.col(s) + F.col(p)).alias(f"_b_{c}") for c, (s, p) in sums.items()])
    joined = run.join(marks.withColumnRenamed("_at", position), [*keys, position], "left")
    return joined.withColumns({c: F.col(s) - F.coalesce(F.col(f"_b_{c}"), F.lit(0)) for c, (s, _) in sums.items()}).drop(*[f"_b_{c}" for c in sums])


def calendar(df: DataFrame, keys: Sequence[str], day: str, order: Sequence[Column], windows: Mapping[str, tuple[int, Column]], shard_days: int = SHARD_DAYS) -> DataFrame:
    """`df` with sums over the rows before this one that are at most so many days old (name -> (days, value)), same day included.

    A row also joins the next shard as far as its windows reach there; it counts there but isn't returned.
    """
    longest = max(d for d, _ in windows.values())
    width = max(shard_days, longest)
    number = F.unix_date(F.col(day))
    rows = df.where(" and ".join(f"`{c}` is not null" for c in [*keys, day])).withColumns({f"_v_{n}": F.coalesce(v, F.lit(0)) for n, (_, v) in windows.items()}).withColumn("_day", number)
    home = F.floor(F.col("_day") / width).cast("int")
    rows = rows.withColumn("_home", home).withColumn("_shard", F.explode(F.array_distinct(F.array(home, F.floor((F.col("_day") + longest) / width).cast("int")))))
    part = Window.partitionBy(*keys, "_shard")
    out = {}
    for n, (days, _) in windows.items():
        whole = F.sum(f"_v_{n}").over(part.orderBy("_day").rangeBetween(-days, 0))
        rest = F.sum(f"_v_{n}").over(Window.partitionBy(*keys, "_shard", "_day").orderBy(*order).rowsBetween(0, Window.unboundedFollowing))
        out[n] = whole - rest
    return rows.withColumns(out).where("_home = _shard").select(*df.columns, *windows)
