"""State that jobs keep between runs: counters, run logs, caches with an age, quotas, ids, repointing across tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtspark.operators.keyed import latest_by_key
from courtspark.operators.ranks import distributed_rank
from courtspark.operators.resolve import repoint


def add_to_counters(stored: DataFrame, deltas: DataFrame, keys: Sequence[str], counters: Sequence[str]) -> DataFrame:
    """Stored counters plus deltas: keys new to the store start at 0, null deltas add nothing. Deltas are summed per task before they move."""
    rows = stored.select(*keys, *counters).unionByName(deltas.select(*keys, *counters))
    return rows.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters])


def fresh(cache: DataFrame, keys: Sequence[str], fetched: str, now: Column, hours: int = 24) -> DataFrame:
    """The newest entry per key, if it is at most `hours` old at `now`; a null time is never fresh."""
    newest = latest_by_key(cache, keys, [F.col(fetched).desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in cache.columns if c not in (*keys, fetched)]])
    return newest.where(F.col(fetched) >= now - F.expr(f"interval {hours} hours"))


def run_log(opened: DataFrame, closed: DataFrame, run: str, at: str, failed: str) -> DataFrame:
    """(run, opened, closed, status) from appended open and close marks: still running without a close, failed if a close says so, partial if only some do."""
    marks = opened.select(run, F.col(at).alias("o"), F.lit(None).cast(opened.schema[at].dataType).alias("c"), F.lit(None).cast("boolean").alias("f")).unionByName(closed.select(run, F.lit(None).cast(opened.schema[at].dataType).alias("o"), F.col(at).alias("c"), F.col(failed).alias("f")))
    sums = marks.groupBy(run).agg(F.min("o").alias("opened"), F.max("c").alias("closed"), F.count("f").alias("n"), F.count(F.when(F.col("f"), 1)).alias("bad"))
    status = F.when(F.col("n") == 0, "running").when(F.col("bad") == F.col("n"), "failed").when(F.col("bad") > 0, "partial").otherwise("success")
    return sums.select(run, "opened", "closed", status.alias("status"))


def quota(calls: DataFrame, month: str, bound: int, reserve: int = 20) -> DataFrame:
    """(month, used, left, allowed) per month of a call log: allowed while the calls keep `reserve` below the bound."""
    used = calls.groupBy(month).agg(F.count(F.lit(1)).alias("used"))
    return used.select(month, "used", F.greatest(F.lit(bound) - F.col("used"), F.lit(0)).alias("left"), (F.col("used") < bound - reserve).alias("allowed"))


def fetch_plan(asked: DataFrame, cache: DataFrame, key: str, fetched: str, now: Column, left: int, hours: int = 24) -> DataFrame:
    """(key, how) for each asked key: `cache` where a fresh entry stands, else `call` for the first `left` in key order, else `refused`.

    Keys that miss are numbered without bringing them to one place.
    """
    hits = fresh(cache.select(key, fetched), [key], fetched, now, hours).select(key, F.lit(True).alias("hit"))
    both = asked.select(key).where(F.col(key).isNotNull()).distinct().join(hits, key, "left")
    missed = distributed_rank(both.where("hit is null").select(key, F.lit(1).alias("_all")), ["_all"], [F.col(key).asc()])
    return both.where("hit").select(key, F.lit("cache").alias("how")).unionByName(missed.select(key, F.when(F.col("position") <= left, "call").otherwise("refused").alias("how")))


def append_with_ids(stored: DataFrame, incoming: DataFrame, id_column: str, order: Sequence[Column]) -> DataFrame:
    """The incoming rows with ids that go on from the greatest stored one, in `order`: the same ids if the job is repeated."""
    last = stored.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("_last"))
    numbered = distributed_rank(incoming.withColumn("_all", F.lit(1)), ["_all"], order).drop("_all")
    return numbered.join(F.broadcast(last)).select((F.col("position") + F.col("_last")).cast("long").alias(id_column), *[c for c in incoming.columns if c != id_column])  # last is one row


def repoint_all(tables: Mapping[str, tuple[DataFrame, Sequence[str]]], mapping: DataFrame, unique: Mapping[str, tuple[Sequence[str], Sequence[Column]]], derived: Sequence[str] = (), roster: tuple[str, str] | None = None) -> dict[str, DataFrame]:
    """Every table with stale ids replaced by canonical ones (`mapping`: stale, canonical, chains closed).

    tables: name -> (rows, id columns). Where a table must stay unique by key, `unique` names the key and which of the
    rows that now collide stays: own rows of the canonical id come before repointed ones. Rows of stale ids in `derived`
    tables (states and features, to be computed anew) and in the roster are dropped.
    """
    out = {}
    for name, (df, columns) in tables.items():
        stale = mapping.select(F.col("stale").alias(columns[0]))
        if name in derived or (roster and name == roster[0]):
            out[name] = df.join(stale, columns[0], "left_anti")
            continue
        moved = repoint(df.withColumns({f"_was_{c}": F.col(c) for c in columns}), columns, mapping)
        changed = F.lit(False)
        for c in columns:
            changed = changed | ~F.col(c).eqNullSafe(F.col(f"_was_{c}"))
        moved = moved.withColumn("_moved", changed.cast("int")).drop(*[f"_was_{c}" for c in columns])
        if name in unique:
            keys, order = unique[name]
            moved = latest_by_key(moved, keys, [F.col("_moved").asc(), *order])
        out[name] = moved.drop("_moved")
    return out


def oriented_odds(results: DataFrame, key: str, side: str, odds_a: str, odds_b: str, parse: Callable[[Column], Column], stored: DataFrame | None = None) -> DataFrame:
    """(key, winner_odds, loser_odds, winner_prob): prices of results turned to the winner (`side` 1 or 2), margin taken out.

    Results without a winner or without two valid prices are skipped; keys already stored stay as they are.
    """
    a, b = parse(F.col(odds_a)), parse(F.col(odds_b))
    first = F.col(side) == 1
    rows = results.where(F.col(side).isin(1, 2) & a.isNotNull() & b.isNotNull()).select(key, F.when(first, a).otherwise(b).alias("winner_odds"), F.when(first, b).otherwise(a).alias("loser_odds"))
    rows = latest_by_key(rows, [key], [F.col("winner_odds").asc(), F.col("loser_odds").asc()])
    if stored is not None:
        rows = rows.join(stored.select(key).distinct(), key, "left_anti")
    return rows.withColumn("winner_prob", (1 / F.col("winner_odds")) / (1 / F.col("winner_odds") + 1 / F.col("loser_odds")))
