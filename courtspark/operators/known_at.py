"""Attributes as known at event time: bitemporal last-known values without wide versions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_DAYS = 64


def attribute_history(df: DataFrame, entity: str, value: str, valid_from: str, known_at: str) -> DataFrame:
    """The change history of one attribute: (entity, valid_from date, known_at timestamp, value); null values are no entry."""
    return df.select(
        F.col(entity).alias("entity"), F.col(valid_from).cast("date").alias("valid_from"), F.col(known_at).cast("timestamp_ntz").alias("known_at"), F.col(value).alias("value")
    ).where("entity is not null and valid_from is not null and known_at is not null and value is not null")


def values_known_at(events: DataFrame, entity: str, event_day: str, histories: Mapping[str, DataFrame], shard_days: int = SHARD_DAYS) -> DataFrame:
    """For each event and each attribute: the entry in force and on file on the event's day.

    An entry counts from the later of its valid day and the day it became known. Of those that count the one with the
    latest valid day wins, then the latest known_at, then the greatest value. Every attribute keeps its own history and
    is matched on its own, so one that changes rarely costs no copies of the others; results come back as one struct
    column per attribute, (valid_from, known_at, value), null where nothing was known. Events with a null entity or day
    get nulls; equal events stay as they are; columns of the events may have any other names.

    Plan: entries and events are laid out by (entity, shard of `shard_days` days); a running max over that order is the
    last-known match. What earlier shards leave behind is one row per shard, found by a partial aggregate and carried
    in as a first row. So an entity with a third of all rows is split over its shards, nothing is gathered, no join.
    """
    names = list(histories)
    event_cols = events.columns
    day = F.unix_date(F.col(event_day).cast("date"))
    ev = events.select(F.struct(*[F.col(f"`{c}`") for c in event_cols]).alias("_event"), F.col(entity).alias("_entity"), day.alias("_day"))
    absent = ev.where("_entity is null or _day is null")
    ev = ev.where("_entity is not null and _day is not null")

    entry_types = {a: h.select(F.struct("valid_from", "known_at", "value").alias("x")).schema["x"].dataType for a, h in histories.items()}

    def entries(own: str, h: DataFrame) -> DataFrame:
        seen = F.unix_date(F.greatest(F.col("valid_from"), F.col("known_at").cast("date")))
        cols = [F.struct("valid_from", "known_at", "value").alias(f"_h_{a}") if a == own else F.lit(None).cast(entry_types[a]).alias(f"_h_{a}") for a in names]
        return h.select(F.col("entity").alias("_entity"), seen.alias("_day"), *cols)

    entry_rows = None
    for a, h in histories.items():
        entry_rows = entries(a, h) if entry_rows is None else entry_rows.unionByName(entries(a, h))

    shard: Column = F.floor(F.col("_day") / shard_days).cast("int").alias("_shard")
    hs = [f"_h_{a}" for a in names]
    per_shard = (
        entry_rows.select("_entity", shard, *hs)
        .unionByName(ev.select("_entity", shard).distinct(), allowMissingColumns=True)
        .groupBy("_entity", "_shard")
        .agg(*[F.max(h).alias(h) for h in hs])
    )
    before = Window.partitionBy("_entity").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_shard.select("_entity", "_shard", *[F.max(h).over(before).alias(h) for h in hs])
    carried = carried.where(" or ".join(f"{h} is not null" for h in hs))

    laid = (
        carried.select("_entity", "_shard", F.lit(-(2**31)).cast("int").alias("_day"), F.lit(0).alias("_side"), *hs)
        .unionByName(entry_rows.select("_entity", shard, "_day", F.lit(1).alias("_side"), *hs))
        .unionByName(ev.select("_entity", shard, "_day", F.lit(2).alias("_side"), "_event"), allowMissingColumns=True)
    )
    upto = Window.partitionBy("_entity", "_shard").orderBy("_day", "_side").rowsBetween(Window.unboundedPreceding, 0)
    known = laid.select("_event", "_side", *[F.max(f"_h_{a}").over(upto).alias(a) for a in names]).where("_side = 2")
    known = known.unionByName(absent.select("_event", F.lit(2).alias("_side")), allowMissingColumns=True)
    return known.select(*[F.col("_event").getField(c).alias(c) for c in event_cols], *names)
