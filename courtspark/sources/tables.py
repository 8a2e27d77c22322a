"""Readers of the archive tables, and the one rule every query shares: a match is its latest version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courtspark.operators.keyed import latest_by_key
from courtspark.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def matches_latest(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    """One row per match_id: the version with the latest ingested_at, pruned to `columns`.

    Rows without a match_id are no match. Equal ingested_at: the greater values in column order win, so the pick is
    the same on every run.
    """
    cols = ["match_id", *[c for c in columns if c != "match_id"]]
    raw = table(spark, sf_dir, "matches").where("match_id is not null").select(*cols, "ingested_at")
    return latest_by_key(raw, ["match_id"], [F.col("ingested_at").desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in cols[1:]]]).select(*cols)


def both_players(matches: DataFrame, *keep: str, winner: str = "winner_player_id", loser: str = "loser_player_id") -> DataFrame:
    """Two rows per match, one for each player (one if both ids are the same), from a single scan."""
    players = F.array_distinct(F.array(F.col(winner), F.col(loser)))
    return matches.select(*keep, F.explode(players).alias("player_id")).where("player_id is not null")


def clean(column: Column) -> Column:
    """Trimmed of any white space."""
    return F.regexp_replace(column, r"^[\s 　]+|[\s 　]+$", "")
