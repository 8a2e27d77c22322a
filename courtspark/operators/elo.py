"""Ratings replayed in order."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, K = 1500.0, 32.0


def elo_replay(contests: DataFrame, pool: Sequence[str], order: Sequence[str], winner: str, loser: str, key: str, known: DataFrame | None = None) -> DataFrame:
    """(key, *pool, winner, loser, winner_before, loser_before, winner_after, loser_after) for every contest in order.

    Each rating depends on the one before, so a pool (tour and surface: disjoint ladders) is one sequence. It is read as
    a stream in sorted batches; a task keeps the present ratings of its pool's players, never the contests. `known`
    (*pool, player, rating) gives ratings to go on from (a roll-forward); players without one start at START.
    """
    cols = [key, *pool, winner, loser]
    laid = contests.select(*dict.fromkeys([*cols, *order])).withColumns({"_side": F.lit(1), "_rating": F.lit(None).cast("double")})
    kinds = {f.name: f.dataType.simpleString() for f in laid.schema.fields}
    if known is not None:
        laid = laid.unionByName(known.select(*pool, F.col("player").alias(winner), F.lit(0).alias("_side"), F.col("rating").alias("_rating")), allowMissingColumns=True)
    laid = laid.repartition(*pool).sortWithinPartitions(*pool, "_side", *order)
    fresh = ["winner_before", "loser_before", "winner_after", "loser_after"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here: tuple | None = None
        ratings: dict[str, float] = {}
        for pdf in batches:
            out = []
            pools = list(zip(*[pdf[p] for p in pool], strict=True))
            for at, a, b, contest, rating in zip(pools, pdf[winner], pdf[loser], pdf["_side"], pdf["_rating"], strict=True):
                if at != here:
                    here, ratings = at, {}
                if not contest:
                    ratings[a] = rating
                    continue
                x, y = ratings.get(a, START), ratings.get(b, START)
                step = K * (1.0 - 1.0 / (1.0 + 10.0 ** ((y - x) / 400.0)))
                ratings[a], ratings[b] = x + step, y - step
                out.append((x, y, x + step, y - step))
            yield pdf.loc[pdf["_side"] == 1, cols].assign(**{c: [row[i] for row in out] for i, c in enumerate(fresh)})

    return laid.mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in cols) + ", " + ", ".join(f"{c} double" for c in fresh))
