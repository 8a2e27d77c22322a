"""Structured Streaming forms of the batch jobs: upserts per micro-batch, windowed counts, ratings kept as state."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtspark.operators.elo import elo_replay
from courtspark.session import cut
from courtspark.sources.files import KeyedTable


def drain(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Everything that has arrived, in micro-batches, then stop: the periodic job."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def upsert_stream(stream: DataFrame, root: str, name: str, checkpoint: str, keys: Sequence[str], order: Sequence[str], compact_every: int = 50) -> KeyedTable:
    """Keep a keyed table current: in each micro-batch the newest row per key wins over the stored one if it isn't older.

    A micro-batch writes only its own rows; every `compact_every` batches are folded into the base. A repeated
    micro-batch changes nothing, so a restart after a failure gives the same table. A table that can't be read stops
    the stream; nothing is taken for absent that merely failed.
    """
    kept = KeyedTable(stream.sparkSession, root, name, keys, order)

    def each(batch: DataFrame, number: int) -> None:
        kept.upsert(batch)
        if number % compact_every == compact_every - 1:
            kept.compact()

    drain(stream, checkpoint, each)
    return kept


def windowed_counts(stream: DataFrame, time: str, key: str, value: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums per tumbling window and key; rows later than the watermark allows are left out and state is dropped behind it."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("window_start"), key, "n", "total")


def sessions(stream: DataFrame, time: str, key: str, gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), key, "n")


def rating_stream(contests: DataFrame, root: str, name: str, checkpoint: str, compact_every: int = 50) -> tuple[KeyedTable, KeyedTable]:
    """(ratings, contests with ratings before) kept current from a stream of ladder, day, key, winner, loser.

    Each micro-batch is replayed by (day, key) from the stored ratings: a ladder's contests stream through sorted
    batches, its present ratings are rows of a table, and a batch writes only the ratings it changed. Ratings carry
    the batch that made them, so a repeated batch, told by its number, starts from where it started before. Contests of one batch are in order; a late one counts in the batch it arrives in.
    """
    spark = contests.sparkSession
    ratings = KeyedTable(spark, root, f"{name}-ratings", ["ladder", "player"], ["batch"])
    scored = KeyedTable(spark, root, f"{name}-scored", ["ladder", "key"], ["batch"])

    def each(batch: DataFrame, number: int) -> None:
        earlier = F.col("batch") < number  # of a repeated batch the first attempt's rows don't count
        if number % compact_every == 0:
            ratings.compact(earlier)
        known = ratings.read(earlier).select("ladder", "player", "rating") if ratings.exists() else None
        out = cut(elo_replay(batch, ["ladder"], ["day", "key"], "winner", "loser", "key", known).withColumn("batch", F.lit(number)))
        scored.upsert(out.select("ladder", "key", "winner_before", "loser_before", "batch"))
        sides = F.array(F.struct(F.col("winner").alias("player"), F.col("winner_after").alias("rating")), F.struct(F.col("loser").alias("player"), F.col("loser_after").alias("rating")))
        rows = out.join(batch.select("ladder", "key", "day"), ["ladder", "key"]).select("ladder", F.struct("day", "key").alias("at"), "batch", F.explode(sides).alias("e"))
        ratings.upsert(rows.groupBy("ladder", F.col("e.player").alias("player"), "batch").agg(F.max_by("e.rating", "at").alias("rating")))

    drain(contests, checkpoint, each)
    return ratings, scored


def read_stream(spark: SparkSession, folder: str, schema: object, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
