"""Queries of the llm problems over the archive tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtspark.llm.components import component_groups
from courtspark.llm.leaks import altered_passages, leaked_passages
from courtspark.llm.linkage import Names, best_links, pair_candidates, solve
from courtspark.llm.nearest import nearest_in_time
from courtspark.llm.sentences import corpus_sentences
from courtspark.llm.skill import ranking, skills
from courtspark.llm.survivor import best_fields, best_records
from courtspark.llm.tokens import encode_corpus
from courtspark.operators.keyed import latest_by_key
from courtspark.session import cut, stored
from courtspark.sources.tables import both_players, clean, matches_latest, table

TOKENIZERS = "/opt/tokenizers"


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = matches_latest(spark, sf_dir, ["winner_player_id", "loser_player_id", "tourney_date"])
    players = both_players(latest, "match_id", "tourney_date")
    rankings = table(spark, sf_dir, "rankings").where("rank is not null").select("player_id", "ranking_date")
    found = nearest_in_time(players, rankings, "player_id", F.unix_date("tourney_date"), F.unix_date("ranking_date"), 10)
    return found.select("match_id", "player_id", F.date_format(F.date_from_unix_date(F.col("nearest").cast("int")), "yyyy-MM-dd").alias("ranking_date"))


def _roster(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict, list]:
    trust = table(spark, sf_dir, "roster_sources").groupBy("roster_source").agg(F.max("trust").alias("trust"))
    codes = table(spark, sf_dir, "ioc_codes").select(F.col("ioc").alias("known_ioc")).distinct()
    records = table(spark, sf_dir, "players").withColumn("ioc_clean", F.upper(clean(F.col("ioc"))))
    records = records.join(trust, "roster_source", "left").join(codes, F.col("ioc_clean") == F.col("known_ioc"), "left")
    hand = F.upper(clean(F.col("hand")))
    age = F.year("loaded_at") - F.year("dob")
    fields = {
        "hand": F.when(hand.isin("R", "L", "A"), hand),
        "dob": F.when(age.between(12, 60), F.date_format("dob", "yyyy-MM-dd")),
        "ioc": F.col("known_ioc"),
        "height": F.when(F.col("height").between(140, 230), F.col("height").cast("string")),
    }
    order = [F.col("trust").desc_nulls_last(), F.col("loaded_at").desc_nulls_last(), F.col("record_id").asc_nulls_last()]
    return records, fields, order


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, fields, order = _roster(spark, sf_dir)
    several = table(spark, sf_dir, "players").groupBy("player_id").agg(F.min("record_id").alias("lo"), F.max("record_id").alias("hi")).where("lo <> hi").select("player_id")
    return best_fields(records, "player_id", fields, order).join(several, "player_id", "left_semi").select("player_id", "field_name", "field_value")


def p6_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, fields, order = _roster(spark, sf_dir)
    return best_records(records, "player_id", fields, order).select("player_id", "record_id", "n_usable")


def _roster_id(column: str) -> F.Column:
    raw = F.upper(clean(F.col(column)))
    number = F.regexp_extract(raw, r"(\d+)$", 1)
    tour = F.coalesce(F.nullif(F.regexp_extract(raw, r"^([A-Z]+)", 1), F.lit("")), F.upper(clean(F.col("tour"))))
    return F.when(number != "", F.concat_ws("_", tour, F.regexp_replace(number, r"^0+(?=\d)", ""))).alias(column)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    approved = table(spark, sf_dir, "duplicate_review").where(F.lower(clean(F.col("verdict"))).isin("y", "yes", "approved"))
    pairs = approved.select(_roster_id("canonical_player_id"), _roster_id("stale_player_id"))
    return component_groups(pairs, "canonical_player_id", "stale_player_id").select(F.col("node").alias("player_id"), F.col("group").alias("group_player_id"))


def p8_ids(spark: SparkSession, sf_dir: str, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text", vocabulary)


def p8_ids_split(spark: SparkSession, sf_dir: str, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """The ids of p8_ids, with every text of more than 1,000 characters encoded in pieces by other tasks, and runs in pieces of 8."""
    return encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text", vocabulary, run=8, spread=1000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p6_found": p6_found, "p6_records": p6_records, "p7_found": p7_found, "p8_ids": p8_ids, "p8_ids_split": p8_ids_split}


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_passages(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def p9_altered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a whole item in altered form, with the similarity."""
    return altered_passages(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


QUERIES |= {"p9_found": p9_found, "p9_altered": p9_altered}


SURFACES = ["Hard", "Clay", "Grass", "IHard"]


def _completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = matches_latest(spark, sf_dir, ["tour", "surface", "match_status", "winner_player_id", "loser_player_id"])
    raw = F.lower(clean(F.col("surface")))
    surface = F.when(raw.isin("carpet", "i.hard", "ihard"), "IHard").when(raw.isin("hard", "clay", "grass"), F.initcap(raw))
    return latest.where("match_status = 'completed'").withColumn("surface", surface).where("surface is not null")


def _skills(completed: DataFrame) -> DataFrame:
    return skills(completed, "winner_player_id", "loser_player_id", "tour", "surface", SURFACES)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    completed = cut(_completed(spark, sf_dir))
    anchors = table(spark, sf_dir, "tour_anchors").select(F.col("player_id").alias("item"), F.lit(True).alias("anchor")).distinct()
    beliefs = _skills(completed).join(anchors, "item", "left")
    bar = beliefs.where("anchor").groupBy("pool", "context").agg(F.max("mean").alias("bar"))
    played = both_players(completed.where("winner_player_id is not null and loser_player_id is not null"), "match_id", "surface").groupBy("player_id", "surface").agg(F.count(F.lit(1)).alias("played")).where("played >= 15")
    stronger = beliefs.where("anchor is null").join(bar, ["pool", "context"]).where("mean > bar").select(F.col("item").alias("player_id"), F.col("context").alias("surface"))
    return played.join(stronger, ["player_id", "surface"]).select("player_id", "surface")


def p3_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = ranking(_skills(_completed(spark, sf_dir)))
    return ranked.select(F.col("item").alias("player_id"), F.col("pool").alias("tour"), F.col("context").alias("surface"), "mean", F.sqrt("variance").alias("deviation"), "lower", "position")


QUERIES |= {"p3_found": p3_found, "p3_ranking": p3_ranking}


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_sentences(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")


QUERIES["p10_found"] = p10_found


#: Days after a tournament's first day up to which a listing is held against its matches (a match starts within 8).
FARTHEST = 12


def p4_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record, target, moment, similarity and what it's made of): listings and matches that share last names, nearly, within some days."""
    odds = table(spark, sf_dir, "aggregated_odds").where("event_id is not null and tour is not null and commence_time_utc is not null")
    events = latest_by_key(odds, ["event_id"], [F.col("fetched_at").desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in ("sport_key", "tour", "player_a_name", "player_b_name", "commence_time_utc")]])
    events = events.select("event_id", F.upper(clean(F.col("tour"))).alias("pool"), F.col("player_a_name").alias("a"), F.col("player_b_name").alias("b"), "commence_time_utc", "sport_key")
    names = events.select("pool", F.explode(F.array("a", "b")).alias("raw"))
    players = table(spark, sf_dir, "players").select(F.upper(F.col("tour")).alias("pool"), "player_id", F.col("name_first").alias("first"), F.coalesce("name_last", "full_name").alias("last"))
    matches = matches_latest(spark, sf_dir, ["tour", "tourney_name", "tourney_date", "round", "winner_player_id", "loser_player_id"]).where("tourney_date is not null")
    matches = stored(matches.select("match_id", F.upper(clean(F.col("tour"))).alias("pool"), "tourney_name", "tourney_date", "round", F.least("winner_player_id", "loser_player_id").alias("low"), F.greatest("winner_player_id", "loser_player_id").alias("high")))
    days = events.select(F.col("event_id").alias("record"), "pool", "a", "b", F.col("commence_time_utc").cast("date").alias("day"))
    met = pair_candidates(Names.of(names, players), days, matches.select(F.col("match_id").alias("target"), "pool", "low", "high", F.col("tourney_date").alias("day")), FARTHEST, 3)
    pairs = met.where("fit >= 0.1").select(F.col("record").alias("event_id"), F.col("target").alias("match_id"), "fit")
    pairs = pairs.join(events.select("event_id", "commence_time_utc", "sport_key"), "event_id").join(matches.select("match_id", "tourney_name", "tourney_date", "round"), "match_id")
    pairs = pairs.withColumn("days", F.date_diff(F.col("commence_time_utc").cast("date"), F.col("tourney_date")))
    listed = F.regexp_replace(F.lower("sport_key"), r"^tennis_(atp|wta)_?", "")
    named = F.regexp_replace(F.regexp_replace(F.lower(clean(F.col("tourney_name"))), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    place = F.when((listed == "") | named.isNull() | (named == ""), 0.85).when(listed == named, 1.0).when(named.startswith(listed) | listed.startswith(named), 0.97).otherwise(F.greatest(F.lit(0.0), 0.6 - F.levenshtein(listed, named) / F.greatest(F.length(listed), F.length(named))))
    pairs = pairs.withColumn("place", place)
    pairs = stored(pairs.select("event_id", "match_id", "commence_time_utc", "days", "round", "fit", "place"))
    usual = pairs.where("days between 0 and 8").groupBy(F.coalesce("round", F.lit("")).alias("stage"), "days").agg(F.count(F.lit(1)).alias("n"))
    most = usual.groupBy("stage").agg(F.max("n").alias("most"))
    usual = usual.join(most, "stage").select("stage", "days", (F.col("n") / F.col("most")).alias("usual"))
    pairs = pairs.withColumn("stage", F.coalesce("round", F.lit(""))).join(usual, ["stage", "days"], "left")
    # a day on which no match of the tournament starts speaks against the pair, as names and place do
    similarity = F.sqrt("fit") * F.col("place") * F.when(F.col("days").between(0, 8), 0.85 + 0.15 * F.sqrt(F.coalesce("usual", F.lit(0.0)))).otherwise(0.45)
    return pairs.select(F.col("event_id").alias("record"), F.col("match_id").alias("target"), F.col("commence_time_utc").alias("moment"), "fit", "place", "days", "round", similarity.alias("similarity"))


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = p4_candidates(spark, sf_dir).select("record", "target", "moment", "similarity")
    return best_links(solve(candidates))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linked(spark, sf_dir).select(F.col("target").alias("match_id"), F.col("record").alias("event_id"))


def p4_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linked(spark, sf_dir).select(F.col("record").alias("event_id"), F.col("target").alias("match_id"), F.col("truth").alias("confidence"))


QUERIES |= {"p4_found": p4_found, "p4_links": p4_links}
