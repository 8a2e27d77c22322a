"""Problems 2 and 5 over the archive tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtspark.operators.known_at import attribute_history, values_known_at
from courtspark.operators.keyed import latest_by_key
from courtspark.operators.trailing import daily_leaves, totals_of_trees, trailing_totals, tree_nodes
from courtspark.session import scratch
from courtspark.sources.files import KeyedTable
from courtspark.sources.tables import both_players, matches_latest, table

PERIODS = [7, 30]


def _match_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = matches_latest(spark, sf_dir, ["winner_player_id", "loser_player_id", "tourney_date"])
    return both_players(latest.where("tourney_date is not null"), "match_id", "tourney_date")


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every match and player with rank and points as known when the tournament began, each with its own history."""
    ranked = table(spark, sf_dir, "rankings").where("rank is not null")
    histories = {a: attribute_history(ranked, "player_id", a, "ranking_date", "ingested_at") for a in ("rank", "points")}
    return values_known_at(_match_players(spark, sf_dir), "player_id", "tourney_date", histories)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return known(spark, sf_dir).where("rank is not null").select("match_id", "player_id", F.date_format("rank.valid_from", "yyyy-MM-dd").alias("ranking_date"), F.col("rank.value").alias("rank"))


def p2_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda a: F.date_format(f"{a}.valid_from", "yyyy-MM-dd").alias(f"{a}_date")
    return known(spark, sf_dir).select("match_id", "player_id", day("rank"), F.col("rank.value").alias("rank"), day("points"), F.col("points.value").alias("points"))


def _won_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    won = matches_latest(spark, sf_dir, ["winner_player_id", "tourney_date", "w_svpt", "w_first_won"])
    both = F.col("w_svpt").isNotNull() & F.col("w_first_won").isNotNull()
    won = won.select("winner_player_id", "tourney_date", *[F.when(both, F.col(c)).alias(c) for c in ("w_svpt", "w_first_won")])
    return daily_leaves(won, "winner_player_id", "tourney_date", ["w_svpt", "w_first_won"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    def wanted(v: dict) -> object:
        return (v["n"] == 0) & (v["w_svpt_7"] >= 200) & (100 * v["w_first_won_30"] >= 42 * v["w_svpt_30"])

    found = trailing_totals(_won_leaves(spark, sf_dir), ["w_svpt", "w_first_won"], PERIODS, wanted)
    return found.select(F.col("entity").alias("player_id"), F.date_format(F.date_from_unix_date("day"), "yyyy-MM-dd").alias("day_date"))


def p5_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all calendar days of each winner: days with a match in the last 30, and the greatest trailing totals."""
    days = trailing_totals(_won_leaves(spark, sf_dir), ["w_svpt", "w_first_won"], PERIODS, lambda v: v["n_30"] >= 0)
    return days.groupBy(F.col("entity").alias("player_id")).agg(
        F.count(F.lit(1)).alias("active_days"), F.max("w_svpt_7").alias("most_svpt_7"), F.max("w_svpt_30").alias("most_svpt_30"), F.max("w_first_won_30").alias("most_first_won_30"), F.max("n_30").alias("most_wins_30")
    )


def p5_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p5_found from stored trees: built from the first version of each match, then corrected by what later versions changed."""
    cols = ["w_svpt", "w_first_won"]
    raw = table(spark, sf_dir, "matches").where("match_id is not null").select("match_id", "winner_player_id", "tourney_date", *cols, "ingested_at")
    rest = ["winner_player_id", "tourney_date", *cols]
    first = latest_by_key(raw, ["match_id"], [F.col("ingested_at").asc_nulls_last(), *[F.col(c).desc_nulls_last() for c in rest]]).select(*rest)
    both = F.col("w_svpt").isNotNull() & F.col("w_first_won").isNotNull()
    old = daily_leaves(first.select(*rest[:2], *[F.when(both, F.col(c)).alias(c) for c in cols]), *rest[:2], cols)
    kept = KeyedTable(spark, scratch(spark), "trees", ["entity", "shard", "node", "part"], ["part"])
    kept.upsert(tree_nodes(old, cols, max(PERIODS)).withColumn("part", F.lit(0)))
    minus = old.select("entity", "day", *[(-F.col(c)).alias(c) for c in ("n", *cols)])
    delta = _won_leaves(spark, sf_dir).unionByName(minus).groupBy("entity", "day").agg(*[F.sum(c).alias(c) for c in ("n", *cols)]).where("n <> 0 or w_svpt <> 0 or w_first_won <> 0")
    kept.upsert(tree_nodes(delta, cols, max(PERIODS)).withColumn("part", F.lit(1)))
    found = totals_of_trees(kept.read(), cols, PERIODS, lambda v: (v["n"] == 0) & (v["w_svpt_7"] >= 200) & (100 * v["w_first_won_30"] >= 42 * v["w_svpt_30"]))
    return found.select(F.col("entity").alias("player_id"), F.date_format(F.date_from_unix_date("day"), "yyyy-MM-dd").alias("day_date"))


QUERIES = {"p2_found": p2_found, "p2_attributes": p2_attributes, "p5_found": p5_found, "p5_peaks": p5_peaks, "p5_corrected": p5_corrected}

LATEST = "(select * from matches where match_id is not null qualify row_number() over (partition by match_id order by ingested_at desc nulls last) = 1)"
BOTH = f"(select distinct match_id, tourney_date, unnest([winner_player_id, loser_player_id]) as player_id from {LATEST})"
WON = f"(select winner_player_id as player_id, tourney_date as d, count(*) as n, sum(case when w_first_won is not null then w_svpt else 0 end) as sv, sum(case when w_svpt is not null then w_first_won else 0 end) as fw from {LATEST} where winner_player_id is not null and tourney_date is not null group by 1, 2)"
TRAILING = f"""with w as {WON}, days as (select distinct player_id, d + cast(k as integer) as day from w, generate_series(0, 29) g(k)),
t as (select days.player_id, days.day, max(case when w.d = days.day then w.n end) as n,
  cast(coalesce(sum(case when w.d >= days.day - 6 then w.sv end), 0) as bigint) as sv7, cast(coalesce(sum(w.sv), 0) as bigint) as sv30,
  cast(coalesce(sum(w.fw), 0) as bigint) as fw30, cast(sum(w.n) as bigint) as n30
  from days join w on w.player_id = days.player_id and w.d between days.day - 29 and days.day group by 1, 2)"""


def _known_sql(attribute: str, alias: str) -> str:
    return f"""(select m.match_id, m.player_id, max({{'d': r.ranking_date, 'k': r.ingested_at, 'v': r.{attribute}}}) as {alias}
from {BOTH} m join (select * from rankings where rank is not null and {attribute} is not null) r
on r.player_id = m.player_id and r.ranking_date <= m.tourney_date and cast(r.ingested_at as date) <= m.tourney_date group by 1, 2)"""


ORACLE = {
    "p2_found": f"select match_id, player_id, strftime(x.d, '%Y-%m-%d') as ranking_date, x.v as rank from {_known_sql('rank', 'x')}",
    "p2_attributes": f"""select m.match_id, m.player_id, strftime(x.d, '%Y-%m-%d') as rank_date, x.v as rank, strftime(y.d, '%Y-%m-%d') as points_date, y.v as points
from {BOTH} m left join {_known_sql('rank', 'x')} a using (match_id, player_id) left join {_known_sql('points', 'y')} b using (match_id, player_id)
where m.player_id is not null and m.tourney_date is not null""",
    "p5_found": f"{TRAILING} select player_id, strftime(day, '%Y-%m-%d') as day_date from t where n is null and sv7 >= 200 and 100 * fw30 >= 42 * sv30",
    "p5_peaks": f"{TRAILING} select player_id, count(*) as active_days, max(sv7) as most_svpt_7, max(sv30) as most_svpt_30, max(fw30) as most_first_won_30, max(n30) as most_wins_30 from t group by 1",
}
ORACLE["p5_corrected"] = ORACLE["p5_found"]
