"""Filters, joins, aggregates, windows, sorts and set operations over the test tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from courtspark.functions import normalize as N
from courtspark.operators import keyed as K
from courtspark.operators import resolve as R
from courtspark.operators.asof import interval_pick_one, latest_before
from courtspark.plans.replay import _LATEST as LATEST
from courtspark.sources.tables import both_players, matches_latest, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def keep(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return run

    return keep


def _m(s: SparkSession, d: str, *cols: str) -> DataFrame:
    return matches_latest(s, d, list(cols))


TIER = "case match_tier when 'main' then 1 when 'qual_chall' then 2 when 'qual_itf' then 3 else 9 end"
PM = f"(select match_id, tour, tourney_date, surface, round, match_num, match_tier, match_status, winner_player_id as player_id, loser_player_id as opponent_id, 1 as won from {LATEST} union all select match_id, tour, tourney_date, surface, round, match_num, match_tier, match_status, loser_player_id, winner_player_id, 0 from {LATEST})"


def _pm(s: SparkSession, d: str) -> DataFrame:
    m = _m(s, d, "tour", "tourney_date", "surface", "round", "match_num", "match_tier", "match_status", "winner_player_id", "loser_player_id")
    side = lambda a, b, w: F.struct(F.col(a).alias("player_id"), F.col(b).alias("opponent_id"), F.lit(w).alias("won"))
    both = F.array(side("winner_player_id", "loser_player_id", 1), side("loser_player_id", "winner_player_id", 0))
    return m.select("match_id", "tour", "tourney_date", "surface", "round", "match_num", "match_tier", "match_status", F.explode(both).alias("p")).select("match_id", "tour", "tourney_date", "surface", "round", "match_num", "match_tier", "match_status", "p.*")


# --- filters -------------------------------------------------------------------------------------------------------


@query("ref_f5_pair_key", f"select least(winner_player_id, loser_player_id) as pair_low, greatest(winner_player_id, loser_player_id) as pair_high, count(*) as n from {LATEST} where winner_player_id is not null and loser_player_id is not null group by 1, 2")
def _(s, d):
    m = _m(s, d, "winner_player_id", "loser_player_id").where("winner_player_id is not null and loser_player_id is not null")
    return m.select(*K.pair_key(F.col("winner_player_id"), F.col("loser_player_id"))).groupBy("pair_low", "pair_high").agg(F.count(F.lit(1)).alias("n"))


@query("ref_f6_f8_window_tiers", f"select tour, match_tier, count(*) as n from {LATEST} where tourney_date between date '2023-06-01' and date '2024-05-31' and match_tier in ('main', 'qual_chall', 'qual_itf') group by 1, 2")
def _(s, d):
    m = _m(s, d, "tour", "match_tier", "tourney_date")
    return m.where(F.col("tourney_date").between("2023-06-01", "2024-05-31") & F.col("match_tier").isin("main", "qual_chall", "qual_itf")).groupBy("tour", "match_tier").agg(F.count(F.lit(1)).alias("n"))


@query("ref_f7_null_or_window", "select event_id, player_a_name from aggregated_odds where median_odds_a is null or cast(commence_time_utc as date) between date '2024-01-01' and date '2024-03-31'")
def _(s, d):
    o = table(s, d, "aggregated_odds")
    return o.where(F.col("median_odds_a").isNull() | F.to_date("commence_time_utc").between("2024-01-01", "2024-03-31")).select("event_id", "player_a_name")


@query("ref_f10_placeholders", "select record_id, player_id from players where name_last is not null and trim(name_last) <> '' and lower(trim(coalesce(name_first, ''))) not in ('', 'unknown')")
def _(s, d):
    p = table(s, d, "players")
    return p.where((F.trim("name_last") != "") & ~F.lower(F.trim(F.coalesce("name_first", F.lit("")))).isin("", "unknown")).select("record_id", "player_id")


@query("ref_f11_id_or_tag", "select distinct o_orderkey from orders where o_custkey in (select c_custkey from customer where c_acctbal > 9000) or lower(trim(o_orderpriority)) in ('1-urgent')")
def _(s, d):
    rich = table(s, d, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("rich"))
    o = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority").join(rich, "o_custkey", "left")
    return o.where(F.col("rich").isNotNull() | F.lower(F.trim("o_orderpriority")).isin("1-urgent")).select("o_orderkey").distinct()


@query("ref_f15_freshness", "select event_id, event_type from events where event_type <> 'view' and ts >= timestamp '2024-01-29 00:00:00' - interval 24 hours and ts <= timestamp '2024-01-29 00:00:00'")
def _(s, d):
    e = table(s, d, "events")
    now = F.to_timestamp_ntz(F.lit("2024-01-29 00:00:00"))
    return e.where((F.col("event_type") != "view") & (F.col("ts") >= now - F.expr("interval 24 hours")) & (F.col("ts") <= now)).select("event_id", "event_type")


@query("ref_f17_verdicts", "select review_id from duplicate_review where lower(trim(verdict)) in ('y', 'yes', 'approved')")
def _(s, d):
    return table(s, d, "duplicate_review").where(F.lower(F.trim("verdict")).isin("y", "yes", "approved")).select("review_id")


@query("ref_f18_history", f"select player_id, count(*) as n from {PM} where match_status = 'completed' and surface is not null and tourney_date < date '2024-01-01' and player_id is not null group by 1")
def _(s, d):
    return _pm(s, d).where("match_status = 'completed' and surface is not null and tourney_date < date'2024-01-01' and player_id is not null").groupBy("player_id").agg(F.count(F.lit(1)).alias("n"))


# --- joins ---------------------------------------------------------------------------------------------------------

_LINE = "l_orderkey, l_shipdate, l_returnflag, l_quantity, l_extendedprice, l_linenumber, l_partkey, l_suppkey"


@query(
    "ref_j1_interval_pick_one",
    """select o_orderkey, l_returnflag as picked_flag, l_shipdate as picked_date, l_extendedprice as picked_price from orders left join lineitem on l_orderkey = o_orderkey and abs(date_diff('day', cast(o_orderdate as date), cast(l_shipdate as date))) <= 10
qualify row_number() over (partition by o_orderkey order by case l_returnflag when 'N' then 1 when 'A' then 2 else 3 end, abs(date_diff('day', cast(o_orderdate as date), cast(l_shipdate as date))) nulls last, l_shipdate nulls last, l_extendedprice nulls last, l_quantity nulls last) = 1""",
)
def _(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_orderdate").withColumn("key", F.col("o_orderkey"))
    line = table(s, d, "lineitem").select(F.col("l_orderkey").alias("r_key"), "l_returnflag", "l_shipdate", "l_extendedprice", "l_quantity")
    gap = F.abs(F.date_diff("l_shipdate", "o_orderdate"))
    order = [F.when(F.col("l_returnflag") == "N", 1).when(F.col("l_returnflag") == "A", 2).otherwise(3), gap.asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in ("l_shipdate", "l_extendedprice", "l_quantity")]]
    out = interval_pick_one(o, line, ["key"], gap <= 10, ["o_orderkey"], order)
    return out.select("o_orderkey", F.col("l_returnflag").alias("picked_flag"), F.col("l_shipdate").alias("picked_date"), F.col("l_extendedprice").alias("picked_price"))


@query("ref_j3_rank_single", "select player_id, arg_max(rank, ranking_date) as rank, max(ranking_date) as ranking_date from (select player_id, ranking_date, min(rank) as rank from rankings where rank is not null and ranking_date <= date '2024-06-30' group by 1, 2) group by 1")
def _(s, d):
    r = table(s, d, "rankings").where("rank is not null and ranking_date <= date'2024-06-30'").groupBy("player_id", "ranking_date").agg(F.min("rank").alias("rank"))
    return r.groupBy("player_id").agg(F.max_by("rank", "ranking_date").alias("rank"), F.max("ranking_date").alias("ranking_date"))


@query(
    "ref_j2_asof_orders",
    "select a.o_orderkey, b.o_orderkey as before_key from orders a asof left join (select o_custkey, cast(o_orderdate as date) as day, max(o_orderkey) as o_orderkey from orders where o_orderstatus = 'F' group by 1, 2) b on a.o_custkey = b.o_custkey and b.day <= cast(a.o_orderdate as date)",
)
def _(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"), "o_orderstatus")
    out = latest_before(o, o.where("o_orderstatus = 'F'").select("o_custkey", "day", F.col("o_orderkey").alias("before_key")), "o_custkey", "day", "day", ["before_key"])
    return out.select("o_orderkey", F.col("asof.before_key").alias("before_key"))


@query(
    "ref_j4_oriented_join",
    f"select m.match_id, x.rank as rank_w, y.rank as rank_l, case when winner_player_id < loser_player_id then x.rank else y.rank end as rank_p1 from {LATEST} m join (select player_id, min(rank) as rank from rankings where rank is not null group by 1) x on x.player_id = winner_player_id join (select player_id, min(rank) as rank from rankings where rank is not null group by 1) y on y.player_id = loser_player_id",
)
def _(s, d):
    m = _m(s, d, "winner_player_id", "loser_player_id")
    best = table(s, d, "rankings").where("rank is not null").groupBy("player_id").agg(F.min("rank").alias("rank"))
    m = m.join(best.select(F.col("player_id").alias("winner_player_id"), F.col("rank").alias("rank_w")), "winner_player_id").join(best.select(F.col("player_id").alias("loser_player_id"), F.col("rank").alias("rank_l")), "loser_player_id")
    return m.select("match_id", "rank_w", "rank_l", F.when(F.col("winner_player_id") < F.col("loser_player_id"), F.col("rank_w")).otherwise(F.col("rank_l")).alias("rank_p1"))


@query(
    "ref_j5_a9_duplicate_groups",
    f"""with r as (select distinct tour, full_name, dob, ioc, player_id from players where player_id is not null), n as (select player_id, count(*) as n_matches from {PM} where player_id is not null group by 1)
select r.tour, r.full_name, r.dob, r.ioc, r.player_id, g.n_ids, coalesce(n.n_matches, 0) as n_matches from r join (select tour, full_name, dob, ioc, count(distinct player_id) as n_ids from r group by 1, 2, 3, 4 having count(distinct player_id) > 1) g
on r.tour is not distinct from g.tour and r.full_name is not distinct from g.full_name and r.dob is not distinct from g.dob and r.ioc is not distinct from g.ioc left join n on n.player_id = r.player_id""",
)
def _(s, d):
    roster = table(s, d, "players").where("player_id is not null").select("tour", "full_name", "dob", "ioc", "player_id").distinct()
    counts = _pm(s, d).where("player_id is not null").groupBy("player_id").agg(F.count(F.lit(1)).alias("n_matches"))
    return R.duplicate_groups(roster, ["tour", "full_name", "dob", "ioc"], counts).select("tour", "full_name", "dob", "ioc", "player_id", "n_ids", "n_matches")


_FIX = f"(select match_id, source, tourney_id, round, winner_player_id as p1, loser_player_id as p2 from {LATEST})"
_RES = f"(select tourney_id, round, winner_player_id, loser_player_id from {LATEST} where match_status = 'completed')"
_HIT = "m.tourney_id = f.tourney_id and coalesce(m.round, '') = coalesce(f.round, '') and ((m.winner_player_id = f.p1 and m.loser_player_id = f.p2) or (m.winner_player_id = f.p2 and m.loser_player_id = f.p1))"


def _promotion(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    m = _m(s, d, "match_status", "tourney_id", "round", "winner_player_id", "loser_player_id")
    m = m.select("match_id", "match_status", "tourney_id", F.coalesce("round", F.lit("")).alias("round_key"), *K.pair_key(F.col("winner_player_id"), F.col("loser_player_id"))).where("pair_low is not null")
    return m, m.where("match_status = 'completed'").select("tourney_id", "round_key", "pair_low", "pair_high").distinct()


@query("ref_j6_promote_survivors", f"select f.match_id from {_FIX} f where f.p1 is not null and f.p2 is not null and not exists (select 1 from {_RES} m where {_HIT})")
def _(s, d):
    fixtures, results = _promotion(s, d)
    return fixtures.join(results, ["tourney_id", "round_key", "pair_low", "pair_high"], "left_anti").select("match_id")


@query("ref_j6_promote_removed", f"select f.match_id from {_FIX} f where exists (select 1 from {_RES} m where {_HIT})")
def _(s, d):
    fixtures, results = _promotion(s, d)
    return fixtures.join(results, ["tourney_id", "round_key", "pair_low", "pair_high"], "left_semi").select("match_id")


@query("ref_j8_opponent_names", f"select m.match_id, m.player_id, coalesce(r.name, m.opponent_id) as opponent from {PM} m left join (select player_id, min(full_name) as name from players group by 1) r on r.player_id = m.opponent_id where m.player_id is not null")
def _(s, d):
    names = table(s, d, "players").groupBy(F.col("player_id").alias("opponent_id")).agg(F.min("full_name").alias("name"))
    return _pm(s, d).where("player_id is not null").join(names, "opponent_id", "left").select("match_id", "player_id", F.coalesce("name", "opponent_id").alias("opponent"))


@query(
    "ref_j9_w1_t5_latest_rank",
    "with l as (select * from rankings where rank is not null qualify row_number() over (partition by player_id order by ranking_date desc, rank, points nulls last) = 1) select p.player_id, l.rank from (select distinct player_id from players) p left join l using (player_id)",
)
def _(s, d):
    latest = K.latest_by_key(table(s, d, "rankings").where("rank is not null").select("player_id", "ranking_date", "rank", "points"), ["player_id"], [F.col("ranking_date").desc(), F.col("rank").asc(), F.col("points").asc_nulls_last()])
    return table(s, d, "players").select("player_id").distinct().join(latest.select("player_id", "rank"), "player_id", "left")


@query(
    "ref_j10_a10_coverage",
    "select year(o_orderdate) as y, count(distinct o_orderkey) as n_orders, count(distinct l_orderkey) as n_shipped, round(100.0 * count(distinct l_orderkey) / nullif(count(distinct o_orderkey), 0), 4)::double as pct from orders left join lineitem on l_orderkey = o_orderkey group by 1",
)
def _(s, d):
    shipped = table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_orderkey")).distinct()
    o = table(s, d, "orders").select("o_orderkey", F.year("o_orderdate").cast("long").alias("y")).join(shipped, "o_orderkey", "left").groupBy("y")
    out = o.agg(F.count_distinct("o_orderkey").alias("n_orders"), F.count_distinct("l_orderkey").alias("n_shipped"))
    return out.withColumn("pct", F.round(F.try_divide(F.lit(100.0) * F.col("n_shipped"), F.col("n_orders")), 4))


@query(
    "ref_j11_hash_key",
    "select event_id, substr(sha1(concat_ws('::', upper(tour), least(a, b), greatest(a, b), strftime(commence_time_utc, '%Y-%m-%d'))), 1, 24) as fixture_key from (select *, trim(regexp_replace(replace(lower(trim(player_a_name)), '-', ' '), '\\s+', ' ', 'g')) as a, trim(regexp_replace(replace(lower(trim(player_b_name)), '-', ' '), '\\s+', ' ', 'g')) as b from aggregated_odds)",
)
def _(s, d):
    o = table(s, d, "aggregated_odds")
    return o.select("event_id", N.fixture_key(F.col("tour"), F.col("player_a_name"), F.col("player_b_name"), F.col("commence_time_utc")).alias("fixture_key"))


@query(
    "ref_j12_rank_collisions",
    "select r.player_id, r.ranking_date, r.ingested_at from rankings r where (r.player_id, r.ranking_date) not in (select player_id, ranking_date from rankings where player_id is not null and ranking_date is not null group by 1, 2 having count(distinct rank) > 1)",
)
def _(s, d):
    r = table(s, d, "rankings").select("player_id", "ranking_date", "rank", "ingested_at")
    clash = r.groupBy("player_id", "ranking_date").agg(F.count_distinct("rank").alias("n")).where("n > 1").select("player_id", "ranking_date")
    return r.join(clash, ["player_id", "ranking_date"], "left_anti").select("player_id", "ranking_date", "ingested_at")


@query(
    "ref_j13_u5_unseen_prune",
    "select o_orderkey from orders where not (o_orderdate between timestamp '1996-01-01' and timestamp '1996-12-31' and o_orderstatus in ('O', 'P')) or o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'N')",
)
def _(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    seen = table(s, d, "lineitem").where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("o_orderkey"))
    return K.prune_unseen(o, seen, ["o_orderkey"], F.expr("o_orderdate between timestamp_ntz'1996-01-01' and timestamp_ntz'1996-12-31' and o_orderstatus in ('O', 'P')")).select("o_orderkey")


@query("ref_j14_tier_fallback", "select p_partkey, coalesce(s_name, p_brand) as tier from part left join supplier on s_suppkey = p_partkey")
def _(s, d):
    sup = table(s, d, "supplier").select(F.col("s_suppkey").alias("p_partkey"), "s_name")
    return table(s, d, "part").select("p_partkey", "p_brand").join(sup, "p_partkey", "left").select("p_partkey", F.coalesce("s_name", "p_brand").alias("tier"))


@query("ref_j15_fuzzy_names")
def _(s, d):
    p = table(s, d, "players").where("player_id is not null")
    weight = both_players(_m(s, d, "winner_player_id", "loser_player_id"), "match_id").groupBy("player_id").agg(F.count(F.lit(1)).alias("n_matches"))
    index = R.alias_index(R.alias_forms(p), weight)
    o = table(s, d, "aggregated_odds").select("tour", F.explode(F.array("player_a_name", "player_b_name")).alias("raw"))
    return R.fuzzy_lookup(o, index)


@query("ref_j17_nearest_gap", f"select least(winner_player_id, loser_player_id) as a, greatest(winner_player_id, loser_player_id) as b, cast(min(abs(tourney_date - date '2024-01-01')) as integer) as days from {LATEST} where winner_player_id is not null and loser_player_id is not null and tourney_date is not null group by 1, 2")
def _(s, d):
    m = _m(s, d, "winner_player_id", "loser_player_id", "tourney_date").where("winner_player_id is not null and loser_player_id is not null and tourney_date is not null")
    return m.groupBy(F.least("winner_player_id", "loser_player_id").alias("a"), F.greatest("winner_player_id", "loser_player_id").alias("b")).agg(F.min(F.abs(F.date_diff("tourney_date", F.lit("2024-01-01").cast("date")))).alias("days"))


# --- aggregates ----------------------------------------------------------------------------------------------------


@query("ref_a1_stats_with_total", f"select player_id, surface, count(*) as played, cast(sum(won) as bigint) as wins, round(sum(won) / count(*), 9) as win_rate, grouping(surface)::integer as is_total from (select player_id, coalesce(surface, '') as surface, won from {PM} where player_id is not null) group by grouping sets ((player_id, surface), (player_id))")
def _(s, d):
    p = _pm(s, d).where("player_id is not null").withColumn("surface", F.coalesce("surface", F.lit("")))
    cells = p.groupBy("player_id", "surface").agg(F.count(F.lit(1)).alias("n"), F.sum("won").alias("w"))
    both = F.array(F.struct(F.col("surface").alias("surface"), F.lit(0).alias("is_total")), F.struct(F.lit(None).cast("string").alias("surface"), F.lit(1).alias("is_total")))
    out = cells.select("player_id", "n", "w", F.explode(both).alias("g")).groupBy("player_id", F.col("g.surface").alias("surface"), F.col("g.is_total").alias("is_total")).agg(F.sum("n").alias("played"), F.sum("w").alias("wins"))
    return out.withColumn("win_rate", F.round(F.col("wins") / F.col("played"), 9))


@query("ref_a2_pair_surface", f"select least(winner_player_id, loser_player_id) as a, greatest(winner_player_id, loser_player_id) as b, surface, cast(sum((winner_player_id < loser_player_id)::int) as bigint) as wins_a, cast(sum((winner_player_id > loser_player_id)::int) as bigint) as wins_b from {LATEST} where surface is not null and winner_player_id is not null and loser_player_id is not null group by 1, 2, 3")
def _(s, d):
    m = _m(s, d, "winner_player_id", "loser_player_id", "surface").where("surface is not null and winner_player_id is not null and loser_player_id is not null")
    won = lambda c: F.sum(c.cast("long"))
    return m.groupBy(F.least("winner_player_id", "loser_player_id").alias("a"), F.greatest("winner_player_id", "loser_player_id").alias("b"), "surface").agg(won(F.col("winner_player_id") < F.col("loser_player_id")).alias("wins_a"), won(F.col("winner_player_id") > F.col("loser_player_id")).alias("wins_b"))


@query("ref_a3_a4_career_window", f"select player_id, count(*) as career, cast(count(*) filter (where tourney_date between date '2024-04-02' and date '2024-07-01') as bigint) as in_window, round(avg(won) filter (where tourney_date between date '2024-05-02' and date '2024-07-01'), 9) as recent_rate from {PM} where player_id is not null group by 1")
def _(s, d):
    inside = lambda a: F.col("tourney_date").between(a, "2024-07-01")
    return _pm(s, d).where("player_id is not null").groupBy("player_id").agg(F.count(F.lit(1)).alias("career"), F.count(F.when(inside("2024-04-02"), 1)).alias("in_window"), F.round(F.avg(F.when(inside("2024-05-02"), F.col("won"))), 9).alias("recent_rate"))


@query("ref_a6_usage_buckets", "select cast(coalesce(sum(case when ts >= timestamp '2024-01-29' then 1 else 0 end), 0) as bigint) as today, cast(sum(case when ts >= timestamp '2024-01-28 12:00:00' then 1 else 0 end) as bigint) as last_day, round(coalesce(sum(case when ts >= timestamp '2024-01-01' then value end), 0), 4) as month_total from events")
def _(s, d):
    since = lambda t: F.col("ts") >= F.to_timestamp_ntz(F.lit(t))
    return table(s, d, "events").agg(F.coalesce(F.sum(since("2024-01-29 00:00:00").cast("long")), F.lit(0)).alias("today"), F.sum(since("2024-01-28 12:00:00").cast("long")).alias("last_day"), F.round(F.coalesce(F.sum(F.when(since("2024-01-01 00:00:00"), F.col("value"))), F.lit(0)), 4).alias("month_total"))


@query("ref_a7_latest_run", "select event_type, max(ts) as last_seen from events where value > 0 group by 1")
def _(s, d):
    return table(s, d, "events").where("value > 0").groupBy("event_type").agg(F.max("ts").alias("last_seen"))


@query("ref_a8_namesakes", "select tour, k as name_key, count(distinct player_id) as n, list_sort(list(distinct player_id)) as ids from (select tour, lower(trim(full_name)) as k, player_id from players where full_name is not null and player_id is not null) group by 1, 2 having count(distinct player_id) > 1")
def _(s, d):
    p = table(s, d, "players").where("full_name is not null and player_id is not null").select("tour", F.lower(F.trim("full_name")).alias("name_key"), "player_id").distinct()
    return p.groupBy("tour", "name_key").agg(F.count_distinct("player_id").alias("n"), F.sort_array(F.collect_set("player_id")).alias("ids")).where("n > 1")


@query("ref_a11_tier_counts", f"select tour, match_tier, match_status, count(*) as n from {LATEST} group by 1, 2, 3")
def _(s, d):
    return _m(s, d, "tour", "match_tier", "match_status").groupBy("tour", "match_tier", "match_status").agg(F.count(F.lit(1)).alias("n"))


@query("ref_a12_median_best", "select l_partkey, round(median(l_extendedprice), 6) as median_price, max(l_extendedprice) as best_price, count(*) as n_books, max(l_extendedprice) filter (where l_returnflag = 'N') as flagged_price, round(median((1 / (l_quantity + 1)) / (1 / (l_quantity + 1) + 1 / (l_linenumber + 1))), 9) as median_share from lineitem group by 1")
def _(s, d):
    a, _b = N.implied(F.col("l_quantity") + 1, F.col("l_linenumber") + 1)
    return table(s, d, "lineitem").groupBy("l_partkey").agg(F.round(F.median("l_extendedprice"), 6).alias("median_price"), F.max("l_extendedprice").alias("best_price"), F.count(F.lit(1)).alias("n_books"), F.max(F.when(F.col("l_returnflag") == "N", F.col("l_extendedprice"))).alias("flagged_price"), F.round(F.median(a), 9).alias("median_share"))


_RANKS = "case round when 'R128' then 1 when 'R64' then 2 when 'R32' then 3 when 'R16' then 4 when 'QF' then 5 when 'SF' then 6 when 'F' then 7 end"


@query(
    "ref_w12_a14_contradicted_rounds",
    f"""with m as (select match_id, tour, tourney_id, winner_player_id as a, loser_player_id as b, {_RANKS} as rk from {LATEST}), x as (select tour, tourney_id, p, max(rk) as top from (select tour, tourney_id, unnest([a, b]) as p, rk from m where rk is not null) where p is not null group by 1, 2, 3)
select match_id from m where rk is not null and (exists (select 1 from x where x.tour = m.tour and x.tourney_id = m.tourney_id and x.p = m.a and x.top > m.rk) or exists (select 1 from x where x.tour = m.tour and x.tourney_id = m.tourney_id and x.p = m.b and x.top > m.rk))""",
)
def _(s, d):
    m = _m(s, d, "tour", "tourney_id", "round", "winner_player_id", "loser_player_id")
    rank = N.lookup(F.col("round"), {"R128": 1, "R64": 2, "R32": 3, "R16": 4, "QF": 5, "SF": 6, "F": 7})
    long = m.withColumn("rk", rank).where("rk is not null and tour is not null and tourney_id is not null").select("match_id", "tour", "tourney_id", "rk", F.explode(F.array("winner_player_id", "loser_player_id")).alias("p")).where("p is not null")
    top = F.max("rk").over(Window.partitionBy("tour", "tourney_id", "p"))
    return long.withColumn("top", top).where("top > rk").select("match_id").distinct()


@query("ref_a21_pivot_tour_year", f"select y, coalesce(max(n) filter (where tour = 'ATP'), 0) as atp, coalesce(max(n) filter (where tour = 'WTA'), 0) as wta from (select year(tourney_date) as y, tour, count(*) as n from {LATEST} where tourney_date is not null group by 1, 2) group by 1")
def _(s, d):
    m = _m(s, d, "tour", "tourney_date").where("tourney_date is not null").withColumn("y", F.year("tourney_date").cast("long"))
    return m.groupBy("y").pivot("tour", ["ATP", "WTA"]).count().select("y", F.coalesce("ATP", F.lit(0)).alias("atp"), F.coalesce("WTA", F.lit(0)).alias("wta"))


@query("ref_a20_two_sources", "select month, cast(sum(n) as bigint) as calls from (select strftime(ts, '%Y-%m') as month, count(*) as n from events group by 1 union all select strftime(published_at, '%Y-%m'), count(*) from documents where published_at is not null group by 1) group by 1")
def _(s, d):
    month = lambda df, c: df.where(F.col(c).isNotNull()).groupBy(F.date_format(c, "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return month(table(s, d, "events"), "ts").unionByName(month(table(s, d, "documents"), "published_at")).groupBy("month").agg(F.sum("n").alias("calls"))


@query("ref_a22_hit_ratio", "select l_suppkey, coalesce(round(cast(count(*) filter (where l_returnflag = 'R') as double) / nullif(count(*) filter (where l_returnflag <> 'A'), 0), 9), 0) as ratio from lineitem group by 1")
def _(s, d):
    n = lambda cond: F.sum(cond.cast("long"))
    flag = F.col("l_returnflag")
    return table(s, d, "lineitem").groupBy("l_suppkey").agg(F.coalesce(F.round(F.try_divide(n(flag == "R").cast("double"), n(flag != "A")), 9), F.lit(0.0)).alias("ratio"))


@query("ref_a23_outcomes", "select case when median_odds_a is null then 'no_odds' when median_odds_a <= 1 or median_odds_b <= 1 then 'invalid' else 'loaded' end as outcome, count(*) as n from aggregated_odds group by 1")
def _(s, d):
    o = table(s, d, "aggregated_odds")
    outcome = F.when(F.col("median_odds_a").isNull(), "no_odds").when((F.col("median_odds_a") <= 1) | (F.col("median_odds_b") <= 1), "invalid").otherwise("loaded")
    return o.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("ref_a24_since_id", "select cast(coalesce(max(event_id), 0) as bigint) as last_id, round(coalesce(sum(value) filter (where event_id > 500), 0), 4) as total from events")
def _(s, d):
    return table(s, d, "events").agg(F.coalesce(F.max("event_id"), F.lit(0)).alias("last_id"), F.round(F.coalesce(F.sum(F.when(F.col("event_id") > 500, F.col("value"))), F.lit(0)), 4).alias("total"))


# --- windows, sorts, sets ------------------------------------------------------------------------------------------


@query("ref_w2_pick_tier", f"select tourney_id, match_id from {LATEST} where tourney_id is not null qualify row_number() over (partition by tourney_id order by {TIER}, match_id) = 1")
def _(s, d):
    tier = F.coalesce(N.lookup(F.col("match_tier"), {"main": 1, "qual_chall": 2, "qual_itf": 3}), F.lit(9))
    return K.latest_by_key(_m(s, d, "tourney_id", "match_tier").where("tourney_id is not null"), ["tourney_id"], [tier.asc(), F.col("match_id").asc()]).select("tourney_id", "match_id")


@query(
    "ref_w3_latest_wins",
    f"""select match_id from {LATEST} where round is null or winner_player_id is null or loser_player_id is null union all
select match_id from {LATEST} where round is not null and winner_player_id is not null and loser_player_id is not null
qualify row_number() over (partition by tour, tourney_id, least(winner_player_id, loser_player_id), greatest(winner_player_id, loser_player_id), round order by ingested_at desc nulls last, match_num desc nulls last, match_id) = 1""",
)
def _(s, d):
    m = _m(s, d, "tour", "tourney_id", "round", "winner_player_id", "loser_player_id", "ingested_at", "match_num")
    m = m.withColumns({"low": F.least("winner_player_id", "loser_player_id"), "high": F.greatest("winner_player_id", "loser_player_id")})
    open_ = F.col("round").isNull() | F.col("winner_player_id").isNull() | F.col("loser_player_id").isNull()
    kept = K.latest_by_key(m.where(~open_), ["tour", "tourney_id", "low", "high", "round"], [F.col("ingested_at").desc_nulls_last(), F.col("match_num").desc_nulls_last(), F.col("match_id").asc()])
    return m.where(open_).select("match_id").unionByName(kept.select("match_id"))


@query("ref_w5_top_two", "select o_custkey, max(o_orderkey) filter (where k = 1) as best, max(o_orderkey) filter (where k = 2) as second from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as k from orders) where k <= 2 group by 1")
def _(s, d):
    two = K.top_n_by_key(table(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()], 2)
    pick = lambda k: F.max(F.when(F.col("rank_in_group") == k, F.col("o_orderkey")))
    return two.groupBy("o_custkey").agg(pick(1).alias("best"), pick(2).alias("second"))


@query("ref_t2_top_recent", "select o_orderkey, o_orderdate from orders order by o_orderdate desc, o_orderkey desc limit 50")
def _(s, d):
    return table(s, d, "orders").select("o_orderkey", "o_orderdate").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).limit(50)


@query("ref_t4_nulls_last_top", "select record_id, height from (select distinct record_id, height from players) order by height asc nulls last, record_id limit 100")
def _(s, d):
    return table(s, d, "players").select("record_id", "height").distinct().orderBy(F.col("height").asc_nulls_last(), "record_id").limit(100)


@query("ref_t6_t7_custom_order", f"select player_id, n from (select player_id, count(*) as n, case min(tour) when 'ATP' then 0 when 'WTA' then 1 else 2 end as o from {PM} where player_id is not null group by 1) order by o, n desc, player_id limit 30")
def _(s, d):
    p = _pm(s, d).where("player_id is not null").groupBy("player_id").agg(F.count(F.lit(1)).alias("n"), F.min("tour").alias("tour"))
    return p.orderBy(F.when(F.col("tour") == "ATP", 0).when(F.col("tour") == "WTA", 1).otherwise(2), F.col("n").desc(), "player_id").select("player_id", "n").limit(30)


@query("ref_u2_alias_forms", "select distinct unnest([f || ' ' || l, l || ' ' || f, l || ' ' || substr(f, 1, 1) || '.']) as alias, tour, player_id from (select trim(name_first) as f, trim(name_last) as l, tour, player_id from players) where f <> '' and l <> '' and lower(f) <> 'unknown' and lower(l) <> 'unknown'")
def _(s, d):
    return R.alias_forms(table(s, d, "players"))


@query("ref_u3_union_distinct", f"select winner_player_id as player_id from {LATEST} union select loser_player_id from {LATEST}")
def _(s, d):
    m = _m(s, d, "winner_player_id", "loser_player_id")
    return m.select(F.explode(F.array("winner_player_id", "loser_player_id")).alias("player_id")).distinct()


@query("ref_u4_u5_set_operations", "(select player_id from players intersect select player_id from rankings) union all (select player_id from rankings except select player_id from players)")
def _(s, d):
    p, r = table(s, d, "players").select("player_id"), table(s, d, "rankings").select("player_id")
    return p.intersect(r).unionByName(r.exceptAll(r.join(p.distinct(), "player_id", "left_semi")).distinct())
