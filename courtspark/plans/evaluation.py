"""Evaluation, composite analytics and streaming queries over the test tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from courtspark.functions import normalize as N
from courtspark.operators import evaluate as E
from courtspark.operators import features as X
from courtspark.operators import keyed as K
from courtspark.operators.asof import latest_before
from courtspark.plans.relational import PM, _pm
from courtspark.plans.replay import _LATEST as LATEST
from courtspark.plans.replay import ELO_STEPS, VECTOR, _contests, _matches, _roster
from courtspark.session import cut, stored
from courtspark.sources import files
from courtspark.sources.tables import matches_latest, table
from courtspark.streaming import jobs

QUERIES: dict = {}
ORACLE: dict = {}


def query(name, sql=None):
    def keep(run):
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return run

    return keep


_VECTORS = "with v as (" + VECTOR + ")"

# predictions for the metrics: ratings before the contest, seen from the smaller id
_PRED = f"""{ELO_STEPS}, pr as (select match_id, tourney_date, case when p1_won = 1 then wb - lb else lb - wb end as d, p1_won as y from (select e.match_id, e.wb, e.lb, c.tourney_date, case when c.winner_player_id < c.loser_player_id then 1 else 0 end as p1_won from e join c on c.match_id = e.match_id where e.k > 0)),
q as (select match_id, tourney_date, year(tourney_date) as yr, y, d, round(1 / (1 + pow(10, -d / 400)), 9) as p, cast(abs(round(d * 3, 0)) as integer) as gap from pr)"""


def _predictions(s, d):
    rows = _contests(s, d)
    e = X.elo(rows).select("match_id", "winner_player_id", "loser_player_id", "winner_before", "loser_before").join(rows.select("match_id", "tourney_date"), "match_id")
    y = (F.col("winner_player_id") < F.col("loser_player_id")).cast("int")
    e = e.withColumn("y", y).withColumn("d", F.when(F.col("y") == 1, F.col("winner_before") - F.col("loser_before")).otherwise(F.col("loser_before") - F.col("winner_before")))
    return e.select("match_id", "tourney_date", F.year("tourney_date").alias("yr"), "y", "d", F.round(N.expected_score(F.col("d")), 9).alias("p"), F.abs(F.round(F.col("d") * 3, 0)).cast("int").alias("gap"))


def _round(df):
    return df.select(*[F.round(c, 7).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("ref_m4_elo_baseline", f"{_PRED} select match_id, round(p, 7) as p from q")
def _(s, d):
    return _round(_predictions(s, d).select("match_id", "p"))


@query("ref_a16_metrics", f"{_PRED} select yr::integer as yr, count(*) as n, round(avg(pow(p - y, 2)), 7) as brier, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 7) as log_loss, round(avg(((p >= 0.5)::int = y)::int), 7) as accuracy from q group by 1")
def _(s, d):
    return _round(E.metrics(_predictions(s, d), "y", "p", ["yr"]))


@query("ref_a17_gap_accuracy", f"{_PRED} select b as bucket, count(q.y) as n, round(avg(((p >= 0.5)::int = y)::int), 7) as accuracy from (values ('0_50', 0, 50), ('50_200', 50, 200), ('200_inf', 200, 10000)) t(b, lo, hi) left join q on gap >= lo and gap < hi group by 1")
def _(s, d):
    return _round(E.accuracy_by_gap(_predictions(s, d), "y", "p", "gap"))


@query("ref_a18_reliability", f"{_PRED}, g as (select i, i * 0.1::double as lo, (i + 1) * 0.1::double as hi from range(10) t(i)) select cast(i as integer) as bin, round(lo, 7) as bin_lower, round(hi, 7) as bin_upper, count(q.y) as n, round(avg(p), 7) as mean_predicted, round(avg(y), 7) as mean_actual from g left join q on (p >= lo and p < hi) or (i = 9 and p = 1) group by i, lo, hi")
def _(s, d):
    return _round(E.reliability(_predictions(s, d), "y", "p"))


@query("ref_a15_weighted_folds", f"{_PRED}, f as (select yr, count(*) as n, avg(pow(p - y, 2)) as brier from q group by 1) select round(sum(n * brier) / sum(n), 7) as brier, count(*) as folds from f")
def _(s, d):
    per = E.metrics(_predictions(s, d), "y", "p", ["yr"])
    return _round(per.agg(E.weighted_mean("brier", "n").alias("brier"), F.count(F.lit(1)).alias("folds")))


@query(
    "ref_m2_walk_forward",
    "with o as (select year(o_orderdate) as y from orders), v as (select unnest([1995, 1996, 1997, 1998, 1999, 2000, 2001, 2002]) as v), r as (select v as validate_year, case when y <= v - 2 then 'train' when y = v - 1 then 'calibrate' when y = v then 'validate' end as role from o join v on y <= v) select validate_year, role, count(*) as n from r where role is not null and validate_year in (select validate_year from r group by 1 having count(distinct role) = 3) group by 1, 2",
)
def _(s, d):
    f = E.fold_table(table(s, d, "orders").select("o_orderdate"), "o_orderdate", list(range(1995, 2003)))
    return f.groupBy("validate_year", "role").agg(F.count(F.lit(1)).alias("n"))


@query("ref_m3_production_split", "select case when year(o_orderdate) <= 1999 then 'train' else 'calibrate' end as part, count(*) as n from orders where year(o_orderdate) <= 2000 group by 1")
def _(s, d):
    y = F.year("o_orderdate")
    return table(s, d, "orders").where(y <= 2000).groupBy(F.when(y <= 1999, "train").otherwise("calibrate").alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("ref_m6_calibration")
def _(s, d):
    p = cut(_predictions(s, d))
    out = E.calibrate(p.where("yr = 2023"), "p", "y", p.where("yr = 2024"))
    return out.select("match_id", "p", F.round("calibrated", 9).alias("calibrated"))


_FEATURES = [f"{c}_{p}" for p in ("p1", "p2") for c in ("win_pct_last10", "win_pct_last25_surface", "first_serve_win_pct", "second_serve_win_pct", "bp_saved_pct", "bp_converted_pct", "fatigue_matches_7d", "fatigue_sets_14d", "days_since_last_match", "days_since_last_match_surface", "rank", "age", "age_vs_peak", "height", "left_handed")] + ["rank_diff", "height_diff_cm", "h2h_p1_wins", "h2h_p2_wins", "h2h_recency_days", "elo_p1_surface", "elo_p2_surface", "elo_diff_surface", "best_of", "level_code", "surface_code"]


def _training(s, d):
    """All features as numbers, with the listing market's probability where names and day tell the listing."""
    v = X.feature_vectors(_matches(s, d), table(s, d, "rankings"), _roster(s, d))
    v = v.withColumns({f"left_handed_{p}": (F.col(f"hand_{p}") == "L").cast("int") for p in ("p1", "p2")})
    v = v.withColumns({"level_code": N.lookup(F.col("level"), {"Slam": 5, "Finals": 4, "M1000": 3, "ATP500": 2, "WTA500": 2, "ATP250": 1, "WTA250": 1}), "surface_code": N.lookup(F.col("surface"), {"Hard": 0, "IHard": 1, "Clay": 2, "Grass": 3})})
    v = v.join(_market(s, d).select("match_id", F.col("market_p1").alias("market")), "match_id", "left")
    return stored(v.select("match_id", "tour", "tourney_date", "p1", "p2", "label", "market", *[F.col(c).cast("double").alias(c) for c in _FEATURES]))


def _folds(s, d):
    return E.fold_table(_training(s, d), "tourney_date", range(2023 * 2, 2025 * 2), months=6)


@query("ref_m1_training_frame", f"{_VECTORS} select match_id, row_number() over (order by tourney_date, match_id) as position, label from v")
def _(s, d):
    v = X.feature_vectors(_matches(s, d), table(s, d, "rankings"), _roster(s, d), with_elo=False)
    return files.numbered_rows(v.select("match_id", "tourney_date", "label"), [F.col("tourney_date").asc(), F.col("match_id").asc()]).select("match_id", "position", "label")


@query("ref_m5_m7_m12_walk_forward")
def _(s, d):
    """Per half-year fold: 41 features, early stopping, calibration, metrics before and after; and the report as JSON."""
    out = stored(E.walk_forward(_folds(s, d), _FEATURES, "label", lambda train, held: E.boosted_trees(train, _FEATURES, "label", rounds=8, held=held), "market"))
    return out.join(F.broadcast(E.report(out).select("means")))  # one row


@query("ref_m10_m11_score_and_reload")
def _(s, d):
    """Scores of fixtures seen from the greater id, from a model written and read again; `same` says the reloaded one gives the same."""
    v = _training(s, d).where("tourney_date < date'2024-01-01'")
    model, at = E.boosted_trees(v, _FEATURES, "label", rounds=4), files.scratch(s)
    E.save_model(model, at)
    here = E.score_trees(model, v, _FEATURES).select("match_id", "p1", "p2", F.col("probability_p1").alias("a"))
    back = E.score_trees(E.load_trees(at), v, _FEATURES).select("match_id", F.col("probability_p1").alias("b"))
    out = E.turned(here.join(back, "match_id"), "b", "p1", "p2")
    return out.select("match_id", F.round("probability_a", 9).alias("probability_a"), (F.abs(F.col("a") - F.col("b")) < 1e-9).alias("same"))


_NAMED = "(select distinct tour, player_id, lower(trim(full_name)) as name from players where player_id is not null and full_name is not null)"
_MARKET = f"(select match_id, p from (select m.match_id, case when x.player_id = least(winner_player_id, loser_player_id) then o.median_implied_prob_a else 1 - o.median_implied_prob_a end as p, o.fetched_at, o.event_id from aggregated_odds o join {_NAMED} x on x.tour = o.tour and x.name = lower(trim(o.player_a_name)) join {_NAMED} y on y.tour = o.tour and y.name = lower(trim(o.player_b_name)) join {LATEST} m on least(m.winner_player_id, m.loser_player_id) = least(x.player_id, y.player_id) and greatest(m.winner_player_id, m.loser_player_id) = greatest(x.player_id, y.player_id) and date_diff('day', m.tourney_date, cast(o.commence_time_utc as date)) between 0 and 8 where o.median_implied_prob_a is not null and x.player_id <> y.player_id) qualify row_number() over (partition by match_id order by fetched_at desc nulls last, event_id, p) = 1)"


def _market(s, d):
    """(match_id, market_p1, tourney_date, label): the latest listing whose names are spelt in full, its probability turned to the smaller id."""
    named = table(s, d, "players").where("player_id is not null and full_name is not null").select("tour", "player_id", F.lower(F.trim("full_name")).alias("name")).distinct()
    o = table(s, d, "aggregated_odds").where("median_implied_prob_a is not null").select("event_id", "tour", "fetched_at", F.to_date("commence_time_utc").alias("day"), F.col("median_implied_prob_a").alias("p"), F.lower(F.trim("player_a_name")).alias("a"), F.lower(F.trim("player_b_name")).alias("b"))
    for c in "ab":
        o = o.join(named.select("tour", F.col("name").alias(c), F.col("player_id").alias(f"{c}_id")), ["tour", c])
    o = o.where("a_id <> b_id").select("event_id", "fetched_at", "day", *K.pair_key(F.col("a_id"), F.col("b_id")), F.when(F.col("a_id") < F.col("b_id"), F.col("p")).otherwise(1 - F.col("p")).alias("market_p1"))
    m = matches_latest(s, d, ["winner_player_id", "loser_player_id", "tourney_date"])
    m = m.select("match_id", "tourney_date", *K.pair_key(F.col("winner_player_id"), F.col("loser_player_id")), (F.col("winner_player_id") < F.col("loser_player_id")).cast("int").alias("label"))
    both = m.join(o, ["pair_low", "pair_high"]).where(F.date_diff("day", "tourney_date").between(0, 8))
    return K.latest_by_key(both, ["match_id"], [F.col("fetched_at").desc_nulls_last(), F.col("event_id").asc(), F.col("market_p1").asc()]).select("match_id", "market_p1", "tourney_date", "label")


@query("ref_m8_market_benchmark", f"select count(*) as n, round(avg(pow(p - y, 2)), 7) as brier, round(avg(((p >= 0.5)::int = y)::int), 7) as accuracy from (select x.p, case when m.winner_player_id < m.loser_player_id then 1 else 0 end as y from {_MARKET} x join {LATEST} m using (match_id))")
def _(s, d):
    return _round(E.metrics(_market(s, d), "label", "market_p1").select("n", "brier", "accuracy"))


@query("ref_m9_last_folds", f"{_PRED}, f as (select yr * 4 + quarter(tourney_date) - 1 as v, count(*) as n, avg(pow(p - y, 2)) as brier from q group by 1), l as (select * from f qualify row_number() over (order by v desc) <= 3) select round(sum(n * brier) / sum(n), 7) as brier, count(*) as folds from l")
def _(s, d):
    p = _predictions(s, d).withColumn("v", F.col("yr") * 4 + F.quarter("tourney_date") - 1)
    per = E.metrics(p, "y", "p", ["v"]).orderBy(F.col("v").desc()).limit(3)
    return _round(per.agg(E.weighted_mean("brier", "n").alias("brier"), F.count(F.lit(1)).alias("folds")))


# --- composites: one set-based plan for all players instead of one lookup per call ------------------------------------


@query("ref_c_player_stats", f"select player_id, coalesce(surface, 'all') as surface, n as played, w as wins from (select player_id, surface, count(*) as n, cast(sum(won) as bigint) as w from {PM} where player_id is not null and surface in ('Hard', 'Clay', 'Grass') and match_tier in ('main', 'qual_chall', 'qual_itf') and tourney_date < date '2024-06-01' group by grouping sets ((player_id, surface), (player_id)))")
def _(s, d):
    p = _pm(s, d).where("player_id is not null and surface in ('Hard', 'Clay', 'Grass') and match_tier in ('main', 'qual_chall', 'qual_itf') and tourney_date < date'2024-06-01'")
    cells = p.groupBy("player_id", "surface").agg(F.count(F.lit(1)).alias("n"), F.sum("won").alias("w"))
    return cells.withColumn("surface", F.explode(F.array("surface", F.lit("all")))).groupBy("player_id", "surface").agg(F.sum("n").alias("played"), F.sum("w").alias("wins"))


@query("ref_c_recent_form", f"select player_id, match_id, won, cast(k as integer) as place, cast(date '2024-07-01' - tourney_date as integer) as days_ago from (select *, row_number() over (partition by player_id order by tourney_date desc, match_num desc nulls last, match_id desc) as k from {PM} where player_id is not null and tourney_date < date '2024-07-01') where k <= 8")
def _(s, d):
    p = _pm(s, d).where("player_id is not null and tourney_date < date'2024-07-01'").select("player_id", "match_id", "won", "tourney_date", "match_num")
    top = K.top_n_by_key(p, ["player_id"], [F.col("tourney_date").desc(), F.col("match_num").desc_nulls_last(), F.col("match_id").desc()], 8)
    return top.select("player_id", "match_id", "won", F.col("rank_in_group").alias("place"), F.date_diff(F.lit("2024-07-01").cast("date"), "tourney_date").alias("days_ago"))


@query(
    "ref_c_head_to_head_summary",
    f"select least(player_id, opponent_id) as a, greatest(player_id, opponent_id) as b, count(*) as met, cast(sum(won) as bigint) as wins_a, max(tourney_date) as last_met from {PM} where player_id < opponent_id group by 1, 2",
)
def _(s, d):
    p = _pm(s, d).where("player_id < opponent_id")
    return p.groupBy(F.col("player_id").alias("a"), F.col("opponent_id").alias("b")).agg(F.count(F.lit(1)).alias("met"), F.sum("won").alias("wins_a"), F.max("tourney_date").alias("last_met"))


@query(
    "ref_c_difference_reasons",
    f"""with x as (select player_id, count(*) filter (where tourney_date between date '2024-04-02' and date '2024-07-01') as active, count(*) as career, max(tourney_date) filter (where tourney_date <= date '2024-07-01') as last_day, count(*) filter (where tourney_date between date '2024-05-02' and date '2024-07-01') as n60, avg(won) filter (where tourney_date between date '2024-05-02' and date '2024-07-01') as form from {PM} where player_id is not null group by 1)
select a.player_id as a, b.player_id as b, (a.active >= 10 and b.active < 3) or (b.active >= 10 and a.active < 3) as activity_gap, coalesce(date '2024-07-01' - a.last_day > 180 or date '2024-07-01' - b.last_day > 180, false) as stale, coalesce(abs(a.form - b.form) >= 0.3 and a.n60 >= 5 and b.n60 >= 5, false) as form_gap, (a.career >= 200 and b.career < 30) or (b.career >= 200 and a.career < 30) as career_gap
from (select distinct winner_player_id, loser_player_id from {LATEST}) m join x a on a.player_id = winner_player_id join x b on b.player_id = loser_player_id""",
)
def _(s, d):
    now = F.lit("2024-07-01").cast("date")
    day = F.col("tourney_date")
    near = day.between("2024-05-02", "2024-07-01")
    x = _pm(s, d).where("player_id is not null").groupBy("player_id").agg(F.count(F.when(day.between("2024-04-02", "2024-07-01"), 1)).alias("active"), F.count(F.lit(1)).alias("career"), F.max(F.when(day <= now, day)).alias("last_day"), F.count(F.when(near, 1)).alias("n60"), F.avg(F.when(near, F.col("won"))).alias("form"))
    side = lambda q: x.select(F.col("player_id").alias(q), *[F.col(c).alias(f"{q}_{c}") for c in ("active", "career", "last_day", "n60", "form")])
    m = matches_latest(s, d, ["winner_player_id", "loser_player_id"]).select(F.col("winner_player_id").alias("a"), F.col("loser_player_id").alias("b")).distinct().join(side("a"), "a").join(side("b"), "b")
    either = lambda c, hi, lo: ((F.col(f"a_{c}") >= hi) & (F.col(f"b_{c}") < lo)) | ((F.col(f"b_{c}") >= hi) & (F.col(f"a_{c}") < lo))
    old = (F.date_diff(now, "a_last_day") > 180) | (F.date_diff(now, "b_last_day") > 180)
    gap = (F.abs(F.col("a_form") - F.col("b_form")) >= 0.3) & (F.col("a_n60") >= 5) & (F.col("b_n60") >= 5)
    return m.select("a", "b", either("active", 10, 3).alias("activity_gap"), F.coalesce(old, F.lit(False)).alias("stale"), F.coalesce(gap, F.lit(False)).alias("form_gap"), either("career", 200, 30).alias("career_gap"))


@query("ref_c_player_ranking", f"select m.match_id, r.rank, cast(m.tourney_date - r.ranking_date as integer) as age_days from (select * from {LATEST} where winner_player_id is not null and tourney_date is not null) m asof left join (select player_id, ranking_date, min(rank) as rank from rankings where rank is not null group by 1, 2) r on r.player_id = m.winner_player_id and r.ranking_date <= m.tourney_date")
def _(s, d):
    m = matches_latest(s, d, ["winner_player_id", "tourney_date"]).where("winner_player_id is not null and tourney_date is not null")
    r = table(s, d, "rankings").where("rank is not null").groupBy(F.col("player_id").alias("winner_player_id"), "ranking_date").agg(F.min("rank").alias("rank"))
    out = latest_before(m, r, "winner_player_id", "tourney_date", "ranking_date", ["rank"])
    return out.select("match_id", F.col("asof.rank").alias("rank"), F.date_diff("tourney_date", "asof.ranking_date").alias("age_days"))


@query("ref_c_coverage_report", f"select tour, match_tier, count(*) as n, count(distinct tourney_id) as events, min(tourney_date) as first_day, max(tourney_date) as last_day, round(100.0 * count(w_svpt) / count(*), 4)::double as with_stats_pct from {LATEST} group by 1, 2")
def _(s, d):
    m = matches_latest(s, d, ["tour", "match_tier", "tourney_id", "tourney_date", "w_svpt"])
    return m.groupBy("tour", "match_tier").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("tourney_id").alias("events"), F.min("tourney_date").alias("first_day"), F.max("tourney_date").alias("last_day"), F.round(F.lit(100.0) * F.count("w_svpt") / F.count(F.lit(1)), 4).alias("with_stats_pct"))


@query("ref_p2_head_to_head", f"select a, b, coalesce(surface, 'all') as surface, met, wins_a, n.name as name_a, o.name as name_b from (select least(player_id, opponent_id) as a, greatest(player_id, opponent_id) as b, surface, count(*) as met, cast(sum(won) as bigint) as wins_a from {PM} where player_id < opponent_id and surface is not null group by grouping sets ((1, 2, 3), (1, 2))) left join (select player_id, min(full_name) as name from players group by 1) n on n.player_id = a left join (select player_id, min(full_name) as name from players group by 1) o on o.player_id = b".replace("grouping sets ((1, 2, 3), (1, 2))", "grouping sets ((a, b, surface), (a, b))"))
def _(s, d):
    p = _pm(s, d).where("player_id < opponent_id and surface is not null").groupBy(F.col("player_id").alias("a"), F.col("opponent_id").alias("b"), "surface").agg(F.count(F.lit(1)).alias("n"), F.sum("won").alias("w"))
    out = p.withColumn("surface", F.explode(F.array("surface", F.lit("all")))).groupBy("a", "b", "surface").agg(F.sum("n").alias("met"), F.sum("w").alias("wins_a"))
    names = table(s, d, "players").groupBy("player_id").agg(F.min("full_name").alias("name"))
    for c in "ab":
        out = out.join(names.select(F.col("player_id").alias(c), F.col("name").alias(f"name_{c}")), c, "left")
    return out


@query("ref_p3_form_freshness", f"select player_id, count(*) as shown, cast(sum(won) as bigint) as won, max(tourney_date) as last_day, date '2024-07-01' - max(tourney_date) > 7 as outdated, min(coalesce(n.name, opponent_id)) as first_opponent from (select *, row_number() over (partition by player_id order by tourney_date desc, match_num desc nulls last, match_id desc) as k from {PM} where player_id is not null and tourney_date < date '2024-07-01') x left join (select player_id as id, min(full_name) as name from players group by 1) n on n.id = x.opponent_id where k <= 10 group by 1")
def _(s, d):
    p = _pm(s, d).where("player_id is not null and tourney_date < date'2024-07-01'").select("player_id", "opponent_id", "match_id", "won", "tourney_date", "match_num")
    top = K.top_n_by_key(p, ["player_id"], [F.col("tourney_date").desc(), F.col("match_num").desc_nulls_last(), F.col("match_id").desc()], 10)
    names = table(s, d, "players").groupBy(F.col("player_id").alias("opponent_id")).agg(F.min("full_name").alias("name"))
    out = top.join(names, "opponent_id", "left").groupBy("player_id").agg(F.count(F.lit(1)).alias("shown"), F.sum("won").alias("won"), F.max("tourney_date").alias("last_day"), F.min(F.coalesce("name", "opponent_id")).alias("first_opponent"))
    return out.withColumn("outdated", F.date_diff(F.lit("2024-07-01").cast("date"), "last_day") > 7)


_SNAP = f"{ELO_STEPS}, sides as (select tour, surface, k, unnest([o.w, o.l]) as player_id, unnest([wb + 32 * (1 - 1 / (1 + pow(10, (lb - wb) / 400))), lb - 32 * (1 - 1 / (1 + pow(10, (lb - wb) / 400)))]) as rating, tourney_date from e join o using (tour, surface, k) join c on c.match_id = o.match_id where e.k > 0), snap as (select * from sides qualify row_number() over (partition by tour, surface, player_id order by k desc) = 1)"


@query("ref_p5_surface_elo", f"{_SNAP}, f as (select distinct tour, surface, least(winner_player_id, loser_player_id) as a, greatest(winner_player_id, loser_player_id) as b from c where tourney_date >= date '2024-01-01'), g as (select distinct tour, s.surface, a, b from f, (values ('Hard'), ('Grass')) s(surface)) select g.tour, g.surface, a, b, round(coalesce(x.rating, 1500), 6) as elo_a, round(coalesce(y.rating, 1500), 6) as elo_b, round(1 / (1 + pow(10, -(coalesce(x.rating, 1500) - coalesce(y.rating, 1500)) / 400)), 9) as expected_a, greatest(x.tourney_date, y.tourney_date) as snapshot_day from g left join snap x on x.tour = g.tour and x.surface = g.surface and x.player_id = a left join snap y on y.tour = g.tour and y.surface = g.surface and y.player_id = b")
def _(s, d):
    rows = cut(_contests(s, d))
    snap = stored(X.elo_snapshot(rows))
    asked = rows.where("tourney_date >= date'2024-01-01'").select("tour", F.least("winner_player_id", "loser_player_id").alias("a"), F.greatest("winner_player_id", "loser_player_id").alias("b")).distinct().withColumn("surface", F.explode(F.array(F.lit("Hard"), F.lit("Grass"))))
    for c in "ab":
        asked = asked.join(snap.select("tour", "surface", F.col("player_id").alias(c), F.col("rating").alias(f"r_{c}"), F.col("last_updated").alias(f"d_{c}")), ["tour", "surface", c], "left")
    a, b = F.coalesce("r_a", F.lit(1500.0)), F.coalesce("r_b", F.lit(1500.0))
    return asked.select("tour", "surface", "a", "b", F.round(a, 6).alias("elo_a"), F.round(b, 6).alias("elo_b"), F.round(N.expected_score(a - b), 9).alias("expected_a"), F.greatest("d_a", "d_b").alias("snapshot_day"))


@query("ref_p7_live_then_cold", f"with live as (select user_id, max(ts) as ts from events group by 1), k as (select player_id, cast(substr(player_id, 5) as bigint) % 100 as uid from (select distinct player_id from {PM} where player_id is not null)) select k.player_id, case when l.ts >= timestamp '2024-01-29' then 'live' when n.n > 0 then 'cold' else 'none' end as origin, coalesce(n.n, 0) as n from k left join live l on l.user_id = k.uid left join (select player_id, least(count(*), 5) as n from {PM} where match_status = 'completed' group by 1) n using (player_id)")
def _(s, d):
    """Recent contests from the live cache where that is fresh, else the last five of the archive."""
    pm = _pm(s, d).where("player_id is not null")
    live = K.latest_by_key(table(s, d, "events").select("user_id", "ts"), ["user_id"], [F.col("ts").desc()])
    asked = pm.select("player_id").distinct().withColumn("user_id", F.substring("player_id", 5, 20).cast("long") % 100)
    cold = K.top_n_by_key(pm.where("match_status = 'completed'").select("player_id", "match_id", "tourney_date"), ["player_id"], [F.col("tourney_date").desc_nulls_last(), F.col("match_id").desc()], 5).groupBy("player_id").agg(F.count(F.lit(1)).alias("n"))
    out = asked.join(live, "user_id", "left").join(cold, "player_id", "left")
    return out.select("player_id", F.when(F.col("ts") >= F.to_timestamp_ntz(F.lit("2024-01-29 00:00:00")), "live").when(F.col("n") > 0, "cold").otherwise("none").alias("origin"), F.coalesce("n", F.lit(0)).alias("n"))


@query("ref_p8_p9_scoreboard", f"{_PRED} select q.match_id, round((q.p - x.p) * 100, 6) as gap_pp, abs((q.p - x.p) * 100) > 10 as panel, (q.p - 0.5) * (x.p - 0.5) < 0 and abs(q.p - x.p) >= 0.05 as model_against_market, (q.p >= 0.5)::int = y as model_right, (x.p >= 0.5)::int = y as market_right from q join {{0}} x using (match_id)".replace("{0}", _MARKET))
def _(s, d):
    p = _predictions(s, d).join(_market(s, d).select("match_id", "market_p1"), "match_id")
    gap = F.col("p") - F.col("market_p1")
    return p.select("match_id", F.round(gap * 100, 6).alias("gap_pp"), (F.abs(gap * 100) > 10).alias("panel"), (((F.col("p") - 0.5) * (F.col("market_p1") - 0.5) < 0) & (F.abs(gap) >= 0.05)).alias("model_against_market"), ((F.col("p") >= 0.5).cast("int") == F.col("y")).alias("model_right"), ((F.col("market_p1") >= 0.5).cast("int") == F.col("y")).alias("market_right"))


@query("ref_p11_home_listing", "select tour, sport_key, cast(row_number() over (order by case tour when 'ATP' then 0 when 'WTA' then 1 else 2 end, sport_key) as bigint) as position, count(*) as fixtures, min(commence_time_utc) as first_start from aggregated_odds where tour is not null and sport_key is not null and (commence_time_utc is null or cast(commence_time_utc as date) between date '2024-01-01' and date '2024-06-30') group by 1, 2")
def _(s, d):
    o = table(s, d, "aggregated_odds").where("tour is not null and sport_key is not null and (commence_time_utc is null or to_date(commence_time_utc) between date'2024-01-01' and date'2024-06-30')")
    g = o.groupBy("tour", "sport_key").agg(F.count(F.lit(1)).alias("fixtures"), F.min("commence_time_utc").alias("first_start"))
    return files.numbered_rows(g, [F.when(F.col("tour") == "ATP", 0).when(F.col("tour") == "WTA", 1).otherwise(2).asc(), F.col("sport_key").asc()])


_RK = "case round when 'R128' then 1 when 'R64' then 2 when 'R32' then 3 when 'R16' then 4 when 'QF' then 5 when 'SF' then 6 when 'F' then 7 end"


@query(
    "ref_p13_refresh",
    f"""with m as (select match_id, tour, tourney_id, round, match_num, ingested_at, winner_player_id as w, loser_player_id as l, match_status, {_RK} as rk from {LATEST} where tour is not null and tourney_id is not null and winner_player_id is not null and loser_player_id is not null),
top as (select tour, tourney_id, p, max(rk) as top from (select tour, tourney_id, unnest([w, l]) as p, rk from m where rk is not null) group by 1, 2, 3),
a as (select m.* from m left join top x on x.tour = m.tour and x.tourney_id = m.tourney_id and x.p = m.w left join top y on y.tour = m.tour and y.tourney_id = m.tourney_id and y.p = m.l where rk is null or (x.top <= rk and y.top <= rk)),
b as (select * from a where round is null union all select * from a where round is not null qualify row_number() over (partition by tour, tourney_id, least(w, l), greatest(w, l), round order by ingested_at desc nulls last, match_num desc nulls last, match_id) = 1)
select match_id from b where not exists (select 1 from {LATEST} r where r.match_status = 'completed' and r.tourney_id = b.tourney_id and coalesce(r.round, '') = coalesce(b.round, '') and least(r.winner_player_id, r.loser_player_id) = least(w, l) and greatest(r.winner_player_id, r.loser_player_id) = greatest(w, l))""",
)
def _(s, d):
    """The daily refresh over fixtures: contradicted rounds, then repeated fixtures, then those with a result go; each step one anti-join or pick."""
    m = matches_latest(s, d, ["tour", "tourney_id", "round", "match_num", "ingested_at", "winner_player_id", "loser_player_id", "match_status"]).where("tour is not null and tourney_id is not null and winner_player_id is not null and loser_player_id is not null")
    m = m.withColumn("rk", N.lookup(F.col("round"), {"R128": 1, "R64": 2, "R32": 3, "R16": 4, "QF": 5, "SF": 6, "F": 7})).select("*", *K.pair_key(F.col("winner_player_id"), F.col("loser_player_id")))
    long = m.where("rk is not null").select("match_id", "tour", "tourney_id", "rk", F.explode(F.array("winner_player_id", "loser_player_id")).alias("p"))
    top = long.groupBy("tour", "tourney_id", "p").agg(F.max("rk").alias("top"))
    against = long.join(top, ["tour", "tourney_id", "p"]).where("top > rk").select("match_id").distinct()
    kept = m.join(against, "match_id", "left_anti")
    one = K.latest_by_key(kept.where("round is not null"), ["tour", "tourney_id", "pair_low", "pair_high", "round"], [F.col("ingested_at").desc_nulls_last(), F.col("match_num").desc_nulls_last(), F.col("match_id").asc()])
    fixtures = kept.where("round is null").unionByName(one).withColumn("round_key", F.coalesce("round", F.lit("")))
    done = m.where("match_status = 'completed'").select("tourney_id", F.coalesce("round", F.lit("")).alias("round_key"), "pair_low", "pair_high").distinct()
    return fixtures.join(done, ["tourney_id", "round_key", "pair_low", "pair_high"], "left_anti").select("match_id")


# --- streaming ---------------------------------------------------------------------------------------------------------


def _stream(s, d, name):
    t = table(s, d, name)
    at = files.scratch(s)
    t.repartition(3).write.parquet(at)
    return jobs.read_stream(s, at, t.schema)


@query("ref_stream_upsert", "select user_id, event_type, event_id from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1")
def _(s, d):
    snap = jobs.upsert_stream(_stream(s, d, "events"), files.scratch(s), "latest", files.scratch(s), ["user_id", "event_type"], ["ts", "event_id"])
    return snap.read().select("user_id", "event_type", "event_id")


@query("ref_stream_windows", "select date_trunc('day', ts)::timestamp as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def _(s, d):
    counts = jobs.windowed_counts(_stream(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "value", late="60 days")
    root = files.scratch(s)
    jobs.drain(counts, files.scratch(s), lambda batch, _: batch.write.mode("overwrite").parquet(root), mode="complete")
    return s.read.parquet(root).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("ref_stream_sessions", "with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hours then 0 else 1 end as fresh from events), n as (select user_id, ts, sum(fresh) over (partition by user_id order by ts) as k from g) select min(ts) as session_start, max(ts) + interval 6 hours as session_end, user_id, count(*) as n from n group by user_id, k")
def _(s, d):
    found = jobs.sessions(_stream(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "user_id", late="60 days")
    root = files.scratch(s)
    jobs.drain(found, files.scratch(s), lambda batch, _: batch.write.mode("overwrite").parquet(root), mode="complete")
    return s.read.parquet(root).select(F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "user_id", "n")


@query("ref_stream_ratings", f"{ELO_STEPS} select match_id, round(wb, 6) as winner_before, round(lb, 6) as loser_before from e where k > 0")
def _(s, d):
    rows = _contests(s, d)
    keyed = rows.select(F.concat_ws("|", "tour", "surface").alias("ladder"), F.col("tourney_date").alias("day"), F.struct(F.coalesce("tourney_id", F.lit("")).alias("a"), F.coalesce("match_num", F.lit(-1)).alias("b"), F.col("match_id").alias("c")).alias("key"), F.col("winner_player_id").alias("winner"), F.col("loser_player_id").alias("loser"))
    at, span = files.scratch(s), keyed.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).first()
    third = (span["hi"] - span["lo"]) / 3 if span["lo"] else dt.timedelta(0)
    ends = [None, *[span["lo"] + third * k for k in (1, 2)], None] if span["lo"] else [None, None]
    for lo, hi in zip(ends, ends[1:], strict=False):  # in order of arrival, one a micro-batch
        part = keyed.where(F.col("day") > F.lit(lo)) if lo else keyed
        (part.where(F.col("day") <= F.lit(hi)) if hi else part).coalesce(1).write.mode("append").parquet(at)
    _, scored = jobs.rating_stream(jobs.read_stream(s, at, keyed.schema), files.scratch(s), "elo", files.scratch(s))
    return scored.read().select(F.col("key.c").alias("match_id"), F.round("winner_before", 6).alias("winner_before"), F.round("loser_before", 6).alias("loser_before"))
