"""Filters, sources and kept state over the archive tables, each with its SQL; the SQL holds its own constants."""

from __future__ import annotations

import json
from itertools import islice

from pyspark.sql import functions as F

from courtspark.functions import normalize as N
from courtspark.operators import keyed as K
from courtspark.operators import resolve as R
from courtspark.operators import state as S
from courtspark.plans.relational import PM, _pm
from courtspark.plans.replay import _LATEST as LATEST
from courtspark.sources import files
from courtspark.sources.tables import matches_latest, table

QUERIES: dict = {}
ORACLE: dict = {}


def query(name, sql=None):
    def keep(run):
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return run

    return keep


# --- filters and joins ---------------------------------------------------------------------------------------------


@query("ref_f4_involved", f"select count(*) as n, count(distinct match_id) as matches from {LATEST} where winner_player_id in (select player_id from tour_anchors) or loser_player_id in (select player_id from tour_anchors)")
def _(s, d):
    asked = table(s, d, "tour_anchors").select("player_id").distinct()
    hits = _pm(s, d).join(asked, "player_id", "left_semi").select("match_id").distinct()
    return hits.agg(F.count(F.lit(1)).alias("n"), F.count("match_id").alias("matches"))


@query("ref_f9_no_doubles", "select event_id, name from (select event_id, case when books_count > 5 then player_a_name || '/' || player_b_name else player_a_name end as name from aggregated_odds) where not contains(coalesce(name, ''), '/')")
def _(s, d):
    o = table(s, d, "aggregated_odds").select("event_id", F.when(F.col("books_count") > 5, F.concat("player_a_name", F.lit("/"), "player_b_name")).otherwise(F.col("player_a_name")).alias("name"))
    return o.where(~F.coalesce(F.col("name").contains("/"), F.lit(False)))


@query("ref_f12_result_type", f"select match_id from (select match_id, case when match_status <> 'unknown' then match_status end as result_type from {LATEST}) where result_type is null or result_type = 'completed'")
def _(s, d):
    m = matches_latest(s, d, ["match_status"]).withColumn("result_type", F.when(F.col("match_status") != "unknown", F.col("match_status")))
    return m.where(F.col("result_type").isNull() | (F.col("result_type") == "completed")).select("match_id")


@query("ref_f13_recent_or_undated", "select doc_id from documents where kind <> 'note' and (published_at is null or cast(published_at as date) >= date '2024-06-30' - 32)")
def _(s, d):
    docs = table(s, d, "documents").where("kind <> 'note'")
    old = F.to_date("published_at") < F.date_sub(F.lit("2024-06-30").cast("date"), 32)
    return docs.where(~F.coalesce(old, F.lit(False))).select("doc_id")


@query("ref_f14_a13_recently_active", f"select distinct player_id from {PM} where player_id is not null and tourney_date between date '2024-06-30' - 21 and date '2024-06-30'")
def _(s, d):
    return _pm(s, d).where("player_id is not null and datediff(date'2024-06-30', tourney_date) between 0 and 21").select("player_id").distinct()


@query("ref_f16_stale_or_missing", "select p.player_id, coalesce(date '2024-06-30' - max(r.ranking_date) > 30, true) as stale from (select distinct player_id from players where player_id is not null) p left join rankings r on r.player_id = p.player_id and r.ranking_date <= date '2024-06-30' group by 1")
def _(s, d):
    last = table(s, d, "rankings").where("ranking_date <= date'2024-06-30'").groupBy("player_id").agg(F.max("ranking_date").alias("last"))
    p = table(s, d, "players").where("player_id is not null").select("player_id").distinct().join(last, "player_id", "left")
    return p.select("player_id", F.coalesce(F.date_diff(F.lit("2024-06-30").cast("date"), "last") > 30, F.lit(True)).alias("stale"))


@query("ref_j16_left_merge", "select o.event_id, o.name, count(p.player_id) as n_players from (select event_id, lower(trim(player_a_name)) as name, tour from aggregated_odds) o left join (select distinct tour, lower(trim(full_name)) as name, player_id from players) p on p.tour = o.tour and p.name = o.name group by 1, 2, o.tour")
def _(s, d):
    o = table(s, d, "aggregated_odds").select("event_id", F.lower(F.trim("player_a_name")).alias("name"), "tour")
    p = table(s, d, "players").select("tour", F.lower(F.trim("full_name")).alias("name"), "player_id").distinct()
    return o.join(p, ["tour", "name"], "left").groupBy("event_id", "name", "tour").agg(F.count("player_id").alias("n_players")).drop("tour")


@query("ref_a19_run_totals", f"select tour, cast(sum(case when winner_player_id is null then 0 when k then 1 else 0 end) as bigint) as added, cast(sum(case when winner_player_id is null then 1 else 0 end) as bigint) as skipped, cast(sum(case when winner_player_id is not null and not k then 1 else 0 end) as bigint) as failed from (select m.*, winner_player_id in (select player_id from players where player_id is not null) as k from {LATEST} m) group by 1")
def _(s, d):
    known = table(s, d, "players").where("player_id is not null").select(F.col("player_id").alias("winner_player_id"), F.lit(True).alias("known")).distinct()
    m = matches_latest(s, d, ["tour", "winner_player_id"]).join(known, "winner_player_id", "left")
    none, there = F.col("winner_player_id").isNull(), F.col("known").isNotNull()
    n = lambda c: F.sum(c.cast("long"))
    return m.groupBy("tour").agg(n(~none & there).alias("added"), n(none).alias("skipped"), n(~none & ~there).alias("failed"))


@query("ref_t3_latest_fifty", "select event_id, ts from events order by ts desc, event_id desc limit 50")
def _(s, d):
    return table(s, d, "events").select("event_id", "ts").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(50)


# --- scalar functions --------------------------------------------------------------------------------------------------

_TIER = "case tourney_level when 'G' then 'Grand Slam' when 'M' then 'Masters series' when 'A' then 'Main tour' when 'PM' then 'WTA 1000' when 'P' then 'WTA 500' when 'I' then 'Main tour' when 'F' then 'Finals' end"
_EVENT = "case when match_num % 11 = 0 then 'The US Open 2024' when match_num % 13 = 0 then 'Wimbledon' else tourney_name end"
_LEVEL = f"case {_TIER} when 'Grand Slam' then 'Slam' when 'Masters series' then 'M1000' when 'WTA 1000' then 'M1000' when 'WTA 500' then 'WTA500' when 'Finals' then 'Finals' else case when contains(lower({_EVENT}), 'us open') or contains(lower({_EVENT}), 'wimbledon') then 'Slam' when {_TIER} = 'Main tour' and tour = 'ATP' then 'ATP500' when {_TIER} = 'Main tour' and tour = 'WTA' then 'WTA500' end end"


@query("ref_x5_x6_tier_level", f"select match_id, level, case when level is null then null when tour = 'ATP' and level = 'Slam' then 5 else 3 end as best_of_default from (select match_id, tour, {_LEVEL} as level from {LATEST})")
def _(s, d):
    m = matches_latest(s, d, ["tour", "tourney_level", "tourney_name", "match_num"])
    tier = N.lookup(F.col("tourney_level"), {"G": "Grand Slam", "M": "Masters series", "A": "Main tour", "PM": "WTA 1000", "P": "WTA 500", "I": "Main tour", "F": "Finals"})
    event = F.when(F.col("match_num") % 11 == 0, "The US Open 2024").when(F.col("match_num") % 13 == 0, "Wimbledon").otherwise(F.col("tourney_name"))
    return m.select("match_id", "tour", N.tier_level(tier, event, F.col("tour")).alias("level")).select("match_id", "level", N.best_of_default(F.col("tour"), F.col("level")).alias("best_of_default"))


@query(
    "ref_x17_shown_zones",
    """select event_id, strftime(commence_time_utc + interval 9 hours, '%Y-%m-%d %H:%M') || ' JST' as tokyo, strftime(commence_time_utc + case when commence_time_utc >= a and commence_time_utc < b then interval 2 hours else interval 1 hour end, '%Y-%m-%d %H:%M') || case when commence_time_utc >= a and commence_time_utc < b then ' CEST' else ' CET' end as berlin
from (select *, case year(commence_time_utc) when 2022 then timestamp '2022-03-27 01:00:00' when 2023 then timestamp '2023-03-26 01:00:00' when 2024 then timestamp '2024-03-31 01:00:00' when 2025 then timestamp '2025-03-30 01:00:00' end as a, case year(commence_time_utc) when 2022 then timestamp '2022-10-30 01:00:00' when 2023 then timestamp '2023-10-29 01:00:00' when 2024 then timestamp '2024-10-27 01:00:00' when 2025 then timestamp '2025-10-26 01:00:00' end as b from aggregated_odds where commence_time_utc is not null)""",
)
def _(s, d):
    o = table(s, d, "aggregated_odds").where("commence_time_utc is not null")
    return o.select("event_id", N.shown_time(F.col("commence_time_utc"), "Asia/Tokyo").alias("tokyo"), N.shown_time(F.col("commence_time_utc"), "Europe/Berlin").alias("berlin"))


@query("ref_x20_on_court", "select event_id, coalesce(case when strftime(s, '%H:%M:%S') <> '12:00:00' then s end, case when strftime(f, '%H:%M:%S') <> '12:00:00' then f end, s, f) as starts from (select event_id, commence_time_utc as s, fetched_at as f from aggregated_odds)")
def _(s, d):
    return table(s, d, "aggregated_odds").select("event_id", N.on_court(F.col("fetched_at"), F.col("commence_time_utc")).alias("starts"))


@query("ref_x26_rated_costs", "select event_id, round((user_id * 100 * r_in + value * 10 * r_out) / 1000000 + 0.01::double * (event_id % 3), 9) as cost from (select *, case event_type when 'click' then 3.0 when 'view' then 1.0 when 'purchase' then 15.0 else 3.0 end::double as r_in, case event_type when 'click' then 15.0 when 'view' then 5.0 when 'purchase' then 75.0 else 15.0 end::double as r_out from events)")
def _(s, d):
    e = table(s, d, "events")
    rates = s.createDataFrame([("click", 3.0, 15.0), ("view", 1.0, 5.0), ("purchase", 15.0, 75.0)], "event_type string, r_in double, r_out double")
    usual = {"r_in": 3.0, "r_out": 15.0}  # of kinds without rates
    cost = (F.col("user_id") * 100 * F.col("r_in") + F.col("value") * 10 * F.col("r_out")) / 1000000 + F.lit(0.01) * (F.col("event_id") % 3)
    return e.join(F.broadcast(rates), "event_type", "left").fillna(usual).select("event_id", F.round(cost, 9).alias("cost"))  # the rate table has one row a kind


@query("ref_x31_two_court_maps", f"select match_id, case surface when 'I.hard' then 'Hard' else surface end as loaded, case when surface in ('I.hard', 'i.hard', 'I.Hard') then 'IHard' else surface end as live from {LATEST}")
def _(s, d):
    m = matches_latest(s, d, ["surface"])
    return m.select("match_id", N.court(F.col("surface"), N.LOADED_COURTS).alias("loaded"), N.court(F.col("surface"), N.LIVE_COURTS).alias("live"))


@query("ref_x33_oriented_odds", "select event_id, least(player_a_name, player_b_name) as first_name, case when player_a_name <= player_b_name then median_odds_a else median_odds_b end as first_odds, case when player_a_name <= player_b_name then median_odds_b else median_odds_a end as second_odds from aggregated_odds where player_a_name is not null and player_b_name is not null")
def _(s, d):
    o = table(s, d, "aggregated_odds").where("player_a_name is not null and player_b_name is not null")
    side = lambda x, y: F.struct(F.col(f"player_{x}_name").alias("n"), F.col(f"median_odds_{x}").alias("f"), F.col(f"median_odds_{y}").alias("g"))
    x = F.when(F.col("player_a_name") <= F.col("player_b_name"), side("a", "b")).otherwise(side("b", "a"))
    return o.select("event_id", x["n"].alias("first_name"), x["f"].alias("first_odds"), x["g"].alias("second_odds"))


# --- kept state --------------------------------------------------------------------------------------------------------


@query("ref_d4_additive_counters", "select user_id, count(*) as calls, cast(sum(case when event_type = 'purchase' then 2 else 1 end) as bigint) as credits from events group by 1")
def _(s, d):
    e = table(s, d, "events").select("user_id", "event_id", F.lit(1).cast("long").alias("calls"), F.when(F.col("event_type") == "purchase", 2).otherwise(1).cast("long").alias("credits"))
    state = None
    for k in range(3):  # three runs, each adds its calls to what the last one stored
        delta = e.where(F.col("event_id") % 3 == k)
        state = files.publish(S.add_to_counters(state if state is not None else delta.limit(0), delta, ["user_id"], ["calls", "credits"]), files.scratch(s), "counters").read()
    return state


@query("ref_d5_cache_write_read", "select k as pair, max(event_id) as event_id from (select least(user_id, (user_id * 7) % 11) || '-' || greatest(user_id, (user_id * 7) % 11) as k, * from events where event_type <> 'view' qualify row_number() over (partition by k order by ts desc, event_id desc) = 1) where ts >= timestamp '2024-01-29 12:00:00' - interval 24 hours group by 1")
def _(s, d):
    e = table(s, d, "events").where("event_type <> 'view'").withColumn("other", F.col("user_id") * 7 % 11)
    e = e.select(F.concat_ws("-", F.least("user_id", "other").cast("string"), F.greatest("user_id", "other").cast("string")).alias("pair"), "event_id", "ts")
    cache = files.KeyedTable(s, files.scratch(s), "cache", ["pair"], ["ts", "event_id"])
    for k in (0, 1):
        cache.upsert(e.where(F.col("event_id") % 2 == k))
    return S.fresh(cache.read(), ["pair"], "ts", F.to_timestamp_ntz(F.lit("2024-01-29 12:00:00"))).select("pair", "event_id")


@query("ref_d6_runs", "select user_id as run, min(ts) filter (where event_type = 'view') as opened, max(ts) filter (where event_type in ('click', 'purchase')) as closed, case when count(*) filter (where event_type in ('click', 'purchase')) = 0 then 'running' when count(*) filter (where event_type in ('click', 'purchase') and value > 60) = count(*) filter (where event_type in ('click', 'purchase')) then 'failed' when count(*) filter (where event_type in ('click', 'purchase') and value > 60) > 0 then 'partial' else 'success' end as status from events where event_type in ('view', 'click', 'purchase') group by 1")
def _(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("run"), "ts", "event_type", (F.col("value") > 60).alias("bad"))
    return S.run_log(e.where("event_type = 'view'"), e.where("event_type in ('click', 'purchase')"), "run", "ts", "bad")


_IDS = "with recursive m as (select stale, min(canonical) as canonical from (select greatest(upper(trim(canonical_player_id)), upper(trim(stale_player_id))) as stale, least(upper(trim(canonical_player_id)), upper(trim(stale_player_id))) as canonical from duplicate_review where lower(trim(verdict)) in ('y', 'yes', 'approved')) where stale <> canonical group by 1), r as (select stale, canonical from m union select r.stale, m.canonical from r join m on m.stale = r.canonical), t as (select stale, min(canonical) as canonical from r group by 1)"
_MATCH_SIDES = f"select coalesce(a.canonical, m.winner_player_id) as w, coalesce(b.canonical, m.loser_player_id) as l from {LATEST} m left join t a on a.stale = m.winner_player_id left join t b on b.stale = m.loser_player_id"


@query(
    "ref_d7_repoint_cascade",
    f"""{_IDS} select 'matches' as part, w as player_id, count(*) as n, cast(null as bigint) as total from ({_MATCH_SIDES}) where w is not null group by 2
union all select 'rankings', player_id, count(*), cast(sum(rank) as bigint) from (select coalesce(t.canonical, r.player_id) as player_id, r.ranking_date, r.rank from rankings r left join t on t.stale = r.player_id where r.player_id is not null
 qualify row_number() over (partition by coalesce(t.canonical, r.player_id), r.ranking_date order by (t.canonical is not null)::int, r.ingested_at desc nulls last, r.rank nulls last, r.points nulls last) = 1) group by 2
union all select 'aliases', coalesce(t.canonical, p.player_id), count(distinct lower(trim(full_name))), cast(null as bigint) from players p left join t on t.stale = p.player_id where p.player_id is not null and full_name is not null group by 2
union all select 'roster', player_id, count(*), cast(null as bigint) from players where player_id is not null and player_id not in (select stale from t) group by 2""",
)
def _(s, d):
    ids = [F.upper(F.trim(c)) for c in ("canonical_player_id", "stale_player_id")]
    approved = table(s, d, "duplicate_review").where(F.lower(F.trim("verdict")).isin("y", "yes", "approved"))
    closed = R.close_chains(approved.select(F.greatest(*ids).alias("stale"), F.least(*ids).alias("canonical")))
    p = table(s, d, "players").where("player_id is not null")
    aliases = p.where("full_name is not null").select("player_id", F.lower(F.trim("full_name")).alias("alias"))
    r = table(s, d, "rankings").where("player_id is not null").select("player_id", "ranking_date", "rank", "points", "ingested_at")
    out = S.repoint_all(
        {"matches": (matches_latest(s, d, ["winner_player_id", "loser_player_id"]), ["winner_player_id", "loser_player_id"]), "rankings": (r, ["player_id"]), "aliases": (aliases, ["player_id"]), "roster": (p.select("player_id", "record_id"), ["player_id"])},
        closed,
        {"rankings": (["player_id", "ranking_date"], [F.col("ingested_at").desc_nulls_last(), F.col("rank").asc_nulls_last(), F.col("points").asc_nulls_last()]), "aliases": (["player_id", "alias"], [])},
        roster=("roster", "player_id"),
    )
    n, no = F.count(F.lit(1)).alias("n"), F.lit(None).cast("long").alias("total")
    part = lambda name, c, total=no: out[name].where(F.col(c).isNotNull()).groupBy(F.col(c).alias("player_id")).agg(n, total).select(F.lit(name).alias("part"), "player_id", "n", "total")
    return part("matches", "winner_player_id").unionByName(part("rankings", "player_id", F.sum("rank").alias("total"))).unionByName(part("aliases", "player_id")).unionByName(part("roster", "player_id"))


@query("ref_d8_slam_prune", f"select match_id from {LATEST} f where not (coalesce(tourney_level, '') = 'G' and exists (select 1 from {LATEST} m where m.match_status = 'completed' and m.tour = f.tour and m.tourney_id = f.tourney_id and least(m.winner_player_id, m.loser_player_id) = least(f.winner_player_id, f.loser_player_id) and greatest(m.winner_player_id, m.loser_player_id) = greatest(f.winner_player_id, f.loser_player_id)))")
def _(s, d):
    m = matches_latest(s, d, ["tour", "tourney_id", "tourney_level", "match_status", "winner_player_id", "loser_player_id"])
    m = m.select("match_id", "tour", "tourney_id", "tourney_level", "match_status", *K.pair_key(F.col("winner_player_id"), F.col("loser_player_id")))
    done = m.where("match_status = 'completed'").select("tour", "tourney_id", "pair_low", "pair_high").distinct()
    slam = F.coalesce(F.col("tourney_level") == "G", F.lit(False))
    return m.where(~slam).select("match_id").unionByName(m.where(slam).join(done, ["tour", "tourney_id", "pair_low", "pair_high"], "left_anti").select("match_id"))


@query("ref_d13_truncate", "select count(*) as removed, 0::bigint as remaining from nation")
def _(s, d):
    root = files.scratch(s)
    held = files.publish(table(s, d, "nation"), root, "nation")
    removed, left = files.truncate(held)
    return left.read().agg(F.lit(removed).cast("long").alias("removed"), F.count(F.lit(1)).alias("remaining"))


@query("ref_d14_append_with_ids", "select (select coalesce(max(event_id), 0) from events where event_type = 'view') + row_number() over (order by ts, event_id) as row_id, event_id from events where event_type <> 'view'")
def _(s, d):
    e = table(s, d, "events").select("event_id", "event_type", "ts")
    stored = e.where("event_type = 'view'").select(F.col("event_id").alias("row_id"))
    return S.append_with_ids(stored, e.where("event_type <> 'view'").select("event_id", "ts"), "row_id", [F.col("ts").asc(), F.col("event_id").asc()]).select("row_id", "event_id")


@query("ref_d15_review_formats", "select 'duplicate_review' as name, 'paired' as format union all select 'listings', 'paired' union all select 'verdicts', 'per_player' union all select 'players', 'unknown'")
def _(s, d):
    review = table(s, d, "duplicate_review")
    frames = {"duplicate_review": review, "listings": table(s, d, "aggregated_odds").select(F.col("player_a_name").alias("winner_raw"), F.col("player_b_name").alias("loser_raw"), "tour"), "verdicts": review.select(F.col("full_name").alias("raw_name"), "tour", "verdict"), "players": table(s, d, "players")}
    return s.createDataFrame([(n, files.review_format(f.columns)) for n, f in frames.items()], "name string, format string")


@query("ref_d17_odds_of_results", "with o as (select event_id, case when a > 1 then a end as a, case when b > 1 then b end as b, books_count % 3 as side from (select *, try_cast(case when books_count = 4 then 'n/a' else cast(median_odds_a as varchar) end as double) as a, median_odds_b as b from aggregated_odds)), n as (select event_id, case side when 1 then a else b end as winner_odds, case side when 1 then b else a end as loser_odds from o where side in (1, 2) and a is not null and b is not null) select event_id, winner_odds, loser_odds, round((1 / winner_odds) / (1 / winner_odds + 1 / loser_odds), 9) as winner_prob from n where event_id not in (select event_id from aggregated_odds where pinnacle_odds_a is not null) qualify row_number() over (partition by event_id order by winner_odds, loser_odds) = 1")
def _(s, d):
    o = table(s, d, "aggregated_odds")
    texts = o.select("event_id", (F.col("books_count") % 3).alias("side"), F.when(F.col("books_count") == 4, "n/a").otherwise(F.col("median_odds_a").cast("string")).alias("a"), F.col("median_odds_b").cast("string").alias("b"))
    out = S.oriented_odds(texts, "event_id", "side", "a", "b", N.odds, o.where("pinnacle_odds_a is not null"))
    return out.withColumn("winner_prob", F.round("winner_prob", 9))


@query("ref_d18_quota", "select strftime(ts, '%Y-%m') as month, count(*) as used, greatest(600 - count(*), 0) as left, count(*) < 580 as allowed from events where event_type <> 'view' group by 1")
def _(s, d):
    calls = table(s, d, "events").where("event_type <> 'view'").select(F.date_format("ts", "yyyy-MM").alias("month"))
    return S.quota(calls, "month", 600).withColumn("left", F.col("left").cast("long"))


@query("ref_d19_fetch_plan", "with c as (select user_id, max(ts) as ts from events where event_type = 'purchase' group by 1), a as (select distinct user_id from events), x as (select a.user_id, coalesce(c.ts >= timestamp '2024-01-29' - interval 24 hours, false) as hit from a left join c using (user_id)) select user_id, case when hit then 'cache' when row_number() over (partition by hit order by user_id) <= 25 then 'call' else 'refused' end as how from x")
def _(s, d):
    e = table(s, d, "events")
    return S.fetch_plan(e.select("user_id"), e.where("event_type = 'purchase'").select("user_id", "ts"), "user_id", "ts", F.to_timestamp_ntz(F.lit("2024-01-29 00:00:00")), 25)


# --- sources and sinks -----------------------------------------------------------------------------------------------


@query("ref_s1_roster_csv", "select 'X_' || record_id as player_id, coalesce(trim(concat_ws(' ', name_first, name_last)), '') as full_name, dob, height from players where record_id is not null")
def _(s, d):
    p = table(s, d, "players").where("record_id is not null").select("record_id", "name_first", "name_last", "hand", F.date_format("dob", "yyyyMMdd"), "ioc", F.col("height").cast("string"), "wikidata_id")
    return files.roster_csv(s, files.write_csv(p), "X").select("player_id", "full_name", "dob", "height")


_CSV = {"winner_id": "split_part(winner_player_id, '_', 2)", "loser_id": "split_part(loser_player_id, '_', 2)"}


@query("ref_s2_s3_match_csv", f"select 'src::ATP-' || tourney_id || '-' || lpad(match_num::varchar, 3, '0') as match_id, match_num, tourney_date, case when score is null or score = '' then 'unknown' when contains(score, 'RET') then 'RET' when contains(score, 'W/O') then 'W/O' when contains(score, 'DEF') then 'DEF' else 'completed' end as match_status, 'ATP_' || split_part(winner_player_id, '_', 2) as winner_player_id, w_ace, l_bp_faced from {LATEST} where tour = 'ATP' and match_num is not null and tourney_id is not null and winner_player_id is not null")
def _(s, d):
    m = matches_latest(s, d, ["tour", "tourney_id", "tourney_name", "surface", "tourney_level", "tourney_date", "match_num", "score", "winner_player_id", "loser_player_id", "w_ace", "l_bp_faced"]).where("tour = 'ATP' and match_num is not null and tourney_id is not null and winner_player_id is not null")
    given = {"tourney_date": F.date_format("tourney_date", "yyyyMMdd"), "match_num": F.concat(F.col("match_num").cast("string")), "winner_id": F.split("winner_player_id", "_")[1], "loser_id": F.split("loser_player_id", "_")[1], "w_ace": F.concat(F.col("w_ace").cast("string"), F.lit(".0")), "l_bpFaced": F.col("l_bp_faced").cast("string")}
    have = {"tourney_id", "tourney_name", "surface", "tourney_level", "score"}
    raw = m.select(*[given[c].alias(c) if c in given else F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in files.MATCH_COLUMNS])
    back = files.match_csv(s, [files.write_csv(raw)], "ATP", "main", "src")
    return back.select("match_id", "match_num", "tourney_date", "match_status", "winner_player_id", "w_ace", "l_bp_faced")


@query("ref_s4_ranking_csv", "select ranking_date, 'T_' || split_part(player_id, '_', 2) as player_id, rank, points from rankings where player_id is not null and ranking_date is not null")
def _(s, d):
    r = table(s, d, "rankings").where("player_id is not null and ranking_date is not null").select(F.date_format("ranking_date", "yyyyMMdd").alias("ranking_date"), F.col("rank").cast("string").alias("rank"), F.split("player_id", "_")[1].alias("player"), F.concat(F.col("points").cast("string"), F.lit(".0")).alias("points"))
    half = F.col("ranking_date") < "20240101"  # two files, as by decade
    return files.ranking_csv(s, [files.write_csv(r.where(half)), files.write_csv(r.where(~half))], "T")


@query("ref_s7_feeds", f"select match_id as id, winner_player_id as player1_id, loser_player_id as player2_id, round as round_name, tourney_name as tournament, surface as court from {LATEST}")
def _(s, d):
    m = matches_latest(s, d, ["winner_player_id", "loser_player_id", "round", "tourney_name", "surface"])
    side = lambda c: F.struct(F.col(c).alias("id"), F.lit("x").alias("unknown_field"))
    one = F.struct(F.col("match_id").alias("id"), side("winner_player_id").alias("player1"), side("loser_player_id").alias("player2"), F.struct(F.col("round").alias("name")).alias("round"), F.struct(F.col("tourney_name").alias("name"), F.struct(F.col("surface").alias("name")).alias("court")).alias("tournament"))
    pages = m.select(F.xxhash64("match_id").alias("h"), one.alias("one")).groupBy(F.abs(F.col("h") % 50).alias("page")).agg(F.to_json(F.struct(F.collect_list("one").alias("data"), F.lit(True).alias("hasNextPage"))).alias("body"))
    return files.feed_rows(pages, "body", "fixtures").select("id", F.col("player1.id").alias("player1_id"), F.col("player2.id").alias("player2_id"), F.col("round.name").alias("round_name"), F.col("tournament.name").alias("tournament"), F.col("tournament.court.name").alias("court"))


@query("ref_s8_book_odds", "select l_orderkey::varchar as id, round(median(p), 7) as median_odds_a, round(median(q), 7) as median_odds_b, max(p) as best_odds_a, count(*) as books_count, round(median((1 / p) / (1 / p + 1 / q)), 7) as median_implied_prob_a, max(p) filter (where book = 'pinnacle') as pinnacle_odds_a from (select l_orderkey, case when l_linenumber = 1 then 'pinnacle' else 'b' || l_linenumber end as book, l_linenumber % 4 + l_quantity / 50 as p, 1 + l_discount * 10 as q from lineitem) where p > 1 and q > 1 group by 1")
def _(s, d):
    line = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") % 4 + F.col("l_quantity") / 50).alias("p"), (1 + F.col("l_discount") * 10).alias("q"))
    price = lambda n, c: F.struct(F.lit(n).alias("name"), F.col(c).alias("price"))
    book = F.struct(F.when(F.col("l_linenumber") == 1, "pinnacle").otherwise(F.concat(F.lit("b"), F.col("l_linenumber").cast("string"))).alias("key"), F.array(F.struct(F.lit("h2h").alias("key"), F.array(price("A", "p"), price("B", "q")).alias("outcomes"))).alias("markets"))
    body = line.groupBy("l_orderkey").agg(F.to_json(F.struct(F.max(F.col("l_orderkey").cast("string")).alias("id"), F.lit("tennis_atp_x").alias("sport_key"), F.lit("A").alias("home_team"), F.lit("B").alias("away_team"), F.collect_list(book).alias("bookmakers"))).alias("body"))
    o = files.book_odds(files.json_text(body, "body", files.ODDS_EVENT).select("parsed.*"))
    return o.select("id", F.round("median_odds_a", 7).alias("median_odds_a"), F.round("median_odds_b", 7).alias("median_odds_b"), "best_odds_a", "books_count", F.round("median_implied_prob_a", 7).alias("median_implied_prob_a"), "pinnacle_odds_a")


@query("ref_s9_pages", "select s_suppkey as id, s_name as name from supplier")
def _(s, d):
    """Pages of a feed, fetched until it says there are no more; what was fetched lands as text and is read from there."""
    feed = table(s, d, "supplier").select("s_suppkey", "s_name").orderBy("s_suppkey").toLocalIterator()  # the feed at the other end
    ahead = list(islice(feed, 1))

    def fetch(page: int) -> dict:
        mine, ahead[:] = [*ahead, *islice(feed, 39)], islice(feed, 1)
        return {"data": [{"id": str(r["s_suppkey"]), "name": r["s_name"]} for r in mine], "hasNextPage": bool(ahead)}

    landed = files.land_pages(s, fetch, files.scratch(s))
    return files.feed_rows(landed, "body", "rankings").select(F.col("id").cast("long").alias("id"), "name")


@query("ref_s10_s11_frames", "select n_regionkey, count(*) as n from nation group by 1")
def _(s, d):
    frame = table(s, d, "nation").toPandas()  # a small dimension out to pandas and back
    s.createDataFrame(frame).createOrReplaceTempView("courtspark_nations")
    return s.sql("select n_regionkey, count(*) as n from courtspark_nations group by n_regionkey")


@query("ref_s12_chunks", "select cast(floor((row_number() over (order by o_orderkey) - 1) / 5000) as bigint) as chunk, o_orderkey from orders")
def _(s, d):
    numbered = files.numbered_rows(table(s, d, "orders").select("o_orderkey"), [F.col("o_orderkey").asc()])
    return numbered.select(F.floor((F.col("position") - 1) / 5000).alias("chunk"), "o_orderkey")


@query("ref_s15_append_csv", "select tour, full_name, verdict from duplicate_review")
def _(s, d):
    r, at = table(s, d, "duplicate_review").select("tour", "full_name", "verdict"), files.scratch(s)
    for tour in ("ATP", "WTA"):
        files.write_csv(r.where(F.col("tour") == tour), at, "append")
    files.write_csv(r.where("tour is null or tour not in ('ATP', 'WTA')"), at, "append")
    return files.csv_written(s, at, ["tour", "full_name", "verdict"])
