"""Scalar functions over the test tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtspark.functions import normalize as N
from courtspark.plans.replay import _LATEST as LATEST
from courtspark.plans.replay import _case
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


def _m(s, d, *cols):
    return matches_latest(s, d, list(cols))


_UNMARKED = "regexp_replace(strip_accents(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(name, 'Đ', 'D'), 'đ', 'd'), 'Ł', 'L'), 'ł', 'l'), 'Ø', 'O'), 'ø', 'o'), 'Æ', 'AE'), 'æ', 'ae'), 'Þ', 'Th'), 'þ', 'th'), 'ß', 'ss')), '[.,''\"-]', ' ', 'g')"


@query("ref_x1_name_key", f"select record_id, coalesce(trim(regexp_replace(lower({_UNMARKED.replace('name', 'full_name')}), '\\s+', ' ', 'g')), '') as name_key from players")
def _(s, d):
    return table(s, d, "players").select("record_id", N.name_key(F.col("full_name")).alias("name_key"))


@query("ref_x2_side_name", "select event_id, trim(regexp_replace(replace(lower(trim(player_a_name)), '-', ' '), '\\s+', ' ', 'g')) as side_name from aggregated_odds")
def _(s, d):
    return table(s, d, "aggregated_odds").select("event_id", N.side_name(F.col("player_a_name")).alias("side_name"))


@query(
    "ref_x7_x15_status",
    f"select match_id, case when score is null or score = '' then 'unknown' when contains(score, 'RET') then 'RET' when contains(score, 'W/O') then 'W/O' when contains(score, 'DEF') then 'DEF' else 'completed' end as status, case when contains(lower(coalesce(score, '')), 'ret') then 'RET' when contains(lower(coalesce(score, '')), 'walkover') or contains(' ' || lower(coalesce(score, '')), ' w/o') then 'WO' when contains(lower(coalesce(score, '')), 'def') then 'DEF' else 'W' end as completion from {LATEST}",
)
def _(s, d):
    return _m(s, d, "score").select("match_id", N.status(F.col("score")).alias("status"), N.completion(F.col("score")).alias("completion"))


_SETS = "(select cast(sum(sign(cast(split_part(y, '-', 1) as integer) - cast(split_part(y, '-', 2) as integer))) as integer) from (select regexp_replace(x, '\\(.*$', '') as y from unnest(string_split_regex(coalesce(score, ''), '\\s+')) t(x)) where regexp_full_match(y, '\\d+-\\d+'))"


@query("ref_x14_winner_side", f"select match_id, case when {_SETS} > 0 then 1 when {_SETS} < 0 then 2 end as winner_side from {LATEST}")
def _(s, d):
    return _m(s, d, "score").select("match_id", N.winner_side(F.col("score")).alias("winner_side"))


@query("ref_x10_overround", "select event_id, round((1 / median_odds_a) / (1 / median_odds_a + 1 / median_odds_b), 9) as prob_a, round((1 / median_odds_b) / (1 / median_odds_a + 1 / median_odds_b), 9) as prob_b from aggregated_odds where median_odds_a > 1 and median_odds_b > 1")
def _(s, d):
    a, b = N.implied(F.col("median_odds_a"), F.col("median_odds_b"))
    return table(s, d, "aggregated_odds").where("median_odds_a > 1 and median_odds_b > 1").select("event_id", F.round(a, 9).alias("prob_a"), F.round(b, 9).alias("prob_b"))


@query(
    "ref_x11_priority_odds",
    "select event_id, case when pinnacle_odds_a > 1 and pinnacle_odds_b > 1 then 'sharp' when median_odds_a > 1 and median_odds_b > 1 then 'median' when best_odds_a > 1 and best_odds_b > 1 then 'best' end as odds_source, case when pinnacle_odds_a > 1 and pinnacle_odds_b > 1 then pinnacle_odds_a when median_odds_a > 1 and median_odds_b > 1 then median_odds_a when best_odds_a > 1 and best_odds_b > 1 then best_odds_a end as odds_a from aggregated_odds",
)
def _(s, d):
    pick = N.first_valid_pair([(F.col(f"{x}_odds_a"), F.col(f"{x}_odds_b"), n) for x, n in (("pinnacle", "sharp"), ("median", "median"), ("best", "best"))])
    return table(s, d, "aggregated_odds").withColumn("p", pick).select("event_id", F.col("p.source").alias("odds_source"), F.col("p.a").alias("odds_a"))


@query(
    "ref_x13_odds_pair",
    """with t as (select event_id, list_transform(regexp_extract_all(coalesce('a ' || cast(round(median_odds_a, 2) as decimal(9, 2)) || ' on v1 or ' || cast(round(best_odds_a, 2) as decimal(9, 2)) || ' and ' || cast(round(median_odds_b, 2) as decimal(9, 2)) || ' now', ''), '\\b([1-9]\\d?\\.\\d{2})\\b', 1), lambda x: cast(x as double)) as p from aggregated_odds),
c as (select event_id, i, j, least(p[i], p[j]) as lo, greatest(p[i], p[j]) as hi, 1 / p[i] + 1 / p[j] as s from t, generate_series(1, 3) a(i), generate_series(1, 3) b(j) where i < j and j <= len(p)),
f as (select distinct on (event_id) event_id, lo, hi from c where s between 0.95 and 1.25 and lo >= 1.01 and hi <= 99.0 order by event_id, i, j)
select distinct t.event_id, f.lo as low, f.hi as high from t left join f using (event_id)""",
)
def _(s, d):
    two = lambda c: F.round(c, 2).cast("decimal(9,2)").cast("string")
    text = F.concat(F.lit("a "), two("median_odds_a"), F.lit(" on v1 or "), two("best_odds_a"), F.lit(" and "), two("median_odds_b"), F.lit(" now"))
    return table(s, d, "aggregated_odds").withColumn("p", N.odds_pair(text)).select("event_id", F.col("p.low").alias("low"), F.col("p.high").alias("high")).distinct()


@query("ref_x16_time_zones", "select event_id, commence_time_utc - interval 3 hours as utc, strftime(commence_time_utc - interval 3 hours, '%Y-%m-%d %H:%M') || ' UTC' as shown from aggregated_odds")
def _(s, d):
    utc = N.naive_utc(F.col("commence_time_utc"), "Europe/Moscow")
    return table(s, d, "aggregated_odds").select("event_id", utc.alias("utc"), F.concat(F.date_format(utc, "yyyy-MM-dd HH:mm"), F.lit(" UTC")).alias("shown"))


@query("ref_x19_x30_logistic_gap", "select event_id, round(1 / (1 + pow(10, -(value - 50) / 400)), 9) as expected, round((1 / (1 + pow(10, -(value - 50) / 400)) - 0.5) * 100, 7) as gap_pp from events")
def _(s, d):
    e = N.expected_score(F.col("value") - 50)
    return table(s, d, "events").select("event_id", F.round(e, 9).alias("expected"), F.round((e - 0.5) * 100, 7).alias("gap_pp"))


@query("ref_x21_x25_lenient_casts", "select match_id, try_cast(substr(trim(tourney_id), 1, 4) as integer) as y, try_strptime(trim(substr(tourney_id, 1, 10)), '%Y-%m-%d')::date as day, cast(round(try_cast(substr(score, 1, 1) || '.4' as double)) as integer) as first_games, try_strptime(strftime(tourney_date, '%Y%m%d'), '%Y%m%d')::date as day8 from " + LATEST)
def _(s, d):
    m = _m(s, d, "tourney_id", "score", "tourney_date")
    return m.select("match_id", F.substring(F.trim("tourney_id"), 1, 4).try_cast("int").alias("y"), N.lenient_day(F.col("tourney_id")).alias("day"), N.number(F.concat(F.substring("score", 1, 1), F.lit(".4"))).alias("first_games"), N.day8(F.date_format("tourney_date", "yyyyMMdd")).alias("day8"))


@query("ref_x22_x23_keys", "select event_id, case when starts_with(sport_key, 'tennis_atp') then 'ATP' when starts_with(sport_key, 'tennis_wta') then 'WTA' end as tour_of_key, strftime(commence_time_utc, '%Y-%m') as month from aggregated_odds")
def _(s, d):
    return table(s, d, "aggregated_odds").select("event_id", N.tour_of(F.col("sport_key")).alias("tour_of_key"), F.date_format("commence_time_utc", "yyyy-MM").alias("month"))


@query("ref_x24_shown_name", "select record_id, coalesce(nullif(trim(full_name), ''), nullif(trim(name_last), ''), player_id) as shown from players")
def _(s, d):
    return table(s, d, "players").select("record_id", F.coalesce(N.shown(F.col("full_name"), F.col("name_last")), F.col("player_id")).alias("shown"))


@query("ref_x27_x32_json", "select event_id, json_extract_string(props, '$.page') as page, coalesce(json_extract_string(props, '$.countryAcr'), json_extract_string(props, '$.coutryAcr')) as country, json_valid(props) as valid from events")
def _(s, d):
    e = table(s, d, "events")
    get = lambda p: F.get_json_object("props", p)
    return e.select("event_id", get("$.page").alias("page"), F.coalesce(get("$.countryAcr"), get("$.coutryAcr")).alias("country"), get("$").isNotNull().alias("valid"))


@query("ref_x28_ilike", "select record_id from players where full_name ilike '%stad%'")
def _(s, d):
    return table(s, d, "players").where(F.col("full_name").ilike("%stad%")).select("record_id")


@query("ref_x29_urls", "select distinct source, lang, lower(source) || '.org/a/' || lang as url_key from documents where lang is not null and source is not null")
def _(s, d):
    u = table(s, d, "documents").where("lang is not null and source is not null").select("source", "lang").distinct()
    url = F.concat(F.lit("https://WWW."), F.col("source"), F.lit(".org/a/"), F.col("lang"), F.lit("//"))
    return u.select("source", "lang", N.url_key(url).alias("url_key"))
