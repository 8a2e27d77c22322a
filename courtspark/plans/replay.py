"""Replay features over the archive, each family with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtspark.functions import normalize as N
from courtspark.operators import features as X
from courtspark.operators.keyed import latest_by_key
from courtspark.sources.tables import matches_latest, table

COLUMNS = ["tour", "match_tier", "tourney_id", "tourney_name", "tourney_level", "tourney_date", "surface", "match_num", "best_of", "score", "match_status", "winner_player_id", "loser_player_id", *[f"{s}_{c}" for s in "wl" for c in X.SERVE]]


def _matches(spark: SparkSession, d: str) -> DataFrame:
    return matches_latest(spark, d, COLUMNS)


def _contests(spark: SparkSession, d: str) -> DataFrame:
    return X.contests(_matches(spark, d))


def _players(spark: SparkSession, d: str) -> DataFrame:
    return X.player_rows(_contests(spark, d))


def _roster(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "players").where("player_id is not null").select("player_id", "hand", "dob", "height", "record_id")
    return latest_by_key(rows, ["player_id"], [F.col(c).asc_nulls_last() for c in ("record_id", "hand", "dob", "height")])


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def unpivot(spark: SparkSession, d: str) -> DataFrame:
    return _players(spark, d).groupBy("player_id", "surface").agg(F.count(F.lit(1)).alias("played"), F.sum("won").alias("won"), F.sum(F.col("rich").cast("long")).alias("with_stats"))


def gates(spark: SparkSession, d: str) -> DataFrame:
    return _contests(spark, d).select("match_id", "surface", "level", "label_open", F.col("sets").cast("long").alias("sets"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(X.feature_vectors(_matches(spark, d), table(spark, d, "rankings"), _roster(spark, d)))


def windows_vector(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(X.feature_vectors(_matches(spark, d), table(spark, d, "rankings"), _roster(spark, d), with_elo=False))


def elo_before(spark: SparkSession, d: str) -> DataFrame:
    out = X.elo(_contests(spark, d))
    return out.select("match_id", "tour", "surface", F.round("winner_before", 6).alias("winner_before"), F.round("loser_before", 6).alias("loser_before"))


def elo_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Rating, contests and last day of each player and surface after the whole replay."""
    return _rounded(X.elo_snapshot(_contests(spark, d)).withColumn("rating", F.round("rating", 6)))


def as_of(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as of the day for every match of the main tier, from the full history strictly before it."""
    m = _matches(spark, d)
    asked = X.contests(m).where("label_open").select("match_id", "tour", "surface", "tourney_date", "level", "best_of", F.least("winner_player_id", "loser_player_id").alias("p1"), F.greatest("winner_player_id", "loser_player_id").alias("p2"))
    return _rounded(X.features_as_of(m, table(spark, d, "rankings"), _roster(spark, d), asked))


QUERIES = {
    "ref_u1_unpivot": unpivot,
    "ref_f1_f2_gates": gates,
    "ref_w4_w6_form": lambda s, d: _rounded(X.form(_players(s, d))),
    "ref_w7_serve_return": lambda s, d: _rounded(X.serve_return(_players(s, d))),
    "ref_w8_head_to_head": lambda s, d: X.head_to_head(_contests(s, d)),
    "ref_w9_fatigue": lambda s, d: X.load(_players(s, d)),
    "ref_w10_rest_days": lambda s, d: X.rest(_players(s, d)),
    "ref_j2_rank_as_of": lambda s, d: X.ranks(_players(s, d), table(s, d, "rankings")),
    "ref_j7_x18_traits": lambda s, d: _rounded(X.traits(_players(s, d), _roster(s, d))),
    "ref_w11_elo": elo_before,
    "ref_s14_elo_snapshot": elo_snapshot,
    "ref_w13_windows": windows_vector,
    "ref_w13_features": vectors,
    "ref_w14_features_as_of": as_of,
}

_LATEST = "(select * from matches where match_id is not null qualify row_number() over (partition by match_id order by ingested_at desc nulls last) = 1)"


def _in(values: list[str]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _case(column: str, values: dict) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then '{v}'" for k, v in values.items()) + " end"


_S, _E = "lower(trim(surface))", "lower(trim(tourney_name))"
_C = f"""select m.* exclude (surface), case when {_S} = 'clay' then 'Clay' when {_S} = 'grass' then 'Grass' when {_S} in ('carpet', 'i.hard') then 'IHard' when {_S} = 'hard' and {_E} in {_in(N.INDOOR_EVENTS)} then 'IHard' when {_S} = 'hard' then 'Hard' end as surface,
case when tour = 'WTA' and coalesce(contains(tourney_name, '125'), false) then null when trim(tourney_level) in ('G', 'F') then {_case('trim(tourney_level)', N.LEVELS['both'])}
 when tour = 'ATP' and trim(tourney_level) = 'A' and {_E} in {_in(N.SERIES_500)} then 'ATP500' when tour = 'ATP' then {_case('trim(tourney_level)', N.LEVELS['ATP'])} when tour = 'WTA' then {_case('trim(tourney_level)', N.LEVELS['WTA'])} end as level,
(select count(*) from unnest(string_split_regex(coalesce(score, ''), '\\s+')) t(x) where regexp_full_match(x, '\\d+-\\d+(\\(\\d+\\))?')) as sets,
coalesce(match_tier = 'main' or (tour = 'ATP' and match_tier = 'qual_chall' and tourney_level in ('G', 'M', 'A')) or (tour = 'WTA' and match_tier = 'qual_itf' and tourney_level in ('G', 'PM', 'P', 'I', 'T1', 'T2', 'W')), false) as open_tier
from {_LATEST} m"""
_ORD = "tourney_date, tourney_id nulls first, match_num nulls first, match_id"
_RICH = " and ".join(f"{s}_{c} is not null" for s in "wl" for c in X.SERVE)
C = f"c as (select *, (open_tier and level is not null and best_of in (3, 5)) is true as label_open from ({_C}) where match_status = 'completed' and surface is not null and winner_player_id is not null and loser_player_id is not null and tourney_date is not null)"


def _side(own: str, other: str, me: str, you: str) -> str:
    return f"select match_id, tour, surface, tourney_date, tourney_id, match_num, sets, ({_RICH}) as rich, {me} as player_id, {int(own == 'w')} as won, " + ", ".join(f"{own}_{c} as {c}" for c in X.SERVE) + f", {other}_bp_saved as opp_bp_saved, {other}_bp_faced as opp_bp_faced from c"


P = f"p as ({_side('w', 'l', 'winner_player_id', 'loser_player_id')} union all {_side('l', 'w', 'loser_player_id', 'winner_player_id')})"
W = f"with {C}, {P}"
_BEFORE = f"order by {_ORD} rows between"
FORM = f"""select match_id, player_id, case when count(*) over a >= 3 then round(avg(won) over a, 9) end as win_pct_last10, case when count(*) over b >= 3 then round(avg(won) over b, 9) end as win_pct_last25_surface,
count(*) over (partition by player_id {_BEFORE} unbounded preceding and 1 preceding) as prior_matches
from p window a as (partition by player_id {_BEFORE} 10 preceding and 1 preceding), b as (partition by player_id, surface {_BEFORE} 25 preceding and 1 preceding)"""


def _rich_sum(c: str) -> str:
    return f"list_sum(list_slice(list(case when rich then {c} end) filter (where rich) over w, -25, -1))"


SERVE = f"""select match_id, player_id, case when n >= 5 and fi > 0 then round(fw / fi, 9) end as first_serve_win_pct, case when n >= 5 and sv - fi > 0 then round(sw / (sv - fi), 9) end as second_serve_win_pct,
case when n >= 5 and bf > 0 then round(bs / bf, 9) end as bp_saved_pct, case when n >= 5 and obf > 0 then round((obf - obs) / obf, 9) end as bp_converted_pct from (
select match_id, player_id, least(25, count(*) filter (where rich) over w) as n, {_rich_sum('first_in')} as fi, {_rich_sum('first_won')} as fw, {_rich_sum('second_won')} as sw, {_rich_sum('svpt')} as sv, {_rich_sum('bp_saved')} as bs, {_rich_sum('bp_faced')} as bf, {_rich_sum('opp_bp_saved')} as obs, {_rich_sum('opp_bp_faced')} as obf
from p window w as (partition by player_id, surface {_BEFORE} unbounded preceding and 1 preceding))"""
H2H = f"""select match_id, p1, p2, cast(coalesce(sum(x) over w, 0) as bigint) as h2h_p1_wins, cast(coalesce(sum(1 - x) over w, 0) as bigint) as h2h_p2_wins, cast(tourney_date - max(tourney_date) over w as integer) as h2h_recency_days
from (select *, least(winner_player_id, loser_player_id) as p1, greatest(winner_player_id, loser_player_id) as p2, case when winner_player_id <= loser_player_id then 1 else 0 end as x from c)
window w as (partition by p1, p2 {_BEFORE} unbounded preceding and 1 preceding)"""
LOAD = f"""select match_id, player_id, (select count(*) from q r where r.player_id = q.player_id and r.k < q.k and q.tourney_date - r.tourney_date <= 7) as fatigue_matches_7d,
(select cast(coalesce(sum(sets), 0) as bigint) from q r where r.player_id = q.player_id and r.k < q.k and q.tourney_date - r.tourney_date <= 14) as fatigue_sets_14d from q"""
Q = f"q as (select *, row_number() over (partition by player_id order by {_ORD}) as k from p)"
REST = f"""select match_id, player_id, cast(greatest(0, least(365, tourney_date - a)) as integer) as days_since_last_match, cast(greatest(0, least(365, tourney_date - b)) as integer) as days_since_last_match_surface from (
select *, max(tourney_date) over (partition by player_id {_BEFORE} unbounded preceding and 1 preceding) as a, max(tourney_date) over (partition by player_id, surface {_BEFORE} unbounded preceding and 1 preceding) as b from p)""".replace("greatest(0, least(365, tourney_date - a))", "case when a is not null then greatest(0, least(365, tourney_date - a)) end").replace("greatest(0, least(365, tourney_date - b))", "case when b is not null then greatest(0, least(365, tourney_date - b)) end")
RANK = "select p.match_id, p.player_id, coalesce(r.rank, 9999) as rank from p asof left join (select player_id, ranking_date, min(rank) as rank from rankings where rank is not null group by 1, 2) r on r.player_id = p.player_id and r.ranking_date <= p.tourney_date"
ROSTER = "(select * from players where player_id is not null qualify row_number() over (partition by player_id order by record_id nulls last, hand nulls last, dob nulls last, height nulls last) = 1)"
TRAITS = f"""select match_id, p.player_id, case when upper(trim(r.hand)) in ('R', 'L', 'A', 'U') then upper(trim(r.hand)) else 'U' end as hand, round((p.tourney_date - r.dob) / 365.25, 9) as age,
round((p.tourney_date - r.dob) / 365.25 - case p.tour when 'ATP' then 26.0 when 'WTA' then 24.0 end, 9) as age_vs_peak, r.height from p left join {ROSTER} r on r.player_id = p.player_id"""
_FACTS = ["win_pct_last10", "win_pct_last25_surface", "first_serve_win_pct", "second_serve_win_pct", "bp_saved_pct", "bp_converted_pct", "fatigue_matches_7d", "fatigue_sets_14d", "days_since_last_match", "days_since_last_match_surface", "rank", "hand", "age", "age_vs_peak", "height"]
VECTOR = f"""{W}, {Q}, f as ({FORM}), s as ({SERVE}), l as ({LOAD}), r as ({REST}), k as ({RANK}), t as ({TRAITS}), h as ({H2H}),
a as (select * from f join s using (match_id, player_id) join l using (match_id, player_id) join r using (match_id, player_id) join k using (match_id, player_id) join t using (match_id, player_id))
select c.match_id, c.tour, c.tourney_date, c.level, c.best_of, c.surface, h.p1, h.p2, h.h2h_p1_wins, h.h2h_p2_wins, h.h2h_recency_days, {', '.join(f'{s}.{x} as {x}_{n}' for n, s in (('p1', 'x'), ('p2', 'y')) for x in _FACTS)},
x.rank - y.rank as rank_diff, x.height - y.height as height_diff_cm, cast(c.winner_player_id = h.p1 as integer) as label
from c join h using (match_id) join a x on x.match_id = c.match_id and x.player_id = h.p1 join a y on y.match_id = c.match_id and y.player_id = h.p2 where c.label_open and x.prior_matches >= 5 and y.prior_matches >= 5"""
ELO_STEPS = f"""with recursive {C}, o as (select match_id, tour, surface, winner_player_id as w, loser_player_id as l, row_number() over (partition by tour, surface order by {_ORD}) as k from c),
e as (select tour, surface, cast(0 as bigint) as k, cast(null as varchar) as match_id, cast(null as double) as wb, cast(null as double) as lb, map([''], [cast(1500 as double)]) as r from o group by 1, 2
union all select tour, surface, k, match_id, x, y, map_concat(r, map([w, l], [x + 32 * (1 - 1 / (1 + pow(10, (y - x) / 400))), y - 32 * (1 - 1 / (1 + pow(10, (y - x) / 400)))])) from
(select o.*, e.r, coalesce(e.r[o.w], 1500) as x, coalesce(e.r[o.l], 1500) as y from e join o on o.tour = e.tour and o.surface = e.surface and o.k = e.k + 1))"""

_AT = "p.tourney_date, p.tourney_id nulls first, p.match_num nulls first, p.match_id"
_DAY = ["win_pct_last10", "fatigue_matches_7d", "fatigue_sets_14d", "days_since_last_match"]
_DAY_HERE = ["win_pct_last25_surface", "first_serve_win_pct", "second_serve_win_pct", "bp_saved_pct", "bp_converted_pct", "days_since_last_match_surface"]
# what holds strictly before a day is what the day's first contest of that state sees
AS_OF = f"""{ELO_STEPS}, {P}, {Q}, f as ({FORM}), s as ({SERVE}), l as ({LOAD}), r as ({REST}), k as ({RANK}), t as ({TRAITS}), h as ({H2H}),
eb as (select e.match_id, o.w as player_id, e.wb as elo from e join o using (match_id) where e.k > 0 union all select e.match_id, o.l, e.lb from e join o using (match_id) where e.k > 0),
a as (select p.match_id, p.player_id, {', '.join(f'first_value({x}) over d as {x}' for x in _DAY)}, {', '.join(f'first_value({x}) over ds as {x}' for x in _DAY_HERE)}, k.rank, t.hand, t.age, t.age_vs_peak, t.height, round(first_value(eb.elo) over es, 9) as elo
 from p join f using (match_id, player_id) join s using (match_id, player_id) join l using (match_id, player_id) join r using (match_id, player_id) join k using (match_id, player_id) join t using (match_id, player_id) join eb using (match_id, player_id)
 window d as (partition by p.player_id, p.tourney_date order by {_AT}), ds as (partition by p.player_id, p.surface, p.tourney_date order by {_AT}), es as (partition by p.player_id, p.tour, p.surface, p.tourney_date order by {_AT})),
g as (select c.match_id, first_value(h2h_p1_wins) over x as h2h_p1_wins, first_value(h2h_p2_wins) over x as h2h_p2_wins, first_value(h2h_recency_days) over x as h2h_recency_days, p1, p2 from h join c using (match_id) window x as (partition by p1, p2, c.tourney_date order by {_AT.replace('p.', 'c.')}))
select c.match_id, c.tour, c.tourney_date, c.level, c.best_of, c.surface, g.p1, g.p2, g.h2h_p1_wins, g.h2h_p2_wins, g.h2h_recency_days, {', '.join(f'{s}.{x} as {x}_{n}' for n, s in (('p1', 'x'), ('p2', 'y')) for x in [*_FACTS, 'elo'])},
x.rank - y.rank as rank_diff, x.height - y.height as height_diff_cm, round(x.elo - y.elo, 9) as elo_diff_surface, x.elo as elo_p1_surface, y.elo as elo_p2_surface
from c join g using (match_id) join a x on x.match_id = c.match_id and x.player_id = g.p1 join a y on y.match_id = c.match_id and y.player_id = g.p2 where c.label_open"""

ORACLE = {
    "ref_u1_unpivot": f"{W} select player_id, surface, count(*) as played, cast(sum(won) as bigint) as won, cast(sum(cast(rich as integer)) as bigint) as with_stats from p group by 1, 2",
    "ref_f1_f2_gates": f"with {C} select match_id, surface, level, label_open, sets from c",
    "ref_w4_w6_form": f"{W} {FORM}",
    "ref_w7_serve_return": f"{W} {SERVE}",
    "ref_w8_head_to_head": f"with {C} {H2H}",
    "ref_w9_fatigue": f"{W}, {Q} {LOAD}",
    "ref_w10_rest_days": f"{W} {REST}",
    "ref_j2_rank_as_of": f"{W} {RANK}",
    "ref_j7_x18_traits": f"{W} {TRAITS}",
    "ref_w11_elo": f"{ELO_STEPS} select match_id, tour, surface, round(wb, 6) as winner_before, round(lb, 6) as loser_before from e where k > 0",
    "ref_s14_elo_snapshot": f"""{ELO_STEPS}, last as (select tour, surface, r from e qualify row_number() over (partition by tour, surface order by k desc) = 1),
u as (select tour, surface, unnest(map_keys(r)) as player_id, unnest(map_values(r)) as rating from last), n as (select tour, surface, x as player_id, count(*) as matches_played, max(tourney_date) as last_updated from (select tour, surface, tourney_date, unnest([winner_player_id, loser_player_id]) as x from c) group by 1, 2, 3)
select tour, surface, player_id, round(rating, 6) as rating, matches_played, last_updated from u join n using (tour, surface, player_id)""",
    "ref_w13_windows": VECTOR,
    "ref_w13_features": f"""{ELO_STEPS}, v as ({VECTOR.replace(f"with {C}, ", "with ", 1)}) select v.*, round(case when o.w = p1 then wb else lb end, 9) as elo_p1_surface, round(case when o.w = p1 then lb else wb end, 9) as elo_p2_surface, round(case when o.w = p1 then wb - lb else lb - wb end, 9) as elo_diff_surface from v join e using (match_id) join o using (match_id)""",
    "ref_w14_features_as_of": AS_OF,
}
