"""DuckDB SQL of those llm queries that SQL can express."""

from __future__ import annotations

LATEST = "(select * from matches where match_id is not null qualify row_number() over (partition by match_id order by ingested_at desc nulls last) = 1)"
BOTH = f"(select distinct match_id, tourney_date, unnest([winner_player_id, loser_player_id]) as player_id from {LATEST})"
TRIMMED = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
USABLE = f"""(select p.*, s.trust,
case when upper({TRIMMED.format('hand')}) in ('R', 'L', 'A') then upper({TRIMMED.format('hand')}) end as ok_hand,
case when year(loaded_at) - year(dob) between 12 and 60 then strftime(dob, '%Y-%m-%d') end as ok_dob,
case when upper({TRIMMED.format('p.ioc')}) in (select ioc from ioc_codes) then upper({TRIMMED.format('p.ioc')}) end as ok_ioc,
case when height between 140 and 230 then cast(height as varchar) end as ok_height
from players p left join (select roster_source, max(trust) as trust from roster_sources group by 1) s using (roster_source) where player_id is not null)"""
BEST = "order by trust desc nulls last, loaded_at desc nulls last, record_id asc nulls last"


def _field(name: str) -> str:
    return f"(select player_id, '{name}' as field_name, ok_{name} as field_value from {USABLE} where ok_{name} is not null and player_id in (select player_id from players group by 1 having count(distinct record_id) > 1) qualify row_number() over (partition by player_id {BEST}) = 1)"


def _id(column: str) -> str:
    raw = f"upper({TRIMMED.format(column)})"
    return rf"case when regexp_extract({raw}, '(\d+)$', 1) <> '' then coalesce(nullif(regexp_extract({raw}, '^([A-Z]+)', 1), ''), upper(tour)) || '_' || cast(cast(regexp_extract({raw}, '(\d+)$', 1) as bigint) as varchar) end"


ORACLE = {
    "p1_found": f"""select match_id, player_id, strftime(ranking_date, '%Y-%m-%d') as ranking_date from (
select m.match_id, m.player_id, r.ranking_date, row_number() over (partition by m.match_id, m.player_id order by abs(r.ranking_date - m.tourney_date), r.ranking_date) as k
from {BOTH} m join (select distinct player_id, ranking_date from rankings where rank is not null) r on r.player_id = m.player_id and abs(r.ranking_date - m.tourney_date) <= 10) where k = 1""",
    "p6_found": " union all ".join(_field(n) for n in ("hand", "dob", "ioc", "height")),
    "p6_records": f"""select player_id, record_id, n_usable from (select *, cast((ok_hand is not null)::int + (ok_dob is not null)::int + (ok_ioc is not null)::int + (ok_height is not null)::int as int) as n_usable from {USABLE})
qualify row_number() over (partition by player_id order by n_usable desc, trust desc nulls last, loaded_at desc nulls last, record_id asc nulls last) = 1""",
    "p7_found": f"""with recursive e as (select distinct {_id('canonical_player_id')} as a, {_id('stale_player_id')} as b from duplicate_review where lower({TRIMMED.format('verdict')}) in ('y', 'yes', 'approved')),
w as (select a, b from e where a <> b union select b, a from e where a <> b), reach as (select a as n, b as m from w union select reach.n, w.b from reach join w on reach.m = w.a)
select n as player_id, least(n, min(m)) as group_player_id from reach group by n""",
}
