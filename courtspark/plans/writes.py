"""State maintenance: appends, upserts, repointing, validation, sinks; results are the state after the write."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtspark.operators import keyed as K
from courtspark.operators import resolve as R
from courtspark.plans.replay import _LATEST as LATEST
from courtspark.sources import files
from courtspark.sources.tables import both_players, matches_latest, table

QUERIES: dict = {}
ORACLE: dict = {}


def query(name, sql=None):
    def keep(run):
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return run

    return keep


_OLD, _NEW = "(select event_id, user_id, event_type, value, ts from events where event_id % 3 <> 0)", "(select event_id, user_id, event_type, value, ts from events)"


def _events(s, d):
    e = table(s, d, "events").select("event_id", "user_id", "event_type", "value", "ts")
    by = [F.col("ts"), F.col("event_id")]
    stored = K.latest_by_key(e.where("event_id % 3 <> 0"), ["user_id", "event_type"], [c.asc() for c in by])
    return stored, e


_STORED = f"(select * from {_OLD} qualify row_number() over (partition by user_id, event_type order by ts, event_id) = 1)"


@query("ref_d1_first_write_wins", f"with s as {_STORED}, n as (select * from {_NEW} qualify row_number() over (partition by user_id, event_type order by ts, event_id) = 1) select * from s union all select n.* from n where not exists (select 1 from s where s.user_id = n.user_id and s.event_type = n.event_type)")
def _(s, d):
    stored, new = _events(s, d)
    return K.append_first_wins(stored, new, ["user_id", "event_type"], [F.col("ts").asc(), F.col("event_id").asc()])


@query("ref_d2_last_write_wins", f"with s as {_STORED}, n as (select * from {_NEW} where event_type <> 'view' qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1) select * from n union all select s.* from s where not exists (select 1 from n where s.user_id = n.user_id and s.event_type = n.event_type)")
def _(s, d):
    stored, new = _events(s, d)
    return K.upsert_last_wins(stored, new.where("event_type <> 'view'"), ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()])


@query("ref_d3_update_subset", f"with s as {_STORED}, n as (select * from {_NEW} qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1) select n.user_id, n.event_type, coalesce(s.event_id, n.event_id) as event_id, n.value from n left join s on s.user_id = n.user_id and s.event_type = n.event_type")
def _(s, d):
    stored, new = _events(s, d)
    out = K.upsert_last_wins(stored, new, ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()], update=["value"])
    return out.select("user_id", "event_type", "event_id", "value")


_MAP = "(select stale, min(canonical) as canonical from (select greatest(upper(trim(canonical_player_id)), upper(trim(stale_player_id))) as stale, least(upper(trim(canonical_player_id)), upper(trim(stale_player_id))) as canonical from duplicate_review where lower(trim(verdict)) in ('y', 'yes', 'approved')) where stale <> canonical group by 1)"


@query("ref_d9_accounting", f"with s as {_STORED} select case when s.user_id is null then 'added' else 'skipped' end as outcome, count(*) as n from {_NEW} e left join s on s.user_id = e.user_id and s.event_type = e.event_type group by 1")
def _(s, d):
    stored, new = _events(s, d)
    keys = stored.select("user_id", "event_type", F.lit(True).alias("there"))
    return new.join(keys, ["user_id", "event_type"], "left").groupBy(F.when(F.col("there"), "skipped").otherwise("added").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("ref_d10_d11_by_name", "select c_custkey as id, c_name as name, cast(null as double) as balance from customer union all select s_suppkey, s_name, s_acctbal from supplier")
def _(s, d):
    c = table(s, d, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("id"))
    return c.unionByName(table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")), allowMissingColumns=True).select("id", "name", "balance")


@query(
    "ref_d12_constraints",
    "select 'players.height' as rule, count(*) as violations from players where height is not null and not (height between 140 and 230) union all select 'rankings.rank', count(*) from rankings where rank is null or rank < 1 union all select 'odds.valid', count(*) from aggregated_odds where median_odds_a <= 1 or median_odds_b <= 1",
)
def _(s, d):
    rules = {
        "players.height": table(s, d, "players").where("height is not null and not (height between 140 and 230)"),
        "rankings.rank": table(s, d, "rankings").where("rank is null or rank < 1"),
        "odds.valid": table(s, d, "aggregated_odds").where("median_odds_a <= 1 or median_odds_b <= 1"),
    }
    return files.violations(rules)


@query("ref_d16_orientation", f"select match_id, case when winner_player_id is null then 'skipped' when winner_player_id not in (select player_id from players where player_id is not null) then 'failed' else 'added' end as outcome from {LATEST}")
def _(s, d):
    known = table(s, d, "players").where("player_id is not null").select(F.col("player_id").alias("winner_player_id"), F.lit(True).alias("known")).distinct()
    m = matches_latest(s, d, ["winner_player_id"]).join(known, "winner_player_id", "left")
    return m.select("match_id", F.when(F.col("winner_player_id").isNull(), "skipped").when(F.col("known").isNull(), "failed").otherwise("added").alias("outcome"))


@query("ref_s13_s14_snapshot", "select user_id, max(event_id) as event_id from events group by 1")
def _(s, d):
    snap = table(s, d, "events").groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    return files.publish(snap, files.scratch(s), "users").read()


@query("ref_u1_unpivot_counts", f"select player_id, count(*) as n from (select distinct match_id, unnest([winner_player_id, loser_player_id]) as player_id from {LATEST}) where player_id is not null group by 1")
def _(s, d):
    return both_players(matches_latest(s, d, ["winner_player_id", "loser_player_id"]), "match_id").groupBy("player_id").agg(F.count(F.lit(1)).alias("n"))
