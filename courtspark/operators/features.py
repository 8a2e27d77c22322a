"""Replay features: every family computed on its own as ordered state, then brought together per contest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtspark.functions import normalize as N
from courtspark.operators.asof import latest_before
from courtspark.operators.elo import elo_replay
from courtspark.operators.windows import calendar, last_n, less_earlier, running
from courtspark.session import cut, stored

SERVE = ["first_in", "first_won", "second_won", "svpt", "bp_saved", "bp_faced"]
ORDER = ["tourney_id", "match_num", "match_id"]
UNRANKED = 9999
FLOOR, FORM, FORM_SURFACE, FORM_LEAST, SERVE_WINDOW, SERVE_LEAST, CAP = 5, 10, 25, 3, 25, 5, 365


def by_order() -> list[Column]:
    """Total order of contests within a day."""
    return [F.col(c).asc_nulls_first() for c in ORDER]


def contests(matches: DataFrame) -> DataFrame:
    """Contests that count as state: completed, on a known surface, with both players, their order and a date."""
    rows = matches.withColumn("raw_surface", F.col("surface")).withColumn("surface", N.surface(F.col("surface"), F.col("tourney_name")))
    rows = rows.where("match_status = 'completed' and surface is not null and winner_player_id is not null and loser_player_id is not null and tourney_date is not null")
    level = N.level(F.col("tour"), F.col("tourney_level"), F.col("tourney_name"))
    open_ = (F.col("match_tier") == "main") | N.is_tour_qualifying(F.col("tour"), F.col("match_tier"), F.col("tourney_level"))
    rows = rows.withColumn("level", level).withColumn("sets", N.sets_played(F.col("score")))
    return rows.withColumn("label_open", F.coalesce(open_, F.lit(False)) & F.col("level").isNotNull() & F.coalesce(F.col("best_of").isin(3, 5), F.lit(False)))


def player_rows(rows: DataFrame) -> DataFrame:
    """Two rows per contest, one for each player, with own and opponent's counters, from one scan."""
    rich = sum((F.col(f"{s}_{c}").isNotNull().cast("int") for s in "wl" for c in SERVE), F.lit(0)) == 2 * len(SERVE)

    def side(own: str, other: str, me: str, you: str) -> Column:
        stats = [F.col(f"{own}_{c}").cast("long").alias(c) for c in SERVE] + [F.col(f"{other}_{c}").cast("long").alias(f"opp_{c}") for c in ("bp_saved", "bp_faced")]
        return F.struct(F.col(me).alias("player_id"), F.col(you).alias("opponent_id"), F.lit(int(own == "w")).alias("won"), *stats)

    both = F.array(side("w", "l", "winner_player_id", "loser_player_id"), side("l", "w", "loser_player_id", "winner_player_id"))
    keep = ["match_id", "tour", "surface", "tourney_date", "tourney_id", "match_num", "sets"]
    return rows.select(*keep, rich.alias("rich"), F.explode(both).alias("p")).select(*keep, "rich", "p.*")


def form(players: DataFrame) -> DataFrame:
    """prior_matches, win_pct_last10 and win_pct_last25_surface before each contest; a rate needs FORM_LEAST contests."""
    rate = lambda wins, n: F.when(F.col(n) >= FORM_LEAST, F.col(wins) / F.col(n))
    base = players.select("match_id", "player_id", "surface", "tourney_date", *ORDER[:2], "won")
    any_ = last_n(base, ["player_id"], "tourney_date", by_order(), FORM, {"wins10": F.col("won")}, count="n10")
    here = last_n(base, ["player_id", "surface"], "tourney_date", by_order(), FORM_SURFACE, {"wins25": F.col("won")}, count="n25")
    prior = running(base, ["player_id"], "tourney_date", by_order(), {"prior_matches": ("sum", F.lit(1))})
    joined = any_.select("match_id", "player_id", rate("wins10", "n10").alias("win_pct_last10"))
    joined = joined.join(here.select("match_id", "player_id", rate("wins25", "n25").alias("win_pct_last25_surface")), ["match_id", "player_id"])
    return joined.join(prior.select("match_id", "player_id", F.col("prior_matches").cast("long").alias("prior_matches")), ["match_id", "player_id"])


def serve_return(players: DataFrame) -> DataFrame:
    """Sum-then-divide ratios over the last SERVE_WINDOW contests on the surface that have all counters."""
    cols = [*SERVE, "opp_bp_saved", "opp_bp_faced"]
    base = players.select("match_id", "player_id", "surface", "tourney_date", *ORDER[:2], "rich", *[F.col(c).alias(f"c_{c}") for c in cols])
    sums = last_n(base, ["player_id", "surface"], "tourney_date", by_order(), SERVE_WINDOW, {c: F.col(f"c_{c}") for c in cols}, member=F.col("rich"), count="n_rich")
    share = lambda a, b: F.when((F.col("n_rich") >= SERVE_LEAST) & (b > 0), F.try_divide(a, b))
    return sums.select(
        "match_id", "player_id", share(F.col("first_won"), F.col("first_in")).alias("first_serve_win_pct"), share(F.col("second_won"), F.col("svpt") - F.col("first_in")).alias("second_serve_win_pct"),
        share(F.col("bp_saved"), F.col("bp_faced")).alias("bp_saved_pct"), share(F.col("opp_bp_faced") - F.col("opp_bp_saved"), F.col("opp_bp_faced")).alias("bp_converted_pct"),
    )


def _fold(rows: DataFrame) -> tuple[list[str], Column, list[Column]]:
    """(mark, whether a row changes state, order within a day): rows with `ask` = 1 change none and come before their day's contests."""
    return (["ask"], F.col("ask") == 0, [F.col("ask").desc(), *by_order()]) if "ask" in rows.columns else ([], F.lit(True), by_order())


def _answers(rows: DataFrame) -> DataFrame:
    """The asked rows where some are marked, else all."""
    return rows.where("ask = 1") if "ask" in rows.columns else rows


def player_state(players: DataFrame) -> DataFrame:
    """form, serve_return and rest in two passes of running state, one by player and one by player and surface."""
    mark, counts, order = _fold(players)
    cols = [*SERVE, "opp_bp_saved", "opp_bp_faced"]
    base = players.select("match_id", "player_id", "surface", "tourney_date", *ORDER[:2], *mark, "won", counts.cast("int").alias("one"), F.col("rich").cast("int").alias("rich"), *[F.when(F.col("rich"), F.col(c)).otherwise(0).alias(f"c_{c}") for c in cols])
    since = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(0), F.least(F.lit(CAP), F.date_diff("tourney_date", F.col(c)))))
    count = {"k": ("sum", F.col("one")), "w": ("sum", F.col("won")), "last_day": ("max", F.when(F.col("one") == 1, F.col("tourney_date")))}
    a = cut(running(base.select("match_id", "player_id", "tourney_date", *ORDER[:2], *mark, "won", "one"), ["player_id"], "tourney_date", order, count))
    a = less_earlier(a, ["player_id"], "k", "one", FORM, {"w10": ("w", "won")})
    a = _answers(a).select("match_id", "player_id", F.when(F.col("k") >= FORM_LEAST, F.col("w10") / F.least(F.col("k"), F.lit(FORM))).alias("win_pct_last10"), F.col("k").cast("long").alias("prior_matches"), since("last_day").alias("days_since_last_match"))
    b = cut(running(base, ["player_id", "surface"], "tourney_date", order, {**count, "r": ("sum", F.col("rich")), **{f"s_{c}": ("sum", F.col(f"c_{c}")) for c in cols}}))
    b = less_earlier(b, ["player_id", "surface"], "k", "one", FORM_SURFACE, {"w25": ("w", "won")})
    b = less_earlier(b, ["player_id", "surface"], "r", "rich", SERVE_WINDOW, {c: (f"s_{c}", f"c_{c}") for c in cols})
    share = lambda x, y: F.when((F.col("r") >= SERVE_LEAST) & (y > 0), F.try_divide(x, y))
    b = _answers(b).select(
        "match_id", "player_id", F.when(F.col("k") >= FORM_LEAST, F.col("w25") / F.least(F.col("k"), F.lit(FORM_SURFACE))).alias("win_pct_last25_surface"), since("last_day").alias("days_since_last_match_surface"),
        share(F.col("first_won"), F.col("first_in")).alias("first_serve_win_pct"), share(F.col("second_won"), F.col("svpt") - F.col("first_in")).alias("second_serve_win_pct"),
        share(F.col("bp_saved"), F.col("bp_faced")).alias("bp_saved_pct"), share(F.col("opp_bp_faced") - F.col("opp_bp_saved"), F.col("opp_bp_faced")).alias("bp_converted_pct"),
    )
    return a.join(b, ["match_id", "player_id"])


#: Contests of one player up to which all its windows are taken in one group; beyond, states are laid out by time shards.
MOST = 200_000


def _largest(players: DataFrame) -> int:
    return players.groupBy("player_id").count().agg(F.max("count")).first()[0] or 0


def player_facts(players: DataFrame, rankings: DataFrame, most: int = MOST) -> DataFrame:
    """All families of one player that depend on order: form, serve and return, rest, load and rank as of the day, by (match_id, player_id).

    The largest player's contests are counted first. Up to `most` of them every window is taken within the player, all
    from one shuffle by player in which the rankings lie as rows of their own. Beyond, no group is in one task: running
    totals per time shard, joined by position.
    """
    if _largest(players) > most:
        return player_state(players).join(load(players), ["match_id", "player_id"]).join(ranks(_answers(players), rankings), ["match_id", "player_id"])
    mark, counts, order = _fold(players)
    cols = [*SERVE, "opp_bp_saved", "opp_bp_faced"]
    base = players.select("match_id", "player_id", "surface", "tourney_date", *ORDER[:2], *mark, "won", "sets", counts.cast("int").alias("one"), F.col("rich").cast("int").alias("rich"), *[F.when(F.col("rich"), F.col(c)).otherwise(0).alias(f"c_{c}") for c in cols], F.lit(1).alias("side"))
    listed = rankings.where("rank is not null and player_id is not null and ranking_date is not null").select("player_id", F.col("ranking_date").alias("tourney_date"), F.struct(F.col("ranking_date").alias("day"), (-F.col("rank")).alias("rank")).alias("listed"), F.lit(0).alias("side"))
    own, here = ["player_id"], ["player_id", "surface"]
    upto = Window.partitionBy(*own).orderBy("tourney_date", "side").rowsBetween(Window.unboundedPreceding, 0)
    rows = base.unionByName(listed, allowMissingColumns=True).withColumn("at", F.max("listed").over(upto)).where("side = 1").drop("listed", "side")
    rows = rows.withColumn("day", F.unix_date("tourney_date"))
    before = lambda keys: Window.partitionBy(*keys).orderBy("tourney_date", *order).rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c, keys: F.coalesce(F.sum(c).over(before(keys)), F.lit(0)).cast("long")
    met = F.when(F.col("one") == 1, F.col("tourney_date"))
    rows = rows.withColumns({"k": total("one", own), "last_day": F.max(met).over(before(own)), "ks": total("one", here), "r": total("rich", here), "last_here": F.max(met).over(before(here))})
    # by position: rows that change no state share the position of the contest after them and are no part of any window
    last = lambda keys, position, n: Window.partitionBy(*keys).orderBy(position).rangeBetween(-n, -1)
    rest_of_day = Window.partitionBy(*own, "day").orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    days = lambda c, n: F.coalesce(F.sum(c).over(Window.partitionBy(*own).orderBy("day").rangeBetween(-n, 0)) - F.sum(c).over(rest_of_day), F.lit(0)).cast("long")
    rows = rows.withColumns({"w10": F.sum("won").over(last(own, "k", FORM)), "w25": F.sum("won").over(last(here, "ks", FORM_SURFACE)), "fatigue_matches_7d": days("one", 7), "fatigue_sets_14d": days("sets", 14), **{c: F.sum(f"c_{c}").over(last(here, "r", SERVE_WINDOW)) for c in cols}})
    since = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(0), F.least(F.lit(CAP), F.date_diff("tourney_date", F.col(c)))))
    share = lambda x, y: F.when((F.col("r") >= SERVE_LEAST) & (y > 0), F.try_divide(x, y))
    rate = lambda wins, n, most_: F.when(F.col(n) >= FORM_LEAST, F.col(wins) / F.least(F.col(n), F.lit(most_)))
    return _answers(rows).select(
        "match_id", "player_id", rate("w10", "k", FORM).alias("win_pct_last10"), F.col("k").alias("prior_matches"), since("last_day").alias("days_since_last_match"), rate("w25", "ks", FORM_SURFACE).alias("win_pct_last25_surface"), since("last_here").alias("days_since_last_match_surface"),
        share(F.col("first_won"), F.col("first_in")).alias("first_serve_win_pct"), share(F.col("second_won"), F.col("svpt") - F.col("first_in")).alias("second_serve_win_pct"), share(F.col("bp_saved"), F.col("bp_faced")).alias("bp_saved_pct"), share(F.col("opp_bp_faced") - F.col("opp_bp_saved"), F.col("opp_bp_faced")).alias("bp_converted_pct"),
        "fatigue_matches_7d", "fatigue_sets_14d", F.coalesce(-F.col("at.rank"), F.lit(UNRANKED)).alias("rank"),
    )


def load(players: DataFrame) -> DataFrame:
    """Contests in the last 7 days and sets in the last 14, rows of the same day before this one included."""
    mark, counts, order = _fold(players)
    base = players.select("match_id", "player_id", "tourney_date", *ORDER[:2], *mark, "sets")
    out = calendar(base, ["player_id"], "tourney_date", order, {"fatigue_matches_7d": (7, counts.cast("int")), "fatigue_sets_14d": (14, F.col("sets"))})
    return _answers(out).select("match_id", "player_id", F.col("fatigue_matches_7d").cast("long").alias("fatigue_matches_7d"), F.col("fatigue_sets_14d").cast("long").alias("fatigue_sets_14d"))


def rest(players: DataFrame) -> DataFrame:
    """Days since the last contest, and since the last on this surface; 0 to CAP, null where there is none."""
    base = players.select("match_id", "player_id", "surface", "tourney_date", *ORDER[:2])
    since = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(0), F.least(F.lit(CAP), F.date_diff("tourney_date", F.col(c)))))
    a = running(base, ["player_id"], "tourney_date", by_order(), {"last_day": ("max", F.col("tourney_date"))})
    b = running(base, ["player_id", "surface"], "tourney_date", by_order(), {"last_day": ("max", F.col("tourney_date"))})
    return a.select("match_id", "player_id", since("last_day").alias("days_since_last_match")).join(b.select("match_id", "player_id", since("last_day").alias("days_since_last_match_surface")), ["match_id", "player_id"])


def head_to_head(rows: DataFrame, most: int = 0) -> DataFrame:
    """Per contest, before it: wins of the smaller id p1, of p2, and days since they last met. Pairs with at most `most` meetings each (counted) need one shuffle, else states are laid out by time shards."""
    mark, counts, order = _fold(rows)
    base = rows.select("match_id", "tourney_date", *ORDER[:2], *mark, counts.alias("counts"), F.least("winner_player_id", "loser_player_id").alias("p1"), F.greatest("winner_player_id", "loser_player_id").alias("p2"), (F.col("winner_player_id") <= F.col("loser_player_id")).cast("int").alias("p1_won"))
    values = {"h2h_p1_wins": ("sum", F.when(F.col("counts"), F.col("p1_won")).otherwise(0)), "h2h_p2_wins": ("sum", F.when(F.col("counts"), 1 - F.col("p1_won")).otherwise(0)), "met": ("max", F.when(F.col("counts"), F.col("tourney_date")))}
    if most and base.groupBy("p1", "p2").count().where(F.col("count") > most).isEmpty():
        before = Window.partitionBy("p1", "p2").orderBy("tourney_date", *order).rowsBetween(Window.unboundedPreceding, -1)
        out = base.withColumns({n: F.max(v).over(before) if kind == "max" else F.coalesce(F.sum(v).over(before), F.lit(0)) for n, (kind, v) in values.items()})
    else:
        out = running(base, ["p1", "p2"], "tourney_date", order, values)
    return _answers(out).select("match_id", "p1", "p2", F.col("h2h_p1_wins").cast("long").alias("h2h_p1_wins"), F.col("h2h_p2_wins").cast("long").alias("h2h_p2_wins"), F.date_diff("tourney_date", "met").alias("h2h_recency_days"))


def ranks(players: DataFrame, rankings: DataFrame) -> DataFrame:
    """The rank on the latest list on or before the day, UNRANKED without one."""
    listed = rankings.where("rank is not null").groupBy("player_id", "ranking_date").agg(F.min("rank").alias("rank"))
    out = latest_before(players.select("match_id", "player_id", "tourney_date"), listed, "player_id", "tourney_date", "ranking_date", ["rank"])
    return out.select("match_id", "player_id", F.coalesce("asof.rank", F.lit(UNRANKED)).alias("rank"))


def traits(players: DataFrame, roster: DataFrame) -> DataFrame:
    """Hand, age, age against the tour's peak and height; one roster row per player."""
    facts = roster.select("player_id", F.col("hand").alias("raw_hand"), "dob", "height")
    out = players.select("match_id", "player_id", "tour", "tourney_date").join(facts, "player_id", "left")
    years = N.age(F.col("dob"), F.col("tourney_date"))
    return out.select("match_id", "player_id", N.hand(F.col("raw_hand")).alias("hand"), years.alias("age"), N.age_vs_peak(years, F.col("tour")).alias("age_vs_peak"), F.col("height"))


def elo(rows: DataFrame) -> DataFrame:
    """Ratings of both players before each contest, one ladder per tour and surface."""
    return elo_replay(rows, ["tour", "surface"], ["tourney_date", *ORDER], "winner_player_id", "loser_player_id", "match_id")


def _both_sides(sides: DataFrame) -> DataFrame:
    """One row per match: every fact of the smaller id as <fact>_p1, of the greater as <fact>_p2, in one shuffle by match."""
    facts = [c for c in sides.columns if c not in ("match_id", "player_id")]
    both = sides.groupBy("match_id").agg(F.sort_array(F.collect_list(F.struct("player_id", *facts))).alias("s"))
    return both.where("size(s) = 2").select("match_id", *[F.col("s")[i][c].alias(f"{c}_p{i + 1}") for i in (0, 1) for c in facts])


def _traits_of(players: DataFrame, roster: DataFrame) -> DataFrame:
    return traits(_answers(players), roster)


def feature_vectors(matches: DataFrame, rankings: DataFrame, roster: DataFrame, with_elo: bool = True, most: int = MOST) -> DataFrame:
    """One row per contest that passes the label gate: 41 features (38 without ratings), ids and the label p1_won.

    Contests that fail the gate still feed every state. p1 is the smaller id. Contests are written once; from there
    on it is one shuffle by player, one by pair, one by ladder and one by contest.
    """
    rows = stored(contests(matches))
    players = player_rows(rows)
    sides = player_facts(players, rankings, most).join(_traits_of(players, roster), ["match_id", "player_id"])
    pairs = rows.where("label_open").select("match_id", "tour", "tourney_date", "level", "best_of", "surface", "winner_player_id", F.least("winner_player_id", "loser_player_id").alias("p1"))
    out = pairs.join(_both_sides(sides), "match_id").join(head_to_head(rows, most).drop("p1"), "match_id").where((F.col("prior_matches_p1") >= FLOOR) & (F.col("prior_matches_p2") >= FLOOR))
    out = out.withColumn("rank_diff", F.col("rank_p1") - F.col("rank_p2")).withColumn("height_diff_cm", F.col("height_p1") - F.col("height_p2")).withColumn("label", (F.col("winner_player_id") == F.col("p1")).cast("int"))
    if with_elo:
        won = F.col("winner_player_id") == F.col("p1")
        before = elo(rows).select("match_id", "winner_before", "loser_before")
        out = out.join(before, "match_id").withColumn("elo_p1_surface", F.when(won, F.col("winner_before")).otherwise(F.col("loser_before"))).withColumn("elo_p2_surface", F.when(won, F.col("loser_before")).otherwise(F.col("winner_before")))
        out = out.withColumn("elo_diff_surface", F.col("elo_p1_surface") - F.col("elo_p2_surface")).drop("winner_before", "loser_before")
    return out.drop("winner_player_id", "prior_matches_p1", "prior_matches_p2")


def features_as_of(matches: DataFrame, rankings: DataFrame, roster: DataFrame, asked: DataFrame, most: int = MOST) -> DataFrame:
    """Vectors of contests yet to be played: asked has match_id, tour, surface, tourney_date, level, best_of, p1, p2 (p1 < p2).

    The same 41 features as feature_vectors, and the ratings as elo_p1 and elo_p2 too. Only contests strictly before the
    asked day count, whoever played them, so ratings come from the full history. Asked rows are laid before their day's
    contests as rows that change no state: each is folded with the contests before it.
    """
    rows = stored(contests(matches))
    asked_ids = asked.select("match_id", "p1", "p2", "tour", "surface", "tourney_date", "level", "best_of")
    both = asked_ids.select("*", F.explode(F.array("p1", "p2")).alias("player_id"))
    history = player_rows(rows).withColumn("ask", F.lit(0))
    neutral = {"won": F.lit(0), "sets": F.lit(0), "rich": F.lit(False), "ask": F.lit(1)}
    given = ("match_id", "player_id", "tour", "surface", "tourney_date")
    laid = stored(history.unionByName(both.select(*given, *[v.alias(c) for c, v in neutral.items()]), allowMissingColumns=True))
    sides = player_facts(laid, rankings, most).drop("prior_matches")
    for family in (traits(both, roster), ratings_as_of(rows, both)):
        sides = sides.join(family, ["match_id", "player_id"])
    meetings = rows.select("match_id", "tourney_date", *ORDER[:2], "winner_player_id", "loser_player_id").withColumn("ask", F.lit(0))
    meetings = meetings.unionByName(asked_ids.select("match_id", "tourney_date", F.col("p1").alias("winner_player_id"), F.col("p2").alias("loser_player_id"), F.lit(1).alias("ask")), allowMissingColumns=True)
    out = asked_ids.join(_both_sides(sides), "match_id").join(head_to_head(meetings, most).drop("p1", "p2"), "match_id")
    out = out.withColumns({f"{c}_diff{u}": F.col(f"{c}_p1") - F.col(f"{c}_p2") for c, u in (("rank", ""), ("height", "_cm"), ("elo", "_surface"))})
    return out.withColumns({"elo_p1_surface": F.col("elo_p1"), "elo_p2_surface": F.col("elo_p2")})


def ratings_as_of(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """(match_id, player_id, elo): the rating after the last contest strictly before the asked day on that tour and surface; 1500 without one."""
    after = elo(rows).join(rows.select("match_id", "tourney_date", "tourney_id", "match_num"), "match_id")
    both = F.array(F.struct(F.col("winner_player_id").alias("player_id"), F.col("winner_after").alias("rating")), F.struct(F.col("loser_player_id").alias("player_id"), F.col("loser_after").alias("rating")))
    marks = after.select("tour", "surface", "tourney_date", "tourney_id", "match_num", "match_id", F.explode(both).alias("e"))
    key = lambda p: F.concat_ws("|", "tour", "surface", p)
    marks = marks.select(key(F.col("e.player_id")).alias("ladder"), F.date_add("tourney_date", 1).alias("from_day"), F.coalesce("tourney_id", F.lit("")).alias("o1"), F.coalesce("match_num", F.lit(-1)).alias("o2"), F.col("match_id").alias("o3"), F.col("e.rating").alias("rating"))
    out = latest_before(asked.withColumn("ladder", key(F.col("player_id"))), marks, "ladder", "tourney_date", "from_day", ["rating"], ["o1", "o2", "o3"])
    return out.select("match_id", "player_id", F.coalesce("asof.rating", F.lit(1500.0)).alias("elo"))


def elo_snapshot(rows: DataFrame) -> DataFrame:
    """(tour, surface, player_id, rating, matches_played, last_updated) after the whole replay of the contests."""
    after = elo(rows).join(rows.select("match_id", "tourney_date", "tourney_id", "match_num"), "match_id")
    both = F.array(F.struct(F.col("winner_player_id").alias("player_id"), F.col("winner_after").alias("rating")), F.struct(F.col("loser_player_id").alias("player_id"), F.col("loser_after").alias("rating")))
    long = after.select("tour", "surface", F.struct("tourney_date", "tourney_id", "match_num", "match_id").alias("at"), F.explode(both).alias("e"))
    return long.groupBy("tour", "surface", F.col("e.player_id").alias("player_id")).agg(F.max_by("e.rating", "at").alias("rating"), F.count(F.lit(1)).alias("matches_played"), F.max("at.tourney_date").alias("last_updated"))
