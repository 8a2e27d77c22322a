"""Leakage: what happens on or after a contest's place in the order must not change its vector."""

import datetime as dt
import random

import pytest

from courtspark.operators import features as X
from courtspark.operators import evaluate as E

COLUMNS = ["match_id", "tour", "match_tier", "tourney_id", "tourney_name", "tourney_level", "tourney_date", "surface", "match_num", "best_of", "score", "match_status", "winner_player_id", "loser_player_id", *[f"{s}_{c}" for s in "wl" for c in X.SERVE]]
SCHEMA = ", ".join(f"{c} " + {"tourney_date": "date"}.get(c, "int" if c in ("match_num", "best_of") or c[:2] in ("w_", "l_") else "string") for c in COLUMNS)
DAY = dt.date(2020, 1, 6)


def make(n=160, seed=1):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        a, b = rng.sample(["ATP_1", "ATP_2", "ATP_3", "ATP_4"], 2)
        stats = [rng.randrange(20, 60) if rng.random() > 0.1 else None for _ in range(12)]
        out.append([f"m{k:03d}", "ATP", "main", f"t{k // 8}", "Event", "A", DAY + dt.timedelta(days=7 * (k // 8)), rng.choice(["Hard", "Clay"]), k % 8, 3, "6-4 6-3", "completed", a, b, *stats])
    return out


@pytest.fixture(scope="module")
def world(spark):
    rankings = spark.createDataFrame([(f"ATP_{p}", DAY + dt.timedelta(days=14 * k), p * 10 + k) for p in range(1, 5) for k in range(5)], "player_id string, ranking_date date, rank int")
    roster = spark.createDataFrame([("ATP_1", "R", dt.date(1995, 1, 1), 185), ("ATP_2", None, None, 180), ("ATP_3", "x", dt.date(1999, 5, 5), None), ("ATP_4", "L", None, 190)], "player_id string, hand string, dob date, height int")

    def run(rows):
        return {r["match_id"]: r.asDict() for r in X.feature_vectors(spark.createDataFrame([tuple(r) for r in rows], SCHEMA), rankings, roster).collect()}

    return run, spark, rankings, roster


def test_sharded_layout_gives_the_same_vectors(world):
    """Players beyond the bound are laid out by time shards; nothing else changes."""
    _, spark, rankings, roster = world
    matches = spark.createDataFrame([tuple(r) for r in make(60)], SCHEMA)
    rows = [{r["match_id"]: r.asDict() for r in X.feature_vectors(matches, rankings, roster, with_elo=False, most=most).collect()} for most in (X.MOST, 0)]
    assert len(rows[0]) > 20 and rows[0] == rows[1]


def test_41_features_and_gates(world):
    run, *_ = world
    got = run(make())
    row = got["m150"]
    ids = {"match_id", "tour", "tourney_date", "p1", "p2", "label"}
    assert len(set(row) - ids) == 41 - 0
    assert all(r["p1"] < r["p2"] for r in got.values())
    assert "m000" not in got
    assert row["hand_p1"] in ("R", "U", "L") and row["level"] == "ATP250"


def test_future_changes_nothing(world):
    run, *_ = world
    rows = make()
    want = run(rows)
    changed = [list(r) for r in rows]
    for r in changed[121:]:
        r[12], r[13] = r[13], r[12]
        r[10] = "6-0 6-0 6-0"
    got = run(changed)
    for k in [m for m in want if m <= "m119"]:
        assert got[k] == want[k]
    assert run(rows[:121])["m120"] == want["m120"]
    assert got["m150"] != want["m150"]


def test_rating_as_of_equals_replay_with_active_opponents(world):
    """As-of ratings use the full history strictly before the day: they equal the replay's at a day's first contest."""
    _, spark, rankings, roster = world
    rows = make()
    m = spark.createDataFrame([tuple(r) for r in rows], SCHEMA)
    c = X.contests(m)
    asked = c.where("match_num = 0").selectExpr("match_id", "tour", "surface", "tourney_date", "level", "best_of", "least(winner_player_id, loser_player_id) as p1", "greatest(winner_player_id, loser_player_id) as p2")
    got = {r["match_id"]: r for r in X.features_as_of(m, rankings, roster, asked).collect()}
    replay = {r["match_id"]: r for r in X.feature_vectors(m, rankings, roster).collect()}
    same = [k for k in got if k in replay]
    assert len(same) > 10
    for k in same:
        assert abs(got[k]["elo_p1"] - replay[k]["elo_p1_surface"]) < 1e-9 and abs(got[k]["elo_p2"] - replay[k]["elo_p2_surface"]) < 1e-9
        for f in ("win_pct_last10", "win_pct_last25_surface", "days_since_last_match", "rank"):
            assert got[k][f"{f}_p1"] == replay[k][f"{f}_p1"]


def test_as_of_vectors_equal_replay(world):
    """All 41 features of a day's first contest equal the replay's, whatever is played later that day or after."""
    _, spark, rankings, roster = world
    m = spark.createDataFrame([tuple(r) for r in make()], SCHEMA)
    ids = "least(winner_player_id, loser_player_id) as p1", "greatest(winner_player_id, loser_player_id) as p2"
    asked = X.contests(m).where("match_num = 0").selectExpr("match_id", "tour", "surface", "tourney_date", "level", "best_of", *ids)
    got = {r["match_id"]: r.asDict() for r in X.features_as_of(m, rankings, roster, asked).collect()}
    replay = {r["match_id"]: r.asDict() for r in X.feature_vectors(m, rankings, roster).collect()}
    same = [k for k in got if k in replay]
    assert len(same) > 10 and len(got) == asked.count()
    for k in same:
        columns = set(replay[k]) - {"label"}
        assert columns - set(got[k]) == set() and len(columns - {"match_id", "tour", "tourney_date", "p1", "p2"}) == 41
        for c in columns:
            assert got[k][c] == (pytest.approx(replay[k][c], abs=1e-9) if isinstance(replay[k][c], float) else replay[k][c]), (k, c)


def test_reliability_edges(spark):
    df = spark.createDataFrame([(p / 10, 1) for p in range(11)], "p double, y int")
    got = {r["bin"]: r["n"] for r in E.reliability(df, "y", "p").collect()}
    assert sum(got.values()) == 11 and got[9] == 2
    empty = {r["bin"]: r["mean_actual"] for r in E.reliability(df.where("p < 0.05"), "y", "p").collect()}
    assert empty[5] is None


def test_calibration_methods(spark):
    rng = random.Random(1)
    rows = [(p := rng.random(), int(rng.random() < p * p)) for _ in range(1500)]
    df = spark.createDataFrame(rows, "p double, y int")
    for method in (None, "platt"):
        out = E.calibrate(df, "p", "y", df, method=method)
        before, after = E.metrics(df, "y", "p").first()["brier"], E.metrics(out, "y", "calibrated").first()["brier"]
        assert after < before
