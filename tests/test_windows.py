import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from courtspark.operators import elo
from courtspark.operators import windows as W
from courtspark.operators.asof import latest_before
from courtspark.operators.known_at import attribute_history, values_known_at
from courtspark.operators.ranks import distributed_rank
from courtspark.operators.trailing import LEAVES, build_trees, canonical_nodes, correct, daily_leaves, trailing_totals

DAY = dt.date(2024, 1, 1)


@pytest.fixture(scope="module")
def rows():
    """Many date peers, and one player with most of the rows."""
    rng = random.Random(3)
    return [(k, rng.choice("aaaaaab"), DAY + dt.timedelta(days=rng.randrange(90)), rng.choice([None, 1, 2, 3]), rng.random() < 0.7) for k in range(400)]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "k int, p string, d date, v int, rich boolean")


def before(rows, row, member=lambda r: True):
    return sorted((r for r in rows if r[1] == row[1] and (r[2], r[0]) < (row[2], row[0]) and member(r)), key=lambda r: (r[2], r[0]))


def test_running(frame, rows):
    got = {r["k"]: r for r in W.running(frame, ["p"], "d", [F.col("k")], {"s": ("sum", F.col("v")), "n": ("count", F.col("v")), "m": ("max", F.col("d"))}, shard_days=7).collect()}
    for r in rows:
        past = before(rows, r)
        assert got[r[0]]["s"] == sum(x[3] or 0 for x in past)
        assert got[r[0]]["n"] == sum(x[3] is not None for x in past)
        assert got[r[0]]["m"] == max((x[2] for x in past), default=None)


@pytest.mark.parametrize("n", [1, 5, 25])
def test_last_n_members(frame, rows, n):
    got = {r["k"]: r for r in W.last_n(frame, ["p"], "d", [F.col("k")], n, {"s": F.col("v")}, member=F.col("rich")).collect()}
    for r in rows:
        past = before(rows, r, lambda x: x[4])[-n:]
        assert (got[r[0]]["n_last"], got[r[0]]["s"]) == (len(past), sum(x[3] or 0 for x in past))


def test_calendar_bounds_are_inclusive(frame, rows):
    got = {r["k"]: r for r in W.calendar(frame, ["p"], "d", [F.col("k")], {"n7": (7, F.lit(1)), "s14": (14, F.col("v"))}, shard_days=15).collect()}
    for r in rows:
        past = before(rows, r)
        assert got[r[0]]["n7"] == sum((r[2] - x[2]).days <= 7 for x in past)
        assert got[r[0]]["s14"] == sum(x[3] or 0 for x in past if (r[2] - x[2]).days <= 14)


def test_windows_take_empty_and_null(spark):
    schema = "k int, p string, d date, v int, rich boolean"
    for data in ([], [(1, None, DAY, 1, True), (2, "a", None, 1, True)]):
        df = spark.createDataFrame(data, schema)
        assert W.running(df, ["p"], "d", [F.col("k")], {"s": ("sum", F.col("v"))}).count() == 0
        assert W.last_n(df, ["p"], "d", [F.col("k")], 3, {"s": F.col("v")}).count() == 0


def test_latest_before(spark):
    left = spark.createDataFrame([(1, "a", DAY), (2, "a", DAY + dt.timedelta(days=400)), (3, "b", DAY), (4, None, DAY), (5, "a", None)], "k int, p string, d date")
    right = spark.createDataFrame([("a", DAY, 7), ("a", DAY + dt.timedelta(days=1), 8), ("b", DAY + dt.timedelta(days=1), 9), ("a", DAY, 6)], "p string, r date, rank int")
    got = {r["k"]: r["asof"] and r["asof"]["rank"] for r in latest_before(left, right, "p", "d", "r", ["rank"]).collect()}
    assert got == {1: 7, 2: 8, 3: None, 4: None, 5: None}


def test_values_known_at_against_brute_force(spark):
    rng = random.Random(5)
    day = lambda: DAY + dt.timedelta(days=rng.randrange(200))
    hist = [(rng.choice("ab"), d := day(), dt.datetime.combine(d + dt.timedelta(days=rng.randrange(-3, 9)), dt.time(rng.randrange(24))), rng.choice([None, *range(9)]), rng.choice([None, *range(9)])) for _ in range(300)]
    events = [(k, rng.choice(["a", "b", "c", None]), rng.choice([None, day(), day(), day()]), "x") for k in range(200)]
    h = spark.createDataFrame(hist, "p string, d date, t timestamp_ntz, rank int, points int")
    e = spark.createDataFrame(events, "k int, p string, d date, value string")
    got = {r["k"]: r for r in values_known_at(e, "p", "d", {a: attribute_history(h, "p", a, "d", "t") for a in ("rank", "points")}, shard_days=16).collect()}
    assert len(got) == len(events)
    for k, p, d, _ in events:
        for a, i in (("rank", 3), ("points", 4)):
            best = max(((x[1], x[2], x[i]) for x in hist if p and d and x[0] == p and x[i] is not None and x[1] <= d and x[2].date() <= d), default=None)
            assert (None if best is None else best) == (got[k][a] and tuple(got[k][a])), (k, a)


def test_segment_tree():
    import numpy as np

    rng = np.random.default_rng(1)
    leaves = rng.integers(0, 9, (3, LEAVES))
    trees = build_trees(leaves)
    correct(trees, np.array([1, 2]), np.array([5, 127]), np.array([4, -2]))
    leaves[1, 5] += 4
    leaves[2, 127] -= 2
    assert (trees == build_trees(leaves)).all()
    for a, b in ((0, 127), (5, 5), (98, 127), (121, 127), (3, 77)):
        assert len(canonical_nodes(a, b)) <= 14
        assert (trees[:, canonical_nodes(a, b)].sum(axis=1) == leaves[:, a : b + 1].sum(axis=1)).all()


def test_trailing_totals_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(rng.choice("aaab"), DAY + dt.timedelta(days=rng.randrange(300)), rng.choice([None, 1, 2, 5])) for _ in range(120)] + [(None, DAY, 1), ("a", None, 1)]
    late = [("a", DAY + dt.timedelta(days=200), 7), ("b", DAY + dt.timedelta(days=3), 2)]
    frame = lambda r: daily_leaves(spark.createDataFrame(r, "p string, d date, v int"), "p", "d", ["v"])
    got = {(r["entity"], r["day"]): r for r in trailing_totals(frame(rows), ["v"], [7, 30], lambda v: v["n_30"] >= 0, corrections=frame(late)).collect()}
    epoch, whole = dt.date(1970, 1, 1), [r for r in rows + late if r[0] and r[1]]
    want = {}
    for p in "ab":
        for x in range(340):
            d = DAY + dt.timedelta(days=x)
            near = [r for r in whole if r[0] == p and 0 <= (d - r[1]).days <= 29]
            if near:
                want[p, (d - epoch).days] = (sum(r[1] == d for r in near), sum(r[2] or 0 for r in near if (d - r[1]).days <= 6), sum(r[2] or 0 for r in near))
    assert {k: (r["n"], r["v_7"], r["v_30"]) for k, r in got.items()} == want
    assert trailing_totals(frame([]), ["v"], [7], lambda v: v["n"] >= 0).count() == 0


def test_elo_replay_is_zero_sum_and_snapshots_before(spark):
    rng = random.Random(2)
    rows = [(f"m{k:03d}", "T", rng.choice("xy"), k // 5, *rng.sample("abcd", 2)) for k in range(100)]
    got = elo.elo_replay(spark.createDataFrame(rows, "m string, t string, s string, d int, w string, l string"), ["t", "s"], ["d", "m"], "w", "l", "m").collect()
    ratings: dict = {}
    by = {r["m"]: r for r in got}
    for m, _t, s, _d, w, loser in sorted(rows, key=lambda r: (r[3], r[0])):
        a, b = ratings.get((s, w), 1500.0), ratings.get((s, loser), 1500.0)
        assert (by[m]["winner_before"], by[m]["loser_before"]) == (a, b)
        assert abs(by[m]["winner_after"] + by[m]["loser_after"] - a - b) < 1e-9
        ratings[s, w], ratings[s, loser] = by[m]["winner_after"], by[m]["loser_after"]


def test_distributed_rank(spark):
    rng = random.Random(4)
    rows = [(rng.choice("aaab"), rng.randrange(50), k) for k in range(500)]
    got = distributed_rank(spark.createDataFrame(rows, "g string, v int, k int"), ["g"], [F.col("v").desc(), F.col("k").asc()]).collect()
    for g in "ab":
        want = [k for _, k in sorted((-v, k) for x, v, k in rows if x == g)]
        assert [r["k"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["position"])] == want
