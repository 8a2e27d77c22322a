import random

from pyspark.sql import functions as F

from courtspark.operators import keyed as K
from courtspark.operators import resolve as R

SCHEMA = "k string, v int, t int"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_latest_takes_ties_nulls_and_repeats(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("a", 2, 2), (None, 3, None), ("b", 4, None)], SCHEMA)
    assert rows(K.latest_by_key(df, ["k"], [F.col("t").desc_nulls_last(), F.col("v").desc()])) == [("a", 2, 2), ("b", 4, None), (None, 3, None)]


def test_first_write_wins(spark):
    old = spark.createDataFrame([("a", 1, 1)], SCHEMA)
    new = spark.createDataFrame([("a", 9, 0), ("b", 2, 2), ("b", 3, 1), (None, 5, 5), (None, 6, 6)], SCHEMA)
    assert rows(K.append_first_wins(old, new, ["k"], [F.col("t").asc()])) == [("a", 1, 1), ("b", 3, 1), (None, 5, 5), (None, 6, 6)]


def test_last_write_wins_and_subset(spark):
    old = spark.createDataFrame([("a", 1, 1), ("c", 7, 7)], SCHEMA)
    new = spark.createDataFrame([("a", 9, 0), ("b", 2, 2), ("b", 3, 1)], SCHEMA)
    assert rows(K.upsert_last_wins(old, new, ["k"], [F.col("t").desc()])) == [("a", 9, 0), ("b", 2, 2), ("c", 7, 7)]
    assert rows(K.upsert_last_wins(old, new, ["k"], [F.col("t").desc()], update=["v"])) == [("a", 9, 1), ("b", 2, 2), ("c", 7, 7)]


def test_prune_is_a_no_op_when_nothing_was_seen(spark):
    stored = spark.createDataFrame([("a", 1, 1), ("b", 2, 2), ("c", 3, 3)], SCHEMA)
    none = spark.createDataFrame([], "k string")
    seen = spark.createDataFrame([("a",)], "k string")
    scope = F.col("t") < 3
    assert K.prune_unseen(stored, none, ["k"], scope).count() == 3
    assert rows(K.prune_unseen(stored, seen, ["k"], scope)) == [("a", 1, 1), ("c", 3, 3)]


def test_fuzzy_lookup_cases(spark):
    roster = spark.createDataFrame([("ATP", "1", "Novak", "Đoković"), ("ATP", "2", "Guillermo", "Coria"), ("ATP", "3", "Federico", "Coria"), ("ATP", "4", "Unknown", "X")], "tour string, player_id string, name_first string, name_last string")
    index = R.alias_index(R.alias_forms(roster))
    names = spark.createDataFrame([("ATP", "Dokovic N."), ("ATP", "Djokovic Novak"), ("ATP", "Coria G"), ("ATP", "Zzz Qqq"), ("ATP", None)], "tour string, raw string")
    got = {r["raw"]: r for r in R.fuzzy_lookup(names, index).collect()}
    assert (got["Dokovic N."]["player_id"], got["Dokovic N."]["status"]) == ("1", "auto")
    assert got["Djokovic Novak"]["player_id"] == "1"
    assert got["Coria G"]["player_id"] == "2"
    assert got["Zzz Qqq"]["status"] == "unknown" and got["Zzz Qqq"]["player_id"] is None


def test_bounds_leave_out_nothing_and_score_little(spark, monkeypatch):
    """Against scoring every pair; a name is scored with a few of the aliases that share its head, not with all."""
    rng = random.Random(3)
    name = lambda: " ".join("".join(rng.choice(["an", "be", "ri", "on", "ko", "st"]) for _ in range(rng.randrange(2, 5))) for _ in range(2))
    keys = sorted({name() for _ in range(600)} | {"é" * 70 + " anna"})
    ids = [f"p{rng.randrange(200)}" for _ in keys]
    bounds, calls, full = R.Bounds(keys), [], R.similarity
    monkeypatch.setattr(R, "similarity", lambda x, y: calls.append(1) or full(x, y))
    for text in [name() for _ in range(60)] + ["anon" * 20, "", "xyz"]:
        best = {}
        for k, i in zip(keys, ids, strict=True):
            if (s := round(full(text, k), 6)) >= 0.7:
                best[i] = max(s, best.get(i, 0))
        assert R._two_best(text, bounds, keys, ids, 0.7) == sorted(best.items(), key=lambda e: (-e[1], e[0]))[:2]
    assert len(calls) < 0.1 * 63 * len(keys)
    monkeypatch.undo()
    index = spark.createDataFrame([("T", k, i, 1) for k, i in zip(keys, ids, strict=True)], "tour string, alias_key string, player_id string, namesakes int")
    names = spark.createDataFrame([("T", name()) for _ in range(40)], "tour string, raw string")
    assert rows(R.fuzzy_lookup(names, index, block=7)) == rows(R.fuzzy_lookup(names, index))


def test_chains_close(spark):
    m = spark.createDataFrame([(f"p{k + 1:02d}", f"p{k:02d}") for k in range(30)] + [("x", "x"), (None, "a")], "stale string, canonical string")
    got = dict(map(tuple, R.close_chains(m).collect()))
    assert got == {f"p{k:02d}": "p00" for k in range(1, 31)}


def test_duplicate_groups_are_null_safe(spark):
    roster = spark.createDataFrame([("a", "N", None), ("b", "N", None), ("c", "N", "x")], "player_id string, name string, ioc string")
    counts = spark.createDataFrame([("a", 5)], "player_id string, n_matches int")
    got = rows(R.duplicate_groups(roster, ["name", "ioc"], counts).select("player_id", "n_matches"))
    assert got == [("a", 5), ("b", 0)]
