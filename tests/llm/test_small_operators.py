import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtspark.llm.components import component_groups
from courtspark.llm.nearest import XFastTries, nearest_in_time
from courtspark.llm.survivor import best_fields, best_records


def test_x_fast_tries_against_search():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 128, n)) for n in (1, 7, 60, 100)]
    group, offset = np.concatenate([np.full(len(s), g) for g, s in enumerate(sets)]), np.concatenate(sets)
    tries = XFastTries(group, offset, 7)
    asks_g, asks = np.repeat(np.arange(5), 128), np.tile(np.arange(128), 5)
    before, after = tries.neighbours(asks_g, asks)
    for g, x, b, a in zip(asks_g, asks, before, after, strict=True):
        have = sets[g] if g < 4 else np.array([], dtype=int)
        want_b, want_a = have[have <= x], have[have >= x]
        assert (tries.offset[b] if b >= 0 else None) == (want_b[-1] if len(want_b) else None)
        assert (tries.offset[a] if a >= 0 else None) == (want_a[0] if len(want_a) else None)


@pytest.mark.parametrize("tolerance", [0, 3, 10, 45])
def test_nearest_against_brute_force(spark, tolerance):
    rng = random.Random(tolerance)
    left = [(k, rng.choice(["a", "b", "c", None]), rng.choice([None, *range(400)]), "x") for k in range(300)]
    right = [(rng.choice(["a", "b", None]), rng.choice([None, *range(0, 400, 3)]), "y") for _ in range(90)]
    ldf, rdf = spark.createDataFrame(left, "k int, e string, t int, nearest_tick string"), spark.createDataFrame(right, "e string, t int, k string")
    got = {r["k"]: r["near"] for r in nearest_in_time(ldf, rdf, "e", F.col("t"), F.col("t"), tolerance, out="near").collect()}
    for k, e, t, _ in left:
        near = [(abs(x[1] - t), x[1]) for x in right if e and t is not None and x[0] == e and x[1] is not None and abs(x[1] - t) <= tolerance]
        assert got.get(k) == (min(near)[1] if near else None)


def test_nearest_empty(spark):
    df = spark.createDataFrame([], "e string, t int")
    full = spark.createDataFrame([("a", 1), ("a", 1)], "e string, t int")
    near = lambda a, b: nearest_in_time(a, b, "e", F.col("t"), F.col("t"), 5).count()
    assert near(df, full) == near(full, df) == near(df, df) == 0
    assert near(full, full) == 2


def test_survivors(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    rows = [("p", 1, "R", None, 1, day(1)), ("p", 2, "L", "x", 2, day(1)), ("p", 3, "L", "y", 2, day(2)), ("p", 3, "L", "y", 2, day(2)), ("q", 4, None, None, None, None), (None, 5, "R", "z", 9, day(1)), ("r", 6, "A", None, None, day(1)), ("r", 7, "R", None, None, day(1))]
    df = spark.createDataFrame(rows, "g string, record_id int, hand string, ioc string, trust int, loaded_at timestamp_ntz")
    order = [F.col("trust").desc_nulls_last(), F.col("loaded_at").desc_nulls_last(), F.col("record_id").asc_nulls_last()]
    fields = {"hand": F.col("hand"), "ioc": F.when(F.col("ioc") != "y", F.col("ioc"))}
    got = sorted(map(tuple, best_fields(df, "g", fields, order).collect()))
    assert got == [("p", "hand", "L"), ("p", "ioc", "x"), ("r", "hand", "A")]
    whole = {r["g"]: (r["record_id"], r["n_usable"]) for r in best_records(df, "g", fields, order).collect()}
    assert whole == {"p": (2, 2), "q": (4, 0), "r": (6, 1)}
    assert best_fields(df.limit(0), "g", fields, order).count() == 0


def union_find(pairs):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            ra, rb = sorted((root(a), root(b)))
            parent[rb] = ra
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("kind", ["chain", "star", "random"])
def test_components_against_union_find(spark, kind):
    rng = random.Random(7)
    name = lambda k: f"n{k:03d}"
    pairs = {"chain": [(name(k), name(k + 1)) for k in range(60)], "star": [(name(0), name(k)) for k in range(1, 80)], "random": [(name(rng.randrange(90)), name(rng.randrange(90))) for _ in range(60)]}[kind]
    pairs += [("z", "z"), (None, "a"), ("a", None), pairs[0], pairs[0][::-1]]
    got = dict(map(tuple, component_groups(spark.createDataFrame(pairs, "a string, b string"), "a", "b").collect()))
    assert got == union_find(pairs)


def test_components_of_nothing(spark):
    assert component_groups(spark.createDataFrame([("a", "a"), (None, None)], "a string, b string"), "a", "b").count() == 0
