import pytest
from pyspark.sql import functions as F

from courtspark.functions import normalize as N


def one(spark, column, **values):
    kinds = {str: "string", int: "int", float: "double", type(None): "string"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "event", "want"), [("Hard", None, "Hard"), (" clay ", "Paris", "Clay"), ("Hard", " BASEL", "IHard"), ("Carpet", None, "IHard"), ("I.hard", None, "IHard"), ("Grass", "x", "Grass"), (None, "Basel", None), ("sand", "x", None)])
def test_surface(spark, raw, event, want):
    assert one(spark, N.surface(F.col("a"), F.col("b")), a=raw, b=event) == want


@pytest.mark.parametrize(
    ("tour", "code", "event", "want"),
    [("ATP", "G", "x", "Slam"), ("WTA", "F", None, "Finals"), ("ATP", "M", "x", "M1000"), ("ATP", "A", "Basel", "ATP500"), ("ATP", "A", "Gstaad", "ATP250"), ("ATP", "D", "x", None), ("WTA", "PM", "x", "M1000"), ("WTA", "P", "Open 125", None), ("WTA", "T3", "x", "WTA250"), ("WTA", "CC", "x", None), ("ATP", None, "x", None)],
)
def test_level(spark, tour, code, event, want):
    assert one(spark, N.level(F.col("t"), F.col("c"), F.col("e")), t=tour, c=code, e=event) == want


@pytest.mark.parametrize(("score", "status", "sets", "side"), [("6-4 7-6(5) 2-1 RET", "RET", 3, 1), ("W/O", "W/O", 0, None), (None, "unknown", 0, None), ("", "unknown", 0, None), ("3-6 6-4 6-7(4)", "completed", 3, 2), ("6-4 4-6", "completed", 2, None), ("6-0 DEF", "DEF", 1, 1)])
def test_scores(spark, score, status, sets, side):
    assert one(spark, N.status(F.col("s")), s=score) == status
    assert one(spark, N.sets_played(F.col("s")), s=score) == sets
    assert one(spark, N.winner_side(F.col("s")), s=score) == side


@pytest.mark.parametrize(("raw", "want"), [("Đoković, N.", "dokovic n"), ("O'Brien-Smith", "o brien smith"), ("Łukasz  Ø", "lukasz o"), (None, ""), ("", "")])
def test_name_key(spark, raw, want):
    assert one(spark, N.name_key(F.col("s")), s=raw) == want


def test_fixture_key_ignores_order(spark):
    df = spark.createDataFrame([("ATP", "A-b C", "D e", "2024-01-02")], "t string, a string, b string, d string")
    x, y = df.select(N.fixture_key(F.col("t"), F.col("a"), F.col("b"), F.col("d").cast("date")), N.fixture_key(F.lower("t"), F.col("b"), F.col("a"), F.col("d").cast("date"))).first()
    assert x == y and len(x) == 24


def test_odds(spark):
    assert one(spark, N.odds(F.col("s")), s="1.0") is None
    assert one(spark, N.odds_pair(F.col("s")), s="v1.05 on 1.50 or 2.60 now")["low"] == 1.5
    assert one(spark, N.odds_pair(F.col("s")), s="9.99 and 8.88") is None
    assert one(spark, N.number(F.col("s")), s="2.5") == 3 and one(spark, N.number(F.col("s")), s="x") is None


def test_unknown_tour_raises(spark):
    with pytest.raises(Exception, match="unknown tour"):
        one(spark, N.age_vs_peak(F.col("a"), F.col("t")), a=20.0, t="XYZ")
