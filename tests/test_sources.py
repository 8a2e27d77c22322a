import json
from collections import Counter

import pytest

from pyspark.sql import functions as F

from courtspark.sources import files
from courtspark.streaming import jobs


def test_csv_sources(spark, tmp_path):
    (tmp_path / "atp_players.csv").write_text("player_id,name_first,name_last,hand,dob,ioc,height,wikidata_id\n1,Ana, Li ,R,19990102,CHN,185.0,Q1\n2,,Solo,,,,x,\n")
    got = [tuple(r) for r in files.roster_csv(spark, str(tmp_path / "atp_players.csv"), "ATP").select("player_id", "full_name", F.col("dob").cast("string"), "height").orderBy("player_id").collect()]
    assert got == [("ATP_1", "Ana  Li", "1999-01-02", 185), ("ATP_2", "Solo", None, None)]
    head = ",".join(files.MATCH_COLUMNS)
    values = {c: "" for c in files.MATCH_COLUMNS} | {"tourney_id": "2020-1", "tourney_date": "20200106", "match_num": "7", "winner_id": "1", "loser_id": "2", "score": "6-4 2-1 RET", "w_ace": "3.0", "best_of": "3"}
    (tmp_path / "m_2020.csv").write_text(head + "\n" + ",".join(values[c] for c in files.MATCH_COLUMNS) + "\n")
    row = files.match_csv(spark, [str(tmp_path / "m_20[0-9]*.csv")], "ATP", "main", "arch").first()
    assert (row["match_id"], row["match_status"], row["w_ace"], row["winner_player_id"], row["minutes"]) == ("arch::ATP-2020-1-007", "RET", 3, "ATP_1", None)
    (tmp_path / "r.csv").write_text("ranking_date,rank,player,points\n20200106,1,5,1000\nbad,2,6,\n")
    assert files.ranking_csv(spark, [str(tmp_path / "r.csv")], "WTA").where("ranking_date is not null").count() == 1


def test_written_csv_is_read_back_as_it_was(spark):
    odd = [None, "", " ", " y ", '"', 'a "b", c', "\\", "a,b\\", '\\"', "a\nb", "a\r\nb", "\r", "#c", "null", "é"]
    rows = [(a, b) for a in odd for b in odd]
    at = files.write_csv(spark.createDataFrame(rows[:100], "a string, b string"))
    files.write_csv(spark.createDataFrame(rows[100:], "a string, b string"), at, "append")
    assert Counter(map(tuple, files.csv_written(spark, at, ["a", "b"]).collect())) == Counter(rows)


def test_every_page_lands_without_a_job(spark, tmp_path):
    jobs_of = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    seen = []

    def fetch(page):
        landed = [p.read_text() for p in (tmp_path / "p").glob("[!._]*")]
        seen.append(len(landed))
        return {"data": [{"id": page, "name": "é\n"}], "hasNextPage": page < 150}

    before = jobs_of()
    pages = files.land_pages(spark, fetch, str(tmp_path / "p"))
    assert jobs_of() == before and seen == list(range(150))  # each is there before the next is asked for
    assert sorted(int(r["id"]) for r in files.feed_rows(pages, "body", "rankings").where("name = 'é\n'").collect()) == list(range(1, 151))
    assert files.land_pages(spark, fetch, str(tmp_path / "p"), most=2).count() == 152


def test_book_odds(spark, tmp_path):
    book = lambda k, a, b: {"key": k, "title": k, "markets": [{"key": "h2h", "outcomes": [{"name": "B", "price": b}, {"name": "A", "price": a}]}]}
    event = {"id": "e", "sport_key": "tennis_atp_x", "commence_time": "2024-01-01T10:00:00Z", "home_team": "A", "away_team": "B", "bookmakers": [book("pinnacle", 2.0, 2.0), book("x", 1.0, 9.0), book("y", 1.5, 3.0)]}
    (tmp_path / "odds.json").write_text(json.dumps(event))
    row = files.book_odds(spark.read.schema(files.ODDS_EVENT).json(str(tmp_path / "odds.json"))).first()
    assert (row["median_odds_a"], row["best_odds_b"], row["books_count"], row["pinnacle_odds_a"], row["tour"]) == (1.75, 3.0, 2, 2.0, "ATP")
    assert abs(row["median_implied_prob_a"] - (0.5 + 2 / 3) / 2) < 1e-9


def test_snapshot_and_magic(spark, tmp_path):
    for n in (3, 5):
        snap = files.publish(spark.range(n), f"file://{tmp_path}/s", "t")
    assert snap.read().count() == 5
    (tmp_path / "a.xlsx").write_bytes(b"PK\x03\x04rest")
    (tmp_path / "b.xlsx").write_bytes(b"\xd0\xcf\x11")
    got = files.is_archive(spark.read.format("binaryFile").load(str(tmp_path / "*.xlsx"))).select("path").collect()
    assert [r["path"].rsplit("/", 1)[1] for r in got] == ["a.xlsx"]
    assert files.review_format(["raw_name", "verdict"]) == "per_player" and files.review_format(["x"]) == "unknown"


def test_streams(spark, tmp_path):
    rows = [(k, "ab"[k % 2], f"2024-01-0{1 + k % 5} 10:00:00", k) for k in range(20)]
    df = spark.createDataFrame(rows, "id int, k string, t string, v int").withColumn("t", F.col("t").cast("timestamp"))
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = lambda: jobs.read_stream(spark, f"{tmp_path}/in", df.schema)
    snap = jobs.upsert_stream(stream(), f"{tmp_path}/out", "latest", f"{tmp_path}/c1", ["k"], ["t", "id"])
    want = {k: max((r[2], r[0]) for r in rows if r[1] == k)[1] for k in "ab"}
    assert {r["k"]: r["id"] for r in snap.read().collect()} == want
    contests = stream().select(F.lit("l").alias("ladder"), F.col("t").alias("day"), F.col("id").cast("string").alias("key"), F.when(F.col("v") % 3 == 0, "x").otherwise("y").alias("winner"), F.when(F.col("v") % 3 == 0, "y").otherwise("x").alias("loser"))
    ratings, scored = jobs.rating_stream(contests, f"{tmp_path}/elo", "r", f"{tmp_path}/c2")
    got = scored.read()
    assert got.count() == 20 and got.where("abs(winner_before + loser_before - 3000) > 1e-6").count() == 0
    assert got.select("batch").distinct().count() == 3 and abs(sum(r["rating"] for r in ratings.read().collect()) - 3000) < 1e-6


def test_upsert_survives_what_fails(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "k string, t int")
    kept = files.KeyedTable(spark, str(tmp_path), "t", ["k"], ["t"])
    with pytest.raises(FileNotFoundError):
        kept.read()
    kept.upsert(rows(*[(f"k{i}", 1) for i in range(10)]))
    # a writer that died before its commit: its folder is there, its mark is not
    rows(("k0", 99)).write.parquet(f"{kept.folder}/batch{2:012d}")
    (tmp_path / "t" / f"batch{2:012d}" / "_SUCCESS").unlink()
    assert kept.read().count() == 10 and kept.read().where("t > 1").count() == 0
    kept.upsert(rows(("k0", 2), ("new", 1)))
    assert kept.read().count() == 11 and kept.read().where("k = 'k0'").first()["t"] == 2
    kept.upsert(rows(("k0", 2), ("new", 1)))  # a repeated batch
    assert kept.read().count() == 11
    # died between the new base and the removal of what it holds
    keep = files.remove
    files.remove = lambda *_: None
    try:
        kept.compact()
    finally:
        files.remove = keep
    assert kept.read().count() == 11 and len(kept._parts()[0]) == 1
    kept.upsert(rows(("k1", 5)))
    kept.compact()
    assert kept.read().count() == 11 and kept.read().where("k = 'k1'").first()["t"] == 5
    # a stored part that is there but can't be read stops the job; nothing is published over it
    for part in (tmp_path / "t").rglob("*.parquet"):
        part.write_bytes(b"broken")
    with pytest.raises(Exception):
        kept.read().collect()


def test_snapshot_versions(spark, tmp_path):
    for n in (3, 5):
        snap = files.publish(spark.range(n), str(tmp_path), "t")
    spark.range(9).write.parquet(f"{snap.folder}/v{3:012d}")
    (tmp_path / "t" / f"v{3:012d}" / "_SUCCESS").unlink()
    assert snap.version() == 2 and snap.read().count() == 5
    assert files.publish(spark.range(4), str(tmp_path), "t").read().count() == 4
    snap.vacuum(keep=1)
    assert sorted(files.numbered(spark, snap.folder, "v")) == [4]
    with pytest.raises(FileNotFoundError):
        files.Snapshot(spark, str(tmp_path), "none").read()
