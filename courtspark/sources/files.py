"""File sources and sinks: typed CSV, JSON text, versioned snapshots, validation."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from courtspark.functions import normalize as N
from courtspark.operators.keyed import latest_by_key
from courtspark.operators.ranks import distributed_rank
from courtspark.session import folder, remove, scratch

#: Fixed: the first bytes of a zip archive (workbooks are zip archives).
ZIP_MAGIC = "504B0304"
SERVE_CSV = {"ace": "ace", "df": "df", "svpt": "svpt", "1stIn": "first_in", "1stWon": "first_won", "2ndWon": "second_won", "SvGms": "sv_gms", "bpSaved": "bp_saved", "bpFaced": "bp_faced"}


def write_csv(df: DataFrame, path: str | None = None, mode: str = "overwrite") -> str:
    path = path or scratch(df.sparkSession)
    df.write.mode(mode).options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, escape='"').csv(path)
    return path


def csv_written(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """What `write_csv` wrote at `path`, text for text: an empty text is a quoted nothing, a null a bare one.

    A table has two columns or more: of one, a null is a blank line, which readers skip. Spark takes both for its null mark, so the mark is a text made up for this read, which no field holds.
    """
    return spark.read.schema(StructType([StructField(c, StringType()) for c in columns])).options(header=True, multiLine=True, lineSep="\n", escape='"', nullValue=uuid.uuid4().hex, emptyValue="").csv(path)


def csv_text(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Files as text columns, header skipped; no inference pass over the data. Globs keep tiers apart. Feeds leave a field empty, quoted or not, where they know nothing."""
    return spark.read.schema(StructType([StructField(c, StringType()) for c in columns])).options(header=True, escape='"').csv(list(path) if not isinstance(path, str) else path)


def csv_typed(spark: SparkSession, path: str | Sequence[str], schema: StructType) -> DataFrame:
    """Text columns cast one by one: a value that doesn't fit is null, decimals in whole-number columns are rounded."""
    raw = csv_text(spark, path, schema.names)
    return raw.select(*[(N.number(F.col(f.name)).cast(f.dataType) if f.dataType.simpleString() in ("int", "smallint") else F.col(f.name).try_cast(f.dataType)).alias(f.name) for f in schema.fields])


def roster_csv(spark: SparkSession, path: str, tour: str) -> DataFrame:
    raw = csv_text(spark, path, ["player_id", "name_first", "name_last", "hand", "dob", "ioc", "height", "wikidata_id"])
    full = F.trim(F.concat_ws(" ", "name_first", "name_last"))
    return raw.select(F.concat_ws("_", F.lit(tour), "player_id").alias("player_id"), F.lit(tour).alias("tour"), N.number(F.col("player_id")).alias("source_id"), "name_first", "name_last", full.alias("full_name"), "hand", N.day8(F.col("dob")).alias("dob"), "ioc", N.number(F.col("height")).alias("height"), "wikidata_id")


def ranking_csv(spark: SparkSession, paths: Sequence[str], tour: str) -> DataFrame:
    raw = csv_text(spark, paths, ["ranking_date", "rank", "player", "points"])
    return raw.select(N.day8(F.col("ranking_date")).alias("ranking_date"), F.concat_ws("_", F.lit(tour), "player").alias("player_id"), N.number(F.col("rank")).alias("rank"), N.number(F.col("points")).alias("points"))


MATCH_COLUMNS = ["tourney_id", "tourney_name", "surface", "draw_size", "tourney_level", "tourney_date", "match_num", *[f"{s}_{c}" for s in ("winner", "loser") for c in ("id", "seed", "entry", "name", "hand", "ht", "ioc", "age")], "score", "best_of", "round", "minutes", *[f"{s}_{c}" for s in "wl" for c in SERVE_CSV], "winner_rank", "winner_rank_points", "loser_rank", "loser_rank_points"]


def match_csv(spark: SparkSession, paths: Sequence[str], tour: str, tier: str, source: str) -> DataFrame:
    raw = csv_text(spark, paths, MATCH_COLUMNS)
    external = F.concat_ws("-", F.lit(tour), "tourney_id", F.lpad("match_num", 3, "0"))
    num = lambda c, to=None: N.number(F.col(c)).alias(to or c)
    player = lambda s: F.concat_ws("_", F.lit(tour), f"{s}_id").alias(f"{s}_player_id")
    return raw.select(
        F.concat_ws("::", F.lit(source), external).alias("match_id"), F.lit(source).alias("source"), external.alias("match_external_id"), F.lit(tour).alias("tour"), F.lit(tier).alias("match_tier"), "tourney_id", "tourney_name", "tourney_level",
        N.day8(F.col("tourney_date")).alias("tourney_date"), "surface", num("draw_size"), num("match_num"), "round", num("best_of"), num("minutes"), "score", N.status(F.col("score")).alias("match_status"), player("winner"), player("loser"),
        *[c for s in ("winner", "loser") for c in (F.col(f"{s}_seed"), F.col(f"{s}_entry"), num(f"{s}_rank"), num(f"{s}_rank_points"), F.col(f"{s}_age").try_cast("double").alias(f"{s}_age"))], *[num(f"{s}_{c}", f"{s}_{to}") for s in "wl" for c, to in SERVE_CSV.items()],
    )


def json_text(df: DataFrame, column: str, schema: str) -> DataFrame:
    """`df` with the text parsed as `parsed`; unknown fields are dropped, broken text gives nulls."""
    return df.withColumn("parsed", F.from_json(column, schema, {"mode": "PERMISSIVE"}))


_SIDE = "struct<id: string, name: string, countryAcr: string, coutryAcr: string>"
_TOURNAMENT = "struct<id: string, name: string, date: string, court: struct<name: string>, rank: struct<name: string>, tier: string>"
_CONTEST = f"id string, date string, timeGame string, player1Id string, player2Id string, player1: {_SIDE}, player2: {_SIDE}, round: struct<name: string>, tournament: {_TOURNAMENT}, result: string, match_winner: int, odd1: string, odd2: string".replace(": struct", " struct").replace("result: ", "result ").replace("match_winner: ", "match_winner ").replace("odd1: ", "odd1 ").replace("odd2: ", "odd2 ")
#: Fields read of each feed; all ids as text, as feeds write them as numbers or text.
FEEDS = {
    "calendar": f"id string, name string, date string, tier string, court struct<name: string>, rank struct<name: string>, {'countryAcr string, coutryAcr string'}",
    "fixtures": _CONTEST, "tournament_fixtures": _CONTEST, "results": _CONTEST, "past_matches": _CONTEST, "head_to_head": _CONTEST,
    "rankings": f"id string, name string, position int, point int, date string, player {_SIDE}",
}


def feed_rows(pages: DataFrame, body: str, feed: str) -> DataFrame:
    """One row per entry of the pages' `data` lists: unknown fields are dropped, missing ones null, broken pages give no rows."""
    schema = f"data array<struct<{', '.join(_as_field(f) for f in _fields(FEEDS[feed]))}>>, hasNextPage boolean"
    rows = pages.select(F.from_json(body, schema, {"mode": "PERMISSIVE"}).alias("p")).select(F.explode("p.data").alias("e")).select("e.*")
    if "coutryAcr" in rows.columns:  # the feed's own slip of the pen
        rows = rows.withColumn("countryAcr", F.coalesce("countryAcr", "coutryAcr")).drop("coutryAcr")
    return rows


def _fields(ddl: str) -> list[str]:
    out, depth = [""], 0
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [f.strip() for f in out]


def _as_field(field: str) -> str:
    name, kind = field.split(" ", 1)
    return f"{name}: {kind}"


def land_pages(spark: SparkSession, fetch: Callable[[int], dict], path: str, most: int | None = None) -> DataFrame:
    """(body) of the pages `fetch` gives from 1 on, until one says there is no next or `most` are read; each is written before the next is asked for.

    A page is a file of its own, made under a hidden name and then renamed, so that readers see whole pages; a job per
    page would take longer than the page. Pages landed at `path` before stay.
    """
    fs, at = folder(spark, path)
    fs.mkdirs(at)
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    run, page = uuid.uuid4().hex, 0
    while most is None or page < most:
        got, page = fetch(page + 1), page + 1
        name = f"{run}-{page:012d}.txt"
        out = fs.create(of(at, f"_{name}"))
        try:
            out.write(bytearray(json.dumps(got).encode() + b"\n"))
        finally:
            out.close()
        if not fs.rename(of(at, f"_{name}"), of(at, name)):
            raise OSError(f"page {page} can't be landed in {path}")
        if not got.get("hasNextPage"):
            break
    return spark.read.schema("body string").text(path)


def numbered_rows(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """`df` with `position` from 1 on under `order`, for work in chunks; rows stay distributed."""
    return distributed_rank(df.withColumn("_all", F.lit(1)), ["_all"], order).drop("_all")


def truncate(snapshot: Snapshot) -> tuple[int, Snapshot]:
    """(rows removed, the table, now empty): an empty version is published, the old one stays until it is vacuumed."""
    held = snapshot.read()
    return held.count(), publish(held.limit(0), snapshot.root, snapshot.name)


ODDS_EVENT = "id string, sport_key string, commence_time string, home_team string, away_team string, bookmakers array<struct<key: string, title: string, markets: array<struct<key: string, outcomes: array<struct<name: string, price: double>>>>>>"


def book_odds(events: DataFrame) -> DataFrame:
    """One row per event from the books' two-way prices: medians, best, count, the sharp book; margins come out per book first."""
    books = events.select("id", "sport_key", "commence_time", "home_team", "away_team", F.explode("bookmakers").alias("b"))
    market = F.get(F.filter("b.markets", lambda m: m["key"] == "h2h"), F.lit(0))
    price = lambda side: F.get(F.filter(market["outcomes"], lambda o: o["name"] == F.col(side)), F.lit(0))["price"]
    rows = books.withColumns({"book": F.col("b.key"), "a": price("home_team"), "z": price("away_team")}).where("a > 1 and z > 1").withColumn("tour", N.tour_of(F.col("sport_key"))).where("tour is not null")
    p_a, p_b = N.implied(F.col("a"), F.col("z"))
    sharp = lambda c: F.max(F.when(F.col("book") == "pinnacle", c))
    return rows.groupBy("id", "sport_key", "tour", "home_team", "away_team", "commence_time").agg(
        F.median("a").alias("median_odds_a"), F.median("z").alias("median_odds_b"), F.max("a").alias("best_odds_a"), F.max("z").alias("best_odds_b"), F.median(p_a).alias("median_implied_prob_a"), F.median(p_b).alias("median_implied_prob_b"),
        F.count(F.lit(1)).alias("books_count"), sharp(F.col("a")).alias("pinnacle_odds_a"), sharp(F.col("z")).alias("pinnacle_odds_b"), sharp(p_a).alias("pinnacle_implied_prob_a"), sharp(p_b).alias("pinnacle_implied_prob_b"),
    )


def is_archive(files: DataFrame) -> DataFrame:
    """binaryFile rows that start like a zip archive."""
    return files.where(F.hex(F.substring("content", 1, 4)) == ZIP_MAGIC)


def numbered(spark: SparkSession, path: str, prefix: str) -> dict[int, bool]:
    """Number -> committed (its _SUCCESS mark stands) of the folders `prefix`<number> under `path`; none where `path` doesn't exist.

    Any other failure to list them is raised: a table that can't be read is not a table that doesn't exist.
    """
    fs, at = folder(spark, path)
    if not fs.exists(at):
        return {}
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    found = {s.getPath().getName(): s.getPath() for s in fs.listStatus(at) if s.isDirectory()}
    return {int(name[len(prefix) :]): fs.exists(mark(p, "_SUCCESS")) for name, p in found.items() if name.startswith(prefix) and name[len(prefix) :].isdigit()}


def write_numbered(df: DataFrame, path: str, prefix: str) -> int:
    """Write `df` as the next numbered folder under `path`; it counts once Spark has committed it. Of two writers of one number one fails."""
    number = max(numbered(df.sparkSession, path, prefix), default=0) + 1
    df.write.mode("error").parquet(f"{path}/{prefix}{number:012d}")
    return number


@dataclass
class Snapshot:
    """A table as numbered versions, each a folder that is never changed: readers take the highest committed one.

    Nothing is moved or overwritten, so at any moment, whatever fails, the last committed version is in force.
    """

    spark: SparkSession
    root: str
    name: str

    @property
    def folder(self) -> str:
        return f"{self.root}/{self.name}"

    def version(self) -> int:
        """The version in force, 0 where the table was never written."""
        return max((k for k, done in numbered(self.spark, self.folder, "v").items() if done), default=0)

    def read(self) -> DataFrame:
        version = self.version()
        if not version:
            raise FileNotFoundError(f"no version of {self.folder}")
        return self.spark.read.parquet(f"{self.folder}/v{version:012d}")

    def vacuum(self, keep: int = 2) -> None:
        """Remove all but the last `keep` committed versions, and what failed writers left behind before them."""
        kept = sorted((k for k, done in numbered(self.spark, self.folder, "v").items() if done), reverse=True)[:keep]
        for k in numbered(self.spark, self.folder, "v"):
            if kept and k < kept[-1]:
                remove(self.spark, f"{self.folder}/v{k:012d}")


def publish(df: DataFrame, root: str, name: str) -> Snapshot:
    """Write a new version; a crash before its commit leaves the old version in force."""
    write_numbered(df, f"{root}/{name}", "v")
    return Snapshot(df.sparkSession, root, name)


@dataclass
class KeyedTable:
    """The newest row per key, as a base snapshot and the batches that came after it.

    A batch adds a folder of its own and rewrites nothing; readers merge base and batches; `compact` folds them into a
    new base. Each base names the last batch it holds, so no batch counts twice or is lost, whatever fails in between.
    """

    spark: SparkSession
    root: str
    name: str
    keys: Sequence[str]
    order: Sequence[str]

    @property
    def folder(self) -> str:
        return f"{self.root}/{self.name}"

    def _newest(self, df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c not in self.keys and c not in self.order]
        return latest_by_key(df, self.keys, [F.col(c).desc_nulls_last() for c in [*self.order, *rest]])

    def _parts(self) -> tuple[list[str], int]:
        bases = [k for k, done in numbered(self.spark, self.folder, "base").items() if done]
        batches = [k for k, done in numbered(self.spark, self.folder, "batch").items() if done]
        held = max(bases, default=0)
        return [f"{self.folder}/base{held:012d}"] * bool(held) + [f"{self.folder}/batch{k:012d}" for k in sorted(batches) if k > held], max([held, *batches])

    def upsert(self, batch: DataFrame) -> None:
        """Add a batch; repeated batches change nothing that readers see."""
        held = max(numbered(self.spark, self.folder, "base"), default=0)
        number = max([held, *numbered(self.spark, self.folder, "batch")]) + 1
        self._newest(batch).write.mode("error").parquet(f"{self.folder}/batch{number:012d}")

    def exists(self) -> bool:
        return bool(self._parts()[0])

    def read(self, among: Column | None = None) -> DataFrame:
        """The newest row per key (of the rows `among` allows)."""
        parts, _ = self._parts()
        if not parts:
            raise FileNotFoundError(f"{self.folder} was never written")
        frames = [self.spark.read.parquet(p) for p in parts]
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
        return self._newest(rows if among is None else rows.where(among))

    def compact(self, among: Column | None = None) -> None:
        """Fold all committed batches (the rows `among` allows) into a new base, then drop what they hold."""
        parts, last = self._parts()
        if len(parts) > 1:
            target = f"{self.folder}/base{last:012d}"
            if numbered(self.spark, self.folder, "base").get(last) is False:  # left by a crash, never read
                remove(self.spark, target)
            self.read(among).write.mode("error").parquet(target)
            for p in parts:
                remove(self.spark, p)


def violations(rules: Mapping[str, DataFrame]) -> DataFrame:
    """(rule, violations) for each rule's offending rows."""
    counts = [df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(rule).alias("rule"), "violations") for rule, df in rules.items()]
    return reduce(DataFrame.unionByName, counts)


def review_format(columns: Sequence[str]) -> str:
    have = set(columns)
    return "paired" if {"canonical_player_id", "stale_player_id"} <= have or {"winner_raw", "loser_raw"} <= have else "per_player" if {"raw_name", "verdict"} <= have else "unknown"
