"""Scalar functions of the archive as column expressions; only Unicode decomposition needs Python."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Names of indoor hard-court events and of the men's 500 series, codes, labels and windows.
INDOOR_EVENTS = [
    "atp finals", "tour finals", "masters cup", "nextgen finals", "next gen finals", "paris masters", "paris", "bercy", "madrid masters", "stuttgart masters", "rotterdam", "vienna", "basel",
    "memphis", "marseille", "stockholm", "sofia", "antwerp", "metz", "san jose", "moscow", "milan", "zagreb", "st. petersburg", "st petersburg", "copenhagen", "lyon", "atp paris", "tashkent",
    "long island", "las vegas", "cologne", "wta finals", "wta tour championships", "wta championships", "tour championships", "tournament of champions", "linz", "luxembourg", "quebec city",
    "quebec", "zurich", "filderstadt", "ostrava", "moscow kremlin cup", "kremlin cup", "porsche grand prix",
]
SERIES_500 = ["rotterdam", "rio de janeiro", "rio", "acapulco", "dubai", "barcelona", "queen's club", "queens club", "queens", "halle", "hamburg", "washington", "beijing", "tokyo", "vienna", "basel", "memphis", "indianapolis", "milan"]
LEVELS = {"both": {"G": "Slam", "F": "Finals"}, "ATP": {"M": "M1000", "A": "ATP250"}, "WTA": {"PM": "M1000", "P": "WTA500", "I": "WTA250", "T1": "M1000", "T2": "WTA500", "T3": "WTA250", "T4": "WTA250", "T5": "WTA250", "W": "WTA250"}}
QUALIFYING_LEVELS = {("ATP", "qual_chall"): ["G", "M", "A"], ("WTA", "qual_itf"): ["G", "PM", "P", "I", "T1", "T2", "W"]}
LETTERS = {"Đ": "D", "đ": "d", "Ł": "L", "ł": "l", "Ø": "O", "ø": "o", "Æ": "AE", "æ": "ae", "Þ": "Th", "þ": "th", "ß": "ss"}
PEAK_AGE = {"ATP": 26.0, "WTA": 24.0}
ROUND_RANK = {"Q1": -3, "Q2": -2, "Q3": -1, "First": 1, "1st Round": 1, "Second": 2, "2nd Round": 2, "Third": 3, "3rd Round": 3, "Fourth": 4, "4th Round": 4, "Round of 16": 4, "1/8": 4, "Quarter-final": 5, "Quarterfinal": 5, "1/4": 5, "QF": 5, "Semi-final": 6, "Semifinal": 6, "1/2": 6, "SF": 6, "Final": 7, "F": 7}


def lookup(column: Column, values: Mapping[str, object]) -> Column:
    """The value a constant table has for the column, else null."""
    return reduce(lambda acc, kv: acc.when(column == kv[0], F.lit(kv[1])), values.items(), F.when(F.lit(False), F.lit(next(iter(values.values())))))


@F.pandas_udf(StringType())
def without_marks(names: pd.Series) -> pd.Series:
    table = str.maketrans(LETTERS)
    return names.map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFKD", s.translate(table)) if not unicodedata.combining(c)))


def name_key(column: Column) -> Column:
    """Lower case, no accents, `. , ' " -` as spaces, single spaces; null gives ''."""
    plain = F.lower(without_marks(column))
    return F.coalesce(F.trim(F.regexp_replace(F.regexp_replace(plain, "[.,'\"-]", " "), r"\s+", " ")), F.lit(""))


def side_name(column: Column) -> Column:
    """Names as feeds spell them: lower, hyphens as spaces, single spaces; accents stay."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(column)), "-", " "), r"\s+", " "))


def surface(raw: Column, event: Column) -> Column:
    s = F.lower(F.trim(raw))
    indoor = F.coalesce(F.lower(F.trim(event)).isin(INDOOR_EVENTS), F.lit(False))
    return F.when(s == "clay", "Clay").when(s == "grass", "Grass").when(s.isin("carpet", "i.hard"), "IHard").when((s == "hard") & indoor, "IHard").when(s == "hard", "Hard")


def level(tour: Column, raw: Column, event: Column) -> Column:
    """Canonical event level, null where out of scope; a women's event with 125 in its name is out whatever its code."""
    code = F.trim(raw)
    minor = (tour == "WTA") & F.coalesce(event.contains("125"), F.lit(False))
    men = F.when((code == "A") & F.coalesce(F.lower(F.trim(event)).isin(SERIES_500), F.lit(False)), "ATP500").otherwise(lookup(code, LEVELS["ATP"]))
    return F.when(minor, F.lit(None).cast("string")).otherwise(F.coalesce(lookup(code, LEVELS["both"]), F.when(tour == "ATP", men), F.when(tour == "WTA", lookup(code, LEVELS["WTA"]))))


def is_tour_qualifying(tour: Column, tier: Column, raw_level: Column) -> Column:
    hits = [(tour == t) & (tier == k) & raw_level.isin(codes) for (t, k), codes in QUALIFYING_LEVELS.items()]
    return F.coalesce(reduce(lambda a, b: a | b, hits), F.lit(False))


def status(score: Column) -> Column:
    has = lambda x: score.contains(x)
    return F.when(score.isNull() | (score == ""), "unknown").when(has("RET"), "RET").when(has("W/O"), "W/O").when(has("DEF"), "DEF").otherwise("completed")


def completion(result: Column) -> Column:
    s = F.lower(F.coalesce(result, F.lit("")))
    return F.when(s.contains("ret"), "RET").when(s.contains("walkover") | F.concat(F.lit(" "), s).contains(" w/o"), "WO").when(s.contains("def"), "DEF").otherwise("W")


def sets_played(score: Column) -> Column:
    tokens = F.split(F.coalesce(score, F.lit("")), r"\s+")
    return F.size(F.filter(tokens, lambda t: t.rlike(r"^\d+-\d+(\(\d+\))?$")))


def winner_side(score: Column) -> Column:
    """1 or 2 by sets won, null on a tie or without sets."""
    pairs = F.transform(F.split(F.coalesce(score, F.lit("")), r"\s+"), lambda t: F.split(F.regexp_replace(t, r"\(.*$", ""), "-"))
    sets = F.filter(pairs, lambda p: (F.size(p) == 2) & p[0].rlike(r"^\d+$") & p[1].rlike(r"^\d+$"))
    margin = F.aggregate(sets, F.lit(0), lambda acc, p: acc + F.signum(p[0].cast("int") - p[1].cast("int")).cast("int"))
    return F.when(margin > 0, 1).when(margin < 0, 2)


def number(column: Column) -> Column:
    """Text to int, decimals rounded; null where it isn't a number."""
    return F.round(column.try_cast("double")).try_cast("int")


def day8(column: Column) -> Column:
    """YYYYMMDD text to date, null where it isn't one."""
    return F.try_to_date(column, "yyyyMMdd")


def odds(column: Column) -> Column:
    x = column.try_cast("double")
    return F.when(x > 1.0, x)


def implied(a: Column, b: Column) -> list[Column]:
    """Probabilities of two decimal odds with the margin taken out."""
    total = 1 / a + 1 / b
    return [1 / a / total, 1 / b / total]


def first_valid_pair(sources: Sequence[tuple[Column, Column, str]]) -> Column:
    """struct(a, b, source) of the first source with both odds above 1."""
    one = lambda a, b, name: F.when((odds(a).isNotNull()) & (odds(b).isNotNull()), F.struct(odds(a).alias("a"), odds(b).alias("b"), F.lit(name).alias("source")))
    return F.coalesce(*[one(*s) for s in sources])


def odds_pair(text: Column) -> Column:
    """struct(low, high) of the first two prices in a text (by first, then second position) whose margin is plausible."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b([1-9]\d?\.\d{2})\b"), 1), lambda x: x.cast("double"))
    ok = F.transform(found, lambda x, i: F.transform(F.slice(found, i + 2, F.greatest(F.size(found), F.lit(1))), lambda y: F.struct(F.least(x, y).alias("low"), F.greatest(x, y).alias("high"), (1 / x + 1 / y).alias("sum"))))
    plausible = F.filter(F.flatten(ok), lambda p: p["sum"].between(0.95, 1.25) & (p["low"] >= 1.01) & (p["high"] <= 99.0))
    return F.get(plausible, F.lit(0))


def fixture_key(tour: Column, a: Column, b: Column, day: Column) -> Column:
    """Order-free key of a fixture: 24 hex digits."""
    x, y = side_name(a), side_name(b)
    return F.substring(F.sha1(F.concat_ws("::", F.upper(tour), F.least(x, y), F.greatest(x, y), F.date_format(day, "yyyy-MM-dd"))), 1, 24)


def hand(raw: Column) -> Column:
    s = F.upper(F.trim(raw))
    return F.when(s.isin("R", "L", "A", "U"), s).otherwise("U")


def age(dob: Column, day: Column) -> Column:
    return F.date_diff(day, dob) / F.lit(365.25)


def age_vs_peak(years: Column, tour: Column) -> Column:
    return F.when(years.isNull(), F.lit(None)).otherwise(years - F.coalesce(lookup(tour, PEAK_AGE), F.raise_error(F.concat(F.lit("unknown tour "), tour)).cast("double")))


def expected_score(diff: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), -diff / 400))


def naive_utc(wall: Column, zone: str) -> Column:
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), wall)


def lenient_day(text: Column) -> Column:
    return F.try_to_date(F.substring(F.trim(text), 1, 10), "yyyy-MM-dd")


def tour_of(key: Column) -> Column:
    return F.when(key.startswith("tennis_atp"), "ATP").when(key.startswith("tennis_wta"), "WTA")


def shown(*names: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(n), F.lit("")) for n in names])


def is_noon(moment: Column) -> Column:
    """The time of day by which feeds mark that only the day is known."""
    return (F.hour(moment) == 12) & (F.minute(moment) == 0) & (F.second(moment) == 0)


def url_key(url: Column) -> Column:
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")
    return F.concat(host, F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), r"/+$", ""))


def round_rank(label: Column) -> Column:
    """Order of a round's label, qualifying below zero; null (never 0) where the label is unknown."""
    return lookup(label, ROUND_RANK)


# Tiers and names of fixtures, courts of the two feeds, sets that win by level.
TIER_LEVELS = {"Grand Slam": "Slam", "ATP Masters 1000": "M1000", "ATP 500": "ATP500", "ATP 250": "ATP250", "WTA Masters 1000": "M1000", "WTA 1000": "M1000", "WTA 500": "WTA500", "WTA 250": "WTA250", "Finals": "Finals", "Masters series": "M1000"}
SLAM_NAMES = ["roland garros", "french open", "wimbledon", "australian open", "us open"]
MAIN_TOUR, MAIN_TOUR_LEVEL = "Main tour", {"ATP": "ATP500", "WTA": "WTA500"}
LOADED_COURTS = {"I.hard": "Hard"}
LIVE_COURTS = {"I.hard": "IHard", "i.hard": "IHard", "I.Hard": "IHard"}


def tier_level(tier: Column, event: Column, tour: Column) -> Column:
    """Event level of a fixture: by its tier, else by a name that only the greatest events have, else the usual one of the tour's main tier; null elsewhere."""
    slam = reduce(lambda a, b: a | b, [F.coalesce(F.lower(event).contains(n), F.lit(False)) for n in SLAM_NAMES])
    return F.coalesce(lookup(tier, TIER_LEVELS), F.when(slam, F.lit("Slam")), F.when(tier == MAIN_TOUR, lookup(tour, MAIN_TOUR_LEVEL)))


def best_of_default(tour: Column, canonical_level: Column) -> Column:
    """Sets a contest is played over where the source doesn't say: five at men's greatest events, else three; null without a level."""
    return F.when(canonical_level.isNull(), F.lit(None).cast("int")).when((tour == "ATP") & (canonical_level == "Slam"), 5).otherwise(3)


def court(raw: Column, names: Mapping[str, str]) -> Column:
    """A feed's court name as a surface; unknown names pass through."""
    return F.coalesce(lookup(raw, names), raw)


def shown_time(utc: Column, zone: str, pattern: str = "yyyy-MM-dd HH:mm z") -> Column:
    """A UTC time on the clock of a zone, with the zone's abbreviation of that date. The session's zone must be UTC."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
    offset = F.timestamp_diff("MINUTE", utc, local)
    names = F.lit("UTC") if zone == "UTC" else reduce(lambda acc, kv: acc.when(offset == kv[1], kv[0]), ZONE_NAMES[zone].items(), F.when(F.lit(False), ""))
    return F.concat(F.date_format(local, pattern.replace(" z", "")), F.lit(" "), names)


#: Fixed: abbreviations by minutes from UTC.
ZONE_NAMES = {"Europe/Berlin": {"CET": 60, "CEST": 120}, "Europe/London": {"GMT": 0, "BST": 60}, "America/New_York": {"EST": -300, "EDT": -240}, "Asia/Tokyo": {"JST": 540}}


def on_court(day: Column, start: Column) -> Column:
    """The time play starts: the stated one, unless it only marks the day; else that of the day, unless that is such a mark too."""
    real = lambda c: F.when(c.isNotNull() & ~is_noon(c), c)
    return F.coalesce(real(start), real(day), start, day)
