"""Matching entities across sources without keys: weighted soft rules as a convex hinge-loss problem, solved by distributed ADMM."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtspark.operators.keyed import latest_by_key
from courtspark.session import Rounds, stored, tidy

#: Letters that don't decompose, and name particles that tell nobody apart.
_LETTERS = str.maketrans({"ø": "o", "æ": "ae", "œ": "oe", "ß": "ss", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "ı": "i"})
PARTICLES = {"van", "von", "der", "den", "de", "da", "di", "del", "la", "le", "dos"}


def plain_tokens(name: str | None) -> list[str]:
    """Lower-case words of a name without accents, particles and punctuation."""
    folded = unicodedata.normalize("NFKD", (name or "").casefold()).translate(_LETTERS)
    letters = "".join(c if c.isalnum() else " " for c in folded if not unicodedata.combining(c))
    words = letters.split()
    return [w for w in words if w not in PARTICLES] or words


def edits(a: str, b: str) -> int:
    """Insertions, deletions, replacements and swaps of neighbours between two words."""
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            cost = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                cost = min(cost, older[j - 2] + 1)
            row.append(cost)
    return row[-1]


def word_similarity(a: str, b: str) -> float:
    if a == b:
        return 1.0
    longest = max(len(a), len(b))
    d = edits(a, b)
    return 0.0 if d > (1 if longest < 8 else 2) or longest < 4 else 1.0 - d / longest


def name_similarity(given: list[str], first: list[str], last: list[str]) -> float:
    """How well a name in any form fits (first names, last names): 0 to 1.

    Last names are aligned with the most similar words; a missing one of several costs a little. What is left is held
    against the first names: equal, initial, shortened or misspelt. Nothing to compare counts as unsure, more so under a
    misspelt last name.
    """
    left = list(given)
    scores = []
    for word in last:
        best = max(left, key=lambda g: word_similarity(g, word), default=None)
        s = word_similarity(best, word) if best is not None else 0.0
        if s > 0:
            left.remove(best)
        scores.append(s)
    hits = [s for s in scores if s > 0]
    if not hits:
        return 0.0
    surname = sum(hits) / len(hits) * (1.0 - 0.15 * (len(scores) - len(hits)) / len(scores))
    if not first or not left:
        return surname**3 * 0.75 * (0.9 ** max(0, len(left) - len(first)))
    best = 0.0
    for g in left:
        f = first[0]
        if g == f:
            s = 1.0
        elif len(g) == 1 or len(f) == 1:
            s = 0.92 if g[0] == f[0] else 0.0
        elif f.startswith(g) or g.startswith(f):
            s = 0.95
        else:
            s = word_similarity(g, f) * 0.95
        best = max(best, s)
    return surname * best * (0.8 ** (len(left) - 1))


def _deletions(word: Column) -> Column:
    """The word and all forms with one letter less: two words within one edit, or one swap, share a form.

    Exploded, this makes many rows of one, which the planner's size estimates don't know of: joins on forms must name
    their kind, or a table is broadcast by the size it had before.
    """
    less = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), F.when(F.length(word) >= 4, less).otherwise(F.array().cast("array<string>"))))


def _parsed(df: DataFrame, keep: str, columns: dict[str, str]) -> DataFrame:
    """`df` with a list of plain words for each name column in `columns` (out -> in)."""
    schema = f"{keep}, " + ", ".join(f"{out} array<string>" for out in columns)
    kept = [x.split()[0] for x in keep.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[kept].assign(**{out: [plain_tokens(x) for x in pdf[c]] for out, c in columns.items()})

    return df.mapInPandas(run, schema)


@dataclass
class Names:
    """Raw names and roster entries as lists of plain words, and which last names a raw name may hold.

    given: pool, raw, given. known: pool, player_id, firsts, lasts; an entry may have several spellings. words: pool, raw,
    word, the last-name words of the roster that are within one edit or swap of a word of the raw name (by deletion
    forms), or belong to an entry whose whole name, spaces left out, is. squeezed: pool, raw, player_id, fit of the latter.
    """

    given: DataFrame
    known: DataFrame
    words: DataFrame
    squeezed: DataFrame

    @classmethod
    def of(cls, names: DataFrame, roster: DataFrame) -> Names:
        """names: pool, raw. roster: pool, player_id, first, last. Work is on distinct names and distinct words."""
        given = stored(_parsed(names.where("pool is not null and raw is not null").select("pool", "raw").distinct(), "pool string, raw string", {"given": "raw"}))
        known = roster.where("pool is not null and player_id is not null").select("pool", "player_id", "first", "last").distinct()
        known = stored(_parsed(known, "pool string, player_id string", {"firsts": "first", "lasts": "last"}).where("size(lasts) > 0").distinct())
        held = given.select("pool", "raw", F.explode("given").alias("given_word"))
        given_words = held.select("pool", "given_word").distinct().withColumn("form", F.explode(_deletions(F.col("given_word"))))
        roster_words = known.select("pool", F.explode("lasts").alias("word")).distinct().withColumn("form", F.explode(_deletions(F.col("word"))))
        near = given_words.join(roster_words.hint("merge"), ["pool", "form"]).select("pool", "given_word", "word").distinct().where("levenshtein(given_word, word) <= 2")
        squeezed = stored(_squeezed_candidates(given, known))
        whole = squeezed.join(known, ["pool", "player_id"]).select("pool", "raw", F.explode("lasts").alias("word"))
        words = stored(held.join(near, ["pool", "given_word"]).select("pool", "raw", "word").unionByName(whole).distinct())
        return cls(given, known, words, squeezed)

    def fits(self, pairs: DataFrame) -> DataFrame:
        """(pool, raw, player_id, fit) of distinct (pool, raw, player_id): the best spelling's name_similarity, 0 to 1."""

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                fit = [name_similarity(list(g), list(f), list(s)) for g, f, s in zip(pdf["given"], pdf["firsts"], pdf["lasts"], strict=True)]
                yield pdf[["pool", "raw", "player_id"]].assign(fit=fit)

        asked = pairs.distinct().join(self.given, ["pool", "raw"]).join(self.known, ["pool", "player_id"]).select("pool", "raw", "given", "player_id", "firsts", "lasts")
        scored = asked.mapInPandas(score, "pool string, raw string, player_id string, fit double").unionByName(self.squeezed)
        return scored.groupBy("pool", "raw", "player_id").agg(F.max("fit").alias("fit"))


def pair_candidates(names: Names, records: DataFrame, targets: DataFrame, before: int, after: int) -> DataFrame:
    """(record, target, fit): records and targets whose two names each share a last name, nearly, and whose days are within reach.

    records: record, pool, a, b (raw names), day. targets: target, pool, low, high (player ids), day; a target's day lies
    at most `before` days before the record's and `after` after it. The key is (pool, both last names, time bucket): a
    last name many share, or a player in a third of all targets, is split by the other name and the time. First names,
    initials and the exact day are no gate here: fit, the product of both names' similarities in the better order, and
    the rules downstream weigh them.
    """
    width = before + after + 1
    key = lambda x, y: [F.least(x, y).alias("w1"), F.greatest(x, y).alias("w2")]
    bucket = lambda day: F.floor(day / width).cast("int")
    rec = records.withColumn("_d", F.unix_date("day"))
    for s in "ab":
        rec = rec.join(names.words.select("pool", F.col("raw").alias(s), F.col("word").alias(f"w{s}")), ["pool", s])
    rec = rec.select("record", "pool", "a", "b", "_d", *key("wa", "wb"), F.explode(F.array_distinct(F.array(bucket(F.col("_d") - before), bucket(F.col("_d") + after)))).alias("bucket")).distinct()
    last = names.known.select("pool", "player_id", F.explode("lasts").alias("word")).distinct()
    tar = targets.where("low is not null and high is not null and low <> high").withColumn("_t", F.unix_date("day")).withColumn("bucket", bucket(F.col("_t")))
    for s in ("low", "high"):
        tar = tar.join(last.select("pool", F.col("player_id").alias(s), F.col("word").alias(f"w_{s}")), ["pool", s])
    tar = tar.select("target", "pool", "low", "high", "_t", "bucket", *key("w_low", "w_high")).distinct()
    met = rec.join(tar, ["pool", "w1", "w2", "bucket"]).where(F.col("_d").between(F.col("_t") - after, F.col("_t") + before))
    met = stored(met.select("record", "target", "pool", "a", "b", "low", "high").distinct())
    ways = F.array(*[F.struct(F.lit(way).alias("way"), F.lit(s).alias("side"), F.col(s).alias("raw"), F.col(p).alias("player_id")) for way, s, p in ((0, "a", "low"), (0, "b", "high"), (1, "a", "high"), (1, "b", "low"))])
    sides = met.select("record", "target", "pool", F.explode(ways).alias("x")).select("record", "target", "pool", "x.*")
    fits = names.fits(sides.select("pool", "raw", "player_id"))
    each = sides.join(fits, ["pool", "raw", "player_id"]).groupBy("record", "target", "way").agg(F.product("fit").alias("fit"), F.count_distinct("side").alias("sides")).where("sides = 2 and fit > 0")
    return each.groupBy("record", "target").agg(F.max("fit").alias("fit"))


def _squeezed_candidates(given: DataFrame, known: DataFrame) -> DataFrame:
    """Names that are one edit or swap from a full or initialled form of an entry once spaces are gone: slips at a space hide the words.

    A name that holds the last names as they are differs in the first name, so it must be the form itself.
    """
    joined = lambda ws: F.array_join(ws, "")
    first, initial = F.get("firsts", F.lit(0)), F.substring(F.get("firsts", F.lit(0)), 1, 1)
    forms = F.array(*[F.struct(F.concat(*parts).alias("form"), F.lit(fit).alias("worth")) for parts, fit in (((joined("firsts"), joined("lasts")), 1.0), ((joined("lasts"), joined("firsts")), 1.0), ((initial, joined("lasts")), 0.92), ((joined("lasts"), initial), 0.92))])
    entries = known.where(first.isNotNull()).select("pool", "player_id", joined("lasts").alias("surname"), F.explode(forms).alias("f")).select("pool", "player_id", "surname", F.col("f.form").alias("form"), F.col("f.worth").alias("worth")).where("length(form) >= 6")
    asked = given.select("pool", "raw", joined("given").alias("squeezed")).where("length(squeezed) >= 6")
    met = asked.withColumn("key", F.explode(_deletions(F.col("squeezed")))).join(entries.withColumn("key", F.explode(_deletions(F.col("form")))).hint("merge"), ["pool", "key"])
    met = met.select("pool", "raw", "player_id", "squeezed", "form", "surname", "worth").distinct().where("squeezed = form or (levenshtein(squeezed, form) <= 2 and not contains(squeezed, surname))")
    return met.select("pool", "raw", "player_id", (F.col("worth") * (1.0 - F.levenshtein("squeezed", "form") / F.length("form")) * 0.97).alias("fit"))


#: Values that move less than this count as settled.
SETTLED = 1e-3


def solve(links: DataFrame, rho: float = 1.0, prior: float = 0.1, evidence: float = 1.0, exclusive: float = 4.0, apart: float = 1.0, together: float = 1.0, same_hours: int = 30, settled: float = SETTLED) -> DataFrame:
    """`links` with `truth` in 0..1: the soft truth that a record belongs to a target.

    links: record, target, moment (timestamp), similarity. Moments of one target count as one while no gap between
    them exceeds `same_hours`. Weighted rules, each a hinge of a linear form: a similarity speaks for its link
    (`evidence`, squared, so that there is one optimum), every link has a cost (`prior`), a record has one target
    (`exclusive`), records of one target at different moments contradict each other (`apart`), those at one moment are
    the same thing and share their target (`together`, transitivity). The sum is convex.

    A link whose record has no other and whose target has no other touches no rule but the first two; its optimum is a
    formula, similarity less prior / (2 evidence). The rest is solved by alternating directions: every rule keeps its
    own copy of the values it touches and moves them by a closed form, which needs only sums over the rule's links;
    then copies are averaged. Both steps are window sums by record and by target, so no component is ever gathered.
    Rounds go on until no copy differs from its value, and no value from the round before, by more than `settled`.
    """
    in_order = Window.partitionBy("target").orderBy("moment", "record")
    seconds = F.unix_timestamp(F.col("moment").cast("timestamp"))
    apart_now = (seconds - F.lag(seconds).over(in_order) > 3600 * same_hours).cast("int")
    by_record, by_target = Window.partitionBy("record"), Window.partitionBy("target")
    grouped = links.withColumn("similarity", F.col("similarity").cast("double")).withColumn("_new", F.coalesce(apart_now, F.lit(0))).withColumn("_moment", F.sum("_new").over(in_order)).drop("_new")
    grouped = stored(grouped.withColumn("_of_target", F.count(F.lit(1)).over(by_target)).withColumn("_of_record", F.count(F.lit(1)).over(by_record)))
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    similarity = F.col("similarity")
    alone = F.col("_of_target") + F.col("_of_record") == 2
    free = grouped.where(alone).select(*links.columns, F.round(clip(similarity - prior / (2 * evidence)), 6).alias("truth"))
    table = Rounds()
    state = grouped.where(~alone).withColumn("_share", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("target", "_moment")))
    state = state.withColumn("_shares", F.sum(F.col("_share") * F.col("_share")).over(by_target))
    state = state.withColumn("z", similarity).withColumns({f"u{k}": F.lit(0.0) for k in range(1, 5)}).withColumn("gap", F.lit(1.0))
    kept = [*links.columns, "_moment", "_of_record", "_share", "_shares"]
    state = table("state", state.select(*kept, "z", "u1", "u2", "u3", "u4", "gap"))
    while (state.agg(F.max("gap").alias("gap")).first()["gap"] or 0.0) > settled:
        for _ in range(2):  # a plan of ten rounds is large, and adaptive execution tells all of it again at every stage
            for _ in range(5):
                state = _round(state, kept, rho, prior, evidence, exclusive, apart, together)
            state = table("state", state)
            tidy(state.sparkSession)
    return free.unionByName(state.select(*links.columns, F.round("z", 6).alias("truth")))


def _round(state: DataFrame, columns: Sequence[str], rho: float, prior: float, evidence: float, exclusive: float, apart: float, together: float) -> DataFrame:
    """One round: each rule's copy x1 to x4, their average z, and the scaled differences u1 to u4. As SQL text, which is cheap to plan round by round.

    Two shuffles: rows laid out by target serve its moments too. What stays the same in every round comes with the
    state: links of a record (_of_record), one by the links of a moment (_share), the sum of its squares over a target (_shares).
    """
    kept = [f"`{c}`" for c in columns]
    by_record, by_target, by_moment = "OVER (PARTITION BY record)", "OVER (PARTITION BY target)", "OVER (PARTITION BY target, _moment)"
    v = [f"z - u{k} AS v{k}" for k in range(1, 5)]
    s = state.selectExpr(*kept, "z", "u1", "u2", "u3", "u4", *v)
    # similarity and cost: the minimum of a squared hinge, a line and a square
    under, over = f"(({rho}D * v1 + {2 * evidence}D * similarity - {prior}D) / {rho + 2 * evidence}D)", f"(v1 - {prior / rho}D)"
    x1 = f"least(greatest(CASE WHEN {under} <= similarity THEN {under} ELSE greatest({over}, similarity) END, 0D), 1D) AS x1"
    # one target per record: hinge on the sum
    s = s.selectExpr("*", x1, f"v2 - least({exclusive / rho}D, greatest((sum(v2) {by_record} - 1) / _of_record, 0D)) AS x2")
    # links of one moment: each against their mean; moments of one target: hinge on the sum of their means
    s = s.repartition("target").selectExpr("*", f"avg(v4) {by_moment} AS mean4")
    s = s.selectExpr("*", f"v3 - _share * least({apart / rho}D, greatest((sum(v3 * _share) {by_target} - 1) / _shares, 0D)) AS x3", f"mean4 + signum(v4 - mean4) * greatest(abs(v4 - mean4) - {together / rho}D, 0D) AS x4")
    s = s.selectExpr("*", "least(greatest((x1 + u1 + x2 + u2 + x3 + u3 + x4 + u4) / 4, 0D), 1D) AS z_new")
    gap = "greatest(abs(z_new - z), abs(x1 - z_new), abs(x2 - z_new), abs(x3 - z_new), abs(x4 - z_new)) AS gap"
    return s.selectExpr(*kept, "z_new AS z", *[f"u{k} + x{k} - z_new AS u{k}" for k in range(1, 5)], gap)


def best_links(solved: DataFrame, least: float = 0.5, lowest: float = 0.3) -> DataFrame:
    """The link of each record with the highest truth: of records whose truths sum to at least `least` (they have a target at all), if it is at least `lowest`; ties by similarity, then target."""
    order = [F.col("truth").desc(), F.col("similarity").desc(), F.col("target").asc()]
    held = solved.withColumn("_held", F.sum("truth").over(Window.partitionBy("record"))).where((F.col("_held") >= least) & (F.col("truth") >= lowest)).drop("_held")
    return latest_by_key(held, ["record"], order)
