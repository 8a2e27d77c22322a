"""Names to entities: aliases, exact and fuzzy lookup, review loop, duplicate detection and repointing."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtspark.functions.normalize import name_key
from courtspark.operators.keyed import latest_by_key, top_n_by_key
from courtspark.session import cut

AUTO, REVIEW, GAP = 0.85, 0.75, 0.05


def alias_forms(roster: DataFrame) -> DataFrame:
    """(alias, tour, player_id): 'First Last', 'Last First' and 'Last F.' of every named entry, from one scan; placeholders have none."""
    first, last = F.trim("name_first"), F.trim("name_last")
    named = roster.where(first.isNotNull() & last.isNotNull() & (first != "") & (last != "") & (F.lower(first) != "unknown") & (F.lower(last) != "unknown"))
    forms = F.array(F.concat_ws(" ", first, last), F.concat_ws(" ", last, first), F.concat(last, F.lit(" "), F.substring(first, 1, 1), F.lit(".")))
    return named.select(F.explode(forms).alias("alias"), "tour", "player_id").distinct()


def alias_index(aliases: DataFrame, weight: DataFrame | None = None) -> DataFrame:
    """(tour, alias_key, player_id, namesakes): one entity per normalised alias, the one with most matches, then the smallest id."""
    keyed = aliases.withColumn("alias_key", name_key(F.col("alias"))).where("alias_key <> ''").select("tour", "alias_key", "player_id").distinct()
    if weight is not None:
        keyed = keyed.join(weight, "player_id", "left")
    else:
        keyed = keyed.withColumn("n_matches", F.lit(0))
    sakes = keyed.groupBy("tour", "alias_key").agg(F.count(F.lit(1)).alias("namesakes"))
    return latest_by_key(keyed, ["tour", "alias_key"], [F.coalesce("n_matches", F.lit(0)).desc(), F.col("player_id").asc()]).drop("n_matches").join(sakes, ["tour", "alias_key"])


def similarity(x: str, y: str) -> float:
    """0 to 1: best of the plain and the word-sorted match ratio."""
    plain = SequenceMatcher(None, x, y).ratio()
    return max(plain, 0.95 * SequenceMatcher(None, _sorted(x), _sorted(y)).ratio())


def _sorted(key: str) -> str:
    return " ".join(sorted(key.split()))


class Bounds:
    """What `similarity` of a text with each of `keys` can be at most, for all of them at once.

    Matched blocks are a common subsequence, so their letters are at most the longest one's: bits of one word per key,
    a step per letter (Hyyro). Before it, letters in common, in any order, rule most keys out.
    """

    def __init__(self, keys: Sequence[str]) -> None:
        self.size = np.array([len(k) for k in keys], dtype=np.int64)
        self.letters = {c: i for i, c in enumerate(sorted(set("".join(keys))), 1)}
        self.plain, self.sorted = (self._codes(ks) for ks in (keys, [_sorted(k) for k in keys]))
        self.counts = np.stack([self._count(k) for k in keys])

    def _codes(self, keys: Sequence[str]) -> np.ndarray:
        out = np.zeros((max(map(len, keys)), len(keys)), dtype=np.int32)
        for j, k in enumerate(keys):
            out[: len(k), j] = [self.letters[c] for c in k]
        return out

    @staticmethod
    def _count(key: str) -> np.ndarray:
        return np.bincount([ord(c) % 32 for c in key], minlength=32).astype(np.int16)

    def _common(self, text: str, codes: np.ndarray) -> np.ndarray:
        masks = np.zeros(len(self.letters) + 1, dtype=np.uint64)
        for i, c in enumerate(text):
            if c in self.letters:
                masks[self.letters[c]] |= np.uint64(1 << i)
        rest = np.full(codes.shape[1], (1 << 64) - 1, dtype=np.uint64)
        for row in codes:
            hit = rest & masks[row]
            rest = (rest + hit) | (rest - hit)
        return len(text) - np.bitwise_count(rest & np.uint64((1 << len(text)) - 1)).astype(np.int64)

    def of(self, text: str, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(positions, bounds) of the keys whose bound is `least` or more."""
        total = self.size + len(text)
        at = np.flatnonzero(2 * np.minimum(self.counts, self._count(text)).sum(axis=1) >= (least - 1e-6) * total)
        if len(text) > 63 or not len(at):  # longer than a word of bits
            return at, np.ones(len(at))
        plain, mixed = self._common(text, self.plain[:, at]), self._common(_sorted(text), self.sorted[:, at])
        most = np.maximum(2 * plain, 0.95 * 2 * mixed) / total[at]
        kept = most >= least - 1e-6
        return at[kept], most[kept]


def _two_best(text: str, bounds: Bounds, keys: Sequence[str], ids: Sequence[str], least: float) -> list[tuple[str, float]]:
    """The two entities with the highest score of at least `least`, ties by id: keys are scored by falling bound until none left can get in."""
    at, most = bounds.of(text, least)
    best: dict[str, float] = {}
    for k in np.argsort(-most, kind="stable"):
        top = sorted(best.items(), key=lambda e: (-e[1], e[0]))[:2]
        if len(top) == 2 and most[k] < top[1][1] - 1e-6:
            break
        score = round(similarity(text, keys[at[k]]), 6)
        if score >= least:
            best = dict(top) | {ids[at[k]]: max(score, best.get(ids[at[k]], 0.0))}
    return sorted(best.items(), key=lambda e: (-e[1], e[0]))[:2]


#: Names and aliases of one block that meet in a task at once; larger blocks are held against each other in parts.
BLOCK = 4000


def _best_of_blocks(asked: DataFrame, index: DataFrame, least: float, block: int) -> DataFrame:
    """(tour, key, player_id, score): the two best entities of every key in every block (tour, head), so among them its two best of all.

    A block's keys and aliases are dealt into parts of about `block` rows by hash; each pair of parts is a group.
    """
    sides = {"q": asked.select("tour", "head", "key"), "a": index.select("tour", "head", "alias_key", "player_id")}
    parts = {s: df.groupBy("tour", "head").agg(F.ceil(F.count(F.lit(1)) / block).alias(f"n_{s}")) for s, df in sides.items()}
    parts = parts["q"].join(parts["a"], ["tour", "head"])
    dealt = {}
    for s, other, text in (("q", "a", "key"), ("a", "q", "alias_key")):
        one = sides[s].join(parts, ["tour", "head"]).withColumn(f"_{s}", F.pmod(F.xxhash64(text), F.col(f"n_{s}")))
        dealt[s] = one.withColumn(f"_{other}", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"n_{other}") - 1)))
    on = ["tour", "head", "_q", "_a"]

    def meet(q: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(q) and len(a):
            keys, ids = a["alias_key"].tolist(), a["player_id"].tolist()
            bounds, tour = Bounds(keys), q["tour"].iloc[0]
            for text in q["key"]:
                rows += [(tour, text, i, score) for i, score in _two_best(text, bounds, keys, ids, least)]
        return pd.DataFrame(rows, columns=["tour", "key", "player_id", "score"])

    return dealt["q"].select(*on, "key").groupBy(*on).cogroup(dealt["a"].select(*on, "alias_key", "player_id").groupBy(*on)).applyInPandas(meet, "tour string, key string, player_id string, score double")


def fuzzy_lookup(names: DataFrame, index: DataFrame, block: int = BLOCK) -> DataFrame:
    """(tour, raw, player_id, confidence, status, runner_up) for distinct raw names: exact key first, the rest by similarity.

    Candidates share a word, or the word's first three letters, so a name is never held against the whole index;
    of those only the ones whose score can be among the two best are scored. The best alias counts per entity; an entity within GAP of the best makes the case one for review.
    """
    asked = names.select("tour", "raw").where("tour is not null and raw is not null").distinct().withColumn("key", name_key(F.col("raw")))
    exact = asked.join(index, (asked["tour"] == index["tour"]) & (asked["key"] == index["alias_key"]), "left").select(asked["tour"], "raw", "key", "player_id", "namesakes")
    done = exact.where("player_id is not null").select("tour", "raw", "player_id", F.lit(1.0).alias("confidence"), F.when(F.col("namesakes") > 1, "review").otherwise("auto").alias("status"), F.lit(0.0).alias("runner_up"))
    rest = exact.where("player_id is null").select("tour", "raw", "key")
    heads = lambda c: F.explode(F.array_distinct(F.transform(F.filter(F.split(c, " "), lambda w: F.length(w) >= 3), lambda w: F.substring(w, 1, 3))))
    blocks = _best_of_blocks(rest.select("tour", "key").distinct().withColumn("head", heads(F.col("key"))), index.select("tour", "alias_key", "player_id").distinct().withColumn("head", heads(F.col("alias_key"))), REVIEW - GAP, block)
    scored = blocks.groupBy("tour", "key", "player_id").agg(F.max("score").alias("score"))
    best = rest.join(scored, ["tour", "key"]).select("tour", "raw", "player_id", "score")
    two = top_n_by_key(best, ["tour", "raw"], [F.col("score").desc(), F.col("player_id").asc()], 2)
    pick = lambda c, k: F.max(F.when(F.col("rank_in_group") == k, F.col(c)))
    ranked = two.groupBy("tour", "raw").agg(pick("player_id", 1).alias("best_id"), pick("score", 1).alias("confidence"), F.coalesce(pick("score", 2), F.lit(0.0)).alias("runner_up"))
    unclear = (F.col("confidence") >= AUTO) & (F.col("runner_up") >= AUTO - GAP) & (F.col("confidence") - F.col("runner_up") < GAP)
    status = F.when((F.col("confidence") >= AUTO) & ~unclear, "auto").when((F.col("confidence") >= REVIEW) | unclear, "review").otherwise("unknown")
    found = rest.select("tour", "raw").join(ranked, ["tour", "raw"], "left").withColumn("status", F.coalesce(status, F.lit("unknown")))
    found = found.select("tour", "raw", F.when(F.col("status") != "unknown", F.col("best_id")).alias("player_id"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "status", F.coalesce("runner_up", F.lit(0.0)).alias("runner_up"))
    return done.unionByName(found)


def duplicate_groups(roster: DataFrame, keys: Sequence[str], counts: DataFrame) -> DataFrame:
    """Rows of every group of two or more ids that agree null-safely on `keys`, with their match counts."""
    groups = roster.groupBy(*[F.col(k).alias(f"_g_{k}") for k in keys]).agg(F.count_distinct("player_id").alias("n_ids")).where("n_ids > 1")
    cond: Column = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_g_{k}"))
    members = roster.join(groups, cond).select(*roster.columns, "n_ids")
    return members.join(counts, "player_id", "left").withColumn("n_matches", F.coalesce("n_matches", F.lit(0)))


def repoint(df: DataFrame, columns: Sequence[str], mapping: DataFrame) -> DataFrame:
    """`df` with stale ids replaced by canonical ones; mapping (stale, canonical) has chains closed already."""
    for c in columns:
        m = mapping.select(F.col("stale").alias(f"_s_{c}"), F.col("canonical").alias(f"_c_{c}"))
        df = df.join(m, df[c] == m[f"_s_{c}"], "left").withColumn(c, F.coalesce(f"_c_{c}", c)).drop(f"_s_{c}", f"_c_{c}")
    return df


def close_chains(mapping: DataFrame) -> DataFrame:
    """(stale, canonical) followed to the end by pointer doubling, so a chain of n links takes about log2(n) rounds.

    Of several targets the least counts. Every target must be less than its source (orient pairs that way), so there
    are no cycles; other rows are left out.
    """
    m = cut(mapping.where("stale is not null and canonical is not null and canonical < stale").groupBy("stale").agg(F.min("canonical").alias("canonical")))
    while True:
        step = m.select(F.col("stale").alias("canonical"), F.col("canonical").alias("next"))
        joined = cut(m.join(step, "canonical", "left"))
        if joined.where("next is not null").isEmpty():
            return m
        m = joined.select("stale", F.coalesce("next", "canonical").alias("canonical"))
