"""Rolling totals over trailing periods, from segment trees per entity and time shard."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAVES = 128


def daily_leaves(df: DataFrame, entity: str, day: str, measures: Sequence[str]) -> DataFrame:
    """(entity, day number, n, sum of each measure): the leaves. Pre-aggregated before the shuffle, so however many rows an entity has, it holds one leaf a day.

    Null entity or day: no leaf. A null measure adds nothing.
    """
    return (
        df.where(F.col(entity).isNotNull() & F.col(day).isNotNull())
        .groupBy(F.col(entity).alias("entity"), F.unix_date(F.col(day).cast("date")).alias("day"))
        .agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(F.col(m).cast("long")), F.lit(0)).cast("long").alias(m) for m in measures])
    )


def tree_leaves(longest: int) -> int:
    """Leaves of a shard's tree: a power of two, at least LEAVES and twice the longest period."""
    if longest < 1:
        raise ValueError("periods of 1 day or more")
    return max(LEAVES, 1 << (2 * longest - 1).bit_length())


def shard_width(longest: int) -> int:
    """Days a shard answers for: its tree also holds the `longest` - 1 days before them."""
    return tree_leaves(longest) - longest + 1


def build_trees(leaves: np.ndarray) -> np.ndarray:
    """[groups, leaves] -> heap-ordered trees [groups, 2 * leaves]; node k has the sum of 2k and 2k + 1."""
    n = leaves.shape[1]
    trees = np.zeros((leaves.shape[0], 2 * n), dtype=np.int64)
    trees[:, n:] = leaves
    size = n // 2
    while size >= 1:
        trees[:, size : 2 * size] = trees[:, 2 * size : 4 * size : 2] + trees[:, 2 * size + 1 : 4 * size : 2]
        size //= 2
    return trees


def correct(trees: np.ndarray, group: np.ndarray, leaf: np.ndarray, delta: np.ndarray) -> None:
    """Add late corrections in place, touching a leaf and its ancestors only."""
    node = leaf + trees.shape[1] // 2
    while node.size and node[0] >= 1:
        np.add.at(trees, (group, node), delta)
        node = node // 2


def canonical_nodes(first: int, last: int, leaves: int = LEAVES) -> list[int]:
    """The nodes whose leaves make up first..last, at most two a level."""
    lo, hi, out = first + leaves, last + leaves + 1, []
    while lo < hi:
        if lo & 1:
            out.append(lo)
            lo += 1
        if hi & 1:
            hi -= 1
            out.append(hi)
        lo, hi = lo // 2, hi // 2
    return out


def range_totals(trees: np.ndarray, period: int, first_answer: int) -> np.ndarray:
    """[groups, answered days]: for each day from leaf `first_answer` on the total of the `period` days that end with it."""
    leaves = trees.shape[1] // 2
    days = range(first_answer, leaves)
    out = np.empty((trees.shape[0], len(days)), dtype=np.int64)
    for k, d in enumerate(days):
        out[:, k] = trees[:, canonical_nodes(d - period + 1, d, leaves)].sum(axis=1)
    return out


def trailing_totals(
    leaves: DataFrame, measures: Sequence[str], periods: Sequence[int], keep: Callable[[dict[str, np.ndarray]], np.ndarray], corrections: DataFrame | None = None, chunk: int = 2000
) -> DataFrame:
    """For every entity and calendar day with a leaf in the longest period: totals and counts of each trailing period.

    `leaves` comes from daily_leaves; `keep` gets arrays by name (n, n_<p>, <measure>_<p>) and says which days to
    return. Returns entity, day, n and those columns. `corrections` has the columns of `leaves` and holds deltas; they
    are added to their leaves' ancestors after the trees stand.

    One shuffle by (entity, shard): each leaf goes to the shard of its day and, if within reach, to the next one, so a
    group has at most as many rows as its tree has leaves and a busy entity is spread over its shards. Averages are total / period or / n.
    """
    longest = max(periods)
    width, size = shard_width(longest), tree_leaves(longest)
    chunk = max(1, chunk * LEAVES // size)
    reach = longest - 1
    cols = ["n", *measures]
    both = leaves.withColumn("late", F.lit(0))
    if corrections is not None:
        both = both.unionByName(corrections.select(*leaves.columns).withColumn("late", F.lit(1)))
    home = F.floor(F.col("day") / width).cast("int")
    shards = F.array_distinct(F.array(home, F.floor((F.col("day") + reach) / width).cast("int")))
    laid = both.select("entity", F.explode(shards).alias("shard"), "day", "late", *[F.col(c).cast("long").alias(c) for c in cols])
    laid = laid.repartition("entity", "shard").sortWithinPartitions("entity", "shard")
    names = ["n", *[f"{c}_{p}" for p in periods for c in cols]]
    schema = f"entity {leaves.schema['entity'].dataType.simpleString()}, day int, " + ", ".join(f"{x} long" for x in names)

    def answer(pdf: pd.DataFrame, group: np.ndarray, heads: np.ndarray) -> pd.DataFrame:
        start = pdf["shard"].to_numpy()[heads].astype(np.int64) * width
        leaf = pdf["day"].to_numpy().astype(np.int64) - (start - reach)[group]
        late = pdf["late"].to_numpy() == 1
        values: dict[str, np.ndarray] = {}
        for c in cols:
            own = np.zeros((len(heads), size), dtype=np.int64)
            x = pdf[c].to_numpy().astype(np.int64)
            np.add.at(own, (group[~late], leaf[~late]), x[~late])
            trees = build_trees(own)
            correct(trees, group[late], leaf[late], x[late])
            for p in periods:
                values[f"{c}_{p}"] = range_totals(trees, p, reach)
            if c == "n":
                values["n"] = trees[:, size + reach :]
        g, k = np.nonzero((values[f"n_{longest}"] > 0) & keep(values))
        return pd.DataFrame({"entity": pdf["entity"].to_numpy()[heads[g]], "day": (start[g] + k).astype(np.int32), **{x: values[x][g, k] for x in names}})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, group, heads in whole_groups(batches, ["entity", "shard"]):
            for lo in range(0, len(heads), chunk):
                a, b = heads[lo], heads[lo + chunk] if lo + chunk < len(heads) else len(pdf)
                yield answer(pdf.iloc[a:b], group[a:b] - lo, heads[lo : lo + chunk] - a)

    return laid.mapInPandas(run, schema)


def tree_nodes(leaves: DataFrame, measures: Sequence[str], longest: int) -> DataFrame:
    """(entity, shard, node, n, sums): the trees as rows to be stored, a leaf's values added to itself and its ancestors only.

    The nodes of late corrections (leaves of deltas) are few rows of the same kind: append them to the stored ones, and
    every total that reads both is the corrected one; no other node is read or written.
    """
    size, width, reach = tree_leaves(longest), shard_width(longest), longest - 1
    home = F.floor(F.col("day") / width).cast("int")
    shards = F.array_distinct(F.array(home, F.floor((F.col("day") + reach) / width).cast("int")))
    laid = leaves.withColumn("shard", F.explode(shards))
    leaf = F.col("day") - F.col("shard") * width + reach + size
    levels = F.transform(F.sequence(F.lit(0), F.lit(size.bit_length() - 1)), lambda k: F.floor(leaf / F.pow(F.lit(2), k)).cast("int"))
    sums = [F.sum(F.col(c).cast("long")).alias(c) for c in ["n", *measures]]
    return laid.withColumn("node", F.explode(levels)).groupBy("entity", "shard", "node").agg(*sums)


def totals_of_trees(nodes: DataFrame, measures: Sequence[str], periods: Sequence[int], keep: Callable[[dict[str, np.ndarray]], np.ndarray], chunk: int = 1000) -> DataFrame:
    """What trailing_totals returns, from stored nodes (and those of corrections): range queries over the trees, nothing is built anew."""
    longest, cols = max(periods), ["n", *measures]
    size, width, reach = tree_leaves(longest), shard_width(longest), longest - 1
    chunk = max(1, chunk * LEAVES // size)
    laid = nodes.select("entity", "shard", "node", *cols).repartition("entity", "shard").sortWithinPartitions("entity", "shard")
    names = ["n", *[f"{c}_{p}" for p in periods for c in cols]]
    schema = f"entity {nodes.schema['entity'].dataType.simpleString()}, day int, " + ", ".join(f"{x} long" for x in names)

    def answer(pdf: pd.DataFrame, group: np.ndarray, heads: np.ndarray) -> pd.DataFrame:
        start = pdf["shard"].to_numpy()[heads].astype(np.int64) * width
        values: dict[str, np.ndarray] = {}
        for c in cols:
            trees = np.zeros((len(heads), 2 * size), dtype=np.int64)
            np.add.at(trees, (group, pdf["node"].to_numpy()), pdf[c].to_numpy().astype(np.int64))
            for p in periods:
                values[f"{c}_{p}"] = range_totals(trees, p, reach)
            if c == "n":
                values["n"] = trees[:, size + reach :]
        g, k = np.nonzero((values[f"n_{longest}"] > 0) & keep(values))
        return pd.DataFrame({"entity": pdf["entity"].to_numpy()[heads[g]], "day": (start[g] + k).astype(np.int32), **{x: values[x][g, k] for x in names}})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, group, heads in whole_groups(batches, ["entity", "shard"]):
            for lo in range(0, len(heads), chunk):
                a, b = heads[lo], heads[lo + chunk] if lo + chunk < len(heads) else len(pdf)
                yield answer(pdf.iloc[a:b], group[a:b] - lo, heads[lo : lo + chunk] - a)

    return laid.mapInPandas(run, schema)


def whole_groups(batches: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Batches of sorted rows recut so that no group is split; with each the group number by row and the first row by group."""
    rest: pd.DataFrame | None = None
    for batch in batches:
        pdf = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        heads = _heads(pdf, keys)
        if len(heads) == 0:
            continue
        cut = heads[-1]
        rest = pdf.iloc[cut:].reset_index(drop=True)
        if cut:
            yield _numbered(pdf.iloc[:cut], heads[:-1])
    if rest is not None and len(rest):
        yield _numbered(rest, _heads(rest, keys))


def _heads(pdf: pd.DataFrame, keys: Sequence[str]) -> np.ndarray:
    new = np.zeros(len(pdf), dtype=bool)
    if len(pdf):
        new[0] = True
        for k in keys:
            x = pdf[k].to_numpy()
            new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _numbered(pdf: pd.DataFrame, heads: np.ndarray) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    first = np.zeros(len(pdf), dtype=np.int64)
    first[heads] = 1
    return pdf, np.cumsum(first) - 1, heads
