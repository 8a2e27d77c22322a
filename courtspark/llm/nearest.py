"""Matching records by nearest time: x-fast tries over timestamp bit-prefixes, per entity and time block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtspark.operators.trailing import whole_groups


class XFastTries:
    """One x-fast trie per group over sorted offsets 0 .. 2**bits - 1; all groups share one hash table of prefixes.

    A node's key is its group and its prefix with a leading one (the heap number). Leaves form a linked list (their
    sorted order); a node knows its least and greatest leaf, which serve as its descendant pointers.
    """

    def __init__(self, group: np.ndarray, offset: np.ndarray, bits: int):
        self.bits, self.group, self.offset = bits, group, offset
        keys, leaves = [], []
        for level in range(bits + 1):
            keys.append(self.key(group, offset, np.full(len(group), level)))
            leaves.append(np.arange(len(group)))
        key, leaf = np.concatenate(keys), np.concatenate(leaves)
        order = np.argsort(key, kind="stable")
        key, leaf = key[order], leaf[order]
        first = np.ones(len(key), dtype=bool)
        first[1:] = key[1:] != key[:-1]
        heads = np.flatnonzero(first)
        self.table = pd.Index(key[heads])
        self.least = leaf[heads]
        self.greatest = leaf[np.append(heads[1:], len(key)) - 1] if len(key) else leaf

    def key(self, group: np.ndarray, offset: np.ndarray, level: np.ndarray) -> np.ndarray:
        return (group.astype(np.int64) << (self.bits + 1)) | (np.int64(1) << level) | (offset >> (self.bits - level))

    def neighbours(self, group: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf numbers of predecessor (at or before) and successor (at or after), -1 where there is none."""
        n = len(group)
        low, high = np.zeros(n, dtype=np.int64), np.full(n, self.bits, dtype=np.int64)
        node = self.table.get_indexer(self.key(group, offset, low))
        alive = node >= 0
        while (low < high).any():  # binary search on the length of the longest prefix that is there
            middle = (low + high + 1) // 2
            at = self.table.get_indexer(self.key(group, offset, middle))
            hit = (at >= 0) & (low < high)
            node = np.where(hit, at, node)
            high = np.where(hit | (low >= high), high, middle - 1)
            low = np.where(hit, middle, low)
        before, after = np.full(n, -1), np.full(n, -1)
        if not alive.any():
            return before, after
        exact = alive & (low == self.bits)
        before[exact] = after[exact] = self.least[node[exact]]
        right = alive & ~exact & (((offset >> np.maximum(self.bits - low - 1, 0)) & 1) == 1)
        left = alive & ~exact & ~right
        before[right] = self.greatest[node[right]]
        after[right] = self._linked(before[right], 1)
        after[left] = self.least[node[left]]
        before[left] = self._linked(after[left], -1)
        return before, after

    def _linked(self, leaf: np.ndarray, step: int) -> np.ndarray:
        to = leaf + step
        ok = (to >= 0) & (to < len(self.group))
        ok[ok] = self.group[to[ok]] == self.group[leaf[ok]]
        return np.where(ok, to, -1)


def nearest_ticks(left: DataFrame, right: DataFrame, tolerance: int) -> DataFrame:
    """(entity, tick) of both sides, whole numbers -> (entity, tick, nearest) of the left, rows without a partner left out.

    `nearest` is the right tick of least distance, at most `tolerance`; on equal distance the earlier one. Rows with
    nulls have no partner; repeated rows count once.

    Both sides are made distinct first (partial aggregate), so an entity has at most one row a tick however many
    records it owns. Blocks of time split busy entities; a right tick is also given to a neighbouring block within the
    tolerance, so no pair is lost at a block's edge and a trie never spans more than 2**bits ticks.
    """
    bits = max(7, int(4 * tolerance).bit_length())
    width = (1 << bits) - 2 * tolerance
    block = lambda c: F.floor(c / width).cast("long")
    known = "entity is not null and tick is not null"
    rights = right.where(known).select("entity", F.col("tick").cast("long").alias("tick")).distinct()
    near = F.array_distinct(F.array(block(F.col("tick") - tolerance), block(F.col("tick")), block(F.col("tick") + tolerance)))
    lefts = left.where(known).select("entity", F.col("tick").cast("long").alias("tick")).distinct()
    laid = rights.select("entity", F.explode(near).alias("block"), "tick", F.lit(0).cast("byte").alias("side")).unionByName(lefts.select("entity", block(F.col("tick")).alias("block"), "tick", F.lit(1).cast("byte").alias("side")))
    laid = laid.repartition("entity", "block").sortWithinPartitions("entity", "block", "side", "tick")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, group, _ in whole_groups(batches, ["entity", "block"]):
            tick = pdf["tick"].to_numpy().astype(np.int64)
            offset = tick - (pdf["block"].to_numpy().astype(np.int64) * width - tolerance)
            asks = pdf["side"].to_numpy() == 1
            tries = XFastTries(group[~asks], offset[~asks], bits)
            before, after = tries.neighbours(group[asks], offset[asks])
            at, far = offset[asks], np.int64(1) << 40
            back = np.where(before >= 0, at - tries.offset[before] if len(tries.offset) else far, far)
            ahead = np.where(after >= 0, tries.offset[after] - at if len(tries.offset) else far, far)
            gap = np.where(back <= ahead, -back, ahead)
            ok = np.minimum(back, ahead) <= tolerance
            yield pd.DataFrame({"entity": pdf["entity"].to_numpy()[asks][ok], "tick": tick[asks][ok], "nearest": (tick[asks] + gap)[ok]})

    return laid.mapInPandas(run, f"entity {left.schema['entity'].dataType.simpleString()}, tick long, nearest long")


def nearest_in_time(left: DataFrame, right: DataFrame, entity: str, left_time: Column, right_time: Column, tolerance: int, out: str = "nearest") -> DataFrame:
    """`left` with the nearest right time of its entity within `tolerance` as long column `out`; rows without one are dropped.

    Times are whole-number columns of one unit (days, seconds). Null entity or time: no partner. Every left row keeps
    its columns and multiplicity; on equal distance the earlier time is taken; an empty side gives an empty result.
    """
    found = nearest_ticks(left.select(F.col(entity).alias("entity"), left_time.alias("tick")), right.select(F.col(entity).alias("entity"), right_time.alias("tick")), tolerance)
    found = found.select(F.col("entity").alias("_ne"), F.col("tick").alias("_nt"), F.col("nearest").alias("_nn"))
    rows = left.withColumn("_tick", left_time.cast("long"))
    return rows.join(found, (rows[entity] == found["_ne"]) & (rows["_tick"] == found["_nt"])).withColumn(out, F.col("_nn")).drop("_ne", "_nt", "_nn", "_tick")
