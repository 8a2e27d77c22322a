"""Consolidating pairwise matches into groups: connected components by low-diameter decomposition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtspark.session import cut


def component_groups(pairs: DataFrame, left: str, right: str, beta: float = 0.2, growth: int = 3, seed: int = 7) -> DataFrame:
    """(node, group): every id in a pair of two different ids, with the least id of all that it is linked to, directly or not.

    Pairs with a null, self pairs, repeats and either direction are allowed for; no pairs give no rows.

    Each round draws a shift from an exponential distribution (rate `beta`) for every vertex, by a hash so that a
    repeated task draws the same, and lets clusters grow for `growth` steps: a vertex joins the centre with the
    greatest shift less distance. Clusters are contracted to super-vertices and the next round works on the edges
    between them, until there are none; a round cuts only a fraction of the edges, so their number falls
    geometrically. Cutting the growth short only leaves more edges for the next round: a vertex never joins a centre
    outside its component. The rounds' assignments are then composed. Edges and assignments stay distributed, each
    round ends in a reliable checkpoint, and only the number of edges left comes to the driver.
    """
    a, b = F.col(left), F.col(right)
    edges = cut(pairs.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct())
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        ways = edges.select(F.explode(F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst")))).alias("e")).select("e.*")
        uniform = (F.abs(F.xxhash64("node", F.lit(seed + len(rounds))) % F.lit(1 << 30)) + 1) / float((1 << 30) + 1)
        state = ways.select(F.col("src").alias("node")).distinct().select("node", F.struct((-F.log(uniform) / beta).alias("shift"), F.col("node").alias("centre")).alias("best"))
        for _ in range(growth):
            offers = ways.join(state, ways["src"] == state["node"]).select(F.col("dst").alias("node"), F.struct((F.col("best.shift") - 1).alias("shift"), F.col("best.centre").alias("centre")).alias("best"))
            state = state.unionByName(offers).groupBy("node").agg(F.max("best").alias("best"))
        assigned = cut(state.select("node", F.col("best.centre").alias("centre")))
        rounds.append(assigned)
        at_u = assigned.select(F.col("node").alias("u"), F.col("centre").alias("cu"))
        at_v = assigned.select(F.col("node").alias("v"), F.col("centre").alias("cv"))
        edges = cut(edges.join(at_u, "u").join(at_v, "v").where("cu <> cv").select(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v")).distinct())
    if not rounds:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("group"))
    labels = rounds[0]
    for later in rounds[1:]:
        step = later.select(F.col("node").alias("centre"), F.col("centre").alias("next"))
        labels = labels.join(step, "centre", "left").select("node", F.coalesce("next", "centre").alias("centre"))
    least = labels.groupBy("centre").agg(F.min("node").alias("group"))
    return labels.join(least, "centre").select("node", "group")
