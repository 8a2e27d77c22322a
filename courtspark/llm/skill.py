"""Global ranking from pairwise comparisons: Gaussian skills by approximate message passing over win outcomes."""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtspark.operators.ranks import distributed_rank
from courtspark.session import Rounds, tidy

#: Fixed values of the approximation 7.1.26 of erfc in Abramowitz and Stegun.
_P = 0.3275911
_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def _hazard(t: str) -> str:
    """pdf(t) / cdf(t) of the standard normal for the column `t`, as SQL text."""
    deep = f"(-{t})"
    for k in (8, 7, 6, 5, 4, 3, 2):
        deep = f"(-{t} + {k} / {deep})"
    k = f"(1 / (1 + {_P}D * abs({t}) / {math.sqrt(2)}D))"
    poly = reduce(lambda acc, a: f"({acc} * {k} + {a}D)", reversed(_A[:-1]), f"{_A[-1]}D")
    tail = f"(0.5D * {k} * {poly} * exp(-{t} * {t} / 2))"
    pdf = f"exp(-{t} * {t} / 2) / {math.sqrt(2 * math.pi)}D"
    return f"CASE WHEN {t} < -2.5D THEN -{t} + 1 / {deep} ELSE {pdf} / CASE WHEN {t} < 0 THEN {tail} ELSE 1 - {tail} END END"


#: Rows of beliefs (one per item and context, under 100 bytes each) up to which they are broadcast; beyond, sides are joined by shuffles, which the
#: joins name: by the size of its compressed columns the planner would broadcast a table ten times as large.
BROADCAST_ROWS = 20_000
#: Weight of the second-order step (1: none) and of a variance step in logarithms, and the plain rounds before.
MOMENTUM, SPREAD_STEP, PLAIN = 1.5, 1.5, 4


def skills(comparisons: DataFrame, winner: str, loser: str, pool: str, context: str, contexts: Sequence[str], tolerance: float = 5e-3, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(item, pool, context, mean, variance) of every item in a comparison and each of `contexts`.

    An item has one skill per context (say, a surface): a general skill plus a deviation, both Gaussian a priori with
    variances estimated per `pool` (items of different pools never meet). The winner's performance beat the loser's,
    with unit variance of their difference. Expectation propagation: every pair of items sends each side a Gaussian
    message computed from the other messages that reach it. Repeated outcomes of a pair share one message, so the work
    follows the distinct pairs, not the records.

    Rounds go on until no mean moves by more than `tolerance` (in units of the performance's deviation). Messages go
    beyond the new value by a second-order step, which needs about a third of the rounds; where means begin to move
    more again, the step is halved, so a round is plain in the end and the iteration settles.

    Nulls and self comparisons are left out. A round is one pre-aggregated sum by item and one look-up of both ends'
    beliefs: by broadcast where their counted rows are at most `broadcast_rows`, else by two joins. Each round is
    written to the shared folder, and what it left with the driver is freed before the next. A few variances per pool are all that reaches the driver.
    """
    known = comparisons.where(" and ".join(f"`{c}` is not null" for c in (winner, loser, pool, context)) + f" and `{winner}` <> `{loser}`")
    known = known.where(F.col(context).isin(*contexts))
    edges = known.groupBy(F.col(winner).alias("w"), F.col(loser).alias("l"), F.col(pool).alias("pool"), F.col(context).alias("context")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    table = Rounds()
    edges = table("edges", edges.selectExpr("*", *[f"0D AS {c}" for c in _STATE], "array(0D, 0D, 0D, 0D) AS old"))
    spread = {r["pool"]: (1.0, 0.3) for r in edges.select("pool").distinct().collect()}
    before, k, last, ahead, rows = None, 0, math.inf, MOMENTUM, None
    with ThreadPoolExecutor(2) as jobs:
        while True:
            nodes = table("nodes", _beliefs(edges, contexts, spread))
            fitted = jobs.submit(_spreads, nodes, before, spread)
            rows = fitted.result()[2] if rows is None else rows  # the same in every round
            further = jobs.submit(table, "edges", _messages(edges, nodes, 1.0 if k < PLAIN else ahead, rows <= broadcast_rows))
            (spread, moved, _), edges = fitted.result(), further.result()
            if moved <= tolerance:
                table.drop("edges")
                return nodes.select("item", "pool", "context", "mean", "variance")
            if k > 2 * PLAIN and moved > 1.5 * last:
                ahead = 1 + (ahead - 1) / 2
            before, last, k = nodes, moved, k + 1
            tidy(nodes.sparkSession)


_STATE = ("wp", "wt", "lp", "lt")


def _beliefs(edges: DataFrame, contexts: Sequence[str], spread: dict) -> DataFrame:
    """Skills given all messages: contexts of one item meet in its general skill."""
    each = range(len(contexts))
    quoted = ["'" + c.replace("\\", "\\\\").replace("'", "\\'") + "'" for c in contexts]
    ends = edges.selectExpr("pool", "context", "inline(array(struct(w AS item, n * wp AS p, n * wt AS t), struct(l AS item, n * lp AS p, n * lt AS t)))")
    sums = [F.expr(f"sum(CASE WHEN context = {quoted[i]} THEN {c} ELSE 0D END)").alias(f"{c}{i}") for i in each for c in "pt"]
    items = ends.groupBy("item", "pool").agg(*sums)
    # as maps, which generated code holds by reference: it stays the same from round to round
    general, own = [F.create_map(*[x for p, v in (spread or {"": (1.0, 1.0)}).items() for x in (F.lit(p), F.lit(v[k]))])[F.col("pool")] for k in (0, 1)]
    items = items.withColumns({"general": general, "own": own})
    items = items.selectExpr("*", *[f"p{i} / (1 + p{i} * own) AS q{i}" for i in each], *[f"t{i} / (1 + p{i} * own) AS r{i}" for i in each])
    items = items.selectExpr("*", "1 / general + " + " + ".join(f"q{i}" for i in each) + " AS base_p", " + ".join(f"r{i}" for i in each) + " AS base_t")
    cells = ", ".join(f"struct({quoted[i]} AS context, p{i} AS p, t{i} AS t, base_p - q{i} AS rest_p, base_t - r{i} AS rest_t)" for i in each)
    rows = items.selectExpr("item", "pool", "general", "own", "base_p", "base_t", f"inline(array({cells}))")
    rows = rows.selectExpr("item", "pool", "context", "general", "own", "base_p", "base_t", "p", "t", "1 / rest_p AS rest_v", "rest_t / rest_p AS rest_m", "1 / (1 / rest_p + own) AS prior_p")
    rows = rows.selectExpr("*", "rest_m * prior_p + t AS tau", "prior_p + p AS pi")
    return rows.selectExpr("*", "tau / pi AS mean", "1 / pi AS variance")


def _spreads(nodes: DataFrame, before: DataFrame | None, spread: dict) -> tuple[dict, float, int]:
    """(variances of general skill and deviation that fit the present beliefs, largest move of a mean, rows): one step of expectation maximisation."""
    general = F.pow(F.col("base_t") / F.col("base_p"), 2) + 1 / F.col("base_p")
    noise = F.when(F.col("p") > 1e-9, 1 / F.col("p") + F.col("rest_v"))
    pull = F.col("own") / (F.col("own") + noise)
    own = F.pow(pull * (F.col("t") / F.col("p") - F.col("rest_m")), 2) + pull * noise
    if before is None:
        rows = nodes.withColumn("was", F.lit(math.inf))
    else:
        rows = nodes.join(before.select("item", "pool", "context", F.col("mean").alias("was")).hint("merge"), ["item", "pool", "context"])
    found = rows.groupBy("pool").agg(F.avg(general).alias("g"), F.avg(F.when(F.col("p") > 1e-9, own)).alias("o"), F.max(F.abs(F.col("mean") - F.col("was"))).alias("moved"), F.count(F.lit(1)).alias("n")).collect()

    def on(old: float, new: float | None) -> float:
        return min(max(old * ((new or old) / old) ** (1.0 if before is None else SPREAD_STEP), 1e-3), 1e3)

    return spread | {r["pool"]: (on(spread[r["pool"]][0], r["g"]), on(spread[r["pool"]][1], r["o"])) for r in found}, max((r["moved"] for r in found), default=0.0), sum(r["n"] for r in found)


def _messages(edges: DataFrame, nodes: DataFrame, ahead: float, small: bool) -> DataFrame:
    joined = edges
    for s in "wl":
        side = nodes.selectExpr(f"item AS {s}", "pool", "context", f"pi AS {s}_pi", f"tau AS {s}_tau")
        joined = joined.join(F.broadcast(side) if small else side.hint("merge"), [s, "pool", "context"])
    ids = ["w", "l", "pool", "context", "n", *_STATE, "old"]
    joined = joined.selectExpr(*ids, *[f"1 / ({s}_pi - {s}p) AS {s}_v" for s in "wl"], *[f"({s}_tau - {s}t) / ({s}_pi - {s}p) AS {s}_m" for s in "wl"])
    joined = joined.selectExpr("*", "1 + w_v + l_v AS c2", "(w_m - l_m) / sqrt(1 + w_v + l_v) AS gap")
    joined = joined.selectExpr("*", f"{_hazard('gap')} AS hazard")
    joined = joined.selectExpr("*", *[f"1 - {s}_v / c2 * hazard * (hazard + gap) AS {s}_kept" for s in "wl"])
    fresh = {}
    for k, (s, sign) in enumerate((("w", "+"), ("l", "-"))):
        fresh[f"{s}p"] = 2 * k, f"(1 / {s}_kept - 1) / {s}_v"
        fresh[f"{s}t"] = 2 * k + 1, f"({s}_m {sign} {s}_v / sqrt(c2) * hazard) / ({s}_v * {s}_kept) - {s}_m / {s}_v"
    step = {c: f"{ahead!r}D * ({new} - old[{k}]) + old[{k}]" if ahead > 1 else new for c, (k, new) in fresh.items()}
    return joined.selectExpr("w", "l", "pool", "context", "n", *[f"greatest({x}, 1e-12D) AS {c}" if c.endswith("p") else f"{x} AS {c}" for c, x in step.items()], f"array({', '.join(_STATE)}) AS old")


def ranking(beliefs: DataFrame, caution: float = 2.0) -> DataFrame:
    """Beliefs with `lower` (mean less `caution` standard deviations) and the position by it per pool and context; ties by item."""
    scored = beliefs.withColumn("lower", F.col("mean") - caution * F.sqrt("variance"))
    return distributed_rank(scored, ["pool", "context"], [F.col("lower").desc(), F.col("item").asc()])
