"""Budgeted choice of one prefix option per item: multiple-choice knapsack by a Lagrangian sweep and greedy repair.

Per item, the lower convex hull of (cost, risk) gives upgrade segments of falling slope. Segments are taken in the order
of slope, then item, as long as the budget lasts. The segment at which it ends is found by summing costs in buckets of
slope, then of item id, narrowed until a bucket holds one value: no sort over all segments, and ties of any size are
split where the budget ends. What is left is less than the dearest single upgrade; a heap over the few best upgrades of
each cost class spends it.

An item whose risk no upgrade lowers stays at its cheapest option; equal risks take the cheaper option.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 512
#: Slopes are compared after rounding to so many decimals.
SLOPE_DECIMALS = 9


def hulls(risk: np.ndarray, cost: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Steps (rows, from, to, slope) along the lower convex hulls of many items at once, steepest first; risk [items, options]."""
    out, rows, at = [], np.arange(len(risk)), np.zeros(len(risk), np.int64)
    while len(rows):
        extra = cost[None] - cost[at][:, None]
        gain = risk[rows, at][:, None] - risk[rows]
        slope = np.where((extra > 0) & (gain > 0), np.round(gain / np.maximum(extra, 1), SLOPE_DECIMALS), -np.inf)
        best = slope.max(1)
        keep = best > 0
        rows, at, slope, best = rows[keep], at[keep], slope[keep], best[keep]
        to = slope.shape[1] - 1 - (slope[:, ::-1] == best[:, None]).argmax(1)
        if len(rows):
            out.append((rows, at, to, best))
        at = to
    return out


def hull(risk: np.ndarray, cost: np.ndarray) -> list[tuple[int, int, int, float]]:
    """Segments (from, to, extra cost, gain) of one item's hull, steepest first."""
    return [(int(a[0]), int(b[0]), int(cost[b[0]] - cost[a[0]]), float(risk[a[0]] - risk[b[0]])) for _, a, b, _ in hulls(np.asarray(risk, float)[None], np.asarray(cost))]


def segments(risks: DataFrame, costs: list[int]) -> DataFrame:
    """(item_id, from_opt, to_opt, extra, gain, slope) from (item_id, risks array by option); options count from 0."""
    cost = np.array(costs)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("item_id").to_numpy()
            risk = batch.column("risks").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), -1)
            for rows, at, to, slope in hulls(risk, cost):
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(at), pa.array(to), pa.array(cost[to] - cost[at], pa.int64()), pa.array(risk[rows, at] - risk[rows, to]), pa.array(slope)], ["item_id", "from_opt", "to_opt", "extra", "gain", "slope"])

    return risks.select("item_id", "risks").mapInArrow(run, "item_id long, from_opt long, to_opt long, extra long, gain double, slope double")


def boundary(rows: DataFrame, key: Column, budget: int):
    """Where the running sum of extra, by ascending key, first passes the budget: that key, and the sum before it. (None, sum) if it never does."""
    rows = rows.select(key.alias("key"), "extra")
    first = rows.agg(F.sum("extra").alias("total"), F.min("key").alias("lo"), F.max("key").alias("hi")).first()
    if (first.total or 0) <= budget:
        return None, first.total or 0
    lo, hi, spent = first.lo, first.hi, 0
    while lo < hi:
        width = (hi - lo) / BUCKETS
        bucket = F.least(F.floor((F.col("key") - F.lit(lo)) / width), F.lit(BUCKETS - 1))
        inside = rows.where((F.col("key") >= F.lit(lo)) & (F.col("key") <= F.lit(hi)))
        found = sorted(inside.groupBy(bucket.alias("b")).agg(F.sum("extra").alias("extra"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect())
        for r in found:
            if spent + r.extra > budget:
                lo, hi = r.lo, r.hi
                break
            spent += r.extra
    return lo, spent


def affordable(found: DataFrame, budget: int) -> DataFrame:
    """The segments taken: in the order of slope (steepest first), then item, while the budget lasts."""
    slope, spent = boundary(found, -F.col("slope"), budget)
    if slope is None:
        return found
    tied = found.where(F.col("slope") == F.lit(-slope))
    last, _ = boundary(tied, F.col("item_id"), budget - spent)
    return found.where((F.col("slope") > F.lit(-slope)) | ((F.col("slope") == F.lit(-slope)) & (F.col("item_id") < F.lit(last))))


def allocate(risks: DataFrame, costs: list[int], budget: int, repair: bool = True) -> DataFrame:
    """(item_id, opt): option indices from 0, of total cost at most budget. risks: (item_id, risks array by option)."""
    if costs[0] != 0 or any(b < a for a, b in zip(costs, costs[1:], strict=False)):
        raise ValueError("costs must not fall, from 0")
    spark = risks.sparkSession
    taken = affordable(segments(risks, costs), budget).groupBy("item_id").agg(F.max("to_opt").alias("opt"), F.sum("extra").alias("spent"))
    chosen = risks.select("item_id", "risks").join(taken, "item_id", "left").select("item_id", "risks", F.coalesce("opt", F.lit(0)).alias("opt"), F.coalesce("spent", F.lit(0)).alias("spent"))
    if not repair:
        return chosen.select("item_id", "opt")
    slack = budget - (chosen.agg(F.sum("spent")).first()[0] or 0)
    # With all segments taken nothing is left to buy, however large the slack; else it is less than the dearest upgrade.
    slack = min(slack, max(costs))
    moves = repairs(chosen, costs, int(slack)) if slack > 0 else {}
    extra = spark.createDataFrame(list(moves.items()) or [(None, None)], "item_id long, better long").where("item_id IS NOT NULL")
    return chosen.join(extra, "item_id", "left").select("item_id", F.coalesce("better", "opt").alias("opt"))


def packed_bytes(sizes: dict[tuple[int, int], int], lengths: list[int], bits: int) -> int:
    """Bytes of the enhancement symbols, each (cluster, option) group padded to whole bytes; sizes: items of a group."""
    return sum(-(-n * (lengths[o] - lengths[0]) * bits // 8) for (_, o), n in sizes.items())


def repair_packing(chosen: DataFrame, risks: DataFrame, lengths: list[int], bits: int, budget: int) -> tuple[DataFrame, int, int]:
    """(item_id, opt) whose grouped packing fits the budget of bytes, and the bytes before and after.

    chosen: (item_id, cluster, opt). Padding costs less than a byte a group, so few upgrades have to go: those with the least
    penalty a bit saved, one step each, in rounds, as many candidates as the excess can need.
    """
    step = F.array(*(F.lit((b - a) * bits) for a, b in zip(lengths, lengths[1:], strict=False)))
    now, before = chosen, None
    while True:
        sizes = {(r.cluster, r.opt): r.n for r in now.groupBy("cluster", "opt").agg(F.count(F.lit(1)).alias("n")).collect()}
        size = packed_bytes(sizes, lengths, bits)
        before = size if before is None else before
        if size <= budget:
            return now.select("item_id", "opt"), before, size
        rows = now.join(risks, "item_id").where("opt > 0").withColumn("saved", F.get(step, (F.col("opt") - 1).cast("int")))
        rate = (F.get("risks", (F.col("opt") - 1).cast("int")) - F.get("risks", F.col("opt").cast("int"))) / F.col("saved")
        wanted = (size - budget) * 8 // bits + 32
        best = rows.select("item_id", "cluster", "opt", rate.alias("rate")).orderBy("rate", "item_id").limit(wanted).collect()
        if not best:
            raise ValueError("the base symbols alone exceed the budget")
        gone = []
        for r in best:
            sizes[r.cluster, r.opt] -= 1
            sizes[r.cluster, r.opt - 1] = sizes.get((r.cluster, r.opt - 1), 0) + 1
            gone.append((r.item_id, 1))
            if len(gone) % 32 == 0 and packed_bytes(sizes, lengths, bits) <= budget:
                break
        less = now.sparkSession.createDataFrame(gone, "item_id long, less int")
        now = now.join(less, "item_id", "left").select("item_id", "cluster", (F.col("opt") - F.coalesce("less", F.lit(0))).alias("opt"))


def repairs(chosen: DataFrame, costs: list[int], slack: int) -> dict[int, int]:
    """Next upgrades by (gain a cost, gain, id) while affordable. At most slack / cost upgrades of a cost class can ever be
    accepted, so as many of the best of each class are brought here, with their whole risk rows; slack is below the dearest
    upgrade, so these are a few rows."""
    steps = {costs[i + 1] - costs[i] for i in range(len(costs) - 1)}
    cost = F.array(*(F.lit(c) for c in costs))
    next_ = chosen.where(F.col("opt") + 1 < len(costs)).withColumn("extra", F.get(cost, (F.col("opt") + 1).cast("int")) - F.get(cost, F.col("opt").cast("int"))).withColumn("gain", F.get("risks", F.col("opt").cast("int")) - F.get("risks", (F.col("opt") + 1).cast("int"))).where("gain > 0")
    rows = []
    for step in sorted(s for s in steps if 0 < s <= slack):
        rows += next_.where(F.col("extra") == step).orderBy(F.desc("gain"), "item_id").limit(slack // step).select("item_id", "risks", "opt").collect()
    now = {r.item_id: r.opt for r in rows}
    risk = {r.item_id: r.risks for r in rows}
    heap: list[tuple[float, float, int]] = []

    def push(item: int) -> None:
        at = now[item]
        if at + 1 < len(costs):
            extra, gain = costs[at + 1] - costs[at], risk[item][at] - risk[item][at + 1]
            if gain > 0:
                heapq.heappush(heap, (-gain / extra, -gain, item))

    for item in now:
        push(item)
    moved: dict[int, int] = {}
    while heap:
        _, _, item = heapq.heappop(heap)
        extra = costs[now[item] + 1] - costs[now[item]]
        if extra <= slack:
            slack -= extra
            now[item] += 1
            moved[item] = now[item]
            push(item)
    return moved


def exact_small(risks: list[list[float]], costs: list[int], budget: int) -> float:
    """Least total risk by dynamic programming; for tests on a few items."""
    best = {0: 0.0}
    for row in risks:
        after: dict[int, float] = {}
        for spent, total in best.items():
            for r, c in zip(row, costs, strict=True):
                if spent + c <= budget and total + r < after.get(spent + c, np.inf):
                    after[spent + c] = total + r
        best = after
    return min(best.values())
