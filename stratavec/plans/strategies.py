"""Allocations of every strategy under the panel's budget, and the index that one of them makes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavec.config import DEFAULT
from stratavec.operators import index
from stratavec.operators.allocate import allocate, repair_packing, segments
from stratavec.plans import codecs, panelsql
from stratavec.plans.panel import relation
from stratavec.plans.state import Panel, panel


def wide(risk: DataFrame) -> DataFrame:
    """item_id and its risks by option, from (item_id, opt, v)."""
    return risk.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("opt", "v"))), lambda s: s.v).alias("risks"))


def allocations(made: Panel, risks: DataFrame, coverage: DataFrame) -> DataFrame:
    """strategy, item_id, opt (from 1). risks: (strategy, item_id, opt, v); coverage: (item_id, n)."""
    cfg = made.cfg
    costs = [cfg.cost(n) for n in cfg.lengths]
    budget = made.items.count() * cfg.cost(cfg.target)
    cost = F.get(F.array(*(F.lit(c) for c in costs)), (F.col("opt") - 1).cast("int"))

    def solved(name: str, rows: DataFrame, limit: int) -> DataFrame:
        chosen = allocate(wide(rows), costs, limit, repair=False)
        return made.keep(chosen.select(F.lit(name).alias("strategy"), "item_id", (F.col("opt") + 1).cast("long").alias("opt")), f"allocation_{name}")

    out = [solved(name, risks.where(F.col("strategy") == name), budget) for name in panelsql.STRATEGIES]
    target = cfg.lengths.index(cfg.target) + 1
    out.append(made.items.select(F.lit("uniform").alias("strategy"), "item_id", F.lit(target).cast("long").alias("opt")))
    seen = out[0].join(coverage.where("n > 0"), "item_id").select("item_id", "opt")
    left = budget - (seen.agg(F.sum(cost)).first()[0] or 0)
    unseen = coverage.where("n = 0").select("item_id")
    for name, base in panelsql.FALLBACKS.items():
        out.append(solved(name, risks.where(F.col("strategy") == base).join(unseen, "item_id"), left))
        out.append(seen.select(F.lit(name).alias("strategy"), "item_id", "opt"))
    return reduce(DataFrame.unionByName, out)


def hull_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hull steps of every strategy's risks, steepest first within an item."""
    made = panel(spark, sf_dir)
    cfg, risks = made.cfg, relation(made, "srisk")
    costs = [cfg.cost(n) for n in cfg.lengths]
    found = [segments(wide(risks.where(F.col("strategy") == name)), costs).withColumn("strategy", F.lit(name)) for name in panelsql.STRATEGIES]
    rows = reduce(DataFrame.unionByName, found)
    return rows.select("strategy", "item_id", (F.col("from_opt") + 1).alias("from_opt"), (F.col("to_opt") + 1).alias("to_opt"), "extra", "slope")


def _lengths(made: Panel) -> DataFrame:
    length = F.get(F.array(*(F.lit(n) for n in made.cfg.lengths)), (F.col("opt") - 1).cast("int")).cast("long")
    return relation(made, "allocs").where("strategy = 'ordinal'").select("item_id", length.alias("len"))


def _index(made: Panel) -> tuple:
    path = f"{made.path}/index"
    centres = codecs.cells(made)
    made.once("index", lambda: index.save(index.build(made.items, _lengths(made), centres, made.books, made.cfg), centres, made.books, path))
    return index.load(made.spark, path)


def packed_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of the index of the calibrated allocation, as written and loaded again."""
    return index.ledger(_index(panel(spark, sf_dir))[0])


def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-phase search of the test queries over probed cells."""
    made = panel(spark, sf_dir)
    rows, centres, books = _index(made)
    queries = made.items.where("role = 'test'").select(F.col("item_id").alias("query_id"), "x")
    found = index.search(rows, centres, books, queries, made.cfg, codecs.PROBES, made.cfg.wide, made.cfg.k)
    return found.select("query_id", "rk", "item_id", "score")


def packing_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calibrated allocation after upgrades went until its grouped packing, padding included, fits the unpadded budget."""
    made = panel(spark, sf_dir)
    cfg = made.cfg
    cell = codecs.ivf_assign(spark, sf_dir).select("item_id", "cluster")
    chosen = made.keep_once(relation(made, "allocs").where("strategy = 'ordinal'").join(cell, "item_id").select("item_id", "cluster", (F.col("opt") - 1).alias("opt")), "to_repair")
    risks = made.keep_once(wide(relation(made, "srisk").where("strategy = 'ordinal'")), "ordinal_wide")
    cost = F.get(F.array(*(F.lit(cfg.cost(n) * cfg.code_bits) for n in cfg.lengths)), F.col("opt").cast("int"))
    budget = (chosen.agg(F.sum(cost)).first()[0] or 0) // 8
    fixed, before, after = repair_packing(chosen, risks, list(cfg.lengths), cfg.code_bits, budget)
    changed = fixed.withColumnRenamed("opt", "now").join(chosen, "item_id").agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.sum(F.col("opt") - F.col("now")), F.lit(0)).cast("long").alias("steps"))
    return changed.select("items", "steps", F.lit(budget).cast("long").alias("budget"), F.lit(before).cast("long").alias("before"), F.lit(after).cast("long").alias("after"))


def allocate_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calibrated allocation with what is left of the budget spent by a heap: items and risk by option, counted from 0."""
    made = panel(spark, sf_dir)
    cfg = DEFAULT
    risks = made.keep_once(wide(relation(made, "srisk").where("strategy = 'ordinal'")), "ordinal_wide")
    chosen = allocate(risks, [cfg.cost(n) for n in cfg.lengths], risks.count() * cfg.cost(cfg.target))
    risk = F.get("risks", F.col("opt").cast("int"))
    return chosen.join(risks, "item_id").groupBy(F.col("opt").cast("long").alias("opt")).agg(F.count(F.lit(1)).alias("items"), F.round(F.sum(risk), 6).alias("risk"))


def queries() -> dict:
    return {f.__name__: f for f in (hull_segments, packed_index, index_search, packing_repair, allocate_risk)}


def oracle_sql() -> dict[str, str]:
    from stratavec.plans.codecs import PROBES, _parts

    cfg = DEFAULT
    cell = _parts()["cell"]

    def text(sql: str) -> str:
        whole = panelsql.oracle("SELECT * FROM alloc")
        return whole[: whole.rindex("\n")].rstrip(",") + f",\n{cell}\n{sql}"

    score = " ".join(f"WHEN {j + 1} THEN a{j + 1}" for j in range(len(cfg.lengths)))
    return {
        "hull_segments": text("SELECT s.strategy, s.item_id, s.from_opt, s.to_opt, s.extra, s.slope FROM al_s s"),
        "packed_index": text(f"SELECT c.cluster, a.len, count(*) AS items, CAST(sum(ceil(a.len * {cfg.code_bits} / 8e0)) AS BIGINT) AS code_bytes FROM alloc a JOIN cell c USING (item_id) GROUP BY ALL"),
        "index_search": text(
            f"SELECT g.item_id AS query_id, n.rk, coalesce(b.item_id, -1) AS item_id, b.s AS score FROM gal g CROSS JOIN (SELECT unnest(range(1, {cfg.k + 1})) AS rk) n LEFT JOIN "
            f"(SELECT query_id, item_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS rk FROM (SELECT s.query_id, s.item_id, CASE a.opt {score} END AS s FROM sc s JOIN cell c USING (item_id) JOIN probed p ON p.query_id = s.query_id AND p.cluster = c.cluster JOIN alloc a USING (item_id) WHERE p.rk <= {PROBES} "
            f"QUALIFY row_number() OVER (PARTITION BY s.query_id ORDER BY s.a1 DESC, s.item_id) <= {cfg.wide}) t) b ON b.query_id = g.item_id AND b.rk = n.rk WHERE g.role = 'test'"
        ),
    }
