"""Registration of the panel's queries: Spark callables and oracle texts by name."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavec.plans import panelsql
from stratavec.plans.state import Panel, panel
from stratavec.sources.tables import numbered, ranked

#: Relations that are written once a panel, in order; a query starts from those it needs.
KEPT = ("ot", "cov", "risk", "srisk", "allocs", "rgain", "rnk")


def _made(made: Panel, name: str, kept: set[str]) -> DataFrame:
    if name == "allocs":
        from stratavec.plans.strategies import allocations

        return allocations(made, made.spark.table("srisk"), made.spark.table("cov"))
    if name == "rgain":
        gains = made.spark.sql(panelsql.composed("SELECT item_id, round(gain, 12) AS gain FROM tot", base=kept))
        return numbered(gains, [F.col("gain"), F.col("item_id")], "i", made.keep)
    if name == "rnk":
        return ranked(made.items.select("item_id"), made.cfg.seed, "rk")
    if name == "srisk":
        from stratavec.plans.codecs import query_ip_table

        query_ip_table(made).createOrReplaceTempView("qip")
    return made.spark.sql(panelsql.composed(f"SELECT * FROM {name}", base=kept - {name}))


def prepared(made: Panel, sql: str) -> set[str]:
    """Views of the written relations that a text needs; their names."""
    made.views()
    parts = panelsql.fragments() | {"allocs": "SELECT * FROM srisk JOIN cov ON true"}
    wanted, kept = panelsql.needs(sql, parts, set()), set()
    for name in KEPT:
        if name in wanted:
            made.kept(name, partial(_made, made, name, set(kept))).createOrReplaceTempView(name)
            kept.add(name)
    return kept


def relation(made: Panel, name: str) -> DataFrame:
    """One of the written relations."""
    prepared(made, f"SELECT * FROM {name}")
    return made.spark.table(name)


def run_sql(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the panel's SQL queries on Spark."""
    made, sql = panel(spark, sf_dir), panelsql.queries()[name]
    return spark.sql(panelsql.composed(sql, base=prepared(made, sql)))


def queries() -> dict:
    return {name: partial(run_sql, name=name) for name in panelsql.queries()}


def oracle_sql() -> dict[str, str]:
    return {name: panelsql.oracle(sql) for name, sql in panelsql.queries().items()}
