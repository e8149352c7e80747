"""Queries of the codec operators: clustering, product codes, lookup-table scores, distortions; with their DuckDB oracles.

The Spark side fits codebooks on the bounded sample and works in Arrow kernels; the oracle does the same in DuckDB's list
functions from the raw table, in another form where there is one (losses as means over queries instead of quadratic
forms, norms from decoded vectors instead of Gram tables, scores from decoded vectors instead of lookup tables).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavec.config import DEFAULT
from stratavec.functions import dot
from stratavec.operators import cluster, codec, losses
from stratavec.operators.score import leaders, merged_topk, topk
from stratavec.plans.state import Panel, panel
from stratavec.sources.tables import gallery

#: Coarse cells, and how many of them a query probes.
CELLS = 8
PROBES = 2
#: Centres and steps of the k-means queries.
CENTRES = 16
STEPS = 3
_SEEDS = {"kmeans": 101, "cells": 202}


def _sent(made: Panel, value):
    return made.spark.sparkContext.broadcast(value)


def kernel(rows: DataFrame, columns: list[str], schema: str, work: Callable[[dict[str, pa.Array]], list[np.ndarray]]) -> DataFrame:
    """work maps the columns of a batch that has rows to the output columns of schema."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in work({c: batch.column(c) for c in columns})], names)

    return rows.select(*columns).mapInArrow(run, schema)


def _sample(made: Panel, role: str) -> np.ndarray:
    """Vectors of a role, in seeded order: the codec sample of the pool, or a query role, which is bounded by its count."""
    return codec.training_rows(made.items.where(F.col("role") == role), made.cfg)


def product_books(made: Panel) -> np.ndarray:
    return made.once("pq", lambda: codec.train_pq(_sample(made, "pool"), made.cfg.stages, made.cfg.codes) if made.dim else np.zeros((made.cfg.stages, 1, 0)))


def cells(made: Panel) -> np.ndarray:
    """Directions of the coarse cells: one spherical step from the first rows in seeded order."""
    return made.once("cells", lambda: cluster.spherical_step(made.items, cluster.first_rows(made.items, _SEEDS["cells"], CELLS)))


def _long(codes: np.ndarray, ids: pa.Array) -> list[np.ndarray]:
    """item_id, part and code of a code matrix."""
    n, parts = codes.shape
    return [np.repeat(ids.to_numpy(), parts), np.tile(np.arange(parts), n), codes.ravel().astype(np.int64)]


def _dims(values: np.ndarray, ids: pa.Array) -> list[np.ndarray]:
    n, dim = values.shape
    return [np.repeat(ids.to_numpy(), dim), np.tile(np.arange(dim), n), np.round(values.ravel(), 9) + 0.0]


def _table(spark: SparkSession, centres: np.ndarray, decimals: int = 9) -> DataFrame:
    """code, dim and v of some centres; bounded by their number."""
    rows = [(int(i), int(j), float(np.round(v, decimals) + 0.0)) for i, c in enumerate(centres) for j, v in enumerate(c)]
    return spark.createDataFrame(rows, "code long, dim long, v double")


def subvectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared length, first and last coordinate of every block of every vector."""
    parts = DEFAULT.stages
    width = (F.size("x") / parts).cast("int")
    block = F.expr("slice(x, part * w + 1, w)")
    rows = gallery(spark, sf_dir).withColumn("w", width).select("item_id", "x", "w", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")).withColumn("s", block)
    return rows.select("item_id", F.col("part").cast("long").alias("part"), F.round(dot("s", "s"), 6).alias("norm2"), F.round(F.element_at("s", 1), 6).alias("first"), F.round(F.element_at("s", -1), 6).alias("last"))


def kmeans_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres after one step from the first rows in seeded order."""
    rows = gallery(spark, sf_dir)
    return _table(spark, cluster.kmeans_step(rows, cluster.first_rows(rows, _SEEDS["kmeans"], CENTRES)))


def kmeans_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every cell after some steps, and the squared error of all."""
    rows = gallery(spark, sf_dir)
    _, count, error = cluster.kmeans_fit(rows, cluster.first_rows(rows, _SEEDS["kmeans"], CENTRES), STEPS)
    return spark.createDataFrame([(i, int(n), round(error, 5)) for i, n in enumerate(count)], "code long, items long, error double")


def spherical_kmeans_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, cells(panel(spark, sf_dir)))


def nearest_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest codeword of the first stage, and its squared distance."""
    made = panel(spark, sf_dir)
    book = _sent(made, made.books[0])

    def work(c):
        d = codec.distances(codec.matrix(c["x"]), book.value)
        return [c["item_id"], d.argmin(1), d.min(1)]

    return kernel(made.items, ["item_id", "x"], "item_id long, code long, distance double", work)


def ivf_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell with the largest inner product, and the length of the residual."""
    made = panel(spark, sf_dir)
    sent = _sent(made, cells(made))

    def work(c):
        x = codec.matrix(c["x"])
        code = cluster.affine(x, sent.value)
        return [c["item_id"], code, np.round(np.sqrt(((x - sent.value[code]) ** 2).sum(1)), 6)]

    return kernel(made.items, ["item_id", "x"], "item_id long, cluster long, residual double", work)


def probed(made: Panel, queries: DataFrame, probes: int = PROBES) -> DataFrame:
    """query_id, rk, cluster: the cells that a query (query_id, x) looks at, best first."""
    sent = _sent(made, cells(made))

    def work(c):
        score = np.round(codec.matrix(c["x"]) @ sent.value.T, codec.DECIMALS)
        order = np.argsort(-score, axis=1, kind="stable")[:, :probes]
        return [np.repeat(c["query_id"].to_numpy(), order.shape[1]), np.tile(np.arange(1, order.shape[1] + 1), len(order)), order.ravel()]

    return kernel(queries, ["query_id", "x"], "query_id long, rk long, cluster long", work)


def ivf_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells nearest to every test query, and how many items each holds."""
    made = panel(spark, sf_dir)
    sizes = ivf_assign(spark, sf_dir).groupBy("cluster").agg(F.count(F.lit(1)).alias("items"))
    found = probed(made, made.items.where("role = 'test'").select(F.col("item_id").alias("query_id"), "x"))
    return found.join(F.broadcast(sizes), "cluster", "left").select("query_id", "rk", "cluster", F.coalesce("items", F.lit(0)).alias("items"))


def pq_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = panel(spark, sf_dir)
    sent = _sent(made, product_books(made))
    return kernel(made.items, ["item_id", "x"], "item_id long, part long, code long", lambda c: _long(codec.encode_pq(codec.matrix(c["x"]), sent.value), c["item_id"]))


def pq_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = panel(spark, sf_dir)
    sent = _sent(made, product_books(made))

    def work(c):
        return _dims(codec.decode_pq(codec.encode_pq(codec.matrix(c["x"]), sent.value), sent.value), c["item_id"])

    return kernel(made.items, ["item_id", "x"], "item_id long, dim long, v double", work)


def decode_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reconstruction from the codes of the target length."""
    made = panel(spark, sf_dir)
    sent, target = _sent(made, made.books), made.cfg.target
    return kernel(made.items, ["item_id", "codes"], "item_id long, dim long, v double", lambda c: _dims(codec.prefixes(codec.matrix(c["codes"]).astype(np.int64), sent.value, (target,))[:, 0], c["item_id"]))


def codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The additive codec's tensor as rows."""
    made = panel(spark, sf_dir)
    return made.codebook().select("stage", "code", F.posexplode("c").alias("dim", "v")).select("stage", "code", F.col("dim").cast("long").alias("dim"), F.round("v", 9).alias("v"))


def prefix_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose codes under a codec of fewer stages are not the first codes of the whole one: none."""
    made = panel(spark, sf_dir)
    short = _sent(made, made.books[:2])

    def work(c):
        codes = codec.encode_rq(codec.matrix(c["x"]), short.value)
        return [np.array([len(codes)]), np.array([int((codes != codec.matrix(c["codes"])[:, :2]).any(1).sum())])]

    return kernel(made.items, ["x", "codes"], "items long, broken long", work).agg(F.coalesce(F.sum("items"), F.lit(0)).alias("items"), F.coalesce(F.sum("broken"), F.lit(0)).alias("broken"))


def gram_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared lengths of full reconstructions, from the codewords' inner products and the codes alone."""
    made = panel(spark, sf_dir)
    gram = _sent(made, np.einsum("skd,tjd->stkj", made.books, made.books))

    def work(c):
        codes = codec.matrix(c["codes"]).astype(np.int64)
        stages = range(codes.shape[1])
        return [c["item_id"], np.round(sum(gram.value[s, t][codes[:, s], codes[:, t]] for s in stages for t in stages), 6)]

    return kernel(made.items, ["item_id", "codes"], "item_id long, norm2 double", work)


def adc_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every item the test query that scores it highest, by lookup tables over codes; items are never decoded."""
    made = panel(spark, sf_dir)
    asked = made.items.where("role = 'test'").select("item_id", "x").orderBy("item_id").toArrow()
    names = asked.column("item_id").to_numpy()
    q = codec.matrix(asked.column("x").combine_chunks())
    gram = np.einsum("skd,tjd->stkj", made.books, made.books)
    sent = _sent(made, (names, np.einsum("qd,skd->qsk", q, made.books) if len(names) else None, gram))

    def work(c):
        who, tables, g = sent.value
        ids, codes = c["item_id"].to_numpy(), codec.matrix(c["codes"]).astype(np.int64)
        if not len(who):
            return [np.empty(0, np.int64)] * 2 + [np.empty(0)]
        stages = range(codes.shape[1])
        norm = np.sqrt(np.maximum(sum(g[s, t][codes[:, s], codes[:, t]] for s in stages for t in stages), 0))
        score = np.round(sum(tables[:, s][:, codes[:, s]] for s in stages) / np.maximum(norm, 1e-12), codec.DECIMALS)
        score[who[:, None] == ids] = -np.inf
        best = score.argmax(0)
        keep = np.isfinite(score.max(0))
        return [ids[keep], who[best][keep], score.max(0)[keep]]

    return kernel(made.items, ["item_id", "codes"], "item_id long, query_id long, score double", work)


def covariances(made: Panel) -> np.ndarray:
    """[parts, width, width]: the calibration queries' second moments by block."""
    whole = made.once("moment", lambda: cluster.second_moment(made.items.where("role = 'calibration'")))
    parts = made.cfg.stages
    if not whole.size:
        return np.zeros((parts, made.dim // parts, made.dim // parts))
    width = len(whole) // parts
    return np.stack([whole[m * width : (m + 1) * width, m * width : (m + 1) * width] for m in range(parts)])


def mahalanobis_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes under the query covariance of every block."""
    made = panel(spark, sf_dir)
    sent = _sent(made, (product_books(made), covariances(made)))
    return kernel(made.items, ["item_id", "x"], "item_id long, part long, code long", lambda c: _long(codec.assign_mahalanobis(codec.matrix(c["x"]), *sent.value), c["item_id"]))


def _loss(made: Panel, names: list[str], work: Callable[[np.ndarray, np.ndarray], list[np.ndarray]]) -> DataFrame:
    """item_id, opt and losses of every prefix option; work maps vectors and reconstructions to [rows, options] each."""
    books, lengths = _sent(made, made.books), made.cfg.lengths

    def run(c):
        x = codec.matrix(c["x"])
        found = work(x, codec.prefixes(codec.matrix(c["codes"]).astype(np.int64), books.value, lengths))
        return [np.repeat(c["item_id"].to_numpy(), len(lengths)), np.tile(np.arange(1, len(lengths) + 1), len(x)), *(v.ravel() for v in found)]

    return kernel(made.items, ["item_id", "x", "codes"], "item_id long, opt long, " + ", ".join(f"{n} double" for n in names), run)


def query_ip_table(made: Panel) -> DataFrame:
    """item_id, opt, v: mean squared error of calibration queries' inner products, unrounded."""
    whole = made.once("moment", lambda: cluster.second_moment(made.items.where("role = 'calibration'")))
    moment = _sent(made, whole if whole.size else np.zeros((made.dim, made.dim)))
    return _loss(made, ["v"], lambda x, y: [losses.query_ip(x, y, moment.value)])


def query_ip_distortion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_ip_table(panel(spark, sf_dir)).select("item_id", "opt", F.round("v", 6).alias("v"))


def block_cov_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = panel(spark, sf_dir)
    moments = _sent(made, covariances(made))
    return _loss(made, ["raw", "cosine"], lambda x, y: [np.round(losses.block_covariance(x, y, moments.value, c), 6) for c in (False, True)])


def softmax_query_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calibration queries, bounded in number by their role, are sent to every task."""
    made = panel(spark, sf_dir)
    queries = _sent(made, codec.matrix(made.items.where("role = 'calibration'").select("x").toArrow().column("x").combine_chunks()))
    if not len(queries.value):
        return spark.createDataFrame([], "item_id long, opt long, raw double, cosine double")
    return _loss(made, ["raw", "cosine"], lambda x, y: [np.round(losses.softmax_query(x, y, queries.value, c), 6) for c in (False, True)])


def subspace_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of the product codec by the mean share of squared length that their reconstruction accounts for, over the pool."""
    made = panel(spark, sf_dir)
    sent, parts = _sent(made, product_books(made)), made.cfg.stages

    def work(c):
        x = codec.matrix(c["x"])
        gain = losses.subspace_gain(x, codec.decode_pq(codec.encode_pq(x, sent.value), sent.value), parts)
        return [np.arange(parts), gain.sum(0), np.full(parts, len(x))]

    sums = kernel(made.items.where("role = 'pool'"), ["x"], "part long, gain double, n long", work).groupBy("part").agg((F.sum("gain") / F.sum("n")).alias("gain"))
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.orderBy(F.desc(F.round("gain", 9)), "part")) - 1
    return sums.select("part", F.round("gain", 6).alias("gain"), place.cast("long").alias("place"))


def chunked_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact neighbours of the validation queries, merged from the leaders of small chunks."""
    made = panel(spark, sf_dir)
    queries = made.items.where("role = 'validation'").select(F.col("item_id").alias("query_id"), F.col("x").alias("q"), F.col("item_id").alias("exclude_id"))
    return merged_topk(made.items, queries, made.cfg.k, chunk=128)


def float_precision_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every validation query's neighbours in double precision, how many single precision finds, and whether the first agrees."""
    made = panel(spark, sf_dir)
    asked = made.items.where("role = 'validation'").select(F.col("item_id").alias("query_id"), F.col("x").alias("q"), F.col("item_id").alias("exclude_id"))
    double, single = (topk(made.items, asked, made.cfg.k, kind=k) for k in ("f8", "f4"))
    both = double.select("query_id", "item_id", F.col("rnk").alias("a")).join(single.select("query_id", "item_id", F.col("rnk").alias("b")), ["query_id", "item_id"], "left")
    return both.groupBy("query_id").agg(F.count("b").alias("shared"), F.max(F.when((F.col("a") == 1) & (F.col("b") == 1), 1).otherwise(0)).cast("long").alias("first"))


def paired_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the same pairs by Arrow kernels and by column functions: pairs, and the differences."""
    made = panel(spark, sf_dir)
    asked = made.items.where("role = 'validation'").select(F.col("item_id").alias("query_id"), F.col("x").alias("q"), F.col("item_id").alias("exclude_id"))
    pairs = topk(made.items, asked, made.cfg.k).join(asked.select("query_id", "q"), "query_id").join(made.items.select("item_id", "x"), "item_id")
    gap = F.abs(F.col("score") - dot("q", "x"))
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), F.coalesce(F.round(F.avg(gap), 7), F.lit(0.0)).alias("mean"), F.coalesce(F.round(F.max(gap), 7), F.lit(0.0)).alias("most"), F.coalesce(F.sum(F.when(gap > 1e-7, 1).otherwise(0)), F.lit(0)).cast("long").alias("changed"))


QUERIES = [subvectors, kmeans_step, kmeans_fit, spherical_kmeans_step, nearest_code, ivf_assign, ivf_probe, pq_encode, pq_decode, decode_prefix, codebooks, prefix_check, gram_norm, adc_scores, mahalanobis_assign, query_ip_distortion, block_cov_loss, softmax_query_loss, subspace_order, chunked_topk, float_precision_agreement, paired_drift]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def _distance(a: str, b: str) -> str:
    return f"round(list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip({a}, {b})]), 9)"


def _lloyd(rows: str, start: str, name: str) -> str:
    """CTE of the centres (code, c) after one step; rows has x, start has code, c."""
    return (
        f"{name}a AS (SELECT item_id, any_value(x) AS x, arg_min(code, (d, code)) AS code FROM (SELECT r.item_id, r.x, s.code, {_distance('r.x', 's.c')} AS d FROM {rows} r, {start} s) GROUP BY item_id), "
        f"{name}m AS (SELECT code, list(v ORDER BY dim) AS c FROM (SELECT code, dim, round(avg(v), 9) AS v FROM (SELECT code, unnest(x) AS v, generate_subscripts(x, 1) AS dim FROM {name}a) GROUP BY code, dim) GROUP BY code), "
        f"{name} AS MATERIALIZED (SELECT s.code, coalesce(m.c, s.c) AS c FROM {start} s LEFT JOIN {name}m m USING (code))"
    )


@cache
def _parts() -> dict[str, str]:
    """CTE texts after the base relations."""
    cfg = DEFAULT
    M, K = cfg.stages, cfg.codes
    start = "SELECT rn AS code, x AS c FROM (SELECT v.x, row_number() OVER (ORDER BY sha256('{s}:' || v.item_id), v.item_id) - 1 AS rn FROM vec v) WHERE rn < {n}"
    km = [f"k0 AS MATERIALIZED ({start.format(s=_SEEDS['kmeans'], n=CENTRES)})"]
    km += [_lloyd("vec", f"k{i}", f"k{i + 1}") for i in range(STEPS)]
    cell = [
        f"s0 AS MATERIALIZED ({start.format(s=_SEEDS['cells'], n=CELLS)})",
        "sa AS MATERIALIZED (SELECT item_id, any_value(x) AS x, arg_min(code, (-d, code)) AS code FROM (SELECT v.item_id, v.x, s.code, round(list_inner_product(v.x, s.c), 9) AS d FROM vec v, s0 s) GROUP BY item_id)",
        "sm AS (SELECT code, list(v ORDER BY dim) AS t FROM (SELECT code, dim, sum(v) AS v FROM (SELECT code, unnest(x) AS v, generate_subscripts(x, 1) AS dim FROM sa) GROUP BY code, dim) GROUP BY code)",
        "cells AS MATERIALIZED (SELECT s.code, coalesce([round(v / sqrt(list_inner_product(m.t, m.t)), 9) for v in m.t], s.c) AS c FROM s0 s LEFT JOIN sm m USING (code))",
        "cell AS MATERIALIZED (SELECT item_id, any_value(x) AS x, arg_min(code, (-d, code)) AS cluster FROM (SELECT v.item_id, v.x, s.code, round(list_inner_product(v.x, s.c), 9) AS d FROM vec v, cells s) GROUP BY item_id)",
        f"probed AS MATERIALIZED (SELECT query_id, code AS cluster, row_number() OVER (PARTITION BY query_id ORDER BY d DESC, code) AS rk FROM (SELECT g.item_id AS query_id, s.code, round(list_inner_product(v.x, s.c), 9) AS d FROM gal g JOIN vec v USING (item_id), cells s WHERE g.role = 'test') QUALIFY rk <= {PROBES})",
    ]
    pq = [
        f"sub AS MATERIALIZED (SELECT v.item_id, r.m AS part, v.x[r.m * (len(v.x) // {M}) + 1 : (r.m + 1) * (len(v.x) // {M})] AS s, t.k FROM vec v LEFT JOIN t0 t USING (item_id), range(0, {M}) r(m))",
        f"pi AS MATERIALIZED (SELECT part, k AS code, s AS c FROM sub WHERE k < {K})",
        f"pa AS (SELECT item_id, part, any_value(s) AS s, arg_min(code, (d, code)) AS code FROM (SELECT a.item_id, a.part, a.s, i.code, {_distance('a.s', 'i.c')} AS d FROM sub a JOIN pi i USING (part) WHERE a.k < {cfg.train_rows}) GROUP BY item_id, part)",
        "pm AS (SELECT part, code, list(v ORDER BY dim) AS c FROM (SELECT part, code, dim, round(avg(v), 9) AS v FROM (SELECT part, code, unnest(s) AS v, generate_subscripts(s, 1) AS dim FROM pa) GROUP BY ALL) GROUP BY part, code)",
        "pb AS MATERIALIZED (SELECT i.part, i.code, coalesce(m.c, i.c) AS c FROM pi i LEFT JOIN pm m USING (part, code))",
        f"pc AS MATERIALIZED (SELECT item_id, part, arg_min(code, (d, code)) AS code FROM (SELECT a.item_id, a.part, b.code, {_distance('a.s', 'b.c')} AS d FROM sub a JOIN pb b USING (part)) GROUP BY item_id, part)",
    ]
    error = "[p[1] - p[2] for p in list_zip(v.x, p.y)]"
    unit = "[p[1] - p[2] / greatest(p.norm, 1e-9) for p in list_zip(v.x, p.y)]".replace("p[1]", "z[1]").replace("p[2]", "z[2]").replace("for p in", "for z in")
    err = [f"er AS MATERIALIZED (SELECT p.item_id, p.option AS opt, v.x, {error} AS raw, {unit} AS cosine FROM pstat p JOIN vec v USING (item_id))", "cq AS MATERIALIZED (SELECT g.item_id AS query_id, v.x AS q FROM gal g JOIN vec v USING (item_id) WHERE g.role = 'calibration')"]
    return {"km": ", ".join(km), "cell": ", ".join(cell), "pq": ", ".join(pq), "err": ", ".join(err)}


def query_ip_oracle() -> str:
    """CTEs up to qip (item_id, opt, v), the unrounded query-IP distortion."""
    return _parts()["err"] + ", qip AS MATERIALIZED (SELECT e.item_id, e.opt, avg(list_inner_product(c.q, e.cosine) ** 2) AS v FROM er e, cq c GROUP BY e.item_id, e.opt)"


def oracle_sql() -> dict[str, str]:
    from stratavec.plans.oracle import base

    cfg, parts = DEFAULT, _parts()
    M, last = cfg.stages, len(cfg.lengths)
    target = cfg.lengths.index(cfg.target) + 1

    def text(sql: str, *used: str) -> str:
        return f"WITH {base()}" + "".join(f", {parts[u]}" for u in used) + f" {sql}"

    flat = "SELECT {k}, dim - 1 AS dim, round(v, 9) + 0.0::DOUBLE AS v FROM (SELECT {k}, unnest({c}) AS v, generate_subscripts({c}, 1) AS dim FROM {t})"
    block = "list_inner_product(c.q[b.m * (len(c.q) // {M}) + 1 : (b.m + 1) * (len(c.q) // {M})], e.{x}[b.m * (len(c.q) // {M}) + 1 : (b.m + 1) * (len(c.q) // {M})])".replace("{M}", str(M))
    return {
        "subvectors": text(f"SELECT v.item_id, m.m AS part, round(list_inner_product(s.s, s.s), 6) AS norm2, round(s.s[1], 6) AS first, round(s.s[len(s.s)], 6) AS last FROM vec v, range(0, {M}) m(m), LATERAL (SELECT v.x[m.m * (len(v.x) // {M}) + 1 : (m.m + 1) * (len(v.x) // {M})] AS s) s"),
        "kmeans_step": text(flat.format(k="code", c="c", t="k1"), "km"),
        "kmeans_fit": text(f"SELECT s.code, count(a.item_id) AS items, (SELECT round(sum(d), 5) FROM (SELECT item_id, min({_distance('v.x', 's.c')}) AS d FROM vec v, k{STEPS} s GROUP BY item_id)) AS error FROM k{STEPS} s LEFT JOIN (SELECT item_id, arg_min(code, (d, code)) AS code FROM (SELECT v.item_id, s.code, {_distance('v.x', 's.c')} AS d FROM vec v, k{STEPS} s) GROUP BY item_id) a USING (code) GROUP BY s.code", "km"),
        "spherical_kmeans_step": text(flat.format(k="code", c="c", t="cells"), "cell"),
        "nearest_code": text(f"SELECT item_id, arg_min(code, (d, code)) AS code, min(d) AS distance FROM (SELECT v.item_id, b.code, {_distance('v.x', 'b.c')} AS d FROM vec v, b0 b) GROUP BY item_id"),
        "ivf_assign": text("SELECT a.item_id, a.cluster, round(list_distance(a.x, s.c), 6) AS residual FROM cell a JOIN cells s ON s.code = a.cluster", "cell"),
        "ivf_probe": text("SELECT p.query_id, p.rk, p.cluster, count(a.item_id) AS items FROM probed p LEFT JOIN cell a USING (cluster) GROUP BY ALL", "cell"),
        "pq_encode": text("SELECT item_id, part, code FROM pc", "pq"),
        "pq_decode": text("SELECT item_id, part * len(c) + dim - 1 AS dim, round(v, 9) + 0.0::DOUBLE AS v FROM (SELECT p.item_id, p.part, b.c, unnest(b.c) AS v, generate_subscripts(b.c, 1) AS dim FROM pc p JOIN pb b USING (part, code))", "pq"),
        "decode_prefix": text(f"SELECT item_id, dim - 1 AS dim, round(sum(v), 9) + 0.0::DOUBLE AS v FROM (SELECT s.item_id, unnest(c.c) AS v, generate_subscripts(c.c, 1) AS dim FROM codes s JOIN cb c USING (stage, code) WHERE stage < {cfg.target}) GROUP BY ALL"),
        "codebooks": text("SELECT stage, code, dim - 1 AS dim, round(v, 9) AS v FROM (SELECT stage, code, unnest(c) AS v, generate_subscripts(c, 1) AS dim FROM cb)"),
        "prefix_check": text("SELECT count(*) AS items, CAST(sum(CASE WHEN a0.code <> c.c0 OR a1.code <> c.c1 THEN 1 ELSE 0 END) AS BIGINT) AS broken FROM a0 JOIN a1 USING (item_id) JOIN (SELECT item_id, max(CASE WHEN stage = 0 THEN code END) AS c0, max(CASE WHEN stage = 1 THEN code END) AS c1 FROM codes GROUP BY item_id) c USING (item_id)"),
        "gram_norm": text(f"SELECT item_id, round(list_inner_product(y, y), 6) AS norm2 FROM pstat WHERE option = {last}"),
        "adc_scores": text(f"SELECT item_id, arg_min(query_id, (-s, query_id)) AS query_id, max(s) AS score FROM (SELECT p.item_id, g.item_id AS query_id, round(list_inner_product(v.x, p.y) / greatest(p.norm, 1e-12), 9) AS s FROM pstat p, gal g JOIN vec v USING (item_id) WHERE p.option = {last} AND g.role = 'test' AND g.item_id <> p.item_id) GROUP BY item_id"),
        "mahalanobis_assign": text(f"SELECT item_id, part, arg_min(code, (round(d, 9), code)) AS code FROM (SELECT s.item_id, s.part, b.code, avg(list_inner_product(q.s, b.c) * (list_inner_product(q.s, b.c) - 2 * list_inner_product(q.s, s.s))) AS d FROM sub s JOIN pb b USING (part) JOIN sub q USING (part) JOIN cq ON cq.query_id = q.item_id GROUP BY s.item_id, s.part, b.code) GROUP BY item_id, part", "pq", "err"),
        "query_ip_distortion": text("SELECT e.item_id, e.opt, round(avg(list_inner_product(c.q, e.cosine) ** 2), 6) AS v FROM er e, cq c GROUP BY e.item_id, e.opt", "err"),
        "block_cov_loss": text(f"SELECT e.item_id, e.opt, round(sum({block.format(x='raw')} ** 2) / (SELECT count(*) FROM cq), 6) AS raw, round(sum({block.format(x='cosine')} ** 2) / (SELECT count(*) FROM cq), 6) AS cosine FROM er e, cq c, range(0, {M}) b(m) GROUP BY e.item_id, e.opt", "err"),
        "softmax_query_loss": text("SELECT item_id, opt, round(sum(w * r * r) / sum(w), 6) AS raw, round(sum(w * c * c) / sum(w), 6) AS cosine FROM (SELECT e.item_id, e.opt, exp(list_inner_product(c.q, e.x)) AS w, list_inner_product(c.q, e.raw) AS r, list_inner_product(c.q, e.cosine) AS c FROM er e, cq c) GROUP BY item_id, opt", "err"),
        "subspace_order": text("SELECT part, round(gain, 6) AS gain, row_number() OVER (ORDER BY round(gain, 9) DESC, part) - 1 AS place FROM (SELECT s.part, avg(2 * list_inner_product(s.s, b.c) - list_inner_product(b.c, b.c)) AS gain FROM sub s JOIN pc p USING (item_id, part) JOIN pb b USING (part, code) JOIN gal g USING (item_id) WHERE g.role = 'pool' GROUP BY s.part)", "pq"),
        "chunked_topk": text(f"SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS rnk, item_id, s AS score FROM (SELECT g.item_id AS query_id, v.item_id, round(list_inner_product(q.x, v.x), 9) AS s FROM gal g JOIN vec q USING (item_id), vec v WHERE g.role = 'validation' AND v.item_id <> g.item_id) QUALIFY rnk <= {cfg.k}"),
        "paired_drift": text(f"SELECT count(*) AS pairs, round(avg(abs(a - b)), 7) AS mean, round(max(abs(a - b)), 7) AS most, CAST(sum(CASE WHEN abs(a - b) > 1e-7 THEN 1 ELSE 0 END) AS BIGINT) AS changed FROM (SELECT list_inner_product(q.x, v.x) AS a, list_sum([p[1] * p[2] for p in list_zip(q.x, v.x)]) AS b, row_number() OVER (PARTITION BY q.item_id ORDER BY a DESC, v.item_id) AS rk FROM gal g JOIN vec q USING (item_id), vec v WHERE g.role = 'validation' AND v.item_id <> g.item_id) WHERE rk <= {cfg.k}"),
    }
