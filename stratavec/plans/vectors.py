"""Queries over the gallery's vectors themselves: exact top k, norms, means, codec quality, allocation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavec.config import DEFAULT
from stratavec.functions import dot, packed_bits
from stratavec.operators import codec
from stratavec.operators.index import pack_rows, unpack_rows
from stratavec.operators.score import topk
from stratavec.plans.state import panel
from stratavec.sources.tables import gallery, ranked

K = 10
#: Every row with an id divisible by this is a query.
EVERY = 50


def exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: the nearest neighbours of the rows whose id is divisible by 50, against all rows."""
    items = gallery(spark, sf_dir)
    queries = items.where(f"item_id % {EVERY} = 0").select(F.col("item_id").alias("query_id"), F.col("x").alias("q"), F.col("item_id").alias("exclude_id"))
    found = topk(items, queries, K)
    return found.select("query_id", "rnk", "item_id", F.round("score", 6).alias("score"))


def norm_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = gallery(spark, sf_dir).select(F.sqrt(dot("x", "x")).alias("n"), F.size("x").alias("dim"))
    return norm.agg(F.count(F.lit(1)).alias("items"), F.max("dim").cast("long").alias("dim"), F.round(F.min("n"), 6).alias("least"), F.round(F.max("n"), 6).alias("most"), F.round(F.avg("n"), 6).alias("mean"))


def l2_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gallery(spark, sf_dir).withColumn("n", F.sqrt(dot("x", "x")))
    unit = rows.where("n > 0").select("item_id", F.posexplode(F.transform("x", lambda v: v / F.col("n"))).alias("dim", "v"))
    return unit.select("item_id", F.col("dim").cast("long").alias("dim"), F.round("v", 6).alias("v"))


def sha_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(gallery(spark, sf_dir).select("item_id"), 17, "rk").select("item_id", F.col("rk").cast("long").alias("rk"))


def permutation(seed: int, dim: int) -> list[int]:
    """The coordinates 0 to dim - 1 in seeded order."""
    import hashlib

    return sorted(range(dim), key=lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())


def permuted(rows: DataFrame, order: list[int]) -> DataFrame:
    """rows with the coordinates of x in another order, which must be a permutation."""
    if sorted(order) != list(range(len(order))):
        raise ValueError("not a permutation")
    return rows.withColumn("x", F.transform(F.array(*(F.lit(i) for i in order)), lambda i: F.get("x", i)))


def permute_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All coordinates in seeded order, and whether the inverse order restores the vector."""
    rows = gallery(spark, sf_dir)
    first = rows.select(F.size("x")).first()
    order = permutation(7, first[0] if first else 0)
    turned = permuted(rows.withColumn("was", F.col("x")), order)
    back = permuted(turned.withColumn("turned", F.col("x")), sorted(range(len(order)), key=order.__getitem__))
    out = back.select("item_id", (F.col("x") == F.col("was")).cast("long").alias("restored"), F.posexplode("turned").alias("dim", "v"))
    return out.select("item_id", "restored", F.col("dim").cast("long").alias("dim"), F.round("v", 6).alias("v"))


def block_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calibration queries' second moments within every block of coordinates, by partial aggregation."""
    parts = DEFAULT.stages
    rows = panel(spark, sf_dir).items.where("role = 'calibration'").select("x", (F.size("x") / parts).cast("int").alias("w"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    rows = rows.select("part", F.expr("slice(x, part * w + 1, w)").alias("s"))
    rows = rows.select("part", "s", F.posexplode("s").alias("i", "a")).select("part", "i", "a", F.posexplode("s").alias("j", "b")).where("i <= j")
    keys = [F.col(c).cast("long").alias(c) for c in ("part", "i", "j")]
    return rows.groupBy(*keys).agg(F.round(F.avg(F.col("a") * F.col("b")), 9).alias("v"))


def pack_nibbles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's codes as bytes, in column functions only."""
    made = panel(spark, sf_dir)
    data = packed_bits("codes", made.cfg.code_bits, made.cfg.stages)
    return made.items.select("item_id", *(x.alias(f"byte{i}") for i, x in enumerate(data)))


def unpack_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_nibbles(spark, sf_dir).select("item_id", F.shiftright("byte1", 4).bitwiseAND(F.lit(15).cast("long")).alias("code"))


def pack_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By code length, the rows packed as bit streams, their bytes, the sum of the unpacked codes, and rows that came back changed."""
    made = panel(spark, sf_dir)
    bits, lengths = made.cfg.code_bits, made.cfg.lengths

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                codes = codec.matrix(batch.column("codes")).astype(np.int64)
                rows = []
                for n in lengths:
                    data = pack_rows(codes[:, :n], bits)
                    back = unpack_rows(data, n, bits)
                    rows.append((n, len(codes), data.size, int(back.sum()), int((back != codes[:, :n]).any(1).sum())))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["len", "items", "bytes", "codes", "broken"])

    sums = [F.sum(c).alias(c) for c in ("items", "bytes", "codes", "broken")]
    return made.items.select("codes").mapInArrow(run, "len long, items long, bytes long, codes long, broken long").groupBy("len").agg(*sums)


def codec_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean squared error and bits a vector of every codec family, over all rows; fitted on the bounded sample."""
    made = panel(spark, sf_dir)
    if not made.dim:
        return spark.createDataFrame([], "codec string, bits long, mse double")
    cfg, x = made.cfg, codec.training_rows(made.items.where("role = 'pool'"), made.cfg)
    queries = codec.training_rows(made.items.where("role = 'calibration'"), made.cfg)
    rq = codec.train_rq(x, cfg, 4)
    lsq, _ = codec.refine_lsq(x, rq)
    pq = codec.train_pq(x, cfg.stages, cfg.codes, 4)
    turn, opq = codec.train_opq(x, cfg.stages, cfg.codes)
    cov_books, cov = codec.train_covariance(x, queries, cfg.stages, cfg.codes)
    centres = codec.lloyd(x, x[: cfg.stages], 4)
    moments = codec.query_matrices(queries, centres)
    aware = codec.train_query_aware(x, pq, centres, moments)
    split = {name: codec.train_split(x, 2, cfg, refine) for name, refine in (("prq", False), ("plsq", True))}

    def rebuilt(name: str, v: np.ndarray) -> np.ndarray:
        whole = (cfg.stages,)
        if name == "rq":
            return codec.prefixes(codec.encode_rq(v, rq), rq, whole)[:, 0]
        if name == "rq_beam":
            return codec.prefixes(codec.encode_beam(v, rq), rq, whole)[:, 0]
        if name == "lsq":
            return codec.prefixes(codec.sweep(v, lsq, codec.encode_beam(v, lsq), 4), lsq, whole)[:, 0]
        if name == "pq":
            return codec.decode_pq(codec.encode_pq(v, pq), pq)
        if name == "opq":
            return codec.decode_pq(codec.encode_pq(v @ turn, opq), opq) @ turn.T
        if name == "covariance_pq":
            return codec.decode_pq(codec.assign_mahalanobis(v, cov_books, cov), cov_books)
        if name == "query_aware_pq":
            return codec.decode_pq(codec.encode_query_aware(v, aware, codec.nearest(v, centres), moments), aware)
        return np.concatenate([codec.prefixes(codec.encode_beam(part, b), b, whole)[:, 0] for part, b in zip(np.split(v, 2, axis=1), split[name], strict=True)], 1)

    names = ["rq", "rq_beam", "lsq", "pq", "opq", "covariance_pq", "query_aware_pq", "prq", "plsq"]
    bits = {n: cfg.stages * cfg.code_bits * (2 if n in split else 1) for n in names}

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                v = codec.matrix(batch.column("x"))
                errors = [float(((v - rebuilt(n, v)) ** 2).sum()) for n in names]
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(errors), pa.array([len(v)] * len(names), pa.int64())], ["codec", "error", "n"])

    sums = made.items.select("x").mapInArrow(run, "codec string, error double, n long").groupBy("codec").agg((F.sum("error") / F.sum("n")).alias("mse"))
    return sums.join(F.broadcast(spark.createDataFrame(list(bits.items()), "codec string, bits long")), "codec").select("codec", "bits", F.round("mse", 6).alias("mse"))


def queries() -> dict:
    return {f.__name__: f for f in (exact_topk, norm_report, l2_normalise, sha_rank, permute_dims, block_covariance, pack_nibbles, unpack_stage, pack_roundtrip, codec_quality)}


_G = "WITH g AS (SELECT vec_id::BIGINT AS item_id, embedding::DOUBLE[] AS x FROM embeddings)"


def oracle_sql() -> dict[str, str]:
    from stratavec.plans.oracle import base

    codes = f"WITH {base()}, w AS (SELECT item_id, max(CASE WHEN stage = 0 THEN code END) AS c0, max(CASE WHEN stage = 1 THEN code END) AS c1, max(CASE WHEN stage = 2 THEN code END) AS c2, max(CASE WHEN stage = 3 THEN code END) AS c3 FROM codes GROUP BY item_id)"
    return {
        "exact_topk": f"{_G}, p AS (SELECT a.item_id AS query_id, b.item_id, list_inner_product(a.x, b.x) AS s FROM g a JOIN g b ON a.item_id % 50 = 0 AND a.item_id <> b.item_id) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, item_id) AS rnk, item_id, round(round(s, 9), 6) AS score FROM p QUALIFY rnk <= 10",
        "norm_report": f"{_G}, n AS (SELECT sqrt(list_inner_product(x, x)) AS n, len(x) AS dim FROM g) SELECT count(*) AS items, max(dim) AS dim, round(min(n), 6) AS least, round(max(n), 6) AS most, round(avg(n), 6) AS mean FROM n",
        "l2_normalise": f"{_G} SELECT item_id, dim - 1 AS dim, round(v / n, 6) AS v FROM (SELECT item_id, list_distance(x, [0.0::DOUBLE for i in x]) AS n, unnest(x) AS v, generate_subscripts(x, 1) AS dim FROM g)",
        "sha_rank": f"{_G} SELECT item_id, row_number() OVER (ORDER BY sha256('17:' || item_id), item_id) - 1 AS rk FROM g",
        "permute_dims": f"{_G}, d AS (SELECT dim, row_number() OVER (ORDER BY sha256('7:' || dim)) - 1 AS place FROM (SELECT unnest(range(len(x))) AS dim FROM (SELECT x FROM g LIMIT 1))) SELECT g.item_id, 1::BIGINT AS restored, d.place AS dim, round(g.x[d.dim + 1], 6) AS v FROM g, d",
        "block_covariance": f"WITH {base()} SELECT p.p AS part, i.i AS i, j.j AS j, round(avg(v.x[p.p * 16 + i.i + 1] * v.x[p.p * 16 + j.j + 1]), 9) AS v FROM gal g JOIN vec v USING (item_id), range(0, 4) p(p), range(0, 16) i(i), range(0, 16) j(j) WHERE g.role = 'calibration' AND i.i <= j.j GROUP BY ALL",
        "pack_nibbles": f"{codes} SELECT item_id, c0 + 16 * c1 AS byte0, c2 + 16 * c3 AS byte1 FROM w",
        "unpack_stage": f"{codes} SELECT item_id, c3 AS code FROM w",
        "pack_roundtrip": f"WITH {base()} SELECT l.len::BIGINT AS len, count(DISTINCT c.item_id) AS items, CAST(count(DISTINCT c.item_id) * ceil(l.len * {DEFAULT.code_bits} / 8e0) AS BIGINT) AS bytes, CAST(sum(c.code) AS BIGINT) AS codes, 0::BIGINT AS broken FROM codes c JOIN (VALUES {', '.join(f'({n})' for n in DEFAULT.lengths)}) l(len) ON c.stage < l.len GROUP BY l.len",
    }
