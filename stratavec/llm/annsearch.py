"""Approximate nearest neighbours by robust-pruned directed graphs, one a shard.

Rows are dealt to shards of about `SHARD_ROWS` (fewer while that leaves cores idle) by a hash of their id. A shard's distinct vectors become the nodes of a
graph: greedy searches from the medoid propose neighbours, and relaxed distance pruning keeps a diverse few of them
(a candidate goes when a kept neighbour is closer to it, by the factor alpha, than the node is). Queries go to every
shard and search it by beam, a shard's index moves once for `QUERY_ROWS` queries; the nearest of all shards are merged. Distances are Euclidean, in double precision, on the
original vectors.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, as query or candidate;
vectors of another length than the query's are no candidates of it; equal vectors are one node and all their rows are
results, ties to the smaller vec_id; rows repeated with a vec_id each count, and none is a result of its own id's query
(a query id that comes with several vectors searches with each, the nearer counts); an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratavec.llm.common import stored, table

#: Rows of a shard: what one task builds and holds, 16 MB of vectors of 64 dimensions and a graph of 6 MB.
SHARD_ROWS = 32768
LEAST_ROWS = 2048
#: Queries that visit a shard in one task, and those that advance together.
QUERY_ROWS = 16384
LOCKSTEP = 256
DEGREE = 32
BUILD_BEAM = 64
SEARCH_BEAM = 128
ALPHA = 1.2
K = 10
EVERY = 100


def _block(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[None] + (q * q).sum(1)[:, None] - 2 * q @ x.T, 0)


def beam(x: np.ndarray, graph: np.ndarray, start: int, q: np.ndarray, width: int, expand: int = 4) -> np.ndarray:
    """For each query, the nodes of the final beam, nearest first; -1 pads. All queries advance in lockstep.

    graph: [nodes, degree], padded with -1. Each step expands the `expand` nearest unexpanded nodes of every beam.
    """
    n, m = len(x), len(q)
    width = min(width, n)
    norm = (x * x).sum(1)
    ids = np.full((m, width), -1)
    dist = np.full((m, width), np.inf)
    done = np.zeros((m, width), bool)
    seen = np.zeros((m, n + 1), bool)
    ids[:, 0] = start
    dist[:, 0] = norm[start] - 2 * q @ x[start]
    seen[:, start] = seen[:, n] = True
    live = np.arange(m)
    while len(live):
        open_ = np.where(done[live] | (ids[live] < 0), np.inf, dist[live])
        pick = np.argsort(open_, axis=1, kind="stable")[:, :expand]
        ok = np.isfinite(np.take_along_axis(open_, pick, 1))
        active = ok.any(1)
        live, pick, ok = live[active], pick[active], ok[active]
        if not len(live):
            break
        nodes = np.where(ok, ids[live[:, None], pick], -1)
        done[live[:, None], pick] |= ok
        near = np.where(nodes[:, :, None] >= 0, graph[nodes], -1).reshape(len(live), -1)
        near = np.where(near < 0, n, near)
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        near = np.where(seen[live[:, None], near], n, near)
        seen[live[:, None], near] = True
        far = near == n
        safe = np.where(far, 0, near)
        d = norm[safe] - 2 * np.einsum("md,mcd->mc", q[live], x[safe])
        d[far] = np.inf
        all_ids = np.concatenate((ids[live], np.where(far, -1, near)), 1)
        all_dist = np.concatenate((dist[live], d), 1)
        all_done = np.concatenate((done[live], np.zeros_like(far)), 1)
        top = np.argpartition(all_dist, width - 1, axis=1)[:, :width]
        order = np.take_along_axis(top, np.argsort(np.take_along_axis(all_dist, top, 1), axis=1, kind="stable"), 1)
        ids[live], dist[live], done[live] = (np.take_along_axis(v, order, 1) for v in (all_ids, all_dist, all_done))
    return ids


def prune(x: np.ndarray, node: int, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning: nearest first, a kept neighbour removes the candidates that it covers."""
    cand = np.unique(cand)
    cand = cand[(cand >= 0) & (cand != node)]
    if not len(cand):
        return cand
    own = ((x[cand] - x[node]) ** 2).sum(1)
    order = np.argsort(own, kind="stable")
    cand, own = cand[order], own[order]
    between = _block(x[cand], x[cand])
    alive, kept = np.ones(len(cand), bool), []
    for i in range(len(cand)):
        if alive[i]:
            kept.append(i)
            if len(kept) == degree:
                break
            alive &= alpha * alpha * between[i] > own
    return cand[kept]


def build(x: np.ndarray, degree: int = DEGREE, width: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 17) -> tuple[np.ndarray, int]:
    """Graph and entry node of distinct vectors."""
    n = len(x)
    rng = np.random.default_rng(seed)
    start = int(_block(x, x.mean(0, keepdims=True))[0].argmin())
    slack = degree + degree // 2
    graph = np.full((n, slack), -1)
    if n > 1:
        first = min(degree // 2, n - 1)
        graph[:, :first] = (np.arange(n)[:, None] + 1 + rng.permuted(np.tile(np.arange(n - 1), (n, 1)), axis=1)[:, :first]) % n if n <= 64 else rng.integers(0, n, (n, first))
    for factor in (1.0, alpha):
        order = rng.permutation(n)
        for at in range(0, n, 128):
            nodes = order[at : at + 128]
            found = beam(x, graph, start, x[nodes], width)
            back: dict[int, list[int]] = {}
            for node, near in zip(nodes, found, strict=True):
                kept = prune(x, node, np.concatenate((near, graph[node])), degree, factor)
                graph[node] = -1
                graph[node, : len(kept)] = kept
                for other in kept:
                    back.setdefault(int(other), []).append(int(node))
            for other, new in back.items():
                row = graph[other]
                own = row[row >= 0]
                own = np.concatenate((own, np.setdiff1d(new, own)))
                if len(own) > slack:
                    own = prune(x, other, own, degree, factor)
                graph[other] = -1
                graph[other, : len(own)] = own
    return graph.astype(np.int32), start


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, embedding of the rows that take part, and dim."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite & F.exists("embedding", lambda x: x != 0)).withColumn("dim", F.size("embedding"))


def _build_shard(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
    ids = part.column("vec_id").to_numpy()
    x = np.stack(part.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1))
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    nodes, of = np.unique(x, axis=0, return_inverse=True)
    graph, start = build(nodes)
    data = pickle.dumps({"ids": ids, "of": of.ravel().astype(np.int32), "x": nodes, "graph": graph, "start": start})
    return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32()), "index": pa.array([data], pa.binary())})


def build_index(rows: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(dim, shard, index): a graph a shard, over every usable row. Written to the shared folder.

    A row's shard is a hash of its id, so copies of a vector spread over all shards.
    """
    good = usable(rows)
    size = good.count()
    shards = max(1, -(-size // shard_rows), min(rows.sparkSession.sparkContext.defaultParallelism, size // LEAST_ROWS))
    dealt = good.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).repartition(4 * shards, "dim", "shard")
    return stored(dealt.groupBy("dim", "shard").applyInArrow(_build_shard, "dim int, shard int, index binary"), "index")[0]


def search(index: DataFrame, queries: DataFrame, k: int = K, width: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of every query (vec_id, embedding); own ids are left out."""
    good = usable(queries).dropDuplicates(["vec_id", "embedding"])
    blocks = max(1, -(-good.count() // QUERY_ROWS))
    shards = index.agg(F.max("shard")).first()[0]
    shards = 0 if shards is None else shards + 1
    block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int").alias("block")
    keys, parts = ["dim", "shard", "block"], max(1, 4 * shards * blocks)
    visits = good.select("dim", "vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(max(0, shards - 1)))).alias("shard"), block).repartition(parts, *keys)
    sent = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(parts, *keys)

    def run(own: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if own.num_rows and asked.num_rows:
            shard = pickle.loads(own.column("index")[0].as_py())
            ids, of, x = shard["ids"], shard["of"], shard["x"]
            members = np.argsort(of, kind="stable")
            bounds = np.searchsorted(of[members], np.arange(len(x) + 1))
            names = asked.column("vec_id").to_numpy()
            vectors = asked.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(names), -1)
            for at in range(0, len(names), LOCKSTEP):
                q = vectors[at : at + LOCKSTEP]
                for name, vector, near in zip(names[at : at + LOCKSTEP], q, beam(x, shard["graph"], shard["start"], q, max(width, 2 * k)), strict=True):
                    near = near[near >= 0]
                    d = np.sqrt(((x[near] - vector) ** 2).sum(1))
                    found = []
                    for s, node in zip(d, near, strict=True):
                        rows = ids[members[bounds[node] : bounds[node + 1]]]
                        found += [(float(s), int(i)) for i in rows[rows != name][:k]]
                    for s, i in sorted(found)[:k]:
                        out[0].append(int(name))
                        out[1].append(i)
                        out[2].append(s)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    found = sent.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return search(build_index(rows), rows.where(F.col("vec_id") % EVERY == 0))
