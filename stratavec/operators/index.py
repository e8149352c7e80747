"""A packed retrieval index: items by coarse cell and code length, each with its code prefix as a bit stream and its norms.

Built from codes and an allocation, written by length, checked against its ledger when loaded. Search has two phases: a
query's probed cells are scanned by the shortest prefix, and the best of those are scored again by their whole prefix.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratavec.config import PanelConfig
from stratavec.operators.codec import DECIMALS, matrix, prefixes
from stratavec.operators.cluster import affine

#: Items of a cell that one task scans.
BLOCK_ROWS = 16384


def pack_rows(codes: np.ndarray, bits: int) -> np.ndarray:
    """[rows, bytes]: every row's symbols as a little-endian stream, padded to whole bytes."""
    each = (codes.astype(np.uint32)[:, :, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(each.reshape(len(codes), -1).astype(np.uint8), axis=1, bitorder="little")


def unpack_rows(data: np.ndarray, count: int, bits: int) -> np.ndarray:
    each = np.unpackbits(data, axis=1, bitorder="little", count=count * bits).reshape(len(data), count, bits)
    return (each.astype(np.int64) << np.arange(bits)).sum(2)


INDEX = "cluster long, len long, item_id long, codes binary, base_norm double, norm double"


def build(items: DataFrame, lengths: DataFrame, centres: np.ndarray, books: np.ndarray, cfg: PanelConfig) -> DataFrame:
    """The index of items (item_id, x, codes) under an allocation (item_id, len)."""
    sent = items.sparkSession.sparkContext.broadcast((centres, books))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            cells, tensor = sent.value
            ids, length, codes = batch.column("item_id").to_numpy(), batch.column("len").to_numpy(), matrix(batch.column("codes")).astype(np.int64)
            cluster = affine(matrix(batch.column("x")), cells)
            every = np.sqrt((prefixes(codes, tensor, tuple(range(1, len(tensor) + 1))) ** 2).sum(-1))
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                data = pack_rows(codes[at, :n], cfg.code_bits)
                stream = pa.array([x.tobytes() for x in data], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(cluster[at], pa.int64()), pa.array(length[at], pa.int64()), pa.array(ids[at]), stream, pa.array(every[at, cfg.lengths[0] - 1]), pa.array(every[at, n - 1])], [x.split()[0] for x in INDEX.split(", ")])

    return items.select("item_id", "x", "codes").join(lengths, "item_id").mapInArrow(run, INDEX)


def ledger(index: DataFrame) -> DataFrame:
    """Items and code bytes by cluster and length."""
    return index.groupBy("cluster", "len").agg(F.count(F.lit(1)).alias("items"), F.sum(F.length("codes")).alias("code_bytes"))


def save(index: DataFrame, centres: np.ndarray, books: np.ndarray, path: str) -> None:
    """Rows by length, the small tensors and the ledger, each in a folder of its own under path."""
    spark = index.sparkSession
    index.write.mode("overwrite").partitionBy("len").parquet(f"{path}/rows")
    ledger(spark.read.schema(INDEX).parquet(f"{path}/rows")).write.mode("overwrite").parquet(f"{path}/ledger")
    head = {"centres": [list(centres.shape), centres.ravel().tolist()], "books": [list(books.shape), books.ravel().tolist()]}
    spark.createDataFrame([(k, json.dumps(v)) for k, v in head.items()], "name string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/tensors")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The index, its centres and its codebooks; an index that does not agree with its ledger is refused."""
    index = spark.read.schema(INDEX).parquet(f"{path}/rows")
    columns = ["cluster", "len", "items", "code_bytes"]
    there, said = ledger(index).select(columns), spark.read.parquet(f"{path}/ledger").select(columns)
    if there.exceptAll(said).union(said.exceptAll(there)).limit(1).count():
        raise ValueError(f"the index under {path} does not agree with its ledger")
    tensors = {r.name: json.loads(r.value) for r in spark.read.parquet(f"{path}/tensors").collect()}
    centres, books = (np.array(tensors[k][1]).reshape(tensors[k][0]) for k in ("centres", "books"))
    return index, centres, books


def search(index: DataFrame, centres: np.ndarray, books: np.ndarray, queries: DataFrame, cfg: PanelConfig, probes: int, depth: int, k: int) -> DataFrame:
    """query_id, rk, item_id, score: the k best of queries (query_id, x); ranks without an item hold -1 and no score.

    The first `depth` items of the probed cells by their shortest prefix are ranked by their whole prefix. A cell is dealt
    to tasks in blocks, so a large one is not a single task.
    """
    spark = index.sparkSession
    sent = spark.sparkContext.broadcast((centres, books))
    sizes = {r["cluster"]: -(-r["n"] // BLOCK_ROWS) for r in index.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = F.coalesce(F.element_at(F.create_map(*(F.lit(x).cast("long") for c, n in (sizes or {-1: 1}).items() for x in (c, n))), F.col("cluster")), F.lit(0).cast("long"))
    dealt = index.withColumn("block", F.pmod(F.xxhash64("item_id"), blocks))

    def cells(batches):
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("x"))
                order = np.argsort(-np.round(x @ sent.value[0].T, DECIMALS), axis=1, kind="stable")[:, :probes]
                rows = np.repeat(np.arange(len(x)), order.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(rows)), batch.column("x").take(pa.array(rows)), pa.array(order.ravel(), pa.int64())], ["query_id", "x", "cluster"])

    asked = queries.select("query_id", "x").mapInArrow(cells, "query_id long, x array<double>, cluster long").withColumn("blocks", blocks).where("blocks > 0")
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))

    def scan(own: pa.Table, probing: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        if own.num_rows and probing.num_rows:
            tensor = sent.value[1]
            who, q = probing.column("query_id").to_numpy(), matrix(probing.column("x").combine_chunks())
            tables = np.einsum("qd,skd->qsk", q, tensor)
            length, ids = own.column("len").to_numpy(), own.column("item_id").to_numpy()
            base, whole = np.empty((len(q), len(ids))), np.empty((len(q), len(ids)))
            first = cfg.lengths[0]
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                data = np.frombuffer(b"".join(own.column("codes").take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), -1)
                codes = unpack_rows(data, int(n), cfg.code_bits)
                stages = np.stack([tables[:, s][:, codes[:, s]] for s in range(n)])
                base[:, at], whole[:, at] = stages[:first].sum(0), stages.sum(0)
            base = np.round(base / np.maximum(own.column("base_norm").to_numpy(), 1e-12), DECIMALS)
            whole = np.round(whole / np.maximum(own.column("norm").to_numpy(), 1e-12), DECIMALS)
            base[who[:, None] == ids] = -np.inf
            for row in range(len(q)):
                order = np.lexsort((ids, -base[row]))[:depth]
                order = order[np.isfinite(base[row, order])]
                for column, value in zip(out, (np.full(len(order), who[row]), ids[order], base[row, order], whole[row, order]), strict=True):
                    column.append(value)
        flat = [np.concatenate(c) if c else np.empty(0) for c in out]
        return pa.table({"query_id": pa.array(flat[0].astype(np.int64)), "item_id": pa.array(flat[1].astype(np.int64)), "base": pa.array(flat[2].astype(float)), "score": pa.array(flat[3].astype(float))})

    found = dealt.groupBy("cluster", "block").cogroup(asked.groupBy("cluster", "block")).applyInArrow(scan, "query_id long, item_id long, base double, score double")
    by_base = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("base"), "item_id"))
    near = found.withColumn("r", by_base).where(F.col("r") <= depth)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")).cast("long")
    best = near.withColumn("rk", rank).where(F.col("rk") <= k).select("query_id", "rk", "item_id", "score")
    slots = queries.select("query_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(k).cast("long"))).alias("rk"))
    return slots.join(best, ["query_id", "rk"], "left").select("query_id", "rk", F.coalesce("item_id", F.lit(-1)).alias("item_id"), "score")


