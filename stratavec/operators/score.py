"""Exact and prefix scores of query blocks against gallery blocks, as bounded top lists.

Queries and gallery rows are packed into blocks of bounded size; every pair of blocks is one task-sized unit that
returns only the rows that can be among a query's leaders by any of the criteria. Nothing of size queries x rows exists.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratavec.config import PanelConfig
from stratavec.operators.codec import DECIMALS, matrix, prefixes

BLOCK_ROWS = 2048


def leaders(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Mask of each row's k largest scores; ties to the smaller id. -inf never leads."""
    order = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, :k]
    out = np.zeros(score.shape, bool)
    np.put_along_axis(out, order, True, 1)
    return out & np.isfinite(score)


def packed(rows: DataFrame, name: str, columns: list[str], block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, int]:
    """Rows in blocks of about block_rows, dealt by a hash of the id: (name, rows array<struct>)."""
    blocks = max(1, -(-rows.count() // block_rows))
    dealt = rows.withColumn(name, F.pmod(F.xxhash64(columns[0]), F.lit(blocks)).cast("int"))
    return dealt.groupBy(name).agg(F.collect_list(F.struct(*columns)).alias(f"{name}_rows")), blocks


def block_pairs(items: DataFrame, queries: DataFrame, item_columns: list[str], query_columns: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(item block, query block) units; the smaller side, the queries, is sent to every item block.

    The merge hint keeps Spark from broadcasting the queries after they are repeated for every block: it judges their size
    as it was before, and would bring blocks x queries vectors to the driver.
    """
    left, blocks = packed(items, "iblock", item_columns, block_rows)
    right, _ = packed(queries, "qblock", query_columns, 512)
    sent = right.withColumn("iblock", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return left.join(sent.hint("merge"), "iblock")


def _columns(rows: pa.ListArray, name: str) -> pa.Array:
    return rows.flatten().field(name)


def topk(items: DataFrame, queries: DataFrame, k: int, block_rows: int = BLOCK_ROWS, kind: str = "f8") -> DataFrame:
    """query_id, rnk, item_id, score: the exact top k inner products. items (item_id, x); queries (query_id, q, exclude_id).

    kind is the precision that products are summed in.
    """

    def run(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        own, asked = part.column("iblock_rows").combine_chunks(), part.column("qblock_rows").combine_chunks()
        ids, names = _columns(own, "item_id").to_numpy(), _columns(asked, "query_id").to_numpy()
        out = np.array(_columns(asked, "exclude_id").fill_null(-1))
        score = np.round((matrix(_columns(asked, "q")).astype(kind) @ matrix(_columns(own, "x")).astype(kind).T).astype("f8"), DECIMALS)
        score[out[:, None] == ids] = -np.inf
        q, i = np.nonzero(leaders(score, ids, k))
        return pa.table({"query_id": pa.array(names[q], pa.int64()), "item_id": pa.array(ids[i], pa.int64()), "score": pa.array(score[q, i])})

    pairs = block_pairs(items.select("item_id", "x"), queries.select("query_id", "q", "exclude_id"), ["item_id", "x"], ["query_id", "q", "exclude_id"], block_rows)
    return _ranked(pairs.groupBy("iblock", "qblock").applyInArrow(run, "query_id long, item_id long, score double"), k)


def merged_topk(items: DataFrame, queries: DataFrame, k: int, chunk: int) -> DataFrame:
    """As topk, for queries of a bounded number: they are sent to every task once, which takes `chunk` rows at a time and
    merges the chunk's leaders with those it has. A task returns k rows a query, however many rows it read."""
    asked = queries.select("query_id", "q", "exclude_id").toArrow().combine_chunks()
    vectors = matrix(asked.column("q").combine_chunks()) if asked.num_rows else None
    sent = items.sparkSession.sparkContext.broadcast((asked.column("query_id").to_numpy(), np.array(asked.column("exclude_id").fill_null(-1)), vectors))

    def run(batches):
        names, out, q = sent.value
        score, ids = np.empty((len(names), 0)), np.empty((len(names), 0), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows if len(names) else 0, chunk):
                part = batch.slice(at, chunk)
                own = part.column("item_id").to_numpy()
                new = np.round(q @ matrix(part.column("x")).T, DECIMALS)
                new[out[:, None] == own] = -np.inf
                score, ids = np.concatenate((score, new), 1), np.concatenate((ids, np.broadcast_to(own, new.shape)), 1)
                best = np.lexsort((ids, -score), axis=1)[:, :k]
                score, ids = np.take_along_axis(score, best, 1), np.take_along_axis(ids, best, 1)
        a, b = np.nonzero(np.isfinite(score))
        yield pa.RecordBatch.from_arrays([pa.array(names[a], pa.int64()), pa.array(ids[a, b], pa.int64()), pa.array(score[a, b])], ["query_id", "item_id", "score"])

    found = items.select("item_id", "x").mapInArrow(run, "query_id long, item_id long, score double")
    return _ranked(found, k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of every query, numbered from 1; ties to the smaller id."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")).cast("long")
    return found.withColumn("rnk", rank).where(F.col("rnk") <= k).select("query_id", "rnk", "item_id", "score")


def scored(items: DataFrame, queries: DataFrame, books: np.ndarray, cfg: PanelConfig) -> DataFrame:
    """query_id, item_id, f (exact score) and a1.. (score of each prefix option) for every item that leads by some criterion.

    Criteria: the first `wide` + 2k by f, the first `rerank` by a1, the first k by each further option, and the `wide`
    largest overestimates a1 - f. items (item_id, x, codes); queries (query_id, q); an item is never its own query's.
    """
    sent = items.sparkSession.sparkContext.broadcast(books)
    names = [f"a{j + 1}" for j in range(len(cfg.lengths))]

    def run(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        own, asked = part.column("iblock_rows").combine_chunks(), part.column("qblock_rows").combine_chunks()
        ids, who = _columns(own, "item_id").to_numpy(), _columns(asked, "query_id").to_numpy()
        q = matrix(_columns(asked, "q"))
        rebuilt = prefixes(matrix(_columns(own, "codes")).astype(np.int64), sent.value, cfg.lengths)
        rebuilt = rebuilt / np.maximum(np.sqrt((rebuilt**2).sum(-1, keepdims=True)), 1e-12)
        scores = [np.round(q @ matrix(_columns(own, "x")).T, DECIMALS), *(np.round(q @ rebuilt[:, j].T, DECIMALS) for j in range(len(names)))]
        self_ = who[:, None] == ids
        lead = np.zeros(self_.shape, bool)
        wanted = [(scores[0], cfg.wide + 2 * cfg.k), (scores[1], cfg.rerank), *((s, cfg.k) for s in scores[2:]), (np.round(scores[1] - scores[0], DECIMALS), cfg.wide)]
        for score, depth in wanted:
            lead |= leaders(np.where(self_, -np.inf, score), ids, depth)
        a, b = np.nonzero(lead)
        return pa.table({"query_id": pa.array(who[a], pa.int64()), "item_id": pa.array(ids[b], pa.int64()), **{n: pa.array(s[a, b]) for n, s in zip(["f", *names], scores, strict=True)}})

    pairs = block_pairs(items.select("item_id", "x", "codes"), queries.select("query_id", "q"), ["item_id", "x", "codes"], ["query_id", "q"])
    return pairs.groupBy("iblock", "qblock").applyInArrow(run, "query_id long, item_id long, f double, " + ", ".join(f"{n} double" for n in names))
