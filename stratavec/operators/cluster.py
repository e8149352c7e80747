"""K-means steps over a table of vectors, and small sums over it: centres are sent out, partial sums come back.

What a task returns has a fixed size (centres x dimensions, or dimensions squared), whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavec.operators.codec import DECIMALS, matrix, nearest
from stratavec.sources.tables import ranked


def first_rows(rows: DataFrame, seed: int, count: int) -> np.ndarray:
    """The vectors of the first `count` rows in seeded order."""
    found = ranked(rows.select("item_id", "x"), seed, "_k").where(F.col("_k") < count).orderBy("_k").select("x").toArrow()
    return matrix(found.column("x").combine_chunks())


def affine(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Code of the centre with the largest inner product; the first of equals."""
    return np.round(x @ centres.T, DECIMALS).argmax(1)


def sums(rows: DataFrame, centres: np.ndarray, assign: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, float]:
    """Per centre the sum and number of its rows, and the squared error of all rows."""
    sent = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        total, count, error = np.zeros_like(sent.value), np.zeros(len(sent.value), np.int64), 0.0
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("x"))
                code = assign(x, sent.value)
                np.add.at(total, code, x)
                count += np.bincount(code, minlength=len(count))
                error += float(((x - sent.value[code]) ** 2).sum())
        code, dim = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(code.ravel(), pa.int64()), pa.array(dim.ravel(), pa.int64()), pa.array(total.ravel()), pa.array(np.repeat(count, total.shape[1])), pa.array([error / max(1, total.size)] * total.size)], ["code", "dim", "total", "n", "error"])

    made = rows.select("x").mapInArrow(run, "code long, dim long, total double, n long, error double").groupBy("code", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.sum("error").alias("error")).toArrow()
    total, count = np.zeros_like(centres), np.zeros(len(centres), np.int64)
    code, dim = made.column("code").to_numpy(), made.column("dim").to_numpy()
    total[code, dim] = made.column("total").to_numpy()
    count[code] = made.column("n").to_numpy()
    return total, count, float(made.column("error").to_numpy().sum())


def kmeans_step(rows: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Means of the rows nearest to each centre; an empty cell keeps its centre."""
    total, count, _ = sums(rows, centres, nearest)
    return np.where(count[:, None] > 0, np.round(total / np.maximum(count, 1)[:, None], DECIMALS), centres)


def kmeans_fit(rows: DataFrame, centres: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Centres after some steps, then the rows of each and the squared error."""
    for _ in range(steps):
        centres = kmeans_step(rows, centres)
    _, count, error = sums(rows, centres, nearest)
    return centres, count, error


def spherical_step(rows: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Directions of the sums of the rows most aligned with each centre; an empty cell keeps its centre."""
    total, count, _ = sums(rows, centres, affine)
    norm = np.sqrt((total**2).sum(1, keepdims=True))
    return np.where((count[:, None] > 0) & (norm > 0), np.round(total / np.maximum(norm, 1e-300), DECIMALS), centres)


def second_moment(rows: DataFrame) -> np.ndarray:
    """Mean outer product of the vectors, not centred; [0, 0] of an empty table."""

    def run(batches):
        total, n = None, 0
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("x"))
                total, n = (0 if total is None else total) + x.T @ x, n + len(x)
        if n:
            at = np.arange(total.size)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total.ravel()), pa.array(np.full(total.size, n), pa.int64())], ["at", "v", "n"])

    made = rows.select("x").mapInArrow(run, "at long, v double, n long").groupBy("at").agg((F.sum("v") / F.sum("n")).alias("v")).toArrow()
    size = int(round(made.num_rows**0.5))
    out = np.zeros(size * size)
    out[made.column("at").to_numpy()] = made.column("v").to_numpy()
    return out.reshape(size, size)
