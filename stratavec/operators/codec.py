"""Nested codecs: residual (greedy, beam, least-squares refined), product, rotated product, query-aware; all nested by stage.

Codebooks are fitted on a bounded sample (`train_rows`, in seeded order) on the driver, where they stay small; encoding
and decoding run on all rows in Arrow batches with the codebooks broadcast (stages x codes x dim numbers).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavec.config import PanelConfig
from stratavec.sources.tables import ranked

#: Scores and distances are compared after rounding to so many decimals, then by id or code.
DECIMALS = 9


def matrix(column: pa.Array) -> np.ndarray:
    """A batch's list column, without nulls and of equal lengths, as a dense matrix of doubles."""
    if not len(column):
        return np.empty((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances, summed over differences (exact zeros stay zero), rounded."""
    out = np.empty((len(x), len(c)))
    for at in range(0, len(x), 512):
        out[at : at + 512] = ((x[at : at + 512, None] - c) ** 2).sum(-1)
    return np.round(out, DECIMALS)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Code of the nearest centre; the first of equals."""
    return distances(x, c).argmin(1)


def lloyd(x: np.ndarray, c: np.ndarray, steps: int = 1) -> np.ndarray:
    """Centres after some Lloyd steps; an empty cell keeps its centre."""
    for _ in range(steps):
        code = nearest(x, c)
        count = np.bincount(code, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, code, x)
        c = np.where(count[:, None] > 0, np.round(total / np.maximum(count, 1)[:, None], DECIMALS), c)
    return c


def half(x: np.ndarray) -> np.ndarray:
    """Rounding to IEEE half precision, kept as doubles."""
    return x.astype(np.float16).astype(np.float64)


def train_rq(x: np.ndarray, cfg: PanelConfig, steps: int = 1) -> np.ndarray:
    """[stages, codes, dim]. x is in seeded order; stage t starts from the residuals of rows t*codes.. of it, and from zeros
    where there are no more rows."""
    books, residual = [], x
    for t in range(cfg.stages):
        start = residual[t * cfg.codes : (t + 1) * cfg.codes]
        book = lloyd(residual, np.concatenate((start, np.zeros((cfg.codes - len(start), x.shape[1])))), steps)
        books.append(book)
        residual = residual - book[nearest(residual, book)]
    return np.array(books)


def encode_rq(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Greedy codes [rows, stages]."""
    codes, residual = [], x
    for book in books:
        code = nearest(residual, book)
        codes.append(code)
        residual = residual - book[code]
    return np.array(codes).T


def encode_beam(x: np.ndarray, books: np.ndarray, width: int = 5) -> np.ndarray:
    """Codes by beam search over partial codes: the `width` best of every stage survive."""
    n = len(x)
    residual, codes = x[:, None], np.empty((n, 1, 0), np.int64)
    for book in books:
        d = ((residual[:, :, None] - book) ** 2).sum(-1).reshape(n, -1)
        keep = np.argsort(d, axis=1, kind="stable")[:, :width]
        parent, code = keep // len(book), keep % len(book)
        codes = np.concatenate((np.take_along_axis(codes, parent[:, :, None], 1), code[:, :, None]), 2)
        residual = np.take_along_axis(residual, parent[:, :, None], 1) - book[code]
    return codes[:, 0]


def refine_lsq(x: np.ndarray, books: np.ndarray, rounds: int = 4, sweeps: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Local-search quantiser: codebooks by least squares given codes, codes by coordinate descent given codebooks."""
    stages, k, dim = books.shape
    codes = encode_beam(x, books)
    for _ in range(rounds):
        hot = np.zeros((len(x), stages * k))
        hot[np.arange(len(x))[:, None], codes + np.arange(stages) * k] = 1
        books = np.linalg.solve(hot.T @ hot + 1e-3 * np.eye(stages * k), hot.T @ x + 1e-3 * books.reshape(-1, dim)).reshape(stages, k, dim)
        codes = sweep(x, books, codes, sweeps)
    return books, codes


def sweep(x: np.ndarray, books: np.ndarray, codes: np.ndarray, sweeps: int) -> np.ndarray:
    """Iterated conditional modes: each stage's code is chosen given the others; error never rises."""
    codes = codes.copy()
    for _ in range(sweeps):
        for s in range(len(books)):
            rest = x - sum(books[t][codes[:, t]] for t in range(len(books)) if t != s)
            codes[:, s] = nearest(rest, books[s])
    return codes


def train_pq(x: np.ndarray, parts: int, codes: int, steps: int = 1) -> np.ndarray:
    """[parts, codes, dim / parts]; part m starts from the first rows' sub-vectors."""
    if x.shape[1] % parts:
        raise ValueError("parts must divide the dimension")
    sub = x.reshape(len(x), parts, x.shape[1] // parts)
    start = np.concatenate((sub[:codes], np.zeros((max(0, codes - len(sub)), *sub.shape[1:]))))
    return np.array([lloyd(sub[:, m], start[:, m], steps) for m in range(parts)])


def encode_pq(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    sub = x.reshape(len(x), len(books), -1)
    return np.array([nearest(sub[:, m], books[m]) for m in range(len(books))]).T


def decode_pq(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return np.concatenate([books[m][codes[:, m]] for m in range(len(books))], 1)


def train_opq(x: np.ndarray, parts: int, codes: int, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Rotation [dim, dim] and product codebooks, alternating with orthogonal Procrustes."""
    rotation = np.eye(x.shape[1])
    books = train_pq(x, parts, codes)
    for _ in range(rounds):
        turned = x @ rotation
        sub = turned.reshape(len(x), parts, -1)
        books = np.array([lloyd(sub[:, m], books[m], 1) for m in range(parts)])
        u, _, v = np.linalg.svd(x.T @ decode_pq(encode_pq(turned, books), books))
        rotation = u @ v
    return rotation, books


def train_split(x: np.ndarray, splits: int, cfg: PanelConfig, refine: bool) -> list[np.ndarray]:
    """Residual codebooks for each of some sub-vectors (refine: least-squares refined)."""
    out = []
    for sub in np.split(x, splits, axis=1):
        books = train_rq(sub, cfg, 4)
        out.append(refine_lsq(sub, books)[0] if refine else books)
    return out


def query_matrices(queries: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Per cluster, the softmax-weighted second moment of the queries: sum_q softmax_q(q.c) q q'."""
    logits = queries @ centres.T
    w = np.exp(logits - logits.max(0))
    return np.einsum("qk,qd,qe->kde", w / w.sum(0), queries, queries)


def encode_query_aware(x: np.ndarray, books: np.ndarray, cluster: np.ndarray, matrices: np.ndarray, sweeps: int = 3) -> np.ndarray:
    """Product codes minimising (x - x^)' A (x - x^) of the row's cluster by coordinate descent over sub-spaces."""
    codes = encode_pq(x, books)
    width = books.shape[2]
    for _ in range(sweeps):
        for m in range(len(books)):
            cut = slice(m * width, (m + 1) * width)
            error = x - decode_pq(codes, books)
            error[:, cut] = 0
            rest = x[:, None, cut] - books[m]
            a = matrices[cluster]
            cross = np.einsum("nd,ndw->nw", error, a[:, :, cut])
            cost = np.einsum("nkw,nwv,nkv->nk", rest, a[:, cut, cut], rest) + 2 * np.einsum("nkw,nw->nk", rest, cross)
            codes[:, m] = np.round(cost, DECIMALS).argmin(1)
    return codes


def update_query_aware(x: np.ndarray, codes: np.ndarray, cluster: np.ndarray, matrices: np.ndarray, shape: tuple[int, int, int], ridge: float = 1e-3) -> np.ndarray:
    """Product codebooks that minimise the sum of (x - x^)' A (x - x^), A the matrix of the row's cluster, given the codes.

    All codewords are unknowns of one system: blocks (m, a), (n, b) hold the sum of A[m, n] over the rows with code a in
    part m and b in part n, that is, co-occurrence counts by cluster times the clusters' matrices.
    """
    parts, k, width = shape
    left = np.zeros((parts, k, width, parts, k, width))
    right = np.zeros((parts, k, width))
    for c, a in enumerate(matrices):
        own, rows = codes[cluster == c], x[cluster == c]
        hot = np.zeros((len(own), parts, k))
        hot[np.arange(len(own))[:, None], np.arange(parts), own] = 1
        counts = np.einsum("nma,npb->mapb", hot, hot)
        blocks = a.reshape(parts, width, parts, width)
        left += np.einsum("mapb,mipj->maipbj", counts, blocks)
        right += np.einsum("nma,nmi->mai", hot, (rows @ a).reshape(len(rows), parts, width))
    size = parts * k * width
    return np.linalg.solve(left.reshape(size, size) + ridge * np.eye(size), right.ravel()).reshape(shape)


def train_query_aware(x: np.ndarray, books: np.ndarray, centres: np.ndarray, matrices: np.ndarray, rounds: int = 3) -> np.ndarray:
    """Codebooks after some rounds of encoding and updating under the clusters' query matrices."""
    cluster = nearest(x, centres)
    for _ in range(rounds):
        books = update_query_aware(x, encode_query_aware(x, books, cluster, matrices), cluster, matrices, books.shape)
    return books


def block_covariance(queries: np.ndarray, parts: int) -> np.ndarray:
    """[parts, width, width], not centred."""
    sub = queries.reshape(len(queries), parts, -1)
    return np.einsum("qmi,qmj->mij", sub, sub) / len(queries)


def assign_mahalanobis(x: np.ndarray, books: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Per block, the code minimising -2 x S c + c S c."""
    sub = x.reshape(len(x), len(books), -1)
    out = [np.round(-2 * sub[:, m] @ cov[m] @ books[m].T + np.einsum("kw,wv,kv->k", books[m], cov[m], books[m]), DECIMALS).argmin(1) for m in range(len(books))]
    return np.array(out).T


def train_covariance(x: np.ndarray, queries: np.ndarray, parts: int, codes: int, most: int = 50, stop: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Codebooks under query covariance: Mahalanobis assignment, Euclidean means, until the cost changes by 1 % or less."""
    cov = block_covariance(queries, parts)
    sub = x.reshape(len(x), parts, -1)
    start = np.concatenate((sub[:codes], np.zeros((max(0, codes - len(sub)), *sub.shape[1:]))))
    books = np.array([start[:, m] for m in range(parts)])
    before = np.inf
    for _ in range(most):
        code = assign_mahalanobis(x, books, cov)
        for m in range(parts):
            count = np.bincount(code[:, m], minlength=codes)
            total = np.zeros_like(books[m])
            np.add.at(total, code[:, m], sub[:, m])
            books[m] = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], books[m])
        error = sub - np.stack([books[m][code[:, m]] for m in range(parts)], 1)
        cost = np.einsum("nmi,mij,nmj->", error, cov, error)
        if before - cost <= stop * before < np.inf:
            break
        before = cost
    return books, cov


def prefixes(codes: np.ndarray, books: np.ndarray, lengths: tuple[int, ...]) -> np.ndarray:
    """Reconstructions [rows, options, dim] of the prefix lengths."""
    parts = np.stack([books[s][codes[:, s]] for s in range(lengths[-1])], 1)
    return np.cumsum(parts, 1)[:, [length - 1 for length in lengths]]


def pack_symbols(codes: np.ndarray, bits: int) -> bytes:
    """Little-endian fixed-width bit stream over all symbols, row after row."""
    flat = codes.astype(np.uint32).ravel()
    each = (flat[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(each.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_symbols(data: bytes, count: int, bits: int) -> np.ndarray:
    each = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=count * bits).reshape(count, bits)
    return (each.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1)


def training_rows(pool: DataFrame, cfg: PanelConfig) -> np.ndarray:
    """The sample that codebooks are fitted on: the first `train_rows` of the pool in seeded order."""
    rows = ranked(pool.select("item_id", "x"), cfg.seed + 6, "_k").where(F.col("_k") < cfg.train_rows).orderBy("_k").select("x").toArrow()
    return matrix(rows.column("x").combine_chunks())


def encode_table(rows: DataFrame, encode) -> DataFrame:
    """rows with codes: encode maps a batch's matrix to integer codes."""
    columns = rows.columns

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                codes = np.asarray(encode(matrix(batch.column("x"))), np.int32)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * codes.shape[1]), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), flat], [*columns, "codes"])

    return rows.mapInArrow(run, _with_codes(rows))


def _with_codes(rows: DataFrame):
    from pyspark.sql import types as T

    return T.StructType([*rows.schema.fields, T.StructField("codes", T.ArrayType(T.IntegerType()))])
