"""Distortions of prefix reconstructions as queries see them.

x is [rows, dim], rebuilt [rows, options, dim]; results are [rows, options]. `cosine` measures against the reconstruction
at unit length, otherwise against the reconstruction itself.
"""

from __future__ import annotations

import numpy as np


def errors(x: np.ndarray, rebuilt: np.ndarray, cosine: bool) -> np.ndarray:
    if cosine:
        rebuilt = rebuilt / np.maximum(np.sqrt((rebuilt**2).sum(-1, keepdims=True)), 1e-9)
    return x[:, None] - rebuilt


def query_ip(x: np.ndarray, rebuilt: np.ndarray, moment: np.ndarray, cosine: bool = True) -> np.ndarray:
    """e' S e for the queries' second moment S: the mean squared error of inner products."""
    e = errors(x, rebuilt, cosine)
    return np.einsum("nod,de,noe->no", e, moment, e, optimize=True)


def block_covariance(x: np.ndarray, rebuilt: np.ndarray, moments: np.ndarray, cosine: bool) -> np.ndarray:
    """Sum over blocks of e_m' S_m e_m; moments [blocks, width, width]."""
    e = errors(x, rebuilt, cosine)
    e = e.reshape(*e.shape[:2], len(moments), -1)
    return np.einsum("nomi,mij,nomj->no", e, moments, e, optimize=True)


def softmax_query(x: np.ndarray, rebuilt: np.ndarray, queries: np.ndarray, cosine: bool) -> np.ndarray:
    """Squared errors of inner products, weighted over the queries by the softmax of their scores with the row."""
    logits = x @ queries.T
    w = np.exp(logits - logits.max(1, keepdims=True))
    w /= w.sum(1, keepdims=True)
    e = errors(x, rebuilt, cosine)
    return np.einsum("nq,noq->no", w, np.einsum("nod,qd->noq", e, queries) ** 2)


def subspace_gain(x: np.ndarray, rebuilt: np.ndarray, parts: int) -> np.ndarray:
    """[rows, parts]: how much of a row's squared length each block of its reconstruction accounts for."""
    a, b = x.reshape(len(x), parts, -1), rebuilt.reshape(len(x), parts, -1)
    return (2 * a * b - b * b).sum(-1)
