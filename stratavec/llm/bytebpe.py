"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut before encoding at safe boundaries only: between a character that is not white space and white
space after it. Every alternative of the pattern takes white space only in front, so such a place always lies
between two matches, and the look-ahead for a run's last white space is not affected.

Defined results: null and empty texts encode to no ids; texts of any length are encoded whole; repeated rows, empty
tables and extra columns need nothing special. Decoding joins raw bytes, so it also holds ids that split a character.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from stratavec.llm.common import table

#: Characters in one call of the encoder, about.
PART_CHARS = 1 << 16
_BOUNDARY = re.compile(r"(?<=\S)(?=\s)")


@cache
def encoding(rank_file: str, pattern: str):
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, size: int = PART_CHARS) -> list[str]:
    """The text in parts of at least `size` characters, cut at safe boundaries; without such a place it stays whole."""
    parts, at = [], 0
    while len(text) - at > size:
        found = _BOUNDARY.search(text, at + size)
        if not found:
            break
        parts.append(text[at : found.start()])
        at = found.start()
    return [*parts, text[at:]]


def encode(text: str, rank_file: str, pattern: str) -> np.ndarray:
    enc = encoding(rank_file, pattern)
    return np.array([i for part in safe_parts(text) for i in enc.encode_ordinary(part)], dtype="<u4")


def decode(ids: np.ndarray, rank_file: str, pattern: str) -> bytes:
    return encoding(rank_file, pattern).decode_bytes(ids.tolist())


def encode_table(docs: DataFrame, rank_file: str, pattern: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit, binary; null unless keep_ids), ids_sha256, decoded_sha256."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n, raw, a, b = [], [], [], []
                for text in part.column("text").to_pylist():
                    ids = encode(text or "", rank_file, pattern)
                    n.append(len(ids))
                    data = ids.tobytes()
                    raw.append(data if keep_ids else None)
                    a.append(hashlib.sha256(data).hexdigest())
                    b.append(hashlib.sha256(decode(ids, rank_file, pattern)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(raw, pa.binary()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string")


def decode_table(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id and the decoded bytes of a table with column ids as encode_table returns it."""

    def run(batches):
        for batch in batches:
            data = [decode(np.frombuffer(x or b"", "<u4"), rank_file, pattern) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    return encode_table(table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN, keep_ids=False).drop("ids")
