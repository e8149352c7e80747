"""The corpus pipeline: stages from the documents table to packed training sequences.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame that is
written as Parquet and read again as the next one's input. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratavec.llm import langid, linededup, ngramjoin, packing, pii
from stratavec.llm.common import stored, table

STAGES = [
    ("language_id", langid.stage),
    ("line_dedup", linededup.stage),
    ("ngram_jaccard", ngramjoin.stage),
    ("pii", pii.stage),
    ("best_fit_packing", packing.stage),
]

#: Model inference, template trees and packing are beyond SQL; tests compare the stages with plain versions and check what run() returns.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = stored(stage(spark, docs, sf_dir), name)
    return docs
