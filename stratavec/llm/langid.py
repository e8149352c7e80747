"""Language identification by multilingual mixture inference.

Training counts hashed character n-grams (within lower-cased words, edges marked) of all labelled training documents,
one bounded count table a language. For a document, every word has a likelihood under each language from its n-grams;
expectation-maximisation over the words estimates the document's language proportions. The language set is chosen
by penalised likelihood: nested sets by estimated proportion, each refitted, scored by 2 * log-likelihood less
`penalty` * log(words) a language.

Defined results: a null text, or one without a letter, is `und` with score 0; rows are judged one by one, repeated or
not; an empty table gives an empty result; without any training row every document is `und`; extra columns are ignored
by the query and kept by the stage, whatever their names; texts of any length are read whole. Ties go to the language that
sorts first. More than `MAX_LABELS` labels are refused: the model has a row a label, so their number must have a bound.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavec.llm.common import small_batches, table, tidied, unused
from stratavec.llm.textbytes import BYTE_LOWER, Texts, mix, slices

#: n-gram buckets: the model is this many rows a language, whatever the corpus.
BUCKETS = 1 << 15
ORDER = 3
EM_STEPS = 8
PENALTY = 4.0
SMOOTHING = 0.2
MAX_LABELS = 1000
_BYTES = mix(BYTE_LOWER)
_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def grams(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every byte n-gram that starts in a word or on the white space before it; the word of each; word documents.

    White space of any kind reads as one separator; an n-gram belongs to the word in which it ends its first two bytes.
    """
    codes = _BYTES[t.buf]
    codes[(t.buf == 32) | ((t.buf >= 9) & (t.buf <= 13))] = 0
    padded = np.concatenate((np.zeros(1, np.uint64), codes, np.zeros(1, np.uint64)))
    gram = mix(padded[:-2] * _MUL[0] + padded[1:-1] * _MUL[1] + padded[2:] * _MUL[2])
    ws, we, wd = t.words()
    inside = codes != 0
    bucket = (gram[inside] & np.uint64(BUCKETS - 1)).astype(np.int32)
    starts = np.concatenate(([0], np.cumsum(we - ws)[:-1])).astype(np.int64) if len(ws) else np.empty(0, np.int64)
    return bucket, starts, wd, we - ws


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and the log-probability table [BUCKETS, languages] of documents (text, lang); lang null rows are left out.

    The counts come back as one row a (language, n-gram bucket): bounded by the label set and BUCKETS, not by the corpus.
    """

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for whole in batches:
            for batch in slices(whole, "text"):
                t = Texts(batch.column("text"))
                bucket, starts, wd, sizes = grams(t)
                langs = batch.column("lang").to_pylist()
                doc = np.repeat(wd, sizes)
                names = sorted(set(langs))
                code = np.array([names.index(x) for x in langs])[doc] if len(doc) else np.empty(0, np.int64)
                got = np.bincount(code * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
                for name, row in zip(names, got, strict=True):
                    counts[name] = counts.get(name, 0) + row
        for name, row in counts.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(row[at].astype(np.int64))], ["lang", "bucket", "n"])

    docs = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang")
    if docs.select("lang").distinct().limit(MAX_LABELS + 1).count() > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} distinct labels in lang")
    rows = docs.mapInArrow(tidied(run), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(rows.column("lang").to_pylist()))
    counts = np.zeros((BUCKETS, len(langs)))
    code = {x: i for i, x in enumerate(langs)}
    counts[rows.column("bucket").to_numpy(), [code[x] for x in rows.column("lang").to_pylist()]] = rows.column("n").to_numpy()
    smooth = counts + SMOOTHING
    return langs, np.log(smooth / smooth.sum(0, keepdims=True)).astype(np.float32) if langs else counts.astype(np.float32)


def _refit(like: np.ndarray, wd: np.ndarray, first: np.ndarray, docs: np.ndarray, share: np.ndarray, n_words: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after some steps of expectation-maximisation, and the mixture's log-likelihood (less the words' maxima)."""
    for _ in range(steps):
        joint = like * share[wd]
        total = joint.sum(1)
        joint /= np.maximum(total, 1e-300)[:, None]
        new = np.zeros_like(share)
        new[docs] = np.add.reduceat(joint, first, axis=0)
        share = new / np.maximum(n_words, 1)[:, None]
    total = (like * share[wd]).sum(1)
    fit = np.zeros(len(share))
    fit[docs] = np.add.reduceat(np.log(np.maximum(total, 1e-300)), first)
    return share, fit


def infer(t: Texts, table_: np.ndarray) -> np.ndarray:
    """Language proportions [documents, languages] of the chosen sets."""
    n, k = t.n, table_.shape[1]
    share = np.zeros((n, k))
    bucket, starts, wd, _ = grams(t)
    if not len(wd) or not k:
        return share
    word = np.add.reduceat(table_[bucket], starts, axis=0).astype(np.float64)
    like = np.exp(np.maximum(word - word.max(1, keepdims=True), -60))
    docs, first = np.unique(wd, return_index=True)
    n_words = np.bincount(wd, minlength=n)
    full, _ = _refit(like, wd, first, docs, np.full((n, k), 1 / k), n_words, EM_STEPS)
    rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1, kind="stable")
    best = np.full(n, -np.inf)
    for size in range(1, k + 1):
        allowed = np.where(rank < size, np.maximum(full, 1e-6), 0)
        got, fit = _refit(like, wd, first, docs, allowed / allowed.sum(1, keepdims=True), n_words, EM_STEPS if size > 1 else 0)
        score = 2 * fit - PENALTY * size * np.log(np.maximum(n_words, 2))
        better = score > best
        best[better], share[better] = score[better], got[better]
    return share


def _has_letter(raw: bytes) -> bool:
    return any(map(str.isalpha, raw.decode("utf-8", "replace")))


NAMES = ("lang_pred", "score", "lang_shares")


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], names: tuple[str, str, str] = NAMES) -> DataFrame:
    """All columns of docs, and by these names the language, the score (its proportion) and a map of the chosen set's shares."""
    from pyspark.sql import types as T

    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    keep = list(docs.columns)
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.MapType(T.StringType(), T.DoubleType()))])

    def run(batches):
        langs, weights = sent.value
        for whole in batches:
            for batch in slices(whole, "text"):
                t = Texts(batch.column("text"))
                share = infer(t, weights)
                known = np.array([_has_letter(r) for r in t.raw], bool) & (share.sum(1) > 0 if len(langs) else False)
                top = share.argmax(1) if len(langs) else np.zeros(t.n, int)
                pred = pa.array([langs[i] if ok else "und" for i, ok in zip(top, known, strict=True)], pa.string())
                score = pa.array([min(1.0, float(share[d, i])) if ok else 0.0 for d, (i, ok) in enumerate(zip(top, known, strict=True))], pa.float64())
                maps = [[(langs[i], float(row[i])) for i in np.flatnonzero(row > 0)] if ok else [] for row, ok in zip(share, known, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pred, score, pa.array(maps, pa.map_(pa.string(), pa.float64()))], [*keep, *names])

    return docs.mapInArrow(tidied(run), schema)


def held_out(doc_id: str = "doc_id"):
    """Documents never trained on: crc32 of the id as text, modulo 4, is 2. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train_split(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    return train(docs.where(~held_out()))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    model = train_split(docs.select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "lang_shares")


#: Share of the winning language under which the pipeline's stage takes a document as unidentified.
MIN_SHARE = 0.3


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rejects documents without an identified language; the rest keep their columns, lang becomes the prediction."""
    small_batches(spark)
    model = train_split(docs.select("doc_id", "text", "lang"))
    columns, names = docs.columns, tuple(unused(docs.columns, *NAMES))
    found = identify(docs, model, names).where((F.col(names[0]) != "und") & (F.col(names[1]) >= MIN_SHARE))
    return found.withColumn("lang", F.col(names[0])).select(*columns)
