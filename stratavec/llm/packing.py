"""Best-fit packing of tokenised documents into sequences of a fixed capacity, bulk-synchronously.

Documents over the capacity are cut into full pieces; the last may be shorter. Pieces and gaps are ordered by size. All
pieces of one size are interchangeable, and so are all sequences with one gap: a superstep takes the pieces of one size,
sweeps from that size to the successor gaps, smallest first, resolves which piece gets which gap by rank, updates the
gaps and repeats with the next smaller size; what finds no gap opens sequences. The sweep runs over counts by size (at
most `capacity` numbers, whatever the corpus); the ranks within a size are computed where the pieces are: a number
within the task that read them, plus the tasks before it. No piece leaves the executors, no size meets in one task.

Defined results: a null or empty text is one piece holding the separator; repeated rows are packed one by one; an empty
table gives an empty result; extra columns are ignored; texts of any length are tokenised whole.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratavec.llm.common import arrow_rows, remembered, small_batches, stored, table, tidied
from stratavec.llm.textbytes import slices

CAPACITY = 2048
SEPARATOR = b"\0\0\0\0"
#: Words and pre-tokens of at most CACHE_LENGTH characters that a Python worker remembers of late: at most twice as many
#: distinct ones, some 140 MB in all. Longer ones are never remembered.
CACHE_WORDS = 100_000
CACHE_PARTS = 250_000
CACHE_LENGTH = 40
#: Words of visible ASCII and of letters from À to ſ, each lower-cased to one letter and unchanged by normalisation.
_PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ſ]+")
#: The tokenizer's pre-token pattern on such words in lower case (a fixed value of the vocabulary file).
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^\sa-z0-9ß-öø-ſ]+")


class _Recent(dict):
    """Ids by word; a word not seen of late is encoded when it is asked for."""

    def __init__(self, encode, most: int):
        self.encode, self.most, self.before = encode, most, {}

    def __missing__(self, word):
        got = self.before.get(word)
        if got is None:
            got = self.encode(word)
        if len(word) <= CACHE_LENGTH:
            if len(self) >= self.most:
                self.before = dict(self)
                self.clear()
            self[word] = got
        return got


class WordEncoder:
    """Ids of a text, as little-endian unsigned 32-bit bytes, word by word through the library's own parts.

    The tokenizer drops white space and none of its pre-tokens spans any, so words encode independently.
    """

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.special = [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        if not all(s.startswith("<|") for s in self.special):
            raise ValueError("a special token does not start with <|")
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        self.bytes_as_text = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.words = _Recent(self._word, CACHE_WORDS)
        self.parts = _Recent(lambda part: self._mapped(part.encode().decode("latin-1").translate(self.bytes_as_text)), CACHE_PARTS)

    def _ids(self, ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def _mapped(self, text: str) -> bytes:
        return self._ids([t.id for t in self.tokenizer.model.tokenize(text)])

    def _word(self, raw: bytes) -> bytes:
        word = raw.decode()
        if "<|" in word and any(s in word for s in self.special):
            return self._ids(self.tokenizer.encode(word, add_special_tokens=False).ids)
        if _PLAIN.fullmatch(word):
            return b"".join(map(self.parts.__getitem__, _PARTS.findall(word.lower())))
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(word))
        return b"".join([self._mapped(p) for p, _ in split])

    def encode(self, raws: list[bytes]) -> list[bytes]:
        get = self.words.__getitem__
        return [b"".join(map(get, raw.split())) for raw in raws]


def encoder(tokenizer_file: str) -> WordEncoder:
    return remembered(f"packing:{tokenizer_file}", lambda: WordEncoder(tokenizer_file))


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, number long, ids binary"


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """A row per piece, with the task that made it and its number among that task's pieces of its length."""

    def run(batches):
        encode, task = encoder(tokenizer_file).encode, TaskContext.get().partitionId()
        made: defaultdict[int, int] = defaultdict(int)
        for whole in batches:
            for batch in slices(whole, "text"):
                raws = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
                out: list[list] = [[] for _ in range(8)]
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(raws), strict=True):
                    ids += SEPARATOR
                    total = len(ids) // 4
                    for k, start in enumerate(range(0, total, capacity)):
                        length = min(capacity, total - start)
                        cut = ids[4 * start : 4 * (start + length)]
                        for column, value in zip(out, (doc_id, k, start, length, zlib.crc32(cut), task, made[length], cut if keep_ids else None), strict=True):
                            column.append(value)
                        made[length] += 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(tidied(run, "packing:"), PIECES)


def best_fit_plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Runs (size, first rank, first sequence, pieces a sequence, offset of the first) that place every rank of every size.

    Pieces of a run fill sequence after sequence. Sizes descend; each takes the smallest gaps that hold it, and a gap is
    filled with as many of the size as it holds, which is what best fit does with equal pieces.
    """
    gaps: defaultdict[int, list[tuple[int, int]]] = defaultdict(list)
    runs, opened = [], 0

    def place(size: int, rank: int, left: int, first: int, many: int, gap: int) -> int:
        """Put up to `left` pieces into `many` equal gaps; returns how many were put."""
        each = gap // size
        full = min(many, left // each)
        put = full * each
        if full:
            runs.append((size, rank, first, each, capacity - gap))
            gaps[gap - each * size].append((first, full))
        rest = left - put if full < many else 0
        if rest:
            runs.append((size, rank + put, first + full, rest, capacity - gap))
            gaps[gap - rest * size].append((first + full, 1))
        used = full + (rest > 0)
        if used < many:
            gaps[gap].append((first + used, many - used))
        return put + rest

    for size in sorted((s for s in counts if counts[s]), reverse=True):
        left, rank = counts[size], 0
        for gap in range(size, capacity):
            while left and gaps[gap]:
                first, many = gaps[gap].pop()
                put = place(size, rank, left, first, many, gap)
                left, rank = left - put, rank + put
            if not left:
                break
        if left:
            many = -(-left // (capacity // size))
            place(size, rank, left, opened, many, capacity)
            opened += many
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, with keep_ids) of every piece."""
    spark = docs.sparkSession
    with arrow_rows(spark, 2000):
        made, _ = stored(pieces(docs, tokenizer_file, capacity, keep_ids), "pieces")
    by_task = made.groupBy("length", "task").agg(F.count(F.lit(1)).alias("many"))
    counts = {r.length: r.many for r in by_task.groupBy("length").agg(F.sum("many").alias("many")).collect()}
    plan = spark.sparkContext.broadcast(best_fit_plan(counts, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.select("length", "task", F.coalesce(F.sum("many").over(before), F.lit(0)).alias("ahead"))
    ranked = made.join(offsets, ["length", "task"]).withColumn("rank", F.col("ahead") + F.col("number"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]

    def run(batches):
        runs = plan.value
        keys = (runs[:, 0] << 44) + runs[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            got = runs[np.searchsorted(keys, (length << 44) + rank, "right") - 1] if len(length) else np.empty((0, 5), np.int64)
            past = rank - got[:, 1]
            sequence = got[:, 2] + past // np.maximum(got[:, 3], 1)
            offset = got[:, 4] + past % np.maximum(got[:, 3], 1) * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, " + "ids binary, " * keep_ids + "sequence_id long, offset long"
    return ranked.select(*columns, "rank").mapInArrow(tidied(run), schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves (sequence_id, ids as little-endian unsigned 32-bit bytes) of pack(keep_ids=True).

    A sequence holds at most `capacity` pieces, so each group is bounded.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.aggregate("parts", F.lit(b""), lambda done, p: F.concat(done, p.ids)).alias("ids"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the kept documents, packed."""
    return pack(docs, tokenizer_path())
