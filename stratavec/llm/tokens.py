"""Token counts by the whole-token shortcut, for a SentencePiece BPE model with byte fallback.

Offline proofs over the vocabulary, made when the model is loaded and refused if they fail:

1. No piece has a white-space mark after another character, so no merge can cross the place before a mark that
   follows another character: the text's parts between such places ("pre-tokens") encode independently.
2. A vocabulary string counts as a whole token only if the library itself encodes it, alone, as exactly one token.

Pre-tokens in that proved set count 1 each; only the others are merged by the library, once per distinct string.

Defined results: null and empty texts have no tokens; repeated rows are counted one by one; an empty table gives an
empty result; extra columns are ignored; a text of any length is counted whole.
"""

from __future__ import annotations

import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavec.llm.common import table

MARK = "▁"
#: Distinct pre-tokens that a Python worker remembers before it starts afresh; those over CACHE_LENGTH characters only for
#: the texts at hand.
CACHE_ENTRIES = 200_000
CACHE_LENGTH = 40
LIMIT = 4096


class PieceCounter:
    def __init__(self, model_file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("a piece crosses a word start: pre-tokens of this model do not encode independently")
        words = [p[1:] for p in pieces if p.startswith(MARK) and len(p) > 1 and MARK not in p[1:]]
        self.whole = {w for w, ids in zip(words, self.model.encode(words, num_threads=1), strict=True) if len(ids) == 1}
        self.seen: dict[str, int] = {}
        self.runs: dict[int, int] = {}

    def marks(self, k: int) -> int:
        """Tokens of k white-space marks at a text's end."""
        if k not in self.runs:
            self.runs[k] = len(self.model.encode("a" + " " * k)) - 1
        return self.runs[k]

    def count(self, texts: list[str]) -> list[int]:
        if len(self.seen) > CACHE_ENTRIES:
            self.seen = {}
        seen, whole, todo, parts = self.seen, self.whole, set(), []
        for text in texts:
            words = text.replace(MARK, " ").split(" ") if text else []
            parts.append(words)
            todo.update(words)
        todo = [w for w in todo if w and w not in seen]
        merged = [w for w in todo if w not in whole]
        seen.update((w, 1) for w in todo if w in whole)
        seen.update(zip(merged, map(len, self.model.encode(merged, num_threads=1)) if merged else (), strict=True))
        counted = [self._total(words) for words in parts]
        for w in [w for w in merged if len(w) > CACHE_LENGTH]:
            del seen[w]
        return counted

    def _total(self, words: list[str]) -> int:
        """The text's pre-tokens are its words, each with the mark before it; several marks join the word after them."""
        if "" not in words:
            return sum(map(self.seen.__getitem__, words))
        total, gap = 0, 0
        for w in words:
            if not w:
                gap += 1
            elif gap:
                key = " " * gap + w
                many = self.seen.get(key)
                if many is None:
                    many = len(self.model.encode(key))
                    if len(key) <= CACHE_LENGTH:
                        self.seen[key] = many
                total, gap = total + many, 0
            else:
                total += self.seen[w]
        return total + (self.marks(gap) if gap else 0)


@cache
def counter(model_file: str) -> PieceCounter:
    return PieceCounter(model_file)


def count_tokens(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every document under the model at model_file (a path that executors can open)."""

    def run(batches):
        count = counter(model_file).count
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [x or "" for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(count(texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
