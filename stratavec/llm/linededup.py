"""Line deduplication by a log-template tree of fixed depth.

A line is parsed by its number of tokens, then by its leading tokens; tokens with a digit count as variable throughout.
At a leaf, a token is a literal of its position if it stands there in at least `min_docs` distinct texts (copies of a
text count once), else the position generalises to a variable field. The line's template is its literals and fields.
A template covers every line of the leaf that agrees at its literal positions, frequent forms too; a line goes to the most
general template that covers it. Templates with at least `min_literal` literal positions that recur in `min_docs` distinct texts are dropped; the first
occurrence of a template (smallest doc_id, then line) stays, so nothing is lost from the corpus as a whole.

Besides, every line that is not blank counts exactly as it stands, digits too and whatever its length, and drops if it
recurs in `min_docs` distinct texts, its first occurrence apart; one of more than `LONG_TOKENS` tokens, which does not
recur by chance, from `LONG_DOCS` distinct texts on.

Everything is counted with partial aggregation over hashed keys: no leaf meets in one task; which forms of a leaf are within
which others is found in tiles of bounded size. Only lines of leaves with enough texts and more than one form have their
tokens counted.

Defined results: lines with fewer than `min_tokens` tokens, or mostly of tokens with digits, never form a template, and blank lines always stay; null and empty texts pass unchanged;
repeated rows are equal texts and count once; rows that repeat a doc_id with the first occurrence's line at its number all
keep it; a null doc_id sorts first; an empty table gives an empty result; extra columns are kept, whatever their names (the
counts get names of their own). White space between tokens does not matter for equality; kept lines keep their bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratavec.llm.common import SLOTS, arrow_rows, bitmap, hit, settled, stored, table, tidied, unused
from stratavec.llm.textbytes import MULTIPLIERS, Texts, mix, slices

MIN_DOCS = 5
MIN_TOKENS = 3
MIN_LITERAL = 0.6
#: An exact line of more tokens than this is a passage, and drops from LONG_DOCS distinct texts on.
LONG_TOKENS = 50
LONG_DOCS = 2
#: Documents that go to Python at a time, so that a run of long ones stays small.
TEXT_ROWS = 1000
#: Literals of a leaf's forms that meet in one task on either side.
TILE = 1 << 19
#: Leading tokens that the tree branches on.
DEPTH = 3
_FIELD = np.uint64(0x5851F42D4C957F2D)


class Lines:
    """Keys of lines: document, number in the document, leaf, line hash, whether it is exact, whether it is long, token span.

    A line that can form a template has a key in its leaf, with digits masked; a line whose own bytes count has an exact
    key without a leaf, unless nothing of it is masked, when its one key serves both.
    """

    def __init__(self, t: Texts, min_tokens: int, min_literal: float):
        sums = t.sums()
        ws, we, _ = t.words()
        raw = sums.hash(ws, we)
        digit = np.concatenate(([0], np.cumsum((t.buf >= 48) & (t.buf <= 57), dtype=np.int64)))
        field = digit[we] > digit[ws]
        words = raw.copy()
        words[field] = _FIELD
        fields = np.concatenate(([0], np.cumsum(field, dtype=np.int64)))
        ls, le, ld = t.lines()
        first, last = np.searchsorted(ws, ls), np.searchsorted(ws, le)
        number = np.arange(len(ls)) - np.searchsorted(ls, t.starts)[ld]
        size, masked = last - first, fields[last] - fields[first]
        general = (size >= min_tokens) & (size - masked >= min_literal * size)
        exact = (size > 0) & ~(general & (masked == 0))
        up = np.full(len(words) + 1, MULTIPLIERS[7])
        up[0] = 1
        up = np.cumprod(up)
        down = np.full(len(words) + 1, np.uint64(pow(int(MULTIPLIERS[7]), -1, 2**64)))
        down[0] = 1
        down = np.cumprod(down)

        def line(of: np.ndarray, rows: np.ndarray) -> np.ndarray:
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(of * up[:-1])))
            return mix((total[last[rows]] - total[first[rows]]) * down[first[rows]] + size[rows].astype(np.uint64) * MULTIPLIERS[8])

        rows, own = np.flatnonzero(general), np.flatnonzero(exact)
        self.line = np.concatenate((line(words, rows), line(raw, own)))
        self.general = np.concatenate((np.ones(len(rows), bool), np.zeros(len(own), bool)))
        self.long = np.concatenate(((masked[rows] == 0) & (size[rows] > LONG_TOKENS), size[own] > LONG_TOKENS))
        rows = np.concatenate((rows, own))
        first, last, self.doc, self.number = first[rows], last[rows], ld[rows], number[rows]
        leaf = size[rows].astype(np.uint64) * MULTIPLIERS[9]
        for i in range(DEPTH):
            at = np.minimum(first + i, np.maximum(last - 1, 0))
            leaf = leaf + np.where(first + i < last, words[at] if len(words) else 0, 0).astype(np.uint64) * MULTIPLIERS[10 + i]
        self.leaf = mix(leaf)
        self.words, self.first, self.last = words, first, last
        self.text = sums.hash(t.starts, t.ends)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def line_rows(docs: DataFrame, min_tokens: int, min_literal: float) -> DataFrame:
    """(leaf, line, long, text, doc_id, number) of every key; leaf (null: exact only), line and text are hashes."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                x = Lines(Texts(batch.column("text")), min_tokens, min_literal)
                leaf = pa.array(x.leaf.view(np.int64), mask=~x.general)
                yield pa.RecordBatch.from_arrays([leaf, _signed(x.line), pa.array(x.long), _signed(x.text[x.doc]), batch.column("doc_id").cast(pa.int64()).take(pa.array(x.doc)), pa.array(x.number.astype(np.int32))], ["leaf", "line", "long", "text", "doc_id", "number"])

    return docs.select("doc_id", "text").mapInArrow(tidied(run), "leaf long, line long, long boolean, text long, doc_id long, number int")


def token_rows(docs: DataFrame, wanted: DataFrame, min_tokens: int, min_literal: float) -> DataFrame:
    """(line, tokens) once a task for the lines of wanted (slot of line); the bitmap may let others through."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(wanted))

    def run(batches):
        seen: set[int] = set()
        for whole in batches:
            for batch in slices(whole, "text"):
                x = Lines(Texts(batch.column("text")), min_tokens, min_literal)
                lines, tokens = [], []
                for i in np.flatnonzero(hit(bits.value, fold(x.line)) & x.general):
                    key = int(x.line[i])
                    if key not in seen:
                        seen.add(key)
                        lines.append(key)
                        tokens.append(x.words[x.first[i] : x.last[i]].view(np.int64))
                if len(seen) > 200_000:
                    seen.clear()
                if lines:
                    yield pa.RecordBatch.from_arrays([_signed(np.array(lines, np.uint64)), pa.array(tokens, pa.list_(pa.int64()))], ["line", "tokens"])

    return docs.select("text").mapInArrow(tidied(run), "line long, tokens array<long>")


_SLOT_BITS = np.uint64(SLOTS - 1)


def fold(line: np.ndarray) -> np.ndarray:
    """Position of a line hash in the membership bitmap: its low bits (F.expr in `_slot` computes the same)."""
    return (line & _SLOT_BITS).astype(np.int64)


def _mark(literals: str):
    """Hash of a set of literals (their positions differ)."""
    return F.aggregate(literals, F.lit(0).cast("long"), lambda seen, x: seen.bitwiseXOR(x.h))


def _slot(column: str):
    return F.col(column).bitwiseAND(F.lit(SLOTS - 1).cast("long")).alias("slot")


def subsets(small: tuple[np.ndarray, np.ndarray], big: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of small, row of big) of which the first set is within the second; sets are (entries end to end, sizes), none empty.

    An entry that a 64th of the big sets have is a bit a big set, others are lists of those that have them. A small set with
    such a list is looked for in the shortest one only, others by the bits they share: both read a 64th of all entries at most.
    """
    keys = np.unique(small[0])
    n, code = len(big[1]), np.searchsorted(keys, big[0])
    known = code < len(keys)
    known[known] = keys[code[known]] == big[0][known]
    code, row = code[known], np.repeat(np.arange(n), big[1])[known]
    first = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n))))
    holders = row[np.argsort(code, kind="stable")]
    count = np.bincount(code, minlength=len(keys))
    ends = np.cumsum(count)
    common = np.flatnonzero(count * 64 >= n)
    place = np.zeros(len(keys), np.int64)
    place[common] = np.arange(len(common))
    bits = np.zeros((len(common), -(-n // 8)), np.uint8)
    for at, c in enumerate(common):
        has = np.zeros(n, bool)
        has[holders[ends[c] - count[c] : ends[c]]] = True
        bits[at] = np.packbits(has)
    asked = np.zeros(len(keys), bool)
    lower, upper = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for at, entries in enumerate(np.split(np.searchsorted(keys, small[0]), np.cumsum(small[1])[:-1])):
        rarest = entries[count[entries].argmin()]
        if count[rarest] * 64 >= n:
            found = np.flatnonzero(np.unpackbits(np.bitwise_and.reduce(bits[place[entries]], axis=0), count=n))
        else:
            found = holders[ends[rarest] - count[rarest] : ends[rarest]]
            sizes = first[found + 1] - first[found]
            spots = np.arange(sizes.sum()) + np.repeat(first[found] - np.cumsum(sizes) + sizes, sizes)
            asked[entries] = True
            shared = np.bincount(np.repeat(np.arange(len(found)), sizes)[asked[code[spots]]], minlength=len(found))
            asked[entries] = False
            found = found[shared == len(entries)]
        lower.append(np.full(len(found), at))
        upper.append(found)
    return np.concatenate(lower), np.concatenate(upper)


def covering(forms: DataFrame) -> DataFrame:
    """(leaf, mark, template, size): for every form the forms of its leaf that are within it, itself included, and their sizes.

    forms: (leaf, mark, literals array of distinct hashes). Forms of a leaf with many meet in tiles of about TILE literals a side.
    """

    def run(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        sides = []
        for side in (True, False):
            rows = part.filter(pc.equal(part.column("template"), side)).combine_chunks()
            literals = rows.column("literals").combine_chunks()
            sizes = pc.list_value_length(literals).to_numpy(zero_copy_only=False).astype(np.int64)
            sides.append((rows.column("mark").to_numpy(), (literals.flatten().to_numpy(zero_copy_only=False), sizes)))
        (template, small), (mark, big) = sides
        a, b = subsets(small, big) if len(template) and len(mark) else (np.empty(0, np.int64), np.empty(0, np.int64))
        return pa.table({"leaf": pa.array(np.full(len(a), key[0].as_py())), "mark": pa.array(mark[b]), "template": pa.array(template[a]), "size": pa.array(small[1][a].astype(np.int32))})

    sizes = forms.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.sum(F.size("literals")) / F.lit(TILE)).alias("tiles"))
    placed = forms.join(sizes, "leaf")
    alone = placed.where("n = 1").select("leaf", "mark", F.col("mark").alias("template"), F.size("literals").alias("size"))
    own, other = F.pmod("mark", "tiles").alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other")
    many = placed.where("n > 1").select("leaf", "mark", "literals", own, other)
    lines = many.select("leaf", F.col("own").alias("i"), F.col("other").alias("j"), "mark", "literals", F.lit(False).alias("template"))
    templates = many.select("leaf", F.col("other").alias("i"), F.col("own").alias("j"), "mark", "literals", F.lit(True).alias("template"))
    found = lines.unionByName(templates).groupBy("leaf", "i", "j").applyInArrow(run, "leaf long, mark long, template long, size int")
    return alone.unionByName(found)


def recurring(docs: DataFrame, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, min_literal: float = MIN_LITERAL) -> DataFrame:
    """(line, template, texts, first_doc, first_number): lines of recurring templates, and each template's first occurrence."""
    with arrow_rows(docs.sparkSession, TEXT_ROWS):
        return _recurring(docs, min_docs, min_tokens, min_literal)


def _recurring(docs: DataFrame, min_docs: int, min_tokens: int, min_literal: float) -> DataFrame:
    rows = line_rows(docs, min_tokens, min_literal)
    by_text = rows.groupBy("leaf", "line", "long", "text").agg(F.min(F.struct("doc_id", "number")).alias("at"))
    by_text, _ = stored(by_text, "by_text")
    lines, _ = stored(by_text.groupBy("leaf", "line", "long").agg(F.count(F.lit(1)).alias("texts"), F.min("at").alias("at")), "lines")
    exact = lines.where(F.col("texts") >= F.when(F.col("long"), min(LONG_DOCS, min_docs)).otherwise(min_docs))
    open_leaves = lines.where("leaf IS NOT NULL").groupBy("leaf").agg(F.sum("texts").alias("n"), F.count(F.lit(1)).alias("forms")).where((F.col("n") >= min_docs) & (F.col("forms") > 1)).select("leaf")
    # Texts with several lines of a leaf are kept apart, to count once wherever those lines agree; the others may be summed.
    pairs = by_text.join(open_leaves, "leaf", "left_semi").select("leaf", "line", "text")
    several = pairs.groupBy("leaf", "text").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("leaf", "text")
    crowd, _ = stored(pairs.join(several, ["leaf", "text"], "left_semi"), "crowd")
    crowded = crowd.groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("n"))
    lone = (F.col("texts") - F.coalesce("n", F.lit(0))).alias("lone")
    loose, _ = stored(lines.join(open_leaves, "leaf", "left_semi").join(crowded, ["leaf", "line"], "left").select("leaf", "line", lone, "at"), "loose")

    def recurs(rows: DataFrame, keys: list[str], *columns) -> DataFrame:
        """Keys that stand in min_docs distinct texts, with their number; rows: leaf, line, lone and what columns need."""
        one = rows.select(*columns, F.col("lone").alias("n"))
        many = crowd.join(rows, ["leaf", "line"]).select(*columns, "text").distinct().select(*keys, F.lit(1).cast("long").alias("n"))
        return one.select(*keys, "n").unionByName(many).groupBy(*keys).agg(F.sum("n").alias("total")).where(F.col("total") >= min_docs)

    tokens = token_rows(docs, loose.select(_slot("line")), min_tokens, min_literal).dropDuplicates(["line"]).join(loose, "line")
    tokens, _ = stored(tokens, "tokens")
    literal = recurs(tokens, ["leaf", "pos", "token"], "leaf", F.posexplode("tokens").alias("pos", "token"))
    literal = literal.where(F.col("token") != F.lit(int(_FIELD)).cast("long")).select("leaf", "pos", "token")
    marked = tokens.select("leaf", "line", F.posexplode("tokens").alias("pos", "token")).join(literal, ["leaf", "pos", "token"])
    shape = marked.groupBy("leaf", "line").agg(F.array_sort(F.collect_list(F.struct("pos", F.xxhash64("pos", "token").alias("h")))).alias("literals"))
    shaped = tokens.join(shape, ["leaf", "line"]).where(F.size("literals") >= F.lit(min_literal) * F.size("tokens"))
    shaped, _ = stored(shaped.select("leaf", "line", "lone", "at", "literals", _mark("literals").alias("mark")), "shaped")
    # A template also covers lines that hold more literals than it: those of the leaf that agree with it wherever it is literal.
    forms, _ = stored(shaped.groupBy("leaf", "mark").agg(F.transform(F.min("literals"), lambda x: x.h).alias("literals")), "forms")
    covers, _ = stored(covering(forms), "covers")
    general = recurs(shaped.join(covers, ["leaf", "mark"]), ["leaf", "template"], "leaf", "template")
    # Every line goes to one template, the most general, so that first occurrences of templates never drop one another.
    chosen = covers.join(general, ["leaf", "template"]).groupBy("leaf", "mark").agg(F.min(F.struct("size", "template", "total")).alias("best")).select("leaf", "mark", "best.template", "best.total")
    taken = shaped.join(chosen, ["leaf", "mark"])
    first = taken.groupBy("leaf", "template").agg(F.min("at").alias("first"))
    merged = taken.join(first, ["leaf", "template"]).select("line", F.xxhash64("leaf", "template").alias("template"), F.col("total").alias("texts"), F.col("first.doc_id").alias("first_doc"), F.col("first.number").alias("first_number"))
    merged, _ = stored(merged, "merged")
    alone = exact.select("line", F.col("line").alias("template"), "texts", F.col("at.doc_id").alias("first_doc"), F.col("at.number").alias("first_number"))
    return alone.join(merged.select("line"), "line", "left_anti").unionByName(merged)


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, min_literal: float = MIN_LITERAL) -> DataFrame:
    """docs with text without the dropped lines, then n_lines and n_dropped (names with underscores before where docs has these).

    Documents without any recurring line (by a fixed-size bitmap) are not shuffled.
    """
    spark, columns = docs.sparkSession, docs.columns
    known = settled(spark, lambda: recurring(docs, min_docs, min_tokens, min_literal), "recurring")
    bits = spark.sparkContext.broadcast(bitmap(known.select(_slot("line"))))
    row_, lines_, hits_, gone_, n_lines_, n_dropped_ = unused(columns, "row_key", "line_count", "line_hits", "lines_gone", "n_lines", "n_dropped")
    names = [*columns, row_, lines_, hits_]
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string(f"{row_} string, {lines_} int, {hits_} array<struct<line:bigint,number:int>>").fields])

    def run(batches):
        import uuid

        task, at = uuid.uuid4().hex, 0
        for whole in batches:
            for batch in slices(whole, "text"):
                t = Texts(batch.column("text"))
                x = Lines(t, min_tokens, min_literal)
                keep = hit(bits.value, fold(x.line))
                hits: list[list] = [[] for _ in range(t.n)]
                for d, line, number in zip(x.doc[keep], x.line[keep].view(np.int64), x.number[keep], strict=True):
                    hits[d].append({"line": int(line), "number": int(number)})
                rows = [f"{task}:{at + i}" for i in range(t.n)]
                at += t.n
                n_lines = [r.count(b"\n") + 1 if r else 0 for r in t.raw]
                kind = pa.list_(pa.struct([("line", pa.int64()), ("number", pa.int32())]))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(rows), pa.array(n_lines, pa.int32()), pa.array(hits, kind)], names)

    with arrow_rows(spark, TEXT_ROWS):
        marked, _ = stored(docs.mapInArrow(tidied(run), schema), "marked")
    hits = marked.where(F.size(hits_) > 0)
    found = hits.select(row_, "doc_id", F.inline(hits_)).join(known, "line").where("NOT (doc_id <=> first_doc AND number = first_number)")
    gone = found.groupBy(row_).agg(F.collect_set("number").alias(gone_))
    some = hits.join(gone, row_, "left").withColumn(gone_, F.coalesce(gone_, F.array().cast("array<int>")))
    none = marked.where(F.size(hits_) == 0).withColumn(gone_, F.array().cast("array<int>"))
    all_ = some.unionByName(none)
    parts = F.split(F.col("text"), "\n", -1)
    kept = F.array_join(F.filter(parts, lambda line, i: ~F.array_contains(F.col(gone_), i)), "\n")
    text = F.when(F.size(gone_) > 0, kept).otherwise(F.col("text"))
    return all_.withColumn("text", text).withColumn(n_lines_, F.col(lines_).cast("long")).withColumn(n_dropped_, F.size(gone_).cast("long")).select(*columns, n_lines_, n_dropped_)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: recurring lines are cut and n_chars follows; documents left without any line go."""
    columns, done = docs.columns, drop_lines(docs)
    done = done.where((F.col(done.columns[-1]) == 0) | (F.col("text") != ""))
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*columns)
