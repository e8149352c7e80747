"""N-gram Jaccard join: documents whose sets of word shingles have a Jaccard similarity of at least 75 %.

Documents with equal sets are one class. A set can miss at most a quarter of its entries in any set that it links with,
so a class goes as soon as more than that are in no other class: first judged on the entries of a fixed part of the hash
range, then, for the few classes left, on all of them. What other classes have of a set is its core, kept in one global
order, rare entries first. Sets that link share an entry among the first `size of core - 75 % of set + 1` of both cores.

Every such entry names one of the classes that hold it, the one whose entries are the most common; a class joins the
block of each class so named. Two classes that share an entry thus share a block, and no list of an entry is ever
collected. Blocks are the parts of a prefix tree join: the cores of a block are stored as a prefix tree, all of them
traverse it at once with partial overlaps that their common paths share, and a subtree is left by all whose overlap
cannot reach the threshold with the remaining length. Classes already joined in the block are not compared. A block over
`TILE` entries is cut into tiles that share its leader; only classes that do not join the leader's are compared across
tiles. Both are exact on 64-bit shingle hashes, so no link between different texts is lost.

Entries that are far more frequent than most (by a counting sketch of fixed size) count as shared without being looked
up, and are dealt by entry and class, so a hot entry never meets in one task.

Defined results: null and empty texts, and texts without a word, have an empty set and are linked with nothing (their
component is their own doc_id); fewer than five words are one shingle; repeated rows and exact copies share a component;
a component of null ids only is null; an empty table gives an empty result; extra columns are ignored, and the pipeline's
stage keeps them whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavec.llm.common import arrow_rows, bitmap, drop_path, hit, slot, stored, table, tidied, unused
from stratavec.llm.graph import components
from stratavec.llm.textbytes import MULTIPLIERS, Texts, mix, slices, windows

WORDS = 5
PERCENT = 75
#: Shingles below this hash are the part that is judged first: 35 % of all, so that a quarter of a set is nearly always less.
SAMPLED = np.uint64(int(0.35 * 2**64))
#: Counters of the sketch that finds hot entries, and counters a block; fixed, so what is broadcast never grows.
SKETCH = 1 << 21
BLOCK = 1 << 16
#: Entries of all cores of a tile: 8 MB.
TILE = 1 << 20
#: Parts that the rows of a hot entry or of a large block are dealt to.
SALTS = 32
_MASK = np.uint64(SKETCH - 1)


def sets_of(column: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document."""
    t = Texts(column)
    ws, we, wd = t.words()
    words = t.sums(lower=True).hash(ws, we)
    runs = windows(words, WORDS)
    bounds = np.searchsorted(wd, np.arange(t.n + 1))
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= WORDS:
            out.append(np.unique(runs[a : b - WORDS + 1]))
        elif b > a:
            k = b - a
            out.append(mix((words[a:b] * MULTIPLIERS[20 + 4 * k : 20 + 5 * k]).sum(keepdims=True) + MULTIPLIERS[10 + k]))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def class_key(found: np.ndarray) -> int:
    """64-bit identity of a set, as a signed number."""
    return int((mix(mix(found ^ MULTIPLIERS[50]).sum(keepdims=True) + np.uint64(len(found)))).view(np.int64)[0])


def needed(n, m):
    """Least intersection of sets of n and m entries that links them: 100 i >= 75 (n + m - i)."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


#: SQL for the entries of a set of n that any set it links with must have.
LEAST = f"(({PERCENT} * n + 99) DIV 100)"


class _Fresh:
    """Classes that a task meets for the first time, as far as it remembers."""

    def __init__(self):
        self.seen: set[int] = set()

    def __call__(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        if len(self.seen) > 200_000:
            self.seen = set()
        for found in sets_of(column):
            if len(found) and (cls := class_key(found)) not in self.seen:
                self.seen.add(cls)
                yield cls, found


def _survey(batches):
    """Kind 0: a row a document (set size, entries of the sampled part, class). Kind 1: this task's sketch, in blocks."""
    counts = np.zeros(SKETCH, np.uint32)
    seen: set[int] = set()
    task = TaskContext.get().partitionId()
    names = ["kind", "doc_id", "n", "sampled", "cls", "block", "part", "data"]
    for whole in batches:
        for batch in slices(whole, "text"):
            found = sets_of(batch.column("text"))
            classes = [class_key(x) if len(x) else None for x in found]
            new = {cls: x for cls, x in zip(classes, found, strict=True) if cls is not None and cls not in seen}
            if len(seen) > 200_000:
                seen = set()
            seen.update(new)
            if new:
                counts += np.bincount((np.concatenate(list(new.values())) & _MASK).astype(np.int64), minlength=SKETCH).astype(np.uint32)
            size = batch.num_rows
            sampled = [int(np.searchsorted(x, SAMPLED)) for x in found]
            yield pa.RecordBatch.from_arrays([pa.array([0] * size, pa.int32()), batch.column("doc_id").cast(pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array(sampled, pa.int64()), pa.array(classes, pa.int64()), pa.nulls(size, pa.int32()), pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary())], names)
    blocks = [zlib.compress(x.tobytes(), 1) for x in counts.reshape(-1, BLOCK)]
    size = len(blocks)
    yield pa.RecordBatch.from_arrays([pa.array([1] * size, pa.int32()), *(pa.nulls(size, pa.int64()) for _ in range(4)), pa.array(range(size), pa.int32()), pa.array([task % 256] * size, pa.int32()), pa.array(blocks, pa.binary())], names)


def _add(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
    total = np.zeros(BLOCK, np.uint64)
    for data in part.column("data"):
        raw = zlib.decompress(data.as_py())
        total += np.frombuffer(raw, np.uint32 if len(raw) == 4 * BLOCK else np.uint64)
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def levels(surveyed: DataFrame) -> np.ndarray:
    """Per counter of the sketch, 0 for ordinary counts, and one more (up to 7) for each doubling beyond."""
    parts = surveyed.where("kind = 1").select("block", "part", "data").groupBy("block", "part").applyInArrow(_add, "block int, data binary")
    rows = parts.groupBy("block").applyInArrow(_add, "block int, data binary").collect()
    counts = np.zeros(SKETCH)
    for r in rows:
        counts[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(zlib.decompress(r.data), np.uint64)
    return np.clip(np.floor(np.log2((counts + 1) / (2 * counts.mean() + 4))), 0, 7).astype(np.uint8)


def _whole_tokens(batches) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """From rows sorted by token, then class: distinct (token, class), and in how many classes the token is; all of a token at once."""

    def counted(token, cls):
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])
        token, cls = token[new], cls[new]
        first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        many = np.diff(np.append(first, len(token)))
        return token, cls, np.repeat(many, many)

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        token, cls = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("token", "cls"))
        if not len(token):
            continue
        cut = int(np.searchsorted(token, token[-1]))
        if held and held[0][0][0] == token[-1]:
            held.append((token, cls))
            continue
        done = [*held, (token[:cut], cls[:cut])]
        token_, cls_ = (np.concatenate([x[i] for x in done]) for i in range(2))
        if len(token_):
            yield counted(token_, cls_)
        held = [(token[cut:], cls[cut:])]
    if held:
        yield counted(*(np.concatenate([x[i] for x in held]) for i in range(2)))


def sampled_rows(docs: DataFrame, level) -> DataFrame:
    """(token, cls) for the sampled part of every set; hot entries of a class are one row of an even token that counts them."""

    def run(batches):
        fresh = _Fresh()
        for whole in batches:
            for batch in slices(whole, "text"):
                tokens, classes = [], []
                for cls, found in fresh(batch.column("text")):
                    part = found[: np.searchsorted(found, SAMPLED)]
                    hot = level.value[(part & _MASK).astype(np.int64)] > 0
                    got = part[~hot] | np.uint64(1)
                    if many := int(hot.sum()):
                        own = (cls * 0x9E3779B97F4A7C15) % 2**64
                        got = np.append(got, np.uint64(own >> 32 << 32 | min(many, 2**31 - 1) << 1))
                    tokens.append(got)
                    classes.append(np.full(len(got), cls))
                if tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(classes))], ["token", "cls"])

    return docs.select("text").mapInArrow(tidied(run), "token long, cls long")


def _shared(batches):
    """(cls, shared): how many of a class's sampled entries other classes have, or are hot; partial sums."""
    for token, cls, many in _whole_tokens(batches):
        worth = np.where(token & 1, many > 1, (token & 0xFFFFFFFF) >> 1)
        own, at = np.unique(cls[worth > 0], return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.bincount(at, worth[worth > 0], len(own)).astype(np.int64))], ["cls", "shared"])


def classes_of(rows: DataFrame) -> DataFrame:
    """(cls, n, sampled, rep, copies): equal sets, and the smallest doc_id that has them."""
    return rows.where("cls IS NOT NULL").groupBy("cls", "n", "sampled").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))


def live_classes(docs: DataFrame, level, classes: DataFrame) -> DataFrame:
    """(cls, n, rep) of the classes that the sampled part does not rule out."""
    shared = sampled_rows(docs, level).repartition("token").sortWithinPartitions("token", "cls").mapInArrow(tidied(_shared), "cls long, shared long")
    counted = shared.groupBy("cls").agg(F.sum("shared").alias("shared"))
    return classes.join(counted, "cls", "left").where(f"sampled - coalesce(shared, 0) <= n - {LEAST}").select("cls", "n", "rep")


_HOT = 1 << 60
_LOW = (1 << 60) - 1


def full_rows(docs: DataFrame, level, live: DataFrame) -> DataFrame:
    """(token, cls) of whole sets of the documents in live (and of some others: a fixed-size bitmap of ids picks them).

    A token holds the level of its counter in its upper bits.
    """
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(live.select(slot("rep").alias("slot"))))

    def run(batches):
        fresh = _Fresh()
        for whole in batches:
            keep = hit(bits.value, whole.column("slot").to_numpy(zero_copy_only=False))
            for batch in slices(whole.filter(pa.array(keep)), "text"):
                tokens, classes = [], []
                for cls, found in fresh(batch.column("text")):
                    tokens.append((level.value[(found & _MASK).astype(np.int64)].astype(np.uint64) << np.uint64(60)) | (found >> np.uint64(4)))
                    classes.append(np.full(len(found), cls))
                if tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(classes))], ["token", "cls"])

    return docs.select("text", slot("doc_id").alias("slot")).mapInArrow(tidied(run), "token long, cls long")


def _ranked(batches):
    """(cls, entry) for entries that other classes have or that are hot; entries sort rare first, in one order for all."""
    for token, cls, many in _whole_tokens(batches):
        hot = token >= _HOT
        keep = hot | (many > 1)
        rarity = np.where(hot, 7 + (token >> 60), np.minimum(7, np.ceil(np.log2(np.maximum(many, 2))).astype(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(cls[keep]), pa.array(((rarity << 59) | ((token & _LOW) >> 1))[keep])], ["cls", "entry"])


def cores_of(docs: DataFrame, level, live: DataFrame) -> DataFrame:
    """(cls, n, core, rank): the entries that other classes have, of the classes that have enough of them to link; rank leads blocks."""
    token = F.col("token")
    dealt = F.when(token < _HOT, token).otherwise(F.xxhash64("token", "cls"))
    ranked = full_rows(docs, level, live).repartition(dealt).sortWithinPartitions("token", "cls").mapInArrow(tidied(_ranked), "cls long, entry long")
    cores = ranked.groupBy("cls").agg(F.array_sort(F.collect_list("entry")).alias("core")).join(live.select("cls", "n"), "cls").where(f"size(core) >= {LEAST}")
    common = F.aggregate("core", F.lit(0.0), lambda total, x: total + F.pow(F.lit(2.0), F.shiftright(x, 59)))
    rank = F.floor(common / F.col("n") * 1000) * F.lit(1 << 32) + F.col("cls").bitwiseAND(F.lit(0xFFFFFFFF))
    return cores.select("cls", "n", "core", rank.cast("long").alias("rank"))


def _salt(hot: Column) -> Column:
    return F.when(hot, F.pmod(F.xxhash64("cls"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int").alias("salt")


def _salts(hot: Column) -> Column:
    return F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt")


def blocks_of(cores: DataFrame) -> DataFrame:
    """(block, cls, weight): the classes that share an entry of their prefixes with the class that block is named after."""
    hot = F.col("entry") >= F.lit(8 << 59)
    entries = cores.select("cls", "rank", F.size("core").alias("weight"), F.explode(F.expr(f"slice(core, 1, CAST(size(core) - {LEAST} + 1 AS INT))")).alias("entry"))
    leaders = entries.groupBy("entry").agg(F.max_by("cls", "rank").alias("block"), F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo <> hi")
    joined = entries.select("cls", "weight", "entry", _salt(hot)).join(leaders.select("entry", "block", _salts(hot)), ["entry", "salt"])
    return joined.select("block", "cls", "weight").distinct()


class PrefixTree:
    """A prefix tree over sorted sets, held as their lexicographic order and the lengths of common prefixes of neighbours.

    sizes are those of the whole sets, which may have entries beyond the ones given here.
    """

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        self.sizes, self.lens = np.asarray(sizes, np.int64), np.array([len(x) for x in sets], np.int64)
        m, flat = len(sets), np.concatenate(sets)
        owner = np.repeat(np.arange(m, dtype=np.int32), self.lens)
        order = np.argsort(flat, kind="stable")
        new = np.concatenate(([True], np.diff(flat[order]) != 0))
        code = np.empty(len(flat), np.int32)
        code[order] = np.cumsum(new) - 1
        self.owners, self.begin = owner[order], np.append(np.flatnonzero(new), len(flat))
        ends = np.cumsum(self.lens)
        self.sets = [code[e - n : e] for e, n in zip(ends, self.lens, strict=True)]
        self.lex = np.array(sorted(range(m), key=lambda i: self.sets[i].astype(">i4").tobytes()), np.int64)
        self.common = np.zeros(m, np.int64)
        for i in range(1, m):
            a, b = self.sets[self.lex[i - 1]], self.sets[self.lex[i]]
            k = min(len(a), len(b))
            differ = np.flatnonzero(a[:k] != b[:k])
            self.common[i] = differ[0] if len(differ) else k

    def overlaps(self, part: np.ndarray) -> np.ndarray:
        """For every set, how many of these entries it has."""
        lists = [self.owners[self.begin[t] : self.begin[t + 1]] for t in part]
        return np.bincount(np.concatenate(lists), minlength=len(self.sets))

    def join(self, label: np.ndarray, lead: int | None = None) -> np.ndarray:
        """Labels of the sets after all links between sets of different labels; linked sets have the same label.

        Every set traverses the tree, all at once; lead (if given) is compared with all others before that. Of a pair,
        the larger set finds the smaller one.
        """
        label, every = label.copy(), np.arange(len(self.sets))
        if lead is not None:
            got = self.overlaps(self.sets[lead]) >= needed(self.sizes, self.sizes[lead])
            label[np.isin(label, label[got])] = label[lead]
        stack = [(0, len(every), 0, every, np.zeros(len(every), np.int64))]
        while stack:
            lo, hi, depth, probes, overlap = stack.pop()
            own = self.lex[lo:hi]
            names = label[own]
            least, deepest = self.sizes[own].min(), self.lens[own].max()
            keep = self.sizes[probes] >= least
            if (names == names[0]).all():
                keep &= label[probes] != names[0]
            probes, overlap = probes[keep], overlap[keep]
            need = needed(self.sizes[probes], least)
            end = int(self.common[lo + 1 : hi].min()) if hi - lo > 1 else int(self.lens[own[0]])
            while True:
                keep = overlap + np.minimum(deepest - depth, self.lens[probes] - overlap) >= need
                probes, overlap, need = probes[keep], overlap[keep], need[keep]
                if depth == end or not len(probes):
                    break
                part = self.sets[own[0]][depth : min(depth + 64, end)]
                overlap = overlap + self.overlaps(part)[probes]
                depth += len(part)
            if not len(probes):
                continue
            at = lo
            while at < hi and self.lens[self.lex[at]] == end:
                i = self.lex[at]
                got = probes[(overlap >= needed(self.sizes[probes], self.sizes[i])) & (label[probes] != label[i]) & (self.sizes[probes] >= self.sizes[i])]
                if len(got):
                    label[np.isin(label, label[got])] = label[i]
                at += 1
            cuts = [at, *(np.flatnonzero(self.common[at + 1 : hi] == end) + at + 1), hi] if at < hi else []
            stack.extend((int(a), int(b), end, probes, overlap) for a, b in zip(cuts[:-1], cuts[1:], strict=True))
        return label


def _joined(part: pa.Table, joined: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Classes of a tile and a label each (the place of one of them); sets already joined start with one label."""
    cls, first = np.unique(part.column("cls").to_numpy(), return_index=True)
    sets = [np.asarray(part.column("core")[i].values) for i in first.tolist()]
    tree = PrefixTree(sets, part.column("n").to_numpy()[first])
    label, lead = np.arange(len(cls)), np.flatnonzero(cls == part.column("block")[0].as_py())
    if joined is not None and joined[first].any():
        label[joined[first]] = np.flatnonzero(joined[first])[0]
    return cls, tree.join(label, int(lead[0]) if len(lead) else None)


_LINKS = "a long, b long, block long, loose boolean"


def _links(cls: np.ndarray, label: np.ndarray, block: int, lead: int | None) -> pa.Table:
    """Each class with the one its label names; loose: it is not joined with the block's leader."""
    loose = np.ones(len(cls), bool) if lead is None else label != label[lead]
    return pa.table({"a": pa.array(cls[label]), "b": pa.array(cls), "block": pa.array(np.full(len(cls), block)), "loose": pa.array(loose)})


def _tile(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
    cls, label = _joined(part, None)
    block = key[0].as_py()
    return _links(cls, label, block, int(np.flatnonzero(cls == block)[0]))


def _cross(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
    """Links of some loose classes of a block with the classes of one of its tiles, whose others are joined already."""
    cls, label = _joined(part, ~part.column("loose").to_numpy())
    return _links(cls, label, key[0].as_py(), None)


def _tiles(weight: Column) -> Column:
    return F.ceil(weight / TILE).cast("int")


def _tile_of(count: str) -> Column:
    return F.pmod(F.xxhash64("cls", F.lit(7)), F.col(count)).cast("int")


def links_of(cores: DataFrame, blocks: DataFrame) -> DataFrame:
    """(a, b): links that join all classes which links within any block join."""
    sets = cores.select("cls", "n", "core")
    large = blocks.groupBy("block").agg(F.sum("weight").alias("total")).where(F.col("total") > TILE).select("block", _tiles(F.col("total")).alias("tiles"))
    large, _ = stored(large, "large")
    some = large.limit(1).count() > 0
    members = blocks.select("block", "cls", F.lit(0).alias("tile"))
    if some:
        dealt = blocks.withColumn("salt", F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int")).join(large.select("block", "tiles", _salts(F.lit(True))), ["block", "salt"], "left")
        own = F.when(F.col("tiles").isNull(), F.array(F.lit(0))).when(F.col("cls") == F.col("block"), F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array(_tile_of("tiles")))
        members, _ = stored(dealt.select("block", "cls", F.explode(own).alias("tile")), "members")
    found, _ = stored(members.join(sets, "cls").groupBy("block", "tile").applyInArrow(_tile, _LINKS), "links")
    links = found.where("a <> b").select("a", "b")
    if some:
        loose = found.join(large.select("block").distinct(), "block", "left_semi").where("loose").select("block", F.col("b").alias("cls")).distinct()
        parts = loose.join(blocks, ["block", "cls"]).groupBy("block").agg(_tiles(F.sum("weight")).alias("parts")).join(large, "block")
        one = loose.join(parts, "block").select("block", "cls", _tile_of("parts").alias("part"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.lit(True).alias("loose"))
        flagged = members.join(loose.withColumn("loose", F.lit(True)), ["block", "cls"], "left").withColumn("loose", F.coalesce("loose", F.lit(False)))
        two = flagged.join(parts, "block").select("block", "cls", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "tile", "loose")
        more, _ = stored(one.unionByName(two).join(sets, "cls").groupBy("block", "part", "tile").applyInArrow(_cross, _LINKS), "links")
        links = links.union(more.where("a <> b").select("a", "b"))
    return links


def join_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, cls (class of equal sets), component_id."""
    spark = docs.sparkSession
    with arrow_rows(spark, 2000):
        surveyed, _ = stored(docs.select("doc_id", "text").mapInArrow(tidied(_survey), "kind int, doc_id long, n long, sampled long, cls long, block int, part int, data binary"), "survey")
        level = spark.sparkContext.broadcast(levels(surveyed))
        rows = surveyed.where("kind = 0").select("doc_id", "n", "sampled", "cls")
        classes, classes_path = stored(classes_of(rows), "classes")
        live, live_path = stored(live_classes(docs, level, classes), "live")
        cores, cores_path = stored(cores_of(docs, level, live), "cores")
        blocks, blocks_path = stored(blocks_of(cores), "blocks")
        final, _ = stored(components(links_of(cores, blocks)), "final")
    for path in (live_path, cores_path, blocks_path):
        drop_path(spark, path)
    tops = classes.join(final.select(F.col("node").alias("cls"), "component"), "cls", "left").where("copies > 1 OR component IS NOT NULL").select("cls", "rep", "copies", F.coalesce("component", "cls").alias("top"))
    least = tops.groupBy("top").agg(F.min("rep").alias("component_id"))
    named, _ = stored(tops.join(least, "top").select("cls", "copies", "component_id"), "named")
    # At most 1,000 classes can each hold a thousandth of all rows; only their rows could crowd a task, and rows without a class.
    known = named.select("cls", "component_id")
    hot = named.where(F.col("copies") * 1000 >= max(1, rows.count())).select("cls", "component_id")
    some = rows.where("cls IS NOT NULL")
    few = some.join(F.broadcast(hot.select("cls")), "cls", "left_anti").join(known, "cls", "left")
    many = some.join(F.broadcast(hot), "cls")
    none = rows.where("cls IS NULL").withColumn("component_id", F.lit(None).cast("long"))
    every = few.unionByName(many).unionByName(none)
    return every.select("doc_id", F.col("n").alias("n_shingles"), "cls", F.coalesce("component_id", "doc_id").alias("component_id"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def _screened(docs: DataFrame, bits, wanted: bool) -> DataFrame:
    """The rows whose id is (or is not) in a bitmap of ids."""
    columns, (at,) = docs.columns, unused(docs.columns, "slot")

    def run(batches):
        for batch in batches:
            keep = hit(bits.value, batch.column(at).to_numpy(zero_copy_only=False)) == wanted
            yield batch.filter(pa.array(keep)).select(columns)

    return docs.select(*columns, slot("doc_id").alias(at)).mapInArrow(tidied(run), docs.schema)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the document with the smallest id stays, once; documents with an empty set, and
    different texts of components without an id, all stay. Only rows of ids that go or repeat (by a fixed-size bitmap)
    are shuffled."""
    joined = join_components(docs)
    stays = F.max(F.col("doc_id").eqNullSafe(F.col("component_id")))
    (key, kept) = unused(docs.columns, "stage_id", "stage_kept")
    ids, _ = stored(joined.groupBy("doc_id").agg(stays.alias(kept), F.count(F.lit(1)).alias("many")).where(f"NOT {kept} OR many > 1").select(F.col("doc_id").alias(key), kept), "ids")
    bits = spark.sparkContext.broadcast(bitmap(ids.select(slot(key).alias("slot"))))
    odd = _screened(docs, bits, True).join(ids, F.col("doc_id").eqNullSafe(F.col(key)), "left").where(F.coalesce(F.col(kept), F.lit(True)))
    return _screened(docs, bits, False).unionByName(odd.dropDuplicates(["doc_id", "text"]).select(*docs.columns))


OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT rid, sh FROM (SELECT rid, array_to_string(list_slice(w, i, i + 4), ' ') AS sh FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
i AS (SELECT a.rid AS x, b.rid AS y, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.rid < b.rid GROUP BY ALL),
l AS (SELECT x, y FROM i JOIN n a ON a.rid = x JOIN n b ON b.rid = y WHERE 100 * i >= 75 * (a.n + b.n - i)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT rid AS x, rid AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT a.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(b.doc_id) AS component_id
FROM r JOIN d a ON a.rid = r.x JOIN d b ON b.rid = r.y LEFT JOIN n ON n.rid = r.x GROUP BY a.rid, a.doc_id
"""
