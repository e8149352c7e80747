"""Session helpers shared by the training-data operators: table reading, shared scratch tables, crash-safe cleanup."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a folder of our own where that is unset (local tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext.getCheckpointDir()
        if found:
            return found
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="stratavec-")
        spark.sparkContext.setCheckpointDir(root)
        return spark.sparkContext.getCheckpointDir()
    return root


_made: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder name under the shared scratch root, removed when the session's process ends."""
    path = f"{scratch_root(spark).rstrip('/')}/stratavec-{label}-{uuid.uuid4().hex[:12]}"
    _made.append(path)
    atexit.register(drop_path, spark, path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Spark's own file system; a session that has ended has nothing left to delete."""
    jvm = spark.sparkContext._jvm
    if jvm is None or spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores before it until no column has it, in upper or lower case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def stored(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write a table to the shared scratch folder and read it back: cuts lineage so that lost executors cost a re-read only.

    The finished step's shuffle files are of no more use. Spark removes them when the driver's garbage is collected,
    which is asked for here, as a small driver heap may otherwise hold them until the disks are full.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path), path


def settled(spark: SparkSession, build: Callable[[], DataFrame], label: str) -> DataFrame:
    """The stored result of build(); scratch tables that it stored on the way are deleted."""
    mark = len(_made)
    done, path = stored(build(), label)
    for other in _made[mark:]:
        if other != path:
            drop_path(spark, other)
    del _made[mark:]
    _made.append(path)
    return done


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """From here on the session sends at most this many rows to Python at a time, so that long texts stay few in memory.

    Set for good, as a returned table is run by its caller; a smaller bound that the session already has stays.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs started within send at most `rows` rows to Python at a time; for columns of large values."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: What this Python worker keeps between an operator's tasks, by name.
_remembered: dict[str, object] = {}


def remembered(name: str, make: Callable[[], object]):
    """A value that this Python worker keeps between tasks, made when first asked for."""
    if name not in _remembered:
        _remembered[name] = make()
    return _remembered[name]


def forget(keep: str = "") -> None:
    """Drop what this Python worker remembers, but for names that begin with keep."""
    others = [x for x in _remembered if not keep or not x.startswith(keep)]
    for name in others:
        del _remembered[name]
    if others:
        gc.collect()
        hand_back()


def hand_back() -> None:
    """Give freed memory back to the system: Spark keeps Python workers from stage to stage, and with them what they hold."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidied(run: Callable[[Iterator], Iterator], keep: str = "") -> Callable[[Iterator], Iterator]:
    """run, for mapInArrow, that begins without what other operators remember (names that do not begin with keep) and ends
    with freed memory handed back."""

    def whole(batches: Iterator) -> Iterator:
        forget(keep)
        yield from run(batches)
        hand_back()

    return whole


#: Bits of a membership bitmap: 4 MB, whatever the corpus. A full bitmap lets more rows through, never fewer.
SLOTS = 1 << 25


def slot(*columns: str) -> Column:
    """Position of a key in a membership bitmap."""
    return F.pmod(F.xxhash64(*columns), F.lit(SLOTS))


def bitmap(keys: DataFrame) -> np.ndarray:
    """Bytes of the bitmap with the positions in column slot set; aggregated where the keys are, in chunks of 32,768 bits."""
    chunks = keys.select((F.col("slot") + 1).alias("x")).groupBy(F.bitmap_bucket_number("x").alias("chunk")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits"))
    out = np.zeros(SLOTS // 8, np.uint8)
    for r in chunks.collect():
        at = (r.chunk - 1) * 4096
        out[at : at + 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def hit(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Which positions are set."""
    return (bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1
