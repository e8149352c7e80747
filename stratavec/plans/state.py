"""Panel state: the relations every query of a panel starts from, written once a session and data folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavec.config import DEFAULT, PanelConfig
from stratavec.operators.codec import encode_rq, encode_table, prefixes, train_rq, training_rows
from stratavec.operators.score import scored
from stratavec.sources.tables import gallery, with_roles

_made: dict[tuple, Panel] = {}


def _root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="stratavec-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def _drop(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext._jsc
    if context is not None and not context.sc().isStopped():
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context.hadoopConfiguration()).delete(where, True)


class Panel:
    """Written relations: items (item_id, x, label, role, codes), scored, and the codec's tables."""

    def __init__(self, spark: SparkSession, sf_dir: str, cfg: PanelConfig):
        self.spark, self.cfg = spark, cfg
        self._derived: dict[str, DataFrame] = {}
        self._values: dict[str, object] = {}
        self.path = f"{_root(spark)}/stratavec-panel-{uuid.uuid4().hex[:12]}"
        atexit.register(_drop, spark, self.path)
        roles = self.keep(with_roles(gallery(spark, sf_dir), cfg.seed), "roles")
        self.books = train_rq(training_rows(roles.where("role = 'pool'"), cfg), cfg)
        books = self.books
        self.dim = books.shape[2]
        self.items = self.keep(encode_table(roles, lambda x: encode_rq(x, books)), "items")
        queries = self.items.where("role <> 'pool'").select(F.col("item_id").alias("query_id"), F.col("x").alias("q"))
        self.scored = self.keep(scored(self.items, queries, books, cfg), "scored")

    def keep(self, rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/{name}")

    def once(self, name: str, make: Callable[[], object]):
        """A small value of fixed size (codebooks, moments) that is the same whenever it is asked for."""
        if name not in self._values:
            self._values[name] = make()
        return self._values[name]

    def codebook(self) -> DataFrame:
        """stage, code, c: bounded by the codec's size."""
        rows = [(s, k, c.tolist()) for s, book in enumerate(self.books) for k, c in enumerate(book)]
        return self.spark.createDataFrame(rows, "stage long, code long, c array<double>")

    def prefix_stats(self) -> DataFrame:
        """item_id, option, norm and cos of every prefix option's reconstruction."""
        import pyarrow as pa

        from stratavec.operators.codec import matrix

        books, lengths = self.spark.sparkContext.broadcast(self.books), self.cfg.lengths

        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = matrix(batch.column("x"))
                rebuilt = prefixes(matrix(batch.column("codes")).astype(np.int64), books.value, lengths)
                norm = np.sqrt((rebuilt**2).sum(-1))
                cos = np.einsum("nd,nod->no", x, rebuilt) / np.maximum(norm, 1e-12) / np.sqrt((x**2).sum(1))[:, None]
                ids = np.repeat(batch.column("item_id").to_numpy(), len(lengths))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.tile(np.arange(1, len(lengths) + 1), len(x))), pa.array(norm.ravel()), pa.array(cos.ravel())], ["item_id", "option", "norm", "cos"])

        return self.items.select("item_id", "x", "codes").mapInArrow(run, "item_id long, option long, norm double, cos double")

    def keep_once(self, rows: DataFrame, name: str) -> DataFrame:
        """keep() for a relation that is the same whenever it is asked for."""
        if name not in self._derived:
            self._derived[name] = self.keep(rows, name)
        return self._derived[name]

    def kept(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A relation that many queries start from, built and written when first asked for."""
        if name not in self._derived:
            self._derived[name] = self.keep(build(), name)
        return self._derived[name]

    def views(self) -> None:
        """Temporary views under the names that the panel's SQL uses."""
        self.items.select("item_id", "role", "label").createOrReplaceTempView("gal")
        self.items.select("item_id", "x").createOrReplaceTempView("vec")
        self.items.select("item_id", F.posexplode("codes").alias("stage", "code")).select("item_id", F.col("stage").cast("long").alias("stage"), F.col("code").cast("long").alias("code")).createOrReplaceTempView("codes")
        self.codebook().createOrReplaceTempView("cb")
        self.prefix_stats().createOrReplaceTempView("pstat")
        self.scored.createOrReplaceTempView("sc")


def _stamp(spark: SparkSession, path: str) -> tuple:
    """Length and time of the files under a path: changed data makes another panel."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in place.listStatus(where)))


def panel(spark: SparkSession, sf_dir: str, cfg: PanelConfig = DEFAULT) -> Panel:
    key = (spark.sparkContext.applicationId, sf_dir, cfg, _stamp(spark, f"{sf_dir.rstrip('/')}/embeddings.parquet"))
    if key not in _made:
        _made[key] = Panel(spark, sf_dir, cfg)
    return _made[key]
