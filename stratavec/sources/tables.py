"""Sources and sinks: the gallery and its roles, vector files, lookups, reports, materialised panel state."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Upper ends of the roles in the seeded hash order: a percentage of the rows, and a count beyond which a role does not grow
#: with the gallery (work over queries x rows then grows with the rows only). The rest is the codec pool.
ROLE_ENDS = (("calibration", 20, 5000), ("validation", 25, 5500), ("test", 35, 6000))


def gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, x (doubles), label of the rows with an id and a vector that is not zero and has finite components only.

    Vectors of another length than the first row's in seeded order take no part either.
    """
    raw = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")
    rows = raw.select(F.col("vec_id").cast("long").alias("item_id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("long").alias("label"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = rows.where(F.col("item_id").isNotNull() & F.col("x").isNotNull()).where(finite & F.exists("x", lambda v: v != 0))
    sizes = rows.groupBy(F.size("x").alias("dim")).agg(F.min(F.struct(seeded(17), "item_id")).alias("first")).orderBy("first").limit(1).collect()
    return rows.where(F.size("x") == sizes[0].dim) if sizes else rows


def seeded(seed: int, column: str = "item_id"):
    """A portable random order: SHA-256 of "<seed>:<id>"."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(column).cast("string")).cast("binary"), 256)


def ranked(rows: DataFrame, seed: int, name: str) -> DataFrame:
    """rows with their 0-based rank in the seeded order.

    Two passes without a global sort in one task: rows are ranked within 4096 ranges of the hash, and each range starts
    after the rows of the ranges before it.
    """
    hashed = rows.withColumn("_h", seeded(seed)).withColumn("_b", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    sizes = hashed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    within = F.row_number().over(Window.partitionBy("_b").orderBy("_h", "item_id")) - 1
    return hashed.withColumn("_r", within).join(F.broadcast(starts), "_b").withColumn(name, F.col("_s") + F.col("_r")).drop("_h", "_b", "_r", "_s")


def numbered(rows: DataFrame, order: list, name: str, keep) -> DataFrame:
    """rows with their 1-based place in an order over all of them, without a sort in one task.

    Rows are range-partitioned and stored by keep(rows, label), so that both passes see the same partitions; places count
    on from the rows of the partitions before.
    """
    parts = keep(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), f"{name}_ranges")
    sizes = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    within = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return parts.withColumn("_r", within).join(F.broadcast(starts), "_p").withColumn(name, F.col("_s") + F.col("_r")).drop("_p", "_r", "_s")


def with_roles(rows: DataFrame, seed: int = 17) -> DataFrame:
    """rows with role: calibration, validation, test or pool."""
    size = rows.count()
    role = F.lit("pool")
    for name, end, most in reversed(ROLE_ENDS):
        role = F.when((F.col("_rank") * 100 < end * size) & (F.col("_rank") < most), name).otherwise(role)
    return ranked(rows, seed, "_rank").withColumn("role", role).drop("_rank")


#: Rows of a vector file that one task reads at a time.
FILE_ROWS = 65536


def _matrix_files(spark: SparkSession, path: str, kind: np.dtype, schema: str) -> DataFrame:
    """Files are listed without their content and read by ranges of rows, so their size has no bound; ids count on from file
    to file in the order of their paths."""
    from pyarrow import fs

    found = sorted(spark.read.format("binaryFile").load(path).select("path", "length").collect())
    plan, start = [], 0
    for row in found:
        place, name = fs.FileSystem.from_uri(row.path)
        with place.open_input_file(name) as data:
            count, dim = (int(x) for x in np.frombuffer(data.read_at(8, 0), "<u4"))
        if row.length != 8 + 4 * count * dim:
            raise ValueError("the file's size does not match its header")
        plan += [(row.path, start, at, min(FILE_ROWS, count - at), dim) for at in range(0, count, FILE_ROWS)]
        start += count

    def run(batches):
        for batch in batches:
            for uri, start, at, rows, dim in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                place, name = fs.FileSystem.from_uri(uri)
                with place.open_input_file(name) as data:
                    part = np.frombuffer(data.read_at(4 * rows * dim, 8 + 4 * at * dim), kind)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * dim), pa.array(part))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(start + at, start + at + rows)), flat], ["item_id", "x"])

    ranges = spark.createDataFrame(plan, "path string, start long, at long, rows long, dim long")
    return ranges.repartition(max(1, len(plan)), "path", "at").mapInArrow(run, schema)


def read_fbin(spark: SparkSession, path: str) -> DataFrame:
    """Vectors of files with header `u32 count, u32 dim`, then little-endian 32-bit floats."""
    return _matrix_files(spark, path, np.dtype("<f4"), "item_id long, x array<float>")


def read_ibin(spark: SparkSession, path: str) -> DataFrame:
    """As read_fbin, for 32-bit integers (neighbour lists)."""
    return _matrix_files(spark, path, np.dtype("<i4"), "item_id long, x array<int>")


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a two-dimensional .npy file of floats, read by ranges of rows; pickled content is refused."""
    from numpy.lib import format as npy
    from pyarrow import fs

    (row,) = spark.read.format("binaryFile").load(path).select("path").collect()
    place, name = fs.FileSystem.from_uri(row.path)
    with place.open_input_file(name) as data:
        version = npy.read_magic(data)
        shape, fortran, kind = (npy.read_array_header_1_0 if version == (1, 0) else npy.read_array_header_2_0)(data)
        head = data.tell()
    if fortran or len(shape) != 2 or kind.kind != "f":
        raise ValueError("not a row-major matrix of floats")
    count, dim = shape
    uri = row.path

    def run(batches):
        for batch in batches:
            place, name = fs.FileSystem.from_uri(uri)
            for at in batch.column("at").to_pylist():
                rows = min(FILE_ROWS, count - at)
                with place.open_input_file(name) as data:
                    part = np.frombuffer(data.read_at(kind.itemsize * rows * dim, head + kind.itemsize * at * dim), kind).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + rows)), pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * dim), pa.array(part))], ["item_id", "x"])

    starts = spark.createDataFrame([(at,) for at in range(0, count, FILE_ROWS)], "at long")
    return starts.repartition(max(1, -(-count // FILE_ROWS)), "at").mapInArrow(run, "item_id long, x array<double>")


def write_fbin(rows: DataFrame, path: str) -> None:
    """Writes (item_id, x) in id order as one such file on the driver's file system; for exchange with other tools.

    Rows come partition by partition, so the driver never holds the whole table; vectors must have equal lengths.
    """
    count, dim = rows.count(), 0
    with open(path, "wb") as out:
        out.write(b"\0" * 8)
        for row in rows.select("item_id", "x").orderBy("item_id").toLocalIterator():
            data = np.array(row.x, "<f4")
            if dim and len(data) != dim:
                raise ValueError("vectors differ in length")
            dim = len(data)
            out.write(data.tobytes())
        out.seek(0)
        out.write(np.array([count, dim], "<u4").tobytes())


def csv_lookup(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """key -> value of a CSV with header; empty values and the literal None are left out."""
    rows = spark.read.csv(path, header=True).select(F.col(key).alias("key"), F.col(value).alias("value"))
    return rows.where("value IS NOT NULL AND value <> '' AND value <> 'None'")


def listed_ids(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Sorted file stems under a folder, as a relation."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path")
    return files.select(F.regexp_extract("path", r"([^/]+?)(\.[^/.]*)?$", 1).alias("id")).orderBy("id")


def read_reports(spark: SparkSession, glob: str) -> DataFrame:
    """Per-seed JSON reports with the file that each came from."""
    return spark.read.option("multiLine", "true").json(glob).withColumn("file", F.input_file_name())


def united_reports(reports: DataFrame, keys: list[str]) -> DataFrame:
    """Reports by key; a key that two reports have is an error."""
    twice = reports.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"several reports of {twice[0].asDict()}")
    return reports


def write_json(value: dict, path: str) -> None:
    """A JSON file on the driver that is there whole or not at all."""
    import json
    import os

    with open(f"{path}.part", "w") as out:
        json.dump(value, out, sort_keys=True, indent=1)
    os.replace(f"{path}.part", path)


def markdown(rows: DataFrame, most: int = 1000) -> str:
    """A small table as Markdown, in its own order; more than `most` rows are refused."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows")
    cell = [[f"{v:.6g}" if isinstance(v, float) else str(v) for v in r] for r in found]
    return "\n".join("| " + " | ".join(r) + " |" for r in [rows.columns, ["-"] * len(rows.columns), *cell])


def save_state(table: DataFrame, path: str, fingerprint: str) -> None:
    """A materialised table and its manifest row; load_state refuses another fingerprint."""
    table.write.mode("overwrite").parquet(f"{path}/data")
    table.sparkSession.createDataFrame([(fingerprint,)], "fingerprint string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def reused(table, path: str, fingerprint: str, spark: SparkSession) -> DataFrame:
    """The state saved under path with this fingerprint; table() is made and saved only where there is none."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/_SUCCESS")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        save_state(table(), path, fingerprint)
    return load_state(spark, path, fingerprint)


def load_state(spark: SparkSession, path: str, fingerprint: str) -> DataFrame:
    found = [r.fingerprint for r in spark.read.json(f"{path}/manifest").collect()]
    if found != [fingerprint]:
        raise ValueError(f"saved state has fingerprint {found}, not {fingerprint}")
    return spark.read.parquet(f"{path}/data")
