"""WARC archives: writing, normalising monolithic gzip files, and reading back by a sidecar offset index.

Writers make whole-file gzip streams. The normaliser inflates each such stream once, in bounded chunks, rewrites every
record as a gzip member of its own, and writes a sidecar index of offsets; readers then seek to single records.

Records with equal payloads of at least `MIN_REVISIT` bytes: the one with the largest page_id is the response, others
are revisits of it. Defined results: a null html is an empty payload; a null page_id counts as smaller than any other;
rows repeated with page_id and payload are all responses when theirs is the largest page_id; an empty table gives no
archive and an empty result; extra columns are ignored. Executors can be lost: a task writes files under names of its
own, and only files named in a committed manifest are ever read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavec.llm.common import bitmap, drop_path, hit, scratch_path, slot, small_batches, stored, table

MIN_REVISIT = 1000
#: Uncompressed bytes after which a writer starts another archive.
ARCHIVE_BYTES = 32 << 20
CHUNK = 1 << 20
LEVEL = 3
EOL = b"\r\n"
#: Parts that the rows of a repeated payload are dealt to.
SALTS = 16
#: Compressed bytes of an archive that are read in one piece.
READ_BYTES = 4 << 20


def _place(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _screened(pages: DataFrame, bits, wanted: bool) -> DataFrame:
    """The rows whose digest is (or is not) in a bitmap of digests."""

    def run(batches):
        for batch in batches:
            keep = hit(bits.value, batch.column("slot").to_numpy(zero_copy_only=False)) == wanted
            yield batch.filter(pa.array(keep)).select(["page_id", "url", "payload", "payload_bytes", "payload_digest"])

    return pages.select("*", slot("payload_digest").alias("slot")).mapInArrow(run, pages.schema)


def plan_records(pages: DataFrame) -> DataFrame:
    """The pages with payload, payload_bytes, payload_digest, record_type and refers_to.

    Digests of repeated large payloads are found first. Only rows that may have one (by a fixed-size bitmap) are shuffled,
    each digest's rows to several parts, so that equal pages do not meet in one task.
    """
    spark = pages.sparkSession
    pages = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    pages = pages.withColumn("payload_bytes", F.length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    large = F.col("payload_bytes") >= MIN_REVISIT
    kept = pages.where(large).groupBy("payload_digest").agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    kept, _ = stored(kept, "digests")
    bits = spark.sparkContext.broadcast(bitmap(kept.select(slot("payload_digest").alias("slot"))))
    dealt = kept.select("payload_digest", "kept", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
    some = _screened(pages, bits, True).withColumn("part", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    joined = some.join(dealt, ["payload_digest", "part"], "left").drop("part")
    joined = joined.unionByName(_screened(pages, bits, False).withColumn("kept", F.lit(None).cast("long")))
    again = large & F.col("kept").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("kept")))
    return joined.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("kept")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record; a revisit keeps the HTTP header, which tells the payload's length, and leaves the payload out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    lines.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + EOL + EOL + block + EOL + EOL


def headers(data: bytes) -> dict[str, str]:
    """Header lines after the first, by lower-case name."""
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in data.decode().split("\r\n")[1:])}


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC header, HTTP header and payload of one record."""
    head, _, rest = data.partition(EOL + EOL)
    fields = headers(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(EOL + EOL)
    return fields, headers(http), payload


def inflate(stream) -> Iterator[bytes]:
    """Chunks of a gzip file of any number of members, in bounded memory."""
    unzip = zlib.decompressobj(31)
    while data := stream.read(CHUNK):
        while data:
            if got := unzip.decompress(data, 4 * CHUNK):
                yield got
            data = unzip.unconsumed_tail
            if unzip.eof:
                data, unzip = unzip.unused_data, zlib.decompressobj(31)


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated stream, by their Content-Length."""
    held = bytearray()
    for chunk in chunks:
        held += chunk
        at = 0
        while (end := held.find(EOL + EOL, at)) >= 0:
            size = end + 4 + int(headers(bytes(held[at:end]))["content-length"]) + 4
            if size > len(held):
                break
            yield bytes(held[at:size])
            at = size
        del held[:at]
    if held:
        raise ValueError(f"archive ends within a record: {len(held)} bytes are left")


def write_archives(planned: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes monolithic gzip archives; returns their manifest (archive, records). Materialise it before reading archives."""

    def run(batches):
        place, root = _place(folder)
        place.create_dir(root, recursive=True)
        out = None

        def close():
            out[0].write(out[1].flush())
            out[0].close()
            return pa.RecordBatch.from_arrays([pa.array([out[2]]), pa.array([out[3]], pa.int64())], ["archive", "records"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "payload_digest", "record_type", "refers_to")), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = [place.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31), name, 0, 0]
                data = record(*row, date)
                out[0].write(out[1].compress(data))
                out[3] += 1
                out[4] += len(data)
                if out[4] >= ARCHIVE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return planned.select("page_id", "url", "payload", "payload_digest", "record_type", "refers_to").mapInArrow(run, "archive string, records long")


def normalise(manifest: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrites every archive record by record; returns the offset index (archive, member, offset, length).

    Archives are dealt to as many tasks as there are archives, which a fixed number keeps from being merged. Each archive also gets a sidecar file `<archive>.idx` with the same offsets as text.
    """

    def run(batches):
        place, root = _place(source)
        to, folder = _place(target)
        to.create_dir(folder, recursive=True)
        for batch in batches:
            for name, expected in zip(batch.column("archive").to_pylist(), batch.column("records").to_pylist(), strict=True):
                new, rows, at = f"{uuid.uuid4().hex}-{name}", [], 0
                with place.open_input_stream(f"{root}/{name}", compression=None) as stream, to.open_output_stream(f"{folder}/{new}", compression=None) as out:
                    for data in records(inflate(stream)):
                        zipped = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = zipped.compress(data) + zipped.flush()
                        out.write(member)
                        rows.append((at, len(member)))
                        at += len(member)
                if len(rows) != expected:
                    raise ValueError(f"{name} has {len(rows)} records, its manifest {expected}")
                with to.open_output_stream(f"{folder}/{new}.idx", compression=None) as out:
                    out.write("".join(f"{a}\t{b}\n" for a, b in rows).encode())
                yield pa.RecordBatch.from_arrays([pa.array([new] * len(rows)), pa.array(range(len(rows)), pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["archive", "member", "offset", "length"])

    return manifest.repartition(max(1, 2 * manifest.count()), "archive").mapInArrow(run, "archive string, member long, offset long, length long")


RECORD_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_records(index: DataFrame, folder: str, keep_payload: bool = True) -> DataFrame:
    """Reads single members by offset and parses them; a response's payload is checked against its digest.

    Members are dealt by archive and range of offsets, so that no task reads much more than `READ_BYTES` in one place.
    """

    def page(urn: str | None) -> int | None:
        number = (urn or "").removeprefix("<urn:x-page:").rstrip(">")
        return int(number) if number else None

    def run(batches):
        place, root = _place(folder)
        name, opened = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, rows = batch.slice(at, 512), []
                for archive, offset, length in zip(*(part.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True):
                    if archive != name:
                        if opened:
                            opened.close()
                        name, opened = archive, place.open_input_file(f"{root}/{archive}")
                    fields, http, payload = parse(zlib.decompress(opened.read_at(length, offset), 31))
                    kind, digest = fields["warc-type"], base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{archive} at {offset}: payload and digest differ")
                    size = len(payload) if kind == "response" else int(http["content-length"])
                    rows.append((page(fields["warc-record-id"]), fields.get("warc-target-uri"), size, digest, kind, page(fields.get("warc-refers-to")), payload if keep_payload and kind == "response" else None))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
        if opened:
            opened.close()

    piece = F.floor(F.col("offset") / READ_BYTES).alias("piece")
    pieces = index.select("archive", piece).distinct().count()
    dealt = index.select("archive", "offset", "length", piece).repartition(max(1, 2 * pieces), "archive", "piece").sortWithinPartitions("archive", "offset")
    return dealt.drop("piece").mapInArrow(run, RECORD_SCHEMA)


def round_trip(pages: DataFrame, keep_payload: bool = True) -> DataFrame:
    """Write, normalise, index, read back."""
    spark = pages.sparkSession
    small_batches(spark)
    whole, single = scratch_path(spark, "warc-whole"), scratch_path(spark, "warc")
    manifest, _ = stored(write_archives(plan_records(pages), whole), "warc-manifest")
    index, _ = stored(normalise(manifest, whole, single), "warc-index")
    drop_path(spark, whole)
    return read_records(index, single, keep_payload)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"), keep_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS kept FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> kept THEN kept END AS refers_to FROM k
"""
