"""WARC archives, index first.

Each task writes archives of gzip members, one per record, and tells file, offset, length, URL
and digest of each record; these rows are the index, which Spark writes with its commit
protocol. A file's name is new for each attempt of a task and only what the index names
counts, so a lost executor or a second attempt does no harm. Reading takes any selection of
index rows, puts the ranges of an archive in order, joins those that lie close together, and
fetches each joined range once.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.llm.shared import fresh_path, small_batches

END = "\r\n\r\n"
#: Bytes between two ranges that are still read as one, and the most bytes of a joined range
#: (a longer record is a range of its own).
GAP, CHUNK = 64 << 10, 4 << 20
#: Bytes that a task fetches, about.
TASK_BYTES = 64 << 20
#: An archive that has reached this size is closed and a new one begun.
ARCHIVE_BYTES = 1 << 30
LEVEL = 6
INDEX = "file string, offset long, length long, page_id long, url string, payload_digest string, record_type string"
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload string"


def base32_sha1(hex_digest: Column) -> Column:
    """RFC 4648 base32 of a SHA-1 in hexadecimal: 20 bits are 5 hex and 4 base32 digits."""
    digits, letters = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    parts = [F.lpad(F.conv(F.substring(hex_digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), digits, letters)


def records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, url, digest, record_type, refers_to, record``: what an archive holds.

    Of payloads that are equal and of ``least_bytes`` or more, the one of the largest
    page_id is a response and the others revisit it. A null html is an empty payload, a null
    url has no target header. Repeated rows of one page_id are one response each, as a page
    does not revisit itself.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    own = own.withColumn("digest", base32_sha1(F.sha1(F.encode("html", "UTF-8")))).withColumn("size", F.octet_length("html").cast("long"))
    # narrow: the payloads' digests only; a null page_id is the smallest
    last = own.where(F.col("size") >= least_bytes).groupBy("digest", "size").agg(F.max("page_id").alias("last_id"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    joined = own.join(last, ["digest", "size"], "left")
    revisit = F.col("last_id").isNotNull() & ~F.col("last_id").eqNullSafe(F.col("page_id"))
    target = F.coalesce(F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", "[\r\n]", ""), F.lit("\r\n")), F.lit(""))
    known = F.coalesce(F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.col("page_id"), F.lit(">\r\n")), F.lit("WARC-Record-ID: <urn:page:>\r\n"))
    refers = F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("last_id"), F.lit(">\r\n"))).otherwise(F.lit(""))
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\n"), known, target, refers,
        F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"),
        F.lit("\r\nX-Payload-Length: "), F.col("size").cast("string"),
        F.lit("\r\nContent-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("size").cast("string")),
        F.lit(END), F.when(revisit, F.lit("")).otherwise(F.col("html")),
    )
    return joined.select("page_id", "url", F.col("digest").alias("payload_digest"), kind.alias("record_type"), record.alias("record"))


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Writes archives (``folder/warc``) and then their index (``folder/index``, parquet);
    gives the folder, a new one in the cluster's shared folder if none is named."""
    small_batches(pages)
    folder = folder or fresh_path(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _place(f"{folder}/warc")
        system.create_dir(base, recursive=True)
        file, at, name = None, 0, ""
        try:
            for batch in batches:
                rows = []
                for page_id, url, digest, kind, record in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if file is None:
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        file = system.open_output_stream(f"{base}/{name}", compression=None)
                    press = zlib.compressobj(LEVEL, wbits=31)
                    member = press.compress(f"{record}{END}".encode()) + press.flush()
                    file.write(member)
                    rows.append((name, at, len(member), page_id, url, digest, kind))
                    at += len(member)
                    if at >= archive_bytes:
                        file.close()
                        file = None
                if rows:
                    yield _index_batch(rows)
        finally:
            if file is not None:
                file.close()

    records(pages, least_bytes).mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return folder


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])


def _place(uri: str):
    """File system and path of a folder that all executors share."""
    from pyarrow import fs

    if "://" not in uri:
        uri = f"file://{uri.removeprefix('file:')}"
    return fs.FileSystem.from_uri(uri)


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}


def _number(text: str | None) -> int | None:
    inner = (text or "").removeprefix("<urn:page:").removesuffix(">")
    return int(inner) if inner else None


def ranges(selected: DataFrame, gap: int = GAP, chunk: int = CHUNK) -> DataFrame:
    """``file, start, stop, parts``: sorted ranges of an archive, joined where at most
    ``gap`` bytes lie between and the sum stays in its ``chunk`` of the archive."""
    from pyspark.sql import Window

    spot = selected.select("file", "offset", "length", F.expr(f"offset div {int(chunk)}").alias("stretch")).distinct()
    # a stretch of an archive is a bounded number of bytes, so are its windows and lists
    order = Window.partitionBy("file", "stretch").orderBy("offset")
    before = F.lag(F.col("offset") + F.col("length")).over(order)
    first = F.when(before.isNull() | (F.col("offset") - before > gap), 1).otherwise(0)
    runs = spot.withColumn("new", first).withColumn("run", F.sum("new").over(order))
    return runs.groupBy("file", "stretch", "run").agg(
        F.min("offset").alias("start"),
        F.max(F.col("offset") + F.col("length")).alias("stop"),
        F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("parts"),
    )


def read_records(spark, folder: str, selected: DataFrame | None = None, gap: int = GAP, chunk: int = CHUNK) -> DataFrame:
    """The records of the selected index rows (all, if none are given), each checked against
    its digest. A revisit has the length and digest of the payload it refers to."""
    selected = spark.read.parquet(f"{folder}/index") if selected is None else selected

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _fetch(batches, f"{folder}/warc")

    # the index is small, what it points at is not: ranges are dealt by the bytes they fetch
    size = selected.agg(F.sum("length")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    spread = ranges(selected, gap, chunk).repartition(tasks, "file", "start")
    return spread.select("file", "start", "stop", "parts").mapInArrow(run, RECORDS)


def _fetch(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())
    names = [x.split()[0] for x in RECORDS.split(", ")]
    system, base = _place(folder)
    for batch in batches:
        for row in batch.to_pylist():
            with system.open_input_file(f"{base}/{row['file']}") as file:
                file.seek(row["start"])
                data = file.read(row["stop"] - row["start"])
            rows = []
            for part in row["parts"]:
                at = part["offset"] - row["start"]
                record = zlib.decompress(data[at : at + part["length"]], wbits=31)
                head, _, rest = record.partition(END.encode())
                h = _headers(head)
                payload, digest, kind = rest[:-4], h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"]
                if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"{row['file']}: payload at {part['offset']} does not have its digest")
                rows.append((_number(h["warc-record-id"]), h.get("warc-target-uri"), kind, int(h["x-payload-length"]), digest, _number(h.get("warc-refers-to")), payload.decode("utf-8") if kind == "response" else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
