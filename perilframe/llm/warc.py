"""WARC archives of pages: a writer that records repeated payloads as revisits, and a splittable reader.

`write` stores one gzip member per page in the shared folder, one file per task, and returns a table of the files.
`read` gives tasks byte ranges of those files. A task looks for the gzip magic, takes a candidate for a record only if
the whole member decodes, opens with a WARC header, and is followed by another member or the end of the file, and owns
the records that start inside its range, reading past its end to finish the last one.

Defined results: a null html is an empty payload; a null url leaves its header out; a null ``page_id`` is written with an
empty id and read back as null; rows that share the smallest id of a payload are all responses; an empty table gives no
record. Only ``page_id``, ``url`` and ``html`` are read. Files of tasks that were lost are never listed, so never read.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilframe.llm.common import written
from perilframe.session import scratch_path

MAGIC = b"\x1f\x8b\x08"
#: Payloads below this many bytes are never recorded as revisits.
LEAST_REVISIT = 100
RANGE_BYTES = 1 << 20
#: What a reading task takes on where the archives fill more tasks than the cluster has cores.
TASK_BYTES = 1 << 27
STEP = 1 << 18
#: Names that Hadoop has for stores which Arrow names otherwise.
SCHEMES = {"s3a": "s3", "s3n": "s3"}
#: Capture date written to every record, so equal input gives equal archives.
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FILES = "path string, size long, records long"
RECORDS = ("page_id long, url string, record_type string, refers_to long, declared_digest string, "
           "declared_bytes long, payload binary, path string, offset long")


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path behind a path as Spark names it."""
    scheme, mark, rest = uri.partition("://")
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}" if mark else uri)


def marked(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, digest`` and the page whose record this one repeats, if any."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload"),
                        F.sha2(payload.cast("binary"), 256).alias("digest"))
    firsts = (rows.where(F.octet_length("payload") >= LEAST_REVISIT).groupBy("digest")
              .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
              .where("n > 1 AND first IS NOT NULL").select("digest", "first"))
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(firsts, "digest", "left").select(
        "page_id", "url", "payload", "digest", F.when(again, F.col("first")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit keeps the HTTP header and leaves the body out."""
    body = b"" if refers_to is not None else payload
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="%/:?#[]@!$&'()*+,;=~"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
             f"Content-Length: {len(http) + len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + body + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def write(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Archives of all pages; one row per file. The table is written, so the archives are made once."""
    target = folder or scratch_path(pages.sparkSession, "warc")

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(target)
        store.create_dir(root, recursive=True)
        name = f"{root}/pages-{uuid.uuid4().hex}.warc.gz"  # unlike that of any other attempt
        size = records = 0
        with store.open_output_stream(name, compression=None) as out:
            for batch in batches:
                for page, url, payload, digest, refers_to in zip(*(column.to_pylist() for column in batch.columns)):
                    data = member(record(page, url, payload.encode(), digest, refers_to))
                    out.write(data)
                    size += len(data)
                    records += 1
        yield pa.record_batch([pa.array([f"{target}/{name.rsplit('/', 1)[1]}"]), pa.array([size], pa.int64()),
                               pa.array([records], pa.int64())], names=["path", "size", "records"])

    return written(marked(pages).mapInArrow(archive, FILES), "warc-files")


_ID = re.compile(r"<urn:page:(-?\d+)>")


def parsed(data: bytes) -> dict | None:
    """The fields of a decoded record, or None if ``data`` isn't one."""
    if not data.startswith(b"WARC/1."):
        return None
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    try:
        block = block[:int(fields["Content-Length"])]
        http, _, payload = block.partition(b"\r\n\r\n")
        declared = re.search(rb"Content-Length: (\d+)", http)
        kind = fields["WARC-Type"]
        page, first = (_ID.fullmatch(fields.get(name, "")) for name in ("WARC-Record-ID", "WARC-Refers-To"))
        return {"page_id": int(page[1]) if page else None, "url": fields.get("WARC-Target-URI"), "record_type": kind,
                "refers_to": int(first[1]) if first else None,
                "declared_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"),
                "declared_bytes": int(declared[1]) if declared else len(payload),
                "payload": None if kind == "revisit" else payload}
    except (KeyError, ValueError):
        return None


def decoded(source: pa.NativeFile, data: memoryview, first: int, at: int, size: int) -> tuple[dict, int] | None:
    """The record whose member starts at ``at`` and where it ends, or None if no record starts there.

    ``data`` holds the file from ``first`` on; the store is asked only for what lies behind it.
    """
    unpack, out, place = zlib.decompressobj(31), [], at
    last = first + len(data)

    def block(start: int, count: int) -> bytes | memoryview:
        return data[start - first:start - first + count] if start < last else source.read_at(min(count, size - start), start)

    try:
        step = 1 << 12  # most candidates and members are short
        while not unpack.eof and place < size:
            part = block(place, step)
            out.append(unpack.decompress(part))
            place += len(part)
            step = STEP
            if len(out) == 1 and not out[0].startswith(b"WARC/1.") and len(out[0]) >= 7:
                return None
    except zlib.error:
        return None
    if not unpack.eof:
        return None
    end = place - len(unpack.unused_data)
    if end < size:
        following = bytes(block(end, len(MAGIC)))
        if len(following) < len(MAGIC) and end + len(following) < size:  # the buffer ends inside
            following = source.read_at(min(len(MAGIC), size - end), end)
        if following != MAGIC:
            return None
    found = parsed(b"".join(out))
    return (found, end) if found else None


def owned(source: pa.NativeFile, start: int, end: int, size: int) -> Iterator[tuple[int, dict]]:
    """Offset and record of every member that starts in [start, end)."""
    data = source.read_at(min(end + len(MAGIC) - 1, size) - start, start)
    view = memoryview(data)
    place = data.find(MAGIC)
    while 0 <= place and start + place < end:
        found = decoded(source, view, start, start + place, size)
        if found:
            yield start + place, found[0]
        place = data.find(MAGIC, found[1] - start if found else place + 1)


def read(files: DataFrame, range_bytes: int = RANGE_BYTES, batch_bytes: int = 1 << 24) -> DataFrame:
    """All records of ``files`` (path, size), by byte ranges; a revisit has no payload, only what its header declares."""
    names = [part.strip().split(" ")[0] for part in RECORDS.split(",")]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, size, start in zip(batch["path"], batch["size"], batch["start"]):
                store, name = store_of(path)
                held, weight = [], 0
                with store.open_input_file(name) as source:
                    for offset, found in owned(source, int(start), min(int(start) + range_bytes, int(size)), int(size)):
                        held.append(found | {"path": path, "offset": offset})
                        weight += found["declared_bytes"]
                        if weight > batch_bytes:
                            yield _frame(held, names)
                            held, weight = [], 0
                if held:
                    yield _frame(held, names)

    ranges = files.where("size > 0").select(
        "path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1,
                                             F.lit(range_bytes).cast("long"))).alias("start"))
    held = files.agg(F.sum("size"), F.sum(F.ceil(F.col("size") / range_bytes))).first()
    cores = files.sparkSession.sparkContext.defaultParallelism
    # A number that is asked for is kept: ranges are small rows, and Spark would read all of them in one task.
    tasks = max(1, min(int(held[1] or 0), max(2 * cores, (held[0] or 0) // TASK_BYTES)))
    return ranges.repartition(tasks, F.col("path"), F.col("start")).mapInPandas(scan, RECORDS)


def _frame(held: list[dict], names: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(held, columns=names)
    return frame.astype({"page_id": "Int64", "refers_to": "Int64"})


def archived(pages: DataFrame) -> DataFrame:
    """Write and read back: per page ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    Length and digest of a response are those of the payload read back; a revisit has them from its own record.
    """
    back = read(write(pages))
    kept = F.col("payload").isNotNull()
    return back.select(
        "page_id",
        F.when(kept, F.octet_length("payload")).otherwise(F.col("declared_bytes")).cast("long").alias("payload_bytes"),
        F.when(kept, F.sha2("payload", 256)).otherwise(F.col("declared_digest")).alias("payload_digest"),
        "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload) AS n, sha256(payload) AS h FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d
), r AS (
  SELECT *, n >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first AS again FROM f
)
SELECT page_id, n::BIGINT AS payload_bytes, h AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first END AS refers_to
FROM r"""
