"""WARC archives: a writer and a splittable reader.

**Writing.** Each task writes one archive of gzip members, one member a record, under a name of its own try. Only
names that the committed manifest lists count, so tasks may be tried again or run twice.

**Reading.** A task gets a byte range. It looks for the gzip magic, takes a place as a member only if what decodes
there begins as a WARC header, and owns the records that start inside its range; the last may end beyond it. So any
cut of the files gives every record once. UTF-8 text cannot hold the magic, and a compressed body that holds it by
chance does not decode to a header.

Defined cases: a null payload is empty; a null page id or url leaves its header out and reads as null; rows that
repeat a page id are records of their own, and all that carry the smallest id of their payload are responses; an
empty table writes no archive; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddrows.llm.common import lookup, materialize, scratch_path, text_of

MAGIC = b"\x1f\x8b\x08"
END = b"\r\n\r\n"
MIN_REVISIT = 100
SPLIT_BYTES = 8 << 20
READ_BYTES = 1 << 18
PLAN_SCHEMA = "page_id long, url string, payload binary, digest string, refers_to long"
RECORD_SCHEMA = "page_id long, url string, record_type string, payload binary, payload_length long, digest string, refers_to long"


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """What to write for each page: its payload, digest, and for a revisit the page it refers to."""
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), text_of(html_col).cast("binary").alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    # The digest is counted with map-side combine; only payloads that occur more than once go on.
    groups = (
        rows.where(F.octet_length("payload") >= min_revisit)
        .groupBy("digest").agg(F.count(F.lit(1)).alias("__n"), F.min("page_id").alias("first_id"))
        .where("__n > 1")
    )
    total = pages.count()
    return lookup(rows, groups, ["digest"], "__n", total).select(
        "page_id", "url", "payload", "digest", F.when(F.col("first_id") != F.col("page_id"), F.col("first_id")).alias("refers_to")
    )


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}:{digest}')}>"


def _member(header: list[str], block: bytes, level: int) -> bytes:
    head = "\r\n".join(["WARC/1.1", *header, f"Content-Length: {len(block)}"]).encode() + END
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(head + block + END) + z.flush()


def encode_record(page_id, url, payload: bytes, digest: str, refers_to, date: str, level: int) -> bytes:
    """One gzip member."""
    header = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        header.append("WARC-Target-URI: " + url.replace("%0D", "%250D").replace("%0A", "%250A").replace("\r", "%0D").replace("\n", "%0A"))
    header += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}"]
    if page_id is not None:
        header.append(f"Page-ID: {page_id}")
    if refers_to is not None:
        header += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"Refers-To-Page-ID: {refers_to}",
        ]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}".encode() + END
    return _member(header, http + (payload if refers_to is None else b""), level)


def write_warc(plan: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z", level: int = 6) -> DataFrame:
    """Write the planned records below ``folder``; gives the manifest: path, bytes, records."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = out = None
        path, size, n = f"{folder}/part-{uuid.uuid4().hex}.warc.gz", 0, 0
        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*[batch.column(i) for i in range(5)]):
                if out is None:
                    store, at = pafs.FileSystem.from_uri(path)
                    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
                    out = store.open_output_stream(at, compression=None)
                    info = _member(["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}", "Content-Type: application/warc-fields"], b"format: WARC File Format 1.1\r\n", level)
                    size += out.write(info) or len(info)
                data = encode_record(page_id.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers_to.as_py(), date, level)
                out.write(data)
                size, n = size + len(data), n + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [size], "records": [n]})

    return materialize(plan.mapInArrow(task, "path string, bytes long, records long"))


def _find(f, start: int, end: int) -> int:
    """First place in [start, end) where the magic begins, or -1; it may reach over ``end``."""
    at = start
    while at < end:
        f.seek(at)
        found = f.read(min(READ_BYTES, end - at) + len(MAGIC) - 1).find(MAGIC)
        if found >= 0:
            return at + found if at + found < end else -1
        at += min(READ_BYTES, end - at)
    return -1


def _decode(f, at: int) -> tuple[dict, bytes, int] | None:
    """Header, block and the place after the member at ``at``; None if none is there."""
    z, out, place = zlib.decompressobj(31), bytearray(), at
    f.seek(at)
    try:
        while not z.eof:
            data = f.read(READ_BYTES if out else 1 << 12)
            if not data:
                return None
            out += z.decompress(data)
            place += len(data)
            if len(out) >= 5 and not out.startswith(b"WARC/"):
                return None
    except zlib.error:
        return None
    head, found, rest = bytes(out).partition(END)
    lines = head.decode("utf-8", "replace").split("\r\n")
    header = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    if not found or not header.get("content-length", "").isdigit():
        return None
    return header, rest[: int(header["content-length"])], place - len(z.unused_data)


def read_range(f, start: int, end: int) -> Iterator[tuple[dict, bytes]]:
    """The records that start in [start, end) of an open file."""
    while 0 <= (at := _find(f, start, end)):
        member = _decode(f, at)
        if member is None:
            start = at + 1
        else:
            yield member[:2]
            start = member[2]
        if start >= end:
            return


def _row(header: dict, block: bytes) -> tuple:
    http, _, payload = block.partition(END)
    length = next((int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.lower() == b"content-length"), len(payload))
    url = header.get("warc-target-uri")
    if url is not None:
        url = url.replace("%0D", "\r").replace("%0A", "\n").replace("%250D", "%0D").replace("%250A", "%0A")
    number = lambda k: int(header[k]) if k in header else None
    kind = header["warc-type"]
    return number("page-id"), url, kind, payload if kind == "response" else None, length, header["warc-payload-digest"].removeprefix("sha256:"), number("refers-to-page-id")


def read_warc(spark: SparkSession, files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Response and revisit records of ``files`` (path, bytes), read by byte ranges."""
    ranges = files.select("path", F.col("bytes").cast("long").alias("bytes")).where("bytes > 0").select(
        "path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start")
    )
    ranges = ranges.repartition(max(1, ranges.count()), F.xxhash64("path", "start"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()),
            ("payload_length", pa.int64()), ("digest", pa.string()), ("refers_to", pa.int64()),
        ])
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
        for batch in batches:
            for path, size, start in zip(*[c.to_pylist() for c in batch.columns]):
                store, at = pafs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_file(at) as f:
                    for header, block in read_range(f, start, min(size, start + split_bytes)):
                        if header.get("warc-type") in ("response", "revisit"):
                            rows.append(_row(header, block))
                            held += len(block)
                        if held > 1 << 22 or len(rows) >= 2000:
                            yield pack(rows)
                            rows, held = [], 0
                if rows:
                    yield pack(rows)

    return ranges.mapInArrow(task, RECORD_SCHEMA)


def warc_round_trip(pages: DataFrame, min_revisit: int = MIN_REVISIT, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Every page written to archives in the shared folder and read back."""
    spark = pages.sparkSession
    manifest = write_warc(plan_records(pages, min_revisit=min_revisit), scratch_path(spark, "warc"))
    return read_warc(spark, manifest, split_bytes)
