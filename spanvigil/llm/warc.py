"""WARC archives: a writer with revisit records and a salvage reader.

Each task writes archives of bounded size into a shared folder, one gzip member per
record.  Names are unique to an attempt, and only archives listed in the committed
manifest are read, so a repeated or lost attempt leaves nothing that counts.

The reader checks every member (gzip trailer, version line, lengths, payload
digest).  After a failed check it looks for the next place where a valid member
starts (in an uncompressed archive: the next version line), goes on from there, and
logs the bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanvigil.llm.text import utf8
from spanvigil.session import checkpoint_dir, materialise

#: Payload bytes after which a task begins another archive.
ARCHIVE_BYTES = 32 << 20
#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 0
#: Tasks that read archives, at most; beyond that a task reads several.
READ_TASKS = 4096
CHUNK = 1 << 20
VERSION = b"WARC/1.1"

_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:x-page:{'' if page is None else page}:{digest}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record's bytes; a revisit keeps the response's head and not its payload."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    lines = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page, digest)}",
        f"WARC-Date: {_DATE}",
        "WARC-Target-URI: " + re.sub(r"[\r\n]", " ", url or ""),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Profile: {_REVISIT_PROFILE}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its file system: a bare path is one of Hadoop's default, not of a task's own disk."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))


def _writer(folder: str, archive_bytes: int, packed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _place(folder)
        handle, path, held, count = None, "", 0, 0
        done: list[tuple[str, int]] = []
        for batch in batches:
            for page, url, payload, refers in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if handle is None:
                    path = f"{uuid.uuid4().hex}.warc" + ".gz" * packed
                    handle, held, count = store.open_output_stream(f"{top}/{path}", compression=None), 0, 0
                body = record(page, url, payload, base32_sha1(payload), refers)
                if packed:
                    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
                    body = squeeze.compress(body) + squeeze.flush()
                handle.write(body)
                held, count = held + len(payload), count + 1
                if held >= archive_bytes:
                    handle.close()
                    done.append((path, count))
                    handle = None
        if handle is not None:
            handle.close()
            done.append((path, count))
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "records"]
        )

    return run


def write_archives(
    pages: DataFrame,
    folder: str,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    least_bytes: int = LEAST_BYTES,
    archive_bytes: int = ARCHIVE_BYTES,
    packed: bool = True,
) -> DataFrame:
    """Write a record per page; returns the committed manifest ``path, records``.

    Of pages with equal payloads the one with the largest id is the response, the
    others revisit it.  Pages with a null id are responses and are never referred
    to; repeated rows of the largest id are all responses.  A null html is an empty
    payload, a null url an empty one.
    """
    spark = pages.sparkSession
    folder = _qualified(spark, folder)
    store, top = _place(folder)
    store.create_dir(top, recursive=True)
    rows = pages.select(F.col(key).cast("long").alias("page"), F.col(url).cast("string").alias("url"), utf8(html).alias("payload"))
    # Only ids and digests are compared; a payload that many pages share is a map-side maximum.
    prints = materialise(rows.where("page is not null").select("page", F.sha1("payload").alias("print"), F.octet_length("payload").alias("n")))
    kept = prints.where(F.col("n") >= least_bytes).groupBy("print").agg(F.max("page").alias("refers"), F.min("page").alias("least"))
    again = kept.where("least < refers").select("print", "refers")
    revisits = materialise(prints.join(again, "print").where("page < refers").select("page", "print", "refers").distinct())
    named = rows.withColumn("print", F.sha1("payload")).join(revisits, ["page", "print"], "left").select("page", "url", "payload", "refers")
    return materialise(named.mapInArrow(_writer(folder, archive_bytes, packed), "path string, records long"))


# --- reading -------------------------------------------------------------------
class BadRecord(ValueError):
    """A check failed; the message says which."""


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at ``at``; raises BadRecord."""
    if data[at : at + 7] != b"WARC/1.":
        raise BadRecord("version line")
    head = data.find(b"\r\n\r\n", at)
    if head < 0:
        raise BadRecord("header end")
    headers = {}
    for line in data[at:head].split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        headers[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,15}", length):
        raise BadRecord("content length")
    start = head + 4
    end = start + int(length)
    if end > len(data) or data[end : end + 4] != b"\r\n\r\n":
        raise BadRecord("record length")
    block = data[start:end]
    stated = headers.get("warc-block-digest", "")
    if stated.startswith("sha1:") and stated[5:] != base32_sha1(block):
        raise BadRecord("block digest")
    return headers, block, end + 4


def _page_of(identifier: str | None) -> int | None:
    found = re.match(r"<urn:x-page:(-?[0-9]+):", identifier or "")
    return int(found[1]) if found else None


def page_row(headers: dict[str, str], block: bytes) -> tuple:
    """page id, payload bytes, payload digest, record type, page referred to."""
    kind = headers.get("warc-type", "")
    head, gap, payload = block.partition(b"\r\n\r\n")
    stated = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "revisit":
        length = re.search(rb"(?i)\r\ncontent-length: *([0-9]+)", b"\r\n" + head)
        size, digest = (int(length[1]) if length else None), stated
    else:
        size, digest = len(payload), base32_sha1(payload)
        if stated and stated != digest:
            raise BadRecord("payload digest")
    refers = _page_of(headers.get("warc-refers-to")) if kind == "revisit" else None
    return _page_of(headers.get("warc-record-id")), size, digest, kind, refers


def _unzip(source, at: int, size: int) -> tuple[bytes, int]:
    """The member at ``at`` and its end; raises BadRecord."""
    squeeze, parts, here = zlib.decompressobj(31), [], at
    while not squeeze.eof:
        chunk = source.read_at(min(CHUNK, size - here), here)
        if not chunk:
            raise BadRecord("member cut off")
        try:
            parts.append(squeeze.decompress(chunk))
        except zlib.error as error:
            raise BadRecord("gzip member") from error
        here += len(chunk)
    return b"".join(parts), here - len(squeeze.unused_data)


def _records(data: bytes) -> tuple[list[tuple], list[str]]:
    """Rows of a member's records, and what its damaged stretches are.

    After a failed check the next version line is tried, so one bad record does not
    take its neighbours along.  A member without a valid record raises BadRecord.
    """
    found, gaps, at, bad, reason = [], [], 0, None, "empty member"
    while at < len(data):
        try:
            headers, block, end = parse_record(data, at)
            row = page_row(headers, block)
        except BadRecord as error:
            if bad is None:
                bad, reason = at, str(error)
            at = data.find(b"WARC/1.", at + 1)
            at = len(data) if at < 0 else at
            continue
        if bad is not None:
            gaps.append(f"{reason}, inflated bytes {bad} to {at}")
            bad = None
        found.append(row)
        at = end
    if not found:
        raise BadRecord(reason)
    if bad is not None:
        gaps.append(f"{reason}, inflated bytes {bad} to {len(data)}")
    return found, gaps


def _find(source, mark: bytes, at: int, size: int) -> int:
    """Next place of ``mark`` from ``at`` on, or ``size``."""
    while at < size:
        chunk = source.read_at(min(CHUNK + len(mark), size - at), at)
        found = chunk.find(mark)
        if found >= 0:
            return at + found
        at += CHUNK
    return size


def salvage(source, size: int) -> Iterator[tuple[str, int, int, object]]:
    """("record", start, end, row) and ("gap", start, end, reason), in file order.

    Every byte of the file belongs to a record or a gap.  ``source`` reads at
    offsets; a packed archive is held one member at a time.  Records and gaps of one
    member all carry the member's place; such a gap's reason tells the inflated bytes.
    """
    packed = source.read_at(min(2, size), 0) == b"\x1f\x8b"
    if not packed and _find(source, b"\x1f\x8b\x08", 0, size) < _find(source, b"WARC/1.", 0, size):
        packed = True  # a damaged beginning
    whole = b"" if packed else source.read_at(size, 0)
    at, bad, reason = 0, None, ""
    while at < size:
        try:
            if packed:
                data, end = _unzip(source, at, size)
                found, gaps = _records(data)
            else:
                headers, block, end = parse_record(whole, at)
                found, gaps = [page_row(headers, block)], []
        except BadRecord as error:
            if bad is None:
                bad, reason = at, str(error)
            at = _find(source, b"\x1f\x8b\x08", at + 1, size) if packed else whole.find(b"WARC/1.", at + 1)
            at = size if at < 0 else at
            continue
        if bad is not None:
            yield "gap", bad, at, reason
            bad = None
        for row in found:
            yield "record", at, end, row
        for reason_inside in gaps:
            yield "gap", at, end, reason_inside
        at = end
    if bad is not None:
        yield "gap", bad, size, reason


RECORDS = (
    "path string, kind string, start long, stop long, reason string, "
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
)


def _reader(folder: str):
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = [part.split()[0] for part in RECORDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _place(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with store.open_input_file(f"{top}/{path}") as source:
                    for kind, start, end, what in salvage(source, source.size()):
                        if kind == "gap":
                            rows.append((path, kind, start, end, what, None, None, None, None, None))
                        else:
                            rows.append((path, kind, start, end, None, *what))
                        if len(rows) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return run


def read_archives(paths: DataFrame, folder: str) -> DataFrame:
    """Records and gaps of the archives in ``paths`` (a column ``path``), RECORDS.

    Archives are dealt over the tasks one by one, as many tasks as archives up to
    ``READ_TASKS``: a manifest is tiny, so its own size says nothing about the work.
    An archive without any valid record is one gap; an empty one gives nothing.
    """
    folder = _qualified(paths.sparkSession, folder)
    spread = paths.select("path").repartition(max(1, min(READ_TASKS, paths.count())))
    return spread.mapInArrow(_reader(folder), RECORDS)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the pages as archives, read these back: a row per page found."""
    spark = pages.sparkSession
    folder = folder or f"{checkpoint_dir(spark)}/warc/{uuid.uuid4().hex}"
    manifest = write_archives(pages, folder)
    found = read_archives(manifest, folder)
    # What was just written has no gaps; one would be a lost page, so it ends the job.
    lost = F.raise_error(F.concat(F.lit("gap in "), "path", F.lit(": "), F.coalesce("reason", F.lit(""))))
    found = found.where(F.when(F.col("kind") == "record", True).otherwise(lost.cast("boolean")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
