"""Zstandard WARC archives: a writer with identical-payload revisits and a validating reader.

An archive starts with a skippable frame that holds a Zstandard dictionary, trained on the payloads
that open the archive; then each record is one frame. Few or uniform payloads give no dictionary;
such an archive has no leading frame, and the reader takes either kind.

Defined cases: a null payload is empty; null ids and urls are written empty and read back as null;
repeated rows give a record each; an empty table gives no archive and no rows; other input columns
are ignored. A frame that is cut, has a bad header or another length than it says comes back with
its `error` set; the frames after a cut can't be found, and nothing is dropped silently.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, stage

SKIPPABLE = 0x184D2A5D.to_bytes(4, "little")
ZSTD = 0xFD2FB528.to_bytes(4, "little")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = (
    "page_id long, target_uri string, record_type string, refers_to long, payload_bytes long,"
    " payload_digest string, payload binary, error string"
)


def plan_records(pages: DataFrame, min_bytes: int = 1000, broadcast_rows: int = 500_000) -> DataFrame:
    """Adds to page_id, url, html: sha1, and refers_to, the page that holds an equal payload in full.

    Only digests seen at least twice are joined back. Their number decides the join: up to
    broadcast_rows of them are sent to every executor, more go through a shuffle that splits hot keys.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select("page_id", "url", body.alias("html"), F.sha1(body).alias("sha1"))
    twins = stage(
        keyed.where(F.octet_length("html") >= min_bytes).groupBy("sha1")
        .agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).where("n > 1").select("sha1", "holder"),
        "twins",
    )
    few = twins.count() <= broadcast_rows
    joined = keyed.join(F.broadcast(twins) if few else twins, "sha1", "left")
    if not few:
        joined = joined.sortWithinPartitions("page_id")  # a task that runs again writes the same archives
    return joined.select("page_id", "url", "html", "sha1", F.expr("if(page_id <> holder, holder, null)").alias("refers_to"))


def _field(value: str) -> str:
    """A header value: line ends and % are escaped."""
    return re.sub(r"[\r\n%]", lambda m: f"%{ord(m[0]):02X}", value)


def _unfield(value: str) -> str:
    return re.sub(r"%(0D|0A|25)", lambda m: chr(int(m[1], 16)), value)


def encode_record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, date: str) -> bytes:
    digest = "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        *([] if url is None else [f"WARC-Target-URI: {_field(url)}"]),
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: {digest}",
        *([] if refers_to is None else [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train_dictionary(payloads: list[bytes], size: int = 32 << 10) -> bytes:
    """A dictionary for payloads like these, or b'' where they are too few."""
    try:
        return zstandard.train_dictionary(size, payloads).as_bytes() if len(payloads) >= 16 else b""
    except zstandard.ZstdError:
        return b""


class _Archive:
    """One archive being written; it appears under its own name only when complete."""

    def __init__(self, fs: pyarrow.fs.FileSystem, folder: str, name: str, samples: list[bytes], level: int):
        self.fs, self.name, self.raw = fs, f"{folder}/{name}", 0
        self.part = f"{folder}/.{name}-{TaskContext.get().taskAttemptId()}"
        fs.create_dir(folder, recursive=True)
        self.out = fs.open_output_stream(self.part)
        trained = train_dictionary(samples)
        if trained:
            self.out.write(SKIPPABLE + len(trained).to_bytes(4, "little") + trained)
        self.zstd = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None, write_checksum=True)

    def add(self, record: bytes) -> None:
        self.out.write(self.zstd.compress(record))
        self.raw += len(record)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.part, self.name)


def write_archives(
    plan: DataFrame, folder: str, *, archive_bytes: int = 128 << 20, sample_bytes: int = 2 << 20, level: int = 3,
    date: str = "2024-01-01T00:00:00Z",
) -> int:
    """Write a record for each row of plan_records(); the number of records. An archive takes about
    archive_bytes of records; its dictionary is trained on its first sample_bytes of payloads."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = pyarrow.fs.FileSystem.from_uri(folder)
        part, made, done = TaskContext.get().partitionId(), 0, 0
        archive: _Archive | None = None
        held: list[tuple] = []  # rows kept back until the samples suffice

        def flush() -> None:
            nonlocal archive, made
            if held and archive is None:
                archive = _Archive(fs, at, f"part-{part:06d}-{made:05d}.warc.zst", [r[2] for r in held if r[2]], level)
                made += 1
            for r in held:
                archive.add(encode_record(*r, date))
            held.clear()
            if archive is not None and archive.raw >= archive_bytes:
                archive.close()
                archive = None

        kept = 0
        for batch in batches:
            for i in range(batch.num_rows):
                page, url, html, sha1, refers = (c[i].as_py() for c in batch.columns)
                held.append((page, url, html.encode(), sha1, refers))
                kept, done = kept + len(held[-1][2]), done + 1
                if kept >= sample_bytes:
                    flush()
                    kept = 0
        flush()
        if archive is not None:
            archive.close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([done], pa.int64())})

    path = plan.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(plan.sparkSession._jsc.hadoopConfiguration()).mkdirs(path)
    return plan.mapInArrow(task, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def frame_end(buf: memoryview, at: int) -> int:
    """Where the frame that starts at `at` ends, found from its block headers; ValueError if it is cut."""
    size = zstandard.frame_header_size(buf[at : at + 18])
    checksum = 4 if buf[at + 4] & 4 else 0
    at, last = at + size, False
    while not last:
        if at + 3 > len(buf):
            raise ValueError("cut frame")
        head = int.from_bytes(buf[at : at + 3], "little")
        last, kind, length = head & 1, head >> 1 & 3, head >> 3
        at += 3 + (1 if kind == 1 else length)
    if at + checksum > len(buf):
        raise ValueError("cut frame")
    return at + checksum


def parse_record(data: bytes) -> dict:
    """The fields of one record; ValueError says what is wrong with it."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC header")
    fields = dict(line.split(": ", 1) for line in lines[1:] if ": " in line)
    if len(fields) != len(lines) - 1:
        raise ValueError("bad header line")
    if missing := {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} - fields.keys():
        raise ValueError(f"without {min(missing)}")
    if not fields["Content-Length"].isdigit() or len(rest) != int(fields["Content-Length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("another length than Content-Length")
    http, gap, payload = rest[:-4].partition(b"\r\n\r\n")
    length = re.search(rb"\r\nContent-Length: (\d+)(?:\r\n|$)", http)
    if not gap or not length:
        raise ValueError("no HTTP header")
    page = re.fullmatch(r"<urn:page:(-?\d*)>", fields["WARC-Record-ID"])
    refers = re.fullmatch(r"<urn:page:(-?\d+)>", fields.get("WARC-Refers-To", ""))
    kind = fields["WARC-Type"]
    if not page or kind not in ("response", "revisit") or (kind == "revisit") != bool(refers):
        raise ValueError("bad record type or id")
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if kind == "response" and (len(payload) != int(length[1]) or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("payload of another length or digest")
    if kind == "revisit" and payload:
        raise ValueError("revisit with a payload")
    uri = fields.get("WARC-Target-URI")
    return {
        "page_id": int(page[1]) if page[1] else None, "target_uri": None if uri is None else _unfield(uri),
        "record_type": kind, "refers_to": int(refers[1]) if refers else None, "payload_bytes": int(length[1]),
        "payload_digest": digest, "payload": payload, "error": None,
    }


def iterate_archive(content: bytes, max_record: int = 1 << 30) -> Iterator[dict]:
    """The records of one archive in order."""
    buf, at = memoryview(content), 0
    broken = dict.fromkeys(("page_id", "target_uri", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"))
    trained = None
    if content[:4] == SKIPPABLE:
        at = 8 + int.from_bytes(buf[4:8], "little")
        stored = bytes(buf[8:at])
        if stored[:4] == ZSTD:  # the dictionary may itself be compressed
            stored = zstandard.ZstdDecompressor().decompress(stored, max_output_size=1 << 26)
        trained = zstandard.ZstdCompressionDict(stored)
    zstd = zstandard.ZstdDecompressor(dict_data=trained) if trained else zstandard.ZstdDecompressor()
    while at < len(buf):
        try:
            end = frame_end(buf, at)
        except (ValueError, zstandard.ZstdError) as e:
            yield broken | {"error": f"at byte {at}: {e}"}
            return
        try:
            if zstandard.get_frame_parameters(buf[at : at + 18]).content_size > max_record:
                raise ValueError("too large")
            yield parse_record(zstd.decompress(buf[at:end], max_output_size=max_record if zstandard.frame_content_size(buf[at : at + 18]) < 0 else 0))
        except (ValueError, zstandard.ZstdError) as e:
            yield broken | {"error": f"at byte {at}: {e}"}
        at = end


def read_archives(spark, folder: str, *, with_payload: bool = True, batch_bytes: int = 8 << 20) -> DataFrame:
    """A row for each record under folder. Without payload, that column is null."""
    schema = pa.schema([("page_id", pa.int64()), ("target_uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("error", pa.string())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for r in iterate_archive(content.as_py()):
                    if with_payload:
                        size += len(r["payload"] or b"")
                    else:
                        r["payload"] = None
                    rows.append(r)
                    if size >= batch_bytes or len(rows) >= 4096:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content")
    return files.mapInArrow(task, RECORD)


def round_trip(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Write pages to archives in the shared folder and read them back."""
    folder = new_path(pages.sparkSession, "warc")
    write_archives(plan_records(pages, min_bytes), folder)
    return read_archives(pages.sparkSession, folder, with_payload=False)
