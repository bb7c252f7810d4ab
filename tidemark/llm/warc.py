"""WARC archives: one gzip member per record, read back as a stream."""

from __future__ import annotations

import base64
import hashlib
import re
import sys
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.shared import broadcast_if_small, text_or_empty
from tidemark.sources.workspace import through_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A repeated payload is a hash and an id; so many are at most some 60 MB when broadcast.
MOST_BROADCAST_PAYLOADS = 500_000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_READ = 1 << 18
_RECORD = (
    "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, "
    "payload_bytes long, payload binary, archive string, offset long"
)


def _sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def _filesystem(uri: str):
    """File system and path of a URI such as file:/x, /x, s3://b/x or hdfs://h/x."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def _one_line(value: str | None) -> str:
    return re.sub(r"[\x00-\x1F\x7F]+", " ", value or "").strip()


def _record(record_id: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """One record, uncompressed. A revisit holds the response's headers without its payload."""
    block = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    ).encode("ascii")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    lines += [f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if _one_line(uri):
        lines.append(f"WARC-Target-URI: {_one_line(uri)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is None:
        block += payload
    else:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    lines += [f"WARC-Block-Digest: sha1:{_sha1(block)}", "Content-Type: application/http;msgtype=response"]
    lines += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "replace") + block + b"\r\n\r\n"


def write_warc(
    records: DataFrame,
    folder: str,
    id_col: str = "page_id",
    uri_col: str = "url",
    payload_col: str = "html",
    least_bytes: int = 0,
    date: str = "1970-01-01T00:00:00Z",
    archive_bytes: int = 1 << 30,
) -> DataFrame:
    """Write a record per row into ``folder``; returns the manifest (archive, records, bytes).

    Of rows with equal payloads of at least ``least_bytes`` bytes that with the largest id is a
    response and the others revisit it; smaller ones are all responses. The payload is the text
    in UTF-8, null counts as empty. Rows that repeat the largest id are all responses. A row
    without id is never the one revisited unless its whole group has none; then all are
    responses. A null address is left out of the header. An empty table writes no archive.

    A task writes archives under names of its own and starts a new one after
    ``archive_bytes``. The manifest is committed by Spark, so files of failed or repeated
    attempts are never read. ``folder`` is a place all executors reach.
    """
    base = records.select(
        F.col(id_col).alias("id"),
        F.col(uri_col).cast("string").alias("uri"),
        text_or_empty(payload_col).alias("payload"),
    ).withColumn("digest", F.unhex(F.sha1("payload")))
    repeated = (
        base.where(F.octet_length("payload") >= least_bytes)
        .groupBy("digest")
        .agg(F.max("id").alias("response"), F.count("*").alias("n"))
        .where("n > 1 AND response IS NOT NULL")
        .drop("n")
    )
    repeated, _ = broadcast_if_small(through_table(repeated, "warc-payloads"), MOST_BROADCAST_PAYLOADS)
    rows = base.join(repeated, "digest", "left").select(
        F.col("id").cast("string").alias("id"),
        "uri",
        "payload",
        F.when(~F.col("id").eqNullSafe(F.col("response")), F.col("response")).cast("string").alias("response"),
    )

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = _filesystem(folder)
        out, path, count, size, done = None, "", 0, 0, []
        for batch in batches:
            for key, uri, text, response in zip(batch["id"], batch["uri"], batch["payload"], batch["response"]):
                if out is None:
                    system.create_dir(root, recursive=True)
                    path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out, count, size = system.open_output_stream(path, compression=None), 0, 0
                payload = text.encode("utf-8", "surrogatepass")
                name = "urn:record:" + (key if isinstance(key, str) else "")
                refers = f"urn:record:{response}" if isinstance(response, str) else None
                plain = _record(name, uri if isinstance(uri, str) else None, payload, _sha1(payload), refers, date)
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = packer.compress(plain) + packer.flush()
                out.write(member)
                count, size = count + 1, size + len(member)
                if size >= archive_bytes:
                    out.close()
                    done.append((path, count, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, count, size))
        yield pd.DataFrame(done, columns=["archive", "records", "bytes"])

    return through_table(rows.mapInPandas(write, "archive string, records long, bytes long"), "warc-manifest")


class WarcError(ValueError):
    """An archive that breaks the format or a digest."""


def _members(stream) -> Iterator[tuple[int, Iterator[bytes]]]:
    """Offset and decompressed pieces of each gzip member, read in order from ``stream``."""
    held, at = b"", 0
    while True:
        held = held or stream.read(_READ)
        if not held:
            return
        inflate, begin = zlib.decompressobj(31), at

        def pieces() -> Iterator[bytes]:
            nonlocal held, at
            while not inflate.eof:
                held = held or stream.read(_READ)
                if not held:
                    raise WarcError(f"member at {begin} is cut off")
                before = len(held)
                piece = inflate.decompress(held, 1 << 20)
                held = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
                at += before - len(held)
                if piece:
                    yield piece

        yield begin, pieces()


def _parse(begin: int, pieces: Iterator[bytes]) -> dict:
    """The one record of a member, checked against its lengths and digests."""
    head = bytearray()
    while (cut := head.find(b"\r\n\r\n")) < 0:
        piece = next(pieces, None)
        if piece is None:
            raise WarcError(f"record at {begin} has no end of headers")
        head += piece
    lines = head[:cut].decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise WarcError(f"record at {begin} has no version line")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length = int(fields["content-length"])
    block = head[cut + 4 :]
    del head
    for piece in pieces:  # to the member's end, so that its checksum is verified too
        block += piece
    if len(block) != length + 4 or block[length:] != b"\r\n\r\n":
        raise WarcError(f"record at {begin}: {len(block) - 4} bytes, {length} announced")
    del block[length:]
    if (told := fields.get("warc-block-digest")) and told != f"sha1:{_sha1(block)}":
        raise WarcError(f"record at {begin}: block digest differs")
    end = block.find(b"\r\n\r\n")
    http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in block[:end].decode("latin-1").split("\r\n")[1:])}
    payload = bytes(block[end + 4 :])
    kind, digest = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and (len(payload) != int(http.get("content-length", len(payload))) or _sha1(payload) != digest):
        raise WarcError(f"record at {begin}: payload differs from its length or digest")
    return {
        "record_id": fields["warc-record-id"].strip("<>"),
        "record_type": kind,
        "target_uri": fields.get("warc-target-uri"),
        "refers_to": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
        "payload_digest": digest,
        "payload_bytes": int(http.get("content-length", len(payload))),
        "payload": payload if kind == "response" else None,
        "offset": begin,
    }


def read_warc(
    spark: SparkSession, manifest: DataFrame, payloads: bool = True, task_bytes: int = 256 << 20
) -> DataFrame:
    """Records of the manifest's archives, one task reading an archive from front to back.

    There is a task for each ``task_bytes`` of archives or each core, whichever makes more
    tasks, and no more tasks than archives. A list without ``bytes`` has a task an archive.

    Each gzip member is inflated piece by piece and must hold one record; its length framing,
    gzip checksum, block digest and (of responses) payload digest are verified, and a
    violation raises ``WarcError``. A task holds one record and a batch of at most 8 MB of
    payloads. Without ``payloads`` the column is null. Revisits have the length and digest of
    the payload they stand for. No archives give no rows.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in _RECORD.split(", ")]
        for batch in batches:
            for path in batch["archive"]:
                system, place = _filesystem(path)
                rows, held = [], 0
                with system.open_input_stream(place, compression=None) as stream:
                    for begin, pieces in _members(stream):
                        row = _parse(begin, pieces) | {"archive": path}
                        if not payloads:
                            row["payload"] = None
                        held += len(row["payload"] or b"")
                        rows.append(row)
                        if held > 8 << 20 or len(rows) >= 5000:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    tasks = archives = manifest.count()
    if "bytes" in manifest.columns:
        total = manifest.agg(F.sum("bytes")).first()[0] or 0
        tasks = max(-(-total // task_bytes), spark.sparkContext.defaultParallelism)
    paths = manifest.select("archive").repartition(max(1, min(archives, tasks)))
    return paths.mapInPandas(read, _RECORD)
