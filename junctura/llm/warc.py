"""WARC archives: a writer with one gzip member per record, and a sequential reader."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import IO
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.llm.shared import new_path, stage

VERSION = b"WARC/1.1"
DATE = "2025-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Bytes after which a task goes on with another archive, and bytes read or inflated at a time.
ARCHIVE_BYTES = 256 << 20
STEP = 1 << 16
HEADER_MOST = 1 << 20


class WarcError(ValueError):
    """An archive that breaks the format."""


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: object) -> str:
    """The id of a page's record; the page's number is its last part. A null page has no number."""
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(name: str | None) -> str | None:
    """The page that a record id names."""
    page = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return page or None


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as a gzip member of its own."""
    lines = [VERSION] + [f"{k}: {v}".encode() for k, v in headers]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def page_record(page_id: object, url: str | None, payload: bytes, refers_to: object = None) -> bytes:
    """A response with the payload or, if it refers to another page, a revisit without it.

    Both keep the HTTP headers, which give the payload's length, and its digest.
    """
    uri = quote(url or "", safe=":/?#[]@!$&'()*+,;=%~")
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if refers_to is not None else http + payload
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
    ]
    if refers_to is not None:
        headers += [("WARC-Refers-To", record_id(refers_to)), ("WARC-Profile", PROFILE)]
    headers += [
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return _member(headers, block)


@dataclass
class Record:
    """A record read back; the digests are those found, not those stated."""

    offset: int
    headers: dict[str, str]
    block_bytes: int
    block_digest: str
    http: bytes
    payload: bytes
    payload_bytes: int
    payload_digest: str


class _Inflater:
    """The plain bytes of one gzip member after another, inflated a step at a time."""

    def __init__(self, source: IO[bytes], step: int) -> None:
        self.source, self.step = source, step
        self.read_bytes, self.spare = 0, b""
        self.engine = None

    def _more(self) -> bytes:
        if self.spare:
            data, self.spare = self.spare, b""
            return data
        data = self.source.read(self.step)
        self.read_bytes += len(data)
        return data

    def next_member(self) -> int | None:
        """Start on the next member; its offset, or None at the end of the archive."""
        data = self._more()
        if not data:
            return None
        self.spare = data
        self.engine = zlib.decompressobj(31)
        return self.read_bytes - len(data)

    def inflate(self) -> bytes:
        """Up to a step of plain bytes of this member; none at its end."""
        engine = self.engine
        while not engine.eof:
            data = engine.unconsumed_tail or self._more()
            if not data:
                raise WarcError("the archive ends inside a gzip member")
            try:
                plain = engine.decompress(data, self.step)
            except zlib.error as broken:
                raise WarcError(f"broken gzip member: {broken}") from broken
            if engine.eof:
                self.spare = engine.unused_data + self.spare
            if plain:
                return plain
        return b""


def _parse_headers(head: bytes) -> dict[str, str]:
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise WarcError("a record doesn't start with its version")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise WarcError("a header line has no colon")
        headers[name.decode().strip().lower()] = value.decode().strip()
    return headers


def read_records(source: IO[bytes], step: int = STEP, keep_payload: bool = True) -> Iterator[Record]:
    """The records of an archive in order.

    A member is inflated a step at a time. Its headers end at the first empty line; Content-Length
    says how long the block is, and two line breaks and the end of the member must follow. Digests
    run along with the bytes, so without ``keep_payload`` a record needs memory for a step only.
    Anything that doesn't fit the frame raises WarcError.
    """
    inflater = _Inflater(source, step)
    while (offset := inflater.next_member()) is not None:
        head = b""
        while b"\r\n\r\n" not in head:
            plain = inflater.inflate()
            if not plain or len(head) > HEADER_MOST:
                raise WarcError("a record's headers don't end")
            head += plain
        head, _, data = head.partition(b"\r\n\r\n")
        headers = _parse_headers(head)
        length = headers.get("content-length", "")
        if not length.isdigit():
            raise WarcError("a record has no Content-Length")
        left, all_digest, own_digest = int(length), hashlib.sha1(), hashlib.sha1()
        in_http = headers.get("content-type", "").startswith("application/http")
        http, kept, size, tail = b"", [], 0, b""
        while True:
            part, tail = data[:left], tail + data[left:]
            left -= len(part)
            all_digest.update(part)
            if in_http:
                http += part
                at = http.find(b"\r\n\r\n")
                if at < 0 and len(http) > HEADER_MOST:
                    raise WarcError("the HTTP headers don't end")
                in_http, part = at < 0, b"" if at < 0 else http[at + 4 :]
                http = http if at < 0 else http[: at + 4]
            own_digest.update(part)
            size += len(part)
            if keep_payload and part:
                kept.append(part)
            if len(tail) > 4:
                raise WarcError("a record goes on after its block")
            data = inflater.inflate()
            if not data:
                break
        if left:
            raise WarcError("a record is shorter than its Content-Length")
        if tail != b"\r\n\r\n":
            raise WarcError("a record doesn't end in two line breaks")
        yield Record(
            offset,
            headers,
            int(length),
            base64.b32encode(all_digest.digest()).decode(),
            http,
            b"".join(kept),
            size,
            base64.b32encode(own_digest.digest()).decode(),
        )


def _stated_length(http: bytes) -> int | None:
    for line in http.split(b"\r\n"):
        name, _, value = line.partition(b":")
        if name.lower() == b"content-length" and value.strip().isdigit():
            return int(value)
    return None


def _open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def revisit_plan(pages: DataFrame, key: str, payload: str, least_bytes: int) -> DataFrame:
    """(key, refers_to) of the rows whose payload another row with a larger key has as well.

    Payloads meet by SHA-256 and length; only digests and keys are shuffled, and counted per digest
    before that, so any number of copies adds one row per task.
    """
    digests = pages.select(
        F.col(f"`{key}`").alias("page"),
        F.sha2(F.coalesce(F.col(f"`{payload}`"), F.lit("")).cast("binary"), 256).alias("digest"),
        F.octet_length(F.coalesce(F.col(f"`{payload}`"), F.lit(""))).alias("bytes"),
    ).filter(F.col("bytes") >= least_bytes)
    digests = stage(digests, "digests")
    last = digests.groupBy("digest", "bytes").agg(F.max("page").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    # Written, so that both sides of the join are plain shuffles, of which Spark can split a hot digest.
    last = stage(last.filter("n > 1").drop("n"), "repeated")
    joined = digests.join(last, ["digest", "bytes"])
    return joined.filter(~F.col("page").eqNullSafe(F.col("refers_to"))).select("page", "digest", "refers_to").distinct()


def write_archives(
    pages: DataFrame,
    folder: str,
    key: str = "page_id",
    url: str = "url",
    payload: str = "html",
    least_bytes: int = 0,
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write a record for each row of ``pages`` under ``folder``; returns (archive, records, bytes).

    The payload is the text in UTF-8 (null: empty). Of rows with equal payloads of at least
    ``least_bytes`` bytes the one with the largest key is a response and those with smaller keys
    revisit it; rows that also repeat that key are responses too, as nothing tells them apart. A null
    key is below all others; where it is all a payload has, its rows are responses. Shorter payloads
    are all responses. Each task writes archives of about ``archive_bytes`` bytes under a name of its
    own and renames them when complete, so a lost or repeated task leaves at most files that the
    result doesn't list. An empty table writes nothing; other columns are ignored.
    """
    plan = revisit_plan(pages, key, payload, least_bytes)
    body = F.coalesce(F.col(f"`{payload}`"), F.lit(""))
    rows = pages.select(
        F.col(f"`{key}`").alias("page"), F.col(f"`{url}`").cast("string").alias("url"), body.alias("body")
    )
    same = F.equal_null(rows.page, plan.page) & (F.sha2(rows.body.cast("binary"), 256) == plan.digest)
    rows = rows.join(plan, same, "left").select(rows.page, "url", F.col("body").cast("binary").alias("body"), "refers_to")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open_folder(folder)
        system.create_dir(base, recursive=True)
        part, made = TaskContext.get().partitionId(), []
        out, draft, records, size = None, "", 0, 0

        def close() -> None:
            out.close()
            name = f"part-{part:05d}-{len(made):03d}-{uuid.uuid4().hex}.warc.gz"
            system.move(draft, f"{base}/{name}")
            made.append((name, records, size))

        for batch in batches:
            for page, uri, data, refers in zip(*(batch.column(i) for i in range(4)), strict=True):
                if out is None:
                    draft, records, size = f"{base}/.draft-{uuid.uuid4().hex}", 0, 0
                    out = system.open_output_stream(draft, compression=None)
                member = page_record(page.as_py(), uri.as_py(), data.as_py(), refers.as_py())
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([m[i] for m in made], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))],
            ["archive", "records", "bytes"],
        )

    return stage(rows.mapInArrow(work, "archive string, records bigint, bytes bigint"), "archives")


RECORD_SCHEMA = (
    "archive string, offset bigint, record_id string, record_type string, target_uri string, "
    "refers_to string, payload binary, payload_bytes bigint, payload_digest string, digests_hold boolean"
)


def read_archives(archives: DataFrame, folder: str, keep_payload: bool = True, step: int = STEP) -> DataFrame:
    """The records of the archives that ``archives`` (archive) lists in ``folder``, by RECORD_SCHEMA.

    One task reads an archive from start to end, as only its records tell where they end.
    ``payload_bytes`` and ``payload_digest`` are those of the full payload: measured for a response,
    stated by the HTTP headers and the record for a revisit, which carries none.
    ``digests_hold`` says whether what was measured is what the record states; a frame that doesn't
    fit stops the read with WarcError.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open_folder(folder)
        fields = pa.schema(
            [
                ("archive", pa.string()),
                ("offset", pa.int64()),
                ("record_id", pa.string()),
                ("record_type", pa.string()),
                ("target_uri", pa.string()),
                ("refers_to", pa.string()),
                ("payload", pa.binary()),
                ("payload_bytes", pa.int64()),
                ("payload_digest", pa.string()),
                ("digests_hold", pa.bool_()),
            ]
        )
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with system.open_input_stream(f"{base}/{name}", compression=None) as source:
                    for r in read_records(source, step, keep_payload):
                        h = r.headers
                        stated = h.get("warc-payload-digest", "").removeprefix("sha1:")
                        hold = h.get("warc-block-digest", "").removeprefix("sha1:") == r.block_digest
                        revisit = h.get("warc-type") == "revisit"
                        rows.append(
                            (
                                name,
                                r.offset,
                                h.get("warc-record-id"),
                                h.get("warc-type"),
                                h.get("warc-target-uri"),
                                h.get("warc-refers-to"),
                                r.payload if keep_payload else None,
                                _stated_length(r.http) if revisit else r.payload_bytes,
                                stated if revisit else r.payload_digest,
                                hold and (revisit or stated == r.payload_digest),
                            )
                        )
                        held += len(r.payload)
                        if len(rows) >= 5000 or held >= 16 << 20:
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)],
                                schema=fields,
                            )
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)],
                        schema=fields,
                    )

    # One archive a partition: a round robin over as many tasks as there are archives.
    names = archives.select("archive")
    spread = names.repartition(max(1, archives.count()))
    return spread.mapInArrow(work, RECORD_SCHEMA)


def resolved(records: DataFrame) -> DataFrame:
    """``records`` with ``refers_hold``: whether a revisit names a response with the same payload.

    True for responses. Revisits and responses meet on the response's id.
    """
    targets = records.filter("record_type = 'response'").select(
        F.col("record_id").alias("target"),
        F.col("payload_digest").alias("target_digest"),
        F.col("payload_bytes").alias("target_bytes"),
    )
    targets = targets.distinct()
    same = (
        (records.refers_to == targets.target)
        & (records.payload_digest == targets.target_digest)
        & (records.payload_bytes == targets.target_bytes)
    )
    return records.join(targets, same, "left").select(
        *[records[c] for c in records.columns],
        ((F.col("record_type") == "response") | F.col("target").isNotNull()).alias("refers_hold"),
    )


def round_trip(spark: SparkSession, pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` into new archives in the shared folder and read them back, without payloads."""
    folder = new_path(spark, "warc")
    archives = write_archives(pages, folder, least_bytes=least_bytes)
    return resolved(stage(read_archives(archives, folder, keep_payload=False), "records"))
