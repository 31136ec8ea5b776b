"""Legacy archives to WARC: ARC files of version 1 and 2 are parsed by their declared lengths and rewritten as WARC records.

Files lie in a folder that all executors share and are opened through pyarrow's file systems. A task that is run again writes
under a new name, and only names reported by the task that succeeded are read, so a lost executor leaves at most unused files.
Records are written as gzip members and streamed one by one in both directions; no file is held whole.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import lookup, shared_folder, table, write_cut

#: Payloads shorter than this never become revisits.
LEAST_PAYLOAD = 100
#: Uncompressed bytes after which a writer goes on in a new file.
FILE_BYTES = 64 << 20
#: Archive date of pages that have none.
NO_DATE = "19960101000000"

# Field names of the record lines of both versions, and WARC's profile of a revisit.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "arc-to-warc")


# ---------------------------------------------------------------- streams


class _In:
    """Lines and counted bytes of a possibly compressed file."""

    def __init__(self, path: str):
        system, name = fs.FileSystem.from_uri(path)
        self.path, self._file = path, system.open_input_stream(name, compression="gzip" if path.endswith(".gz") else None)
        self._held, self._at = b"", 0

    def _more(self) -> bool:
        got = self._file.read(1 << 18)
        self._held, self._at = self._held[self._at :] + got, 0
        return bool(got)

    def line(self) -> bytes | None:
        """Next line without its end; None after the last."""
        while (end := self._held.find(b"\n", self._at)) < 0:
            if not self._more():
                out, self._held = self._held, b""
                return out or None
        out, self._at = self._held[self._at : end], end + 1
        return out.removesuffix(b"\r")

    def take(self, size: int) -> bytes:
        parts, left = [], size
        while left:
            if self._at == len(self._held) and not self._more():
                raise ValueError(f"{self.path}: a record ends {left} bytes early")
            parts.append(self._held[self._at : self._at + left])
            self._at += len(parts[-1])
            left -= len(parts[-1])
        return b"".join(parts)

    def close(self) -> None:
        self._file.close()


class _Out:
    """Compressed file under a name that no other attempt uses."""

    def __init__(self, folder: str, kind: str):
        self.name = f"{kind}-{uuid.uuid4().hex}.{kind}.gz"
        self.path = f"{folder}/{self.name}"
        system, name = fs.FileSystem.from_uri(self.path)
        system.create_dir(name.rpartition("/")[0], recursive=True)
        self._file, self.size, self.records = system.open_output_stream(name, compression=None), 0, 0

    def add(self, record: bytes) -> None:
        packer = zlib.compressobj(1, wbits=31)
        self._file.write(packer.compress(record) + packer.flush())
        self.size += len(record)
        self.records += 1

    def close(self) -> str:
        self._file.close()
        return self.path


# ---------------------------------------------------------------- ARC


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    kind: str
    block: bytes
    number: int
    more: dict[str, str] = field(default_factory=dict)

    @property
    def http(self) -> tuple[bytes, bytes]:
        """(header block with its empty line, payload); the header is empty if the block isn't an HTTP response."""
        if self.block.startswith(b"HTTP/"):
            head, mark, body = self.block.partition(b"\r\n\r\n")
            if mark:
                return head + mark, body
        return b"", self.block


def _http_field(head: bytes, name: bytes) -> str | None:
    for line in head.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == name:
            return value.strip().decode("utf-8", "replace")
    return None


def read_arc(path: str) -> Iterator[ArcRecord]:
    """Records of one ARC file, the version block first (number 0). The version stands in the block of the first record; record
    lines have five fields in version 1 and ten in version 2, the declared length last. Bad lines and short files raise."""
    source, version, number = _In(path), 0, 0
    try:
        while (line := source.line()) is not None:
            if not line:
                continue
            fields = line.decode("utf-8", "replace").split(" ")
            names = ARC_FIELDS[version or 1].split(" ")
            if len(fields) != len(names) or not fields[-1].isdigit():
                raise ValueError(f"{path}: no version {version or 1} record line: {line[:80]!r}")
            block = source.take(int(fields[-1]))
            if not version:
                version = int(block.split(b" ", 1)[0] or 0)
                if version not in ARC_FIELDS:
                    raise ValueError(f"{path}: unknown version {version}")
            yield ArcRecord(fields[0], fields[1], fields[2], fields[3], block, number, dict(zip(names[4:-1], fields[4:-1], strict=True)))
            number += 1
    finally:
        source.close()


def arc_record(version: int, url: str, ip: str, date: str, kind: str, block: bytes, offset: int = 0, file: str = "-") -> bytes:
    middle = f" 200 {hashlib.md5(block).hexdigest()} - {offset} {file}" if version == 2 else ""
    return f"{url} {ip} {date} {kind}{middle} {len(block)}\n".encode() + block + b"\n"


def _arc_start(version: int, name: str) -> bytes:
    body = f"{version} 0 {'reserved ' if version == 2 else ''}pages\n{ARC_FIELDS[version]}\n\n".encode()
    return f"filedesc://{name} 0.0.0.0 {NO_DATE} text/plain {len(body)}\n".encode() + body


def write_arcs(pages: DataFrame, folder: str) -> DataFrame:
    """(path, records) of ARC files with the pages (page_id, url, html), by turns in version 1 and 2. Each page becomes an HTTP
    response whose X-Page-Id header keeps the id; blanks in URLs are quoted; a null URL becomes urn:page; a null html is empty."""

    def write(batches):
        files: dict[int, _Out] = {}
        done: list[tuple[str, int]] = []

        def close(version: int) -> None:
            out = files.pop(version)
            done.append((out.close(), out.records))

        turn = 0
        for batch in batches:
            for page, url, html in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                version, turn = 1 + turn % 2, turn + 1
                if version not in files:
                    files[version] = _Out(folder, "arc")
                    files[version].add(_arc_start(version, files[version].name))
                out, body = files[version], (html or "").encode()
                head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (f"X-Page-Id: {page}\r\n" if page is not None else "")
                block = f"{head}Content-Length: {len(body)}\r\n\r\n".encode() + body
                address = quote(url, safe="!#$%&'()*+,/:;=?@[]~-._") if url else "urn:page"
                out.add(arc_record(version, address, "0.0.0.0", NO_DATE, "text/html", block, out.size, out.name))
                if out.size >= FILE_BYTES:
                    close(version)
        for version in list(files):
            close(version)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["path", "records"])

    return write_cut(pages.select("page_id", "url", "html").mapInArrow(write, "path string, records long"))


# ---------------------------------------------------------------- conversion


def _digest(body: bytes) -> str:
    return hashlib.sha256(body).hexdigest()


def _over_files(paths: DataFrame, read, schema: str) -> DataFrame:
    """read(path) -> rows, over the files of column path, which are dealt out evenly."""
    kinds = pa.schema([(n, {"string": pa.string(), "long": pa.int64()}[k]) for n, k in (x.split() for x in schema.split(", "))])

    def rows(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held = []
                for row in read(path):
                    held.append(row)
                    if len(held) == 5_000:
                        yield pa.RecordBatch.from_pylist(held, kinds)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, kinds)

    files = paths.count()
    return paths.select("path").repartition(max(1, min(files, 10_000))).mapInArrow(rows, schema)


def _arc_rows(path: str):
    for record in read_arc(path):
        if record.number:
            head, body = record.http
            page = _http_field(head, b"x-page-id")
            yield {"path": path, "number": record.number, "page_id": int(page) if page else None, "size": len(body), "digest": _digest(body)}


def _uuid(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, ' '.join(map(str, parts)))}>"


def warc_record(record: ArcRecord, refers: tuple[int | None] | None, first: bool) -> bytes:
    """WARC record for an ARC record: identifier from digest and page (and place, unless others may refer to it), date in ISO form,
    type from the block, digests of payload and block. refers: page that holds the payload, if this is a revisit."""
    day = record.date.ljust(14, "0")
    when = f"{day[:4]}-{day[4:6]}-{day[6:8]}T{day[8:10]}:{day[10:12]}:{day[12:14]}Z"
    if record.number == 0:
        kind, block, more = "warcinfo", record.block, {"WARC-Filename": record.url.removeprefix("filedesc://"), "Content-Type": "application/warc-fields"}
        more["WARC-Record-ID"] = _uuid("warcinfo", record.url)
    else:
        head, body = record.http
        digest, page = _digest(body), _http_field(head, b"x-page-id")
        kind = "revisit" if refers else "response" if head else "resource"
        block = head if refers else record.block
        more = {
            "WARC-Record-ID": _uuid("response", digest, page) if first else _uuid(kind, digest, page, record.number),
            "WARC-Target-URI": record.url, "WARC-IP-Address": record.ip, "WARC-Payload-Digest": f"sha256:{digest}",
            "Content-Type": "application/http; msgtype=response" if head else record.kind,
        }
        if refers:
            more |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": _uuid("response", digest, refers[0])}
            if refers[0] is not None:
                more["X-Refers-To-Page"] = str(refers[0])
    more = {"WARC-Type": kind, "WARC-Date": when, **more, "WARC-Block-Digest": f"sha256:{_digest(block)}", "Content-Length": str(len(block))}
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in more.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def convert_arcs(arcs: DataFrame, folder: str, least_payload: int = LEAST_PAYLOAD) -> DataFrame:
    """(path, records) of WARC files, one for each ARC file of column path.

    Payloads are compared by SHA-256. Of equal payloads of at least least_payload bytes the record with the smallest page id (null
    last; then by file and place) stays whole, the others become revisits of it. The files are read twice: once for the digests,
    once for rewriting; between them go only numbers and digests, and a digest that many records share is counted before the
    shuffle."""
    records = write_cut(_over_files(arcs, _arc_rows, "path string, number long, page_id long, size long, digest string"))
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "path", "number")
    firsts = records.where(F.col("size") >= least_payload).groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
    judged = lookup(records, write_cut(firsts.where("n > 1").drop("n")), ["digest"])
    same = (F.col("first.path") == F.col("path")) & (F.col("first.number") == F.col("number"))
    plan = judged.select("path", "number", (F.col("first").isNotNull() & ~same).alias("again"), F.coalesce(same, F.lit(False)).alias("kept"), F.col("first.page_id").alias("refers"))

    def rewrite(rows: pa.Table) -> pa.Table:
        path = rows.column("path")[0].as_py()
        plans = {n: ((r,) if a else None, k) for n, a, k, r in zip(*(rows.column(c).to_pylist() for c in ("number", "again", "kept", "refers")), strict=True)}
        out = _Out(folder, "warc")
        for record in read_arc(path):
            refers, first = plans.get(record.number, (None, False))
            out.add(warc_record(record, refers, first))
        return pa.table({"path": pa.array([out.close()], pa.string()), "records": pa.array([out.records], pa.int64())})

    # as many tasks as files: the plan is small, and would be merged into a few tasks by its size
    dealt = plan.repartition(max(1, arcs.count()), "path")
    return write_cut(dealt.groupBy("path").applyInArrow(rewrite, "path string, records long"))


def read_warc(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record of one WARC file."""
    source = _In(path)
    try:
        while (line := source.line()) is not None:
            if not line:
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"{path}: no WARC record: {line[:80]!r}")
            fields = {}
            while line := source.line():
                key, _, value = line.decode().partition(":")
                fields[key.strip().lower()] = value.strip()
            yield fields, source.take(int(fields["content-length"]))
    finally:
        source.close()


def _warc_rows(path: str):
    for fields, block in read_warc(path):
        kind = fields["warc-type"]
        if kind == "warcinfo":
            continue
        head, _, body = block.partition(b"\r\n\r\n")
        digest = fields["warc-payload-digest"].removeprefix("sha256:")
        if kind != "revisit" and _digest(body if kind == "response" else block) != digest:
            raise ValueError(f"{path}: payload and digest differ in {fields['warc-record-id']}")
        page, refers = _http_field(head, b"x-page-id"), fields.get("x-refers-to-page")
        yield {
            "page_id": int(page) if page else None, "payload_bytes": int(_http_field(head, b"content-length") or len(block)), "payload_digest": digest,
            "record_type": kind, "refers_to": int(refers) if refers else None, "record_id": fields["warc-record-id"],
            "refers_to_id": fields.get("warc-refers-to"), "target_uri": fields["warc-target-uri"],
        }


def read_warcs(warcs: DataFrame) -> DataFrame:
    """One row for each record but the warcinfo ones; whole payloads are checked against their digests."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_id string, target_uri string"
    return _over_files(warcs, _warc_rows, schema)


def through_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Pages written to ARC files, converted to WARC and read back. Null and empty html have an empty payload; repeated rows are
    records of their own; null ids stay null; an empty table writes no records; other columns are not read."""
    return read_warcs(convert_arcs(write_arcs(pages, f"{folder}/arc"), f"{folder}/warc"))


def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    target = f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}"
    return through_archives(table(spark, folder, "pages"), target).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""

QUERIES = {"op7_warc": op7_warc}
ORACLES = {"op7_warc": OP7_SQL}
