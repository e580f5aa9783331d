"""Conversion of legacy ARC archives to WARC.

ARC files hold records of one header line and a body of the declared length; the line's fields depend on the version that
the file's first record states. Both formats are read and written one gzip member for each record.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import materialize, new_path, slices
from tidewater.llm.files import new_file, old_file

# Fixed values of the ARC format: the fields of a header line after the URL, by version.
ARC_FIELDS = {
    1: ("ip", "date", "mime", "length"),
    2: ("ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length"),
}
ARC_TITLES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_CHUNK = 1 << 20


def gzip_member(data: bytes, level: int = 1) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def gzip_members(source: pa.NativeFile) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each gzip member; one is held at a time."""
    rest, at, read = b"", 0, 0
    while True:
        unpacker, out = zlib.decompressobj(31), []
        start = at
        while not unpacker.eof:
            if not rest:
                rest = source.read(_CHUNK)
                if not rest:
                    if out:
                        raise ValueError(f"archive ends inside the record at {start}")
                    return
                read += len(rest)
            out.append(unpacker.decompress(rest))
            rest = unpacker.unused_data if unpacker.eof else b""
        at = read - len(rest)
        yield start, b"".join(out)


@dataclass(frozen=True)
class ArcRecord:
    url: str
    ip: str
    date: str
    mime: str
    body: bytes

    @property
    def is_http(self) -> bool:
        return self.url.startswith(("http://", "https://")) and self.body.startswith(b"HTTP/")

    def split(self) -> tuple[bytes, bytes]:
        """HTTP header block (with its blank line) and payload; a body that is no HTTP message is payload alone."""
        if not self.is_http:
            return b"", self.body
        end = re.search(rb"\r?\n\r?\n", self.body)
        return (self.body, b"") if end is None else (self.body[: end.end()], self.body[end.end() :])

    def page_id(self) -> int | None:
        found = re.search(rb"(?im)^X-Page-Id: (-?\d+)\r?$", self.split()[0])
        return int(found[1]) if found else None


def parse_arc_record(data: bytes, version: int) -> ArcRecord:
    """The URL may hold spaces in old files, so fields are taken from the right. The body has the declared length, or what there is of it."""
    line, _, rest = data.partition(b"\n")
    names = ARC_FIELDS[version]
    values = line.rstrip(b"\r").decode("utf-8", "replace").rsplit(" ", len(names))
    if len(values) != len(names) + 1 or not values[-1].isdigit():
        raise ValueError(f"not an ARC version {version} header line: {line[:200]!r}")
    fields = dict(zip(names, values[1:], strict=True))
    return ArcRecord(values[0], fields["ip"], fields["date"], fields["mime"], rest[: int(fields["length"])])


def read_arc(source: pa.NativeFile) -> Iterator[tuple[int, ArcRecord]]:
    """Offset and record; the first record (``filedesc://``) states the version by its body's first figure."""
    version = 1
    for at, data in gzip_members(source):
        if at == 0:
            stated = re.match(rb"filedesc://[^\n]*\n(\d)", data)
            version = int(stated[1]) if stated and int(stated[1]) in ARC_FIELDS else 1
        yield at, parse_arc_record(data, version)


def arc_header(version: int, url: str, date: str, mime: str, length: int, ip: str = "0.0.0.0", filename: str = "-") -> bytes:
    safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) or "-"
    extra = ("200", "-", "-", "0", filename) if version == 2 else ()
    return " ".join((safe, ip, date, mime, *extra, str(length))).encode("utf-8", "surrogatepass") + b"\n"


def write_arc(pages: DataFrame, folder: str, version: int = 1, date: str = "20240101000000") -> DataFrame:
    """Write ``page_id``, ``url``, ``html`` as ARC files, one for each task -> manifest ``file``. Null html is an empty payload, a null URL is ``-``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        with new_file(folder, ".arc.gz") as (out, name):
            about = f"{version} 0 tidewater\n{ARC_TITLES[version]}\n\n".encode()
            out.write(gzip_member(arc_header(version, f"filedesc://{name}", date, "text/plain", len(about), filename=name) + about + b"\n"))
            for batch in batches:
                for part in slices(batch, "html"):
                    for page_id, url, html in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                        payload = html or b""
                        mark = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
                        body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{mark}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
                        url = url if (url or "").startswith(("http://", "https://")) else f"http://-/{url or ''}"
                        out.write(gzip_member(arc_header(version, url, date, "text/html", len(body), filename=name) + body + b"\n"))
                        n += 1
        if n:
            yield pa.RecordBatch.from_pydict({"file": [name], "n": [n]})

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.col("html").cast("string"), "UTF-8").alias("html"))
    return materialize(rows.mapInArrow(run, "file string, n long"), "arc-manifest")


def _tasks(manifest: DataFrame) -> int:
    """A task for each file, up to a bound."""
    return max(1, min(manifest.count(), 10_000))


def _spread(manifest: DataFrame) -> DataFrame:
    return manifest.repartition(_tasks(manifest), "file")


RECORDS = T.StructType([T.StructField(n, t) for n, t in (("file", T.StringType()), ("at", T.LongType()), ("page_id", T.LongType()), ("url", T.StringType()), ("date", T.StringType()), ("payload_bytes", T.LongType()), ("digest", T.BinaryType()))])


def arc_records(manifest: DataFrame, folder: str) -> DataFrame:
    """A row for each record of the ARC files, without the payloads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("file").to_pylist():
                rows = []
                with old_file(folder, file) as source:
                    for at, r in read_arc(source):
                        if r.url.startswith("filedesc://"):
                            continue
                        payload = r.split()[1]
                        rows.append((file, at, r.page_id(), r.url, r.date, len(payload), hashlib.sha256(payload).digest()))
                        if len(rows) == 10_000:
                            yield _batch(rows)
                            rows = []
                yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(RECORDS)
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], RECORDS.names)

    return _spread(manifest).mapInArrow(run, RECORDS)


def record_id(file: str, at: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file}#{at}')}>"


def warc_date(date: str) -> str:
    """ARC dates have 14 digits, older ones fewer; what lacks is the start of the span, and no date at all is the epoch."""
    if not re.fullmatch(r"\d{4,14}", date):
        return "1970-01-01T00:00:00Z"
    d = date + "00000101000000"[len(date) :] if len(date) < 14 else date
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in (*fields, ("Content-Length", str(len(block)))))
    return b"WARC/1.1\r\n" + head.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def convert_record(r: ArcRecord, file: str, at: int, original: dict | None) -> bytes:
    """The WARC record that says the same. ``original`` is the record whose payload this one repeats, or None."""
    header, payload = r.split()
    digest = "sha256:" + hashlib.sha256(payload).hexdigest()
    fields = [("WARC-Record-ID", record_id(file, at)), ("WARC-Date", warc_date(r.date)), ("WARC-Target-URI", r.url)]
    if r.ip not in ("", "-", "0.0.0.0"):
        fields.append(("WARC-IP-Address", r.ip))
    if not r.is_http:
        return warc_record([("WARC-Type", "resource"), *fields, ("Content-Type", r.mime), ("WARC-Payload-Digest", digest)], r.body)
    fields += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest)]
    if original is None:
        return warc_record([("WARC-Type", "response"), *fields, ("WARC-Block-Digest", "sha256:" + hashlib.sha256(r.body).hexdigest())], r.body)
    refers = [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(original["file"], original["at"])), ("WARC-Refers-To-Target-URI", original["url"]), ("WARC-Refers-To-Date", warc_date(original["date"])), ("WARC-X-Refers-To-Page", str(original["page_id"])), ("WARC-X-Payload-Length", str(len(payload)))]
    return warc_record([("WARC-Type", "revisit"), *fields, *refers, ("WARC-Block-Digest", "sha256:" + hashlib.sha256(header).hexdigest())], header)


def convert(manifest: DataFrame, arc_folder: str, warc_folder: str, least_bytes: int = 100) -> DataFrame:
    """ARC files -> WARC files, one for each; returns their manifest ``file``.

    Of HTTP responses with equal payloads of at least ``least_bytes`` bytes the one with the smallest page id (then file and place)
    stays a response, and the others become revisits of it. Only digests and places are shuffled.
    """
    records = materialize(arc_records(manifest, arc_folder), "arc-records")
    place = F.struct(F.coalesce("page_id", F.lit((1 << 63) - 1)).alias("turn"), "file", "at", "url", "date", "page_id")
    first = records.filter(F.col("payload_bytes") >= least_bytes).groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    shared = materialize(first.filter("n > 1").select("digest", "first"), "arc-shared")
    # Most records stay as they are; the join only names the revisits. A hot digest is split by the adaptive skew join.
    revisits = records.filter(F.col("payload_bytes") >= least_bytes).select("file", "at", "digest").join(shared, "digest").filter((F.col("file") != F.col("first.file")) | (F.col("at") != F.col("first.at")))
    todo = manifest.select("file", F.lit(-1).cast("long").alias("at"), F.lit(None).cast(shared.schema["first"].dataType).alias("first")).unionByName(revisits.select("file", "at", "first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come file by file, and by place inside a file; place -1 opens the file.
        rows = (row for batch in batches for row in batch.to_pylist())
        for file, group in itertools.groupby(rows, key=lambda row: row["file"]):
            with old_file(arc_folder, file) as source, new_file(warc_folder, ".warc.gz") as (out, name):
                n = 0
                todo = ((row["at"], row["first"]) for row in group if row["at"] >= 0)
                place, original = next(todo, (-1, None))
                for at, r in read_arc(source):
                    repeats = at == place
                    out.write(gzip_member(_converted(r, file, at, name, original if repeats else None)))
                    if repeats:
                        place, original = next(todo, (-1, None))
                    n += 1
            yield pa.RecordBatch.from_pydict({"file": [name], "n": [n]})

    spread = todo.repartition(_tasks(manifest), "file").sortWithinPartitions("file", "at")
    return materialize(spread.mapInArrow(run, "file string, n long"), "warc-manifest")


def _converted(r: ArcRecord, file: str, at: int, name: str, original: dict | None) -> bytes:
    if not r.url.startswith("filedesc://"):
        return convert_record(r, file, at, original)
    about = f"software: tidewater\r\nformat: WARC File Format 1.1\r\nconverted-from: {file}\r\n".encode()
    return warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(file, at)), ("WARC-Date", warc_date(r.date)), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], about)


def parse_warc_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Named fields (lower-case names) and block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:100]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def read_warc(manifest: DataFrame, folder: str) -> DataFrame:
    """A row for each response, resource and revisit: ``page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, url, date``.

    Digests of payloads that are there are computed anew and must match the stated ones.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "url", "date"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())

    def row(data: bytes) -> tuple | None:
        fields, block = parse_warc_record(data)
        kind = fields["warc-type"]
        if kind not in ("response", "revisit", "resource"):
            return None
        message = ArcRecord("http://-", "", "", "", block)
        payload = block if kind == "resource" else message.split()[1]
        stated = fields["warc-payload-digest"].removeprefix("sha256:")
        size, refers_to = len(payload), None
        if kind == "revisit":
            size, about = int(fields["warc-x-payload-length"]), fields["warc-x-refers-to-page"]
            refers_to = None if about == "None" else int(about)
        elif hashlib.sha256(payload).hexdigest() != stated:
            raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
        return message.page_id(), size, stated, kind, refers_to, fields["warc-record-id"], fields["warc-target-uri"], fields["warc-date"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("file").to_pylist():
                rows = []
                with old_file(folder, file) as source:
                    for _, data in gzip_members(source):
                        found = row(data)
                        if found:
                            rows.append(found)
                columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return _spread(manifest).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string, date string")


def pages_to_warc(spark: SparkSession, pages: DataFrame, version: int = 1, least_bytes: int = 100) -> DataFrame:
    """Write ``pages`` as ARC, convert to WARC, and read the WARC files back; one row per row of ``pages``.

    Null html is an empty payload; ids may be null (no id comes back then, and such a row is the response only where all of its group
    lack one) or repeat (the first in file order is the response). Extra columns are not written.
    """
    arcs, warcs = new_path(spark, "arc"), new_path(spark, "warc")
    return read_warc(convert(write_arc(pages, arcs, version), arcs, warcs, least_bytes), warcs)
