"""Legacy archives (ARC 1 and 2) converted to WARC 1.1.

An ARC record is one header line, whose fields depend on the version named in the
file's first record, and as many bytes as the line's last field declares.  The
converter indexes the records, decides over the whole corpus which of those with
equal payloads stays a response, and writes each record as WARC with a
synthesised identifier, timestamp, type and payload digest.

Archives are gzip, a member for each record, so a record is read from its offset
alone.  Payloads are never shuffled: only (file, offset, digest) rows are.  Files
are written under a temporary name and renamed, so a repeated task leaves the same
file.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roamlens.llm.common import as_uri, materialise, new_folder, utf8

#: Records with payloads of so many bytes are written once.
MIN_REVISIT_BYTES = 1000
#: Uncompressed bytes of an ARC file before the next begins.
ARC_BYTES = 64 << 20
#: Compressed ARC bytes that become one WARC file.
WARC_SHARE = 8 << 20
CRAWL_DATE = "20240101000000"
#: The field lists of the two ARC versions.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Fixed value: the profile of a revisit with the same payload.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# --- records ---------------------------------------------------------------

def member(data: bytes) -> bytes:
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def members(f, block: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member of an open file."""
    rest, at = f.read(block), 0
    while rest:
        d, parts, start = zlib.decompressobj(31), [], at
        while True:
            parts.append(d.decompress(rest))
            if d.eof:
                at, rest = at + len(rest) - len(d.unused_data), d.unused_data
                break
            at, rest = at + len(rest), f.read(block)
            if not rest:
                raise ValueError("the archive ends inside a record")
        yield start, b"".join(parts)
        rest = rest or f.read(block)


def arc_line(version: int, url: str, kind: str, body: bytes, status: str = "200", date: str = CRAWL_DATE) -> bytes:
    middle = [] if version == 1 else [status, hashlib.sha1(body).hexdigest(), "-", "0", "-"]
    return (" ".join([url, "0.0.0.0", date, kind, *middle, str(len(body))]) + "\n").encode()


def arc_file_header(version: int, name: str) -> bytes:
    body = f"{version} 0 converter\n{ARC_FIELDS[version]}\n\n".encode()
    return arc_line(1, f"filedesc://{name}", "text/plain", body) + body


def parse_arc(data: bytes, version: int | None) -> tuple[dict, bytes]:
    """The fields of one ARC record and its body of declared length.  The first
    record of a file names the version (``version`` None: this is it)."""
    line, _, rest = data.partition(b"\n")
    values = line.decode("utf-8", "replace").rstrip("\r").split(" ")
    names = ARC_FIELDS[version or 1].split(" ")
    if len(values) < len(names):
        raise ValueError(f"an ARC {version or 1} header has {len(names)} fields: {line[:200]!r}")
    # Old crawlers wrote unescaped spaces into URLs: the last fields are counted from the end.
    extra = len(values) - len(names)
    values = [" ".join(values[:extra + 1]), *values[extra + 1:]]
    fields = dict(zip(names, values))
    n = int(fields["Archive-length"])
    if len(rest) < n:
        raise ValueError("an ARC record is shorter than it declares")
    return fields, rest[:n]


def arc_version(body: bytes) -> int:
    return int(body.split(b" ", 1)[0])


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """HTTP header (with its blank line) and payload."""
    head, gap, payload = body.partition(b"\r\n\r\n")
    return (head + gap, payload) if gap and head.startswith(b"HTTP/") else (b"", body)


def http_field(head: bytes, name: bytes) -> str | None:
    for line in head.split(b"\r\n"):
        if line.lower().startswith(name + b":"):
            return line.split(b":", 1)[1].strip().decode()
    return None


def record_id(page: str | None, digest: str) -> str:
    return f"<urn:page-record:{'' if page is None else page}:{digest[:16]}>"


def page_of(identifier: str) -> int | None:
    page = identifier.rsplit(":", 2)[1]
    return int(page) if page else None


def warc_date(date: str) -> str:
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def to_warc(fields: dict, body: bytes, refers_to: str | None) -> bytes:
    """One ARC record as WARC: a file description becomes warcinfo, HTTP a response
    (or a revisit of ``refers_to``), DNS a response, anything else a resource."""
    url, date = fields["URL"], warc_date(fields["Archive-date"])
    if url.startswith("filedesc://"):
        about = b"software: arc converter\r\nformat: WARC File Format 1.1\r\n"
        return warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, url)}>"),
                            ("WARC-Date", date), ("Content-Type", "application/warc-fields")], about)
    head, payload = split_http(body)
    sha = hashlib.sha1(payload)
    digest = "sha1:" + base64.b32encode(sha.digest()).decode()
    kind = "response" if head or url.startswith("dns:") else "resource"
    mime = "application/http; msgtype=response" if head else fields["Content-type"]
    out = [("WARC-Type", "revisit" if refers_to else kind), ("WARC-Target-URI", url), ("WARC-Date", date),
           ("WARC-Record-ID", record_id(http_field(head, b"x-page-id"), sha.hexdigest())),
           ("WARC-IP-Address", fields["IP-address"]), ("WARC-Payload-Digest", digest), ("Content-Type", mime)]
    if not refers_to:
        return warc_record(out, body)
    out += [("WARC-Refers-To", refers_to), ("WARC-Profile", SAME_PAYLOAD), ("X-Payload-Length", str(len(payload)))]
    return warc_record(out, head)


def parse_warc(data: bytes) -> tuple[dict, bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    return fields, rest[:int(fields["Content-Length"])]


class _Files:
    """Output files that appear under their name only when whole."""

    def __init__(self, uri: str):
        from pyarrow import fs

        self.store, self.root = fs.FileSystem.from_uri(uri)
        self.store.create_dir(self.root, recursive=True)
        self.out = None

    def open(self, name: str) -> None:
        self.close()
        self.path, self.temporary, self.size = f"{self.root}/{name}", f"{self.root}/.{uuid.uuid4().hex}", 0
        self.out = self.store.open_output_stream(self.temporary)

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> str | None:
        if self.out is None:
            return None
        self.out.close()
        self.out = None
        self.store.move(self.temporary, self.path)
        return self.path


# --- the corpus ------------------------------------------------------------

def write_arc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
              html_col: str = "html", versions: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Pages as ARC files (the versions taken in turn by the tasks); the files' paths."""
    import pyarrow as pa

    uri = as_uri(folder)

    def write(it):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        version, files, n, raw = versions[part % len(versions)], None, 0, 0
        for b in it:
            for page, url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), utf8(b.column(2))):
                if files is None or raw > ARC_BYTES:
                    if files is not None:
                        yield pa.RecordBatch.from_pylist([{"file": files.close()}])
                    files = files or _Files(uri)
                    name = f"part-{part:06d}-{n:04d}.arc.gz"
                    files.open(name)
                    files.write(member(arc_file_header(version, name)))
                    n, raw = n + 1, 0
                mark = "" if page is None else f"X-Page-Id: {page}\r\n"
                body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{mark}\r\n".encode() + html
                url = quote(url or "about:blank", safe="%:/?#[]@!$&'()*+,;=~-._")
                files.write(member(arc_line(version, url, "text/html", body) + body + b"\n"))
                raw += len(body)
        if files is not None:
            yield pa.RecordBatch.from_pylist([{"file": files.close()}])

    rows = pages.select(pages[id_col].cast("long"), url_col, html_col)
    return materialise(rows.mapInArrow(write, "file string"), "arc-manifest")


def index_arc(files: DataFrame, folder: str) -> DataFrame:
    """Every record of the ARC files: file, version, place (offset), page_id, sha1, n_bytes."""
    import pyarrow as pa

    uri = as_uri(folder)
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def read(it):
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(uri)
        for b in it:
            for path in b.column(0).to_pylist():
                rows, version = [], None
                with store.open_input_file(path) as f:
                    for place, data in members(f):
                        fields, body = parse_arc(data, version)
                        if version is None:
                            version = arc_version(body)
                            continue
                        head, payload = split_http(body)
                        page = http_field(head, b"x-page-id")
                        rows.append({"file": path, "version": version, "place": place,
                                     "page_id": None if page is None else int(page),
                                     "sha1": hashlib.sha1(payload).hexdigest(), "n_bytes": len(payload)})
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("file", pa.string()), ("version", pa.int32()), ("place", pa.int64()), ("page_id", pa.int64()),
                        ("sha1", pa.string()), ("n_bytes", pa.int64())])
    out = files.select("file").repartition(parts, "file").mapInArrow(
        read, "file string, version int, place long, page_id long, sha1 string, n_bytes long")
    return materialise(out, "arc-index")


def revisits(index: DataFrame, least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """The index with ``refers_to``: the largest page_id among equal payloads of
    ``least`` bytes or more, null for that page itself and for all others.  A digest
    that a third of the pages share is counted before the shuffle, and the join
    back on it is one that AQE splits."""
    same = index.filter(F.col("n_bytes") >= least).groupBy("sha1", "n_bytes").agg(
        F.max("page_id").alias("kept_page"), F.count(F.lit(1)).alias("copies"))
    same = same.filter("copies > 1").drop("copies")
    out = index.join(same, ["sha1", "n_bytes"], "left")
    other = F.col("kept_page").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept_page"))
    return out.withColumn("refers_to", F.when(other, F.col("kept_page"))).drop("kept_page")


def convert(index: DataFrame, arc_folder: str, folder: str) -> DataFrame:
    """WARC files of the indexed ARC records; the files' paths."""
    import pyarrow as pa

    uri, source = as_uri(folder), as_uri(arc_folder)
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def write(it):
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(source)
        files, now, f = _Files(uri), None, None
        for b in it:
            for path, share, place, version, sha1, target in zip(*(b.column(i).to_pylist() for i in range(6))):
                if (path, share) != now:
                    if now is not None:
                        f.close()
                        yield pa.RecordBatch.from_pylist([{"file": files.close()}])
                    now, f = (path, share), store.open_input_file(path)
                    name = path.rsplit("/", 1)[1].removesuffix(".arc.gz")
                    files.open(f"{name}-{share:05d}.warc.gz")
                    files.write(member(to_warc(*parse_arc(next(members(f))[1], None), None)))
                f.seek(place)
                fields, body = parse_arc(next(members(f, 1 << 15))[1], version)
                same = None if target is None else record_id(str(target), sha1)
                files.write(member(to_warc(fields, body, same)))
        if now is not None:
            f.close()
            yield pa.RecordBatch.from_pylist([{"file": files.close()}])

    rows = index.select("file", F.floor(F.col("place") / WARC_SHARE).cast("long").alias("share"), "place", "version", "sha1", "refers_to")
    rows = rows.repartition(parts, "file", "share").sortWithinPartitions("file", "share", "place")
    return materialise(rows.mapInArrow(write, "file string"), "warc-manifest")


def read_warc(files: DataFrame, folder: str) -> DataFrame:
    """Per record of the WARC files (without warcinfo): page_id, payload_bytes,
    payload_digest, record_type, refers_to.  A stored payload must have its digest."""
    import pyarrow as pa

    uri = as_uri(folder)
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64())])

    def read(it):
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(uri)
        for b in it:
            for path in b.column(0).to_pylist():
                rows = []
                with store.open_input_file(path) as f:
                    for _, data in members(f):
                        fields, block = parse_warc(data)
                        kind = fields["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
                        if kind == "revisit":
                            size = int(fields["X-Payload-Length"])
                        else:
                            payload = split_http(block)[1]
                            size = len(payload)
                            if hashlib.sha1(payload).digest() != digest:
                                raise ValueError(f"a payload in {path} differs from its digest")
                        refers = fields.get("WARC-Refers-To")
                        rows.append({"page_id": page_of(fields["WARC-Record-ID"]), "payload_bytes": size,
                                     "payload_digest": digest.hex(), "record_type": kind,
                                     "refers_to": page_of(refers) if refers else None})
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("file").repartition(parts, "file").mapInArrow(
        read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_pages(pages: DataFrame, **names) -> DataFrame:
    """Pages written as ARC, converted to WARC and read back: one row per row.

    Null html is an empty payload, a null url ``about:blank``, a null id stays null
    (such a page can only revisit); rows that share the largest page_id of their
    payload all are responses; an empty table writes no files; other columns are
    not read."""
    spark = pages.sparkSession
    arc, warc = new_folder(spark, "arc"), new_folder(spark, "warc")
    index = index_arc(write_arc(pages, arc, **names), arc)
    return read_warc(convert(revisits(index), arc, warc), warc)
