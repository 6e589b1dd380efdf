"""Operator 4: WARC archives, their normalisation to one gzip member a record, and reading by offset index.

Writers stream records into whole-file gzip streams. The normaliser inflates each such stream once, from front to
back, rewrites every record as a gzip member of its own, and writes a sidecar index of offsets and lengths; after
that any record can be read alone. Archives are files in the shared folder, reached through its own file system.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Payloads of fewer bytes are always written whole.
LEAST_BYTES = 1000
#: A writer begins another archive after so many bytes of records.
ARCHIVE_BYTES = 16 << 20
BLOCK = 1 << 20
FIRST_LINE = b"WARC/1.1"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id, url, payload: bytes, sha1: str, refers_to) -> bytes:
    """One response record, or a revisit record without the payload where refers_to is given."""
    http = HTTP + f"Content-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{page_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", "".join((url or "about:blank").split())),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        head[3:3] = [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in head)
    return FIRST_LINE + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def head_of(data: bytes) -> tuple[dict[str, str], int] | None:
    """(fields, offset of the block) of the record at the front of data, or None if its head is not complete."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = data[:end].decode().split("\r\n")
    if lines[0] != FIRST_LINE.decode():
        raise ValueError(f"no WARC record here: {lines[0][:40]!r}")
    return dict(line.split(": ", 1) for line in lines[1:]), end + 4


def inflate(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """Plain bytes of a gzip stream of one or more members."""
    engine = zlib.decompressobj(31)
    for block in blocks:
        while block:
            yield engine.decompress(block)
            block = engine.unused_data
            if engine.eof and block:
                engine = zlib.decompressobj(31)
    yield engine.flush()


def records(plain: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, whole record) of each record; only the record at hand is kept."""
    held = bytearray()
    need, fields, searched = None, None, 0
    for more in plain:
        held += more
        while held:
            if need is None:
                end = held.find(b"\r\n\r\n", searched)
                if end < 0:
                    searched = max(0, len(held) - 3)
                    break
                fields, block = head_of(bytes(held[: end + 4]))
                searched = 0
                need = block + int(fields["Content-Length"]) + 4
            if len(held) < need:
                break
            yield fields, bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise ValueError("the archive ends within a record")


def _blocks(stream) -> Iterator[bytes]:
    while block := stream.read(BLOCK):
        yield block


def place(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


class _Archive:
    """A file that gets its name only when it is complete, so that a task that is run again replaces it whole."""

    def __init__(self, folder: str, name: str):
        self.fs, self.root = place(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.path, self.name = f"{self.root}/{name}", name
        self.part = f"{self.root}/.{name}.{uuid.uuid4().hex}"
        self.out, self.size = self.fs.open_output_stream(self.part, compression=None), 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()
        if self.fs.get_file_info(self.path).type != pafs.FileType.NotFound:  # of an earlier attempt; a store may refuse to replace
            self.fs.delete_file(self.path)
        self.fs.move(self.part, self.path)


def _write(folder: str):
    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, archive, made, n, size = TaskContext.get().partitionId(), None, 0, 0, 0

        def finish():
            archive.write(engine.flush())
            archive.close()
            return pa.RecordBatch.from_arrays([pa.array([archive.name]), pa.array([n], pa.int64())], ["archive", "records"])

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "sha1", "refers_to")]
            for page_id, url, html, sha1, refers_to in zip(*columns, strict=True):
                if archive is None:
                    archive, n, size, made = _Archive(folder, f"{at:06d}-{made:05d}.warc.gz"), 0, 0, made + 1
                    engine = zlib.compressobj(1, zlib.DEFLATED, 31)
                data = record(page_id.as_py(), url.as_py(), html.as_buffer().to_pybytes() if html.is_valid else b"", sha1.as_py(), refers_to.as_py())
                archive.write(engine.compress(data))
                n, size = n + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    yield finish()
                    archive = None
        if archive is not None:
            yield finish()

    return run


def _page(urn: str) -> int | None:
    text = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if text == "None" else int(text)


def _normalise(folder: str, remove: bool):
    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = place(folder)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                source, archive = f"{root}/{name}", _Archive(folder, f"records-{name}")
                index = _Archive(folder, f"records-{name}.idx")
                rows = []
                if fs.get_file_info(source).type == pafs.FileType.NotFound:  # an earlier attempt of this task finished it
                    done = fs.open_input_stream(f"{archive.path}.idx", compression=None).read().decode()
                    for line in done.splitlines():
                        page, kind, offset, length = line.split()
                        rows.append((archive.name, None if page == "-" else int(page), int(offset), int(length)))
                    for unused in (archive, index):
                        unused.out.close()
                        fs.delete_file(unused.part)
                else:
                    with fs.open_input_stream(source, compression=None) as stream:
                        for fields, whole in records(inflate(_blocks(stream))):
                            engine = zlib.compressobj(4, zlib.DEFLATED, 31)
                            member = engine.compress(whole) + engine.flush()
                            page = _page(fields["WARC-Record-ID"])
                            index.write(f"{'-' if page is None else page} {fields['WARC-Type']} {archive.size} {len(member)}\n".encode())
                            rows.append((archive.name, page, archive.size, len(member)))
                            archive.write(member)
                    archive.close()
                    index.close()
                    if remove:
                        fs.delete_file(source)
                names, pages, offsets, lengths = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names), pa.array(pages, pa.int64()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
                    ["archive", "page_id", "offset", "length"],
                )

    return run


def _read(folder: str):
    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = place(folder)
        name = stream = None
        for batch in batches:
            out = []
            for archive, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True):
                if archive != name:
                    if stream is not None:
                        stream.close()
                    name, stream = archive, fs.open_input_file(f"{root}/{archive}")
                whole = zlib.decompress(stream.read_at(length, offset), 31)
                fields, block = head_of(whole)
                http = whole.index(b"\r\n\r\n", block)
                size = int(whole[block:http].rpartition(b"Content-Length: ")[2])
                digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                refers, payload = fields.get("WARC-Refers-To"), None
                if refers is None:
                    payload = whole[http + 4 : -4]
                    if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{archive} at {offset}: the payload does not match its record")
                out.append((_page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], size, digest, fields["WARC-Type"], None if refers is None else _page(refers), payload))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], READ_NAMES)

    return run


READ_NAMES = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]


def roles(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """pages with sha1 and refers_to: of equal payloads of at least least_bytes bytes, all but those with the largest page_id refer to it.

    Only digests are grouped, with partial sums, so a payload that a third of the pages share is no hot task; the
    groups of two or more are broadcast behind a check of their size.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha1", F.sha1(F.encode("html", "UTF-8")))
    long = F.octet_length("html") >= least_bytes
    groups = rows.where(long).groupBy("sha1").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = common.saved(groups.select("sha1", "first"), "payloads")
    joined = common.sized_join(rows, groups, "sha1", "left", 120)
    return joined.withColumn("refers_to", F.when(long & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).drop("first")


def write(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) as whole-file gzip archives in folder; returns archive and records of each."""
    rows = roles(pages, least_bytes).select("page_id", "url", "html", "sha1", "refers_to")
    return common.saved(rows.withColumn("html", F.encode("html", "UTF-8")).mapInArrow(_write(folder), "archive string, records long"), "archives")


def normalise(archives: DataFrame, folder: str, remove: bool = True) -> DataFrame:
    """Rewrite whole-file gzip archives as one member a record, with sidecar indexes (page, type, offset, length).

    Returns the index: archive, page_id, offset, length. remove: delete each source once its copy is complete.
    """
    n = max(1, archives.count())
    dealt = archives.select("archive").repartition(min(n, 4000), "archive")
    return common.saved(dealt.mapInArrow(_normalise(folder, remove), "archive string, page_id long, offset long, length long"), "index")


def read(index: DataFrame, folder: str) -> DataFrame:
    """Read records by their offsets: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    Payloads are checked against their length and digest; a revisit's payload is null, its length and digest are those
    of the payload it refers to.
    """
    return index.mapInArrow(_read(folder), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write pages to archives, normalise them, and read them back.

    pages: page_id, url, html; other columns are ignored. One row per page. Null html is an empty payload; a null url
    is about:blank; null page_ids are records like others and never those referred to; of rows that share the largest
    page_id each is a response; an empty table gives an empty one. Archives stay in the shared folder.
    """
    folder = f"{common.shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read(normalise(write(pages, folder), folder), folder)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS m FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM m AND m IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM m THEN m END AS refers_to FROM g
"""


def query(spark, sf_dir: str) -> DataFrame:
    read_back = archive_and_read(common.table(spark, sf_dir, "pages"))
    return read_back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
