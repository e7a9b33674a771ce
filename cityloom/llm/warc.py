"""Web archives in ZIP packages: writing, and reading by ranges without extraction.

An archive is a ZIP file of stored (uncompressed) members, as web-archive collections are packaged: one member of WARC
records, each its own gzip member, and one index member with a line per record. :func:`write_archives` lets every task
write its own package in the shared folder. :func:`read_archives` parses the end record, the ZIP64 records and the central
directory of each package, reads the index by range, deals the records out over tasks and reads each by its own range.
"""

from __future__ import annotations

import base64
import hashlib
import io
import itertools
import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from cityloom.llm.storage import ship, table
from cityloom.session import scratch_path

RECORDS = "archive/data.warc.gz"
INDEX = "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_U32 = 0xFFFFFFFF
_U16 = 0xFFFF


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder given as a path or a URI."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- ZIP packages -------------------------------------------------------------------------------------------------


class ZipWriter:
    """Stored members written one after another to a stream; sizes follow in a data descriptor, all fields in ZIP64 form."""

    def __init__(self, out):
        self.out, self.at, self.members = out, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def member(self, name: str, chunks: Iterator[bytes]) -> None:
        raw, start, crc, size = name.encode(), self.at, 0, 0
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._put(struct.pack("<4s5H3I2H", b"PK\3\4", 45, 0x808, 0, 0, 33, 0, _U32, _U32, len(raw), len(extra)) + raw + extra)
        for chunk in chunks:
            crc, size = zlib.crc32(chunk, crc), size + len(chunk)
            self._put(chunk)
        self._put(struct.pack("<4sIQQ", b"PK\7\x08", crc, size, size))
        self.members.append((raw, crc, size, start))

    def close(self) -> None:
        start = self.at
        for raw, crc, size, offset in self.members:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, offset)
            self._put(struct.pack("<4s6H3I5H2I", b"PK\1\2", 45, 45, 0x808, 0, 0, 33, crc, _U32, _U32, len(raw), len(extra), 0, 0, 0, 0, _U32) + raw + extra)
        size, end, n = self.at - start, self.at, len(self.members)
        self._put(struct.pack("<4sQ2H2I4Q", b"PK\6\6", 44, 45, 45, 0, 0, n, n, size, start))
        self._put(struct.pack("<4sIQI", b"PK\6\7", 0, end, 1))
        self._put(struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, min(n, _U16), min(n, _U16), min(size, _U32), _U32, 0))


def directory(read: Callable[[int, int], bytes], length: int) -> dict[str, tuple[int, int]]:
    """Offset and size of the stored members of a package, from its end record and central directory.

    ``read(offset, size)`` gives bytes of the package. Members that are compressed or encrypted are an error when named
    in the directory, since they have no ranges to read.
    """
    tail_at = max(0, length - 65_557)
    tail = read(tail_at, length - tail_at)
    at = tail.rfind(b"PK\5\6")
    if at < 0:
        raise ValueError("no end of central directory")
    n, size, start = struct.unpack("<HII", tail[at + 10 : at + 20])
    if _U32 in (size, start) or n == _U16:
        locator = read(tail_at + at - 20, 20)
        if locator[:4] != b"PK\6\7":
            raise ValueError("no ZIP64 locator")
        (end64,) = struct.unpack("<Q", locator[8:16])
        record = read(end64, 56)
        if record[:4] != b"PK\6\6":
            raise ValueError("no ZIP64 end record")
        n, size, start = struct.unpack("<3Q", record[32:56])
    body, p, found = read(start, size), 0, {}
    for _ in range(n):
        if body[p : p + 4] != b"PK\1\2":
            raise ValueError("broken central directory")
        flags, method = struct.unpack("<2H", body[p + 8 : p + 12])
        packed, plain, n_name, n_extra, n_comment = struct.unpack("<2I3H", body[p + 20 : p + 34])
        (offset,) = struct.unpack("<I", body[p + 42 : p + 46])
        name = body[p + 46 : p + 46 + n_name].decode()
        extra = body[p + 46 + n_name : p + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, k = struct.unpack("<2H", extra[:4])
            if kind == 1:
                wide = iter(struct.unpack(f"<{k // 8}Q", extra[4 : 4 + k // 8 * 8]))
                plain = next(wide) if plain == _U32 else plain
                packed = next(wide) if packed == _U32 else packed
                offset = next(wide) if offset == _U32 else offset
            extra = extra[4 + k :]
        if method or flags & 1:
            raise ValueError(f"member {name} is not stored")
        head = read(offset, 30)
        name_size, extra_size = struct.unpack("<2H", head[26:30])
        found[name] = (offset + 30 + name_size + extra_size, packed)
        p += 46 + n_name + n_extra + n_comment
    return found


# --- WARC records -------------------------------------------------------------------------------------------------


def record(page: str, url: str | None, payload: bytes, refers_to: str | None, digest_: str) -> bytes:
    """One WARC record as a gzip member: a response with its payload, or a revisit that names the page it repeats."""
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{digest_}')}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": json.dumps(url or "")[1:-1],
        "WARC-Payload-Digest": f"sha1:{digest_}",
        "WARC-Page-ID": page,
        "WARC-Payload-Length": str(len(payload)),
    }
    if refers_to is not None:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}:{digest_}')}>", "WARC-Refers-To-Page-ID": refers_to}
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if refers_to is None else b"")
    fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and payload of one gzip member with a WARC record."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


# --- Spark jobs ---------------------------------------------------------------------------------------------------


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write a record per row of ``pages`` into packages and return ``path, records``, a row per package.

    Of the rows with equal payloads of at least ``min_bytes`` bytes the largest page id is a response, the others are
    revisits that refer to it; smaller payloads are all responses. A null html is an empty payload, a null url an empty
    one. A null page id counts as smaller than any other. Rows that repeat page id and payload of a response are
    responses too. A lost task writes its package again; only packages named in the returned table count.
    """
    spark = pages.sparkSession
    ship(spark)
    folder = scratch_path(spark, "warc")
    rows = pages.select(F.col(page_id).alias("page"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    marked = rows.withColumn("digest", F.base64(F.unhex(F.sha1("html")))).withColumn("size", F.octet_length("html"))
    groups = marked.select("digest", "size", "page").groupBy("digest", "size").agg(F.max("page").alias("top"), F.count("*").alias("n"))
    groups = table(groups.where((F.col("n") > 1) & (F.col("size") >= min_bytes)).select("digest", "size", "top"), "payloads")
    full = marked.join(groups.hint("merge"), ["digest", "size"], "left").select(
        F.col("page").cast("string").alias("page"),
        "url",
        "html",
        F.when(~F.col("page").eqNullSafe(F.col("top")), F.col("top")).cast("string").alias("refers_to"),
    )

    def run(batches):
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        batches = itertools.chain([first], batches)
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        name = f"{uuid.uuid4().hex}.wacz"
        index, n = io.StringIO(), 0

        def records():
            nonlocal n
            at = 0
            for batch in batches:
                for page, url_, html_, refers in zip(*(batch.column(c) for c in ("page", "url", "html", "refers_to")), strict=True):
                    payload = html_.as_py().encode()
                    raw = record(page.as_py() or "", url_.as_py(), payload, refers.as_py(), digest(payload))
                    index.write(json.dumps({"page": page.as_py(), "offset": at, "length": len(raw)}) + "\n")
                    at, n = at + len(raw), n + 1
                    yield raw

        with store.open_output_stream(f"{base}/{name}.part", compression=None) as out:
            package = ZipWriter(out)
            package.member(RECORDS, records())
            package.member(INDEX, iter([index.getvalue().encode()]))
            package.close()
        store.move(f"{base}/{name}.part", f"{base}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64())], names=["path", "records"])

    return table(full.mapInArrow(run, "path string, records long"), "packages")


class Ranges:
    """Reads parts of files by offset; keeps the last file open."""

    def __init__(self):
        self.path, self.file = None, None

    def open(self, path: str):
        if path != self.path:
            if self.file is not None:
                self.file.close()
            store, inner = open_store(path)
            self.path, self.file = path, store.open_input_file(inner)
        return self.file

    def read(self, path: str, offset: int, size: int) -> bytes:
        return self.open(path).read_at(size, offset)


def list_records(packages: DataFrame) -> DataFrame:
    """``path, offset, length`` of every record, from the directories and indexes of the packages ``path``."""

    def run(batches):
        ranges = Ranges()
        for batch in batches:
            for path in batch.column(0).to_pylist():
                members = directory(lambda o, n, p=path: ranges.read(p, o, n), ranges.open(path).size())
                base, _ = members[RECORDS]
                lines = [json.loads(x) for x in ranges.read(path, *members[INDEX]).decode().splitlines()]
                for k in range(0, len(lines), 10_000):
                    part = lines[k : k + 10_000]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([path] * len(part)),
                            pa.array([base + x["offset"] for x in part], pa.int64()),
                            pa.array([x["length"] for x in part], pa.int64()),
                        ],
                        names=["path", "offset", "length"],
                    )

    return packages.select("path").repartition("path").mapInArrow(run, "path string, offset long, length long")


def read_archives(packages: DataFrame, span: int = 4 << 20) -> DataFrame:
    """``page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to`` of every record of the packages.

    Ids come back as strings, null where none was written. A revisit has no payload of its own; its size and digest are
    those of the full payload. A response whose payload does not have the stated digest is an error. No packages: no rows.
    """
    ship(packages.sparkSession)

    def run(batches):
        ranges = Ranges()
        for batch in batches:
            out = []
            for path, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fields, payload = parse(ranges.read(path, offset, length))
                own = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                revisit = fields["WARC-Type"] == "revisit"
                if not revisit and digest(payload) != own:
                    raise ValueError(f"damaged record at {offset} of {path}")
                out.append(
                    (fields["WARC-Page-ID"] or None, json.loads(f'"{fields["WARC-Target-URI"]}"'), None if revisit else payload,
                     int(fields["WARC-Payload-Length"]), own, fields["WARC-Type"], fields.get("WARC-Refers-To-Page-ID"))
                )
                if len(out) == 500:
                    yield _rows(out)
                    out = []
            if out:
                yield _rows(out)

    spans = list_records(packages).repartition("path", F.floor(F.col("offset") / span)).select("path", "offset", "length")
    return spans.sortWithinPartitions("path", "offset").mapInArrow(
        run, "page_id string, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to string"
    )


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string()]
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """:func:`write_archives`, then :func:`read_archives`."""
    return read_archives(write_archives(pages, **options))
