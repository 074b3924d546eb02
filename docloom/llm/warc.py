"""WARC archives: a writer with revisit records, and a splittable reader of per-record gzip members."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, split_marked, written

MAGIC = b"\x1f\x8b\x08"
READ = 1 << 20
#: A member's first bytes that are enough to see its version line, whatever the compression.
PROBE = 4096
_VERSION = re.compile(rb"WARC/\d+\.\d+\r\n")
_PAGE = re.compile(r"<urn:docloom:page:(-?\d+)>")
_FILES = pa.schema([("path", pa.string()), ("length", pa.int64()), ("records", pa.int64())])
_RECORDS = pa.schema(
    [("page_id", pa.int64()), ("record_type", pa.string()), ("target_uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
    + [("refers_to", pa.int64()), ("payload", pa.binary()), ("path", pa.string()), ("offset", pa.int64())]
)
_RECORDS_DDL = (
    "page_id bigint, record_type string, target_uri string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary, path string, offset bigint"
)


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI: a local or mounted folder, HDFS or an object store."""
    return fs.FileSystem.from_uri(path if "://" in path else re.sub(r"^file:/+", "file:///", path) if path.startswith("file:") else f"file://{path}")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, n_bytes: int, refers_to: int | None) -> bytes:
    """One WARC record. A revisit has HTTP headers but no payload; its X-Payload-Length extends the standard's headers."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:docloom:page:{page_id}>" if page_id is not None else f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>"]
    head += ["WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:docloom:page:{refers_to}>", f"X-Payload-Length: {n_bytes}"]
    head.append(f"Content-Length: {len(block)}")
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 4) -> bytes:
    """data as a gzip member of its own."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _archiver(folder: str, max_file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each attempt writes files of its own; only those that the finished task names are ever read."""
        store, at = _open(folder)
        part, files, out, count = TaskContext.get().partitionId(), [], None, 0

        def close():
            nonlocal out, count
            if out is not None:
                files.append((path, out.tell(), count))
                out.close()
                out, count = None, 0

        for batch in batches:
            names = batch.schema.names
            for values in zip(*(batch.column(i).to_pylist() for i in range(len(names))), strict=True):
                row = dict(zip(names, values, strict=True))
                if out is None:
                    name = f"part-{part:05d}-{uuid.uuid4().hex}.warc.gz"
                    path = f"{folder.rstrip('/')}/{name}"
                    out = store.open_output_stream(f"{at}/{name}", compression=None)
                payload = (row["html"] or "").encode()
                digest = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
                kind = "response" if row["refers_to"] is None else "revisit"
                out.write(member(record(kind, row["page_id"], row["url"], payload, digest, row["n_bytes"], row["refers_to"])))
                count += 1
                if out.tell() >= max_file_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_pydict({n: [f[i] for f in files] for i, n in enumerate(("path", "length", "records"))}, schema=_FILES)

    return run


def write_warc(pages: DataFrame, folder: str, *, least_bytes: int = 0, max_file_bytes: int = 1 << 30) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) and returns the files: path, length, records.

    The payload is html in UTF-8 (null: empty). Of the rows with equal payloads of at least least_bytes bytes, that
    with the smallest page_id becomes a response and the others revisits of it; smaller payloads are all responses.

    Cases: a null url leaves the target out; control and other unsafe characters of urls are percent-encoded; rows with
    a null page_id are responses; rows that repeat a page_id and payload are alike; an empty table writes no file;
    other columns are ignored.

    Scale: digests are grouped without the payloads, and only digests that several pages share come back to the pages;
    pages whose digest is not among them, by a bitmap, take no part in that join and stay where they are read. Each task streams into files of its own, so a lost executor costs its tasks only."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint"), "url", "html", F.sha1(F.encode(html, "UTF-8")).alias("sha1"), F.octet_length(html).cast("bigint").alias("n_bytes"))
    firsts = (
        rows.filter(F.col("n_bytes") >= least_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
        .filter("first <> last").select("sha1", "first")
    )
    firsts = written(firsts, "digests")
    some, rest = split_marked(rows, F.xxhash64("sha1"), firsts.select(F.xxhash64("sha1")))
    again = F.when(F.col("first") != F.col("page_id"), F.col("first"))
    some = some.join(firsts, "sha1", "left").withColumn("refers_to", again).drop("first").withColumn("html", F.when(F.col("refers_to").isNull(), F.col("html")))
    rows = rest.withColumn("refers_to", F.lit(None).cast("bigint")).unionByName(some)
    store, at = _open(folder)
    store.create_dir(at, recursive=True)
    return written(rows.mapInArrow(_archiver(folder, max_file_bytes), "path string, length bigint, records bigint"), "archives")


class _Bytes:
    """Random access to a file by offset, with one buffer that moves forward."""

    def __init__(self, file):
        self.file, self.begin, self.data, self.last = file, 0, b"", False

    def _load(self, at: int, n: int) -> None:
        self.file.seek(at)
        self.begin, self.data = at, self.file.read(max(n, READ))
        self.last = len(self.data) < max(n, READ)

    def get(self, at: int, n: int) -> bytes:
        """n bytes from at; fewer only at the file's end."""
        if not (self.begin <= at and (self.last or at + n <= self.begin + len(self.data))):
            self._load(at, n)
        return self.data[at - self.begin : at - self.begin + n]

    def some(self, at: int, n: int = 1 << 16) -> bytes:
        """Up to n bytes from at, as the buffer has them; none only at the file's end."""
        if not self.begin <= at < self.begin + len(self.data):
            self._load(at, n)
        return self.data[at - self.begin : at - self.begin + n]


def _starts_record(data: _Bytes, at: int) -> bool:
    """Whether a gzip member at this place decodes to a WARC version line. Reserved flags are checked first."""
    head = data.get(at, PROBE)
    if len(head) < 18 or head[3] & 0xE0:
        return False
    try:
        return bool(_VERSION.match(zlib.decompressobj(31).decompress(head, 64)))
    except zlib.error:
        return False


def _whole(data: _Bytes, at: int) -> tuple[bytes, int] | None:
    """The member's content and the place behind it; None if it is broken."""
    z, parts, pos = zlib.decompressobj(31), [], at
    while not z.eof:
        raw = data.some(pos)
        if not raw:
            return None
        try:
            parts.append(z.decompress(raw))
        except zlib.error:
            return None
        pos += len(raw)
    return b"".join(parts), pos - len(z.unused_data)


def _before(data: _Bytes, at: int) -> int:
    """The place of the last magic bytes that begin before at; -1 if there are none."""
    end = at + len(MAGIC) - 1
    while end > len(MAGIC) - 1:
        start = max(0, end - READ)
        if (k := data.get(start, end - start).rfind(MAGIC)) >= 0:
            return start + k
        end = start + len(MAGIC) - 1 if start else 0
    return -1


#: A stored block of deflate holds at most so many bytes in a row; between two of them stands a header.
STORED = 65_535


def _broken(data: _Bytes, at: int, size: int) -> int | None:
    """Where the whole records that follow one another from here end; None if that is the file's end, or if they take more
    than a stored block holds.

    Bytes of another archive can only stand in a member's payload as they are in stored blocks, and a record that reaches over a
    block's end is broken there. So a row of records longer than a block is none of a payload."""
    p = at
    while p - at <= STORED:
        if p == size:
            return None
        found = _whole(data, p) if _starts_record(data, p) else None
        if not found:
            return p
        p = found[1]
    return None


def _enclosing(data: _Bytes, at: int, broken: int) -> int | None:
    """The end of a record before at that reaches beyond it, of whose payload at is a part; None if there is none.

    Records are looked at backwards, however many they are, up to the file's beginning or to a row of them (which is broken
    at a place) that is too long for a payload."""
    q = first = at
    while (q := _before(data, q)) >= 0:
        if _starts_record(data, q) and (found := _whole(data, q)):
            if found[1] > at:
                return found[1]
            if found[1] != first:
                broken = found[1]
            first = q
            if q == 0 or broken - first > STORED:
                return None
    return None


def members(file, start: int, end: int, size: int) -> Iterator[tuple[int, bytes | None]]:
    """(offset, content) of the records whose members begin in [start, end), and (offset, None) where the bytes behind
    such a record, or at the file's beginning, are damaged.

    A range seldom begins at a member, so gzip's magic bytes are looked for from start on; they also occur inside
    compressed data, so a candidate counts only if its first bytes decode to a WARC version line and it decodes to its
    end, checksum included. Records of another archive, stored inside a payload without compression, do so too. A candidate is
    none of those if more whole records follow it than a payload can hold in a row (see _broken); where damage or such a
    payload leaves that open, it is one if a record before it reaches beyond it, and the search goes on behind that. So the records are the
    same wherever ranges are cut, and a record in front of damaged bytes counts. From there each member's end is
    the next one's start; the last one may reach beyond end."""
    data, at, in_step = _Bytes(file), start, start == 0
    while at < end:
        if not in_step:
            block = data.get(at, min(READ, end - at + len(MAGIC) - 1))
            k = block.find(MAGIC)
            if k < 0:
                at += max(1, len(block) - len(MAGIC) + 1)
                continue
            at += k
            if at >= end:
                return
        found = _whole(data, at) if _starts_record(data, at) else None
        broken = None if not found or in_step or at == 0 else _broken(data, at, size)
        around = None if broken is None else _enclosing(data, at, broken)
        if around:
            at = around
        elif found:
            yield at, found[0]
            at, in_step = found[1], True
            if at >= end and at < size and not (_starts_record(data, at) and _whole(data, at)):
                yield at, None  # no later range would see that the record before it was whole
        else:
            if in_step:
                yield at, None
            at, in_step = at + 1, False


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers (names lower-cased) and block."""
    head, _, rest = content.partition(b"\r\n\r\n")
    headers = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    n = headers.get("content-length", "")
    return headers, rest[: int(n)] if n.isdigit() else rest


def _page(uri: str | None) -> int | None:
    m = _PAGE.fullmatch(uri or "")
    return int(m[1]) if m else None


def _reader(payloads: bool, damaged: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def flush():
            nonlocal rows, held
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_RECORDS)], schema=_RECORDS)
            rows, held = [], 0
            return out

        for batch in batches:
            for path, length, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "start", "end")), strict=True):
                store, at = _open(path)
                with store.open_input_file(at) as file:
                    for offset, content in members(file, start, end, length):
                        if content is None:
                            if damaged:
                                rows.append((None, "damaged", None, None, None, None, None, path, offset))
                            continue
                        headers, block = parse(content)
                        kind = headers.get("warc-type")
                        if kind not in ("response", "revisit"):
                            continue
                        digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
                        payload, n = None, int(n) if (n := headers.get("x-payload-length", "")).isdigit() else 0
                        if kind == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            n = len(payload)
                            if digest != base32_sha1(payload):
                                raise ValueError(f"payload digest differs in {path} at {offset}")
                        rows.append((_page(headers.get("warc-record-id")), kind, headers.get("warc-target-uri"), n, digest, _page(headers.get("warc-refers-to")), payload if payloads else None, path, offset))
                        held += n if payloads else 200
                        if held > 4 << 20:
                            yield flush()
        yield flush()

    return run


def read_warc(spark: SparkSession, files: DataFrame, *, split_bytes: int = 16 << 20, payloads: bool = True, damaged: bool = False) -> DataFrame:
    """The response and revisit records of files (path, length): page_id, record_type, target_uri, payload_bytes,
    payload_digest (bare base32 SHA-1), refers_to, payload, path and offset.

    Files are cut into byte ranges of split_bytes, one task each, however few and large the files are; a task reads the
    records that begin in its range (see members). Digests of responses are checked. Without payloads the payload
    column is null, and only headers and digests leave the task. Damaged bytes are passed over up to the next whole record;
    with damaged, each such stretch is a row of record_type damaged with its path and offset. A length that is no number is not used."""
    cut = F.expr(f"transform(sequence(0L, greatest(length - 1, 0L), {split_bytes}L), s -> struct(s as start, least(s + {split_bytes}L, length) as end))")
    ranges = written(files.filter("length > 0").select("path", "length", F.explode(cut).alias("r")).select("path", "length", "r.start", "r.end"), "ranges")
    n = ranges.count()
    # a range a task: the ranges' order numbers spread them, where hashing would put several into one
    numbered = ranges.repartitionByRange(max(1, min(n, 100_000)), "path", "start")
    return numbered.mapInArrow(_reader(payloads, damaged), _RECORDS_DDL)


def warc_round_trip(pages: DataFrame, *, least_bytes: int = 0, split_bytes: int = 16 << 20) -> DataFrame:
    """Writes pages to archives in the shared folder and reads the records back, without payloads."""
    spark = pages.sparkSession
    files = write_warc(pages, new_path(spark, "warc"), least_bytes=least_bytes)
    return read_warc(spark, files, split_bytes=split_bytes, payloads=False)
