"""WARC archives as a Spark data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Reading plans partitions over files, takes predicates on the record type and other headers, parses headers first
and passes over the payload of a record that is not wanted without inflating it: each record is a gzip member of its own, and
members written here carry the skip-lengths field "sl" of the WARC standard. Archives without it, and with several records in a member, are read as well.
Files are opened through pyarrow's file systems, on the executors.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from .common import need_columns, new_path, salted_lookup, ship, text_or_empty

SCHEMA = "record_id string, record_type string, target_uri string, date string, content_type string, payload_digest string, payload_bytes long, refers_to string, payload binary"
#: Columns that are headers, by which records can be passed over.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "content_type": "content-type", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of a record that are inflated to look at its headers.
HEAD = 4096
#: Name of the extra field with the mark of a file, sixteen random bytes, by which a reader that begins inside the file finds the next member.
MARK = b"lm"


def _line(value: str) -> str:
    """A header value keeps to its line."""
    return value.replace("\r", "%0D").replace("\n", "%0A").strip()


def record_bytes(record_id: str, record_type: str, uri: str | None, date: str, payload: bytes, payload_bytes: int, digest: str | None, refers_to: str | None) -> bytes:
    """A whole WARC record. A revisit keeps the HTTP header of its response and no payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    if record_type != "revisit":
        block += payload
    lines = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <{_line(record_id)}>", f"WARC-Date: {date}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {_line(uri)}")
    if digest is not None:
        lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if record_type == "revisit":
        lines.append(f"WARC-Profile: {PROFILE}")
    if refers_to is not None:
        lines.append(f"WARC-Refers-To: <{_line(refers_to)}>")
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 3, mark: bytes = b"") -> bytes:
    """data as a gzip member that says, in its extra field, how long it is compressed and not ("sl", left out beyond 4 GB), after the mark of its file if there is one."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    extra = MARK + struct.pack("<H", len(mark)) + mark if mark else b""
    total = 10 + 2 + len(extra) + 12 + len(body) + 8
    if max(total, len(data)) < 1 << 32:
        extra += b"sl" + struct.pack("<HII", 8, total, len(data))
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _fields(lines: bytes) -> dict[str, str]:
    found: dict[str, str] = {}
    for line in lines.decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if colon:
            found.setdefault(name.strip().lower(), value.strip())
    return found


def _columns(fields: dict[str, str]) -> dict[str, str | None]:
    row = {c: fields.get(h) for c, h in HEADERS.items()}
    for c in ("record_id", "refers_to"):
        if row[c] and row[c].startswith("<") and row[c].endswith(">"):
            row[c] = row[c][1:-1]
    return row


class _Buffered:
    """Places of a file by way of one block of it, so that what is read in order is fetched once."""

    def __init__(self, f, block: int = 1 << 20):
        self.f, self.block, self.end, self.at, self.held = f, block, f.size(), 0, b""

    def read_at(self, n: int, at: int) -> bytes:
        n = max(0, min(n, self.end - at))
        if at < self.at or at + n > self.at + len(self.held):
            kept = self.held[at - self.at :] if self.at <= at <= self.at + len(self.held) else b""
            new = at + len(kept)
            self.held, self.at = kept + self.f.read_at(min(max(n - len(kept), self.block), self.end - new), new), at
        return self.held[at - self.at : at - self.at + n]


class _Stream:
    """The bytes of a gzip member, or of a file from a place on, in order."""

    def __init__(self, f: _Buffered, at: int, gz: bool):
        self.f, self.at, self.gz, self.buffer = f, at, gz, b""
        self.inflate = zlib.decompressobj(31) if gz else None
        self.passed = 0  # bytes given out so far
        self.skip_to = self.whole = None  # where the next member begins and how long this one is inflated, if it says so
        if gz:
            start = f.read_at(12, at)
            if start[:2] != b"\x1f\x8b":
                raise ValueError(f"no gzip member at byte {at}")
            for name, value in _extra(f, at, start):
                if name == b"sl" and len(value) == 8 and (total := struct.unpack_from("<I", value)[0]):
                    self.skip_to, self.whole = at + total, struct.unpack_from("<I", value, 4)[0]

    def _more(self, n: int) -> bool:
        """Tries to have n bytes at hand."""
        parts, have = [self.buffer], len(self.buffer)
        while have < n:
            if not self.gz:
                data = self.f.read_at(max(n - have, 1 << 14), self.at)
                self.at += len(data)
            elif self.inflate.eof:
                break
            else:
                part = self.inflate.unconsumed_tail or self.f.read_at(1 << 16, self.at)
                if not part:
                    raise ValueError("a gzip member is cut off")
                self.at += 0 if self.inflate.unconsumed_tail else len(part)
                data = self.inflate.decompress(part, max(n - have, 1 << 12))
                parts.append(data)
                have += len(data)
                continue
            if not data:
                break
            parts.append(data)
            have += len(data)
        self.buffer = b"".join(parts)
        return have >= n

    def take(self, n: int) -> bytes:
        if not self._more(n):
            raise ValueError("a record is cut off")
        out, self.buffer = self.buffer[:n], self.buffer[n:]
        self.passed += n
        return out

    def skip(self, n: int) -> None:
        if not self.gz and n > len(self.buffer):
            self.at += n - len(self.buffer)
            self.passed += n
            self.buffer = b""
            if self.at > self.f.end:
                raise ValueError("a record is cut off")
            return
        while n:
            n -= len(self.take(min(n, 1 << 20)))

    def until(self, end: bytes, most: int | None = None) -> bytes:
        """All up to and with ``end``, or nothing if it does not come, within so many bytes if there is a limit."""
        n = HEAD
        while True:
            n = n if most is None else min(n, most)
            there = self._more(n)
            if (found := self.buffer.find(end, 0, most)) >= 0:
                return self.take(found + len(end))
            if not there or n == most:
                return b""
            n *= 4

    def ended(self) -> bool:
        """Whether nothing but line ends is left."""
        while self._more(1) and self.buffer[:1] in b"\r\n":
            self.take(1)
        return not self.buffer

    def after(self) -> int:
        return self.at - len(self.inflate.unused_data)


def _extra(f: _Buffered, at: int, start: bytes) -> Iterator[tuple[bytes, bytes]]:
    """The extra fields of the gzip member at a place, whose first twelve bytes are given."""
    if start[3] & 4:
        extra = f.read_at(struct.unpack_from("<H", start, 10)[0], at + 12)
        while len(extra) >= 4:
            n = struct.unpack_from("<H", extra, 2)[0]
            yield extra[:2], extra[4 : 4 + n]
            extra = extra[4 + n :]


def file_mark(f: _Buffered) -> bytes:
    """The mark that every member of a file written here has and no other bytes have, or nothing."""
    start = f.read_at(12, 0)
    return next((v for n, v in _extra(f, 0, start) if n == MARK and len(v) == 16), b"") if start[:2] == b"\x1f\x8b" else b""


def _first_member(f: _Buffered, start: int, stop: int, mark: bytes) -> int:
    """Where the first member that begins within a range of a marked file begins, or stop."""
    before, at = 16, start  # a member's mark comes after ten bytes, the length of its extra fields, and the mark's name and length
    while at < stop + before:
        data = f.read_at((1 << 20) + 15, at)
        if (found := data.find(mark)) >= 0 and at + found - before >= start:
            return min(stop, at + found - before)
        at = at + found + 1 if found >= 0 else at + (1 << 20)
    return stop


def records(f, gz: bool, wanted: Callable[[dict], bool] = lambda row: True, payload: bool = True, verify: bool = True, start: int = 0, stop: int | None = None) -> Iterator[dict]:
    """The records of an open archive as rows of SCHEMA; the payload is None for revisits and where it is not asked for.

    A gzip member may hold one record, as the standard has it, several or the whole archive. start and stop: the range in which members begin that are
    read, of a file with a mark. Whatever is no record, or is cut off, or does not have its digest, is an error: nothing is passed over silently.
    """
    f = _Buffered(f)
    stop = f.end if stop is None else stop
    at = _first_member(f, start, stop, file_mark(f)) if start else 0
    while at < stop:
        stream = _Stream(f, at, gz)
        while not stream.ended():
            head = stream.until(b"\r\n\r\n")
            if not head.startswith(b"WARC/"):
                raise ValueError(f"no WARC record in what begins at byte {at}")
            fields = _fields(head[:-4])
            length = int(fields["content-length"])
            row = _columns(fields)
            alone = stream.whole is not None and stream.passed + length + 4 == stream.whole
            if wanted(row):
                http = stream.until(b"\r\n\r\n", length) if (fields.get("content-type") or "").startswith("application/http") else b""
                held, body = length - len(http), None
                of_http = _fields(http[:-4]) if row["record_type"] == "revisit" else {}  # else what is there counts
                if row["record_type"] != "revisit" and (payload or verify):
                    body = stream.take(held)
                    digest = row["payload_digest"] or ""
                    if verify and digest.startswith("sha1:") and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest[5:]:
                        raise ValueError(f"the payload of {row['record_id']} does not have its digest")
                    length = 0
                else:
                    length = held
                yield row | {"payload_bytes": int(of_http.get("content-length", held)), "payload": body if payload else None}
            if alone:
                break
            stream.skip(length)
        if not gz:
            break
        at = stream.skip_to if stream.skip_to is not None and not stream.inflate.eof else stream.after()


class WarcPartition(InputPartition):
    """Parts of files: path, and the range in which the members begin that are meant, or None for all."""

    def __init__(self):
        self.parts: list[tuple[str, int, int | None]] = []


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """A file system of pyarrow for a URI as Hadoop writes it, and the path there."""
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


def _test(x: Filter) -> Callable[[dict], bool] | None:
    """A predicate on one header column, or None if it is of another kind."""
    column = getattr(x, "attribute", (None,))
    if len(column) != 1 or column[0] not in HEADERS:
        return None
    c = column[0]
    if isinstance(x, (EqualTo, EqualNullSafe)) and x.value is not None:
        return lambda row: row[c] == x.value
    if isinstance(x, In) and None not in x.value:
        return lambda row: row[c] in x.value
    if isinstance(x, IsNull):
        return lambda row: row[c] is None
    if isinstance(x, IsNotNull):
        return lambda row: row[c] is not None
    for kind, test in ((StringStartsWith, str.startswith), (StringEndsWith, str.endswith), (StringContains, str.__contains__)):
        if isinstance(x, kind):
            return lambda row, test=test: row[c] is not None and test(row[c], x.value)
    return None


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "true").lower() == "true"
        self.split = int(options.get("splitbytes", 64 << 20))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for x in filters:
            if _test(x) is None:
                yield x
            else:
                self.filters.append(x)

    def partitions(self) -> Sequence[WarcPartition]:
        system, path = file_system(self.path)
        found = system.get_file_info(path) if system.get_file_info(path).type != fs.FileType.Directory else None
        files = [found] if found else system.get_file_info(fs.FileSelector(path))
        out, held = [WarcPartition()], 0
        for x in sorted((x for x in files if x.is_file and x.base_name.endswith((".warc", ".warc.gz")) and x.base_name[0] not in "._"), key=lambda x: x.path):
            cuts: list[int | None] = [0, None]
            if x.size > self.split and x.base_name.endswith(".gz"):
                with system.open_input_file(x.path) as f:
                    if file_mark(_Buffered(f, 64)):
                        cuts = [*range(0, x.size, self.split), x.size]
            for start, stop in zip(cuts, cuts[1:], strict=False):
                if held >= self.split:
                    out.append(WarcPartition())
                    held = 0
                out[-1].parts.append((x.path, start, stop))
                held += (stop or x.size) - start
        return out

    def read(self, partition: WarcPartition) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.path)
        tests = [_test(x) for x in self.filters]
        kinds = [("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("content_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.string()), ("payload", pa.binary())]
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, pa.schema(kinds))

        for path, start, stop in partition.parts:
            with system.open_input_file(path) as f:
                for row in records(f, path.endswith(".gz"), lambda row: all(t(row) for t in tests), self.payload, self.verify, start, stop):
                    rows.append(row)
                    held += len(row["payload"] or b"")
                    if len(rows) >= 2000 or held > 8 << 20:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()


class Staged(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    """Tasks write under names of their own in a staging folder; the commit moves what the finished tasks name."""

    def __init__(self, options: dict, overwrite: bool):
        self.uri, self.overwrite = options["path"], overwrite
        self.date = options.get("date", "1970-01-01T00:00:00Z")
        self.file_bytes = int(options.get("filebytes", 256 << 20))
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        system, path = file_system(self.uri)
        system.create_dir(f"{path}/{self.staging}")
        files, out, size = [], None, 0
        task = TaskContext.get()
        try:
            for b in iterator:
                for r in b.to_pylist():
                    if out is None or size >= self.file_bytes:
                        if out:
                            out.close()
                        files.append(f"records-{task.partitionId():06d}-{uuid.uuid4().hex}.warc.gz")
                        out, size = system.open_output_stream(f"{path}/{self.staging}/{files[-1]}", compression=None), 0
                        mark = uuid.uuid4().bytes
                    member = gzip_member(record_bytes(r["record_id"], r["record_type"], r["target_uri"], r.get("date") or self.date, r["payload"] or b"", r["payload_bytes"], r["payload_digest"], r["refers_to"]), mark=mark)
                    out.write(member)
                    size += len(member)
        finally:
            if out:
                out.close()
        return Staged(files)

    def commit(self, messages: list[Staged | None]) -> None:
        system, path = file_system(self.uri)
        system.create_dir(path)
        if self.overwrite:
            for x in system.get_file_info(fs.FileSelector(path)):
                if x.is_file and x.base_name.endswith((".warc", ".warc.gz")):
                    system.delete_file(x.path)
        for m in messages:
            for name in m.files if m else []:
                system.move(f"{path}/{self.staging}/{name}", f"{path}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        system, path = file_system(self.uri)
        if system.get_file_info(f"{path}/{self.staging}").type == fs.FileType.Directory:
            system.delete_dir(f"{path}/{self.staging}")


class WarcDataSource(DataSource):
    """Options: path (a URI); reading: payload, verify, splitBytes; writing: date, fileBytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session and lets it push predicates down to Python sources.

    Spark looks a Python source up in the session that is active in the calling thread: so this one is made active, for threads that have none yet.
    """
    ship(spark)
    spark._jvm.SparkSession.setActiveSession(spark._jsparkSession)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def read_warc(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The records of the archives under a path, a file or a folder; an empty folder gives no rows, a damaged archive is an error.

    Options: payload and verify ("false": payloads are not returned, or not held against their digests), splitBytes. Files written here are
    read in ranges of splitBytes; archives of others, whose members can't be told from inside, by one task for each file.
    """
    register(spark)
    return spark.read.format("warc").options(**options).load(path)


def base32_of_hex(digest: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hexadecimal digits, as WARC headers have it."""
    out = []
    for at in range(1, 41, 5):  # five digits are twenty bits, four letters
        bits = F.conv(F.substring(digest, at, 5), 16, 10).cast("int")
        out += [F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.shiftright(bits, right).bitwiseAND(31) + 1, F.lit(1)) for right in (15, 10, 5, 0)]
    return F.concat(*out)


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Rows for the writer: a response for each payload, and revisits of it for the other pages with equal payloads.

    Of pages with equal payloads of at least ``least_bytes``, that with the largest id is the response; pages with smaller payloads are all
    responses. A null html counts as empty. Rows that repeat page and payload are all responses; a page without an id
    refers to one with an id if there is one, and is a response otherwise. Payloads are equal if length and SHA-256 are. An empty table gives no rows.
    """
    need_columns(pages, id_col, url_col, html_col)
    payload = text_or_empty(html_col).cast("binary")
    p = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).alias("_url"), payload.alias("_payload"), F.octet_length(payload).alias("payload_bytes"), F.sha1(payload).alias("_sha1"), F.concat_ws(":", F.sha2(payload, 256), F.octet_length(payload)).alias("_same"))
    equal = p.filter(F.col("payload_bytes") >= least_bytes).groupBy("_same").agg(F.max("_id").alias("_keep"), F.count("*").alias("_n"))
    p = salted_lookup(p, equal.filter("_n > 1").drop("_n"), "_same", "_id", "_url")
    first = F.col("_keep").isNull() | F.col("_keep").eqNullSafe(F.col("_id"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    return p.select(
        urn("_id").alias("record_id"),
        F.when(first, "response").otherwise("revisit").alias("record_type"),
        F.col("_url").alias("target_uri"),
        F.lit(None).cast("string").alias("date"),
        F.lit(None).cast("string").alias("content_type"),
        base32_of_hex(F.col("_sha1")).alias("payload_digest"),
        F.col("payload_bytes").cast("long").alias("payload_bytes"),
        F.when(~first, urn("_keep")).alias("refers_to"),
        F.when(first, F.col("_payload")).alias("payload"),
    )


def archive_pages(pages: DataFrame, path: str, **columns) -> None:
    """Writes a WARC record per page under the path, which all executors can reach."""
    register(pages.sparkSession)
    page_records(pages, **columns).write.format("warc").mode("append").save(path)


def query(spark, sf_dir: str) -> DataFrame:
    """op9: all pages written as WARC records and read back, payloads held against their digests."""
    path = new_path(spark, "warc")
    archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    page = lambda c: F.nullif(F.substring_index(F.col(c), ":", -1), F.lit("null")).cast("long")
    return read_warc(spark, path).select(
        page("record_id").alias("page_id"), "payload_bytes", F.substring_index("payload_digest", ":", -1).alias("payload_digest"), "record_type", page("refers_to").alias("refers_to")
    )


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS keep FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM g
"""
