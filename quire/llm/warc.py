"""WARC archives: a Python data source that writes and reads them.

Each record is a gzip member of its own, and beside each archive lies an index: a line a record with its offset, its compressed
length and its headers. The reader plans a partition an archive, pushes predicates on the record type and on headers down to
the index, and inflates the members that it wants only; without their payloads it inflates none. Archives without an index are read
from their beginning, headers first, and payloads that are not wanted are passed over. Tasks write under names of their own,
which the driver moves into place once all have ended, so a task that runs twice leaves one archive.
"""

from __future__ import annotations

import gzip
import io
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from .common import make_folder, ready, small

VERSION, BREAK = "WARC/1.1", "\r\n"
_SCHEMA = "record_type string, record_id string, target_uri string, date string, content_type string, content_length long, payload_digest string, refers_to string, headers map<string,string>, http_status int, payload binary"
_FIELDS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "content_type": "content-type", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
_ARROW = pa.schema([*((c, pa.string()) for c in ("record_type", "record_id", "target_uri", "date", "content_type")), ("content_length", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("http_status", pa.int32()), ("payload", pa.binary())])
_BATCH_BYTES = 4 << 20
INDEX, DRAFTS = ".cdx", "_drafts"


class WarcFile(InputPartition):
    def __init__(self, uri: str) -> None:
        self.uri = uri


def _skip(stream, size: int) -> None:
    if stream.seekable():
        stream.seek(size, io.SEEK_CUR)
    else:
        while size > 0 and (got := len(stream.read(min(size, 1 << 20)))):
            size -= got


def _headers(stream) -> dict[str, str]:
    """The headers of a record whose first line has been read; names in lower case."""
    headers = {}
    while (line := stream.readline()).strip():
        name, _, value = line.decode("utf-8", "replace").partition(":")
        headers[name.strip().lower()] = value.strip()
    return headers


def _payload(headers: dict[str, str], body: bytes) -> tuple[int | None, bytes]:
    """(HTTP status, payload) of a record's block."""
    status = None
    if headers.get("content-type", "").startswith("application/http"):
        head, _, body = body.partition(b"\r\n\r\n")
        first = head.split(None, 2)
        status = int(first[1]) if len(first) > 1 and first[1].isdigit() else None
    return status, body


def records(stream, wanted, payloads: bool = True) -> Iterator[tuple[dict[str, str], int | None, bytes | None]]:
    """(headers with lower-case names, HTTP status, payload) of the records whose headers `wanted` accepts."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = _headers(stream)
        size = int(headers.get("content-length", 0))
        if not wanted(headers) or not payloads:
            _skip(stream, size)
            if wanted(headers):
                yield headers, None, None
            continue
        yield headers, *_payload(headers, stream.read(size))


def inflate(member: bytes) -> bytes:
    return zlib.decompress(member, 31)


def indexed(raw, index, wanted, payloads: bool = True) -> Iterator[tuple[dict[str, str], int | None, bytes | None]]:
    """The same through an index (lines of JSON): only members that are wanted are read and inflated."""
    for line in index:
        offset, length, headers = json.loads(line)
        if not wanted(headers):
            continue
        if not payloads:
            yield headers, None, None
            continue
        raw.seek(offset)
        stream = io.BytesIO(inflate(raw.read(length)))
        stream.readline()
        _headers(stream)
        yield headers, *_payload(headers, stream.read(int(headers.get("content-length", 0))))


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.payloads = options.get("payload", "true").lower() != "false"
        self.tests: list[tuple[str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes equality and membership tests on the record type and the named headers; Spark keeps the others."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute[0] in _FIELDS and len(f.attribute) == 1:
                self.tests.append((_FIELDS[f.attribute[0]], tuple(f.value) if isinstance(f, In) else (f.value,)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        store, path = pa.fs.FileSystem.from_uri(self.path)
        scheme = self.path.split("://")[0] if "://" in self.path else "file" if ":" in self.path.split("/")[0] else ""
        found = store.get_file_info(pa.fs.FileSelector(path, recursive=True)) if store.get_file_info(path).type == pa.fs.FileType.Directory else [store.get_file_info(path)]
        names = sorted(x.path for x in found if x.type == pa.fs.FileType.File and x.size and not x.base_name.startswith(("_", ".")) and not x.base_name.endswith(INDEX) and f"/{DRAFTS}/" not in x.path)
        return [WarcFile(f"{scheme}://{n}" if scheme else n) for n in names]

    def read(self, partition: WarcFile) -> Iterator[pa.RecordBatch]:
        if partition is None or not getattr(partition, "uri", None):
            return
        store, path = pa.fs.FileSystem.from_uri(partition.uri)
        wanted = lambda headers: all(headers.get(name) in values for name, values in self.tests)
        with store.open_input_file(path) as raw:
            rows, size = [], 0
            for headers, status, payload in self._records(store, path, raw, wanted):
                row = {column: headers.get(name) for column, name in _FIELDS.items()}
                rows.append(row | {"content_length": int(headers.get("content-length", 0)), "headers": list(headers.items()), "http_status": status, "payload": payload})
                size += len(payload or b"") + 500
                if size > _BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


    def _records(self, store, path: str, raw, wanted) -> Iterator[tuple[dict[str, str], int | None, bytes | None]]:
        if store.get_file_info(path + INDEX).type == pa.fs.FileType.File:
            with store.open_input_stream(path + INDEX, compression=None, buffer_size=1 << 20) as index:
                yield from indexed(raw, io.TextIOWrapper(index, "utf-8"), wanted, self.payloads)
            return
        packed = raw.read(2) == b"\x1f\x8b"
        raw.seek(0)
        yield from records(io.BufferedReader(gzip.GzipFile(fileobj=raw) if packed else raw, 1 << 20), wanted, self.payloads)


@dataclass
class Written(WriterCommitMessage):
    draft: str | None
    """The name of a task's archive; none if it had no records."""


class WarcWriter(DataSourceArrowWriter):
    """Writes rows of one column, whole records (bytes), as archives with their indexes."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]

    def _at(self) -> tuple[pa.fs.FileSystem, str]:
        store, path = pa.fs.FileSystem.from_uri(self.path)
        return store, path.rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, path = self._at()
        name, offset = None, 0
        archive = index = None
        try:
            for batch in iterator:
                for record in batch.column(0).to_pylist():
                    if name is None:
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        store.create_dir(f"{path}/{DRAFTS}", recursive=True)
                        archive, index = (store.open_output_stream(f"{path}/{DRAFTS}/{name}{end}", compression=None) for end in ("", INDEX))
                    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = pack.compress(record) + pack.flush()
                    stream = io.BytesIO(record)
                    stream.readline()
                    index.write(json.dumps([offset, len(member), _headers(stream)]).encode() + b"\n")
                    archive.write(member)
                    offset += len(member)
        finally:
            for stream in (archive, index):
                if stream is not None:
                    stream.close()
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        store, path = self._at()
        for m in messages:
            if m and m.draft:
                for end in (INDEX, ""):  # an archive never stands without its index
                    store.move(f"{path}/{DRAFTS}/{m.draft}{end}", f"{path}/{m.draft}{end}")
        self._clear(store, path)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*self._at())

    def _clear(self, store: pa.fs.FileSystem, path: str) -> None:
        if store.get_file_info(f"{path}/{DRAFTS}").type == pa.fs.FileType.Directory:
            store.delete_dir(f"{path}/{DRAFTS}")


class WarcDataSource(DataSource):
    """spark.read.format("warc").option("payload", "false").load(path), and write of one binary column."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    ready(spark.range(0))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def _line(name: str, value):
    return F.concat(F.lit(f"{name}: "), value, F.lit(BREAK))


def _clean(value):
    """One line: characters that would end a header or split an address are percent-encoded, other controls dropped."""
    for char, code in (("\r", "%0D"), ("\n", "%0A"), ("\t", "%09"), (" ", "%20")):
        value = F.replace(value, F.lit(char), F.lit(code))
    return F.regexp_replace(value, "[\\x00-\\x1F\\x7F]", "")


def record_id(key, url):
    h = F.md5(F.concat_ws("\n", F.coalesce(key.cast("string"), F.lit("-")), F.coalesce(url, F.lit("-"))))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def write_warc(df: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 1000, date: str = "2000-01-01T00:00:00Z") -> None:
    """One record a row, in archives of gzip members with an index below `path`, a new folder.

    Of rows with equal payloads of at least `least` bytes, the one with the largest (key, url) is a response; the others are
    revisit records without a body that refer to it. Rows equal to that one in both are responses too. A null payload is
    empty. A null key or url sorts first and its header is left out. The payload's digest and length are in headers of
    every record. Other columns are ignored; an empty table gives a folder without archives.
    """
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(url).cast("string").alias("u"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("p"))
    rows = rows.withColumn("size", F.octet_length("p").cast("long")).withColumn("digest", F.sha1(F.col("p").cast("binary")))
    groups = rows.where(F.col("size") >= least).groupBy("digest").agg(F.max(F.struct("k", "u")).alias("head"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("same"), "head")
    # Small payloads join nothing: they get keys of their own, so that empty pages do not meet in one task.
    rows = rows.withColumn("seek", F.when(F.col("size") >= least, F.col("digest")).otherwise(F.concat_ws(" ", F.lit("-"), "k", "u")))
    rows = rows.join(small(groups, 100_000), F.col("seek") == F.col("same"), "left")
    revisit = F.col("head").isNotNull() & ~(F.col("k").eqNullSafe(F.col("head.k")) & F.col("u").eqNullSafe(F.col("head.u")))
    body = F.concat(F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "), F.col("size").cast("string"), F.lit(BREAK * 2), F.col("p"))
    body = F.when(revisit, F.lit("")).otherwise(body)
    none = F.lit("")
    text = F.concat(
        F.lit(VERSION + BREAK),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", record_id(F.col("k"), F.col("u"))),
        _line("WARC-Date", F.lit(date)),
        F.coalesce(_line("WARC-Target-URI", _clean(F.col("u"))), none),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.coalesce(_line("X-Page-Id", F.col("k").cast("string")), none),
        _line("X-Payload-Length", F.col("size").cast("string")),
        F.when(revisit, F.concat(_line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), _line("WARC-Refers-To", record_id(F.col("head.k"), F.col("head.u"))), F.coalesce(_line("X-Refers-To-Page", F.col("head.k").cast("string")), none))).otherwise(none),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", F.octet_length("b").cast("string")),
        F.lit(BREAK),
        F.col("b"),
        F.lit(BREAK * 2),
    )
    spark = ready(df)
    make_folder(spark, path)
    spark.dataSource.register(WarcDataSource)
    rows.withColumn("b", body).select(text.cast("binary").alias("record")).write.format("warc").mode("append").save(path)


def payloads(archive: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of records that write_warc wrote; a response's figures are those of the bytes read."""
    head = lambda name: F.col("headers")[name]
    read = F.col("record_type") == "response"
    return archive.select(
        head("x-page-id").cast("long").alias("page_id"),
        F.when(read, F.length("payload").cast("long")).otherwise(head("x-payload-length").cast("long")).alias("payload_bytes"),
        F.when(read, F.sha1("payload")).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        "record_type",
        head("x-refers-to-page").cast("long").alias("refers_to"),
    )
