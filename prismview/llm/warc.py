"""WARC archives as a PySpark data source, for reading and writing.

Reading: ``spark.read.format("warc").load(path)``, a folder (read with its subfolders), or a
file. Any archive of the standard is read: plain, one gzip member a record, or one for all.
Files are planned into partitions of similar size; a file is read by one task, since a record
may hold an archive and no byte range can be told to begin a record. Comparisons with header
columns are pushed down (``spark.sql.python.filterPushdown.enabled``). Headers are parsed
first; the payload of a record that a predicate rejects, or that is not wanted
(``option("payload", "false")``), is neither kept nor decoded. In a plain archive it is
skipped by its length. A gzip member of this writer states its length in its header, so
it is skipped without inflating; others are inflated and passed over.

Writing: ``df.write.format("warc").mode("append").save(folder)``. Each task writes
records as gzip members of their own to temporary files; the commit on the driver
moves the files of successful tasks only, so a lost executor leaves no record twice, and
commit and abort remove what is left of the job.

Columns: see SCHEMA; ``headers`` has every header line by its name. A ``response`` of type
application/http is split into ``http_header`` and payload. A record without payload has an
empty one. Null header columns are left out of the record and read back as null. Values are
written as they are, but for line breaks, which a header cannot hold: they become
%0D and %0A. An empty table makes an archive without records. A file that does not go on with
a record where one should begin, or that breaks off, raises an error that names it.

Schemes are those of Arrow's file systems: file, hdfs, viewfs, s3 (also s3a, s3n), gs, abfs(s).
"""

from __future__ import annotations

import base64
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from prismview.llm.scratch import rows_without, shared_folder, split_join, written

SCHEMA = "record_id string, record_type string, date string, target_uri string, refers_to string, payload_digest string, content_type string, content_length long, payload_length long, http_header string, headers map<string,string>, payload binary"
KINDS = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "map<string,string>": pa.map_(pa.string(), pa.string())}
ARROW = pa.schema([(c.split()[0], KINDS[c.split()[1]]) for c in SCHEMA.split(", ")])
#: Column of each header line, by its lower-case name.
HEADERS = {"WARC-Record-ID": "record_id", "WARC-Type": "record_type", "WARC-Date": "date", "WARC-Target-URI": "target_uri", "WARC-Refers-To": "refers_to", "WARC-Payload-Digest": "payload_digest", "Content-Type": "content_type", "Content-Length": "content_length", "X-Payload-Length": "payload_length"}
COLUMNS = {name.lower(): column for name, column in HEADERS.items()}
NUMBERS, BRACKETED = ("content_length", "payload_length"), ("record_id", "refers_to")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2026-01-01T00:00:00Z"
#: Bytes of files read by one task at most (a file more), written to one file, and inflated or read at once.
PARTITION_BYTES, FILE_BYTES, CHUNK = 64 << 20, 64 << 20, 1 << 16
#: Payloads below this size are stored again, not revisited.
LEAST_REVISIT = 1000
#: Copies from which a payload is looked up in a broadcast rather than shuffled, rows of that table at most, and ids of a payload that meet in one task.
HEAVY_COPIES, HEAVY_ROWS, CROWD = 100, 1 << 16, 1000
SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "abfss": "abfss"}


def store(path: str) -> tuple[pafs.FileSystem, str]:
    scheme, mark, rest = path.partition("://")
    if not mark:
        return pafs.FileSystem.from_uri(path if path.startswith("file:") else f"file://{path}")
    return pafs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")


# records


def header_of(record: dict, block: int) -> bytes:
    values = {"WARC-Date": DATE} | {k: v for k, v in (record.get("headers") or {}).items() if k.lower() not in COLUMNS}
    for name, column in HEADERS.items():
        value = record.get(column)
        if value is None or column == "content_length":
            continue
        if column == "payload_digest" and re.fullmatch("[0-9a-f]{40}", value):
            value = "sha1:" + base64.b32encode(bytes.fromhex(value)).decode()
        values[name] = f"<{value}>" if column in BRACKETED else str(value)
    if record.get("record_type") == "revisit":
        values.setdefault("WARC-Profile", PROFILE)
    lines = [f"{k}: {v}".replace("\r", "%0D").replace("\n", "%0A") for k, v in values.items()]
    return ("\r\n".join(["WARC/1.1", *lines, f"Content-Length: {block}"]) + "\r\n\r\n").encode()


def parsed(header: bytes) -> dict:
    """Columns of a record header. The payload is empty until it is read."""
    record: dict = dict.fromkeys(ARROW.names) | {"headers": {}}
    lines = re.sub(r"\r?\n[ \t]+", " ", header.decode("utf-8", "replace")).splitlines()
    for line in lines[1:]:
        name, _, value = line.partition(":")
        name, value = name.strip(), value.strip()
        record["headers"].setdefault(name, value)
        column = COLUMNS.get(name.lower())
        if not column or record[column] is not None:
            continue
        if column in BRACKETED:
            value = value.removeprefix("<").removesuffix(">")
        elif column in NUMBERS:
            value = int(value) if value.isdigit() else None
        elif column == "payload_digest" and re.fullmatch("sha1:[A-Z2-7]{32}", value):
            value = base64.b32decode(value[5:]).hex()
        record[column] = value
    return record


def member(data: bytes) -> bytes:
    """A gzip member whose header tells its compressed and full length (subfield ``sl``), if four bytes can."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    total = 10 + 2 + 12 + len(body) + 8
    end = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    if max(total, len(data)) >= 1 << 32:
        return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + body + end
    extra = b"sl" + struct.pack("<HII", 8, total, len(data))
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + end


class Raw:
    """Bytes of a file that can be pushed back and skipped."""

    def __init__(self, file):
        self.file, self.held = file, b""

    def read(self, n: int) -> bytes:
        while len(self.held) < n and (more := self.file.read(max(CHUNK, n - len(self.held)))):
            self.held += more
        out, self.held = self.held[:n], self.held[n:]
        return out

    def push(self, data: bytes) -> None:
        self.held = data + self.held

    def skip(self, n: int) -> int:
        """Skips ``n`` bytes, or what there is; returns how many."""
        own = min(n, len(self.held))
        self.held = self.held[own:]
        if own == n:
            return n
        at, end = self.file.tell(), self.file.seek(0, 2)
        beyond = min(n - own, end - at)
        self.file.seek(at + beyond)
        return own + beyond


class Inflated:
    """The inflated bytes of the gzip members of a file, one after the other."""

    def __init__(self, raw: Raw):
        self.raw, self.held, self.inflate = raw, b"", None

    def more(self) -> bool:
        if self.inflate is None:
            start = self.raw.read(2)
            if not start.strip(b"\0"):  # the end, or padding
                return False
            self.raw.push(start)
            self.inflate = zlib.decompressobj(31)
        data = self.inflate.unconsumed_tail or self.raw.read(CHUNK)
        if not data:
            raise ValueError("it breaks off inside a gzip member")
        self.held += self.inflate.decompress(data, CHUNK)
        if self.inflate.eof:
            self.raw.push(self.inflate.unused_data)
            self.inflate = None
        return True

    def read(self, n: int) -> bytes:
        parts, size = [], 0
        while size < n and (self.held or self.more()):
            parts.append(self.held[: n - size])
            self.held = self.held[n - size :]
            size += len(parts[-1])
        return b"".join(parts)

    def push(self, data: bytes) -> None:
        self.held = data + self.held

    def skip(self, n: int) -> int:
        size = 0
        while size < n and (part := self.read(min(CHUNK, n - size))):
            size += len(part)
        return size

    def own_member(self) -> bytes | None:
        """The start of the member that begins here, if it states its length."""
        if self.held or self.inflate is not None:
            return None
        start = self.raw.read(24)
        if len(start) == 24 and start[:4] == b"\x1f\x8b\x08\x04" and start[10:16] == b"\x0c\0sl\x08\0":
            return start
        self.raw.push(start)
        return None


def head_of(stream) -> bytes | None:
    """The next record's header without its empty line; None at the end."""
    first = b""
    while not first.strip():  # empty lines between records
        first = stream.read(1)
        if not first:
            return None
    head = first
    while True:
        part = stream.read(1024)
        at = re.search(rb"\r?\n\r?\n", head[-3:] + part)
        if at:
            end = len(head) - len(head[-3:]) + at.end()
            whole = head + part
            stream.push(whole[end:])
            head = whole[:end].rstrip(b"\r\n")
            break
        head += part
        if not part or (len(head) > 5 and not head.startswith(b"WARC/")):
            break
    if not head.startswith(b"WARC/"):
        raise ValueError(f"no record begins with {head[:20]!r}")
    return head


def with_payload(record: dict, block: bytes) -> dict:
    if (record["content_type"] or "").replace(" ", "").lower().startswith("application/http") and (at := re.search(rb"\r?\n\r?\n", block)):
        record["http_header"], block = block[: at.start()].decode("utf-8", "replace"), block[at.end() :]
    record["payload"] = block
    return record


def records_in(file, wanted, payloads: bool) -> Iterator[dict]:
    """Records of one archive that ``wanted`` accepts by their header."""
    raw = Raw(file)
    start = raw.read(2)
    raw.push(start)
    stream = Inflated(raw) if start == b"\x1f\x8b" else raw
    while True:
        if stream is not raw and (own := stream.own_member()):
            total = struct.unpack("<I", own[16:20])[0] - 24
            inflate = zlib.decompressobj(-15)
            head, seen = b"", 0
            while b"\r\n\r\n" not in head and seen < total:
                data = inflate.unconsumed_tail or raw.read(min(CHUNK, total - seen))
                if not data:
                    break
                seen += 0 if inflate.unconsumed_tail else len(data)
                head += inflate.decompress(data, 1024)
            header, _, rest = head.partition(b"\r\n\r\n")
            record = parsed(header)
            if not wanted(record) or not payloads:
                passed = raw.skip(total - seen)
                if wanted(record):
                    yield record
            else:
                data = raw.read(total - seen)
                passed = len(data)
                block = rest + inflate.decompress(inflate.unconsumed_tail + data)
                yield with_payload(record, block[: record["content_length"]])
            if passed != total - seen:
                raise ValueError("it breaks off inside a record")
            continue
        head = head_of(stream)
        if head is None:
            return
        record = parsed(head)
        length = record["content_length"] or 0
        if not wanted(record) or not payloads:
            got = stream.skip(length)
        else:
            block = stream.read(length)
            got = len(block)
            with_payload(record, block)
        if got != length:
            raise ValueError("it breaks off inside a record")
        if wanted(record):
            yield record


# the data source

#: How pushed filters compare a header column with their value; neither is null.
COMPARE = {
    ds.EqualTo: lambda a, b: a == b, ds.EqualNullSafe: lambda a, b: a == b, ds.In: lambda a, b: a in b, ds.GreaterThan: lambda a, b: a > b, ds.GreaterThanOrEqual: lambda a, b: a >= b,
    ds.LessThan: lambda a, b: a < b, ds.LessThanOrEqual: lambda a, b: a <= b, ds.StringStartsWith: lambda a, b: a.startswith(b), ds.StringEndsWith: lambda a, b: a.endswith(b), ds.StringContains: lambda a, b: b in a,
}


@dataclass
class Files(ds.InputPartition):
    paths: tuple[str, ...]


@dataclass
class Written(ds.WriterCommitMessage):
    paths: tuple[str, ...]


class WarcReader(ds.DataSourceReader):
    def __init__(self, path: str, payloads: bool, tasks: int = 1):
        self.path, self.payloads, self.tasks, self.filters = path, payloads, tasks, []

    def pushFilters(self, filters: list) -> Iterator:  # noqa: N802  the interface's name
        for f in filters:
            told = type(f) in COMPARE and getattr(f, "value", None) is not None or isinstance(f, (ds.IsNull, ds.IsNotNull))
            if told and len(f.attribute) == 1 and f.attribute[0] in HEADERS.values():
                self.filters.append(f)
            else:
                yield f

    def wanted(self, record: dict) -> bool:
        for f in self.filters:
            value = record[f.attribute[0]]
            if isinstance(f, ds.IsNull):
                keep = value is None
            else:
                keep = value is not None and (isinstance(f, ds.IsNotNull) or COMPARE[type(f)](value, f.value))
            if not keep:
                return False
        return True

    def partitions(self) -> list[Files]:
        fs, folder = store(self.path)
        infos = fs.get_file_info([folder])
        if infos[0].type == pafs.FileType.Directory:
            infos = fs.get_file_info(pafs.FileSelector(folder, recursive=True))
            hidden = lambda p: any(x[:1] in "._" for x in p[len(folder) :].strip("/").split("/"))
            infos = [i for i in infos if i.type == pafs.FileType.File and not hidden(i.path) and i.path.lower().endswith((".warc", ".warc.gz"))]
        elif infos[0].type == pafs.FileType.NotFound:
            infos = []
        most = min(PARTITION_BYTES, sum(i.size for i in infos) // max(self.tasks, 1))
        held, size, out = [], 0, []
        for info in sorted(infos, key=lambda i: i.path):
            if held and size + info.size > most:
                out.append(Files(tuple(held)))
                held, size = [], 0
            held.append(info.path)
            size += info.size
        return out + [Files(tuple(held))]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = store(self.path)
        rows: list[dict] = []
        size = 0
        for path in partition.paths:
            with fs.open_input_file(path) as data:
                try:
                    for record in records_in(data, self.wanted, self.payloads):
                        rows.append(record)
                        size += len(record["payload"] or b"")
                        if len(rows) >= 1000 or size > 8 << 20:
                            yield self.batch(rows)
                            rows, size = [], 0
                except (ValueError, zlib.error) as e:
                    raise ValueError(f"{path}: {e}") from e
        yield self.batch(rows)

    @staticmethod
    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, schema=ARROW)


class WarcWriter(ds.DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = store(self.path)
        fs.create_dir(f"{folder}/_temporary/{self.job}")
        paths: list[str] = []
        out, size = None, 0
        for batch in iterator:
            others = [c for c in batch.schema.names if c != "payload"]
            payloads = batch["payload"] if "payload" in batch.schema.names else pa.nulls(batch.num_rows, pa.binary())
            for record, payload in zip(batch.select(others).to_pylist(), payloads, strict=True):
                if out is None or size > FILE_BYTES:
                    if out:
                        out.close()
                    paths.append(f"{folder}/_temporary/{self.job}/{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(paths[-1], compression=None), 0
                record["headers"] = dict(record.get("headers") or ())
                block = payload.as_py() or b""
                if record.get("http_header") is not None:
                    block = record["http_header"].encode() + b"\r\n\r\n" + block
                data = member(header_of(record, len(block)) + block + b"\r\n\r\n")
                out.write(data)
                size += len(data)
        if out:
            out.close()
        return Written(tuple(paths))

    def commit(self, messages: list) -> None:
        fs, folder = store(self.path)
        fs.create_dir(folder)
        for message in messages:
            for path in message.paths if message else ():
                fs.move(path, f"{folder}/{path.rsplit('/', 1)[1]}")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        """Removes the job's folder, with what failed tasks left there."""
        fs, folder = store(self.path)
        job = f"{folder}/_temporary/{self.job}"
        if fs.get_file_info([job])[0].type == pafs.FileType.Directory:
            fs.delete_dir(job)


class WarcSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() == "true", int(self.options.get("tasks", "1")))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload).lower()).option("tasks", 2 * spark.sparkContext.defaultParallelism).load(path)


def write_pages(pages: DataFrame, path: str, least: int = LEAST_REVISIT, heavy_copies: int = HEAVY_COPIES, heavy_rows: int = HEAVY_ROWS) -> None:
    """A record of each row of ``page_id, url, html``: a response, or a revisit of the largest page id with the same payload.

    Revisits come from a table of ids and digests without payloads. Rows of payloads with very many
    copies are told from responses by a broadcast of bounded size, others by an anti-join on (digest, page id),
    in which no key is hot; only rows that share a slot with a revisit are shuffled.

    A null html is an empty payload; a null page id is below all others. Rows that
    repeat both the largest id and the payload are responses all of them. Other columns are
    ignored, whatever their names. An empty table writes no file.
    """
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    folder = shared_folder(spark)
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("key", F.when(F.col("size") >= least, F.sha2("payload", 256)))
    ids = written(rows.filter("key IS NOT NULL").select("page_id", "url", "size", "key", F.sha1("payload").alias("digest")), "ids", folder)
    repeated = written(ids.groupBy("key").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL"), "repeated", folder)
    most = repeated.agg(F.max("n")).first()[0] or 0
    copies = split_join(ids, repeated.select("key", "first"), "key", "page_id", repeated.filter(F.col("n") > CROWD).select("key"), most, CROWD)
    pair = F.concat_ws("/", "key", F.coalesce(F.col("page_id").cast("string"), F.lit("none"))).alias("pair")
    revisits = written(copies.filter(~F.col("page_id").eqNullSafe(F.col("first"))).select("page_id", "url", "size", "digest", "first", "key", pair), "revisits", folder)
    heavy = repeated.filter(F.col("n") >= heavy_copies).orderBy(F.desc("n"), "key").limit(heavy_rows).select("key", F.col("first").alias("heavy_first"))
    told = rows.join(F.broadcast(heavy), "key", "left").filter("heavy_first IS NULL OR page_id <=> heavy_first").drop("heavy_first")
    light = revisits.join(F.broadcast(heavy), "key", "left_anti").select("pair")
    responses = rows_without(told.withColumn("pair", F.coalesce(pair, F.lit(""))), light, "pair")
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("none")))
    none = F.lit(None).cast("string")
    records = responses.select(urn(F.col("page_id")).alias("record_id"), F.lit("response").alias("record_type"), F.col("url").alias("target_uri"), none.alias("refers_to"), F.sha1("payload").alias("payload_digest"), F.col("size").alias("payload_length"), "payload")
    again = revisits.select(urn(F.col("page_id")), F.lit("revisit"), "url", urn(F.col("first")), "digest", "size", F.lit(None).cast("binary"))
    records.union(again).write.format("warc").mode("append").save(path)


def round_trip(pages: DataFrame, path: str | None = None, **sizes: int) -> DataFrame:
    """Writes archives of ``pages`` and reads back ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    Sizes and digests of responses are taken from the payloads that were read, those of revisits from their headers.
    """
    spark = pages.sparkSession
    path = path or f"{shared_folder(spark)}/archive"
    write_pages(pages, path, **sizes)
    response = F.col("record_type") == "response"
    page = lambda c: F.substring_index(c, ":", -1).try_cast("long")
    return read_warc(spark, path).select(
        page(F.col("record_id")).alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        page(F.col("refers_to")).alias("refers_to"),
    )
