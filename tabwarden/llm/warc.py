r"""WARC archives as a Spark data source, and pages written to them with revisits in place of repeated payloads.

`spark.read.format("warc")` plans partitions of whole files, takes predicates on the record type and on headers down to the reader,
parses a record's headers first, and inflates a payload only where the schema asks for it and the predicates let the record through.
`df.write.format("warc")` writes a gzip member for each record. A member says in a field LX of its gzip header how long it is, so the
reader steps over a record without inflating it; members of other writers, without that field, are inflated and thrown away.

Files are reached by pyarrow's file systems (local or shared paths, hdfs, s3, gs).
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, Not, StringContains,
    StringEndsWith, StringStartsWith, WriterCommitMessage,
)
from pyspark.sql.types import BinaryType, LongType, MapType, StringType, StructType

from ..functions.store import new_path, until_the_end
from .common import BROADCAST_BYTES, keep, see_package

#: Columns of a record that have names of their own, and the header of each (fixed values).
HEADERS = {
    "warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest", "content_type": "Content-Type", "profile": "WARC-Profile",
}
#: Values that are written between angle brackets.
BRACKETED = {"record_id", "refers_to"}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", content_length long, headers map<string,string>, payload binary, file string, offset long"
#: The profile of a revisit of an equal payload, and the head of an HTTP response around a payload (fixed values).
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE, HTTP_HEAD = "application/http;msgtype=response", b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
#: Bytes after which a task begins a new archive, that a partition of files has at most (but for one file), and that are read ahead.
FILE_BYTES, PARTITION_BYTES, AHEAD = 256 << 20, 128 << 20, 1 << 20
#: zlib's level, and bytes of payloads in a batch of rows.
LEVEL, BATCH_BYTES = 5, 8 << 20
#: Payloads from so many bytes on are kept once.
LEAST_BYTES = 100


def open_at(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if re.match(r"[a-zA-Z][\w+.-]*:", path) else (pafs.LocalFileSystem(), path)


class Ahead:
    """A file read by place, with what lies ahead in memory."""

    def __init__(self, file):
        self.file, self.at, self.data = file, 0, b""

    def read(self, place: int, size: int) -> bytes:
        """Bytes from a place on: `size` of them, fewer only where the file ends."""
        if not self.at <= place <= place + size <= self.at + len(self.data):
            self.file.seek(place)
            self.at, self.data = place, self.file.read(max(size, AHEAD))
        return self.data[place - self.at : place - self.at + size]


@dataclass
class Record:
    headers: dict[str, str]
    place: int
    #: Where the next record starts, if that is known without reading this one.
    after: int | None
    #: Gives the block's bytes; and where the next record starts.
    block: object


def head_of(raw: bytes, path: str, place: int) -> dict[str, str]:
    lines = raw.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError(f"no WARC record at byte {place} of {path}")
    out: dict[str, str] = {}
    last = None
    for line in lines[1:]:
        if line[:1] in (b" ", b"\t") and last:  # a value that goes on
            out[last] += " " + line.strip().decode("utf-8", "replace")
        elif b":" in line:
            name, value = line.split(b":", 1)
            last = name.strip().decode("utf-8", "replace").lower()
            out[last] = value.strip().decode("utf-8", "replace")
    return out


def records(file, path: str) -> Iterator[Record]:
    """The records of an archive, plain or of gzip members, headers parsed and blocks not yet read."""
    ahead, place = Ahead(file), 0
    while start := ahead.read(place, 4):
        record = gzip_record(ahead, path, place) if start[:2] == b"\x1f\x8b" else plain_record(ahead, path, place)
        if record is None:  # blank lines between records
            place += 1
            continue
        yield record
        place = record.after if record.after is not None else record.block()[1]


def plain_record(ahead: Ahead, path: str, place: int) -> Record | None:
    if ahead.read(place, 1) in (b"\r", b"\n"):
        return None
    size = 4096
    while (end := (raw := ahead.read(place, size)).find(b"\r\n\r\n")) < 0:
        if len(raw) < size:
            raise ValueError(f"a record at byte {place} of {path} is cut off")
        size *= 4
    headers = head_of(raw[:end], path, place)
    length = int(headers.get("content-length", 0))
    after = place + end + 4 + length + 4

    def block() -> tuple[bytes, int]:
        data = ahead.read(place + end + 4, length)
        if len(data) < length:
            raise ValueError(f"a record at byte {place} of {path} is cut off")
        return data, after

    return Record(headers, place, after, block)


def member_size(raw: bytes) -> int | None:
    """The length of a gzip member that says it in a field LX."""
    if len(raw) < 12 or not raw[3] & 4:
        return None
    at, stop = 12, 12 + struct.unpack_from("<H", raw, 10)[0]
    while at + 4 <= stop:
        name, size = raw[at : at + 2], struct.unpack_from("<H", raw, at + 2)[0]
        if name == b"LX" and size == 8:
            return struct.unpack_from("<I", raw, at + 4)[0]
        at += 4 + size
    return None


def gzip_record(ahead: Ahead, path: str, place: int) -> Record:
    size = member_size(ahead.read(place, 64))
    inflate, at, raw = zlib.decompressobj(31), place, b""

    def more(most: int) -> bytes:
        nonlocal at
        data = inflate.unconsumed_tail
        if not data:
            data = ahead.read(at, 16384 if most < 65536 else AHEAD) if size is None else ahead.read(at, min(16384 if most < 65536 else AHEAD, place + size - at))
            at += len(data)
            if not data:
                raise ValueError(f"a record at byte {place} of {path} is cut off")
        return inflate.decompress(data, most)

    while (end := raw.find(b"\r\n\r\n")) < 0 and not inflate.eof:
        raw += more(4096)
    headers = head_of(raw[:end], path, place)
    length = int(headers.get("content-length", 0))

    def block() -> tuple[bytes, int]:
        parts, have = [raw[end + 4 :]], len(raw) - end - 4
        while not inflate.eof:
            parts.append(more(1 << 20))
            have += len(parts[-1])
        data = b"".join(parts)
        if have < length:
            raise ValueError(f"a record at byte {place} of {path} is cut off")
        return data[:length], at - len(inflate.unused_data)

    return Record(headers, place, None if size is None else place + size, block)


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """What a block holds behind its HTTP head, if it has one; else the block."""
    if headers.get("content-type", "").lower().startswith("application/http"):
        return block[at + 4 :] if (at := block.find(b"\r\n\r\n")) >= 0 else b""
    return block


def value_of(headers: dict[str, str], column: str) -> str | None:
    value = headers.get(HEADERS.get(column, column).lower())
    return value.removeprefix("<").removesuffix(">") if value is not None and column in BRACKETED else value


def holds(f: Filter, headers: dict[str, str]) -> bool | None:
    """Whether a record's headers meet a predicate; None as SQL's null."""
    if isinstance(f, Not):
        said = holds(f.child, headers)
        return None if said is None else not said
    value = value_of(headers, f.attribute[0])
    if isinstance(f, IsNull):
        return value is None
    if isinstance(f, IsNotNull):
        return value is not None
    if isinstance(f, EqualNullSafe):
        return value == f.value
    if value is None:
        return None
    if isinstance(f, In):
        return True if value in f.value else None if None in f.value else False
    if isinstance(f, EqualTo):
        return value == f.value
    if isinstance(f, StringStartsWith):
        return value.startswith(f.value)
    return value.endswith(f.value) if isinstance(f, StringEndsWith) else f.value in value


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str):
        self.schema, self.path, self.filters = schema, path, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Predicates on single headers are this reader's; others go back to Spark."""
        known = (EqualTo, EqualNullSafe, In, IsNull, IsNotNull, StringStartsWith, StringEndsWith, StringContains)
        texts = {f.name for f in self.schema.fields if isinstance(f.dataType, StringType) and f.name != "file"}
        for f in filters:
            inner = f.child if isinstance(f, Not) else f
            if isinstance(inner, known) and len(inner.attribute) == 1 and inner.attribute[0] in texts:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        """Whole files, small ones together. Files and folders whose names begin with _ or . are no archives."""
        fs, at = open_at(self.path)
        info = fs.get_file_info(at)
        found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(at, recursive=True))
        hidden = lambda x: any(n[:1] in "_." for n in x.path[len(at) :].strip("/").split("/") if n)
        files = sorted((x.size, x.path) for x in found if x.type == pafs.FileType.File and not hidden(x) and re.search(r"\.warc(\.gz)?$", x.path))
        parts: list[Files] = []
        mine: list[str] = []
        size = 0
        for n, path in files:
            if mine and size + n > PARTITION_BYTES:
                parts.append(Files(tuple(mine)))
                mine, size = [], 0
            mine.append(path)
            size += n
        return [*parts, Files(tuple(mine))]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        wanted = "payload" in schema.names
        fs, _ = open_at(self.path)
        rows: list[list] = []
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(schema.types)], schema=schema)

        for path in partition.paths:
            with fs.open_input_file(path) as file:
                for record in records(file, path):
                    if not all(holds(f, record.headers) for f in self.filters):
                        continue
                    data = None
                    if wanted:
                        data, after = record.block()
                        record.after, data = after, payload_of(record.headers, data)
                        size += len(data)
                    rows.append([self.cell(f, record, data, path) for f in self.schema.fields])
                    if size > BATCH_BYTES or len(rows) >= 10_000:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()

    def cell(self, field, record: Record, payload: bytes | None, path: str):
        kind, name = field.dataType, field.name
        if name == "payload" and isinstance(kind, BinaryType):
            return payload
        if name == "headers" and isinstance(kind, MapType):
            return list(record.headers.items())
        if name == "file":
            return path
        if isinstance(kind, LongType):
            return record.place if name == "offset" else int(x) if (x := record.headers.get("content-length" if name == "content_length" else name.lower())) is not None else None
        return value_of(record.headers, name)


def clean(value: str) -> str:
    """A header's value on one line: control characters as %XX."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def member(content: bytes) -> bytes:
    """A gzip member whose header says in a field LX how long it and its content are."""
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = pack.compress(content) + pack.flush() + struct.pack("<II", zlib.crc32(content), len(content) & 0xFFFFFFFF)
    size = 10 + 2 + 12 + len(body)
    if max(size, len(content)) >= 2**32:
        return b"\x1f\x8b\x08\x00\0\0\0\0\0\xff" + body
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"LX", 8, size, len(content)) + body


def record_bytes(row: dict) -> bytes:
    """A record of the row's columns. A response's or revisit's block is an HTTP response, of which a revisit has the head only."""
    kind, payload = row.get("warc_type") or "resource", row.get("payload") or b""
    block, content = payload, row.get("content_type")
    if kind in ("response", "revisit"):
        block, content = (HTTP_HEAD % len(payload)) + (payload if kind == "response" else b""), HTTP_TYPE
    said = {**row, "warc_type": kind, "record_id": row.get("record_id") or f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, repr(sorted(row.items())))}", "content_type": content or "application/octet-stream"}
    said["date"] = said.get("date") or "1970-01-01T00:00:00Z"
    if kind == "revisit":
        said["profile"] = said.get("profile") or SAME_PAYLOAD
    lines = [b"WARC/1.1"]
    for column, value in said.items():
        if column != "payload" and value is not None:
            value = clean(str(value))
            lines.append(f"{HEADERS.get(column, column)}: {f'<{value}>' if column in BRACKETED else value}".encode())
    return b"\r\n".join([*lines, b"Content-Length: %d" % len(block), b"", block, b"", b""])


@dataclass
class Wrote(WriterCommitMessage):
    names: tuple[str, ...]


class WarcWriter(DataSourceArrowWriter):
    """Archives of a task lie in a hidden folder until all tasks are done; those of tasks that failed or ran twice never leave it."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    @property
    def hidden(self) -> str:
        return f"{open_at(self.path)[1]}/_writing-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Wrote:
        fs, _ = open_at(self.path)
        fs.create_dir(self.hidden)
        names, out, size = [], None, 0
        try:
            for batch in iterator:
                for i in range(batch.num_rows):
                    if out is None or size > FILE_BYTES:
                        if out is not None:
                            out.close()
                        names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        out, size = fs.open_output_stream(f"{self.hidden}/{names[-1]}", compression=None), 0
                        size += out.write(member(record_bytes({"warc_type": "warcinfo", "content_type": "application/warc-fields", "record_id": f"urn:uuid:{uuid.uuid4()}", "payload": b"format: WARC File Format 1.1\r\n"})))
                    row = {f.name: batch.column(j)[i].as_py() for j, f in enumerate(batch.schema)}
                    size += out.write(member(record_bytes(row)))
        finally:
            if out is not None:
                out.close()
        return Wrote(tuple(names))

    def commit(self, messages: list[Wrote | None]) -> None:
        fs, at = open_at(self.path)
        if self.overwrite:
            for x in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)):
                if x.path.rstrip("/") != self.hidden:
                    fs.delete_file(x.path) if x.type == pafs.FileType.File else fs.delete_dir(x.path)
        fs.create_dir(at)
        for m in messages:
            for name in m.names if m else ():
                fs.move(f"{self.hidden}/{name}", f"{at}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Wrote | None]) -> None:
        fs, _ = open_at(self.path)
        if fs.get_file_info(self.hidden).type == pafs.FileType.Directory:
            fs.delete_dir(self.hidden)


class WarcSource(DataSource):
    """Options: path. Reading: any of the columns of SCHEMA, and headers by their own names as string or long columns. Writing: the same, without file, offset, headers."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def use_warc(spark: SparkSession) -> None:
    """Make the format known to a session, and let predicates of Python data sources go down."""
    see_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


#: A payload that so many rows share, of all, is a hot one; there are at most 1 / HOT_SHARE of them. Parts that a hot one's rows are dealt to.
HOT_SHARE, HOT_PARTS = 0.001, 64


def with_first(rows: DataFrame, id_col: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """rows (with payload_digest and payload_bytes) with `first`: the smallest id of the rows with an equal payload, null where there is one row or it is short.

    Payloads are told by their SHA-256. Only digests are shuffled while the repeated ones are few; beyond the bound rows meet them by the
    digest, and the rows of a hot digest are dealt to HOT_PARTS parts.
    """
    spark = rows.sparkSession
    told = rows.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.min(id_col).alias("first"), F.count("*").alias("_n"))
    shared = keep(told.filter("_n > 1"), "warc-shared")
    size = shared.agg(F.count("*").alias("n"), F.sum("_n").alias("rows")).first()
    if size["n"] * 200 <= BROADCAST_BYTES:
        return rows.join(F.broadcast(shared.drop("_n")), "payload_digest", "left")
    hot = shared.withColumn("_hot", F.col("_n") > HOT_SHARE * size["rows"])
    marked = rows.join(F.broadcast(hot.filter("_hot").select("payload_digest", "_hot")), "payload_digest", "left")  # at most 1 / HOT_SHARE rows
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(id_col, "target_uri"), F.lit(HOT_PARTS))).otherwise(0).cast("int").alias("_salt")
    parts = F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(HOT_PARTS - 1))).otherwise(F.array(F.lit(0)))).alias("_salt")
    return marked.select(*rows.columns, salt).join(hot.select("payload_digest", "first", parts), ["payload_digest", "_salt"], "left").drop("_salt")


def archive_pages(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least_bytes: int = LEAST_BYTES) -> None:
    """Write a record for each page: its text in UTF-8 as the payload of a response, or a revisit of the page with the smallest id that has the same payload.

    A null text is an empty payload; payloads under `least_bytes` are always responses. A record's id is urn:page: and the page's id, `null` for none.
    Rows that share the smallest id of a payload are responses all; a row without an id is one only where no equal row has an id. A null
    url has no header; control characters in one are written as %XX. Other columns are ignored; an empty table makes no archive.
    """
    use_warc(pages.sparkSession)
    payload = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.col("payload_bytes") >= least_bytes)
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("null")))
    with_first(rows, "page_id", least_bytes).select(
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("warc_type"), name(F.col("page_id")).alias("record_id"), "target_uri",
        F.when(again, name(F.col("first"))).alias("refers_to"), F.concat(F.lit("sha256:"), "payload_digest").alias("payload_digest"),
        F.col("payload_bytes").alias("WARC-Payload-Length"), F.when(~again, F.col("payload")).alias("payload"),
    ).write.format("warc").mode("append").save(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) from archives of pages.

    Responses are read with their payloads, whose length and digest are taken anew and held against the headers; a difference is an
    error. Revisits have no payload, so of them only headers are read.
    """
    use_warc(spark)
    number = lambda c: F.when(F.col(c) != "urn:page:null", F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).cast("long"))
    read = lambda schema: spark.read.format("warc").schema(schema).load(path)
    whole = read("warc_type string, record_id string, payload_digest string, payload binary").filter("warc_type = 'response'")
    found = F.sha2("payload", 256)
    digest = F.when(F.concat(F.lit("sha256:"), found) == F.col("payload_digest"), found).otherwise(F.raise_error(F.concat(F.lit("payload of another digest in record "), "record_id")).cast("string"))
    responses = whole.select(
        number("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), digest.alias("payload_digest"),
        F.col("warc_type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"),
    )
    again = read("warc_type string, record_id string, refers_to string, payload_digest string, `WARC-Payload-Length` long").filter("warc_type = 'revisit'")
    return responses.unionByName(again.select(
        number("record_id").alias("page_id"), F.col("WARC-Payload-Length").alias("payload_bytes"), F.substring_index("payload_digest", ":", -1).alias("payload_digest"),
        F.col("warc_type").alias("record_type"), number("refers_to").alias("refers_to"),
    ))


def op13_warc(spark, sf_dir: str) -> DataFrame:
    from .common import table

    path = new_path(spark, "pages", "warc")
    archive_pages(table(spark, sf_dir, "pages"), path)
    return read_pages(spark, until_the_end(spark, path))


OP13_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, sha256(html) AS payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
