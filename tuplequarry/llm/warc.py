"""WARC files as a PySpark data source: records are written and read by Python data source tasks.

Reading: the driver lists the committed files and plans partitions of whole files of about ``PART`` bytes. A task reads a
record's header block first. Predicates on the record type and on headers are taken over from Spark (``pushFilters``)
and decided on the header; what they reject is skipped without decoding its payload: files of this writer carry each
record's compressed size in the gzip member's extra field (subfield ``WS``), so a skipped record costs a seek. Files of
other writers, compressed or not, are read too; there a skipped gzip member is inflated into nothing and a skipped plain
record is seeked over. ``payload=false`` leaves out all payloads; ``payload=digest`` reads them, and gives their size and
digest (``seen_bytes``, ``seen_digest``) in place of their bytes.

Writing: a task writes files of about ``ROLL`` bytes under names of its own; on commit the driver writes the list of
files that count, so files of failed or repeated tasks are never read. Files may lie in any store that pyarrow opens.

Edge cases: null payloads are empty; null headers are left out; header values keep any text but line ends, which become
spaces; an empty table makes an archive without records; a truncated last record ends its file.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage

from .common import fresh_path

PART, ROLL, ROWS = 32 << 20, 32 << 20, 512
COMMITTED = "_files.json"
# Columns, and the named header fields that they are (fixed values of the format).
FIELDS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "date": "WARC-Date",
    "target_uri": "WARC-Target-URI",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "content_type": "Content-Type",
    "page_id": "X-Page-Id",
    "payload_size": "X-Payload-Length",
    "refers_to_page": "X-Refers-To-Page-Id",
}
SCHEMA = ", ".join(f"{x} string" for x in FIELDS) + ", payload binary, seen_bytes long, seen_digest string"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(record: bytes) -> bytes:
    """One gzip member, its whole size in the extra field's subfield WS."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(record) + z.flush()
    size = 10 + 2 + 8 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + (8).to_bytes(2, "little") + b"WS" + (4).to_bytes(2, "little") + size.to_bytes(4, "little")
    return head + body + zlib.crc32(record).to_bytes(4, "little") + (len(record) & 0xFFFFFFFF).to_bytes(4, "little")


def record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {' '.join(v.splitlines()) if v else ''}" for k, v in fields if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Source:
    """Buffered reads of one file, with seeks."""

    def __init__(self, file):
        self.file, self.buffer, self.at = file, b"", 0

    def need(self, n: int) -> bytes:
        """At least n bytes ahead, or all there are."""
        if len(self.buffer) - self.at < n:
            self.buffer = self.buffer[self.at :] + self.file.read(max(n, 1 << 18))
            self.at = 0
        return memoryview(self.buffer)[self.at :]

    def skip(self, n: int) -> None:
        have = len(self.buffer) - self.at
        if n <= have:
            self.at += n
        else:
            self.file.seek(n - have, 1)
            self.buffer, self.at = b"", 0


def _header(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        k, sep, v = line.partition(":")
        if sep:
            out[k.strip().lower()] = v.strip()
    return out


def read_records(file, want) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(header, block) of the records that want(header) accepts: it returns None to skip, else whether to decode."""
    src = _Source(file)
    while True:
        ahead = bytes(src.need(20)[:20])
        if len(ahead) < 10:
            return
        if ahead[:2] == b"\x1f\x8b":
            size = int.from_bytes(ahead[16:20], "little") if ahead[3] == 4 and ahead[12:14] == b"WS" else None
            if size and len(src.need(size)) < size:
                return
            z, out, used = zlib.decompressobj(31), b"", 0
            chunk = 2048  # header first: only as much is inflated as it takes
            while b"\r\n\r\n" not in out and not z.eof:
                data = bytes(src.need(used + chunk)[used : used + chunk])
                if not data:
                    return
                out += z.decompress(data)
                used += len(data)
                chunk = min(chunk * 2, 1 << 20)
            head, _, block = out.partition(b"\r\n\r\n")
            fields = _header(head)
            wanted = want(fields)
            if wanted or not size:
                parts = [block]
                while not z.eof:
                    data = bytes(src.need(used + (1 << 16))[used : used + (1 << 16)])
                    if not data:
                        return
                    x = z.decompress(data)
                    used += len(data)
                    if wanted:
                        parts.append(x)
                used -= len(z.unused_data)
                block = b"".join(parts)[: int(fields.get("content-length", 0))]
            src.skip(size or used)
        else:
            n = 4096
            while (end := bytes(src.need(n)).find(b"\r\n\r\n")) < 0:
                if len(src.need(n)) < n:
                    return
                n *= 2
            fields = _header(bytes(src.need(end)[:end]))
            src.skip(end + 4)
            length = int(fields.get("content-length", 0))
            wanted = want(fields)
            if wanted:
                block = bytes(src.need(length)[:length])
            src.skip(length + 4)
        if wanted is not None:
            yield fields, block if wanted else None


@dataclass
class _Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload = options["path"], str(options.get("payload", "true")).lower()
        self.part = int(options.get("partBytes", PART))
        self.only: list[tuple[str, tuple]] = []

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo | EqualNullSafe) and f.attribute[0] in FIELDS and f.value is not None:
                self.only.append((FIELDS[f.attribute[0]].lower(), (f.value,)))
            elif isinstance(f, In) and f.attribute[0] in FIELDS:
                self.only.append((FIELDS[f.attribute[0]].lower(), tuple(f.value)))
            elif isinstance(f, IsNotNull) and f.attribute[0] in FIELDS:
                self.only.append((FIELDS[f.attribute[0]].lower(), ()))
            else:
                yield f

    def partitions(self):
        fs, path = _open(self.path)
        if fs.get_file_info(path).type == pafs.FileType.File:
            return [_Files([path])]
        if fs.get_file_info(f"{path}/{COMMITTED}").type == pafs.FileType.File:
            with fs.open_input_stream(f"{path}/{COMMITTED}") as f:
                files = [(f"{path}/{x['name']}", x["size"]) for x in json.loads(f.read())]
        else:
            found = fs.get_file_info(pafs.FileSelector(path, recursive=True))
            files = [(x.path, x.size) for x in found if x.type == pafs.FileType.File and x.path.endswith((".warc", ".warc.gz"))]
        parts: list[_Files] = []
        room = 0
        for name, size in sorted(files):
            if not parts or size > room:
                parts.append(_Files([]))
                room = self.part
            parts[-1].paths.append(name)
            room -= size
        return parts or [_Files([])]

    def read(self, partition):
        fs, _ = _open(self.path)
        payload, only = self.payload != "false", self.only

        def want(fields: dict[str, str]) -> bool | None:
            for name, values in only:
                v = fields.get(name)
                if v is None or (values and v not in values):
                    return None
            return payload

        names = [*FIELDS, "payload", "seen_bytes", "seen_digest"]
        kinds = [*[pa.string()] * len(FIELDS), pa.binary(), pa.int64(), pa.string()]
        whole = self.payload == "true"
        rows: list[tuple] = []
        size = 0

        def batch():
            cols = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

        for path in partition.paths:
            with fs.open_input_file(path) as file:
                for fields, block in read_records(file, want):
                    seen = (None, None) if block is None else (len(block), digest_of(block))
                    rows.append((*(fields.get(x.lower()) for x in FIELDS.values()), block if whole else None, *seen))
                    size += len(block or b"") if whole else 0
                    if len(rows) >= ROWS or size > 8 << 20:
                        yield batch()
                        size = 0
        if rows:
            yield batch()


@dataclass
class _Written(WriterCommitMessage):
    files: list[dict]


class WarcWriter(DataSourceArrowWriter):
    """Rows with columns of SCHEMA, payload first of all; size and digest are the writer's. A revisit is written with both,
    but without its payload."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator):
        fs, path = _open(self.path)
        fs.create_dir(path, recursive=True)
        files: list[dict] = []
        out = None
        try:
            for b in iterator:
                cols = {n: b.column(n).to_pylist() for n in b.schema.names}
                for k in range(b.num_rows):
                    row = {n: c[k] for n, c in cols.items()}
                    payload = row.get("payload") or b""
                    kind = row.get("record_type") or "response"
                    row["payload_size"], row["payload_digest"] = str(len(payload)), f"sha1:{digest_of(payload)}"
                    fields = [(h, row.get(n)) for n, h in FIELDS.items()]
                    if kind == "revisit":
                        fields.append(("WARC-Profile", REVISIT))
                        payload = b""
                    data = member(record(fields, payload))
                    if out is None or files[-1]["size"] > ROLL:
                        if out:
                            out.close()
                        files.append({"name": f"part-{uuid.uuid4().hex}.warc.gz", "size": 0})
                        out = fs.open_output_stream(f"{path}/{files[-1]['name']}", compression=None)
                    out.write(data)
                    files[-1]["size"] += len(data)
        finally:
            if out:
                out.close()
        return _Written(files)

    def commit(self, messages):
        fs, path = _open(self.path)
        fs.create_dir(path, recursive=True)
        files = [f for m in messages if m for f in m.files]
        with fs.open_output_stream(f"{path}/{COMMITTED}", compression=None) as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages):
        fs, path = _open(self.path)
        for m in messages:
            for f in m.files if m else ():
                fs.delete_file(f"{path}/{f['name']}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def with_revisits(records: DataFrame, least: int = 0) -> DataFrame:
    """Adds record_type and refers_to to records (page_id, payload, ...): of equal payloads of at least ``least`` bytes
    the smallest page_id is the response, others revisit it. Equality is that of SHA-256 and size.

    Only digests that occur more than once are joined back: that list is broadcast if Spark finds it small, and otherwise
    the join is one whose skewed partitions are split."""
    size, key = F.octet_length("payload"), F.sha2("payload", 256)
    first = records.where(size >= least).groupBy(key.alias("digest")).agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    # Rows that repeat the smallest page_id are responses too: nothing tells them apart.
    first = first.where("n > 1").drop("n")
    out = records.withColumn("digest", F.when(size >= least, key)).join(first, "digest", "left").drop("digest")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return out.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("first"))).drop("first")


def record_uri(page_id: Column) -> Column:
    """A record id that follows from the page's id."""
    h = F.md5(F.concat(F.lit("page:"), page_id.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def write_pages(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes a response or revisit record for each page."""
    register(pages.sparkSession)
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("target_uri"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"))
    p = with_revisits(p, least)
    text = lambda c: F.col(c).cast("string")
    rows = p.select(
        "record_type",
        record_uri(F.col("page_id")).alias("record_id"),
        F.lit(date).alias("date"),
        "target_uri",
        F.when(F.col("refers_to").isNotNull(), record_uri(F.col("refers_to"))).alias("refers_to"),
        F.lit("text/html").alias("content_type"),
        text("page_id").alias("page_id"),
        text("refers_to").alias("refers_to_page"),
        "payload",
    )
    rows.write.format("warc").option("path", path).mode("append").save()


def archive_round_trip(pages: DataFrame, path: str | None = None, id_col: str = "page_id", **options) -> DataFrame:
    """Writes the pages and reads the archive: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Of responses, size and digest are those of the payload that was read; of revisits, those that their headers give,
    and they are read without payload."""
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    write_pages(pages, path, id_col, **options)
    kind = pages.schema[id_col].dataType
    read = lambda payload: spark.read.format("warc").option("path", path).option("payload", payload).load()
    page = F.col("page_id").cast(kind).alias(id_col)
    whole = read("digest").where("record_type = 'response'").select(page, F.col("seen_bytes").alias("payload_bytes"), F.col("seen_digest").alias("payload_digest"), "record_type", F.lit(None).cast(kind).alias("refers_to"))
    bare = read("false").where("record_type = 'revisit'").select(page, F.col("payload_size").cast("long").alias("payload_bytes"), F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "record_type", F.col("refers_to_page").cast(kind).alias("refers_to"))
    return whole.union(bare)
