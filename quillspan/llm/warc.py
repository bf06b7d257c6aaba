"""WARC archives as a PySpark Python data source: ``warc``, for reading and writing.

Reading plans one partition for each pack of files, and several for a large compressed file, cut at members: a
partition has the members that start in its range of bytes. As a rule every record is a gzip member of its own (or stands
uncompressed); a member with several records is read to its end. A record's headers are parsed first, the pushed
predicates on header columns are asked, and the payload of a record that is not wanted is neither inflated nor decoded: the
reader seeks past it by the member's length, which the writer keeps in the gzip header's ``sl`` extra field, and
inflates to find the end only in archives that lack it. Options: ``payload`` = ``all`` (the default) or ``none``;
``packBytes``, the size to which small files are packed and large ones cut; ``damaged`` = ``raise`` (the default) or ``report``.

An archive that is cut off, or has bytes that are no record, fails with its path and offset. With ``report`` such a
place is a row of record_type ``damaged`` (target_uri the file, payload_bytes the offset), and reading goes on at the
next member. Blank lines between members are passed over.

Pushed predicates: =, IN, IS [NOT] NULL and STARTSWITH on the header columns; others stay with Spark.

Writing: each task writes one file under a hidden name and the commit gives it its final name, so a
retried or lost task leaves nothing visible. Files are opened through pyarrow's file systems, by URI.

Query rules (records of equal payloads): see ``archive_pages``. Defined results: a null html is an empty
payload; a null url or page_id stays null; payloads under ``least_bytes`` are all responses; of rows that
repeat the largest page_id of their payload all are responses; an empty table gives an empty archive and
result; extra columns are ignored.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, IsNotNull, IsNull, StringStartsWith, WriterCommitMessage

from .common import BROADCAST_ROWS, fresh_path, read, settle

SCHEMA = "record_type string, record_id string, target_uri string, date string, payload_digest string, refers_to string, payload_bytes long, payload binary"
#: Fixed WARC header names of the columns.
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"


def file_system(path: str):
    """(file system, path on it) of a URI or a local path."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def record_bytes(row: dict) -> bytes:
    """One record: WARC headers, then an HTTP message whose body is the payload (none in a revisit)."""
    payload = row["payload"] if row["payload"] is not None else b""
    body = b"" if row["record_type"] == "revisit" else bytes(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    lines = ["WARC/1.1"] + [f"{name}: {_clean(row[c])}" for c, name in HEADERS.items() if row[c] is not None]
    lines += [f"WARC-Profile: {REVISIT_PROFILE}"] if row["record_type"] == "revisit" else []
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(body)}"]
    return "\r\n".join(lines).encode() + _END + http + body + _END


def _clean(value: str) -> str:
    """A header value on one line."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def member(raw: bytes, level: int = 1) -> bytes:
    """A gzip member whose header tells its own length: extra field sl, compressed and full size."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    data = z.compress(raw) + z.flush()
    size = 10 + 2 + 12 + len(data) + 8
    extra = b"sl" + struct.pack("<HII", 8, size, len(raw) & 0xFFFFFFFF) if size < 2**32 else b"sx" + struct.pack("<HII", 8, 0, 0)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + extra + data + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


class Damaged(ValueError):
    """What is wrong with an archive at some place."""


@dataclass
class Files(InputPartition):
    """The files, or the ranges of files, that one task reads."""

    ranges: list[tuple[str, int, int]] = field(default_factory=list)


@dataclass
class Written(WriterCommitMessage):
    """A task's file, before and after its final name."""

    hidden: str
    final: str


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


class WarcWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.job = uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz"
        fs, base = file_system(self.path)
        fs.create_dir(base, recursive=True)
        with fs.open_output_stream(f"{base}/_{self.job}-{name}", compression=None) as out:
            for row in rows:
                out.write(member(record_bytes(row.asDict())))
        return Written(f"{base}/_{self.job}-{name}", f"{base}/{name}")

    def commit(self, messages: list) -> None:
        fs, _ = file_system(self.path)
        for m in messages:
            if m is not None:
                fs.move(m.hidden, m.final)
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        """Delete what this job's failed or repeated attempts left under hidden names."""
        from pyarrow import fs as pafs

        fs, base = file_system(self.path)
        for x in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
            if x.base_name.startswith(f"_{self.job}-"):
                fs.delete_file(x.path)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.with_payload = options.get("payload", "all") != "none"
        self.pack_bytes = int(options.get("packbytes", options.get("packBytes", 32 << 20)))
        self.report = options.get("damaged", "raise") == "report"
        self.wanted: list[tuple] = []

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if column in HEADERS and isinstance(f, EqualTo):
                self.wanted.append((column, "in", (f.value,)))
            elif column in HEADERS and isinstance(f, In):
                self.wanted.append((column, "in", tuple(f.value)))
            elif column in HEADERS and isinstance(f, StringStartsWith):
                self.wanted.append((column, "starts", f.value))
            elif column in HEADERS and isinstance(f, (IsNull, IsNotNull)):
                self.wanted.append((column, "null" if isinstance(f, IsNull) else "some", None))
            else:
                yield f

    def partitions(self) -> list[Files]:
        from pyarrow import fs as pafs

        fs, base = file_system(self.path)
        found = [x for x in fs.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True)) if x.is_file and not x.base_name.startswith(("_", "."))]
        packs, size = [Files()], 0
        for x in sorted(found, key=lambda x: x.path):
            if x.size > self.pack_bytes and _compressed(fs, x.path):
                cuts = [*range(0, x.size, self.pack_bytes), x.size]
                packs += [Files([(x.path, a, b)]) for a, b in zip(cuts, cuts[1:])] + [Files()]
                size = 0
                continue
            if packs[-1].ranges and size + x.size > self.pack_bytes:
                packs.append(Files())
                size = 0
            packs[-1].ranges.append((x.path, 0, x.size))
            size += x.size
        return [p for p in packs if p.ranges] or packs[:1]

    def _wants(self, head: dict) -> bool:
        for column, test, value in self.wanted:
            x = head.get(column)
            if not {"in": lambda: x in value, "starts": lambda: x is not None and x.startswith(value), "null": lambda: x is None, "some": lambda: x is not None}[test]():
                return False
        return True

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.path)
        rows, held = [], 0
        for path, start, stop in partition.ranges:
            with fs.open_input_file(path) as f:
                for row in self._records(f, path, start, stop):
                    rows.append(row)
                    held += len(row["payload"] or b"")
                    if held > 8 << 20 or len(rows) >= 4096:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _records(self, f, path: str, start: int, stop: int) -> Iterator[dict]:
        """The records of the members that start in a range."""
        size = f.size()
        at = start if start == 0 else _next_member(f, start, stop)
        while at is not None and at < min(stop, size):
            f.seek(at)
            first = f.read(64)
            blank = len(first) - len(first.lstrip(b"\r\n"))
            if blank:
                at += blank
                continue
            try:
                if not first.startswith((_GZIP, b"WARC/")):
                    raise Damaged("no record starts here")
                source = _Member(f, at) if first.startswith(_GZIP) else _Plain(f, at)
                yield from self._of(source)
                at = source.end()
            except (Damaged, zlib.error) as why:
                if not self.report:
                    raise Damaged(f"{path}: {why}, at byte {at}") from why
                row = dict.fromkeys(HEADERS) | {"record_type": "damaged", "target_uri": path, "payload_bytes": at, "payload": None}
                if self._wants(row):
                    yield row
                at = _next_member(f, at + 1, size)

    def _of(self, source: _Plain) -> Iterator[dict]:
        """The wanted records of a member, or the one at a plain offset."""
        while True:
            block = source.until(_END)
            if block is None or not block.startswith(b"WARC/"):
                raise Damaged("a record's headers have no end" if block is None else "no record's headers")
            head = _parse(block)
            if not (head.get("content-length") or "").isdigit():
                raise Damaged("a record without its length")
            length = int(head.pop("content-length"))
            kind = head.pop("content-type", None) or ""
            read, row = 0, None
            if self._wants(head):
                told = []
                if kind.lower().startswith("application/http"):  # other blocks are the payload as they stand
                    http = source.until(_END)
                    read = len(http or b"") + len(_END)
                    if http is None or read > length:
                        raise Damaged("an HTTP message whose headers have no end")
                    told = [x.split(b":", 1)[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
                body, size = None, length - read
                if self.with_payload and head["record_type"] != "revisit":
                    body = source.take(size)
                    if len(body) < size:
                        raise Damaged("a record is cut off")
                    read = length
                row = head | {"payload_bytes": int(told[0]) if told and told[0].strip().isdigit() else size, "payload": body}
            more = source.leave(len(block) + len(_END) + length, length - read)
            if row is not None:
                yield row
            if not more:
                return


_GZIP = b"\x1f\x8b"


def _compressed(fs, path: str) -> bool:
    with fs.open_input_file(path) as f:
        return f.read(2) == _GZIP


def _next_member(f, at: int, stop: int, chunk: int = 1 << 16) -> int | None:
    """The first offset from at, before stop, at which a gzip member or a plain record starts."""
    size = f.size()
    while at < stop:
        f.seek(at)
        data = f.read(chunk + 64)
        marks = [at + m.start() for m in re.finditer(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n[A-Za-z]", data)]
        for k in marks:
            if at <= k < min(at + chunk, stop):
                f.seek(k)
                head = f.read(4096)
                try:
                    if head.startswith(b"WARC/1") or zlib.decompressobj(31).decompress(head, 64).startswith(b"WARC/"):
                        return k
                except zlib.error:
                    pass
        at += chunk
        if at >= size:
            break
    return None


def _parse(block: bytes) -> dict:
    found = dict.fromkeys(HEADERS)
    names = {v.lower(): k for k, v in HEADERS.items()}
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        name = name.strip().lower()
        if name in names:
            found[names[name]] = value.strip()
        elif name in ("content-length", "content-type"):
            found[name] = value.strip()
    return found


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names=names)


class _Plain:
    """An uncompressed record at an offset."""

    def __init__(self, f, at: int):
        self.f, self.at, self.after = f, at, at
        f.seek(at)
        self.held = b""

    def _more(self) -> bool:
        chunk = self.f.read(4096)
        self.held += chunk
        return bool(chunk)

    def until(self, mark: bytes) -> bytes | None:
        """What stands before the mark, reading no further than needed."""
        seen = 0
        while (k := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark) + 1)
            if not self._more():
                return None
        out, self.held = self.held[:k], self.held[k + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        parts, left = [], n
        while left and (self.held or self._more()):
            parts.append(self.held[:left])
            self.held = self.held[left:]
            left -= len(parts[-1])
        return b"".join(parts)

    def leave(self, length: int, unread: int) -> bool:
        """Go past a record of a length of which some is unread; whether more records follow in the same member."""
        self.after += length + len(_END)
        if self.at + length > self.f.size():
            raise Damaged("a record is cut off")
        return False

    def end(self) -> int:
        return self.after


class _Member(_Plain):
    """A gzip member at an offset, inflated as far as it is asked for."""

    def __init__(self, f, at: int):
        super().__init__(f, at)
        self.length = self.full = None
        head = f.read(12)
        if len(head) == 12 and head[3] & 4:
            extra = f.read(struct.unpack("<H", head[10:12])[0])
            if extra[:2] == b"sl" and len(extra) >= 12:
                self.length, self.full = struct.unpack("<II", extra[4:12])
        if self.length and at + self.length > f.size():
            raise Damaged("a member is cut off")
        f.seek(at)
        self.z = zlib.decompressobj(31)
        self.fed = self.passed = 0
        self.rest = b""

    def _more(self) -> bool:
        if self.z.eof:
            return False
        data = self.rest or self.f.read(16384)
        if not data:
            raise Damaged("a member is cut off")
        self.fed += 0 if self.rest else len(data)
        self.held += self.z.decompress(data, 65536)
        self.rest = self.z.unconsumed_tail
        return True

    def leave(self, length: int, unread: int) -> bool:
        self.passed += length + len(_END)
        if self.full is not None and self.passed & 0xFFFFFFFF == self.full:
            return False  # the member's only or last record: what is unread of it stays compressed
        left = unread + len(_END)
        while left and (self.held or self._more()):
            gone = min(left, len(self.held))
            self.held, left = self.held[gone:], left - gone
        if left > len(_END):
            raise Damaged("a record is cut off")
        while not self.held.lstrip(b"\r\n"):
            self.held = b""
            if not self._more():
                return False
        self.held = self.held.lstrip(b"\r\n")
        return True

    def end(self) -> int:
        if self.length:
            return self.at + self.length
        while self._more():
            self.held = b""
        return self.at + self.fed - len(self.z.unused_data)


def write_warc(records: DataFrame, path: str) -> None:
    """Append records (the columns of SCHEMA) as archives under path."""
    records.sparkSession.dataSource.register(WarcDataSource)
    records.select(*[x.split()[0] for x in SCHEMA.split(", ")]).write.format("warc").mode("append").save(path)


def read_warc(spark: SparkSession, path: str, payload: str = "all", **options: str) -> DataFrame:
    """The records under path; filters on header columns are pushed into the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").option("payload", payload).options(**options).load(path)


def archive_pages(pages: DataFrame, least_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Records of pages (page_id, url, html): of equal payloads of least_bytes or more the one with the largest
    page_id is a response and the others revisit it; smaller ones are all responses."""
    raw = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    p = pages.select("page_id", "url", raw.alias("payload")).withColumn("digest", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    # Only digests of several pages matter; payloads are not shuffled by them.
    groups = p.where(F.col("payload_bytes") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("c")).where("c > 1")
    groups = settle(groups.select("digest", "first_id"), "digests")
    if groups.count() <= BROADCAST_ROWS:
        p = p.join(F.broadcast(groups), "digest", "left")
    else:
        # Narrow rows meet the digests, and pages their own row, by page: no key is shared by many of them.
        marks = p.select("page_id", "digest").join(groups, "digest").distinct().withColumnsRenamed({"page_id": "_page", "digest": "_digest"})
        p = p.join(marks, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left").drop("_page", "_digest")
    again = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    return p.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        urn(F.col("page_id")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        F.concat(F.lit("sha1:"), "digest").alias("payload_digest"),
        F.when(again, urn(F.col("first_id"))).alias("refers_to"),
        "payload_bytes",
        F.when(~again, F.col("payload")).alias("payload"),
    )


def page_of(urn: str) -> Column:
    """The page_id in a record id of archive_pages; null where there is none."""
    return F.nullif(F.regexp_extract(urn, r"^<urn:page:(-?\d*)>$", 1), F.lit("")).cast("long")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of an archive of pages.

    Responses are read with their payloads, which are digested again. Revisits are read for their headers alone: the
    reader passes over every response without inflating it."""
    full = read_warc(spark, path).where("record_type = 'response'")
    again = read_warc(spark, path, "none").where("record_type = 'revisit'")
    head = lambda df, size, digest: df.select(page_of("record_id").alias("page_id"), size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", page_of("refers_to").alias("refers_to"))
    full = head(full, F.octet_length("payload").cast("long"), F.sha1("payload"))
    return full.unionByName(head(again, F.col("payload_bytes"), F.regexp_replace("payload_digest", "^sha1:", "")))


def op8(spark, sf_dir) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_warc(archive_pages(read(spark, sf_dir, "pages").select("page_id", "url", "html")), path)
    return digests(spark, path)


ORACLE_SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS first_id FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN first_id <> page_id THEN first_id END AS refers_to FROM p LEFT JOIN g USING (payload_digest)"""
