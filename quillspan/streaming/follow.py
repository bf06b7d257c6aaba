"""Growing transcript files as a stream of lines: the Python data source ``growing_lines``.

A place in the stream is the number of a plan. Plans are small files in a journal folder: plan n says which bytes of
which generation of which file its batch adds. So an offset is one number however many files there are, and a plan is
written before Spark hears of it: a stream that starts again goes on behind the last plan, and what Spark had not
finished is read again from the same plans. Every some plans the positions of all files are written whole, and what Spark has
committed before them is deleted.

A line belongs to the plan that has its line break. What stands after a file's last break is therefore left for the
plan that brings the break; the task that reads it looks back for the line's start. Ranges are cut into partitions of
``partitionBytes`` by the same rule, so that one large file is read by many tasks and no byte passes the driver but
the first HEAD of a changed file.

A file that got shorter, or whose first bytes changed, has begun a new generation, which is read from its start;
rows carry the generation, and a reader of the rows takes the newest of each file.

Options: ``path``, ``journal`` (a folder of this query alone, shared like the checkpoint), ``maxBytes`` and ``maxRecords``
a batch (0: all there is; records are counted on the driver within the admitted bytes), ``partitionBytes``,
``maxRecordBytes`` (a longer line has a null value), ``suffix``. Files are opened through pyarrow's file systems, by URI.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from quillspan.functions.workers import ship

SCHEMA = "source_id string, generation int, offset long, length long, value string"
HEAD = 1024
#: Plans between two writings of all positions.
EVERY = 32
_BLOCK = 1 << 16


def file_system(path: str):
    """(file system, path on it) of a URI or a local path."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Stretch(InputPartition):
    """Bytes of a file whose line breaks are read by one task."""

    path: str
    generation: int
    start: int
    stop: int


class Journal:
    """Numbered plans and now and then all positions, as JSON files in a folder."""

    def __init__(self, folder: str):
        self.fs, self.folder = file_system(folder.rstrip("/"))
        self.fs.create_dir(self.folder, recursive=True)

    def _numbers(self, kind: str) -> list[int]:
        from pyarrow import fs as pafs

        names = [x.base_name for x in self.fs.get_file_info(pafs.FileSelector(self.folder)) if x.is_file]
        return sorted(int(n.split("-")[1].split(".")[0]) for n in names if n.startswith(f"{kind}-") and n.endswith(".json"))

    def _path(self, kind: str, number: int) -> str:
        return f"{self.folder}/{kind}-{number:012d}.json"

    def write(self, kind: str, number: int, value) -> None:
        with self.fs.open_output_stream(self._path(kind, number) + ".tmp") as out:
            out.write(json.dumps(value).encode())
        self.fs.move(self._path(kind, number) + ".tmp", self._path(kind, number))

    def read(self, kind: str, number: int):
        with self.fs.open_input_stream(self._path(kind, number)) as f:
            return json.loads(f.read())

    def restore(self) -> tuple[int, dict]:
        """The last plan's number, and what is known of each file: [generation, position, size of its head, digest of its head]."""
        wholes, plans = self._numbers("all"), self._numbers("plan")
        last = wholes[-1] if wholes else 0
        known = self.read("all", last) if wholes else {}
        for n in plans:
            if n > last:
                known.update({path: [generation, stop, *head] for path, generation, _, stop, head in self.read("plan", n)})
        return max([last, *plans]), known

    def forget(self, committed: int) -> None:
        """Delete what no start at or behind a committed plan needs."""
        wholes = [n for n in self._numbers("all") if n <= committed]
        if wholes:
            for kind in ("all", "plan"):
                for n in self._numbers(kind):
                    if n < wholes[-1] or kind == "plan" and n == wholes[-1]:
                        self.fs.delete_file(self._path(kind, n))


class GrowingLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingLinesReader:
        return GrowingLinesReader(self.options)


class GrowingLinesReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        number = lambda name, default: int(options.get(name, options.get(name.lower(), default)))
        self.path, self.folder, self.suffix = options["path"], options["journal"], options.get("suffix", ".jsonl")
        self.max_bytes, self.max_records = number("maxBytes", 1 << 30), number("maxRecords", 0)
        self.part_bytes, self.record_bytes = number("partitionBytes", 32 << 20), number("maxRecordBytes", 16 << 20)
        self.journal: Journal | None = None

    def _open(self) -> Journal:
        """The journal, and what it knows, at the first use in this process."""
        if self.journal is None:
            self.journal = Journal(self.folder)
            self.number, self.known = self.journal.restore()
            self.seen: dict[str, tuple] = {}
        return self.journal

    def initialOffset(self) -> dict:
        return {"plan": 0}

    def _head(self, fs, path: str, size: int) -> list:
        with fs.open_input_file(path) as f:
            return [size, hashlib.sha256(f.read(size)).hexdigest()]

    def _changed(self) -> Iterator[list]:
        """(path, generation, from, to, head) of the files that have bytes no plan has, in the order of their names."""
        from pyarrow import fs as pafs

        fs, base = file_system(self.path)
        found = fs.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True))
        for x in sorted((x for x in found if x.is_file and x.base_name.endswith(self.suffix)), key=lambda x: x.path):
            if self.seen.get(x.path) == (x.size, x.mtime_ns):
                continue
            generation, at, head_size, digest = self.known.get(x.path, [0, 0, 0, ""])
            if at and (x.size < at or self._head(fs, x.path, head_size)[1] != digest):
                generation, at, head_size = generation + 1, 0, 0
            if x.size > at:
                head = [head_size, digest] if head_size else self._head(fs, x.path, min(x.size, HEAD))
                yield [x.path, generation, at, x.size, head]
            if x.size == at:
                self.seen[x.path] = (x.size, x.mtime_ns)

    def latestOffset(self) -> dict:
        journal = self._open()
        plan, left, records = [], self.max_bytes or 1 << 62, self.max_records
        for path, generation, start, size, head in self._changed():
            stop = min(size, start + left)
            if self.max_records:
                stop, found = self._bounded(path, start, stop, records)
                records -= found
            if stop > start:
                plan.append([path, generation, start, stop, head])
                left -= stop - start
            if left <= 0 or self.max_records and records <= 0:
                break
        if plan:
            self.number += 1
            self.known.update({path: [generation, stop, *head] for path, generation, _, stop, head in plan})
            journal.write("plan", self.number, plan)
            if self.number % EVERY == 0:
                journal.write("all", self.number, self.known)
        return {"plan": self.number}

    def _bounded(self, path: str, start: int, stop: int, records: int) -> tuple[int, int]:
        """Where a range ends that has at most so many line breaks, and their number."""
        found, at = 0, start
        with file_system(self.path)[0].open_input_file(path) as f:
            f.seek(start)
            while at < stop:
                block = f.read(min(_BLOCK, stop - at))
                if not block:
                    break
                here = block.count(b"\n")
                if found + here >= records:
                    k = -1
                    for _ in range(records - found):
                        k = block.index(b"\n", k + 1)
                    return at + k + 1, records
                found, at = found + here, at + len(block)
        return at, found

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        journal = self._open()
        merged: dict[tuple, list] = {}
        for n in range(start["plan"] + 1, end["plan"] + 1):
            for path, generation, a, b, _ in journal.read("plan", n):
                own = merged.setdefault((path, generation), [a, b])
                own[1] = b
        return [Stretch(path, generation, at, min(at + self.part_bytes, b)) for (path, generation), (a, b) in merged.items() for at in range(a, b, self.part_bytes)]

    def commit(self, end: dict) -> None:
        self._open().forget(end["plan"])

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        with file_system(self.path)[0].open_input_file(partition.path) as f:
            for offset, length, line in lines_ending(f, partition.start, partition.stop, self.record_bytes):
                rows.append((partition.path, partition.generation, offset, length, None if line is None else line.decode("utf-8", "replace")))
                held += length
                if held > 4 << 20 or len(rows) >= 4096:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def lines_ending(f, start: int, stop: int, longest: int) -> Iterator[tuple[int, int, bytes | None]]:
    """(offset, length, line without its break) of the lines whose break lies in [start, stop); None for a line longer than allowed."""
    f.seek(start)
    at, begin, held = start, None, b""
    while at < stop:
        block = f.read(min(_BLOCK, stop - at))
        if not block:
            return
        first = 0
        while (k := block.find(b"\n", first)) >= 0:
            if begin is None:  # the first line may begin before the range
                begin = _line_start(f, start)
                size = at + k - begin
                if size <= longest:
                    f.seek(begin)
                    held = f.read(size - (k - first))
                f.seek(at + len(block))
            size = at + k - begin
            yield begin, size, (held + block[first:k]).removesuffix(b"\r") if size <= longest else None
            held, first, begin = b"", k + 1, at + k + 1
        if begin is not None and len(held) <= longest:
            held += block[first:]
        at += len(block)


def _line_start(f, at: int) -> int:
    """The offset behind the last line break before a place."""
    while at > 0:
        low = max(0, at - _BLOCK)
        f.seek(low)
        k = f.read(at - low).rfind(b"\n")
        if k >= 0:
            return low + k + 1
        at = low
    return 0


def transcript_stream(spark: SparkSession, path: str, journal: str, **options: int | str) -> DataFrame:
    """The lines of transcript files under path (source_id, at, value) as they are appended; at orders the lines of a source, generation first.

    journal is a folder of this query alone. With trigger(availableNow=True) a start takes one batch, bounded as any other; a
    running query goes on until nothing is left."""
    ship(spark)
    spark.dataSource.register(GrowingLines)
    lines = spark.readStream.format("growing_lines").option("journal", journal).options(**options).load(path)
    return lines.select("source_id", F.struct("generation", "offset").alias("at"), "value")


def newest_generation(rows: DataFrame) -> DataFrame:
    """Of rows with at = (generation, offset) in a table those of each source's newest generation."""
    newest = rows.groupBy("source_id").agg(F.max("at.generation").alias("_newest"))
    return rows.join(newest, "source_id").where("at.generation = _newest").drop("_newest")
